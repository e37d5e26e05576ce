"""Callers' columns of any name and type come back as they are from the pipeline's operators and the pipeline."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowlens.llm import mixing, quality, secrets, simhash

NAMES = ["a.b", "_row", "_size", "_key", "_id", "_k", "_r", "_slot", "_words", "_text", "_c3", "fp", "root_fp", "_0", "score", "kept", "rank", "judged", "a b", "ü`x"]


@pytest.fixture()
def wide(spark):
    text = "The quick brown fox jumps over the lazy dog and runs away now, as foxes do. bearer q8Zt0LmX2vB7nR4kY9sW1cHd "
    rows = [(i, f"{text} number {i} {'word ' * i}", "en", f"s{i % 3}", 10) for i in range(12)] + [(3, f"{text} number 3 {'word ' * 3}", "en", "s0", 10), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *(F.concat(F.lit(f"{k}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for k, n in enumerate(NAMES)))
    return docs.withColumn("map", F.create_map(F.lit("k"), "doc_id")).withColumn("deep", F.array(F.struct(F.create_map(F.lit(1), F.lit(2)).alias("m"))))


def as_they_were(out, docs):
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    rows = out.collect()
    for r in rows:
        own = "-" if r["doc_id"] is None else r["doc_id"]
        assert [r[n] for n in NAMES] == [f"{k}/{own}" for k in range(len(NAMES))]
        assert r["map"] == {"k": r["doc_id"]} and r["deep"][0]["m"] == {1: 2}
    return rows


def test_columns_of_stages(spark, wide):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = as_they_were(quality.kept_documents(wide, labels), wide)
    assert 0 < len(kept) < 14
    one = as_they_were(simhash.keep_one(wide), wide)
    assert len({r["doc_id"] for r in one}) == len(one)
    clean = as_they_were(secrets.redact(wide), wide)
    assert len(clean) == 14 and all("q8Zt0LmX" not in (r["text"] or "") and r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in clean)
    mixed = as_they_were(mixing.mixed_documents(wide), wide)
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in one} | {r["doc_id"] for r in clean}


def test_columns_through_the_stages_of_the_pipeline(spark, wide, monkeypatch):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(corpus_pipeline, "table", lambda spark, d, name: labels)
    docs = wide
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == wide.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == len(as_they_were(docs, wide)) > 0
