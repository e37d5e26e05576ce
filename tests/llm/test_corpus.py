"""Quality rules, SimHash components, mixing and the pipeline against brute force."""

import collections
import hashlib
import random

import brute
import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowlens.llm import mixing, quality, queries, secrets, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def labels(spark):
    return {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def test_quality_equals_brute_force(spark, texts, labels):
    want = brute.quality(texts, labels, quality.BUCKETS)
    for r in queries.op3_quality_rules(spark, SF).collect():
        score, kept = want[r["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.base_statistics(texts[r["doc_id"]])
        assert r["score"] == pytest.approx(score, abs=2e-6) and r["kept"] == kept


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 1, 0), (5, 1, 0), (None, 1, None), (6, None, None)], "doc_id long, quality int, toxic int")
    rows = quality.quality(odd.select("doc_id", "text", "source", "t"), labels).collect()
    assert len(rows) == 9 and not any(r["kept"] for r in rows if r["doc_id"] in (2, 3, 4, 6))
    assert all(r["kept"] for r in rows if r["doc_id"] == 1)
    assert quality.quality(none, labels).count() == 0
    assert quality.quality(odd.select("doc_id", "text"), labels.limit(0)).filter("kept").count() == 3
    kept = quality.kept_documents(odd, labels)
    assert kept.columns == odd.columns and kept.count() == sum(r["kept"] for r in rows)
    assert all(r["score"] == 0.5 and r["fp"] == 3 for r in kept.collect())  # the caller's own columns
    clash = quality.quality(odd, labels).collect()
    assert sorted(r["score"] for r in clash) == sorted(r["score"] for r in rows) and all(r["rank"] == 1 for r in clash)


def test_trusted_ids_meet_texts_either_way(spark, docs):
    trusted = docs.select(F.col("doc_id").alias("_label_id")).filter("doc_id % 3 = 0")
    a, b = (quality.marked(docs.select(F.col("doc_id").alias("_id"), "text"), trusted, most) for most in (10**6, 0))
    assert "BroadcastHashJoin" in a._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.filter("_trusted").count() == trusted.count()


def test_ratios_grow_with_the_corpus(spark, docs, texts, labels):
    assert quality.BUCKETS >= 1 << 16 and [quality.bucket_count(n) for n in (0, 10**6, 10**8, 10**10)] == [1 << 16, 1 << 16, 1 << 19, 1 << 22]
    # of the labels of odd hash only the first is held back; every other trusted document counts
    table = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r["score"] for r in quality.quality(docs.select("doc_id", "text"), table, max_labels=1).collect()}
    grams = {i: brute.gram_buckets(t, quality.BUCKETS) for i, t in texts.items()}
    order = {i: brute.signed(brute.spark_xx(i, 42)) for i, (q, toxic) in labels.items() if q == 0 or (q, toxic) == (1, 0)}
    held = min((i for i in order if order[i] % 2), key=order.get)
    raw, trusted = collections.Counter(), collections.Counter()
    for i, g in grams.items():
        raw.update(g)
        if labels.get(i) == (1, 0) and i != held:
            trusted.update(g)
    n_raw, n_trusted = raw.total() + quality.BUCKETS, trusted.total() + quality.BUCKETS
    for i, g in grams.items():
        want = sum(np.log((trusted[b] + 1) / n_trusted) - np.log((raw[b] + 1) / n_raw) for b in g) / len(g) if g else 0.0
        assert got[i] == pytest.approx(want, abs=2e-6)


def test_every_label_is_counted_or_judged_by(spark):
    labels = spark.range(40_000).select(F.col("id").alias("doc_id"), (F.col("id") % 4 > 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    kinds = {r["_label_id"]: (r["_kind"], r["_held"]) for r in quality.label_kinds(labels).collect()}
    assert kinds == {i: (int(i % 4 > 0), brute.signed(brute.spark_xx(i, 42)) % 2 == 1) for i in range(40_000)}
    assert sum(held for _, held in kinds.values()) > 19_000


@pytest.fixture(scope="module")
def many(spark):
    """24,000 short documents, all labelled, and their texts and labels."""
    pick = random.Random(3)
    texts = {i: " ".join(pick.choice("abcdefgh") + pick.choice("klmn") for _ in range(12)) for i in range(24_000)}
    labels = {i: (int(i % 4 > 0), 0) for i in texts}
    return texts, labels, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame([(i, *v) for i, v in labels.items()], "doc_id long, quality int, toxic int")


def test_threshold_comes_from_all_labels_held_back(many):
    texts, labels, docs, table = many
    want = {i for i, (_, kept) in brute.quality(texts, labels, quality.BUCKETS).items() if kept}
    assert {r["doc_id"] for r in quality.quality(docs, table, quality.BUCKETS).filter("kept").collect()} == want
    assert {r["doc_id"] for r in quality.quality(docs, table, quality.BUCKETS, 10_000).filter("kept").collect()} != want


def test_first_stage_of_the_pipeline_uses_all_labels(spark, many, tmp_path):
    texts, labels, docs, table = many
    table.write.parquet(f"{tmp_path}/labels.parquet")
    want = {i for i, (_, kept) in brute.quality(texts, labels, quality.BUCKETS).items() if kept}
    assert {r["doc_id"] for r in corpus_pipeline.quality_rules(spark, docs, str(tmp_path)).collect()} == want


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 30])
def test_repeats_of_short_texts(spark, n):
    rows = [(i, t) for i, t in enumerate([" ".join(["a"] * n), " ".join("abcde"[k % 5] for k in range(n)), "\n".join(["x y"] * n)])]
    got = quality.base_statistics(quality.with_words(spark.createDataFrame(rows, "doc_id long, text string"))).orderBy("doc_id").collect()
    for (_, t), r in zip(rows, got):
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.base_statistics(t)


def test_fingerprints_and_components_equal_brute_force(spark, texts):
    got = {r["doc_id"]: r for r in queries.op4_simhash_near_dup(spark, SF).collect()}
    fps = [(i, brute.fingerprint(t)) for i, t in texts.items()]
    want = brute.components(fps)
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == dict(fps)
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_links_are_complete_and_once(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 60, dtype=np.int64)
    near = [int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 63, (12, 2))]
    near += [int(b) ^ (1 << int(i)) for b in base for i in rng.integers(0, 63, 3)]
    fps = sorted({*map(int, base), *near, 0, -1, 1, 3})
    got = [(r["u"], r["v"]) for r in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()]
    want = {(a, b) for k, b in enumerate(fps) for a in fps[:k] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert len(got) == len(set(got)) and set(got) == want


def test_golay_code_covers():
    words = np.random.default_rng(1).integers(0, 1 << simhash.LENGTH, 5000)
    tables = simhash.patterns(simhash.RADIUS)
    assert (sum(count[simhash.remainders(words)] for _, count in tables) == 1).all()  # one code word within the radius


def test_long_chains_end_at_their_smallest(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 200)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 200: 0, 101: 100}


def test_one_of_each_component_stays(spark, odd, none):
    text = " ".join(f"word{i}" for i in range(200))
    near = text.replace("word7 ", "word7x ")
    rows = [(9, text, "a", 1), (4, text, "b", 2), (4, text, "b", 2), (None, text, "c", 3), (12, near, "d", 4), (20, "Entirely other words stand here today", "e", 5), (21, None, None, None), (22, "", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string, fp int")
    got = simhash.keep_one(df)
    assert got.columns == df.columns and sorted(r["doc_id"] for r in got.collect()) == [4, 20, 21]
    assert simhash.clusters(odd).count() == 9 and simhash.clusters(none).count() == 0 and simhash.keep_one(none).count() == 0


def duck(sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    return con


def test_mix_equals_brute_force_and_sql(spark, docs):
    rows = [(r["doc_id"], r["source"], r["text"]) for r in docs.collect()]
    key = lambda r: tuple(round(x, 6) for x in r)
    want = sorted(map(key, brute.mix(rows)))
    got = queries.op6_mixing(spark, SF).collect()
    assert sorted(key(r[:5]) for r in got) == want
    assert sorted(map(str, map(key, map(lambda r: [x if x is not None else -1 for x in r], got)))) == sorted(map(str, map(key, map(lambda r: [x if x is not None else -1 for x in r], duck(SF).sql(queries.OP6_SQL).fetchall()))))


def test_mix_of_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["source"], r["text"]) for r in odd.collect()]
    mixed, stream = mixing.mix(odd, block=16)
    got = collections.Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixed.collect())
    assert got == collections.Counter((a, b, c, round(d, 6), e) for a, b, c, d, e in brute.mix(rows))
    assert stream.agg(F.max(F.col("stop") - F.col("first"))).first()[0] <= 16
    assert mixing.mix(none)[0].count() == 0 and mixing.mixed_documents(none).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix(blank)[0].collect()] == [0, 0] and mixing.mixed_documents(blank).count() == 2


def test_schedule_spreads_sources(docs):
    table = mixing.targets(docs.groupBy("source").agg(F.sum(F.size(mixing.words("text")).cast("long")).alias("source_size")))
    total = table.agg(F.sum("source_size")).first()[0]
    slots = mixing.schedule(table, -(-total // 64), 64).orderBy("slot").collect()
    share = {r["rank"]: r["hi"] - r["lo"] for r in table.collect()}
    seen = collections.Counter()
    for k, s in enumerate(slots[: total // 64 - 5], 1):
        seen[s["rank"]] += 1
        assert all(abs(seen[r] - k * share[r]) < 6 for r in share)  # any prefix holds the sources' shares
    assert len({(s["rank"], s["number"]) for s in slots}) == len(slots)


def test_mixed_documents_hold_the_taken_words(spark, docs):
    taken = collections.Counter()
    for r in mixing.mix(docs)[0].collect():
        taken[r["doc_id"]] += r["taken"]
    got, whole = collections.Counter(), {r["doc_id"]: r["text"] for r in docs.collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        got[r["doc_id"]] += len(brute.words(r["text"]))
        assert whole[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    assert +got == +taken


def test_mixed_documents_follow_the_schedule(spark, docs):
    """Any prefix of the mixed documents holds the sources' shares, but for the ends of blocks and documents."""
    table = mixing.targets(docs.groupBy("source").agg(F.sum(F.size(mixing.words("text")).cast("long")).alias("source_size"))).collect()
    total = sum(r["source_size"] for r in table)
    parts = mixing.mixed_documents(docs.withColumn("t", F.lit(1))).withColumn("p", F.spark_partition_id()).withColumn("m", F.monotonically_increasing_id()).collect()
    longest, held, seen = max(len(brute.words(r["text"])) for r in parts), 0, collections.Counter()
    for r in sorted(parts, key=lambda r: r["m"]):
        n = len(brute.words(r["text"]))
        seen[r["source"]] += n
        held += n
        assert all(abs(seen[x["source"]] - held * (x["hi"] - x["lo"])) <= longest + 8 * mixing.BLOCK for x in table)
    assert abs(held - total) <= len(table)


def test_rows_that_differ_in_one_column_stay_apart(spark):
    rows = [(1, "a b c d", "s", lang, 7) for lang in ("en", "de", "en")] + [(2, None, "s", None, None)] * 2
    got = collections.Counter(map(tuple, mixing.mixed_documents(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")).collect()))
    assert got == {(1, "a b c d", "s", "en", 7): 2, (1, "a b c d", "s", "de", 7): 1, (2, None, "s", None, None): 2}


def test_pipeline_equals_brute_force(spark, docs, texts, labels):
    import sentencepiece

    rows = {r["doc_id"]: r for r in docs.collect()}
    verdict = brute.quality(texts, labels, quality.BUCKETS)
    kept = [i for i in texts if verdict[i][1]]
    near = brute.components([(i, brute.fingerprint(texts[i])) for i in kept])
    clean, known = {}, secrets.learn(docs.filter(F.col("doc_id").isin([i for i in kept if near[i] == i])))
    for i in (i for i in kept if near[i] == i):
        spans = secrets.find(texts[i], known=known)[1]
        clean[i] = secrets.redacted(texts[i], spans, "[secret]")
        assert all(x in secrets.listed(spans).split(",") for x in brute.base_spans(texts[i]).split(",") if x)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, size, _, _, taken in brute.mix([(i, rows[i]["source"], t) for i, t in clean.items()]):
        ends = [m.end() for m in brute.WORD.finditer(clean[i])]
        parts = [clean[i]] * (taken // size) + ([clean[i][: ends[taken % size - 1]]] if taken % size else [])
        for p in parts:
            ids = library.encode(p)
            want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(want)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and len(set(names)) == 5


def test_pipeline_of_odd_rows(spark, odd, none):
    for start in (odd.select("doc_id", "text", "lang", "source", "n_chars"), none):
        df = start
        for name, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, SF)
            assert df.count() >= 0, name
            if stage is not corpus_pipeline.encoding:
                assert df.columns == start.columns
