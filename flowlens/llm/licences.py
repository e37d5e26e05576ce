"""License scans: a trained paragraph classifier whose finds templates confirm.  DataFrame functions and Spark ML only.

Paragraphs are runs of lines that are not blank, so wrapped notices and those in
comments are read as one; a line without letters or digits counts as blank.
Paragraphs of more than ``WINDOW`` words are read in windows that overlap by
half.  Features are the distinct word unigrams and bigrams of a window, hashed,
as sparse vectors.  A multinomial logistic regression with an elastic net tells
the licence families and ``unknown`` apart.  It learns the families from their
notices and from copies of these with words left out, and ``unknown`` from
ordinary sentences and a sample of ``sample`` windows, about, of the documents
that hold no notice.

The unknown class is calibrated on the windows of all documents: a family must
reach the probability that at most 1 in 1,000 of the windows that resemble no
notice reach, and one half at least.  A find counts if the window also
holds enough of the words and pairs of words of one of the family's notices;
further families of which such a window holds a notice nearly whole are found too.
"""

from __future__ import annotations

import json
from functools import reduce
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowlens.llm.common import cut
from flowlens.llm.notices import ORDINARY, templates

BUCKETS = 1 << 15
WINDOW = 64
#: Windows from which the unknown class is fitted, about.
SAMPLE = 4000
#: Share of a notice's words and pairs that confirms a find, and that makes one beside a likelier family.
HELD, WHOLE = 0.6, 0.95
LEAST = 0.5
FAMILIES = sorted(templates())
FOUND = "array<struct<window:int,family:string,probability:double,held:double>>"


def plain_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def paragraphs(text: Column) -> Column:
    """Word arrays of a text's paragraphs."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n[^\p{L}\p{N}\n]*\n"), plain_words), lambda ws: F.size(ws) > 0)


def starts(n: Column) -> Column:
    """Where the windows of a paragraph of n words begin, from 1."""
    return F.sequence(F.lit(1), F.greatest(n - WINDOW // 2, F.lit(1)), F.lit(WINDOW // 2))


def windows(text: Column) -> Column:
    """Word arrays of a text's paragraphs, long ones in overlapping windows."""
    return F.flatten(F.transform(paragraphs(text), lambda ws: F.transform(starts(F.size(ws)), lambda s: F.slice(ws, s, WINDOW))))


def grams(ws: Column) -> Column:
    """Hashes of the distinct words and pairs of words of a window."""
    ones = F.transform(ws, lambda w: F.xxhash64(w))
    most = F.greatest(F.size(ones) - 1, F.lit(0))
    return F.array_distinct(F.concat(ones, F.zip_with(F.slice(ones, 1, most), F.slice(ones, 2, most), lambda a, b: F.xxhash64(a, b))))


def bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def constant(numbers: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(numbers)), f"array<{kind}>")  # folded to a constant by the optimizer


def notice_grams(spark) -> dict[str, list[list[int]]]:
    """Hashes of each family's notices."""
    rows = [F.struct(F.lit(f).alias("f"), F.lit(t).alias("t")) for f, ts in sorted(templates().items()) for t in ts]
    got = spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.f", grams(plain_words(F.col("r.t"))).alias("g")).collect()  # the notices of notices.py
    out: dict[str, list[list[int]]] = {f: [] for f in FAMILIES}
    for r in got:
        out[r["f"]].append(sorted(r["g"]))
    return out


def held_share(gs: Column, notices: list[list[int]]) -> Column:
    """Largest share of the hashes of one of the notices that a window holds."""
    shares = [F.size(F.array_intersect(gs, constant(own, "bigint"))) / len(own) for own in notices]
    return F.greatest(*shares) if len(shares) > 1 else shares[0]


def examples(docs: DataFrame, notices: dict[str, list[list[int]]], sample: int) -> DataFrame:
    """``_grams`` and ``_label`` (a family's number, or the number of families for unknown).

    The sample of windows is by hash: first of documents, then of their windows, so no rows
    are ordered or gathered for it.
    """
    spark = docs.sparkSession
    rows = [F.struct(F.lit(FAMILIES.index(f)).alias("k"), F.lit(t).alias("t")) for f, ts in sorted(templates().items()) for t in ts]
    known = spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select(F.col("r.k").alias("_label"), F.explode(windows(F.col("r.t"))).alias("_all"))
    known = known.select("_label", "_all", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("v"))
    known = known.select("_label", F.filter("_all", lambda w, i: (F.col("v") == 6) | (i % 6 != F.col("v"))).alias("_words"))
    plain = spark.range(1).select(F.explode(F.array(*(plain_words(F.lit(t)) for t in ORDINARY))).alias("_words"))
    below = lambda h, share: F.pmod(h, F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))
    n = docs.filter("_text is not null").count()
    some = docs.select("_text", F.xxhash64("_text").alias("_d")).filter(below(F.col("_d"), sample / max(n, 1)))
    drawn = cut(some.select(F.explode(windows(F.col("_text"))).alias("_words")).withColumn("_h", F.xxhash64("_words")).dropDuplicates(["_h"]))
    drawn = drawn.filter(below(F.col("_h"), sample / max(drawn.count(), 1))).withColumn("_grams", grams(F.col("_words")))
    far = reduce(F.greatest, (held_share(F.col("_grams"), notices[f]) for f in FAMILIES)) < HELD / 2
    unknown = drawn.filter(far).select("_grams").unionByName(plain.select(grams(F.col("_words")).alias("_grams")))
    return known.select("_label", grams(F.col("_words")).alias("_grams")).unionByName(unknown.withColumn("_label", F.lit(len(FAMILIES))))


class Model(NamedTuple):
    """Weights of buckets that have any, by class (unknown last), intercepts, and each bucket's row (0: none)."""

    weights: list[list[float]]
    intercepts: list[float]
    row: list[int]


def learn(docs: DataFrame, notices: dict[str, list[list[int]]], sample: int = SAMPLE) -> Model:
    """The classifier; ``docs`` has ``_text``. Buckets that occur in no notice are no features: they can't tell families apart."""
    rows = cut(examples(docs, notices, sample).withColumn("_names", F.array_distinct(F.transform("_grams", lambda g: bucket(g).cast("string")))).select(F.col("_label").cast("double").alias("label"), "_names"), parts=2)  # about ``sample`` rows
    vector = CountVectorizer(inputCol="_names", outputCol="features", vocabSize=BUCKETS, binary=True).fit(rows.filter(F.col("label") < len(FAMILIES)))
    model = LogisticRegression(family="multinomial", regParam=0.0005, elasticNetParam=0.5, maxIter=60, standardization=False).fit(vector.transform(rows).select("label", "features"))
    table = model.coefficientMatrix.toArray().round(4)
    row, kept = [0] * BUCKETS, [[0.0] * table.shape[0]]
    for name, own in zip(vector.vocabulary, table.T.tolist()):
        if any(own):
            row[int(name)] = len(kept)
            kept.append(own)
    return Model([list(x) for x in zip(*kept)], model.interceptVector.toArray().tolist(), row)


def likely(docs: DataFrame, model: Model, notices: dict[str, list[list[int]]], keep: list[str]) -> DataFrame:
    """``keep``, ``n_windows`` and ``_likely``: windows in which some family is likelier than unknown, with all probabilities and shares held.

    A family's lead over unknown is at most the sum of the largest leads of the
    window's buckets; windows that cannot lead that way are passed over first.
    """
    lead = [round(max(own) - u, 4) for own, u in zip(zip(*model.weights[:-1]), model.weights[-1])]
    need = model.intercepts[-1] - max(model.intercepts[:-1])
    row, leads = constant(model.row, "int"), constant(lead, "double")
    row_of = lambda h: F.get(row, bucket(h))

    def numbered(ws: Column) -> Column:
        """Rows in the model of a paragraph's words and of its pairs of words; each is hashed once, however many windows it is in."""
        most = F.greatest(F.size(ws) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(ws, 1, most), F.slice(ws, 2, most), lambda a, b: row_of(F.xxhash64(F.xxhash64(a), F.xxhash64(b))))
        return F.struct(F.transform(ws, lambda w: row_of(F.xxhash64(w))).alias("ones"), pairs.alias("twos"))

    def cut_out(x: Column, i: Column) -> Column:
        any_of = lambda at: F.array_distinct(F.filter(F.concat(F.slice(x["ones"], at, WINDOW), F.slice(x["twos"], at, WINDOW - 1)), lambda r: r > 0))
        return F.transform(starts(F.size(x["ones"])), lambda at: F.struct(i.alias("part"), at.alias("at"), any_of(at).alias("rows")))

    def scores(x: Column) -> Column:
        one = lambda own, bias: F.exp(F.aggregate(x["rows"], F.lit(bias), lambda a, r: a + F.get(constant(own, "double"), r)))
        return x.withField("e", F.array(*(one(own, bias) for own, bias in zip(model.weights, model.intercepts))))

    def judged(x: Column) -> Column:
        total, gs = F.aggregate(x["e"], F.lit(0.0), lambda a, b: a + b), grams(F.slice(F.get("_parts", x["part"]), x["at"], WINDOW))
        held = F.transform(F.array(gs), lambda g: F.array(*(held_share(g, notices[f]) for f in FAMILIES)))  # the hashes once for all notices
        return F.struct(x["window"].alias("window"), F.transform(x["e"], lambda v: v / total).alias("p"), F.get(held, 0).alias("held"))

    df = docs.select(*keep, paragraphs(F.col("_text")).alias("_parts"))
    df = df.withColumn("_seen", F.flatten(F.transform(F.transform("_parts", numbered), cut_out)))
    df = df.withColumn("n_windows", F.size("_seen").cast("long"))
    leading = F.filter(F.transform("_seen", lambda x, i: x.withField("window", i)), lambda x: F.aggregate(x["rows"], F.lit(0.0), lambda a, r: a + F.get(leads, r)) >= need)
    df = df.withColumn("_seen", F.filter(F.transform(leading, scores), lambda x: F.array_max(F.slice(x["e"], 1, len(FAMILIES))) >= F.get(x["e"], len(FAMILIES))))
    return df.select(*keep, "n_windows", F.transform("_seen", judged).alias("_likely"))


def calibrated(found: DataFrame) -> float:
    """The probability that at most 1 in 1,000 of the windows that resemble no notice reach, of all documents; ``LEAST`` at least."""
    total = found.agg(F.coalesce(F.sum("n_windows"), F.lit(0))).first()[0]
    each = found.select(F.explode("_likely").alias("x")).filter(F.array_max("x.held") < HELD / 2)
    steps = each.groupBy(F.ceil(F.array_max(F.slice("x.p", 1, len(FAMILIES))) * 1000).alias("s")).agg(F.count("*").alias("n"))  # 1,000 rows at most
    above = steps.withColumn("above", F.sum("n").over(W.orderBy(F.desc("s"))))
    least = above.filter(1000 * F.col("above") > total).agg(F.max("s")).first()[0]
    return max(LEAST, min(1.0, (least or 0) / 1000))


def scan(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``keep`` (all columns of ``docs`` if not given), ``n_windows`` and ``licences``: array of (window, family, probability, held), in text order.

    Null and empty texts have no windows.  Rows may repeat, an empty table gives
    an empty result.  Columns of ``keep`` named like the two results give way to
    them.  If families tie in probability, all of them that a notice confirms
    are found.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_windows", "licences")]
    work = docs.select(F.struct(*keep).alias("_row"), F.col(text_col).alias("_text"))
    notices = notice_grams(docs.sparkSession)
    found = cut(likely(work, learn(work, notices, sample), notices, ["_row"]))
    least = calibrated(found)

    def families(x: Column) -> Column:
        own = F.slice(x["p"], 1, len(FAMILIES))
        is_one = lambda p, h: (p >= least) & (p == F.array_max(own)) & (h >= HELD) | (h >= WHOLE)
        each = F.zip_with(own, x["held"], lambda p, h: F.struct(p.alias("p"), h.alias("h"), is_one(p, h).alias("yes")))
        named = F.transform(each, lambda e, k: F.struct(x["window"].alias("window"), F.get(F.array(*map(F.lit, FAMILIES)), k).alias("family"), e["p"].alias("probability"), e["h"].alias("held"), e["yes"].alias("yes")))
        return F.transform(F.filter(named, lambda e: e["yes"]), lambda e: F.struct(e["window"], e["family"], e["probability"], e["held"]))

    return found.select("_row.*", "n_windows", F.flatten(F.transform("_likely", families)).cast(FOUND).alias("licences"))
