"""Quality rules: base statistics and a hashed n-gram likelihood ratio, DataFrame functions only.

A text is kept if it passes the base rules and its mean log-likelihood ratio
between two multinomials over hashed word unigrams and bigrams, that of trusted
texts and that of the raw corpus, reaches a threshold.  Every document goes
through both; the decision has no random part.

* raw multinomial: all n-grams of all documents;
* target multinomial: those of all trusted documents (quality 1, not toxic) that
  are not held back;
* held back: all labelled ids with odd hashes, so each label is either counted or judged
  by; a caller may hold back fewer, the ``max_labels`` of lowest hash (equal hashes stay together);
* buckets: the least power of two that is no less than 32 times the square root
  of the number of distinct n-grams (HyperLogLog), and ``BUCKETS`` at least;
* threshold: from those held back.  With g the 1st percentile of the trusted
  scores and j the 90th percentile of the scores of labelled junk, it is
  min(g, (g + j) / 2): no more than about 1 in 100 trusted texts go.  Percentiles are read
  off a histogram with steps of 0.001.  Without trusted texts nothing is
  rejected by the ratio.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowlens.llm.common import cut, words

BUCKETS = 1 << 16
PER_ROOT = 32
#: Trusted ids, ids held back, and ratios of buckets, that are sent to every executor at most, 16 bytes a row; more of them meet texts, and n-grams, dealt by key.
MAX_BROADCAST = 2_000_000
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def zipped(a: str, b: str, skip: int, short: int) -> Column:
    """Hash of each ``a[i]`` with ``b[i + skip]``; ``short``: how many of ``a`` have no partner."""
    head = F.slice(a, 1, F.greatest(F.size(a) - short, F.lit(0)))
    tail = F.slice(b, skip + 1, F.greatest(F.size(b) - skip, F.lit(0)))
    return F.zip_with(head, tail, lambda x, y: F.xxhash64(x, y))


def with_words(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_words`` and the 64-bit hashes of its words, ``_ones``, and of its pairs of words, ``_twos``."""
    df = docs.withColumn("_words", words("text")).withColumn("_ones", F.transform("_words", lambda w: F.xxhash64(w)))
    return df.withColumn("_twos", zipped("_ones", "_ones", 1, 1))


def bucket(hashed: Column, buckets: int) -> Column:
    """``buckets`` is a power of two."""
    return hashed.bitwiseAND(F.lit(buckets - 1)).cast("int")


def base_statistics(df: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    ``df`` comes from :func:`with_words`.  Windows of five words are told apart
    by 64-bit hashes and equal ones are found by sorting the hashes with their
    places, so a text of n words takes n log n steps whatever repeats in it.
    """
    width, text = 5, F.coalesce("text", F.lit(""))
    df = (
        df.withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.aggregate("_words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)))
        .withColumn("n_symbols", (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long"))
        .withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("_fours", zipped("_twos", "_twos", 2, 2))
        .withColumn("_windows", zipped("_fours", "_ones", 4, 1))
    )
    df = df.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    same = lambda s, j: (s["h"] == F.get("_sorted", j - 1)["h"]) | (s["h"] == F.get("_sorted", j + 1)["h"])
    places = F.transform("_sorted", lambda s, j: F.when(same(s, j), s["i"]))
    df = df.withColumn("_places", F.sort_array(F.filter(places, lambda p: p.isNotNull())))
    steps = F.transform("_places", lambda p, j: F.least(F.lit(width), F.coalesce(F.get("_places", j + 1) - p, F.lit(width))))
    df = df.withColumn("n_repeat_words", F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x))
    return df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def bucket_count(distinct: int) -> int:
    """Buckets for so many distinct n-grams; they grow with the corpus."""
    return max(BUCKETS, 1 << (math.ceil(PER_ROOT * math.sqrt(distinct)) - 1).bit_length())


def distinct_grams(df: DataFrame) -> int:
    return df.select(F.explode(F.concat("_ones", "_twos")).alias("g")).agg(F.approx_count_distinct("g")).first()[0]


def label_kinds(labels: DataFrame, max_labels: int | None = None) -> DataFrame:
    """All labelled ids with ``_kind``, 1 trusted or 0 junk, and ``_held``: those of odd hash, or at most ``max_labels`` of them."""
    rows = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_label_id")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    kind = F.when((F.col("q") == 1) & (F.col("t") == 0), 1).when(F.col("q") == 0, 0)
    rows = rows.select("_label_id", kind.alias("_kind"), F.xxhash64("_label_id").alias("_order")).filter(F.col("_kind").isNotNull())
    odd = F.pmod("_order", F.lit(2)) == 1
    if max_labels is None:
        return rows.select("_label_id", "_kind", odd.alias("_held"))
    first = rows.filter(odd).select("_order").orderBy("_order").limit(max_labels + 1)
    n, last = first.agg(F.count("*"), F.max("_order")).first()
    held = odd & (F.col("_order") < last) if n > max_labels else odd
    return rows.select("_label_id", "_kind", held.alias("_held"))


def marked(texts: DataFrame, trusted: DataFrame, most: int = MAX_BROADCAST) -> DataFrame:
    """``texts`` with ``_trusted``, whether their ids, ``_id``, are in the table ``trusted`` (_label_id, no id twice)."""
    ids = trusted.withColumn("_trusted", F.lit(True))
    ids = F.broadcast(ids) if trusted.count() <= most else ids
    return texts.join(ids, F.col("_id") == F.col("_label_id"), "left").drop("_label_id").withColumn("_trusted", F.coalesce("_trusted", F.lit(False)))


def grams(*keep: str) -> list[Column]:
    """``keep`` and, as ``b`` once exploded, the hash of each n-gram."""
    return [*keep, F.explode(F.concat("_ones", "_twos")).alias("g")]


def ratios(texts: DataFrame, buckets: int) -> DataFrame:
    """(b, w), a row a bucket that holds an n-gram: log p(bucket | trusted) - log p(bucket | raw), counts plus one."""
    rows = texts.select(*grams("_trusted"))
    counts = cut(rows.groupBy(bucket(F.col("g"), buckets).alias("b")).agg(F.count("*").alias("raw"), F.count_if("_trusted").alias("trusted")))
    n_raw, n_trusted = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)), F.coalesce(F.sum("trusted"), F.lit(0))).first()
    log = lambda x, n: F.log((F.col(x) + 1) / F.lit(n + buckets))
    return counts.select("b", (log("trusted", n_trusted) - log("raw", n_raw)).alias("w"))


def scores(texts: DataFrame, weights: DataFrame, buckets: int) -> DataFrame:
    """(_id, _hash, score): the mean ratio of each text's n-grams, for texts with any; rows with equal ids and texts share one.

    Only n-grams meet the ratios, and only a sum and a number a text move: no row carries the ratios.
    """
    rows = with_words(texts).select(*grams("_id", "_hash")).select("_id", "_hash", bucket(F.col("g"), buckets).alias("b"))
    near = F.broadcast(weights) if buckets <= MAX_BROADCAST else weights
    return rows.join(near, "b").groupBy("_id", "_hash").agg(F.round(F.sum("w") / F.count("*"), 9).alias("score"))


def threshold_of(scored: DataFrame) -> DataFrame:
    """One number: the threshold, from rows (_kind, score) of those held back."""
    steps = scored.groupBy("_kind", F.round("score", 3).alias("s")).agg(F.count("*").alias("n"))
    w = W.partitionBy("_kind").orderBy("s")
    steps = steps.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(W.partitionBy("_kind")))
    at = steps.filter((F.col("_kind") == 1) & (100 * F.col("upto") >= F.col("all")) | (F.col("_kind") == 0) & (10 * F.col("upto") >= 9 * F.col("all")))
    ends = at.agg(F.min(F.when(F.col("_kind") == 1, F.col("s"))).alias("g"), F.min(F.when(F.col("_kind") == 0, F.col("s"))).alias("j"))
    return ends.select(F.coalesce(F.least(F.col("g"), (F.col("g") + F.col("j")) / 2), F.col("g"), F.lit(-1e300)).alias("threshold"))


def judged(docs: DataFrame, labels: DataFrame, buckets: int | None, max_labels: int | None) -> DataFrame:
    """The columns of ``docs`` as ``_0``, ``_1``, ... beside ``COLUMNS``; so no name of the caller's is in the way."""
    own = [f"_{k}" for k in range(len(docs.columns))]
    id, text = (F.col(own[docs.columns.index(c)]) for c in ("doc_id", "text"))
    rows = docs.toDF(*own).select(*own, id.alias("_id"), text.alias("text"), F.xxhash64(text).alias("_hash"))
    texts = rows.select("_id", "_hash", "text")
    buckets = buckets or bucket_count(distinct_grams(with_words(texts)))
    kinds = cut(label_kinds(labels, max_labels))
    trusted = kinds.filter((F.col("_kind") == 1) & ~F.col("_held")).select("_label_id")
    weights = cut(ratios(with_words(marked(texts, trusted)), buckets))
    found = cut(scores(texts, weights, buckets))
    held = kinds.filter("_held")
    held = F.broadcast(held) if held.count() <= MAX_BROADCAST else held
    again = texts.join(held, F.col("_id") == F.col("_label_id")).select("_id", "_hash", "_kind")
    least = threshold_of(again.join(found, ["_id", "_hash"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))).first()[0]
    # A row of its own makes the statistics: a filter on them stays above it, where it would otherwise be moved below the
    # projections and write their chain of expressions out once for each use.
    base = base_statistics(with_words(rows)).select(*own, "_id", "_hash", F.inline(F.array(F.struct(*COLUMNS[:-2]))))
    by = found.select(F.col("_id").alias("_i"), F.col("_hash").alias("_h"), "score")
    out = base.join(by, base["_id"].eqNullSafe(by["_i"]) & (base["_hash"] == by["_h"]), "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least)).select(*own, *COLUMNS)


def quality(docs: DataFrame, labels: DataFrame, buckets: int | None = None, max_labels: int | None = None) -> DataFrame:
    """``docs`` with the base statistics, ``score`` and ``kept``.

    The score is the mean ratio over a text's n-grams; a text without words has
    score 0 and fails the base rules.  Null texts have no words.  Rows may
    repeat; ids and other columns may be null or repeat; extra columns pass
    through, but those named like one of ``COLUMNS`` give way to it.  Scores
    that tie with the threshold are kept.  An empty table gives an empty result.
    """
    return judged(docs, labels, buckets, max_labels).select(*(F.col(f"_{k}").alias(c) for k, c in enumerate(docs.columns) if c not in COLUMNS), *COLUMNS)


def kept_documents(docs: DataFrame, labels: DataFrame, buckets: int | None = None, max_labels: int | None = None) -> DataFrame:
    """The rows of ``docs`` that :func:`quality` keeps, all their columns as they are."""
    return judged(docs, labels, buckets, max_labels).filter("kept").select(*(f"_{k}" for k in range(len(docs.columns)))).toDF(*docs.columns)
