"""Mixing sources to target weights by a low-discrepancy schedule.

The stream is a row of slots of ``block`` words.  Slot k takes the golden-ratio
point frac((k + 1) * phi); the cumulative target shares say which source owns
that point.  The slots of a source, ranked, are its blocks 0, 1, 2, ...: equal
stretches of the line on which its documents lie in shuffled order, repeated as
often as the target asks for.  Slots past a source's target are left out, the
few that the schedule still owes are appended, and the last block ends at the
target, so a source gives floor(target) words.

No step needs a whole source in one task: documents are laid out by hash bucket
(bucket sums, then places inside the bucket), slots are ranked by chunk, points
meet sources by cell, and pieces meet slots by (source, block).  Buckets and
cells grow with the rows and slots.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowlens.llm.common import aside, cut, row_hash, words

#: Fixed value: 1 / golden ratio.
PHI = 0.6180339887498949
BLOCK = 1024
MOST = 3
CHUNK = 1 << 16
#: Documents of a bucket and slots of a cell, about.
PER_BUCKET, PER_CELL = 4096, 4096


def shuffle_key(df: DataFrame) -> DataFrame:
    """Adds ``_key``, equal for rows with equal ids and texts, in no order of either, and ``_row``, a hash of all columns, which tells such rows apart."""
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), text).cast("binary"))
    return df.withColumn("_row", row_hash(df)).withColumn("_key", key)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """``source``, ``source_size``, ``rank``, ``target`` and the share's ends ``lo``, ``hi``; a row for each source.

    ``sizes`` has ``source`` and ``source_size``.  Sources are ranked by code
    point, null last, and weigh ``weights`` in turn.  Targets are
    min(most * size, level * weight), with the level at which they add up to
    the whole size: what resharing the excess by weight converges to.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")  # a row for each source
    table = sizes.withColumn("rank", F.row_number().over(by_name))
    cycle = F.array(*(F.lit(w).cast("long") for w in weights))
    table = table.withColumn("w", F.get(cycle, (F.col("rank") - 1) % len(weights)))
    table = table.withColumn("cap", F.col("source_size") * most)
    by_ratio = W.orderBy(F.col("cap") / F.col("w"), "rank")
    table = table.withColumn("all", F.sum("source_size").over(W.partitionBy())).withColumn("capped", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    table = table.withColumn("level", (F.col("all") - F.col("capped")) / F.sum("w").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "rank", "level"))).over(W.partitionBy())["level"]
    table = table.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("w")))
    share = F.when(F.col("all") > 0, F.col("target") / F.col("all")).otherwise(F.lit(0.0))
    table = table.withColumn("hi", F.sum(share).over(W.orderBy("rank"))).withColumn("lo", F.col("hi") - share)
    return table.select("source", "source_size", "rank", "target", F.lag("hi", 1, 0.0).over(W.orderBy("rank")).alias("lo"), "hi")


def schedule(table: DataFrame, slots: int, block: int = BLOCK) -> DataFrame:
    """``rank`` (the source's), ``number`` (of the block in its source) and ``slot``, in a low-discrepancy order."""
    spark, cells = table.sparkSession, 1 << max(10, (slots // PER_CELL).bit_length())
    points = spark.range(slots).withColumn("u", (F.col("id") + 1) * F.lit(PHI) - F.floor((F.col("id") + 1) * F.lit(PHI)))
    points = points.withColumn("cell", F.floor(F.col("u") * cells))
    last = F.max(F.when(F.col("hi") > F.col("lo"), F.col("rank"))).over(W.partitionBy())
    owned = table.withColumn("hi", F.when(F.col("rank") == last, F.lit(2.0)).otherwise(F.col("hi"))).filter("hi > lo")
    owned = owned.select("rank", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))).alias("cell"))
    drawn = points.join(owned, "cell").filter("u >= lo and u < hi").select("rank", "id", F.floor(F.col("id") / CHUNK).alias("chunk"))
    counts = drawn.groupBy("rank", "chunk").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("rank").orderBy("chunk")) - F.col("n")).drop("n")
    ranked = drawn.withColumn("k", F.row_number().over(W.partitionBy("rank", "chunk").orderBy("id")) - 1).join(before, ["rank", "chunk"])
    need = table.select("rank", F.ceil(F.floor("target") / block).alias("need"))
    found = ranked.select("rank", (F.col("before") + F.col("k")).alias("number"), F.col("id").alias("slot"))
    have = counts.groupBy("rank").agg(F.sum("n").alias("have"))
    owed = need.join(have, "rank", "left").withColumn("have", F.coalesce("have", F.lit(0))).filter("have < need")
    owed = owed.select("rank", F.explode(F.sequence(F.col("have"), F.col("need") - 1)).alias("number"), F.lit(slots).alias("slot"))
    return found.join(need, "rank").filter("number < need").drop("need").unionByName(owed)


def line(docs: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """Documents with ``rank``, ``place`` (first word on the source's shuffled line), ``nth`` (among equal rows) and the source's columns; ``n`` rows in all."""
    digits = next(d for d in range(1, 33) if 16**d * PER_BUCKET >= n)
    rows = docs.withColumn("_bucket", F.substring("_key", 1, digits))
    sums = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("_before", F.sum("n").over(W.partitionBy("source").orderBy("_bucket")) - F.col("n")).drop("n")
    sums = sums.withColumnRenamed("source", "_s").withColumnRenamed("_bucket", "_b")
    inside = W.partitionBy("source", "_bucket").orderBy("_key", "_row")
    rows = rows.withColumn("place", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    rows = rows.withColumn("nth", F.row_number().over(inside) - F.rank().over(inside))
    rows = rows.join(sums, rows["source"].eqNullSafe(sums["_s"]) & (rows["_bucket"] == sums["_b"])).withColumn("place", F.col("place") + F.col("_before"))
    src = sources.select(F.col("source").alias("_s"), "source_size", "rank", "target")
    return rows.drop("_s", "_b", "_before").join(src, F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "_bucket")


IDENTITY = ("rank", "_key", "_row", "nth")


def pieces(placed: DataFrame, slots: DataFrame, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """The mixed stream: ``slot``, ``number``, ``IDENTITY``, ``doc_id``, ``round``, and words ``first`` to ``stop`` of the document."""
    rounds = placed.filter("size > 0").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    at = F.col("round") * F.col("source_size") + F.col("place")
    spans = rounds.select(*IDENTITY, "doc_id", "round", at.alias("at"), F.least(at + F.col("size"), F.floor("target")).alias("end")).filter("at < end")
    cuts = spans.withColumn("number", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("end") - 1) / block))))
    first = F.greatest(F.col("at"), F.col("number") * block) - F.col("at")
    stop = F.least(F.col("end"), (F.col("number") + 1) * block) - F.col("at")
    return cuts.select(*IDENTITY, "number", "doc_id", "round", first.alias("first"), stop.alias("stop")).join(slots, ["rank", "number"])


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), block: int = BLOCK, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(documents with ``size``, ``source_size``, ``target``, ``taken``, ``first_slot`` and ``n_slots``; the stream of :func:`pieces`).

    A document's size is its number of words (null: 0); ``taken`` counts the
    words that the stream takes of it, repeats counted, ``n_slots`` the slots
    that hold some, and ``first_slot`` is the first of these, null if it takes
    none.  Rows may repeat, ids and sources may be null, an empty table gives no
    rows; further columns only tell equal documents apart.  ``documents`` also
    has ``IDENTITY`` and ``source``.
    """
    rows = cut(shuffle_key(docs).select("doc_id", "source", "_key", "_row", F.size(words("text")).cast("long").alias("size")))
    sources = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    placed = cut(line(rows, sources, rows.count()))
    stream = cut(pieces(placed, schedule(sources, math.ceil(total / block), block), block, most))
    taken = stream.groupBy(*IDENTITY).agg(F.sum(F.col("stop") - F.col("first")).alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n_slots"))
    done = placed.join(taken, list(IDENTITY), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return done.select("doc_id", "source", *IDENTITY, "size", "source_size", "target", zero("taken"), "first_slot", zero("n_slots")), stream


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), block: int = BLOCK, most: int = MOST) -> DataFrame:
    """``docs`` as the mix takes them, with their own columns, in the order of the schedule.

    A document taken t times as long as it is comes t times; a rest comes as one
    more row whose text ends with the last word taken.  Each taking stands where
    the slot is that holds its first word: rows are dealt out by ranges of slots
    and sorted within, so part files in order are the stream.  Documents of no
    words, which no target counts, stay as they are, before the others.
    ``n_chars``, if there, follows.  Rows that repeat are taken as often as they
    are there; ids and sources may be null; an empty table gives no rows. Further
    columns may have any name and type; they come back as they are.
    """
    own, names = aside(docs, "doc_id", "source", "text", "n_chars")
    placed, stream = mix(own, weights, block, most)
    takings = stream.groupBy("_key", "_row", "rank", "nth", "round").agg(F.min("slot").alias("_slot"), F.min("number").alias("_number"), F.sum(F.col("stop") - F.col("first")).alias("_words"))
    takings = takings.select("_key", "_row", "_slot", "_number", "_words")
    blank = placed.filter("size = 0").select("_key", "_row", F.lit(-1).cast("long").alias("_slot"), F.lit(-1).cast("long").alias("_number"), F.lit(-1).cast("long").alias("_words"))
    sizes = placed.groupBy("_key", "_row").agg(F.first("size").alias("_size"))
    takings = takings.unionByName(blank).join(sizes, ["_key", "_row"]).withColumnsRenamed({"_key": "_k", "_row": "_r"})
    rows = shuffle_key(own).dropDuplicates(["_key", "_row"])  # equal in all columns
    rows = rows.join(takings, (rows["_key"] == takings["_k"]) & (rows["_row"] == takings["_r"]))
    parts = F.split(F.col("text"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # each part ends with a word
    whole = (F.col("_words") < 0) | (F.col("_words") == F.col("_size"))
    rows = rows.withColumn("text", F.when(whole, F.col("text")).otherwise(F.array_join(F.slice(parts, 1, F.greatest(F.col("_words"), F.lit(1)).cast("int")), "")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(own.schema["n_chars"].dataType))
    order = ["_slot", "_number", "_k", "_r"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*names).toDF(*docs.columns)
