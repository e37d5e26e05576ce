"""SimHash near-duplicates by anchor-point covering.

Fingerprints are 64 bits wide.  The anchors are the code words of a product
code over all of them: two binary Golay codes (23, 12) on bits 0-22 and 23-45,
and six repetition codes (3, 1) on bits 46-63.  Every fingerprint lies within
radius 3 of exactly one code word in a Golay block and within radius 1 of
exactly one in a group of three bits; together these are its home.  If two
fingerprints differ in at most t bits, a block in which they differ in d holds
the other's home within its radius + d.  So every distinct fingerprint goes
home once and is replicated to every anchor that it reaches with t bits shared
out among the blocks, and only fingerprints that meet at an anchor are
compared, on all 64 bits.

With t = 2 a fingerprint has about 130 replicas, however many rows there are.
There are 2**30 anchors, so N random fingerprints make about
N * N * 130 / 2**30 comparisons: fewer than replicas up to a billion of them.

Exact copies share a fingerprint and are folded before any of this; what joins
and iterates is distinct fingerprints only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import aside, cut, row_hash

#: Golay code (23, 12, 7), its generator and its covering radius.
GENERATOR, LENGTH, CHECKS, RADIUS = 0b110001110101, 23, 11, 3
GROUPS = 6
#: Fingerprints of more than one row in so many are hot; there are no more hot ones than this.
HOT = 1000
CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of a text as an unsigned number; see :func:`fingerprints`."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        shingles, n = map(b" ".join, zip(*(words[k:] for k in range(width)))), len(words) - width + 1
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(42))
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = np.fromiter(hashes, "<u8", min(CHUNK, n - at))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, carry: list[str] | None = None) -> DataFrame:
    """Adds ``fp`` (the fingerprint's bits as a signed long) to ``id_col`` and the columns of ``carry``.

    A-Z are lower-cased, words are runs of anything but ASCII white space,
    shingles are ``width`` words joined by a space, repeats included; a text of
    fewer words is one shingle.  A null, empty or blank text has fingerprint 0.
    """
    keep = [id_col, *(carry or [])]
    kept = docs.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(len(keep))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), pa.array(fps.view(np.int64))], [*keep, "fp"])

    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, kept.add("fp", "long"))


def remainders(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit polynomials by the generator."""
    left = words.astype(np.int64)
    for k in range(LENGTH - 1, CHECKS - 1, -1):
        left = np.where(left >> k & 1, left ^ (GENERATOR << (k - CHECKS)), left)
    return left


def patterns(most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each weight 0..most: error patterns by remainder, padded, and how many there are.

    ``word ^ pattern`` for the patterns of the word's remainder are the code
    words at that distance.
    """
    out = []
    for weight in range(most + 1):
        errors = np.array([sum(1 << k for k in bits) for bits in combinations(range(LENGTH), weight)], np.int64)
        by = remainders(errors)
        order = np.argsort(by, kind="stable")
        errors, by = errors[order], by[order]
        count = np.bincount(by, minlength=1 << CHECKS)
        rows = np.zeros((1 << CHECKS, count.max()), np.int64)
        rows[by, np.arange(len(by)) - (np.cumsum(count) - count)[by]] = errors
        out.append((rows, count))
    return out


def flips(threshold: int) -> list[int]:
    """Sets of groups that ``threshold`` bits can turn to their other code word, one bit a group at least."""
    return [m for m in range(1 << GROUPS) if m.bit_count() <= threshold]


def thirds(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits 46-63 by groups of three: the nearest code words, and which groups are none themselves, as bit sets."""
    home, mixed = np.zeros(len(bits), np.int64), np.zeros(len(bits), np.int64)
    for g in range(GROUPS):
        ones = np.bitwise_count(bits >> np.uint64(2 * LENGTH + 3 * g) & np.uint64(7))
        home |= (ones >= 2).astype(np.int64) << g
        mixed |= ((ones == 1) | (ones == 2)).astype(np.int64) << g
    return home, mixed


def anchors_of(fps: np.ndarray, threshold: int, home: bool, tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for every anchor within reach of each fingerprint, or for its home only."""
    reach = 0 if home else threshold
    bits = fps.view(np.uint64)
    low = (bits & np.uint64((1 << LENGTH) - 1)).astype(np.int64)
    high = (bits >> np.uint64(LENGTH) & np.uint64((1 << LENGTH) - 1)).astype(np.int64)
    s_low, s_high = remainders(low), remainders(high)
    rows, anchors, left = [], [], []
    for a in range(RADIUS + reach + 1):
        for b in range(RADIUS + reach + 1):
            spare = reach - max(0, a - RADIUS) - max(0, b - RADIUS)
            if spare < 0:
                continue
            (pa_, na), (pb_, nb) = tables[a], tables[b]
            for i in range(pa_.shape[1]):
                here = np.flatnonzero(na[s_low] > i)
                if not len(here):
                    continue
                first = (low[here] ^ pa_[s_low[here], i]) >> CHECKS
                for j in range(pb_.shape[1]):
                    both = nb[s_high[here]] > j
                    at = here[both]
                    rows.append(at)
                    anchors.append(first[both] << (LENGTH - CHECKS) | (high[at] ^ pb_[s_high[at], j]) >> CHECKS)
                    left.append(np.full(len(at), spare))
    rows, anchors, left = (np.concatenate(x) for x in (rows, anchors, left))
    nearest, mixed = thirds(bits)
    out = []
    for m in flips(reach):  # a group that is no code word is one bit from turning, another one two bits
        cost = np.bitwise_count(mixed & m).astype(np.int64) + 2 * np.bitwise_count(~mixed & m)
        at = np.flatnonzero(cost[rows] <= left)
        out.append((rows[at], anchors[at] << GROUPS | nearest[rows[at]] ^ m))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def anchored(fps: DataFrame, threshold: int, home: bool) -> DataFrame:
    """Rows (anchor, fp): each distinct fingerprint at its home, or at all anchors in reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = patterns(RADIUS + threshold)
        for b in batches:
            values = b.column(0).to_numpy()
            for at in range(0, len(values), 4096):
                part = values[at : at + 4096]
                rows, anchors = anchors_of(part, threshold, home, tables)
                yield pa.RecordBatch.from_arrays([pa.array(anchors.astype(np.int32)), pa.array(part[rows])], ["anchor", "fp"])

    return fps.select("fp").mapInArrow(run, "anchor int, fp long")


def links(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """Every pair (u < v) of distinct fingerprints that differ in at most ``threshold`` bits, once.

    The smaller one is at home, the larger one is a replica; a home is unique,
    so a pair meets there exactly once.
    """
    home = anchored(fps, threshold, True).withColumnRenamed("fp", "u")
    away = anchored(fps, threshold, False).withColumnRenamed("fp", "v")
    near: Column = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= threshold
    # replicas are over a hundred times the rows that a planner expects of them, so neither side may be taken for small
    both = home.hint("merge").join(away, (home.anchor == away.anchor) & (F.col("u") < F.col("v")) & near)
    return both.select("u", "v")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the smallest node it can reach.

    Alternates large-star and small-star steps until the edges stay the same;
    they are then stars around the roots.  Every step is a few keyed
    aggregations and joins over the edges left, cut to the shared folder;
    the driver sees two numbers a round.
    """
    pairs = edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).filter("a <> b").distinct()
    pairs, seen = cut(pairs), None
    while True:
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        ways = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = ways.filter("b > a").join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())


def clusters(docs: DataFrame, threshold: int = 2, width: int = 3, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``carry``, ``fp``, ``root_fp`` and ``component_id``.

    ``component_id`` is the smallest id that links of at most ``threshold``
    differing bits reach, the row's own included; ids that are null are passed
    over, and a component of null ids only has a null one (``root_fp`` still
    tells it apart).  Repeated rows stay, an empty table gives no rows, further
    columns are not read.
    """
    rows = cut(fingerprints(docs, id_col, text_col, width, carry))
    fps = cut(rows.groupBy("fp").agg(F.min(id_col).alias("_first"), F.count("*").alias("_rows")))
    stars = components(links(fps, threshold))
    linked = stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "fp")
    linked = fps.join(linked, "fp")
    ids = linked.groupBy("root").agg(F.min("_first").alias("_least"))
    linked = linked.join(ids, "root").select("fp", "root", "_least")
    classes = fps.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root_fp"), F.when(F.col("root").isNull(), F.col("_first")).otherwise(F.col("_least")).alias("component_id"))
    # rows of a hot fingerprint don't go to one task to meet its class; no more than HOT fingerprints have over 1 / HOT of all rows
    every = rows.count()
    classes = cut(classes.join(fps.select("fp", "_rows"), "fp"))
    hot = F.col("_rows") * HOT > every
    at_home = rows.join(F.broadcast(classes.filter(hot)), "fp")
    others = rows.join(F.broadcast(classes.filter(hot).select("fp")), "fp", "left_anti").join(classes.filter(~hot), "fp")
    return at_home.unionByName(others).select(id_col, *(carry or []), "fp", "root_fp", "component_id")


def keep_one(docs: DataFrame, threshold: int = 2, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, ties broken by the row's hash.

    Further columns may have any name and type; they come back as they are.
    """
    own, names = aside(docs, id_col, text_col)
    hashed = own.withColumn("_row", row_hash(own))
    found = clusters(hashed, threshold, width, id_col, text_col, ["_row"])
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_row").alias("row"))
    chosen = found.groupBy("root_fp").agg(F.min(key).alias("k")).select(F.col("k.id").alias("_id"), F.col("k.row").alias("_r"))
    kept = hashed.join(chosen, (hashed["_row"] == chosen["_r"]) & hashed[id_col].eqNullSafe(chosen["_id"]), "left_semi")
    return kept.dropDuplicates(["_row", id_col]).select(*names).toDF(*docs.columns)


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
