"""Merkle manifest of a dataset: a hash tree per source, a tree over the sources, a proof for every row.

Every row is a leaf.  Within a source leaves ascend by id; three neighbours have
one parent, up to the source's root; the sources' roots, in order of the
source, have a tree of their own.  A level is a table with a row a node.  Lag
and lead columns one and two nodes off, masked by the node's slot among its
parent's children and by the number of children, are its siblings; the first
child hashes the parent.  Going down again, each node's proof is its own
siblings and its parent's proof, one equi-join a level of keys that are held by
three rows at most, so no source is a hot key.  A level has a third of the rows
of the one below: all levels together are half as many rows as there are leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowlens.llm.common import aside, cut
from flowlens.operators.relation import ranked

#: Children of a node.
ARITY = 3
#: Nodes of a level are windowed in runs of this many, a power of ``ARITY``: a run fits a task, whatever a source holds.
SPAN = ARITY**4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<left:string,right:string>"


def field(value: Column) -> Column:
    """A value as it goes into a leaf's hash: its length in bytes, a colon and itself; ``-`` if it is null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def placed(leaves: DataFrame, source: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Leaves with ``tree``, the place of their source among all sources, ``idx``, their own place in it, and ``n``, its leaves; and (tree, trees), a row a source.

    No source is gathered: rows are dealt out by ranges of (source, order) and
    written; the ranges of each source are counted, and a row's place in its range
    is moved by the ranges before. Rows alike in all of ``order`` keep the order in
    which they are read. Null sources come first, then the others bytewise.
    """
    dealt = leaves.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(source, *order, "_read")
    dealt = cut(dealt.withColumn("_p", F.spark_partition_id()))
    counts = dealt.groupBy("_p", F.col(source).alias("_source")).agg(F.count("*").alias("_c"))
    before = W.partitionBy("_source").orderBy("_p")  # a row for each range of the source
    counts = counts.withColumn("_b", F.sum("_c").over(before) - F.col("_c")).withColumn("n", F.sum("_c").over(W.partitionBy("_source")))
    counts = cut(counts)
    trees = cut(ranked(counts.filter("_b = 0").select("_source"), ["_source"], "tree").withColumnRenamed("n", "trees"))
    same = F.col("_source").eqNullSafe(F.col("_name"))
    spans = counts.join(trees.select(F.col("_source").alias("_name"), "tree"), same).drop("_name")
    inside = F.row_number().over(W.partitionBy("_p", source).orderBy(*order, "_read")) - 1
    rows = dealt.withColumn("_i", inside).alias("r").join(spans.alias("c"), (F.col("r._p") == F.col("c._p")) & F.col(f"r.{source}").eqNullSafe(F.col("c._source")))
    return rows.select(*(f"r.{c}" for c in leaves.columns), "tree", (F.col("_b") + F.col("_i")).alias("idx"), "n"), trees.select("tree", "trees")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Adds to a level's nodes (tree, idx, n, hash) their siblings' hashes, ``left`` and ``right``, and, in first children, ``parent``."""
    run = W.partitionBy("tree", "_run").orderBy("idx")
    slot, last = F.col("idx") % ARITY, F.col("n") - 1 - F.col("idx")
    seen = nodes.withColumn("_run", F.floor(F.col("idx") / SPAN))
    for k in (1, 2):
        seen = seen.withColumn(f"_before{k}", F.when(slot >= k, F.lag("hash", k).over(run)))
        seen = seen.withColumn(f"_after{k}", F.when((slot + k < ARITY) & (last >= k), F.lead("hash", k).over(run)))
    seen = seen.withColumn("left", F.concat_ws("", "_before2", "_before1")).withColumn("right", F.concat_ws("", "_after1", "_after2"))
    seen = seen.withColumn("parent", F.when(slot == 0, F.sha2(F.concat("hash", "right"), 256)))
    return seen.select("tree", "idx", "n", "hash", "left", "right", "parent")


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """All levels of the trees of ``nodes`` (tree, idx, n, hash), leaves first, and the roots (tree, height, hash).

    A level has the nodes of the trees that are not yet at their root there; the levels are written.
    """
    levels, roots = [], nodes.filter("n = 1").select("tree", F.lit(0).alias("height"), "hash")
    nodes = nodes.filter("n > 1")
    while not nodes.isEmpty():
        levels.append(cut(with_siblings(nodes)))
        up = levels[-1].filter("parent is not null").select("tree", F.floor(F.col("idx") / ARITY).alias("idx"), F.ceil(F.col("n") / ARITY).alias("n"), F.col("parent").alias("hash"))
        roots = roots.unionByName(up.filter("n = 1").select("tree", F.lit(len(levels)).alias("height"), "hash"))
        nodes = up.filter("n > 1")
    return levels, roots


def descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(tree, idx, path, subroot) of each leaf: siblings of the leaf and of its ancestors, from below, then the path of its tree's root.

    ``tops``: (tree, height, path, subroot), a row a tree.
    """
    at = lambda height: tops.filter(F.col("height") == height).select("tree", F.lit(0).cast("long").alias("idx"), "path", "subroot")
    paths = at(len(levels))
    for height in range(len(levels) - 1, -1, -1):
        above = paths.select("tree", F.col("idx").alias("_up"), "path", "subroot")
        own = levels[height].select("tree", "idx", F.struct("left", "right").alias("_step"), F.floor(F.col("idx") / ARITY).alias("_up"))
        own = own.join(above, ["tree", "_up"]).select("tree", "idx", F.concat(F.array("_step"), "path").alias("path"), "subroot")
        paths = own.unionByName(at(height))
    return paths


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, start, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proof(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(leaves: DataFrame, id: str = "doc_id", source: str = "source") -> DataFrame:
    """Leaves (id, source, leaf) with ``subroot``, the root of their source, ``root``, that of all, and ``path``, which leads from the leaf to it.

    Leaves of one source ascend by id, null first; equal ids by leaf, so that
    repeated rows give the same trees in any order. Sources ascend bytewise, null
    first, "" after it. An empty table gives an empty one. Further columns of any
    name are kept, but ``path``, ``subroot`` and ``root``, which are replaced.
    """
    leaves = leaves.drop("path", "subroot", "root")
    own, names = aside(leaves, id, source, "leaf")
    rows, trees = placed(own, source, [id, "leaf"])
    rows = cut(rows)
    levels, roots = climb(rows.select("tree", "idx", "n", F.col("leaf").alias("hash")))
    roots = cut(roots.join(trees, "tree"))
    upper, top = climb(roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("trees").alias("n"), "hash"))
    top = cut(top, parts=1)
    over = descend(upper, top.select("tree", "height", F.array().cast(f"array<{STEP}>").alias("path"), F.col("hash").alias("subroot")))
    tops = cut(roots.join(over.select(F.col("idx").alias("tree"), "path"), "tree").select("tree", "height", "path", F.col("hash").alias("subroot")))
    paths = descend(levels, tops)
    out = rows.join(paths, ["tree", "idx"]).withColumn("root", top.select("hash").scalar())
    return out.select(*names, "path", "subroot", "root").toDF(*leaves.columns, "path", "subroot", "root")


def audit(docs: DataFrame) -> DataFrame:
    """Every document's leaf, roots and proof, and what its proof gives for a text whose line ends are lost where crc32 of the id is even.

    A null value is ``-`` in its leaf. A null text stays null; a text without line
    ends stays what it is, so it is verified all the same. A null id is not
    tampered with. Repeated rows are leaves of their own. Very long texts are
    hashed where they are read; only digests move. Columns but the five of a leaf are not read.
    """
    values = [F.col(f"`{c}`") for c in FIELDS]
    spoilt = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    other = leaf([*values[:-1], F.replace(F.col("text"), F.lit("\n"), F.lit(""))])
    leaves = docs.select("doc_id", "source", leaf(values).alias("leaf"), F.when(spoilt, other).alias("tampered"))
    out = manifest(leaves).withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return out.select("doc_id", "source", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "path")
