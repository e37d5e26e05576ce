"""Exact quantiles of groups of any size without sorting them: histograms that are refined until the wanted ranks are known.

A pass counts the values of the wanted ranks' intervals in equal bins, with the
smallest and largest value of each, and goes on with the bins that hold the ranks.
An interval shrinks by the number of bins a pass, so two or three passes over a
narrow table pick any rank of millions of values; each is a partial aggregation
before its shuffle, so what moves is bins, not rows, and no group meets in a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowlens.functions.store import cut

BINS = 4096
#: Values of one group in one interval that are sorted as an array instead of binned once more.
FEW = 1 << 14


def linear(q: float) -> Callable[[Column], Column]:
    """The place of a quantile among n values, between neighbours by a straight line."""
    return lambda n: F.lit(q) * (n - 1)


def picked(df: DataFrame, keys: list[str], value: str, at: dict[str, Callable[[Column], Column]], written: bool = False) -> DataFrame:
    """(keys, n, a column for each of ``at``): the values at the 0-based places that ``at`` gives for n values; places between two ranks lie on the line between them.

    Null and NaN values count nowhere, infinite ones are refused by the arithmetic
    of bins only if a wanted rank is among them. Groups without values have no row; without keys
    there is one row if there is any value. Null keys are a group. ``written``: ``df`` is cheap to read again.
    """
    own = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)), F.col(value).cast("double").alias("_v"))
    if not written:
        own = cut(own)
    ks = [f"_k{i}" for i in range(len(keys))]
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in ks] or [F.lit(True)]
    ends = own.groupBy(*ks).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).filter("n > 0")
    places = F.array(*(F.struct(F.lit(name).alias("name"), f(F.col("n")).cast("double").alias("place")) for name, f in at.items()))
    wanted = cut(ends.withColumn("_a", F.explode(places)).select(*ks, "n", "lo", "hi", F.col("_a.name").alias("name"), F.col("_a.place").alias("place")))
    sides = F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place"))))
    known = wanted.select(*ks, "lo", "hi", F.lit(0).cast("long").alias("below"), "n", sides.alias("rank")).distinct()
    done: list[DataFrame] = []
    while True:
        done.append(known.filter("lo = hi").select(*ks, "rank", F.col("lo").alias("value")))
        known = known.filter("lo < hi")
        if known.isEmpty():
            break
        spans = known.select(*ks, "lo", "hi", "n").distinct().groupBy(*ks).agg(F.collect_list(F.struct("lo", "hi", "n")).alias("spans"))  # as many as wanted ranks at most
        inside = own.alias("o").join(spans.alias("s"), same("o", "s")).select(*(f"o.{k}" for k in ks), "_v", F.explode(F.filter("spans", lambda s: F.col("_v").between(s["lo"], s["hi"]))).alias("s"))
        few = F.col("s.n") <= FEW
        bin = F.when(~few, F.least(F.lit(BINS - 1), F.floor((F.col("_v") / 2 - F.col("s.lo") / 2) / (F.col("s.hi") / 2 - F.col("s.lo") / 2) * BINS))).otherwise(0)
        bins = inside.groupBy(*ks, F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"), bin.alias("bin")).agg(F.count("*").alias("c"), F.min("_v").alias("a"), F.max("_v").alias("b"), F.array_sort(F.collect_list(F.when(few, F.col("_v")))).alias("all"))
        order = W.partitionBy(*ks, "lo", "hi").orderBy("bin")  # BINS rows at most
        bins = bins.withColumn("before", F.sum("c").over(order) - F.col("c"))
        place = F.col("k.rank") - F.col("k.below") - F.col("b.before")
        hit = known.alias("k").join(bins.alias("b"), [*same("k", "b"), F.col("k.lo") == F.col("b.lo"), F.col("k.hi") == F.col("b.hi"), (place >= 0) & (place < F.col("b.c"))])
        exact = F.get("b.all", place.cast("int"))  # null where the bin was not taken as an array
        known = cut(hit.select(*(f"k.{k}" for k in ks), F.coalesce(exact, "b.a").alias("lo"), F.coalesce(exact, "b.b").alias("hi"), (F.col("k.below") + F.col("b.before")).alias("below"), F.col("b.c").alias("n"), "k.rank"))
    values = done[0]
    for more in done[1:]:
        values = values.unionByName(more)
    both = wanted.alias("w").join(values.alias("v"), [*same("w", "v"), F.col("v.rank").between(F.floor("w.place"), F.ceil("w.place"))])
    low, high, part = F.min("v.value"), F.max("v.value"), F.max(F.col("w.place") - F.floor("w.place"))
    each = both.groupBy(*(F.col(f"w.{k}") for k in ks), F.col("w.n").alias("n"), F.col("w.name").alias("name")).agg((low + (high - low) * part).alias("value"))
    wide = each.groupBy(*ks, "n").agg(*(F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in at))
    return wide.select(*(F.col(k).alias(c) for k, c in zip(ks, keys)), "n", *at)
