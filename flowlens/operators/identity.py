"""Who a row belongs to: renamed and recycled symbols, share classes, splits, upserts, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowlens.functions.rolling import trailing
from flowlens.functions.store import cut


def resolve_aliases(panel: DataFrame, spans: DataFrame) -> DataFrame:
    """Interval join with override: within [start, end) a symbol's rows are its old symbol's.

    ``spans``: (symbol, old_symbol, start, end, priority). The first span with a row that
    day wins; a symbol's own rows are never used inside its spans.
    """
    sp = spans.select(F.col("symbol").alias("_new"), F.col("old_symbol").alias("_old"), "start", "end", "priority")
    inside = (F.col("d") >= F.col("start")) & (F.col("d") < F.col("end"))
    native = panel.join(sp, (F.col("symbol") == F.col("_new")) & inside, "left_anti")
    taken = panel.join(sp, (F.col("symbol") == F.col("_old")) & inside)
    first = W.partitionBy("_new", "d").orderBy("priority")
    taken = taken.withColumn("_r", F.row_number().over(first)).filter("_r = 1").withColumn("symbol", F.col("_new"))
    return native.unionByName(taken.select(*panel.columns))


def valid_from(panel: DataFrame, dates: DataFrame, values: list[str]) -> DataFrame:
    """Values before a recycled symbol's first valid day become null. ``dates``: (symbol, first_d)."""
    both = panel.join(dates, "symbol", "left")
    keep = F.col("first_d").isNull() | (F.col("d") >= F.col("first_d"))
    for v in values:
        both = both.withColumn(v, F.when(keep, F.col(v)))
    return both.drop("first_d")


def merge_classes(panel: DataFrame, classes: DataFrame, sums: list[str], means: list[str], own: list[str]) -> DataFrame:
    """Secondary share classes go into their primary: summed, averaged, or the primary's own columns.

    ``classes``: (primary, secondary). Null plus null stays null.
    """
    both = panel.join(classes, F.col("symbol") == F.col("secondary"), "left").withColumn("_to", F.coalesce("primary", "symbol"))
    aggs = [F.sum(c).alias(c) for c in sums] + [F.avg(c).alias(c) for c in means] + [F.max(F.when(F.col("symbol") == F.col("_to"), F.col(c))).alias(c) for c in own]
    return both.groupBy(F.col("_to").alias("symbol"), "t").agg(*aggs)


#: Ratios at which stocks are split.
SPLIT_RATIOS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20)


def detect_splits(series: DataFrame, width: int = 12, gap: int = 6, reach: int = 31, threshold: float = 2.2, tolerance: float = 0.22) -> DataFrame:
    """Upward steps of a ratio that stay and are those of a split: (symbol, t, factor).

    ``series``: (symbol, t, ratio), read as its valid rows; ratios below 1e-9 count as
    that, and symbols with fewer than 3 ``width`` rows are not judged. Where the median of the next ``width``
    log ratios exceeds that of the previous ``width`` by more than ln(threshold), a run of such rows has
    one peak. Its size is the quotient of the medians of rows ``gap`` to ``reach`` - 1 after it and
    ``gap`` + 1 to ``reach`` before it; it is a split if the nearest of ``SPLIT_RATIOS`` is less than ``tolerance`` off,
    which lets falls and shifts of other sizes be. The split takes effect at the first of two
    rows in a row, within ``width`` of the peak, that reach the geometric mean of the two medians, else at
    the peak. Two peaks dated alike are one split, of the later one's factor.
    """
    ln = F.log("c")
    own = series.filter(F.col("ratio").isNotNull() & ~F.isnan("ratio")).select("symbol", "t", F.greatest(F.col("ratio"), F.lit(1e-9)).alias("c"))
    own = trailing(own.withColumn("lr", ln), ["symbol"], "lr", width, {"_m": 0.5})
    by_t = W.partitionBy("symbol").orderBy("t")
    own = own.withColumn("i", F.row_number().over(by_t) - 1).withColumn("n", F.count("*").over(W.partitionBy("symbol")))
    own = own.withColumn("jump", F.round(F.lead("_m", width - 1).over(by_t) - F.lag("_m", 1).over(by_t), 9)).withColumn("next", F.lead("c").over(by_t))
    own = cut(own.select("symbol", "t", "i", "n", "c", "next", "jump"))  # read for the peaks and for their surroundings
    over = own.filter((F.col("n") >= 3 * width) & (F.col("i") >= width) & (F.col("i") < F.col("n") - width) & (F.col("jump") > F.log(F.lit(threshold))))
    over = over.withColumn("run", F.col("i") - F.row_number().over(W.partitionBy("symbol").orderBy("i")))
    peaks = over.groupBy("symbol", "run").agg(F.max_by("i", F.struct("jump", -F.col("i"))).alias("peak"))
    near = peaks.select("symbol", "peak", F.explode(F.sequence(F.col("peak") - reach, F.col("peak") + reach - 1)).alias("i")).join(own.select("symbol", "i", "t", "c", "next"), ["symbol", "i"])
    off = F.col("i") - F.col("peak")
    steps = near.groupBy("symbol", "peak").agg(
        F.median(F.when(off < -gap, F.col("c"))).alias("old"), F.median(F.when(off >= gap, F.col("c"))).alias("new"),
        F.collect_list(F.when(off.between(-width, width - 1) & F.col("next").isNotNull(), F.struct("t", F.least("c", "next").alias("both")))).alias("rows"), F.max(F.when(off == 0, F.col("t"))).alias("at"),
    )
    size = F.col("new") / F.col("old")
    ratios = F.array(*map(F.lit, SPLIT_RATIOS))
    nearest = F.array_min(F.transform(ratios, lambda r: F.struct(F.abs(r - F.col("size")).alias("far"), r.alias("ratio"))))["ratio"]
    steps = steps.withColumn("size", size).withColumn("factor", nearest.cast("double")).filter(F.abs(F.col("factor") - F.col("size")) / F.col("factor") < tolerance)
    middle = F.sqrt(F.greatest("old", F.lit(1e-12)) * F.greatest("new", F.lit(1e-12)))
    reached = F.array_min(F.transform(F.filter("rows", lambda r: r["both"] >= F.col("mid")), lambda r: r["t"]))
    dated = steps.withColumn("mid", middle).withColumn("t", F.coalesce(reached, "at"))
    return dated.groupBy("symbol", "t").agg(F.max_by("factor", "peak").alias("factor"))


def apply_splits(panel: DataFrame, splits: DataFrame, values: list[str]) -> DataFrame:
    """Multiply values before each split by its factor; several ones multiply. ``split_factor`` is added."""
    sp = splits.groupBy("symbol").agg(F.collect_list(F.struct("t", "factor")).alias("_s"))
    both = panel.join(sp, "symbol", "left")
    later = F.filter(F.coalesce("_s", F.array().cast("array<struct<t:int,factor:double>>")), lambda s: s["t"] > F.col("t"))
    both = both.withColumn("split_factor", F.aggregate(later, F.lit(1.0), lambda a, s: a * s["factor"]))
    for v in values:
        both = both.withColumn(v, F.col(v) * F.col("split_factor"))
    return both.drop("_s")


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """New values over old, cell by cell; old ones fill holes, new keys are added."""
    a = stored.select(*keys, *(F.col(v).alias(f"_{v}") for v in values))
    return a.join(fresh.select(*keys, *values), keys, "full_outer").select(*keys, *(F.coalesce(v, f"_{v}").alias(v) for v in values))


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last in order."""
    w = W.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def first_seen(df: DataFrame, value: str, place: str) -> DataFrame:
    """Distinct values with the place where each came first."""
    return df.groupBy(value).agg(F.min(place).alias(place))


def missing_days(wanted: DataFrame, covered: DataFrame, key: str = "d") -> DataFrame:
    return wanted.select(key).distinct().join(covered.select(key), key, "left_anti")


def completeness(panel: DataFrame, value: str, share: float = 0.05, least: int = 3) -> DataFrame:
    """How many symbols end before the freshest session, and whether that is within max(least, share)."""
    ends = panel.groupBy("symbol").agg(F.max(F.when(F.col(value).isNotNull(), F.col("t"))).alias("last"))
    ends = ends.withColumn("_end", panel.filter(F.col(value).isNotNull()).agg(F.max("t")).scalar())
    out = ends.agg(F.count("*").alias("symbols"), F.count_if(F.coalesce(F.col("last") < F.col("_end"), F.lit(True))).alias("behind"))
    return out.withColumn("complete", F.col("behind") <= F.greatest(F.lit(float(least)), share * F.col("symbols")))
