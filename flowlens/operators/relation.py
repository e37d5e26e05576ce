"""Level against forward return: deciles, correlations, trends, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowlens.functions.selection import linear, picked
from flowlens.functions.store import cut
from flowlens.operators.panel import drop_empty, forward_return, since, thin_weekly


def points(panel: DataFrame, x: str, y: str) -> DataFrame:
    """Pooled (name, day) pairs with both values: symbol, t, x, y."""
    return panel.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select("symbol", "t", F.col(x).alias("x"), F.col(y).alias("y"))


def ranked(df: DataFrame, order: list[str], out: str = "rank", parts: int | None = None) -> DataFrame:
    """Adds the 0-based place of each row in the order of unique ``order``, and the number of rows ``n``.

    A pool is never put into one task: rows are dealt out by range once and
    written with their range's number, counted per range, and numbered inside
    their range.  Counts and places read the same table, so they agree whatever
    the sampled bounds are.  ``parts``: ranges, ``spark.sql.shuffle.partitions``
    if not given.  Null keys come first.
    """
    dealt = df.repartitionByRange(*([parts] if parts else []), *order)
    dealt = cut(dealt.withColumn("_p", F.spark_partition_id()))
    counts = dealt.groupBy("_p").agg(F.count("*").alias("_c"))  # a row a range
    before = counts.withColumn("_b", F.sum("_c").over(W.orderBy("_p")) - F.col("_c")).withColumn("n", F.sum("_c").over(W.partitionBy()))
    inside = F.row_number().over(W.partitionBy("_p").orderBy(*order)) - 1
    return dealt.withColumn("_i", inside).join(F.broadcast(before), "_p").withColumn(out, F.col("_b") + F.col("_i")).drop("_p", "_c", "_b", "_i")


def slice_bucket(rank: Column, n: Column, k: int = 10) -> Column:
    """Bucket 1..k of a 0-based rank: slices end at floor(n * b / k), so sizes differ by one at most; not ntile."""
    return (F.floor((k * (rank + 1) - 1) / n) + 1).cast("int")


def deciles(pts: DataFrame, k: int = 10) -> DataFrame:
    """Pooled buckets of x: n, mean x, mean, median and population deviation of y, range of x."""
    b = ranked(pts, ["x", "symbol", "t"]).withColumn("bucket", slice_bucket(F.col("rank"), F.col("n"), k)).drop("rank", "n")
    return bucket_statistics(b, ["bucket"])


def sampled(pts: DataFrame, order: list[str], most: int = 7000) -> DataFrame:
    """Every k-th point in order, k = ceil(n / most), for plots: systematic, so reruns agree."""
    return ranked(pts, order).filter(F.col("rank") % F.ceil(F.col("n") / most) == 0).drop("rank", "n")


def bucket_statistics(b: DataFrame, keys: list[str]) -> DataFrame:
    """n, mean and range of x, mean, median and population deviation of y per bucket; medians are selected, not sorted for."""
    b = cut(b.select(*keys, "x", "y"))
    stats = b.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("x").alias("x_mean"), F.avg("y").alias("y_mean"), F.stddev_pop("y").alias("y_std"), F.min("x").alias("x_lo"), F.max("x").alias("x_hi"))
    return stats.join(picked(b, keys, "y", {"y_median": linear(0.5)}, written=True).drop("n"), keys, "left")


def decile_table(pts: DataFrame, latest: DataFrame, least: int = 30, k: int = 10, h: int = 21) -> DataFrame:
    """Per symbol and bucket: mean of y, overlap-adjusted error, and whether the symbol's latest x is in it.

    ``latest``: (symbol, latest). The current bucket is the first whose range of x holds
    the latest value; a value in none is in the last one if it is beyond it, else in the first.
    """
    own = W.partitionBy("symbol")
    b = pts.withColumn("n", F.count("*").over(own)).filter(F.col("n") >= least)
    b = b.withColumn("bucket", slice_bucket(F.row_number().over(own.orderBy("x", "t")) - 1, F.col("n"), k))
    stats = b.groupBy("symbol", "bucket").agg(F.count("*").alias("n"), F.avg("y").alias("y_mean"), F.stddev_pop("y").alias("std"), F.min("x").alias("x_lo"), F.max("x").alias("x_hi"))
    stats = stats.withColumn("se", overlap_error(F.col("std"), F.col("n"), h)).join(latest, "symbol", "left")
    holds = F.min(F.when(F.col("latest").between(F.col("x_lo"), F.col("x_hi")), F.col("bucket"))).over(own)
    beyond = F.max(F.when(F.col("bucket") == k, F.col("latest") > F.col("x_hi"))).over(own)
    now = F.coalesce(holds, F.when(F.col("latest").isNotNull(), F.when(beyond, k).otherwise(1)))
    return stats.withColumn("now", now).select("symbol", "bucket", "n", "y_mean", "se", F.coalesce(F.col("now") == F.col("bucket"), F.lit(False)).alias("current"))


def overlap_error(std: Column, n: Column, h: int) -> Column:
    """Standard error with n / h independent observations, one at least."""
    return std / F.sqrt(F.greatest(F.lit(1.0), n / h))


def average_rank(x: str, part: str | list[str]) -> Column:
    """Rank with ties sharing their mean place."""
    part = [part] if isinstance(part, str) else part
    return F.rank().over(W.partitionBy(*part).orderBy(x)) + (F.count("*").over(W.partitionBy(*part, x)) - 1) / 2


def correlations(pts: DataFrame, part: str = "symbol", least: int = 5) -> DataFrame:
    """Pearson and Spearman correlation per part; null under ``least`` pairs or without variance."""
    both = pts.withColumn("rx", average_rank("x", part)).withColumn("ry", average_rank("y", part))
    real = lambda a, b: F.when((F.count("*") >= least) & (F.stddev_pop(a) > 1e-12) & (F.stddev_pop(b) > 1e-12), F.corr(a, b))
    return both.groupBy(part).agg(F.count("*").alias("n"), real("x", "y").alias("pearson"), real("rx", "ry").alias("spearman"))


def trend(pts: DataFrame, part: list[str]) -> DataFrame:
    """Least-squares line and the range of x."""
    return pts.groupBy(*part).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.min("x").alias("x_lo"), F.max("x").alias("x_hi"), F.count("*").alias("n"))


def spread_statistics(df: DataFrame, part: list[str], value: str) -> DataFrame:
    """Mean, median, population and sample deviation, median absolute deviation, share above zero, mean over MAD; medians are selected."""
    own = cut(df.filter(F.col(value).isNotNull()).select(*part, F.col(value).alias("_v")))
    out = own.groupBy(*part).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std_pop"), F.stddev_samp("_v").alias("std_samp"), F.avg((F.col("_v") > 0).cast("double")).alias("hit"))
    median = picked(own, part, "_v", {"median": linear(0.5)}, written=True).drop("n")
    far = own.join(median, part).withColumn("_far", F.abs(F.col("_v") - F.col("median")))
    mad = picked(far, part, "_far", {"mad": linear(0.5)}, written=True).drop("n")
    out = out.join(median, part).join(mad, part)
    return out.withColumn("mean_over_mad", F.col("mean") / F.when(F.col("mad") > 0, F.col("mad")))


def histogram(df: DataFrame, value: str, base: float = 0.0, bins: int = 26) -> DataFrame:
    """Counts in equal bins over [p1, p99] widened to hold 0, the mean and ``base``; what lies outside is clamped.

    Percentiles are the values at place floor(p * (n - 1)) of the sorted ones. A range without width is widened by 1.
    """
    own = cut(df.filter(F.col(value).isNotNull()).select(F.col(value).alias("v")))
    ends = picked(own, [], "v", {"p1": lambda n: F.floor((n - 1) * 0.01), "p99": lambda n: F.floor((n - 1) * 0.99)}, written=True)
    ends = ends.withColumn("m", own.agg(F.avg("v")).scalar())
    lo, hi = F.least("p1", "m", F.lit(0.0), F.lit(base)), F.greatest("p99", "m", F.lit(0.0), F.lit(base))
    ends = ends.select(F.struct(lo.alias("lo"), F.when(hi > lo, hi).otherwise(lo + 1).alias("hi")).alias("e")).scalar()
    binned = own.withColumn("e", ends).withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("e.lo")) / ((F.col("e.hi") - F.col("e.lo")) / bins)))).cast("int"))
    return binned.groupBy("bin").agg(F.count("*").alias("n"))


def name_relation(panel: DataFrame, value: str, start: str, pair: tuple[str, str], horizons: tuple[int, ...] = (21, 42, 63), price: str = "adjclose", over: int = 378) -> DataFrame:
    """Each name's value with its forward returns since a day, thinned to weeks if there are more than ``over`` sessions.

    ``pair``: (primary, secondary) share classes, averaged into the primary.
    Names without a value in the window go. Columns: symbol, t, value, r{h}.
    """
    for h in horizons:
        panel = forward_return(panel, h, f"r{h}", price)
    names = [value, *(f"r{h}" for h in horizons)]
    primary, secondary = pair
    merged = panel.withColumn("symbol", F.when(F.col("symbol") == secondary, primary).otherwise(F.col("symbol"))).groupBy("symbol", "t", "d").agg(*(F.avg(c).alias(c) for c in names))
    kept = since(merged, start)
    return drop_empty(thin_weekly(kept, kept, over=over), value).select("symbol", "t", *names)


def cross_section(panel: DataFrame, value: str, forward: str, bench: str | None = None, k: int = 10, min_names: int = 20, min_history: int = 20, relative: bool = True) -> DataFrame:
    """Per session: names ranked into k slices by the signal: (symbol, t, signal, fwd, bucket).

    The relative signal is the value less its own expanding mean, with
    ``min_history`` values. With ``bench``, returns are in excess of that symbol's over the same sessions; it is not ranked,
    and sessions on which it has no return go.
    """
    if bench is not None:
        # the signal needs the symbol's whole history, also sessions on which the benchmark has no return
        base = panel.filter((F.col("symbol") == bench) & F.col(forward).isNotNull()).select("t", F.col(forward).alias("_base"))
        panel = panel.filter(F.col("symbol") != bench).join(base, "t", "left").withColumn(forward, F.col(forward) - F.col("_base")).drop("_base")
    with_signal = expanding(panel, value)
    signal = F.when(F.col("seen") >= min_history, F.col(value) - F.col("expanding_mean")) if relative else F.col(value)
    own = with_signal.withColumn("signal", F.round(signal, 9)).filter(F.col("signal").isNotNull() & F.col(value).isNotNull() & F.col(forward).isNotNull())
    day = W.partitionBy("t")
    own = own.withColumn("n", F.count("*").over(day)).filter(F.col("n") >= min_names)
    rank = F.row_number().over(day.orderBy("signal", "symbol")) - 1
    return own.select("symbol", "t", "signal", F.col(forward).alias("fwd"), slice_bucket(rank, F.col("n"), k).alias("bucket"))


def expanding(panel: DataFrame, value: str, part: str = "symbol") -> DataFrame:
    """``expanding_mean`` and ``seen`` up to and with each row, carried over nulls."""
    w = W.partitionBy(part).orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    return panel.withColumn("expanding_mean", F.avg(value).over(w)).withColumn("seen", F.count(value).over(w))


def cross_section_spread(slices: DataFrame, h: int = 21, k: int = 10) -> DataFrame:
    """Top less bottom slice: mean over sessions, overlap-adjusted error, t, annualised."""
    day = slices.groupBy("t").agg((F.avg(F.when(F.col("bucket") == k, F.col("fwd"))) - F.avg(F.when(F.col("bucket") == 1, F.col("fwd")))).alias("spread")).filter("spread is not null")
    out = day.agg(F.count("*").alias("days"), F.avg("spread").alias("mean"), F.stddev_pop("spread").alias("std"))
    out = out.withColumn("se", overlap_error(F.col("std"), F.col("days"), h))
    return out.select("days", "mean", "se", (F.col("mean") / F.when(F.col("se") > 0, F.col("se"))).alias("t_stat"), (F.col("mean") * 252 / h).alias("annual"))


def monotonicity(buckets: DataFrame, bucket: str, value: str) -> DataFrame:
    """Spearman correlation of bucket number and bucket mean; a handful of rows."""
    b = buckets.select(F.lit(0).alias("_g"), F.col(bucket).cast("double").alias("x"), F.col(value).alias("y"))
    return correlations(b, "_g", 2).select("n", F.col("spearman").alias("monotonicity"))
