"""Index and sector gauges: dollar-weighted short share, contributors, residuals, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowlens.functions.core import clip01, ratio, sessions
from flowlens.functions.rolling import trailing
from flowlens.operators.panel import forward_return


def dollar_dix(panel: DataFrame, cal: DataFrame, keys: list[str] | None = None, exclude: str | None = None, min_names: int = 20, min_coverage: float = 0.6, price: str = "close") -> DataFrame:
    """sum(price * short) / sum(price * total) per session, clipped to [0, 1].

    Null where fewer than ``min_names`` names have all three, or fewer than
    ``min_coverage`` of the median over the last 63 sessions (once 10 are there).
    ``keys``: further grouping, such as a fund; sessions without any name count 0.
    """
    keys = keys or []
    own = panel.filter(F.col("short").isNotNull() & F.col("total").isNotNull() & F.col(price).isNotNull())
    if exclude is not None:
        own = own.filter(F.col("symbol") != exclude)
    sums = own.groupBy(*keys, "t").agg(F.sum(F.col(price) * F.col("short")).alias("s"), F.sum(F.col(price) * F.col("total")).alias("d_"), F.count("*").alias("n"))
    if keys:
        last = cal.agg(F.max("t")).scalar()
        days = own.select(*keys).distinct().withColumn("_last", last).select(*keys, F.explode(F.sequence(F.lit(0), "_last")).alias("t")).join(cal, "t")
    else:
        days = cal
    daily = days.join(sums, [*keys, "t"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    daily = trailing(daily.withColumn("_n", F.col("n").cast("double")), keys, "_n", 63, {"_u": 0.5}, seen="_seen", by_sessions=True)  # without keys: one row a session
    usual = F.when(F.col("_seen") >= 10, F.col("_u")).otherwise(0.0)
    good = (F.col("n") >= min_names) & (F.col("n") >= min_coverage * F.col("usual"))
    return daily.withColumn("usual", usual).select(*keys, "t", "d", "n", F.when(good, clip01(ratio("s", "d_"))).alias("dix"))


def aggregate_share(panel: DataFrame, exclude: str | None = None, min_names: int = 20) -> DataFrame:
    """Off-exchange total over consolidated volume per session, of names that have both."""
    own = panel.filter(F.col("total").isNotNull() & F.col("volume").isNotNull())
    if exclude is not None:
        own = own.filter(F.col("symbol") != exclude)
    sums = own.groupBy("t").agg(F.sum("total").alias("a"), F.sum("volume").alias("b"), F.count("*").alias("n"))
    return sums.select("t", "n", F.when(F.col("n") >= min_names, ratio("a", "b")).alias("share"))


def equal_mean(panel: DataFrame, min_names: int = 20) -> DataFrame:
    """Plain mean of the names' DPI per session."""
    sums = panel.groupBy("t").agg(F.avg("dpi").alias("m"), F.count("dpi").alias("n"))
    return sums.select("t", "n", F.when(F.col("n") >= min_names, F.col("m")).alias("mean_dpi"))


def contributors(panel: DataFrame, weights: DataFrame, window: int = 25, top: int = 40, min_names: int = 20, exclude: str | None = None) -> DataFrame:
    """Who makes the index level: trailing means of dollar short and dollar total per name; contributions add up to the level.

    As of the last session on which any name is valid. ``weights``: (symbol, weight).
    """
    own = panel.filter(F.col("short").isNotNull() & F.col("total").isNotNull() & F.col("close").isNotNull())
    if exclude is not None:
        own = own.filter(F.col("symbol") != exclude)
    own = own.withColumn("_last", own.agg(F.max("t")).scalar()).filter(F.col("t") > F.col("_last") - window)
    means = own.groupBy("symbol").agg(F.avg(F.col("close") * F.col("short")).alias("s"), F.avg(F.col("close") * F.col("total")).alias("d"), F.max("_last").alias("as_of"))
    whole = W.partitionBy()
    means = means.withColumn("names", F.count("*").over(whole)).withColumn("all_d", F.sum("d").over(whole))  # a row for each name
    means = means.filter((F.col("names") >= min_names) & (F.col("all_d") > 0))
    out = means.join(weights, "symbol", "left").select(
        "symbol", "as_of", (F.col("s") / F.col("all_d")).alias("contribution"), (F.col("d") / F.col("all_d")).alias("dollar_weight"), clip01(ratio("s", "d")).alias("dpi"), F.col("weight").alias("index_weight")
    )
    return out.withColumn("rank", F.row_number().over(W.orderBy(F.desc("contribution"), "symbol"))).filter(F.col("rank") <= top)


def members_of(panel: DataFrame, membership: DataFrame) -> DataFrame:
    """Panel rows once for each fund that holds the symbol."""
    return panel.join(membership, "symbol")


def sector_levels(panel: DataFrame, membership: DataFrame, cal: DataFrame, min_names: int = 8, smooth: int = 5) -> DataFrame:
    """(fund, t, d, n, dix, level): the fund's dollar-weighted share and its moving average."""
    dix = dollar_dix(members_of(panel, membership.select("fund", "symbol")), cal, ["fund"], min_names=min_names)
    return dix.withColumn("level", F.avg("dix").over(sessions("fund", -(smooth - 1), 0)))


def sector_bands(levels: DataFrame, width: int = 252, least: int = 63, high: float = 0.8, low: float = 0.2) -> DataFrame:
    """Rolling quantile bands over the last ``width`` valid rows, and crossings.

    A level on the band's edge is in the band. A crossing into a band needs the band to be defined on the row before.
    """
    valid = levels.filter(F.col("level").isNotNull())
    out = trailing(valid, ["fund"], "level", width, {"_hi": high, "_lo": low}, seen="_n")
    band = lambda c: F.when(F.col("_n") >= least, F.round(c, 9))
    out = out.withColumn("upper", band("_hi")).withColumn("lower", band("_lo")).withColumn("level", F.round("level", 9)).drop("_hi", "_lo", "_n")
    before = W.partitionBy("fund").orderBy("t")
    inside = {"up": (F.col("level") >= F.col("upper")), "down": (F.col("level") <= F.col("lower"))}
    for way, now in inside.items():
        out = out.withColumn(f"_{way}", now).withColumn(f"cross_{way}", F.coalesce(F.col(f"_{way}") & ~F.lag(f"_{way}").over(before), F.lit(False)))
    return out.drop("_up", "_down")


def last_crossing(bands: DataFrame) -> DataFrame:
    """Per fund: session and direction of the last crossing."""
    crossed = bands.filter("cross_up or cross_down").withColumn("direction", F.when(F.col("cross_up"), "up").otherwise("down"))
    return crossed.groupBy("fund").agg(F.max("t").alias("t"), F.max_by("direction", "t").alias("direction"), F.count("*").alias("crossings"))


def crossings(bands: DataFrame, kept: DataFrame) -> DataFrame:
    """(fund, t, direction) of the crossings on the kept sessions (t), which a plot shows; bands are those of the whole history."""
    crossed = bands.filter("cross_up or cross_down").withColumn("direction", F.when(F.col("cross_up"), "up").otherwise("down"))
    return crossed.join(kept.select("t").distinct(), "t", "left_semi").select("fund", "t", "direction")


def sector_summary(levels: DataFrame, width: int = 252, change: int = 20) -> DataFrame:
    """Per fund: latest level, percentile (share of the last ``width`` valid rows strictly below, in whole percent), change over ``change`` valid rows, null with no row beyond them."""
    valid = levels.filter(F.col("level").isNotNull()).withColumn("level", F.round("level", 9))
    back = W.partitionBy("fund").orderBy(F.desc("t"))
    ranked = valid.withColumn("back", F.row_number().over(back)).withColumn("now", F.first("level").over(back.rowsBetween(W.unboundedPreceding, 0)))
    out = ranked.groupBy("fund").agg(
        F.max("t").alias("t"),
        F.max("now").alias("level"),
        F.round(100 * F.avg(F.when(F.col("back") <= width, (F.col("level") < F.col("now")).cast("double")))).alias("percentile"),
        F.when(F.count("*") > change + 1, F.max(F.when(F.col("back") == change + 1, F.col("now") - F.col("level")))).alias("change"),
    )
    return out


def constituents(panel: DataFrame, levels: DataFrame, membership: DataFrame, value: str = "dd", window: int = 25, change: int = 20, top: int = 30) -> DataFrame:
    """Who receives a fund's flow: each name's share of the members' mean dollar short over the last ``window`` sessions, in percent.

    With the name's latest value, its change over ``change`` valid rows (0 with
    fewer) and the direction of that. ``levels``: (symbol, t, value) on every
    session; names without either go. The first ``top`` of each fund by share.
    """
    last = levels.agg(F.max("t")).scalar()
    means = panel.withColumn("_last", last).filter(F.col("t") > F.col("_last") - window).groupBy("symbol").agg(F.avg(F.col("close") * F.col("short")).alias("_s")).filter("_s is not null")
    back = W.partitionBy("symbol").orderBy(F.desc("t"))
    valid = levels.filter(F.col(value).isNotNull()).withColumn("_b", F.row_number().over(back))
    at = lambda k: F.max(F.when(F.col("_b") == k, F.col(value)))
    own = valid.groupBy("symbol").agg(at(1).alias("latest"), F.when(F.count("*") > change + 1, at(1) - at(change + 1)).otherwise(0.0).alias("change"))
    fund = W.partitionBy("fund")
    out = membership.join(means, "symbol").withColumn("_all", F.sum("_s").over(fund)).filter(F.col("_all") != 0).join(own, "symbol")
    out = out.withColumn("share", F.col("_s") / F.col("_all") * 100).withColumn("rank", F.row_number().over(fund.orderBy(F.desc("share"), "symbol")))
    return out.filter(F.col("rank") <= top).select("fund", "symbol", "share", "latest", "change", flags(F.lit(0.0), F.col("change"))[1].alias("flow"), "rank")


def joint_names(panel: DataFrame, membership: DataFrame) -> DataFrame:
    """Per fund: members, and members with any session on which short, total and price are all there."""
    joint = F.col("short").isNotNull() & F.col("total").isNotNull() & F.col("close").isNotNull()
    have = panel.filter(joint).select("symbol").distinct().withColumn("_have", F.lit(1))
    return membership.join(have, "symbol", "left").groupBy("fund").agg(F.countDistinct("symbol").alias("names"), F.count("_have").alias("with_data"))


def flags(x: Column, change: Column, hot: float = 0.12, drift: float = 0.003) -> tuple[Column, Column]:
    """(hot, drift): the latest divergence is large; the 20-session change is accumulating or distributing."""
    return F.abs(x) >= hot, F.when(change > drift, "accumulating").when(change < -drift, "distributing").otherwise("flat")


def residuals(grid: DataFrame, bench: DataFrame, x: str = "dd", window: int = 126, least: int = 40, smooth: int = 0) -> DataFrame:
    """``diff`` = x - b and ``reg`` = x - (alpha + beta b), beta rolling over ``window`` sessions.

    ``bench``: (t, b). The covariance is over complete pairs, variance and means over
    their own values; each needs ``least`` of them. Sums over a window are running
    sums at its end less those before its begin, so a row costs the same whatever the window is. x and b
    are first centred on their means over the symbol, so that what two running sums
    have in common stays small against what differs (tests hold 20,000 sessions against numpy).
    """
    both = grid.join(bench, "t", "left")
    whole = W.partitionBy("symbol")
    both = both.withColumn("_cx", F.avg(x).over(whole)).withColumn("_cb", F.avg("b").over(whole))
    u, v = F.col(x) - F.col("_cx"), F.col("b") - F.col("_cb")
    pair = u.isNotNull() & v.isNotNull()
    up_to = W.partitionBy("symbol").orderBy("t").rangeBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("symbol").orderBy("t").rangeBetween(W.unboundedPreceding, -window)
    terms = {"n": F.when(pair, 1), "u": F.when(pair, u), "v": F.when(pair, v), "uv": F.when(pair, u * v), "nb": F.when(v.isNotNull(), 1), "b": v, "bb": v * v, "nx": F.when(u.isNotNull(), 1), "x": u}
    both = both.select("*", *(F.coalesce(F.sum(e).over(up_to), F.lit(0)).alias(f"_a{k}") for k, e in terms.items()), *(F.coalesce(F.sum(e).over(before), F.lit(0)).alias(f"_z{k}") for k, e in terms.items()))
    s = {k: F.col(f"_a{k}") - F.col(f"_z{k}") for k in terms}
    cov = F.when(s["n"] >= least, (s["uv"] - s["u"] * s["v"] / s["n"]) / F.when(s["n"] > 1, s["n"] - 1))
    var = F.when(s["nb"] >= least, (s["bb"] - s["b"] * s["b"] / s["nb"]) / F.when(s["nb"] > 1, s["nb"] - 1))
    mb, mx = F.when(s["nb"] >= least, s["b"] / s["nb"]), F.when(s["nx"] >= least, s["x"] / s["nx"])
    out = both.select(*grid.columns, "b", "_cx", "_cb", cov.alias("_cov"), var.alias("_var"), mb.alias("_mb"), mx.alias("_mx"))
    flat = F.col("_var") > 1e-13 * (1 + F.col("_cb") * F.col("_cb"))  # below, a variance is what running sums leave of none
    out = out.withColumn("beta", F.col("_cov") / F.when(flat, F.col("_var"))).withColumn("diff", F.col(x) - F.col("b"))
    out = out.withColumn("reg", F.col(x) - F.col("_cx") - F.col("_mx") - F.col("beta") * (F.col("b") - F.col("_cb") - F.col("_mb")))
    if smooth > 1:
        frame = sessions("symbol", -(smooth - 1), 0)
        out = out.withColumn("diff", F.avg("diff").over(frame)).withColumn("reg", F.avg("reg").over(frame))
    return out.drop("_cx", "_cb", "_cov", "_var", "_mb", "_mx")


def divergence_order(latest: DataFrame, value: str = "latest") -> DataFrame:
    """Place of each symbol: values from 0 up descending, then negative ones ascending, nulls last; ties by symbol."""
    v = F.col(value)
    group = F.when(v >= 0, 0).when(v < 0, 1).otherwise(2)
    return latest.withColumn("place", F.row_number().over(W.orderBy(group, F.when(v >= 0, -v).otherwise(v), "symbol")))


def raw_order(latest: DataFrame, value: str = "latest") -> DataFrame:
    """Place of each symbol by value, descending; nulls count -1, ties go by symbol."""
    return latest.withColumn("raw_place", F.row_number().over(W.orderBy(F.coalesce(F.col(value), F.lit(-1.0)).desc(), "symbol")))  # a row for each name


def weight_order(symbols: DataFrame, weights: DataFrame, bench: str) -> DataFrame:
    """Place of each symbol: the benchmark, then by weight descending, then those without one; ties by symbol."""
    both = symbols.join(weights, "symbol", "left")
    group = F.when(F.col("symbol") == bench, 0).when(F.col("weight").isNotNull(), 1).otherwise(2)
    return both.withColumn("weight_place", F.row_number().over(W.orderBy(group, F.desc_nulls_last("weight"), "symbol")))


def ranked_funds(summary: DataFrame) -> DataFrame:
    """Funds by percentile, descending; nulls last, ties by name."""
    return summary.withColumn("place", F.row_number().over(W.orderBy(F.desc_nulls_last("percentile"), "fund")))


def grid_table(residuals: DataFrame, bench: DataFrame, weights: DataFrame, sectors: DataFrame, bench_name: str) -> DataFrame:
    """Latest raw level, difference and residual of each symbol and of the benchmark as a symbol of its own, with orders, weights and sectors.

    ``residuals``: (symbol, t, raw, diff, reg); ``bench``: (t, b). The benchmark
    is no deviation from itself, so its difference and residual are 0.
    """
    at = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("t"))).alias(c)
    own = residuals.groupBy("symbol").agg(at("raw"), at("diff"), at("reg"))
    line = bench.agg(F.max_by("b", F.when(F.col("b").isNotNull(), F.col("t"))).alias("raw")).select(F.lit(bench_name).alias("symbol"), "raw", F.lit(0.0).alias("diff"), F.lit(0.0).alias("reg"))
    both = own.unionByName(line)
    out = weight_order(raw_order(both, "raw"), weights, bench_name).join(sectors, "symbol", "left")
    out = divergence_order(out.withColumn("_v", F.round("diff", 6)), "_v").withColumnRenamed("place", "diff_place")
    return divergence_order(out.withColumn("_v", F.round("reg", 6)), "_v").drop("_v")


def index_table(series: DataFrame, value: str, price: str, horizons: tuple[int, ...] = (21, 42, 63)) -> DataFrame:
    """Index level against forward returns; horizons count valid rows of the level, so they are numbered anew first."""
    valid = series.filter(F.col(value).isNotNull()).withColumn("_u", F.lit(0))
    valid = valid.withColumn("session", F.col("t")).withColumn("t", (F.row_number().over(W.partitionBy("_u").orderBy("t")) - 1).cast("int"))
    for h in horizons:
        valid = forward_return(valid, h, f"r{h}", price, "_u")
    return valid.select(F.col("session").alias("t"), value, *(f"r{h}" for h in horizons))


def breadth(prices: DataFrame, bench: str, pair: tuple[str, str], price: str = "close", least: int = 5) -> DataFrame:
    """Two symbols relative to a benchmark, rebased to 100 on the first common session, and their mean."""
    names = [bench, *pair]
    wide = prices.filter(F.col("symbol").isin(names)).groupBy("t").pivot("symbol", names).agg(F.first(price)).na.drop()
    first = W.orderBy("t").rowsBetween(W.unboundedPreceding, 0)  # one row a session
    wide = wide.withColumn("_n", F.count("*").over(W.partitionBy()))
    for k, name in enumerate(names):
        wide = wide.withColumn(f"_{k}", F.col(f"`{name}`") / F.first(f"`{name}`").over(first))
    a, b = F.col("_1") / F.col("_0") * 100, F.col("_2") / F.col("_0") * 100
    return wide.filter(F.col("_n") >= least).select("t", a.alias("a_rel"), b.alias("b_rel"), ((a + b) / 2).alias("gauge"))


def compare_series(a: DataFrame, b: DataFrame, least: int = 30) -> DataFrame:
    """Two series (t, v): correlations of levels and of differences, mean offset and mean absolute difference, in percent."""
    both = a.select("t", F.col("v").alias("x")).join(b.select("t", F.col("v").alias("y")), "t").filter("x is not null and y is not null")
    order = W.orderBy("t")  # one row a session
    both = both.withColumn("dx", F.col("x") - F.lag("x").over(order)).withColumn("dy", F.col("y") - F.lag("y").over(order))
    out = both.agg(F.count("*").alias("n"), F.corr("x", "y").alias("level_corr"), F.corr("dx", "dy").alias("change_corr"), (F.avg(F.col("x") - F.col("y")) * 100).alias("offset"), (F.avg(F.abs(F.col("x") - F.col("y"))) * 100).alias("abs_diff"))
    return out.filter(F.col("n") >= least)
