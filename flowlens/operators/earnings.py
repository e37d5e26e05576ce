"""Earnings: timing of filings, nearest matches, and the event study around report days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowlens.functions.core import sessions
from flowlens.functions.selection import linear, picked
from flowlens.functions.stats import p_of_correlation, p_value, welch, welch_columns
from flowlens.functions.store import cut
from flowlens.operators.panel import daily_change, forward_return, realised_vol
from flowlens.operators.relation import average_rank
from flowlens.operators.streaks import paths

#: Regular trading hours, US/Eastern.
OPEN, CLOSE = "09:30", "16:00"
HORIZONS = (("next_day", 1), ("w1", 5), ("w2", 10), ("m1", 21))


def classify_timing(utc: Column, zone: str = "America/New_York") -> tuple[Column, Column]:
    """(local date, timing) of a UTC time: bmo before the open, amc from the close on, else intraday."""
    local = F.from_utc_timestamp(utc, zone)
    clock = F.date_format(local, "HH:mm")
    return F.to_date(local), F.when(clock < OPEN, "bmo").when(clock >= CLOSE, "amc").otherwise("intraday")


def nearest_match(periodic: DataFrame, candidates: DataFrame, window: int, key: str = "k", at: str = "at", number: str = "id") -> DataFrame:
    """For each periodic report the nearest candidate of its key within ``window``; ties go to the earlier one.

    ``at`` is a whole number of days (or hours). The band join runs on equal
    (key, bucket) with buckets of the window's width, each report looking into
    three of them, so keys with many rows don't meet all of each other.
    Columns: key, report, cand, gap.
    """
    p = periodic.select(F.col(key).alias("_k"), F.col(number).alias("report"), F.col(at).alias("_at"))
    p = p.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_at") / window) - 1, F.floor(F.col("_at") / window) + 1)))
    c = candidates.select(F.col(key).alias("_ck"), F.col(number).alias("cand"), F.col(at).alias("_cat"), F.floor(F.col(at) / window).alias("_cb"))
    near = p.join(c, (F.col("_k") == F.col("_ck")) & (F.col("_b") == F.col("_cb")) & (F.abs(F.col("_at") - F.col("_cat")) <= window))
    best = near.groupBy("_k", "report").agg(F.min(F.struct(F.abs(F.col("_at") - F.col("_cat")).alias("gap"), F.col("_cat").alias("at"), F.col("cand"))).alias("m"))
    return best.select(F.col("_k").alias(key), "report", F.col("m.cand").alias("cand"), F.col("m.gap").alias("gap"))


def next_session(cal: DataFrame) -> DataFrame:
    """(day, t, exact): for every civil day of the calendar's span the first session on or after it."""
    ends = cal.agg(F.min("d").alias("a"), F.max("d").alias("b"))
    days = ends.select(F.explode(F.sequence("a", "b")).alias("day")).join(cal, F.col("day") == F.col("d"), "left")
    ahead = W.orderBy("day").rowsBetween(0, W.unboundedFollowing)  # one row a civil day
    return days.select("day", F.min("t").over(ahead).alias("t"), F.col("d").isNotNull().alias("exact"))


def as_of_forward(events: DataFrame, cal: DataFrame, day: str) -> DataFrame:
    """Events with ``t``, the first session on or after their day, and ``exact``; days after the last session have none."""
    return events.join(next_session(cal).withColumnRenamed("day", day), day, "left")


def base_session(t: Column, exact: Column, timing: Column) -> Column:
    """Last session whose close precedes the report: A if it came after the close of session A, else A - 1."""
    return F.when((timing == "amc") & exact, t).otherwise(t - 1)


def event_table(events: DataFrame, grid: DataFrame, cal: DataFrame, anchor: bool = False) -> DataFrame:
    """A row per report: base session and its day, mean DPI before it, forward returns and volatility, a reaction flag, percentile ranks.

    ``events``: (symbol, report_date, timing). Reports of symbols without any price go, and those
    whose as-of or base session is the calendar's first or before it. DPI windows of 5 and 10 sessions end
    before the as-of session and need max(3, w - 2) values. The reaction flag is 1 if
    the next day's move reaches max(2 %, 2 sigma of sessions -65..-4); without a move or a sigma it is 0.
    ``has_data`` tells that there is a next day's return. With ``anchor`` the base is first moved by
    :func:`anchor_to_reaction`, and all that follows the base is taken from there.
    """
    px = daily_change(grid)
    for name, h in HORIZONS:
        px = forward_return(px, h, f"{name}_ret")
        px = realised_vol(px, h, f"{name}_rvol")
    for w in (5, 10):
        over = sessions("symbol", -w, -1)
        px = px.withColumn(f"dpi{w}", F.when(F.count("dpi").over(over) >= max(3, w - 2), F.avg("dpi").over(over)))
    over = sessions("symbol", -65, -4)
    px = px.withColumn("sigma", F.when(F.count("chg").over(over) > 10, F.stddev_samp("chg").over(over)))
    priced = grid.filter("adjclose is not null").select("symbol").distinct()
    at = as_of_forward(events, cal, "report_date").join(priced, "symbol", "left_semi")
    at = at.withColumn("base", base_session(F.col("t"), F.col("exact"), F.col("timing")).cast("int")).filter("t >= 1 and base >= 1")
    at = at.join(px.select("symbol", "t", "dpi5", "dpi10", "sigma"), ["symbol", "t"], "left")
    at = anchor_to_reaction(at, px, cal) if anchor else at.withColumn("anchored", F.lit(0))
    after = px.select("symbol", F.col("t").alias("base"), *(f"{n}_{k}" for n, _ in HORIZONS for k in ("ret", "rvol")))
    out = at.join(after, ["symbol", "base"], "left").join(cal.select(F.col("t").alias("base"), F.col("d").alias("base_date")), "base", "left")
    move = F.abs("next_day_ret") >= F.greatest(F.lit(0.02), 2 * F.col("sigma"))
    out = out.withColumn("looks_reaction", F.coalesce((F.col("sigma").isNotNull() & move).cast("int"), F.lit(0))).withColumn("has_data", F.col("next_day_ret").isNotNull().cast("int"))
    out = out.withColumn("dpi5", F.round("dpi5", 9)).withColumn("dpi10", F.round("dpi10", 9))
    for w in (5, 10):
        out = percent_rank(out, f"dpi{w}", f"dpi{w}_pct")
    return out


def percent_rank(df: DataFrame, value: str, out: str, part: str = "symbol") -> DataFrame:
    """Average rank over the number of values, within ``part``; null where the value is null. Not Spark's percent_rank."""
    has = F.col(value).isNotNull()
    rank = F.rank().over(W.partitionBy(part, has).orderBy(value)) + (F.count("*").over(W.partitionBy(part, value)) - 1) / 2
    return df.withColumn(out, F.when(has, rank / F.count(value).over(W.partitionBy(part))))


def long_horizons(events: DataFrame, kind: str = "ret") -> DataFrame:
    """Events once for each horizon: adds ``horizon`` and ``ret``."""
    pairs = F.array(*(F.struct(F.lit(n).alias("horizon"), F.col(f"{n}_{kind}").alias("ret")) for n, _ in HORIZONS))
    return events.withColumn("_h", F.explode(pairs)).withColumn("horizon", F.col("_h.horizon")).withColumn("ret", F.col("_h.ret")).drop("_h")


def tercile(pct: Column) -> Column:
    return F.when(pct >= 2 / 3, "high").when(pct <= 1 / 3, "low").when(pct.isNotNull(), "mid")


def tercile_spread(events: DataFrame, pct: str = "dpi10_pct") -> DataFrame:
    """Per horizon: means and up-rates of the terciles (missing returns count as not up), spread and Welch's t."""
    ev = long_horizons(events).withColumn("_t", tercile(F.col(pct)))
    high, low, mid = (F.col("_t") == x for x in ("high", "low", "mid"))
    up = lambda c: F.avg(F.when(c, F.coalesce((F.col("ret") > 0).cast("double"), F.lit(0.0))))
    agg = ev.groupBy("horizon").agg(*welch(F.col("ret"), high, low), F.avg(F.when(mid, F.col("ret"))).alias("mid_mean"), up(high).alias("high_up"), up(low).alias("low_up"), F.count_if(high).alias("high_n"), F.count_if(low).alias("low_n"))
    return agg.withColumns(welch_columns()).withColumnRenamed("m1", "high_mean").withColumnRenamed("m2", "low_mean").drop("n1", "n2", "v1", "v2")


def with_p(df: DataFrame) -> DataFrame:
    """Adds ``p`` for columns ``t_stat`` and ``df``."""
    return df.withColumn("p", p_value("t_stat", "df"))


def horizon_rollup(events: DataFrame, x: str = "dpi10", least: int = 5) -> DataFrame:
    """Per horizon: pairs and correlation."""
    ev = long_horizons(events).filter(F.col(x).isNotNull() & F.col("ret").isNotNull())
    out = ev.groupBy("horizon").agg(F.count("*").alias("n"), F.corr(x, "ret").alias("r")).filter(F.col("n") >= least)
    return out


def relations(events: DataFrame, kind: str = "ret", least: int = 5) -> DataFrame:
    """Per DPI window and horizon: pairs, Pearson's and Spearman's correlation, that with the rank within the name, and their p-values.

    Null under ``least`` pairs or without variance. ``kind``: returns or volatility (``rvol``).
    """
    windows = F.array(*(F.struct(F.lit(w).alias("window"), F.col(w).alias("x"), F.col(f"{w}_pct").alias("pct")) for w in ("dpi5", "dpi10")))
    ev = long_horizons(events, kind).select("horizon", F.col("ret").alias("y"), F.explode(windows).alias("w")).select("w.window", "horizon", "w.x", "w.pct", "y").filter("x is not null and y is not null")
    part = ["window", "horizon"]
    ev = ev.withColumn("rx", average_rank("x", part)).withColumn("ry", average_rank("y", part))
    real = lambda a, b: F.when((F.count("*") >= least) & (F.stddev_pop(a) > 1e-12) & (F.stddev_pop(b) > 1e-12), F.corr(a, b))
    out = ev.groupBy(*part).agg(F.count("*").alias("n"), real("x", "y").alias("pearson"), real("rx", "ry").alias("spearman"), real("pct", "y").alias("within"))
    return out.withColumns({f"{c}_p": p_of_correlation(F.col(c), F.col("n")) for c in ("pearson", "spearman", "within")})


def correlation_p(rollup: DataFrame) -> DataFrame:
    """Adds ``p`` for columns ``r`` and ``n``."""
    return rollup.withColumn("p", p_of_correlation(F.col("r"), F.col("n")))


def quintiles(events: DataFrame, x: str, y: str) -> DataFrame:
    """Means of y in five bins of x, cut at linear quantiles, closed on the right."""
    own = events.filter(F.col(x).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    cuts = picked(own, [], "x", {f"c{j}": linear(j / 5) for j in range(1, 5)}).select(F.array(*(F.round(f"c{j}", 9) for j in range(1, 5))).alias("c")).scalar()
    place = F.size(F.filter("_cuts", lambda c: c < F.col("x"))) + 1
    return own.withColumn("_cuts", cuts).withColumn("quintile", place).groupBy("quintile").agg(F.count("*").alias("n"), F.avg("x").alias("x_mean"), F.avg("y").alias("y_mean"))


def correlation_cuts(events: DataFrame, cohort: list[str], x: str = "dpi10", y: str = "m1_ret", least: int = 8) -> DataFrame:
    """Correlations by year, cohort, timing, name and early or late half, as grouping sets of one aggregation: (cut, value, n, r)."""
    ev = events.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("year", F.year("report_date"))
    middle = picked(ev, [], "year", {"m": linear(0.5)}).select(F.floor("m")).scalar()
    ev = ev.withColumn("_middle", middle).select(
        F.col("year").cast("string").alias("year"), "timing", F.col("symbol").alias("name"), F.when(F.col("symbol").isin(cohort), "in").otherwise("out").alias("cohort"),
        F.when(F.col("year") <= F.col("_middle"), "early").otherwise("late").alias("half"), F.col(x).alias("_x"), F.col(y).alias("_y"),
    )
    cuts = ["year", "timing", "name", "cohort", "half"]
    own = lambda c: F.grouping(c) == 0
    which, value = F.coalesce(*(F.when(own(c), F.lit(c)) for c in cuts)), F.coalesce(*(F.when(own(c), F.col(c)) for c in cuts))
    out = ev.groupingSets([[c] for c in cuts], *cuts).agg(which.alias("cut"), value.alias("value"), F.count("*").alias("n"), F.corr("_x", "_y").alias("r"))
    return out.filter(F.col("n") >= least).select("cut", "value", "n", "r")


def cut_relations(events: DataFrame, cohort: list[str], least: int = 5) -> DataFrame:
    """By year, cohort and timing: reports with a DPI, and its correlation with the month's and the next day's return, with p-values.

    One aggregation over grouping sets; a correlation under ``least`` pairs or without variance is null.
    """
    ev = events.select(F.year("report_date").cast("string").alias("year"), F.when(F.col("symbol").isin(cohort), "in").otherwise("out").alias("cohort"), "timing", "dpi10", "m1_ret", "next_day_ret")
    cuts = ["year", "cohort", "timing"]
    which = F.coalesce(*(F.when(F.grouping(c) == 0, F.lit(c)) for c in cuts))
    value = F.coalesce(*(F.when(F.grouping(c) == 0, F.col(c)) for c in cuts))
    aggs = [which.alias("cut"), value.alias("value"), F.count("dpi10").alias("n")]
    for name, y in (("m1", "m1_ret"), ("next", "next_day_ret")):
        both = F.col("dpi10").isNotNull() & F.col(y).isNotNull()
        a, b = F.when(both, F.col("dpi10")), F.when(both, F.col(y))
        real = (F.count(a) >= least) & (F.stddev_pop(a) > 1e-12) & (F.stddev_pop(b) > 1e-12)
        aggs += [F.count(a).alias(f"_{name}"), F.when(real, F.corr(a, b)).alias(f"{name}_r")]
    out = ev.groupingSets([[c] for c in cuts], *cuts).agg(*aggs)
    for name in ("m1", "next"):
        out = out.withColumn(f"{name}_p", p_of_correlation(F.col(f"{name}_r"), F.col(f"_{name}")))
    return out.select("cut", "value", "n", "m1_r", "m1_p", "next_r", "next_p")


def event_classes(events: DataFrame, x: str = "dpi10", least: int = 6) -> DataFrame:
    """Adds ``cls``: hi or lo by the symbol's own terciles of x, with ``least`` values; else mid."""
    own = W.partitionBy("symbol")
    cuts = F.percentile(x, F.array(F.lit(1 / 3), F.lit(2 / 3))).over(own)
    ev = events.withColumn("_c", cuts).withColumn("_n", F.count(x).over(own))
    cls = F.when(F.col(x) >= F.round(F.get("_c", 1), 9), "hi").when(F.col(x) <= F.round(F.get("_c", 0), 9), "lo").otherwise("mid")
    return ev.withColumn("cls", F.when((F.col("_n") >= least) & F.col(x).isNotNull(), cls)).drop("_c", "_n")


def path_rollup(events: DataFrame, panel: DataFrame, steps: int = 21, least: int = 5) -> DataFrame:
    """Per symbol and offset: mean and median path after events in basis points (half-even), and mean paths of the hi and the lo class (3 events or more).

    Only events whose path is complete count; a symbol needs ``least`` of them.
    """
    starts = event_classes(events).select("symbol", F.col("base").alias("t"), "report_date", "cls")
    own = paths(starts, panel, steps).withColumn("bp", F.bround(F.col("move") * 10000).cast("int"))
    full = W.partitionBy("symbol", "report_date")
    own = own.withColumn("_k", F.count("*").over(full)).filter(F.col("_k") == steps + 1)
    hi, lo = (F.when(F.col("cls") == c, F.col("bp")) for c in ("hi", "lo"))
    out = own.groupBy("symbol", "k").agg(F.count("*").alias("n"), F.avg("bp").alias("mean_bp"), F.median("bp").alias("median_bp"), F.when(F.count(hi) >= 3, F.avg(hi)).alias("hi_bp"), F.when(F.count(lo) >= 3, F.avg(lo)).alias("lo_bp"), F.count_if(F.col("bp") > 0).alias("up"))
    return out.filter(F.col("n") >= least)


def path_finals(events: DataFrame, panel: DataFrame, steps: int = 21, least: int = 5, few: int = 3) -> DataFrame:
    """Per symbol: complete paths, mean and median final move, how many end up, final means of the hi and lo classes (``few`` events or more), mean volatility over the horizon by class.

    A symbol needs ``least`` complete paths.
    """
    starts = event_classes(events).select("symbol", F.col("base").alias("t"), "report_date", "cls", "m1_rvol")
    own = paths(starts, panel, steps).withColumn("bp", F.bround(F.col("move") * 10000).cast("int"))
    own = own.withColumn("_k", F.count("*").over(W.partitionBy("symbol", "report_date"))).filter((F.col("_k") == steps + 1) & (F.col("k") == steps))
    of = lambda c, x: F.when(F.col("cls") == c, F.col(x))
    out = own.groupBy("symbol").agg(
        F.count("*").alias("n"), F.avg("bp").alias("final_mean"), F.median("bp").alias("final_median"), F.count_if(F.col("bp") > 0).alias("up"),
        F.when(F.count(of("hi", "bp")) >= few, F.avg(of("hi", "bp"))).alias("hi_mean"), F.when(F.count(of("lo", "bp")) >= few, F.avg(of("lo", "bp"))).alias("lo_mean"),
        F.avg("m1_rvol").alias("rvol"), F.avg(of("hi", "m1_rvol")).alias("rvol_hi"), F.avg(of("lo", "m1_rvol")).alias("rvol_lo"),
    )
    return out.filter(F.col("n") >= least)


def unpivoted(df: DataFrame, section: str, item: str, names: tuple[str, ...]) -> DataFrame:
    """(section, item, metric, value), a row for each of ``names``."""
    rows = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names))
    return df.select(F.lit(section).alias("section"), F.col(item).alias("item"), F.explode(rows).alias("m")).select("section", "item", "m.metric", "m.value")


def full_summary(events: DataFrame, cohort: list[str]) -> DataFrame:
    """:func:`summary` with the terciles and Welch's t, volatility by tercile, and correlations by cut, as rows of one table."""
    events = cut(events)  # a row a report, read for each section
    spread = unpivoted(tercile_spread(events), "tercile", "horizon", ("high_n", "low_n", "high_mean", "low_mean", "high_up", "low_up", "spread", "t_stat", "df"))
    ev = long_horizons(events, "rvol").withColumn("_t", tercile(F.col("dpi10_pct")))
    vol = ev.groupBy("horizon").agg(F.avg("ret").alias("mean"), F.corr("dpi10", "ret").alias("r"), F.avg(F.when(F.col("_t") == "high", F.col("ret"))).alias("high"), F.avg(F.when(F.col("_t") == "low", F.col("ret"))).alias("low"))
    cuts = correlation_cuts(events, cohort).withColumn("item", F.concat_ws("=", "cut", "value"))
    return summary(events).unionByName(spread).unionByName(unpivoted(vol, "volatility", "horizon", ("mean", "r", "high", "low"))).unionByName(unpivoted(cuts, "cut", "item", ("n", "r")))


def names_by_correlation(events: DataFrame, x: str = "dpi10", y: str = "m1_ret", least: int = 8) -> DataFrame:
    """Per name with ``least`` values of x: pairs, correlation and its place, ascending; nulls last, ties by name."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    own = events.groupBy("symbol").agg(F.count(x).alias("_n"), F.count_if(both).alias("n"), F.corr(x, y).alias("r")).filter(F.col("_n") >= least).drop("_n")
    return own.withColumn("place", F.row_number().over(W.orderBy(F.asc_nulls_last(F.round("r", 9)), "symbol")))  # a row for each name


def anchor_to_reaction(events: DataFrame, changes: DataFrame, cal: DataFrame, before: int = 1, after: int = 5, least: float = 0.03, sigmas: float = 2.5, lead: float = 1.3) -> DataFrame:
    """Moves ``base`` to the session before the dominant move on the sessions -before..after of it, if there is one; ``anchored`` (1 or 0) tells.

    The largest absolute daily change must reach ``least``, ``sigmas`` deviations and
    ``lead`` times the second. The window ends at the calendar's ends, and never holds its
    first session; a window of one session, a missing change in it, or no deviation above zero forbids moving.
    ``events``: (symbol, report_date, base, sigma, ..), ``changes``: (symbol, t, chg).
    """
    last = cal.agg(F.max("t")).scalar()
    own = events.withColumn("_last", last)
    own = own.withColumn("_lo", F.greatest(F.lit(1), F.col("base") - before)).withColumn("_hi", F.least(F.col("_last"), F.col("base") + after))
    slots = own.filter("_lo < _hi").select("symbol", "report_date", "base", (F.col("_hi") - F.col("_lo") + 1).alias("_size"), F.explode(F.sequence("_lo", "_hi")).alias("t")).distinct()
    slots = slots.join(changes.select("symbol", "t", F.abs("chg").alias("a")), ["symbol", "t"])
    keys = ["symbol", "report_date", "base"]
    moves = slots.groupBy(*keys, "_size").agg(F.sort_array(F.collect_list(F.struct("a", F.col("t").alias("at"))), asc=False).alias("m"), F.count("a").alias("c"))
    big, second = F.get("m", 0), F.get("m", 1)
    good = (F.col("c") == F.col("_size")) & (big["a"] >= least) & (F.col("sigma") > 0) & (big["a"] >= sigmas * F.col("sigma")) & (big["a"] >= lead * F.greatest(second["a"], F.lit(1e-9)))
    both = events.join(moves, keys, "left").withColumn("anchored", F.coalesce(good, F.lit(False)).cast("int"))
    return both.withColumn("base", F.when(F.col("anchored") == 1, big["at"] - 1).otherwise(F.col("base")).cast("int")).drop("m", "c", "_size")


def summary(events: DataFrame) -> DataFrame:
    """The study as rows: (section, item, metric, value)."""
    ev = long_horizons(events)
    med = picked(ev, ["horizon"], "ret", {"median": linear(0.5)}).drop("n")
    base = ev.groupBy("horizon").agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("std"), F.avg((F.col("ret") > 0).cast("double")).alias("positive"), F.corr("dpi10", "ret").alias("r_dpi10"), F.corr("dpi5", "ret").alias("r_dpi5")).join(F.broadcast(med), "horizon", "left")
    names = ("mean", "median", "std", "positive", "r_dpi10", "r_dpi5")
    rows = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names))
    horizons = base.select(F.lit("horizon").alias("section"), F.col("horizon").alias("item"), F.explode(rows).alias("m")).select("section", "item", "m.metric", "m.value")
    counts = events.agg(F.count("*").cast("double").alias("events"), F.countDistinct("symbol").cast("double").alias("names"), F.count_if(F.col("dpi10").isNotNull()).cast("double").alias("with_data"))
    rows = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in ("events", "names", "with_data")))
    totals = counts.select(F.lit("sample").alias("section"), F.lit("all").alias("item"), F.explode(rows).alias("m")).select("section", "item", "m.metric", "m.value")
    timing = events.groupBy("timing").agg(F.count("*").cast("double").alias("value")).select(F.lit("timing").alias("section"), F.col("timing").alias("item"), F.lit("events").alias("metric"), "value")
    return horizons.unionByName(totals).unionByName(timing)

