"""Decile states, streak events, what follows them, and the backtest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowlens.functions.core import ratio
from flowlens.functions.rolling import trailing
from flowlens.functions.selection import linear, picked
from flowlens.functions.store import cut
from flowlens.operators.panel import forward_return


def trailing_decile(panel: DataFrame, value: str, width: int = 252, least: int = 120) -> DataFrame:
    """(symbol, t, decile): place of the value among the ``width`` valid observations before it; no look-ahead."""
    own = panel.filter(F.col(value).isNotNull()).select("symbol", "t", F.col(value).alias("v"))
    own = trailing(own, ["symbol"], "v", width, seen="_n", up_to="_le", current=False)
    return own.withColumn("decile", F.when(F.col("_n") >= least, F.greatest(F.lit(1), F.ceil(10 * F.col("_le") / F.col("_n")))).cast("int")).select("symbol", "t", "decile")


def sample_decile(panel: DataFrame, value: str, least: int = 20) -> DataFrame:
    """(symbol, t, decile) by the symbol's own cuts sorted[floor(n j / 10)]: 1 + number of cuts below the value."""
    own = panel.filter(F.col(value).isNotNull()).select("symbol", "t", F.col(value).alias("v"))
    part = W.partitionBy("symbol")
    own = own.withColumn("_n", F.count("*").over(part)).withColumn("_i", F.row_number().over(part.orderBy("v", "t")) - 1).filter(F.col("_n") >= least)
    for j in range(1, 10):
        own = own.withColumn(f"_c{j}", F.max(F.when(F.col("_i") == F.floor(F.col("_n") * j / 10), F.col("v"))).over(part))
    cuts = sum((F.col(f"_c{j}") < F.col("v")).cast("int") for j in range(1, 10))
    return own.select("symbol", "t", (cuts + 1).cast("int").alias("decile"))


def pooled_decile(panel: DataFrame, value: str, least: int = 20) -> DataFrame:
    """As :func:`sample_decile` with cuts of the whole pool, which is neither gathered nor sorted: nine ranks are selected."""
    own = panel.filter(F.col(value).isNotNull()).select("symbol", "t", F.col(value).alias("v"))
    picks = picked(own, [], "v", {f"c{j}": lambda n, j=j: F.floor(n * j / 10) for j in range(1, 10)}).filter(F.col("n") >= least)
    cuts = picks.select(F.array(*(f"c{j}" for j in range(1, 10))).alias("c")).scalar()
    below = F.size(F.filter("_cuts", lambda c: c < F.col("v")))
    return own.withColumn("_cuts", cuts).filter(F.col("_cuts").isNotNull()).select("symbol", "t", (below + 1).cast("int").alias("decile"))


def in_band(states: DataFrame, lo: int, hi: int) -> DataFrame:
    return states.filter(F.col("decile").between(lo, hi))


def islands(hits: DataFrame, part: list[str]) -> DataFrame:
    """Runs of consecutive sessions in ``hits`` (part, t): adds ``island`` and the place ``k`` in it, from 1."""
    own = W.partitionBy(*part).orderBy("t")
    marked = hits.withColumn("island", F.col("t") - F.row_number().over(own))
    return marked.withColumn("k", F.row_number().over(W.partitionBy(*part, "island").orderBy("t")))


def streak_events(hits: DataFrame, run: int = 5, part: list[str] | None = None) -> DataFrame:
    """(part, t): the run-th consecutive session of a streak; it fires once, and a missing session breaks the run."""
    part = part or ["symbol"]
    return islands(hits, part).filter(F.col("k") == run).select(*part, "t")


def streak_status(states: DataFrame, cal: DataFrame, lo: int, hi: int, run: int = 5, fresh: int = 3) -> DataFrame:
    """Per symbol: length of the streak that is on, whether it is active (run reached) or building (one short), last event.

    A streak is on if it holds the symbol's last state and that one is among the
    calendar's last ``fresh`` sessions, whether or not any symbol has a state there.
    """
    marked = islands(in_band(states, lo, hi), ["symbol"])
    newest = states.filter("decile is not null").groupBy("symbol").agg(F.max("t").alias("last_t"))
    end = cal.agg(F.max("t")).scalar()
    tips = marked.groupBy("symbol").agg(F.max("t").alias("tip"), F.max_by("k", "t").alias("k"), F.max(F.when(F.col("k") == run, F.col("t"))).alias("last_event"))
    out = newest.withColumn("_end", end).join(tips, "symbol", "left")
    on = (F.col("tip") == F.col("last_t")) & (F.col("last_t") > F.col("_end") - fresh)
    length = F.when(on, F.col("k")).otherwise(0).cast("int")
    return out.withColumn("length", length).select("symbol", "length", F.when(F.col("length") >= run, "active").when(F.col("length") == run - 1, "building").otherwise("none").alias("status"), "last_event")


def event_returns(events: DataFrame, panel: DataFrame, horizons: tuple[int, ...] = (21, 42, 63), price: str = "adjclose") -> DataFrame:
    """Events with their forward returns, a row for each horizon: (symbol, t, h, ret)."""
    return events.join(long_returns(panel, horizons, price), ["symbol", "t"])


def long_returns(panel: DataFrame, horizons: tuple[int, ...] = (21, 42, 63), price: str = "adjclose", bench: str | None = None, excess: bool = False) -> DataFrame:
    """(symbol, t, h, ret) of the whole panel, missing returns left out, and those of the symbol ``bench``.

    With ``excess`` returns are less the benchmark's over the same sessions; where it has none there is none.
    """
    wide = panel
    for h in horizons:
        wide = forward_return(wide, h, f"r{h}", price)
    pairs = F.array(*(F.struct(F.lit(h).alias("h"), F.col(f"r{h}").alias("ret")) for h in horizons))
    long = wide.select("symbol", "t", F.explode(pairs).alias("p")).select("symbol", "t", "p.h", "p.ret").filter("ret is not null")
    if bench is None:
        return long
    base = long.filter(F.col("symbol") == bench).select("t", "h", F.col("ret").alias("_b"))  # a row a session and horizon
    long = long.filter(F.col("symbol") != bench)
    return long.join(base, ["t", "h"]).select("symbol", "t", "h", (F.col("ret") - F.col("_b")).alias("ret")) if excess else long


def day_means(returns: DataFrame) -> DataFrame:
    """Cross-sectional mean return per session and horizon."""
    return returns.groupBy("t", "h").agg(F.avg("ret").alias("base"))


def matched_base(events: DataFrame, returns: DataFrame) -> DataFrame:
    """Per horizon: events, their mean return, the mean of the day means on their days (with multiplicity), and the edge."""
    own = events.join(returns, ["symbol", "t"]).join(day_means(returns), ["t", "h"])
    return own.groupBy("h").agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), F.avg("base").alias("base"), F.avg(F.col("ret") - F.col("base")).alias("edge"))


def band_events(states: DataFrame, run: int = 5) -> DataFrame:
    """(symbol, t, bands): the bands lo <= hi of which a streak completes ``run`` sessions at t; rows of no event have none.

    One pass over each symbol's states carries twenty running maxima: the last
    session at which the state was below each lo, and above each hi. A
    session without a state, or missing from ``states``, is outside every band. A band's streak is then
    the sessions since the later one of its two, so no row is copied to the bands that hold it.
    """
    own = W.partitionBy("symbol").orderBy("t")
    so_far = own.rowsBetween(W.unboundedPreceding, 0)
    gap = F.when(F.col("t") - F.lag("t", 1).over(own) == 1, F.when(F.col("decile").isNull(), F.col("t"))).otherwise(F.when(F.col("decile").isNull(), F.col("t")).otherwise(F.col("t") - 1))
    marks = {"_gap": F.col("_broken")}
    marks |= {f"_under{k}": F.when(F.col("decile") < k, F.col("t")) for k in range(2, 11)} | {f"_over{k}": F.when(F.col("decile") > k, F.col("t")) for k in range(1, 10)}
    seen = states.select("symbol", "t", "decile").withColumn("_broken", gap)
    seen = seen.select("symbol", "t", "decile", *(F.max(v).over(so_far).alias(k) for k, v in marks.items()))
    # a streak of a band has run sessions if the later of its two marks is at t - run; marks grow with lo and fall with hi,
    # so the los whose mark is no later are 1 to lo_le and those whose mark is earlier 1 to lo_lt; of the his they are the last ones
    since = F.col("t") - run
    count = lambda name, ks, test: F.lit(1) + sum(F.coalesce(test(F.col(f"{name}{k}")).cast("int"), F.lit(1)) for k in ks)
    both = {"lo": ("_under", range(2, 11)), "hi": ("_over", range(1, 10))}
    ends = {f"{k}_le": count(*v, lambda c: c <= since) for k, v in both.items()} | {f"{k}_lt": count(*v, lambda c: c < since) for k, v in both.items()}
    seen = seen.filter(F.col("decile").isNotNull() & (F.col("_gap") <= since)).select("symbol", "t", (F.col("_gap") == since).alias("begins"), *(v.alias(k) for k, v in ends.items()))
    seen = seen.filter(F.col("begins") | (F.col("lo_le") > F.col("lo_lt")) | (F.col("hi_le") > F.col("hi_lt")))
    held = F.flatten(F.transform(F.sequence(F.lit(1), "lo_le"), lambda lo: F.transform(F.sequence(11 - F.col("hi_le"), F.lit(10)), lambda hi: F.struct(lo.alias("lo"), hi.alias("hi")))))
    mine = F.filter(held, lambda b: F.col("begins") | (b["lo"] > F.col("lo_lt")) | (b["hi"] <= 10 - F.col("hi_lt")))
    return seen.select("symbol", "t", mine.alias("bands"))


def band_sweep(states: DataFrame, returns: DataFrame, run: int = 5) -> DataFrame:
    """All 55 bands lo <= hi: streak events and their mean, median and MAD per horizon. Only events go to the bands they are of."""
    events = band_events(states, run).join(returns, ["symbol", "t"]).select(F.explode("bands").alias("b"), "h", "ret").select("b.lo", "b.hi", "h", "ret")
    keys = ["lo", "hi", "h"]
    events = cut(events)
    stats = events.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("std"))
    median = picked(events, keys, "ret", {"median": linear(0.5)}, written=True).drop("n")
    far = events.join(F.broadcast(median), keys).withColumn("far", F.abs(F.col("ret") - F.col("median")))  # a row for each band and horizon
    mad = picked(far, keys, "far", {"mad": linear(0.5)}, written=True).drop("n")
    return stats.join(median, keys).join(mad, keys).select(*keys, "n", "mean", "median", "mad", "std")


def sweep_table(states: DataFrame, returns: DataFrame, run: int = 5, horizons: tuple[int, ...] = (21, 42, 63)) -> DataFrame:
    """The sweep's bands with all their streaks, also those without a return, their mean per horizon, and the places by either.

    Band 0-0 is the baseline: all (name, day) returns. Means that are missing come last; ties go by band.
    """
    by_day = returns.groupBy("symbol", "t").agg(F.collect_list(F.struct("h", "ret")).alias("rets"))  # a row a session, with a return for each horizon
    events = band_events(states, run).join(by_day, ["symbol", "t"], "left").select(F.explode("bands").alias("b"), "rets")
    every = F.transform(F.array(*map(F.lit, horizons)), lambda h: F.struct(h.alias("h"), F.get(F.filter("rets", lambda r: r["h"] == h), 0)["ret"].alias("ret")))
    long = events.select("b.lo", "b.hi", F.explode(every).alias("r"))
    grid = long.groupBy("lo", "hi", F.col("r.h").alias("h")).agg(F.count("*").alias("streaks"), F.count("r.ret").alias("n"), F.avg("r.ret").alias("mean"))
    base = returns.groupBy("h").agg(F.count("*").alias("n"), F.avg("ret").alias("mean")).select(F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(None).cast("long").alias("streaks"), "h", "n", "mean")
    part = W.partitionBy("h")
    grid = grid.withColumn("by_streaks", F.row_number().over(part.orderBy(F.desc("streaks"), "lo", "hi"))).withColumn("by_mean", F.row_number().over(part.orderBy(F.desc_nulls_last(F.round("mean", 9)), "lo", "hi")))
    return grid.unionByName(base, allowMissingColumns=True)


def current_streaks(status: DataFrame, active: int = 12, building: int = 8) -> DataFrame:
    """The longest active streaks and those one session short, first ``active`` and ``building`` of them; ties by symbol."""
    own = status.filter(F.col("status") != "none").withColumn("rank", F.row_number().over(W.partitionBy("status").orderBy(F.desc("length"), "symbol")))
    return own.filter(F.col("rank") <= F.when(F.col("status") == "active", active).otherwise(building)).select("status", "rank", "symbol", "length")


def regime_split(events: DataFrame, returns: DataFrame, cal: DataFrame, boundary: str) -> DataFrame:
    """Events before and from a boundary day and all together, per horizon, against their matched base.

    A boundary that leaves less than two sessions on its right or none on its
    left is replaced by the sample's middle session.
    """
    first = cal.agg(F.min(F.when(F.col("d") >= F.lit(boundary).cast("date"), F.col("t"))).alias("s"), F.count("*").alias("n"))
    split = first.select(F.when((F.col("s") > 0) & (F.col("s") < F.col("n") - 1), F.col("s")).otherwise(F.floor(F.col("n") / 2)).cast("int")).scalar()
    own = events.join(returns, ["symbol", "t"]).join(day_means(returns), ["t", "h"]).join(cal, "t")
    own = own.withColumn("_split", split)
    own = own.withColumn("side", F.when(F.col("t") < F.col("_split"), "before").otherwise("after"))
    out = own.groupingSets([["h"], ["h", "side"]], "h", "side").agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), F.avg("base").alias("base"), F.avg(F.col("ret") - F.col("base")).alias("edge"))
    return out.select(F.coalesce("side", F.lit("full")).alias("period"), "h", "n", "mean", "base", "edge")


def paths(starts: DataFrame, panel: DataFrame, steps: int = 63, price: str = "adjclose", hedge: str | None = None) -> DataFrame:
    """(starts' columns, k, move): price moves 0..steps sessions after each start; missing prices are left out.

    With ``hedge`` moves are less that symbol's over the same sessions; starts and sessions on which it has no price go.
    """
    px = panel.filter(F.col(price).isNotNull()).select("symbol", F.col("t").alias("_t"), F.col(price).alias("_p"))
    if hedge is not None:
        px = px.join(px.filter(F.col("symbol") == hedge).select("_t", F.col("_p").alias("_b")), "_t")  # a row a session
    else:
        px = px.withColumn("_b", F.lit(None).cast("double"))
    first = starts.join(px.select("symbol", F.col("_t").alias("t"), F.col("_p").alias("_p0"), F.col("_b").alias("_b0")), ["symbol", "t"])
    at = first.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("_t", (F.col("t") + F.col("k")).cast("int"))
    move = ratio("_p", "_p0") - 1
    move = move if hedge is None else move - (ratio("_b", "_b0") - 1)
    return at.join(px, ["symbol", "_t"]).withColumn("move", move).drop("_t", "_p", "_p0", "_b", "_b0")


def event_drift(events: DataFrame, panel: DataFrame, steps: int = 63, price: str = "adjclose", hedge: str | None = None) -> DataFrame:
    """Per offset k: mean move after events, its standard error (population) and number."""
    moves = paths(events, panel, steps, price, hedge).groupBy("k").agg(F.count("*").alias("n"), F.avg("move").alias("mean"), F.stddev_pop("move").alias("_s"))
    return moves.select("k", "n", "mean", (F.col("_s") / F.sqrt("n")).alias("se"))


def matched_drift(events: DataFrame, panel: DataFrame, steps: int = 63, price: str = "adjclose", bench: str | None = None, excess: bool = False) -> DataFrame:
    """Per offset k: the mean path of all names but ``bench`` on each event day, averaged with the days' numbers of events.

    Names are averaged per (t, k) before events come in, so no name meets every event.
    """
    days = events.groupBy("t").agg(F.count("*").alias("w"))
    every = panel.filter(F.col(price).isNotNull()).select("symbol", "t").join(days, "t")
    every = every if bench is None else every.filter(F.col("symbol") != bench)
    by_day = paths(every, panel, steps, price, bench if excess else None).groupBy("t", "k").agg(F.avg("move").alias("m"), F.first("w").alias("w"))
    return by_day.groupBy("k").agg(F.sum("w").alias("n"), (F.sum(F.col("m") * F.col("w")) / F.sum("w")).alias("mean"))


def holdings(events: DataFrame, panel: DataFrame, runs: list[tuple[int, int]], price: str = "adjclose", hedge: str | None = None) -> DataFrame:
    """Days of every trade of every run (hold, lag): (hold, lag, symbol, e, day, p, r, x, p0, and the hedge's b, hp, hp0).

    A trade enters lag sessions after an event, if there is a price, and leaves
    at the last price within ``hold`` sessions, ``x``, which must be later. ``r`` and ``b`` are the day's
    returns over exactly one session, null without both prices or on a price of zero. One equi-join for all runs.
    """
    px = panel.filter(F.col(price).isNotNull()).select("symbol", F.col("t").alias("day"), F.col(price).alias("p"))
    before = F.first("p").over(W.partitionBy("symbol").orderBy("day").rangeBetween(-1, -1))
    px = px.withColumn("r", ratio("p", before) - 1)
    if hedge is not None:
        base = px.filter(F.col("symbol") == hedge).select("day", F.col("r").alias("b"), F.col("p").alias("hp"))  # a row a session
        px = px.join(base, "day", "left")
    else:
        px = px.withColumns({"b": F.lit(None).cast("double"), "hp": F.lit(None).cast("double")})
    variants = F.array(*(F.struct(F.lit(h).alias("hold"), F.lit(k).alias("lag")) for h, k in runs))
    entries = events.select("symbol", "t").distinct().select("symbol", "t", F.explode(variants).alias("v")).select("symbol", "v.hold", "v.lag", (F.col("t") + F.col("v.lag")).cast("int").alias("e"))
    days = entries.withColumn("day", F.explode(F.sequence(F.col("e"), F.col("e") + F.col("hold")))).join(px, ["symbol", "day"])
    trade = W.partitionBy("hold", "lag", "symbol", "e")  # hold + 1 rows
    first = lambda c: F.max(F.when(F.col("day") == F.col("e"), F.col(c))).over(trade)
    days = days.withColumn("x", F.max("day").over(trade)).withColumn("entered", first("day")).withColumn("p0", first("p")).withColumn("hp0", first("hp"))
    return days.filter("entered is not null and x > e").drop("entered")


def equities(held: DataFrame, cal: DataFrame, runs: list[tuple[int, int]], cost_bps: float = 5.0) -> DataFrame:
    """Daily equity of each run: (hold, lag, t, positions, ret, equity, drawdown), a row a session of ``cal``.

    Open positions have equal weight; a position without a return on a day is not
    open on it. Both sides cost ``cost_bps``; a day without the hedge's return is not hedged.
    """
    cost = cost_bps / 10000
    live = held.filter((F.col("day") > F.col("e")) & F.col("r").isNotNull())
    own = F.col("r") - F.coalesce("b", F.lit(0.0)) - F.when(F.col("day") == F.col("e") + 1, cost).otherwise(0.0) - F.when(F.col("day") == F.col("x"), cost).otherwise(0.0)
    daily = live.groupBy("hold", "lag", F.col("day").alias("t")).agg(F.count("*").alias("positions"), F.avg(own).alias("ret"))
    variants = F.array(*(F.struct(F.lit(h).alias("hold"), F.lit(k).alias("lag")) for h, k in runs))
    every = cal.select("t", F.explode(variants).alias("v")).select("v.hold", "v.lag", "t").join(daily, ["hold", "lag", "t"], "left")
    every = every.select("hold", "lag", "t", F.coalesce("positions", F.lit(0)).alias("positions"), F.coalesce("ret", F.lit(0.0)).alias("ret"))
    so_far = W.partitionBy("hold", "lag").orderBy("t").rowsBetween(W.unboundedPreceding, 0)  # a row a session
    # the product of 1 + ret: a hedge can lose more than everything, so signs and zeros count
    size = F.exp(F.sum(F.log(F.when(F.col("ret") != -1, F.abs(1 + F.col("ret"))).otherwise(1.0))).over(so_far))
    sign = F.when(F.count_if(F.col("ret") < -1).over(so_far) % 2 == 1, -1.0).otherwise(1.0)
    every = every.withColumn("equity", F.when(F.count_if(F.col("ret") == -1).over(so_far) > 0, 0.0).otherwise(sign * size))
    peak = F.greatest(F.lit(1.0), F.max("equity").over(so_far))
    return every.withColumn("drawdown", F.col("equity") / peak - 1)


def trade_returns(held: DataFrame, cost_bps: float = 5.0) -> DataFrame:
    """(hold, lag, symbol, e, x, ret): each trade's return after both costs, less the hedge's over the same sessions where it has both prices."""
    whole = ratio("p", "p0") - 1 - 2 * cost_bps / 10000 - F.coalesce(ratio("hp", "hp0") - 1, F.lit(0.0))
    return held.filter(F.col("day") == F.col("x")).select("hold", "lag", "symbol", "e", "x", whole.alias("ret"))


def backtest(events: DataFrame, panel: DataFrame, cal: DataFrame, hold: int = 21, lag: int = 1, cost_bps: float = 5.0, price: str = "adjclose", hedge: str | None = None) -> DataFrame:
    """Daily equity of holding each event's symbol from t + lag for at most ``hold`` sessions, hedged with the symbol ``hedge`` if one is given: (t, positions, ret, equity, drawdown)."""
    return equities(holdings(events, panel, [(hold, lag)], price, hedge), cal, [(hold, lag)], cost_bps).drop("hold", "lag")


def backtest_lags(events: DataFrame, panel: DataFrame, cal: DataFrame, holds: tuple[int, ...] = (21, 42, 63), cost_bps: float = 5.0, price: str = "adjclose", hedge: str | None = None) -> DataFrame:
    """Per holding period: trades, total when entered a session later, total at the event's own close, and what the lag costs."""
    runs = [(h, lag) for h in holds for lag in (1, 0)]
    held = cut(holdings(events, panel, runs, price, hedge))  # read for the equity and for the trades
    totals = equities(held, cal, runs, cost_bps).groupBy("hold", "lag").agg((F.max_by("equity", "t") - 1).alias("v"))
    entered = held.filter(F.col("day") == F.col("x")).groupBy("hold", "lag").agg(F.count("*").alias("n"))
    both = totals.join(entered, ["hold", "lag"], "left")
    of = lambda lag, c: F.max(F.when(F.col("lag") == lag, F.col(c)))
    out = both.groupBy("hold").agg(F.coalesce(of(1, "n"), F.lit(0)).alias("trades"), of(1, "v").alias("total"), of(0, "v").alias("total_no_lag"))
    return out.withColumn("lag", F.col("total") - F.col("total_no_lag"))


def with_hold(equity: DataFrame, panel: DataFrame, symbol: str, price: str = "adjclose") -> DataFrame:
    """Adds ``hold``: the symbol's price over its first one, carried over sessions without a price."""
    px = panel.filter((F.col("symbol") == symbol) & F.col(price).isNotNull()).select("t", F.col(price).alias("_p"))
    so_far = W.orderBy("t").rowsBetween(W.unboundedPreceding, 0)  # one row a session
    both = equity.join(px, "t", "left").withColumn("_p", F.last("_p", ignorenulls=True).over(so_far))
    return both.withColumn("hold", F.col("_p") / F.first("_p", ignorenulls=True).over(so_far)).drop("_p")


def backtest_statistics(events: DataFrame, panel: DataFrame, cal: DataFrame, hold: int = 21, lag: int = 1, cost_bps: float = 5.0, price: str = "adjclose", hedge: str | None = None) -> DataFrame:
    """Total, yearly growth, Sharpe ratio (population), worst drawdown, share of winning trades, mean positions on invested days, share of days invested.

    A trade wins if its return after both costs is above zero; one entered at a price of zero
    is not judged. Without trades ``win`` is null and ``avg_positions`` 0.
    """
    held = cut(holdings(events, panel, [(hold, lag)], price, hedge))  # read for the equity and for the trades
    open_day = F.col("positions") > 0
    out = equities(held, cal, [(hold, lag)], cost_bps).agg(
        F.count("*").alias("days"), (F.max_by("equity", "t") - 1).alias("total"), F.avg("ret").alias("_m"), F.stddev_pop("ret").alias("_s"), F.least(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"),
        F.coalesce(F.avg(F.when(open_day, F.col("positions"))), F.lit(0.0)).alias("avg_positions"), F.avg(open_day.cast("double")).alias("invested"),
    )
    won = trade_returns(held, cost_bps).agg(F.count("*").alias("trades"), F.avg((F.col("ret") > 0).cast("double")).alias("win"))
    growth = F.pow(1 + F.col("total"), 252.0 / F.col("days")) - 1
    both = out.join(F.broadcast(won))  # a row each
    return both.withColumn("cagr", growth).withColumn("sharpe", F.col("_m") / F.when(F.col("_s") > 0, F.col("_s")) * F.sqrt(F.lit(252.0))).drop("_m", "_s")
