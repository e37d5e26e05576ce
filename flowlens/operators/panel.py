"""The long panel (symbol, t, d, measures): calendar, grid, ratios, moving averages, returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowlens.functions.core import at_session, clip01, ratio, sessions


def calendar(days: DataFrame) -> DataFrame:
    """Session ordinals: ``t`` = 0, 1, ... over the distinct days ``d``. A row per day, so one ordered partition is small."""
    return days.select("d").distinct().withColumn("t", (F.row_number().over(W.orderBy("d")) - 1).cast("int"))


def with_sessions(facts: DataFrame, cal: DataFrame) -> DataFrame:
    """Facts dated ``d`` on sessions only; other days are dropped by the join."""
    return facts.join(cal, "d")


def grid(panel: DataFrame, cal: DataFrame) -> DataFrame:
    """Calendar-driven alignment: every symbol on every session, measures null where there is no row."""
    last = cal.agg(F.max("t")).scalar()
    dense = panel.select("symbol").distinct().withColumn("_last", last).select("symbol", F.explode(F.sequence(F.lit(0), "_last")).alias("t")).join(cal, "t")
    return dense.join(panel.drop("d"), ["symbol", "t"], "left")


def dpi(short: str = "short", total: str = "total") -> Column:
    """Short share of off-exchange volume, zero totals null, clipped to [0, 1]."""
    return clip01(ratio(short, total))


def moving_average(panel: DataFrame, value: str, out: str, width: int = 5, part: str | list[str] = "symbol", least: int = 1) -> DataFrame:
    """Mean of the last ``width`` sessions with at least ``least`` values. On a grid it also exists on days without a value."""
    frame = sessions(part, -(width - 1), 0)
    return panel.withColumn(out, F.when(F.count(value).over(frame) >= least, F.avg(value).over(frame)))


def forward_return(panel: DataFrame, h: int, out: str, price: str = "adjclose", part: str | list[str] = "symbol") -> DataFrame:
    """price(t + h) / price(t) - 1 over exactly h sessions; a self-join is not needed."""
    return panel.withColumn(out, ratio(at_session(price, h, part), price) - 1)


def excess(panel: DataFrame, value: str, bench: str, out: str) -> DataFrame:
    """``value`` less the benchmark symbol's on the same session; sessions where the benchmark has none go."""
    base = panel.filter((F.col("symbol") == bench) & F.col(value).isNotNull()).select("t", F.col(value).alias("_base"))
    return panel.filter(F.col("symbol") != bench).join(base, "t").withColumn(out, F.col(value) - F.col("_base")).drop("_base")


def zscore(panel: DataFrame, value: str, out: str, part: str = "symbol") -> DataFrame:
    """Per-symbol z-score with the population deviation; deviations up to 1e-9 count as 1, under two values nothing changes."""
    own = W.partitionBy(part)
    std = F.stddev_pop(value).over(own)
    z = (F.col(value) - F.avg(value).over(own)) / F.when(std <= 1e-9, 1.0).otherwise(std)
    return panel.withColumn(out, F.when(F.count(value).over(own) < 2, F.col(value)).otherwise(z))


def daily_change(panel: DataFrame, price: str = "adjclose", part: str = "symbol") -> DataFrame:
    """``chg`` and ``logret`` against the session before; no padding over gaps."""
    before = at_session(price, -1, part)
    return panel.withColumn("chg", ratio(F.col(price), before) - 1).withColumn("logret", F.log(ratio(F.col(price), before)))


def realised_vol(panel: DataFrame, h: int, out: str, part: str = "symbol") -> DataFrame:
    """Annualised, in percent, of the next h sessions' log returns; all of them must exist. Needs ``logret``."""
    frame = sessions(part, 1, h)
    squares = F.sum(F.col("logret") * F.col("logret")).over(frame)
    return panel.withColumn(out, F.when(F.count("logret").over(frame) == h, F.sqrt(252.0 / h * squares) * 100))


def last_sessions(panel: DataFrame, n: int, part: str | None = None) -> DataFrame:
    """The last n sessions of the panel."""
    over = W.partitionBy(part) if part else None
    last = F.max("t").over(over) if over else panel.agg(F.max("t")).scalar()
    return panel.withColumn("_last", last).filter(F.col("t") > F.col("_last") - n).drop("_last")


def since(panel: DataFrame, start: str, day: str = "d") -> DataFrame:
    """Rows from a day on."""
    return panel.filter(F.col(day) >= F.lit(start).cast("date"))


def universe(panel: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of the members only. ``members`` has ``symbol``."""
    return panel.join(members.select("symbol").distinct(), "symbol", "left_semi")


def latest(panel: DataFrame, value: str, out: str = "latest", part: str = "symbol") -> DataFrame:
    """Last valid value per symbol."""
    return panel.groupBy(part).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("t"))).alias(out))


def thin_weekly(panel: DataFrame, keep: DataFrame, step: int = 5, over: int = 378) -> DataFrame:
    """Every ``step``-th kept session counted back from the last one, if more than ``over`` are kept. ``keep`` has ``t``."""
    days = keep.select("t").distinct()
    back = F.row_number().over(W.orderBy(F.desc("t"))) - 1  # sessions, not facts
    numbered = days.withColumn("back", back).withColumn("n", F.count("*").over(W.partitionBy()))
    return panel.join(numbered.filter((F.col("n") <= over) | (F.col("back") % step == 0)).select("t"), "t")


def drop_empty(panel: DataFrame, value: str, part: str = "symbol") -> DataFrame:
    """Symbols without any value go."""
    return panel.withColumn("_n", F.count(value).over(W.partitionBy(part))).filter("_n > 0").drop("_n")


def search(panel: DataFrame, query: str) -> DataFrame:
    """Symbols that contain the query, both in upper case and the query trimmed."""
    return panel.filter(F.upper("symbol").contains(query.strip().upper()))


def normal_symbol(x: Column | str) -> Column:
    """Key across sources: trimmed, upper case, dots as dashes."""
    return F.replace(F.upper(F.trim(x)), F.lit("."), F.lit("-"))


def prefer(panel: DataFrame, first: str, second: str, out: str, part: str = "symbol") -> DataFrame:
    """``first``, or ``second`` for symbols that have no ``first`` at all; ``fallback`` tells which."""
    none = F.count(first).over(W.partitionBy(part)) == 0
    return panel.withColumn("fallback", none).withColumn(out, F.when(none, F.col(second)).otherwise(F.col(first)))
