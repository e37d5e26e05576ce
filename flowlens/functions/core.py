"""Column helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.window import WindowSpec


def sessions(part: str | list[str], lo: int, hi: int, order: str = "t") -> WindowSpec:
    """Frame of sessions lo..hi around a row: whole-number arithmetic on the session ordinal, gaps included."""
    return W.partitionBy(*([part] if isinstance(part, str) else part)).orderBy(order).rangeBetween(lo, hi)


def at_session(x: Column | str, h: int, part: str | list[str]) -> Column:
    """The value exactly h sessions later (or -h earlier); null if that session has none."""
    return F.first(x).over(sessions(part, h, h))


def ratio(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return a / F.when(b != 0, b)


def clip01(x: Column) -> Column:
    """To [0, 1]; null stays null (greatest and least would pass nulls over)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def r6(x: Column | str) -> Column:
    """Six decimals, for results; -0.0 becomes 0.0."""
    return F.round(x, 6) + F.lit(0.0)
