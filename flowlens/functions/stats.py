"""Student's t: two-sided p-values as a column, and Welch's test from aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the continued fraction. Its error falls with a power of terms / sqrt(df): below 1e-10 for df up to 1e5.
TERMS = 400


def log_gamma(z: Column, shift: int = 8) -> Column:
    """ln of the gamma function of z > 0: Stirling's series at z + ``shift``, less the factors between."""
    far = z + shift
    series = 1 / (12 * far) - 1 / (360 * far**3) + 1 / (1260 * far**5) - 1 / (1680 * far**7)
    between = z
    for k in range(1, shift):
        between = between * (z + k)
    return (far - 0.5) * F.log(far) - far + 0.5 * math.log(2 * math.pi) + series - F.log(between)


def beta_fraction(a: Column, b: Column, x: Column, terms: int = TERMS) -> Column:
    """The continued fraction of the incomplete beta function, folded from its last term to its first."""

    def term(acc: Column, k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return 1 + F.when(k % 2 == 0, even).otherwise(odd) / acc

    return 1 / F.aggregate(F.sequence(F.lit(terms), F.lit(1)), F.lit(1.0), term)


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """I_x(a, b), regularised; of x and 1 - x the one is taken at which the fraction converges fast."""
    turn = x > (a + 1) / (a + b + 2)
    p, q, y = F.when(turn, b).otherwise(a), F.when(turn, a).otherwise(b), F.when(turn, 1 - x).otherwise(x)
    front = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.log(y) + q * F.log(1 - y)) / p
    part = F.when(y <= 0, 0.0).otherwise(front * beta_fraction(p, q, y))
    return F.when(turn, 1 - part).otherwise(part)


def p_value(t: Column | str, df: Column | str) -> Column:
    """Two-sided p of Student's t; null where t is null or NaN or there is no degree of freedom. Meant for aggregated rows."""
    t, df = (F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in (t, df))
    p = incomplete_beta(df / 2, F.lit(0.5), df / (df + t * t))
    return F.when((df > 0) & t.isNotNull() & ~F.isnan(t) & ~F.isnan(df), F.when(t == 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))))


def p_of_correlation(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation over n pairs; 0 for a perfect one, null under 3 pairs."""
    return F.when((n > 2) & r.isNotNull() & ~F.isnan(r), F.when(F.abs(r) >= 1, 0.0).otherwise(p_value(r * F.sqrt((n - 2) / F.when(r * r < 1, 1 - r * r)), n - 2)))


#: SQL macro with the same rules; DuckDB has ln of the gamma function itself.
P_SQL = """
, tb AS (SELECT *, df / 2 AS a0, df / (df + t * t) AS x0 FROM tt),
tc AS (SELECT *, x0 > (a0 + 1) / (a0 + 2.5) AS turn FROM tb),
td AS (SELECT *, CASE WHEN turn THEN 0.5 ELSE a0 END AS pa, CASE WHEN turn THEN a0 ELSE 0.5 END AS pb, CASE WHEN turn THEN 1 - x0 ELSE x0 END AS px FROM tc),
te AS (SELECT *, CASE WHEN px <= 0 THEN 0 ELSE exp(lgamma(pa + pb) - lgamma(pa) - lgamma(pb) + pa * ln(px) + pb * ln(1 - px)) / pa / list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(400, 0, -1), lambda i: i::DOUBLE)),
  lambda acc, k: 1 + CASE WHEN k % 2 = 0 THEN (k / 2) * (pb - k / 2) * px / ((pa + k - 1) * (pa + k)) ELSE -(pa + (k - 1) / 2) * (pa + pb + (k - 1) / 2) * px / ((pa + k - 1) * (pa + k)) END / acc) END AS part FROM td),
tp AS (SELECT *, CASE WHEN df > 0 THEN CASE WHEN t = 0 THEN 1.0 ELSE least(1.0, greatest(0.0, CASE WHEN turn THEN 1 - part ELSE part END)) END END AS p FROM te)
"""


def welch(x: Column, first: Column, second: Column) -> list[Column]:
    """Aggregates of ``x`` over two conditions: n, mean and sample variance of each."""
    out = []
    for name, cond in (("1", first), ("2", second)):
        v = F.when(cond, x)
        out += [F.count(v).alias(f"n{name}"), F.avg(v).alias(f"m{name}"), F.var_samp(v).alias(f"v{name}")]
    return out


def welch_columns() -> dict[str, Column]:
    """``spread``, ``t_stat`` and ``df`` (Satterthwaite) from the columns of :func:`welch`; null under 3 values on a side."""
    a, b = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    good = (F.col("n1") >= 3) & (F.col("n2") >= 3) & (a + b > 0)
    df = (a + b) * (a + b) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1))
    return {"spread": F.when(good, F.col("m1") - F.col("m2")), "t_stat": F.when(good, (F.col("m1") - F.col("m2")) / F.sqrt(a + b)), "df": F.when(good, df)}
