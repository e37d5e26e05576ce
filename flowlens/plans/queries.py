"""Every query: a Spark plan over the driver's tables, and its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.core import r6
from flowlens.operators import identity as D
from flowlens.operators import index as I
from flowlens.operators import panel as P
from flowlens.operators import relation as R
from flowlens.operators import resample as B
from flowlens.operators import streaks as S
from flowlens.plans import adapter as A
from flowlens.plans.adapter import BENCH, DIX_SQL, MEMBER_SQL, SQL, fwd

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query and its SQL twin."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, d: f(A.Source(spark), d)
        if sql:
            ORACLES[name] = sql
        return f

    return add


def dix(spark: SparkSession, d: str) -> DataFrame:
    return I.dollar_dix(A.panel(spark, d), A.days(spark, d), exclude=BENCH, min_names=5)


# ---------------------------------------------------------------- panel


@query("panel_dpi", SQL + "SELECT symbol, t, d, short, total, round(dpi, 6) + 0.0 AS dpi FROM grid0")
def panel_dpi(spark, d):
    return P.grid(A.panel(spark, d), A.days(spark, d)).select("symbol", "t", "d", "short", "total", r6("dpi").alias("dpi"))


@query("dma5", SQL + "SELECT symbol, t, round(dd, 6) + 0.0 AS dd FROM grid WHERE dd IS NOT NULL")
def dma5(spark, d):
    return A.grid(spark, d).filter("dd is not null").select("symbol", "t", r6("dd").alias("dd"))


@query("dix_daily", SQL + DIX_SQL + "SELECT t, d, n, round(dix, 6) + 0.0 AS dix FROM dix")
def dix_daily(spark, d):
    return dix(spark, d).select("t", "d", "n", r6("dix").alias("dix"))


@query("agg_share", SQL + "SELECT t, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(sum(total) / nullif(sum(volume), 0), 6) + 0.0 END AS share FROM panel WHERE symbol <> 'Brand#1' GROUP BY t")
def agg_share(spark, d):
    return I.aggregate_share(A.panel(spark, d), BENCH, 5).select("t", "n", r6("share").alias("share"))


@query("eq_mean", SQL + "SELECT t, count(dpi) AS n, CASE WHEN count(dpi) >= 5 THEN round(avg(dpi), 6) + 0.0 END AS mean_dpi FROM panel GROUP BY t")
def eq_mean(spark, d):
    return I.equal_mean(A.panel(spark, d), 5).select("t", "n", r6("mean_dpi").alias("mean_dpi"))


@query("fwd_returns", SQL + f"SELECT symbol, t, round({fwd(1)}, 6) + 0.0 AS r1, round({fwd(5)}, 6) + 0.0 AS r5, round({fwd(21)}, 6) + 0.0 AS r21 FROM panel")
def fwd_returns(spark, d):
    df = A.panel(spark, d)
    for h in (1, 5, 21):
        df = P.forward_return(df, h, f"r{h}")
    return df.select("symbol", "t", *(r6(f"r{h}").alias(f"r{h}") for h in (1, 5, 21)))


@query("excess_returns", SQL + f", f AS (SELECT symbol, t, {fwd(21)} AS r FROM panel) SELECT a.symbol, a.t, round(a.r - b.r, 6) + 0.0 AS ex FROM f a JOIN f b ON a.t = b.t AND b.symbol = 'Brand#1' AND b.r IS NOT NULL WHERE a.symbol <> 'Brand#1' AND a.r IS NOT NULL")
def excess_returns(spark, d):
    df = P.forward_return(A.panel(spark, d), 21, "r")
    return P.excess(df, "r", BENCH, "ex").filter("ex is not null").select("symbol", "t", r6("ex").alias("ex"))


@query("zscore_dpi", SQL + "SELECT symbol, t, round(CASE WHEN count(dpi) OVER w < 2 THEN dpi ELSE (dpi - avg(dpi) OVER w) / CASE WHEN stddev_pop(dpi) OVER w <= 1e-9 THEN 1 ELSE stddev_pop(dpi) OVER w END END, 6) + 0.0 AS z FROM panel WINDOW w AS (PARTITION BY symbol)")
def zscore_dpi(spark, d):
    return P.zscore(A.panel(spark, d), "dpi", "z").select("symbol", "t", r6("z").alias("z"))


@query("weekly_thin", SQL + ", k AS (SELECT t, row_number() OVER (ORDER BY t DESC) - 1 AS back, count(*) OVER () AS n FROM cal) SELECT symbol, t, round(dpi, 6) + 0.0 AS dpi FROM panel JOIN k USING (t) WHERE n <= 378 OR back % 5 = 0")
def weekly_thin(spark, d):
    return P.thin_weekly(A.panel(spark, d), A.days(spark, d)).select("symbol", "t", r6("dpi").alias("dpi"))


@query("quality_sync", SQL + ", e AS (SELECT symbol, max(t) FILTER (dpi IS NOT NULL) AS last FROM panel GROUP BY symbol), m AS (SELECT max(last) AS f FROM e) SELECT count(*) AS symbols, count(*) FILTER (coalesce(last < f, true)) AS behind, count(*) FILTER (coalesce(last < f, true)) <= greatest(3.0, 0.05 * count(*)) AS complete FROM e, m")
def quality_sync(spark, d):
    return D.completeness(A.panel(spark, d), "dpi")


# ---------------------------------------------------------------- index


@query(
    "contributors_top",
    SQL
    + """, own AS (SELECT *, max(t) OVER () AS last FROM panel WHERE symbol <> 'Brand#1'),
m AS (SELECT symbol, avg(close * short) AS s, avg(close * total) AS dt, max(last) AS as_of FROM own WHERE t > last - 25 GROUP BY symbol),
w AS (SELECT p_brand AS symbol, CAST(sum(CAST(p_retailprice AS DECIMAL(18, 2))) AS DOUBLE) AS w FROM part GROUP BY ALL),
x AS (SELECT symbol, w / sum(w) OVER () * 100 AS weight FROM w),
a AS (SELECT m.*, sum(dt) OVER () AS alld, count(*) OVER () AS n FROM m)
SELECT symbol, as_of, round(s / alld, 6) + 0.0 AS contribution, round(dt / alld, 6) + 0.0 AS dollar_weight, CASE WHEN dt <> 0 THEN round(greatest(0.0, least(1.0, s / dt)), 6) + 0.0 END AS dpi,
  round(weight, 6) + 0.0 AS index_weight, CAST(row_number() OVER (ORDER BY s / alld DESC, symbol) AS INTEGER) AS rank
FROM a LEFT JOIN x USING (symbol) WHERE n >= 5 AND alld > 0 QUALIFY rank <= 10""",
)
def contributors_top(spark, d):
    out = I.contributors(A.panel(spark, d), A.weights(spark, d), top=10, min_names=5, exclude=BENCH)
    return out.select("symbol", "as_of", *(r6(c).alias(c) for c in ("contribution", "dollar_weight", "dpi", "index_weight")), "rank")


RESIDUAL_SQL = (
    SQL
    + DIX_SQL
    + """, bench AS (SELECT t, avg(dix) OVER (ORDER BY t RANGE BETWEEN 4 PRECEDING AND CURRENT ROW) AS b FROM dix),
j AS (SELECT symbol, t, dd AS x, b FROM grid LEFT JOIN bench USING (t)),
st AS (SELECT symbol, t, x, b,
  CASE WHEN count(CASE WHEN x IS NOT NULL AND b IS NOT NULL THEN 1 END) OVER w >= 40 THEN covar_samp(x, b) OVER w END AS cv,
  CASE WHEN count(b) OVER w >= 40 THEN var_samp(b) OVER w END AS vb, CASE WHEN count(b) OVER w >= 40 THEN avg(b) OVER w END AS mb, CASE WHEN count(x) OVER w >= 40 THEN avg(x) OVER w END AS mx
  FROM j WINDOW w AS (PARTITION BY symbol ORDER BY t RANGE BETWEEN 125 PRECEDING AND CURRENT ROW)),
res AS (SELECT symbol, t, x - b AS diff, x - (mx - cv / nullif(vb, 0) * mb + cv / nullif(vb, 0) * b) AS reg FROM st)
"""
)


def bench(spark, d):
    from flowlens.functions.core import sessions

    own = dix(spark, d).withColumn("_u", F.lit(0))
    return own.select("t", F.avg("dix").over(sessions("_u", -4, 0)).alias("b"))


@query("residual_diff", RESIDUAL_SQL + "SELECT symbol, t, round(diff, 6) + 0.0 AS diff FROM res WHERE diff IS NOT NULL")
def residual_diff(spark, d):
    return I.residuals(A.grid(spark, d), bench(spark, d)).filter("diff is not null").select("symbol", "t", r6("diff").alias("diff"))


@query("residual_reg", RESIDUAL_SQL + "SELECT symbol, t, round(reg, 6) + 0.0 AS reg FROM res WHERE reg IS NOT NULL")
def residual_reg(spark, d):
    return I.residuals(A.grid(spark, d), bench(spark, d)).filter("reg is not null").select("symbol", "t", r6("reg").alias("reg"))


@query(
    "divergence_order",
    RESIDUAL_SQL
    + """, l AS (SELECT symbol, round(arg_max(diff, t) FILTER (diff IS NOT NULL), 6) + 0.0 AS latest FROM res GROUP BY symbol)
SELECT symbol, latest, CAST(row_number() OVER (ORDER BY CASE WHEN latest >= 0 THEN 0 WHEN latest < 0 THEN 1 ELSE 2 END, CASE WHEN latest >= 0 THEN -latest ELSE latest END, symbol) AS INTEGER) AS place FROM l""",
)
def divergence_order(spark, d):
    res = I.residuals(A.grid(spark, d), bench(spark, d))
    return I.divergence_order(P.latest(res, "diff").withColumn("latest", r6("latest")))


@query(
    "index_vs_fwd",
    SQL
    + DIX_SQL
    + f""", px AS (SELECT t, close FROM panel WHERE symbol = 'Brand#1'),
v AS (SELECT dix.t AS session, dix, close, CAST(row_number() OVER (ORDER BY dix.t) - 1 AS INTEGER) AS t, 0 AS u FROM dix LEFT JOIN px USING (t) WHERE dix IS NOT NULL)
SELECT session AS t, round(dix, 6) + 0.0 AS dix, round({fwd(21, price="close", part="u")}, 6) + 0.0 AS r21, round({fwd(42, price="close", part="u")}, 6) + 0.0 AS r42, round({fwd(63, price="close", part="u")}, 6) + 0.0 AS r63 FROM v""",
)
def index_vs_fwd(spark, d):
    px = A.panel(spark, d).filter(F.col("symbol") == BENCH).select("t", "close")
    out = I.index_table(dix(spark, d).join(px, "t", "left"), "dix", "close")
    return out.select("t", *(r6(c).alias(c) for c in ("dix", "r21", "r42", "r63")))


@query(
    "breadth_rel",
    SQL
    + """, w AS (SELECT t, max(close) FILTER (symbol = 'Brand#1') AS c0, max(close) FILTER (symbol = 'Brand#2') AS c1, max(close) FILTER (symbol = 'Brand#3') AS c2 FROM panel GROUP BY t),
k AS (SELECT * FROM w WHERE c0 IS NOT NULL AND c1 IS NOT NULL AND c2 IS NOT NULL),
b AS (SELECT t, c0 / first(c0) OVER o AS x0, c1 / first(c1) OVER o AS x1, c2 / first(c2) OVER o AS x2, count(*) OVER () AS n FROM k WINDOW o AS (ORDER BY t ROWS UNBOUNDED PRECEDING))
SELECT t, round(x1 / x0 * 100, 6) + 0.0 AS a_rel, round(x2 / x0 * 100, 6) + 0.0 AS b_rel, round((x1 / x0 * 100 + x2 / x0 * 100) / 2, 6) + 0.0 AS gauge FROM b WHERE n >= 5""",
)
def breadth_rel(spark, d):
    out = I.breadth(A.panel(spark, d).select("symbol", "t", "close"), BENCH, ("Brand#2", "Brand#3"))
    return out.select("t", *(r6(c).alias(c) for c in ("a_rel", "b_rel", "gauge")))


@query(
    "series_compare",
    SQL
    + DIX_SQL
    + """, eq AS (SELECT t, CASE WHEN count(dpi) >= 5 THEN avg(dpi) END AS y FROM panel GROUP BY t),
b AS (SELECT t, dix AS x, y FROM dix JOIN eq USING (t) WHERE dix IS NOT NULL AND y IS NOT NULL),
e AS (SELECT *, x - lag(x) OVER (ORDER BY t) AS dx, y - lag(y) OVER (ORDER BY t) AS dy FROM b)
SELECT count(*) AS n, round(corr(x, y), 6) + 0.0 AS level_corr, round(corr(dx, dy), 6) + 0.0 AS change_corr, round(avg(x - y) * 100, 6) + 0.0 AS "offset", round(avg(abs(x - y)) * 100, 6) + 0.0 AS abs_diff FROM e HAVING count(*) >= 30""",
)
def series_compare(spark, d):
    out = I.compare_series(dix(spark, d).select("t", F.col("dix").alias("v")), I.equal_mean(A.panel(spark, d), 5).select("t", F.col("mean_dpi").alias("v")))
    return out.select("n", *(r6(c).alias(c) for c in ("level_corr", "change_corr", "offset", "abs_diff")))


SECTOR_SQL = (
    SQL
    + MEMBER_SQL
    + """, fs AS (SELECT fund, t, sum(close * short) AS s, sum(close * total) AS dd_, count(*) AS n FROM panel JOIN membership USING (symbol) GROUP BY ALL),
fd AS (SELECT f.fund, cal.t, s, dd_, coalesce(n, 0) AS n FROM (SELECT DISTINCT fund FROM fs) f CROSS JOIN cal LEFT JOIN fs USING (fund, t)),
fu AS (SELECT *, CASE WHEN count(*) OVER w >= 10 THEN list_aggregate(list(n) OVER w, 'quantile_cont', 0.5) ELSE 0 END AS u FROM fd WINDOW w AS (PARTITION BY fund ORDER BY t RANGE BETWEEN 62 PRECEDING AND CURRENT ROW)),
fx AS (SELECT fund, t, n, CASE WHEN n >= 3 AND n >= 0.6 * u AND dd_ <> 0 THEN greatest(0.0, least(1.0, s / nullif(dd_, 0))) END AS dix FROM fu),
lv AS (SELECT *, avg(dix) OVER (PARTITION BY fund ORDER BY t RANGE BETWEEN 4 PRECEDING AND CURRENT ROW) AS level FROM fx)
"""
)
BANDS_SQL = (
    SECTOR_SQL
    + """, va AS (SELECT fund, t, round(level, 9) AS level, CASE WHEN count(*) OVER w >= 63 THEN round(list_aggregate(list(level) OVER w, 'quantile_cont', 0.8), 9) END AS upper,
  CASE WHEN count(*) OVER w >= 63 THEN round(list_aggregate(list(level) OVER w, 'quantile_cont', 0.2), 9) END AS lower FROM lv WHERE level IS NOT NULL WINDOW w AS (PARTITION BY fund ORDER BY t ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)),
cr AS (SELECT *, coalesce(level >= upper AND NOT (lag(level) OVER o >= lag(upper) OVER o), false) AS cross_up, coalesce(level <= lower AND NOT (lag(level) OVER o <= lag(lower) OVER o), false) AS cross_down FROM va WINDOW o AS (PARTITION BY fund ORDER BY t))
"""
)


def levels(spark, d):
    return I.sector_levels(A.panel(spark, d), A.membership(spark, d), A.days(spark, d), min_names=3)


@query(
    "sector_dix",
    SECTOR_SQL
    + """, v AS (SELECT fund, t, round(level, 9) AS level, row_number() OVER (PARTITION BY fund ORDER BY t DESC) AS back, first(round(level, 9)) OVER (PARTITION BY fund ORDER BY t DESC) AS now FROM lv WHERE level IS NOT NULL)
SELECT fund, max(t) AS t, round(max(now), 6) + 0.0 AS level, round(100 * avg(CASE WHEN back <= 252 THEN CAST(level < now AS DOUBLE) END)) AS percentile, CASE WHEN count(*) > 21 THEN round(max(CASE WHEN back = 21 THEN now - level END), 6) + 0.0 END AS change FROM v GROUP BY fund""",
)
def sector_dix(spark, d):
    return I.sector_summary(levels(spark, d)).select("fund", "t", r6("level").alias("level"), "percentile", r6("change").alias("change"))


@query("sector_bands", BANDS_SQL + "SELECT fund, t, round(level, 6) + 0.0 AS level, round(upper, 6) + 0.0 AS upper, round(lower, 6) + 0.0 AS lower FROM cr")
def sector_bands(spark, d):
    return I.sector_bands(levels(spark, d)).select("fund", "t", *(r6(c).alias(c) for c in ("level", "upper", "lower")))


@query("sector_cross", BANDS_SQL + "SELECT fund, max(t) AS t, arg_max(CASE WHEN cross_up THEN 'up' ELSE 'down' END, t) AS direction, count(*) AS crossings FROM cr WHERE cross_up OR cross_down GROUP BY fund")
def sector_cross(spark, d):
    return I.last_crossing(I.sector_bands(levels(spark, d)))


@query("sector_crossings", BANDS_SQL + "SELECT fund, t, CASE WHEN cross_up THEN 'up' ELSE 'down' END AS direction FROM cr WHERE (cross_up OR cross_down) AND t > (SELECT max(t) FROM cal) - 378")
def sector_crossings(spark, d):
    return I.crossings(I.sector_bands(levels(spark, d)), P.last_sessions(A.days(spark, d), 378))


# ---------------------------------------------------------------- relation

POINTS_SQL = SQL + f", f AS (SELECT symbol, t, dd, {fwd(21, 'grid')} AS y FROM grid), pts AS (SELECT symbol, t, round(dd, 9) AS x, y FROM f WHERE dd IS NOT NULL AND y IS NOT NULL)"


def points(spark, d):
    df = P.forward_return(A.grid(spark, d), 21, "y").withColumn("x", F.round("dd", 9))
    return R.points(df, "x", "y")


STATS_SQL = "count(*) AS n, round(avg(x), 6) + 0.0 AS x_mean, round(avg(y), 6) + 0.0 AS y_mean, round(median(y), 6) + 0.0 AS y_median, round(stddev_pop(y), 6) + 0.0 AS y_std, round(min(x), 6) + 0.0 AS x_lo, round(max(x), 6) + 0.0 AS x_hi"


@query("deciles_pooled", POINTS_SQL + f", b AS (SELECT *, CAST(floor((10 * row_number() OVER (ORDER BY x, symbol, t) - 1) / count(*) OVER ()) + 1 AS INTEGER) AS bucket FROM pts) SELECT bucket, {STATS_SQL} FROM b GROUP BY bucket")
def deciles_pooled(spark, d):
    return R.deciles(points(spark, d)).select("bucket", "n", *(r6(c).alias(c) for c in ("x_mean", "y_mean", "y_median", "y_std", "x_lo", "x_hi")))


@query(
    "decile_table",
    POINTS_SQL
    + """, c AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM pts),
b AS (SELECT *, CAST(floor((10 * row_number() OVER (PARTITION BY symbol ORDER BY x, t) - 1) / n) + 1 AS INTEGER) AS bucket FROM c WHERE n >= 30),
l AS (SELECT symbol, round(arg_max(dd, t) FILTER (dd IS NOT NULL), 9) AS latest FROM grid GROUP BY symbol),
s AS (SELECT symbol, bucket, count(*) AS n, avg(y) AS y_mean, stddev_pop(y) AS sd, min(x) AS lo, max(x) AS hi FROM b GROUP BY ALL),
m AS (SELECT s.*, coalesce(min(CASE WHEN latest >= lo AND latest <= hi THEN bucket END) OVER (PARTITION BY symbol), CASE WHEN latest > max(CASE WHEN bucket = 10 THEN hi END) OVER (PARTITION BY symbol) THEN 10 WHEN latest IS NOT NULL THEN 1 END) AS now FROM s LEFT JOIN l USING (symbol))
SELECT symbol, bucket, n, round(y_mean, 6) + 0.0 AS y_mean, round(sd / sqrt(greatest(1.0, n / 21)), 6) + 0.0 AS se, coalesce(now = bucket, false) AS current FROM m""",
)
def decile_table(spark, d):
    latest = P.latest(A.grid(spark, d), "dd").withColumn("latest", F.round("latest", 9))
    out = R.decile_table(points(spark, d), latest)
    return out.select("symbol", "bucket", "n", r6("y_mean").alias("y_mean"), r6("se").alias("se"), "current")


@query(
    "corr_by_symbol",
    POINTS_SQL
    + """, k AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY x) + (count(*) OVER (PARTITION BY symbol, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY symbol ORDER BY y) + (count(*) OVER (PARTITION BY symbol, y) - 1) / 2 AS ry FROM pts)
SELECT symbol, count(*) AS n, CASE WHEN count(*) >= 5 AND stddev_pop(x) > 1e-12 AND stddev_pop(y) > 1e-12 THEN round(corr(x, y), 6) + 0.0 END AS pearson,
  CASE WHEN count(*) >= 5 AND stddev_pop(rx) > 1e-12 AND stddev_pop(ry) > 1e-12 THEN round(corr(rx, ry), 6) + 0.0 END AS spearman FROM k GROUP BY symbol""",
)
def corr_by_symbol(spark, d):
    return R.correlations(points(spark, d)).select("symbol", "n", r6("pearson").alias("pearson"), r6("spearman").alias("spearman"))


@query("ols_trend", POINTS_SQL + " SELECT symbol, round(regr_slope(y, x), 6) + 0.0 AS slope, round(regr_intercept(y, x), 6) + 0.0 AS intercept, round(min(x), 6) + 0.0 AS x_lo, round(max(x), 6) + 0.0 AS x_hi, count(*) AS n FROM pts GROUP BY symbol")
def ols_trend(spark, d):
    return R.trend(points(spark, d), ["symbol"]).select("symbol", *(r6(c).alias(c) for c in ("slope", "intercept", "x_lo", "x_hi")), "n")


@query(
    "dist_stats",
    POINTS_SQL
    + """, m AS (SELECT *, median(y) OVER (PARTITION BY symbol) AS med FROM pts)
SELECT symbol, count(*) AS n, round(avg(y), 6) + 0.0 AS mean, round(median(y), 6) + 0.0 AS median, round(stddev_pop(y), 6) + 0.0 AS std_pop, round(stddev_samp(y), 6) + 0.0 AS std_samp,
  round(median(abs(y - med)), 6) + 0.0 AS mad, round(avg(CAST(y > 0 AS DOUBLE)), 6) + 0.0 AS hit, CASE WHEN median(abs(y - med)) > 0 THEN round(avg(y) / median(abs(y - med)), 6) + 0.0 END AS mean_over_mad FROM m GROUP BY symbol""",
)
def dist_stats(spark, d):
    out = R.spread_statistics(points(spark, d), ["symbol"], "y")
    return out.select("symbol", "n", *(r6(c).alias(c) for c in ("mean", "median", "std_pop", "std_samp", "mad", "hit", "mean_over_mad")))


@query(
    "histogram",
    POINTS_SQL
    + """, q AS (SELECT round(y, 9) AS v, row_number() OVER (ORDER BY round(y, 9)) - 1 AS i, count(*) OVER () AS n FROM pts),
e0 AS (SELECT max(CASE WHEN i = floor((n - 1) * 0.01) THEN v END) AS p1, max(CASE WHEN i = floor((n - 1) * 0.99) THEN v END) AS p99, avg(v) AS m FROM q),
e1 AS (SELECT least(p1, m, 0.0) AS lo, greatest(p99, m, 0.0) AS hi FROM e0), e AS (SELECT lo, CASE WHEN hi <= lo THEN lo + 1 ELSE hi END AS hi FROM e1)
SELECT CAST(greatest(0, least(25, floor((v - lo) / ((hi - lo) / 26)))) AS INTEGER) AS bin, count(*) AS n FROM q, e GROUP BY ALL""",
)
def histogram(spark, d):
    return R.histogram(points(spark, d).withColumn("y", F.round("y", 9)), "y")


XS_SQL = (
    SQL
    + f""", f AS (SELECT symbol, t, dd, {fwd(21, 'grid')} AS fwd, avg(dd) OVER w AS em, count(dd) OVER w AS seen FROM grid WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING)),
s AS (SELECT f.symbol, t, round(dd - em, 9) AS signal, f.fwd - b.fwd AS fwd FROM f JOIN (SELECT t, fwd FROM f WHERE symbol = 'Brand#1' AND fwd IS NOT NULL) b USING (t) WHERE symbol <> 'Brand#1' AND dd IS NOT NULL AND f.fwd IS NOT NULL AND seen >= 20),
n AS (SELECT *, count(*) OVER (PARTITION BY t) AS n FROM s),
b AS (SELECT *, CAST(floor((5 * row_number() OVER (PARTITION BY t ORDER BY signal, symbol) - 1) / n) + 1 AS INTEGER) AS bucket FROM n WHERE n >= 5)
"""
)


def slices(spark, d):
    return R.cross_section(P.forward_return(A.grid(spark, d), 21, "fwd"), "dd", "fwd", BENCH, k=5, min_names=5)


@query("xs_deciles", XS_SQL + "SELECT bucket, count(*) AS n, round(avg(fwd), 6) + 0.0 AS mean FROM b GROUP BY bucket")
def xs_deciles(spark, d):
    return slices(spark, d).groupBy("bucket").agg(F.count("*").alias("n"), r6(F.avg("fwd")).alias("mean"))


@query(
    "xs_spread",
    XS_SQL
    + """, dy AS (SELECT t, avg(fwd) FILTER (bucket = 5) - avg(fwd) FILTER (bucket = 1) AS sp FROM b GROUP BY t),
a AS (SELECT count(*) AS days, avg(sp) AS mean, stddev_pop(sp) / sqrt(greatest(1.0, count(*) / 21)) AS se FROM dy WHERE sp IS NOT NULL)
SELECT days, round(mean, 6) + 0.0 AS mean, round(se, 6) + 0.0 AS se, CASE WHEN se > 0 THEN round(mean / se, 6) + 0.0 END AS t_stat, round(mean * 252 / 21, 6) + 0.0 AS annual FROM a""",
)
def xs_spread(spark, d):
    return R.cross_section_spread(slices(spark, d), k=5).select("days", *(r6(c).alias(c) for c in ("mean", "se", "t_stat", "annual")))


@query("expanding_signal", SQL + "SELECT symbol, t, round(avg(dd) OVER w, 6) + 0.0 AS expanding_mean, count(dd) OVER w AS seen FROM grid WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING)")
def expanding_signal(spark, d):
    return R.expanding(A.grid(spark, d), "dd").select("symbol", "t", r6("expanding_mean").alias("expanding_mean"), "seen")


# ---------------------------------------------------------------- streaks

STATE_SQL = (
    SQL
    + """, ov AS (SELECT symbol, t, round(dd, 9) AS v FROM grid WHERE dd IS NOT NULL AND symbol <> 'Brand#1'),
pa AS (SELECT symbol, t, v, list(v) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING) AS past FROM ov),
state AS (SELECT symbol, t, CASE WHEN len(past) >= 120 THEN CAST(greatest(1, ceil(10 * len(list_filter(past, lambda x: x <= v)) / len(past))) AS INTEGER) END AS decile FROM pa)
"""
)
EVENT_SQL = (
    STATE_SQL
    + """, hits AS (SELECT symbol, t, t - row_number() OVER (PARTITION BY symbol ORDER BY t) AS island FROM state WHERE decile BETWEEN 1 AND 3),
runs AS (SELECT *, row_number() OVER (PARTITION BY symbol, island ORDER BY t) AS k FROM hits), ev AS (SELECT symbol, t FROM runs WHERE k = 3)
"""
)
RET_SQL = f""", rl AS (SELECT symbol, t, h, CASE h WHEN 21 THEN r21 WHEN 42 THEN r42 ELSE r63 END AS ret FROM (SELECT symbol, t, {fwd(21)} AS r21, {fwd(42)} AS r42, {fwd(63)} AS r63 FROM panel), (VALUES (21), (42), (63)) v(h)),
ret AS (SELECT * FROM rl WHERE ret IS NOT NULL AND symbol <> 'Brand#1'), day AS (SELECT t, h, avg(ret) AS base FROM ret GROUP BY ALL)
"""
#: RET_SQL with returns in excess of the benchmark's on the same sessions.
EXCESS_SQL = RET_SQL.replace("ret AS (SELECT * FROM rl WHERE ret IS NOT NULL AND symbol <> 'Brand#1')", "ret AS (SELECT a.symbol, a.t, a.h, a.ret - b.ret AS ret FROM rl a JOIN rl b ON b.symbol = 'Brand#1' AND a.t = b.t AND a.h = b.h WHERE a.symbol <> 'Brand#1' AND a.ret IS NOT NULL AND b.ret IS NOT NULL)")
LO, HI, RUN = 1, 3, 3


def returns(spark, d, excess=False):
    return S.long_returns(A.panel(spark, d), bench=BENCH, excess=excess)


def states(spark, d):
    return S.trailing_decile(names(spark, d), "dd")


def events(spark, d):
    return S.streak_events(S.in_band(states(spark, d), LO, HI), RUN)


@query("trailing_decile", STATE_SQL + "SELECT symbol, t, decile FROM state")
def trailing_decile(spark, d):
    return states(spark, d)


FULL_SQL = SQL + ", ov AS (SELECT symbol, t, round(dd, 9) AS v FROM grid WHERE dd IS NOT NULL AND symbol <> 'Brand#1'), "


def names(spark, d):
    """The grid of the names: without the benchmark, which has no states."""
    return A.grid(spark, d).filter(F.col("symbol") != BENCH).withColumn("dd", F.round("dd", 9))



@query(
    "fullsample_decile",
    FULL_SQL
    + """s AS (SELECT symbol, list(v ORDER BY v) AS l FROM ov GROUP BY symbol HAVING count(*) >= 20)
SELECT symbol, t, CAST(1 + len(list_filter([1, 2, 3, 4, 5, 6, 7, 8, 9], lambda j: l[CAST(floor(len(l) * j / 10) AS BIGINT) + 1] < v)) AS INTEGER) AS decile FROM ov JOIN s USING (symbol)""",
)
def fullsample_decile(spark, d):
    return S.sample_decile(names(spark, d), "dd")


@query(
    "pooled_decile",
    FULL_SQL
    + """c AS (SELECT list(v ORDER BY v) AS l FROM ov HAVING count(*) >= 20)
SELECT symbol, t, CAST(1 + len(list_filter([1, 2, 3, 4, 5, 6, 7, 8, 9], lambda j: l[CAST(floor(len(l) * j / 10) AS BIGINT) + 1] < v)) AS INTEGER) AS decile FROM ov, c""",
)
def pooled_decile(spark, d):
    return S.pooled_decile(names(spark, d), "dd")


@query("streak_events", EVENT_SQL + "SELECT symbol, t FROM ev")
def streak_events(spark, d):
    return events(spark, d)


@query(
    "streak_status",
    EVENT_SQL
    + """, nw AS (SELECT symbol, max(t) AS last_t FROM state WHERE decile IS NOT NULL GROUP BY symbol), en AS (SELECT max(t) AS e FROM cal),
tp AS (SELECT symbol, max(t) AS tip, arg_max(k, t) AS k, max(CASE WHEN k = 3 THEN t END) AS last_event FROM runs GROUP BY symbol),
z AS (SELECT symbol, CAST(CASE WHEN tip = last_t AND last_t > e - 3 THEN k ELSE 0 END AS INTEGER) AS length, last_event FROM nw LEFT JOIN tp USING (symbol), en)
SELECT symbol, length, CASE WHEN length >= 3 THEN 'active' WHEN length = 2 THEN 'building' ELSE 'none' END AS status, last_event FROM z""",
)
def streak_status(spark, d):
    return S.streak_status(states(spark, d), A.days(spark, d), LO, HI, RUN)


@query("band_returns", EVENT_SQL + RET_SQL + "SELECT symbol, t, h, round(ret, 6) + 0.0 AS ret FROM ev JOIN ret USING (symbol, t)")
def band_returns(spark, d):
    return S.event_returns(events(spark, d), A.panel(spark, d)).select("symbol", "t", "h", r6("ret").alias("ret"))


MEANS = "count(*) AS n, round(avg(ret), 6) + 0.0 AS mean, round(avg(base), 6) + 0.0 AS base, round(avg(ret - base), 6) + 0.0 AS edge"


@query("matched_base", EVENT_SQL + RET_SQL + f"SELECT h, {MEANS} FROM ev JOIN ret USING (symbol, t) JOIN day USING (t, h) GROUP BY h")
def matched_base(spark, d):
    return S.matched_base(events(spark, d), returns(spark, d)).select("h", "n", *(r6(c).alias(c) for c in ("mean", "base", "edge")))


@query("regime_split", EVENT_SQL + RET_SQL + f", x AS (SELECT h, ret, base, unnest(['full', CASE WHEN d < DATE '1998-06-01' THEN 'before' ELSE 'after' END]) AS period FROM ev JOIN ret USING (symbol, t) JOIN day USING (t, h) JOIN cal USING (t)) SELECT period, h, {MEANS} FROM x GROUP BY ALL")
def regime_split(spark, d):
    out = S.regime_split(events(spark, d), returns(spark, d), A.days(spark, d), "1998-06-01")
    return out.select("period", "h", "n", *(r6(c).alias(c) for c in ("mean", "base", "edge")))


SWEEP_SQL = """, bands AS (SELECT a.i AS lo, b.i AS hi FROM range(1, 11) a(i), range(1, 11) b(i) WHERE a.i <= b.i),
hits AS (SELECT lo, hi, symbol, t, t - row_number() OVER (PARTITION BY lo, hi, symbol ORDER BY t) AS island FROM state JOIN bands ON decile BETWEEN lo AND hi),
ev AS (SELECT lo, hi, symbol, t FROM (SELECT *, row_number() OVER (PARTITION BY lo, hi, symbol, island ORDER BY t) AS k FROM hits) WHERE k = 3),
m AS (SELECT lo, hi, h, ret, median(ret) OVER (PARTITION BY lo, hi, h) AS med FROM ev JOIN ret USING (symbol, t))
SELECT CAST(lo AS INTEGER) AS lo, CAST(hi AS INTEGER) AS hi, h, count(*) AS n, round(avg(ret), 6) + 0.0 AS mean, round(max(med), 6) + 0.0 AS median, round(median(abs(ret - med)), 6) + 0.0 AS mad, round(stddev_pop(ret), 6) + 0.0 AS std FROM m GROUP BY ALL"""


@query("band_sweep", STATE_SQL + RET_SQL + SWEEP_SQL)
def band_sweep(spark, d):
    out = S.band_sweep(states(spark, d), returns(spark, d), RUN)
    return out.select("lo", "hi", "h", "n", *(r6(c).alias(c) for c in ("mean", "median", "mad", "std")))


@query("band_sweep_excess", STATE_SQL + EXCESS_SQL + SWEEP_SQL)
def band_sweep_excess(spark, d):
    out = S.band_sweep(states(spark, d), returns(spark, d, True), RUN)
    return out.select("lo", "hi", "h", "n", *(r6(c).alias(c) for c in ("mean", "median", "mad", "std")))


DRIFT_SQL = """, px AS (SELECT symbol, t, adjclose AS p FROM panel)
"""


@query("event_drift", EVENT_SQL + DRIFT_SQL + ", m AS (SELECT k.k, b.p / a.p - 1 AS v FROM ev JOIN px a USING (symbol, t), range(0, 64) k(k) JOIN px b ON b.symbol = ev.symbol AND b.t = ev.t + k.k) SELECT CAST(k AS INTEGER) AS k, count(*) AS n, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v) / sqrt(count(*)), 6) + 0.0 AS se FROM m GROUP BY k")
def event_drift(spark, d):
    return S.event_drift(events(spark, d), A.panel(spark, d)).select("k", "n", r6("mean").alias("mean"), r6("se").alias("se"))


@query("matched_drift", EVENT_SQL + DRIFT_SQL + ", dw AS (SELECT t, count(*) AS w FROM ev GROUP BY t), m AS (SELECT a.t, k.k, avg(b.p / a.p - 1) AS v, max(w) AS w FROM px a JOIN dw USING (t), range(0, 64) k(k) JOIN px b ON b.symbol = a.symbol AND b.t = a.t + k.k WHERE a.symbol <> 'Brand#1' GROUP BY ALL) SELECT CAST(k AS INTEGER) AS k, CAST(sum(w) AS BIGINT) AS n, round(sum(v * w) / sum(w), 6) + 0.0 AS mean FROM m GROUP BY k")
def matched_drift(spark, d):
    return S.matched_drift(events(spark, d), A.panel(spark, d), bench=BENCH).select("k", "n", r6("mean").alias("mean"))


PAIR_SQL = DRIFT_SQL + ", pb AS (SELECT a.symbol, a.t, a.p, b.p AS q FROM px a JOIN px b ON b.symbol = 'Brand#1' AND b.t = a.t)"


@query("event_drift_excess", EVENT_SQL + PAIR_SQL + ", m AS (SELECT k.k, b.p / a.p - b.q / a.q AS v FROM ev JOIN pb a USING (symbol, t), range(0, 64) k(k) JOIN pb b ON b.symbol = ev.symbol AND b.t = ev.t + k.k) SELECT CAST(k AS INTEGER) AS k, count(*) AS n, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v) / sqrt(count(*)), 6) + 0.0 AS se FROM m GROUP BY k")
def event_drift_excess(spark, d):
    return S.event_drift(events(spark, d), A.panel(spark, d), hedge=BENCH).select("k", "n", r6("mean").alias("mean"), r6("se").alias("se"))


@query("matched_drift_excess", EVENT_SQL + PAIR_SQL + ", dw AS (SELECT t, count(*) AS w FROM ev GROUP BY t), m AS (SELECT a.t, k.k, avg(b.p / a.p - b.q / a.q) AS v, max(w) AS w FROM pb a JOIN dw USING (t), range(0, 64) k(k) JOIN pb b ON b.symbol = a.symbol AND b.t = a.t + k.k WHERE a.symbol <> 'Brand#1' GROUP BY ALL) SELECT CAST(k AS INTEGER) AS k, CAST(sum(w) AS BIGINT) AS n, round(sum(v * w) / sum(w), 6) + 0.0 AS mean FROM m GROUP BY k")
def matched_drift_excess(spark, d):
    return S.matched_drift(events(spark, d), A.panel(spark, d), bench=BENCH, excess=True).select("k", "n", r6("mean").alias("mean"))


@query("matched_base_excess", EVENT_SQL + EXCESS_SQL + f"SELECT h, {MEANS} FROM ev JOIN ret USING (symbol, t) JOIN day USING (t, h) GROUP BY h")
def matched_base_excess(spark, d):
    return S.matched_base(events(spark, d), returns(spark, d, True)).select("h", "n", *(r6(c).alias(c) for c in ("mean", "base", "edge")))


BACKTEST_SQL = (
    EVENT_SQL
    + DRIFT_SQL
    + """, dr AS (SELECT symbol, t AS day, p / first(p) OVER (PARTITION BY symbol ORDER BY t RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) - 1 AS r FROM px),
en AS (SELECT DISTINCT ev.symbol, ev.t + 1 AS e FROM ev JOIN px ON px.symbol = ev.symbol AND px.t = ev.t + 1),
sp AS (SELECT en.symbol, e, max(px.t) AS x FROM en JOIN px ON px.symbol = en.symbol AND px.t BETWEEN e AND e + 21 GROUP BY ALL HAVING max(px.t) > e),
lv AS (SELECT dr.day, r - CASE WHEN day = e + 1 THEN 0.0005 ELSE 0 END - CASE WHEN day = x THEN 0.0005 ELSE 0 END AS own FROM sp JOIN dr ON dr.symbol = sp.symbol AND dr.day > e AND dr.day <= x WHERE r IS NOT NULL),
dy AS (SELECT day, count(*) AS positions, avg(own) AS ret FROM lv GROUP BY day),
al AS (SELECT cal.t, coalesce(positions, 0) AS positions, coalesce(ret, 0.0) AS ret FROM cal LEFT JOIN dy ON day = cal.t),
eq AS (SELECT *, exp(sum(ln(1 + ret)) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING)) AS equity FROM al),
bt AS (SELECT *, equity / greatest(1.0, max(equity) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING)) - 1 AS drawdown FROM eq)
"""
)


@query("backtest_equity", BACKTEST_SQL + "SELECT t, positions, round(ret, 6) + 0.0 AS ret, round(equity, 6) + 0.0 AS equity, round(drawdown, 6) + 0.0 AS drawdown FROM bt")
def backtest_equity(spark, d):
    out = S.backtest(events(spark, d), A.panel(spark, d), A.days(spark, d))
    return out.select("t", "positions", *(r6(c).alias(c) for c in ("ret", "equity", "drawdown")))


@query(
    "backtest_stats",
    BACKTEST_SQL
    + """SELECT count(*) AS days, round(arg_max(equity, t) - 1, 6) + 0.0 AS total, round(min(drawdown), 6) + 0.0 AS max_drawdown, (SELECT round(avg(CAST(b.p / a.p - 1 - 0.001 > 0 AS DOUBLE)), 6) + 0.0 FROM sp JOIN px a ON a.symbol = sp.symbol AND a.t = e JOIN px b ON b.symbol = sp.symbol AND b.t = x) AS win, (SELECT count(*) FROM sp) AS trades,
  round(coalesce(avg(positions) FILTER (positions > 0), 0), 6) + 0.0 AS avg_positions, round(avg(CAST(positions > 0 AS DOUBLE)), 6) + 0.0 AS invested, round(pow(arg_max(equity, t), 252.0 / count(*)) - 1, 6) + 0.0 AS cagr,
  CASE WHEN stddev_pop(ret) > 0 THEN round(avg(ret) / stddev_pop(ret) * sqrt(252.0), 6) + 0.0 END AS sharpe FROM bt""",
)
def backtest_stats(spark, d):
    out = S.backtest_statistics(events(spark, d), A.panel(spark, d), A.days(spark, d))
    return out.select("days", "trades", *(r6(c).alias(c) for c in ("total", "max_drawdown", "win", "avg_positions", "invested", "cagr", "sharpe")))


@query(
    "monotonicity",
    POINTS_SQL
    + """, b AS (SELECT *, CAST(floor((10 * row_number() OVER (ORDER BY x, symbol, t) - 1) / count(*) OVER ()) + 1 AS INTEGER) AS bucket FROM pts),
m AS (SELECT bucket, round(avg(y), 9) AS y FROM b GROUP BY bucket), r AS (SELECT rank() OVER (ORDER BY bucket) AS rx, rank() OVER (ORDER BY y) AS ry FROM m)
SELECT count(*) AS n, round(corr(rx, ry), 6) + 0.0 AS monotonicity FROM r""",
)
def monotonicity(spark, d):
    buckets = R.deciles(points(spark, d)).withColumn("y_mean", F.round("y_mean", 9))
    return R.monotonicity(buckets, "bucket", "y_mean").select("n", r6("monotonicity").alias("monotonicity"))


@query("sampled_points", POINTS_SQL + ", n AS (SELECT *, row_number() OVER (ORDER BY symbol, t) - 1 AS i, count(*) OVER () AS n FROM pts) SELECT symbol, t, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM n WHERE i % CAST(ceil(n / 500) AS BIGINT) = 0")
def sampled_points(spark, d):
    return R.sampled(points(spark, d), ["symbol", "t"], 500).select("symbol", "t", r6("x").alias("x"), r6("y").alias("y"))


@query(
    "residual_grid",
    RESIDUAL_SQL
    + """, a AS (SELECT symbol, arg_max(diff, t) FILTER (diff IS NOT NULL) AS diff, arg_max(reg, t) FILTER (reg IS NOT NULL) AS reg, count(reg) = 0 AS fallback FROM res GROUP BY symbol),
w AS (SELECT p_brand AS symbol, CAST(sum(CAST(p_retailprice AS DECIMAL(18, 2))) AS DOUBLE) AS w FROM part GROUP BY ALL), x AS (SELECT symbol, w / sum(w) OVER () * 100 AS weight FROM w)
SELECT symbol, round(diff, 6) + 0.0 AS diff, round(CASE WHEN fallback THEN diff ELSE reg END, 6) + 0.0 AS shown, fallback, abs(round(diff, 6)) >= 0.12 AS hot, round(weight, 6) + 0.0 AS weight FROM a LEFT JOIN x USING (symbol)""",
)
def residual_grid(spark, d):
    res = I.residuals(A.grid(spark, d), bench(spark, d))
    shown = P.prefer(res, "reg", "diff", "shown")
    own = P.latest(shown, "diff", "diff").join(P.latest(shown, "shown", "shown"), "symbol").join(shown.select("symbol", "fallback").distinct(), "symbol")
    hot, _ = I.flags(r6("diff"), F.lit(0.0))
    return own.join(A.weights(spark, d), "symbol", "left").select("symbol", r6("diff").alias("diff"), r6("shown").alias("shown"), "fallback", hot.alias("hot"), r6("weight").alias("weight"))


@query(
    "bootstrap_ci",
    POINTS_SQL
    + """, nb AS (SELECT row_number() OVER (ORDER BY symbol, t) - 1 AS i, x, y, count(*) OVER () AS n FROM pts), pr AS (SELECT max(n) AS n, CAST(ceil(max(n) / 21) AS BIGINT) AS per FROM nb),
c0 AS (SELECT unnest(range(0, 300 * per)) AS id, per, n FROM pr WHERE n >= 63), cells AS (SELECT id // per AS b, CAST('0x' || substr(md5('7/' || CAST(id AS VARCHAR)), 1, 15) AS BIGINT) % (n - 20) AS s FROM c0),
rs AS (SELECT b, corr(x, y) AS r FROM (SELECT b, s + k AS i FROM cells, range(0, 21) k(k)) JOIN nb USING (i) GROUP BY b),
pl AS (SELECT r, row_number() OVER (ORDER BY r) - 1 AS k, count(*) OVER () AS m FROM rs WHERE r IS NOT NULL),
o AS (SELECT count(*) AS draws, max(CASE WHEN k = least(m - 1, floor(0.025 * m)) THEN r END) AS lo, max(CASE WHEN k = least(m - 1, floor(0.975 * m)) THEN r END) AS hi FROM pl)
SELECT n, draws, CASE WHEN draws >= 30 THEN round(lo, 6) + 0.0 END AS lo, CASE WHEN draws >= 30 THEN round(hi, 6) + 0.0 END AS hi FROM o, pr""",
)
def bootstrap_ci(spark, d):
    return B.block_bootstrap(points(spark, d), 21).select("n", "draws", r6("lo").alias("lo"), r6("hi").alias("hi"))


@query(
    "perm_test",
    EVENT_SQL
    + f""", fr AS (SELECT symbol, t, {fwd(21)} AS ret FROM panel),
ring AS (SELECT symbol, t, ret, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS len FROM fr WHERE ret IS NOT NULL),
own AS (SELECT symbol, pos, len, ret FROM ev JOIN ring USING (symbol, t)), re AS (SELECT count(*) AS n, avg(ret) AS mean FROM own),
mv AS (SELECT symbol, draw, (pos + CAST('0x' || substr(md5('11/' || symbol || '/' || CAST(draw AS VARCHAR)), 1, 15) AS BIGINT) % len) % len AS pos FROM own, range(1, 501) r(draw)),
ms AS (SELECT draw, avg(ret) AS m FROM mv JOIN ring USING (symbol, pos) GROUP BY draw), b AS (SELECT m, avg(m) OVER () AS center, n, mean FROM ms, re)
SELECT n, round(mean, 6) + 0.0 AS mean, round(center, 6) + 0.0 AS placebo, round((count(*) FILTER (abs(m - center) >= abs(mean - center)) + 1) / (count(*) + 1), 6) + 0.0 AS p, round(avg(CAST(m < mean AS DOUBLE)), 6) + 0.0 AS percentile
FROM b WHERE n >= 3 GROUP BY n, mean, center""",
)
def perm_test(spark, d):
    own = P.forward_return(A.panel(spark, d), 21, "ret").filter("ret is not null").select("symbol", "t", "ret")
    return B.permutation_test(events(spark, d), own).select("n", *(r6(c).alias(c) for c in ("mean", "placebo", "p", "percentile")))
