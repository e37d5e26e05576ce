"""Queries on the tables that reports show: orders, constituents, sweeps, backtests, the study's rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.core import r6
from flowlens.operators import earnings as N
from flowlens.operators import identity as D
from flowlens.operators import index as I
from flowlens.operators import panel as P
from flowlens.operators import relation as R
from flowlens.operators import streaks as S
from flowlens.plans import adapter as A
from flowlens.plans import event_queries as E
from flowlens.plans import queries as Q
from flowlens.plans.adapter import BENCH, MEMBER_SQL, REPORT_SQL, SQL, fwd
from flowlens.plans.queries import query

START = "1998-01-01"

# ---------------------------------------------------------------- panels and orders


@query("universe_rows", SQL + MEMBER_SQL + f"SELECT symbol, t, total FROM panel WHERE symbol IN (SELECT symbol FROM membership WHERE fund = 'size2') AND d >= DATE '{START}'")
def universe_rows(spark, d):
    members = A.membership(spark, d).filter("fund = 'size2'")
    return P.since(P.universe(A.panel(spark, d), members), START).select("symbol", "t", "total")


@query("symbol_search", SQL + "SELECT symbol, count(*) AS n FROM panel WHERE contains(upper(symbol), '#1') AND t > (SELECT max(t) FROM panel) - 252 GROUP BY symbol")
def symbol_search(spark, d):
    return P.last_sessions(P.search(A.panel(spark, d), " #1 "), 252).groupBy("symbol").agg(F.count("*").alias("n"))


@query("first_reports", SQL + REPORT_SQL + f"SELECT symbol, year(report_date) AS year, min(report_date) AS report_date, arg_min(timing, report_date) AS timing FROM reports WHERE report_date >= DATE '{START}' GROUP BY ALL")
def first_reports(spark, d):
    own = P.since(A.reports(spark, d), START, "report_date").withColumn("year", F.year("report_date"))
    return D.keep_first(own, ["symbol", "year"], ["report_date"]).select("symbol", "year", "report_date", "timing")


@query("reports_order", SQL + REPORT_SQL + "SELECT symbol, report_date, CAST(row_number() OVER (PARTITION BY symbol ORDER BY report_date) AS INTEGER) AS place FROM reports")
def reports_order(spark, d):
    from pyspark.sql import Window as W

    return A.reports(spark, d).select("symbol", "report_date", F.row_number().over(W.partitionBy("symbol").orderBy("report_date")).alias("place"))


@query("residual_smooth", Q.RESIDUAL_SQL + ", s AS (SELECT symbol, t, avg(diff) OVER w AS diff, avg(reg) OVER w AS reg FROM res WINDOW w AS (PARTITION BY symbol ORDER BY t RANGE BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT symbol, t, round(diff, 6) + 0.0 AS diff, round(reg, 6) + 0.0 AS reg FROM s WHERE diff IS NOT NULL")
def residual_smooth(spark, d):
    out = I.residuals(A.grid(spark, d), Q.bench(spark, d), smooth=5).filter("diff is not null")
    return out.select("symbol", "t", r6("diff").alias("diff"), r6("reg").alias("reg"))


PLACED = "CASE WHEN {0} >= 0 THEN 0 WHEN {0} < 0 THEN 1 ELSE 2 END, CASE WHEN {0} >= 0 THEN -{0} ELSE {0} END, symbol"


@query(
    "grid_table",
    Q.RESIDUAL_SQL
    + MEMBER_SQL
    + f""", a AS (SELECT symbol, arg_max(dd, t) FILTER (dd IS NOT NULL) AS raw, arg_max(diff, t) FILTER (diff IS NOT NULL) AS diff, arg_max(reg, t) FILTER (reg IS NOT NULL) AS reg FROM res JOIN grid USING (symbol, t) GROUP BY symbol
  UNION ALL SELECT '~DIX', arg_max(b, t) FILTER (b IS NOT NULL), 0.0, 0.0 FROM bench),
w AS (SELECT p_brand AS symbol, CAST(sum(CAST(p_retailprice AS DECIMAL(18, 2))) AS DOUBLE) AS w FROM part GROUP BY ALL), x AS (SELECT symbol, w / sum(w) OVER () * 100 AS weight FROM w),
se AS (SELECT symbol, min(fund) AS sector FROM membership WHERE level = 'sector' GROUP BY symbol),
o AS (SELECT symbol, round(raw, 6) + 0.0 AS raw, round(diff, 6) + 0.0 AS diff, round(reg, 6) + 0.0 AS reg, weight, sector, row_number() OVER (ORDER BY coalesce(raw, -1) DESC, symbol) AS raw_place,
  row_number() OVER (ORDER BY CASE WHEN symbol = '~DIX' THEN 0 WHEN weight IS NOT NULL THEN 1 ELSE 2 END, weight DESC NULLS LAST, symbol) AS weight_place FROM a LEFT JOIN x USING (symbol) LEFT JOIN se USING (symbol))
SELECT symbol, raw, diff, reg, round(weight, 6) + 0.0 AS weight, sector, CAST(raw_place AS INTEGER) AS raw_place, CAST(weight_place AS INTEGER) AS weight_place,
  CAST(row_number() OVER (ORDER BY {PLACED.format("diff")}) AS INTEGER) AS diff_place, CAST(row_number() OVER (ORDER BY {PLACED.format("reg")}) AS INTEGER) AS place FROM o""",
)
def grid_table(spark, d):
    bench = Q.bench(spark, d)
    res = I.residuals(A.grid(spark, d), bench).withColumn("raw", F.col("dd"))
    sectors = A.membership(spark, d).filter("level = 'sector'").groupBy("symbol").agg(F.min("fund").alias("sector"))
    out = I.grid_table(res, bench, A.weights(spark, d), sectors, "~DIX")
    return out.select("symbol", *(r6(c).alias(c) for c in ("raw", "diff", "reg", "weight")), "sector", "raw_place", "weight_place", "diff_place", "place")


@query(
    "name_relation",
    SQL
    + f""", f AS (SELECT symbol, t, d, dpi, {fwd(21)} AS r21, {fwd(42)} AS r42, {fwd(63)} AS r63 FROM panel),
m AS (SELECT CASE WHEN symbol = 'Brand#7' THEN 'Brand#6' ELSE symbol END AS symbol, t, avg(dpi) AS dpi, avg(r21) AS r21, avg(r42) AS r42, avg(r63) AS r63 FROM f WHERE d >= DATE '{START}' GROUP BY ALL),
k AS (SELECT t, row_number() OVER (ORDER BY t DESC) - 1 AS back, count(*) OVER () AS n FROM (SELECT DISTINCT t FROM m)), z AS (SELECT m.* FROM m JOIN k USING (t) WHERE n <= 378 OR back % 5 = 0)
SELECT symbol, t, round(dpi, 6) + 0.0 AS dpi, round(r21, 6) + 0.0 AS r21, round(r42, 6) + 0.0 AS r42, round(r63, 6) + 0.0 AS r63 FROM z QUALIFY count(dpi) OVER (PARTITION BY symbol) > 0""",
)
def name_relation(spark, d):
    out = R.name_relation(A.panel(spark, d), "dpi", START, ("Brand#6", "Brand#7"))
    return out.select("symbol", "t", *(r6(c).alias(c) for c in ("dpi", "r21", "r42", "r63")))


# ---------------------------------------------------------------- sectors


@query(
    "sector_constituents",
    SQL
    + MEMBER_SQL
    + """, m AS (SELECT symbol, avg(close * short) AS s FROM panel WHERE t > (SELECT max(t) FROM cal) - 25 GROUP BY symbol HAVING avg(close * short) IS NOT NULL),
v AS (SELECT symbol, round(dd, 9) AS dd, row_number() OVER (PARTITION BY symbol ORDER BY t DESC) AS back FROM grid WHERE dd IS NOT NULL),
l AS (SELECT symbol, max(dd) FILTER (back = 1) AS latest, CASE WHEN count(*) > 21 THEN max(dd) FILTER (back = 1) - max(dd) FILTER (back = 21) ELSE 0 END AS change FROM v GROUP BY symbol),
c AS (SELECT fund, symbol, s / sum(s) OVER (PARTITION BY fund) * 100 AS share FROM membership JOIN m USING (symbol)),
r AS (SELECT *, row_number() OVER (PARTITION BY fund ORDER BY share DESC, symbol) AS rank FROM c JOIN l USING (symbol))
SELECT fund, symbol, round(share, 6) + 0.0 AS share, round(latest, 6) + 0.0 AS latest, round(change, 6) + 0.0 AS change, CASE WHEN change > 0.003 THEN 'accumulating' WHEN change < -0.003 THEN 'distributing' ELSE 'flat' END AS flow, CAST(rank AS INTEGER) AS rank
FROM r WHERE rank <= 30""",
)
def sector_constituents(spark, d):
    # the change over 20 valid rows is from the 21st last one
    out = I.constituents(A.panel(spark, d), A.grid(spark, d).withColumn("dd", F.round("dd", 9)), A.membership(spark, d).select("fund", "symbol"))
    return out.select("fund", "symbol", *(r6(c).alias(c) for c in ("share", "latest", "change")), "flow", "rank")


@query("joint_names", SQL + MEMBER_SQL + "SELECT fund, count(DISTINCT m.symbol) AS names, count(DISTINCT p.symbol) AS with_data FROM membership m LEFT JOIN (SELECT symbol FROM panel WHERE short IS NOT NULL AND total IS NOT NULL AND close IS NOT NULL) p ON p.symbol = m.symbol GROUP BY fund")
def joint_names(spark, d):
    return I.joint_names(A.panel(spark, d), A.membership(spark, d))


@query(
    "sector_rank",
    Q.SECTOR_SQL
    + """, v AS (SELECT fund, round(level, 9) AS level, row_number() OVER (PARTITION BY fund ORDER BY t DESC) AS back, first(round(level, 9)) OVER (PARTITION BY fund ORDER BY t DESC) AS now FROM lv WHERE level IS NOT NULL),
p AS (SELECT fund, round(100 * avg(CASE WHEN back <= 252 THEN CAST(level < now AS DOUBLE) END)) AS percentile FROM v GROUP BY fund)
SELECT fund, percentile, CAST(row_number() OVER (ORDER BY percentile DESC NULLS LAST, fund) AS INTEGER) AS place FROM p""",
)
def sector_rank(spark, d):
    return I.ranked_funds(I.sector_summary(Q.levels(spark, d))).select("fund", "percentile", "place")


# ---------------------------------------------------------------- streaks


@query(
    "sweep_table",
    Q.STATE_SQL
    + Q.RET_SQL
    + """, bands AS (SELECT a.i AS lo, b.i AS hi FROM range(1, 11) a(i), range(1, 11) b(i) WHERE a.i <= b.i),
hits AS (SELECT lo, hi, symbol, t, t - row_number() OVER (PARTITION BY lo, hi, symbol ORDER BY t) AS island FROM state JOIN bands ON decile BETWEEN lo AND hi),
ev AS (SELECT lo, hi, symbol, t FROM (SELECT *, row_number() OVER (PARTITION BY lo, hi, symbol, island ORDER BY t) AS k FROM hits) WHERE k = 3),
st AS (SELECT lo, hi, count(*) AS streaks FROM ev GROUP BY ALL), me AS (SELECT lo, hi, h, count(*) AS n, avg(ret) AS mean FROM ev JOIN ret USING (symbol, t) GROUP BY ALL),
g AS (SELECT lo, hi, streaks, h, coalesce(n, 0) AS n, mean FROM st CROSS JOIN (VALUES (21), (42), (63)) x(h) LEFT JOIN me USING (lo, hi, h))
SELECT CAST(lo AS INTEGER) AS lo, CAST(hi AS INTEGER) AS hi, streaks, h, n, round(mean, 6) + 0.0 AS mean, CAST(row_number() OVER (PARTITION BY h ORDER BY streaks DESC, lo, hi) AS INTEGER) AS by_streaks,
  CAST(row_number() OVER (PARTITION BY h ORDER BY round(mean, 9) DESC NULLS LAST, lo, hi) AS INTEGER) AS by_mean FROM g
UNION ALL SELECT 0, 0, NULL, h, count(*), round(avg(ret), 6) + 0.0, NULL, NULL FROM ret GROUP BY h""",
)
def sweep_table(spark, d):
    out = S.sweep_table(Q.states(spark, d), Q.returns(spark, d), Q.RUN)
    return out.select("lo", "hi", "streaks", "h", "n", r6("mean").alias("mean"), "by_streaks", "by_mean")


STATUS_SQL = (
    Q.EVENT_SQL
    + """, nw AS (SELECT symbol, max(t) AS last_t FROM state WHERE decile IS NOT NULL GROUP BY symbol), en AS (SELECT max(t) AS e FROM cal),
tp AS (SELECT symbol, max(t) AS tip, arg_max(k, t) AS k FROM runs GROUP BY symbol),
z AS (SELECT symbol, CAST(CASE WHEN tip = last_t AND last_t > e - 3 THEN k ELSE 0 END AS INTEGER) AS length FROM nw LEFT JOIN tp USING (symbol), en)
"""
)


@query(
    "current_streaks",
    STATUS_SQL
    + """, y AS (SELECT symbol, length, CASE WHEN length >= 3 THEN 'active' WHEN length = 2 THEN 'building' END AS status FROM z WHERE length >= 2)
SELECT status, CAST(row_number() OVER (PARTITION BY status ORDER BY length DESC, symbol) AS INTEGER) AS rank, symbol, length FROM y QUALIFY rank <= CASE WHEN status = 'active' THEN 12 ELSE 8 END""",
)
def current_streaks(spark, d):
    return S.current_streaks(S.streak_status(Q.states(spark, d), A.days(spark, d), Q.LO, Q.HI, Q.RUN))


@query(
    "regime_midpoint",
    Q.EVENT_SQL
    + Q.RET_SQL
    + f""", sp AS (SELECT CAST(floor(count(*) / 2) AS INTEGER) AS s FROM cal), x AS (SELECT h, ret, base, unnest(['full', CASE WHEN ev.t < s THEN 'before' ELSE 'after' END]) AS period FROM ev JOIN ret USING (symbol, t) JOIN day USING (t, h), sp)
SELECT period, h, {Q.MEANS} FROM x GROUP BY ALL""",
)
def regime_midpoint(spark, d):
    """The boundary lies after the sample, so its middle takes its place."""
    out = S.regime_split(Q.events(spark, d), Q.returns(spark, d), A.days(spark, d), "2030-01-01")
    return out.select("period", "h", "n", *(r6(c).alias(c) for c in ("mean", "base", "edge")))


def backtest_sql(hold: int, lag: int, hedge: bool, tag: str = "") -> str:
    """The backtest's tables with a suffix, from ``ev`` and ``px``."""
    own = "r - coalesce(hb, 0)" if hedge else "r"
    return f"""
, d0{tag} AS (SELECT symbol, t AS day, p / first(p) OVER (PARTITION BY symbol ORDER BY t RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) - 1 AS r FROM px),
dr{tag} AS (SELECT a.symbol, a.day, a.r, b.r AS hb FROM d0{tag} a LEFT JOIN d0{tag} b ON b.symbol = 'Brand#1' AND b.day = a.day),
en{tag} AS (SELECT DISTINCT ev.symbol, ev.t + {lag} AS e FROM ev JOIN px ON px.symbol = ev.symbol AND px.t = ev.t + {lag}),
sp{tag} AS (SELECT en{tag}.symbol, e, max(px.t) AS x FROM en{tag} JOIN px ON px.symbol = en{tag}.symbol AND px.t BETWEEN e AND e + {hold} GROUP BY ALL HAVING max(px.t) > e),
lv{tag} AS (SELECT d.day, {own} - CASE WHEN day = e + 1 THEN 0.0005 ELSE 0 END - CASE WHEN day = x THEN 0.0005 ELSE 0 END AS own FROM sp{tag} s JOIN dr{tag} d ON d.symbol = s.symbol AND d.day > e AND d.day <= x WHERE r IS NOT NULL),
dy{tag} AS (SELECT day, count(*) AS positions, avg(own) AS ret FROM lv{tag} GROUP BY day),
eq{tag} AS (SELECT cal.t, coalesce(positions, 0) AS positions, coalesce(ret, 0.0) AS ret, exp(sum(ln(abs(1 + coalesce(ret, 0.0)))) OVER (ORDER BY cal.t ROWS UNBOUNDED PRECEDING)) AS equity FROM cal LEFT JOIN dy{tag} ON day = cal.t)"""


@query(
    "backtest_hedged",
    Q.EVENT_SQL
    + Q.DRIFT_SQL
    + backtest_sql(21, 1, True)
    + """, bp AS (SELECT t, last_value(p IGNORE NULLS) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS p FROM cal LEFT JOIN (SELECT t, p FROM px WHERE symbol = 'Brand#1') USING (t))
SELECT t, positions, round(ret, 6) + 0.0 AS ret, round(p / (SELECT arg_min(p, t) FROM bp WHERE p IS NOT NULL), 6) + 0.0 AS hold FROM eq JOIN bp USING (t)""",
)
def backtest_hedged(spark, d):
    df = A.panel(spark, d)
    out = S.with_hold(S.backtest(Q.events(spark, d), df, A.days(spark, d), hedge=BENCH), df, BENCH)
    return out.select("t", "positions", r6("ret").alias("ret"), r6("hold").alias("hold"))


@query(
    "backtest_lags",
    Q.EVENT_SQL
    + Q.DRIFT_SQL
    + "".join(backtest_sql(h, lag, False, f"_{h}_{lag}") for h in (21, 42, 63) for lag in (1, 0))
    + ", o AS ("
    + " UNION ALL ".join(f"SELECT {h} AS hold, (SELECT count(*) FROM sp_{h}_1) AS trades, (SELECT arg_max(equity, t) - 1 FROM eq_{h}_1) AS a, (SELECT arg_max(equity, t) - 1 FROM eq_{h}_0) AS b" for h in (21, 42, 63))
    + ") SELECT hold, trades, round(a, 6) + 0.0 AS total, round(b, 6) + 0.0 AS total_no_lag, round(a - b, 6) + 0.0 AS lag FROM o",
)
def backtest_lags(spark, d):
    out = S.backtest_lags(Q.events(spark, d), A.panel(spark, d), A.days(spark, d))
    return out.select("hold", "trades", *(r6(c).alias(c) for c in ("total", "total_no_lag", "lag")))


# ---------------------------------------------------------------- the study


@query(
    "path_finals",
    E.EVENT_SQL
    + """, k AS (SELECT symbol, quantile_cont(dpi10, 1 / 3) AS a, quantile_cont(dpi10, 2 / 3) AS b, count(dpi10) AS c FROM ev GROUP BY symbol),
cs AS (SELECT ev.symbol, base, report_date, m1_rvol, CASE WHEN c >= 6 AND dpi10 IS NOT NULL THEN CASE WHEN dpi10 >= round(b, 9) THEN 'hi' WHEN dpi10 <= round(a, 9) THEN 'lo' ELSE 'mid' END END AS cls FROM ev JOIN k USING (symbol)),
p AS (SELECT symbol, t, adjclose AS v FROM panel), w AS (SELECT cs.symbol, report_date, cls, m1_rvol, s.s AS k, CAST(round_even((q.v / o.v - 1) * 10000, 0) AS INTEGER) AS bp
  FROM cs JOIN p o ON o.symbol = cs.symbol AND o.t = base, range(0, 4) s(s) JOIN p q ON q.symbol = cs.symbol AND q.t = base + s.s),
f AS (SELECT *, count(*) OVER (PARTITION BY symbol, report_date) AS c FROM w)
SELECT symbol, count(*) AS n, round(avg(bp), 6) + 0.0 AS final_mean, round(median(bp), 6) + 0.0 AS final_median, count(*) FILTER (bp > 0) AS up, CASE WHEN count(*) FILTER (cls = 'hi') >= 1 THEN round(avg(bp) FILTER (cls = 'hi'), 6) + 0.0 END AS hi_mean,
  CASE WHEN count(*) FILTER (cls = 'lo') >= 1 THEN round(avg(bp) FILTER (cls = 'lo'), 6) + 0.0 END AS lo_mean, round(avg(m1_rvol), 6) + 0.0 AS rvol, round(avg(m1_rvol) FILTER (cls = 'hi'), 6) + 0.0 AS rvol_hi, round(avg(m1_rvol) FILTER (cls = 'lo'), 6) + 0.0 AS rvol_lo
FROM f WHERE c = 4 AND k = 3 GROUP BY symbol HAVING count(*) >= 2""",
)
def path_finals(spark, d):
    out = N.path_finals(E.study(spark, d), A.panel(spark, d), 3, 2, 1)
    return out.select("symbol", "n", "up", *(r6(c).alias(c) for c in ("final_mean", "final_median", "hi_mean", "lo_mean", "rvol", "rvol_hi", "rvol_lo")))


@query(
    "horizon_table",
    E.WELCH_SQL.replace("\nSELECT horizon, high_n", "\n, wl AS (SELECT horizon, high_n", 1)
    + "), hr AS (SELECT horizon, count(*) AS n, round(corr(dpi10, ret), 6) + 0.0 AS r FROM lg WHERE dpi10 IS NOT NULL AND ret IS NOT NULL GROUP BY horizon HAVING count(*) >= 5) SELECT horizon, n, r, high_mean, low_mean, spread, t_stat, high_up, low_up FROM hr JOIN wl USING (horizon)",
)
def horizon_table(spark, d):
    ev = E.study(spark, d)
    out = N.horizon_rollup(ev).join(N.tercile_spread(ev), "horizon")
    return out.select("horizon", "n", *(r6(c).alias(c) for c in ("r", "high_mean", "low_mean", "spread", "t_stat", "high_up", "low_up")))


@query(
    "names_by_correlation",
    E.EVENT_SQL
    + """, o AS (SELECT symbol, count(*) FILTER (dpi10 IS NOT NULL AND m1_ret IS NOT NULL) AS n, corr(dpi10, m1_ret) AS r FROM ev GROUP BY symbol HAVING count(dpi10) >= 2)
SELECT symbol, n, round(r, 6) + 0.0 AS r, CAST(row_number() OVER (ORDER BY round(CASE WHEN isnan(r) THEN NULL ELSE r END, 9) NULLS LAST, symbol) AS INTEGER) AS place FROM o""",
)
def names_by_correlation(spark, d):
    out = N.names_by_correlation(E.study(spark, d), least=2)
    return out.select("symbol", "n", r6("r").alias("r"), "place")


@query(
    "study_full",
    E.WELCH_SQL.replace("\nSELECT horizon, high_n", "\n, wl AS (SELECT horizon, high_n", 1)
    + """), hz AS (SELECT horizon, avg(ret) AS mean, median(ret) AS median, stddev_samp(ret) AS std, avg(CAST(ret > 0 AS DOUBLE)) AS positive, corr(dpi10, ret) AS r_dpi10, corr(dpi5, ret) AS r_dpi5 FROM lg GROUP BY horizon),
wd AS (SELECT horizon, CAST(high_n AS DOUBLE) AS high_n, CAST(low_n AS DOUBLE) AS low_n, high_mean, low_mean, high_up, low_up, spread, t_stat, df FROM wl),
rv AS ("""
    + " UNION ALL ".join(f"SELECT '{n}' AS horizon, {n}_rvol AS v, dpi10, dpi10_pct FROM ev" for n, _ in E.H)
    + """), vo AS (SELECT horizon, avg(v) AS mean, corr(dpi10, v) AS r, avg(v) FILTER (dpi10_pct >= 2 / 3) AS high, avg(v) FILTER (dpi10_pct <= 1 / 3) AS low FROM rv GROUP BY horizon),
o AS (SELECT *, year(report_date) AS y FROM ev WHERE dpi10 IS NOT NULL AND m1_ret IS NOT NULL), m AS (SELECT floor(quantile_cont(y, 0.5)) AS mid FROM o),
cx AS (SELECT dpi10, m1_ret, unnest(['year=' || y, 'timing=' || timing, 'name=' || symbol, 'cohort=' || CASE WHEN symbol IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5') THEN 'in' ELSE 'out' END, 'half=' || CASE WHEN y <= mid THEN 'early' ELSE 'late' END]) AS item FROM o, m),
cu AS (SELECT item, CAST(count(*) AS DOUBLE) AS n, corr(dpi10, m1_ret) AS r FROM cx GROUP BY item HAVING count(*) >= 8),
al AS (SELECT 'horizon' AS section, horizon AS item, metric, value FROM hz UNPIVOT INCLUDE NULLS (value FOR metric IN (mean, median, std, positive, r_dpi10, r_dpi5))
  UNION ALL SELECT 'sample', 'all', 'events', CAST(count(*) AS DOUBLE) FROM ev UNION ALL SELECT 'sample', 'all', 'names', CAST(count(DISTINCT symbol) AS DOUBLE) FROM ev
  UNION ALL SELECT 'sample', 'all', 'with_data', CAST(count(dpi10) AS DOUBLE) FROM ev UNION ALL SELECT 'timing', timing, 'events', CAST(count(*) AS DOUBLE) FROM ev GROUP BY timing
  UNION ALL SELECT 'tercile', horizon, metric, value FROM wd UNPIVOT INCLUDE NULLS (value FOR metric IN (high_n, low_n, high_mean, low_mean, high_up, low_up, spread, t_stat, df))
  UNION ALL SELECT 'volatility', horizon, metric, value FROM vo UNPIVOT INCLUDE NULLS (value FOR metric IN (mean, r, high, low)) UNION ALL SELECT 'cut', item, metric, value FROM cu UNPIVOT INCLUDE NULLS (value FOR metric IN (n, r)))
SELECT section, item, metric, round(value, 6) + 0.0 AS value FROM al""",
)
def study_full(spark, d):
    return N.full_summary(E.study(spark, d), E.COHORT).select("section", "item", "metric", r6("value").alias("value"))
