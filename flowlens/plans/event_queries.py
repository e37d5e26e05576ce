"""Queries on identities, filings and the event study."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.core import r6
from flowlens.functions.stats import P_SQL
from flowlens.operators import earnings as N
from flowlens.operators import identity as D
from flowlens.operators import panel as P
from flowlens.plans import adapter as A
from flowlens.plans.adapter import REPORT_SQL, SQL
from flowlens.plans.queries import query

SPANS = (("Brand#2", "Brand#3", "1996-01-01", "1998-01-01", 1), ("Brand#2", "Brand#4", "1997-06-01", "1999-01-01", 2))
COHORT = ["Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5"]


def rows_of(spark: SparkSession, rows: tuple, schema: str) -> DataFrame:
    """A small fixed table."""
    names = [c.split()[0] for c in schema.split(",")]
    kinds = [c.split()[1] for c in schema.split(",")]
    structs = [F.struct(*(F.lit(v).cast(k).alias(n) for v, n, k in zip(r, names, kinds))) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


@query(
    "alias_join",
    SQL
    + """, sp AS (SELECT * FROM (VALUES ('Brand#2', 'Brand#3', DATE '1996-01-01', DATE '1998-01-01', 1), ('Brand#2', 'Brand#4', DATE '1997-06-01', DATE '1999-01-01', 2)) v(new, old, a, b, pr)),
al AS (SELECT symbol, t, d, total, dpi FROM panel WHERE NOT EXISTS (SELECT 1 FROM sp WHERE new = symbol AND d >= a AND d < b)
  UNION ALL SELECT new, t, d, total, dpi FROM (SELECT *, row_number() OVER (PARTITION BY new, d ORDER BY pr) AS r FROM panel JOIN sp ON symbol = old AND d >= a AND d < b) WHERE r = 1)
SELECT symbol, t, CASE WHEN symbol <> 'Brand#5' OR d >= DATE '1997-01-01' THEN total END AS total, CASE WHEN symbol <> 'Brand#5' OR d >= DATE '1997-01-01' THEN round(dpi, 6) + 0.0 END AS dpi FROM al""",
)
def alias_join(spark, d):
    spans = rows_of(spark, SPANS, "symbol string,old_symbol string,start date,end date,priority int")
    out = D.resolve_aliases(A.panel(spark, d), spans)
    out = D.valid_from(out, rows_of(spark, (("Brand#5", "1997-01-01"),), "symbol string,first_d date"), ["total", "dpi"])
    return out.select("symbol", "t", "total", r6("dpi").alias("dpi"))


@query(
    "share_class_merge",
    SQL
    + """, m AS (SELECT CASE WHEN symbol = 'Brand#7' THEN 'Brand#6' ELSE symbol END AS s, t, sum(short) AS short, sum(total) AS total, max(CASE WHEN symbol <> 'Brand#7' THEN close END) AS close FROM panel GROUP BY ALL)
SELECT s AS symbol, t, short, total, round(close, 6) + 0.0 AS close, CASE WHEN total <> 0 THEN round(greatest(0.0, least(1.0, short / total)), 6) + 0.0 END AS dpi FROM m""",
)
def share_class_merge(spark, d):
    classes = rows_of(spark, (("Brand#6", "Brand#7"),), "primary string,secondary string")
    out = D.merge_classes(A.panel(spark, d), classes, ["short", "total"], [], ["close"])
    return out.select("symbol", "t", "short", "total", r6("close").alias("close"), r6(P.dpi()).alias("dpi"))


SPLIT_SQL = (
    SQL
    + """, sv AS (SELECT symbol, t, total * CASE WHEN symbol = 'Brand#8' AND d >= DATE '1998-01-05' THEN 4 ELSE 1 END AS total, volume FROM panel),
ow AS (SELECT symbol, t, greatest(total / volume, 1e-9) AS c, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM sv WHERE total / volume IS NOT NULL),
md AS (SELECT *, round(list_aggregate(list(ln(c)) OVER (o ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING), 'quantile_cont', 0.5) - list_aggregate(list(ln(c)) OVER (o ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), 'quantile_cont', 0.5), 9) AS jump,
  list_aggregate(list(c) OVER (o ROWS BETWEEN 31 PRECEDING AND 7 PRECEDING), 'quantile_cont', 0.5) AS before, list_aggregate(list(c) OVER (o ROWS BETWEEN 6 FOLLOWING AND 30 FOLLOWING), 'quantile_cont', 0.5) AS after,
  lead(c) OVER (o) AS next FROM ow WINDOW o AS (PARTITION BY symbol ORDER BY t)),
ov AS (SELECT *, i - row_number() OVER (PARTITION BY symbol ORDER BY i) AS run FROM md WHERE n >= 36 AND i >= 12 AND i < n - 12 AND jump > ln(2.2)),
pk AS (SELECT symbol, t, i AS peak, before, after, after / before AS f FROM ov QUALIFY row_number() OVER (PARTITION BY symbol, run ORDER BY jump DESC, i) = 1),
sz AS (SELECT *, (SELECT arg_min(r, abs(r - f)) FROM (VALUES (2), (3), (4), (5), (6), (7), (8), (10), (12), (15), (20)) v(r)) AS best FROM pk),
dt AS (SELECT sz.symbol, peak, best, coalesce((SELECT min(md.t) FROM md WHERE md.symbol = sz.symbol AND md.i >= peak - 12 AND md.i < peak + 12 AND md.c >= sqrt(sz.before * sz.after) AND md.next >= sqrt(sz.before * sz.after)), sz.t) AS t FROM sz WHERE abs(best - f) / best < 0.22),
sp AS (SELECT symbol, CAST(t AS INTEGER) AS t, CAST(arg_max(best, peak) AS DOUBLE) AS factor FROM dt GROUP BY ALL)
"""
)


def split_view(spark, d):
    later = (F.col("symbol") == "Brand#8") & (F.col("d") >= F.lit("1998-01-05").cast("date"))
    return A.panel(spark, d).withColumn("total", F.col("total") * F.when(later, 4.0).otherwise(1.0))


def splits(spark, d):
    return D.detect_splits(split_view(spark, d).select("symbol", "t", (F.col("total") / F.col("volume")).alias("ratio")))


@query("split_detect", SPLIT_SQL + "SELECT symbol, t, round(factor, 6) + 0.0 AS factor FROM sp")
def split_detect(spark, d):
    return splits(spark, d).select("symbol", "t", r6("factor").alias("factor"))


@query("split_adjust", SPLIT_SQL + "SELECT sv.symbol, sv.t, round(sv.total * coalesce((SELECT product(factor) FROM sp WHERE sp.symbol = sv.symbol AND sp.t > sv.t), 1), 6) + 0.0 AS total FROM sv")
def split_adjust(spark, d):
    return D.apply_splits(split_view(spark, d), splits(spark, d), ["total"]).select("symbol", "t", r6("total").alias("total"))


@query(
    "upsert_keep_last",
    SQL
    + """, a AS (SELECT symbol, t, short, total FROM panel WHERE d < DATE '2000-01-01'),
deliveries AS (SELECT symbol, t, CASE WHEN (t + v) % 2 = 0 THEN short * v END AS short, total + v AS total, v FROM panel, (VALUES (1), (2), (3)) x(v) WHERE d >= DATE '1999-01-01' AND (t + v) % 3 <> 0),
b AS (SELECT symbol, t, short, total FROM deliveries QUALIFY row_number() OVER (PARTITION BY symbol, t ORDER BY v DESC) = 1)
SELECT symbol, t, coalesce(b.short, a.short) AS short, coalesce(b.total, a.total) AS total FROM a FULL JOIN b USING (symbol, t)""",
)
def upsert_keep_last(spark, d):
    df = A.panel(spark, d)
    stored = df.filter("d < date'2000-01-01'")
    v = F.col("v")
    fresh = df.filter("d >= date'1999-01-01'").withColumn("v", F.explode(F.array(*map(F.lit, (1, 2, 3))))).filter((F.col("t") + v) % 3 != 0)  # a day is delivered twice
    fresh = fresh.withColumn("short", F.when((F.col("t") + v) % 2 == 0, F.col("short") * v)).withColumn("total", F.col("total") + v)
    return D.upsert(stored, D.keep_last(fresh, ["symbol", "t"], ["v"]), ["symbol", "t"], ["short", "total"])


@query(
    "set_ops",
    SQL
    + """, e AS (SELECT DISTINCT symbol FROM panel WHERE d < DATE '1996-01-01'), l AS (SELECT DISTINCT symbol FROM panel WHERE d >= DATE '2000-01-01'),
w AS (SELECT CAST(unnest(generate_series((SELECT min(d) FROM cal), (SELECT max(d) FROM cal), INTERVAL 1 DAY)) AS DATE) AS d)
SELECT 'common' AS kind, symbol AS item, CAST(NULL AS BIGINT) AS place FROM (SELECT * FROM e INTERSECT SELECT * FROM l)
UNION ALL SELECT 'new', symbol, NULL FROM (SELECT * FROM l EXCEPT SELECT * FROM e)
UNION ALL SELECT 'missing', CAST(d AS VARCHAR), NULL FROM w WHERE isodow(d) <= 5 AND d NOT IN (SELECT d FROM cal)
UNION ALL SELECT 'first seen', p_brand, min(p_partkey) FROM part GROUP BY p_brand""",
)
def set_ops(spark, d):
    df, cal = A.panel(spark, d), A.days(spark, d)
    early = df.filter("d < date'1996-01-01'").select("symbol").distinct()
    late = df.filter("d >= date'2000-01-01'").select("symbol").distinct()
    civil = cal.agg(F.min("d").alias("a"), F.max("d").alias("b")).select(F.explode(F.sequence("a", "b")).alias("d")).filter(F.weekday("d") < 5)
    none = F.lit(None).cast("bigint").alias("place")
    kind = lambda k, x, p=none: [F.lit(k).alias("kind"), x.alias("item"), p]
    out = early.intersect(late).select(*kind("common", F.col("symbol")))
    out = out.unionByName(late.exceptAll(early).select(*kind("new", F.col("symbol"))))
    out = out.unionByName(D.missing_days(civil, cal).select(*kind("missing", F.col("d").cast("string"))))
    seen = D.first_seen(A.table(spark, d, "part").select(F.col("p_brand").alias("symbol"), F.col("p_partkey").alias("place")), "symbol", "place")
    return out.unionByName(seen.select(*kind("first seen", F.col("symbol"), F.col("place"))))


# ---------------------------------------------------------------- filings


@query(
    "classify_timing",
    # events lie in January, when Eastern time is UTC-5
    """WITH e AS (SELECT event_id, ts - INTERVAL 5 HOUR AS l FROM events)
SELECT event_id, CAST(l AS DATE) AS local_date, CASE WHEN strftime(l, '%H:%M') < '09:30' THEN 'bmo' WHEN strftime(l, '%H:%M') >= '16:00' THEN 'amc' ELSE 'intraday' END AS timing FROM e""",
)
def classify_timing(spark, d):
    day, timing = N.classify_timing(F.col("ts"))
    return A.table(spark, d, "events").select("event_id", day.alias("local_date"), timing.alias("timing"))


@query(
    "nearest_match",
    """WITH e AS (SELECT event_id, user_id, event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h FROM events),
j AS (SELECT p.user_id, p.event_id AS report, c.event_id AS cand, abs(p.h - c.h) AS gap, c.h FROM e p JOIN e c ON p.user_id = c.user_id AND p.event_type = 'purchase' AND c.event_type = 'error' AND abs(p.h - c.h) <= 35)
SELECT user_id, report, cand, gap FROM j QUALIFY row_number() OVER (PARTITION BY user_id, report ORDER BY gap, h, cand) = 1""",
)
def nearest_match(spark, d):
    ev = A.table(spark, d, "events").select("event_id", "user_id", "event_type", F.floor(F.unix_timestamp("ts") / 3600).alias("h"))
    return N.nearest_match(ev.filter("event_type = 'purchase'"), ev.filter("event_type = 'error'"), 35, "user_id", "h", "event_id")


@query("asof_session", SQL + REPORT_SQL + "SELECT o_orderkey, ahead.t, coalesce(exact, false) AS exact FROM orders LEFT JOIN ahead ON day = CAST(o_orderdate AS DATE)")
def asof_session(spark, d):
    own = A.table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day_"))
    return N.as_of_forward(own, A.days(spark, d), "day_").select("o_orderkey", "t", F.coalesce("exact", F.lit(False)).alias("exact"))


# ---------------------------------------------------------------- event study

H = N.HORIZONS
PRICE_SQL = (
    SQL
    + REPORT_SQL
    + """, ch AS (SELECT *, adjclose / nullif(first(adjclose) OVER (PARTITION BY symbol ORDER BY t RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), 0) AS rt FROM grid),
cl AS (SELECT *, rt - 1 AS chg, ln(rt) AS lr FROM ch),
px AS (SELECT symbol, t, """
    + ", ".join(
        f"first(adjclose) OVER (PARTITION BY symbol ORDER BY t RANGE BETWEEN {h} FOLLOWING AND {h} FOLLOWING) / nullif(adjclose, 0) - 1 AS {n}_ret, "
        f"CASE WHEN count(lr) OVER (PARTITION BY symbol ORDER BY t RANGE BETWEEN 1 FOLLOWING AND {h} FOLLOWING) = {h} THEN sqrt(252.0 / {h} * sum(lr * lr) OVER (PARTITION BY symbol ORDER BY t RANGE BETWEEN 1 FOLLOWING AND {h} FOLLOWING)) * 100 END AS {n}_rvol"
        for n, h in H
    )
    + """, CASE WHEN count(dpi) OVER (o RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING) >= 3 THEN round(avg(dpi) OVER (o RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING), 9) END AS dpi5,
  CASE WHEN count(dpi) OVER (o RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING) >= 8 THEN round(avg(dpi) OVER (o RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING), 9) END AS dpi10,
  CASE WHEN count(chg) OVER (o RANGE BETWEEN 65 PRECEDING AND 4 PRECEDING) > 10 THEN stddev_samp(chg) OVER (o RANGE BETWEEN 65 PRECEDING AND 4 PRECEDING) END AS sigma
  FROM cl WINDOW o AS (PARTITION BY symbol ORDER BY t)),
e1 AS (SELECT r.symbol, report_date, timing, a.t, CAST(CASE WHEN timing = 'amc' AND exact THEN a.t ELSE a.t - 1 END AS INTEGER) AS base FROM reports r JOIN ahead a ON day = report_date
  WHERE a.t >= 1 AND r.symbol IN (SELECT symbol FROM panel WHERE adjclose IS NOT NULL)),
eb AS (SELECT e1.*, b.dpi5, b.dpi10, b.sigma FROM e1 LEFT JOIN px b ON b.symbol = e1.symbol AND b.t = e1.t WHERE base >= 1)
"""
)
FIXED_SQL = ", ea AS (SELECT *, 0 AS anchored FROM eb)\n"
ANCHOR_SQL = """, li AS (SELECT max(t) AS last FROM cal), sl AS (SELECT symbol, report_date, least(last, base + 5) - greatest(1, base - 1) + 1 AS size, unnest(range(greatest(1, base - 1), least(last, base + 5) + 1)) AS pos FROM eb, li),
mv AS (SELECT s.symbol, report_date, max(size) AS size, count(chg) AS c, max(abs(chg)) AS top, arg_max(pos, abs(chg)) AS place, list_sort(list(abs(chg)), 'DESC')[2] AS second FROM sl s JOIN cl ON cl.symbol = s.symbol AND cl.t = pos GROUP BY ALL),
ea AS (SELECT eb.* REPLACE (CAST(CASE WHEN good THEN place - 1 ELSE base END AS INTEGER) AS base), CAST(coalesce(good, false) AS INTEGER) AS anchored
  FROM eb LEFT JOIN (SELECT symbol, report_date, place, size >= 2 AND c = size AND top >= 0.03 AND sigma > 0 AND top >= 2.5 * sigma AND top >= 1.3 * greatest(second, 1e-9) AS good FROM mv JOIN eb USING (symbol, report_date)) g USING (symbol, report_date))
"""
BASED_SQL = (
    """, e2 AS (SELECT ea.*, cal.d AS base_date, """
    + ", ".join(f"f.{n}_ret, f.{n}_rvol" for n, _ in H)
    + """ FROM ea LEFT JOIN px f ON f.symbol = ea.symbol AND f.t = ea.base LEFT JOIN cal ON cal.t = ea.base),
ev AS (SELECT *, CASE WHEN sigma IS NOT NULL AND abs(next_day_ret) >= greatest(0.02, 2 * sigma) THEN 1 ELSE 0 END AS looks_reaction, CAST(next_day_ret IS NOT NULL AS INTEGER) AS has_data,
  CASE WHEN dpi5 IS NOT NULL THEN (rank() OVER (PARTITION BY symbol, dpi5 IS NULL ORDER BY dpi5) + (count(*) OVER (PARTITION BY symbol, dpi5) - 1) / 2) / count(dpi5) OVER (PARTITION BY symbol) END AS dpi5_pct,
  CASE WHEN dpi10 IS NOT NULL THEN (rank() OVER (PARTITION BY symbol, dpi10 IS NULL ORDER BY dpi10) + (count(*) OVER (PARTITION BY symbol, dpi10) - 1) / 2) / count(dpi10) OVER (PARTITION BY symbol) END AS dpi10_pct FROM e2)
"""
)
EVENT_SQL = PRICE_SQL + FIXED_SQL + BASED_SQL
LONG_SQL = ", lg AS (" + " UNION ALL ".join(f"SELECT *, '{n}' AS horizon, {n}_ret AS ret FROM ev" for n, _ in H) + ")\n"
ROUNDED = ("dpi5", "dpi10", "sigma", "dpi5_pct", "dpi10_pct", *(f"{n}_{k}" for n, _ in H for k in ("ret", "rvol")))


TABLE_SQL = "SELECT symbol, report_date, timing, base, base_date, anchored, has_data, looks_reaction, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ROUNDED) + " FROM ev"


def study(spark, d, anchor=False):
    return N.event_table(A.reports(spark, d), A.grid(spark, d), A.days(spark, d), anchor)


def shown(table):
    return table.select("symbol", "report_date", "timing", "base", "base_date", "anchored", "has_data", "looks_reaction", *(r6(c).alias(c) for c in ROUNDED))


@query("event_table", EVENT_SQL + TABLE_SQL)
def event_table(spark, d):
    return shown(study(spark, d))


@query("reaction_anchor", PRICE_SQL + ANCHOR_SQL + BASED_SQL + TABLE_SQL)
def reaction_anchor(spark, d):
    return shown(study(spark, d, True))


@query("realised_vol", EVENT_SQL + "SELECT symbol, t, round(w1_rvol, 6) + 0.0 AS w1_rvol, round(m1_rvol, 6) + 0.0 AS m1_rvol FROM px WHERE w1_rvol IS NOT NULL")
def realised_vol(spark, d):
    df = P.daily_change(A.grid(spark, d))
    df = P.realised_vol(P.realised_vol(df, 5, "w1_rvol"), 21, "m1_rvol")
    return df.filter("w1_rvol is not null").select("symbol", "t", r6("w1_rvol").alias("w1_rvol"), r6("m1_rvol").alias("m1_rvol"))


WELCH_SQL = (
    EVENT_SQL
    + LONG_SQL
    + """, q AS (SELECT *, CASE WHEN dpi10_pct >= 2 / 3 THEN 'high' WHEN dpi10_pct <= 1 / 3 THEN 'low' WHEN dpi10_pct IS NOT NULL THEN 'mid' END AS tc FROM lg),
a AS (SELECT horizon, count(ret) FILTER (tc = 'high') AS n1, avg(ret) FILTER (tc = 'high') AS m1, var_samp(ret) FILTER (tc = 'high') AS v1, count(ret) FILTER (tc = 'low') AS n2, avg(ret) FILTER (tc = 'low') AS m2, var_samp(ret) FILTER (tc = 'low') AS v2,
  avg(ret) FILTER (tc = 'mid') AS mid_mean, avg(coalesce(CAST(ret > 0 AS DOUBLE), 0)) FILTER (tc = 'high') AS high_up, avg(coalesce(CAST(ret > 0 AS DOUBLE), 0)) FILTER (tc = 'low') AS low_up, count(*) FILTER (tc = 'high') AS high_n, count(*) FILTER (tc = 'low') AS low_n FROM q GROUP BY horizon)
SELECT horizon, high_n, low_n, round(m1, 6) + 0.0 AS high_mean, round(mid_mean, 6) + 0.0 AS mid_mean, round(m2, 6) + 0.0 AS low_mean, round(high_up, 6) + 0.0 AS high_up, round(low_up, 6) + 0.0 AS low_up,
  CASE WHEN n1 >= 3 AND n2 >= 3 THEN round(m1 - m2, 6) + 0.0 END AS spread, CASE WHEN n1 >= 3 AND n2 >= 3 THEN round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) + 0.0 END AS t_stat,
  CASE WHEN n1 >= 3 AND n2 >= 3 THEN round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 6) + 0.0 END AS df FROM a"""
)
SPREAD = ("high_mean", "mid_mean", "low_mean", "high_up", "low_up", "spread", "t_stat", "df")


@query("tercile_spread", WELCH_SQL)
def tercile_spread(spark, d):
    return N.tercile_spread(study(spark, d)).select("horizon", "high_n", "low_n", *(r6(c).alias(c) for c in SPREAD))


WELCH_P_SQL = WELCH_SQL.replace("\nSELECT horizon, high_n", "\n, wl AS (SELECT horizon, high_n", 1) + "), tt AS (SELECT horizon, spread, t_stat AS t, df, spread AS sp, t_stat FROM (SELECT horizon, (m1 - m2) AS spread, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t_stat, pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS df FROM a WHERE n1 >= 3 AND n2 >= 3))" + P_SQL + "SELECT horizon, round(spread, 6) + 0.0 AS spread, round(t_stat, 6) + 0.0 AS t_stat, round(p, 6) + 0.0 AS p FROM tp"


@query("welch_p", WELCH_P_SQL)
def welch_p(spark, d):
    return N.with_p(N.tercile_spread(study(spark, d))).filter("t_stat is not null").select("horizon", r6("spread").alias("spread"), r6("t_stat").alias("t_stat"), r6("p").alias("p"))


@query("horizon_rollup", EVENT_SQL + LONG_SQL + "SELECT horizon, count(*) AS n, round(corr(dpi10, ret), 6) + 0.0 AS r FROM lg WHERE dpi10 IS NOT NULL AND ret IS NOT NULL GROUP BY horizon HAVING count(*) >= 5")
def horizon_rollup(spark, d):
    return N.horizon_rollup(study(spark, d)).select("horizon", "n", r6("r").alias("r"))


@query(
    "correlation_p",
    EVENT_SQL + LONG_SQL + ", tt AS (SELECT horizon, n, r, n - 2 AS df, r * sqrt((n - 2) / (1 - r * r)) AS t FROM (SELECT horizon, count(*) AS n, corr(dpi10, ret) AS r FROM lg WHERE dpi10 IS NOT NULL AND ret IS NOT NULL GROUP BY horizon HAVING count(*) >= 5))" + P_SQL + "SELECT horizon, n, round(r, 6) + 0.0 AS r, round(p, 6) + 0.0 AS p FROM tp",
)
def correlation_p(spark, d):
    return N.correlation_p(N.horizon_rollup(study(spark, d))).select("horizon", "n", r6("r").alias("r"), r6("p").alias("p"))


@query(
    "quintiles",
    EVENT_SQL
    + """, o AS (SELECT dpi10 AS x, m1_ret AS y FROM ev WHERE dpi10 IS NOT NULL), c AS (SELECT quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) AS c FROM o)
SELECT CAST(len(list_filter(c, lambda q: round(q, 9) < x)) + 1 AS INTEGER) AS quintile, count(*) AS n, round(avg(x), 6) + 0.0 AS x_mean, round(avg(y), 6) + 0.0 AS y_mean FROM o, c GROUP BY ALL""",
)
def quintiles(spark, d):
    return N.quintiles(study(spark, d), "dpi10", "m1_ret").select("quintile", "n", r6("x_mean").alias("x_mean"), r6("y_mean").alias("y_mean"))


@query(
    "corr_cuts",
    EVENT_SQL
    + """, o AS (SELECT *, year(report_date) AS y FROM ev WHERE dpi10 IS NOT NULL AND m1_ret IS NOT NULL), m AS (SELECT floor(quantile_cont(y, 0.5)) AS mid FROM o),
x AS (SELECT dpi10, m1_ret, unnest([{'cut': 'year', 'value': CAST(y AS VARCHAR)}, {'cut': 'timing', 'value': timing}, {'cut': 'name', 'value': symbol},
  {'cut': 'cohort', 'value': CASE WHEN symbol IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5') THEN 'in' ELSE 'out' END}, {'cut': 'half', 'value': CASE WHEN y <= mid THEN 'early' ELSE 'late' END}]) AS c FROM o, m)
SELECT c.cut AS cut, c.value AS value, count(*) AS n, round(corr(dpi10, m1_ret), 6) + 0.0 AS r FROM x GROUP BY ALL HAVING count(*) >= 8""",
)
def corr_cuts(spark, d):
    return N.correlation_cuts(study(spark, d), COHORT).select("cut", "value", "n", r6("r").alias("r"))


CUTS_SQL = """, cx AS (SELECT dpi10, m1_ret, next_day_ret, unnest([{'cut': 'year', 'value': CAST(year(report_date) AS VARCHAR)}, {'cut': 'timing', 'value': timing},
  {'cut': 'cohort', 'value': CASE WHEN symbol IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5') THEN 'in' ELSE 'out' END}]) AS c FROM ev),
cg AS (SELECT c.cut AS cut, c.value AS value, count(dpi10) AS n, count(*) FILTER (dpi10 IS NOT NULL AND m1_ret IS NOT NULL) AS na, count(*) FILTER (dpi10 IS NOT NULL AND next_day_ret IS NOT NULL) AS nb, corr(dpi10, m1_ret) AS a, corr(dpi10, next_day_ret) AS b FROM cx GROUP BY ALL),
cu AS (SELECT cut, value, n, unnest([{'kind': 'm1', 'n': na, 'r': CASE WHEN na >= 5 AND NOT isnan(a) THEN a END}, {'kind': 'next', 'n': nb, 'r': CASE WHEN nb >= 5 AND NOT isnan(b) THEN b END}]) AS c FROM cg),
tt AS (SELECT cut, value, n AS size, c.kind AS kind, c.r AS r, c.n - 2 AS df, c.r * sqrt((c.n - 2) / nullif(1 - c.r * c.r, 0)) AS t FROM cu)"""


@query(
    "study_cuts",
    EVENT_SQL + CUTS_SQL + P_SQL + "SELECT cut, value, max(size) AS n, " + ", ".join(f"round(max(r) FILTER (kind = '{k}'), 6) + 0.0 AS {k}_r, round(max(CASE WHEN r IS NOT NULL THEN p END) FILTER (kind = '{k}'), 6) + 0.0 AS {k}_p" for k in ("m1", "next")) + " FROM tp GROUP BY cut, value",
)
def study_cuts(spark, d):
    return N.cut_relations(study(spark, d), COHORT).select("cut", "value", "n", *(r6(c).alias(c) for c in ("m1_r", "m1_p", "next_r", "next_p")))


@query(
    "paths",
    EVENT_SQL
    + """, k AS (SELECT symbol, quantile_cont(dpi10, 1 / 3) AS a, quantile_cont(dpi10, 2 / 3) AS b, count(dpi10) AS c FROM ev GROUP BY symbol),
cs AS (SELECT ev.symbol, base, report_date, CASE WHEN c >= 6 AND dpi10 IS NOT NULL THEN CASE WHEN dpi10 >= round(b, 9) THEN 'hi' WHEN dpi10 <= round(a, 9) THEN 'lo' ELSE 'mid' END END AS cls FROM ev JOIN k USING (symbol)),
p AS (SELECT symbol, t, adjclose AS v FROM panel), w AS (SELECT cs.symbol, report_date, cls, s.s AS k, CAST(round_even((q.v / o.v - 1) * 10000, 0) AS INTEGER) AS bp
  FROM cs JOIN p o ON o.symbol = cs.symbol AND o.t = base, range(0, 4) s(s) JOIN p q ON q.symbol = cs.symbol AND q.t = base + s.s),
f AS (SELECT *, count(*) OVER (PARTITION BY symbol, report_date) AS c FROM w)
SELECT symbol, CAST(k AS INTEGER) AS k, count(*) AS n, round(avg(bp), 6) + 0.0 AS mean_bp, round(median(bp), 6) + 0.0 AS median_bp, CASE WHEN count(*) FILTER (cls = 'hi') >= 3 THEN round(avg(bp) FILTER (cls = 'hi'), 6) + 0.0 END AS hi_bp,
  CASE WHEN count(*) FILTER (cls = 'lo') >= 3 THEN round(avg(bp) FILTER (cls = 'lo'), 6) + 0.0 END AS lo_bp,
  count(*) FILTER (bp > 0) AS up FROM f WHERE c = 4 GROUP BY ALL HAVING count(*) >= 2""",
)
def paths(spark, d):
    out = N.path_rollup(study(spark, d), A.panel(spark, d), 3, 2)
    return out.select("symbol", "k", "n", *(r6(c).alias(c) for c in ("mean_bp", "median_bp", "hi_bp", "lo_bp")), "up")


RELATION_SQL = (
    ", wx AS ("
    + " UNION ALL ".join(f"SELECT '{w}' AS \"window\", '{n}' AS horizon, {w} AS x, {w}_pct AS pct, {n}_ret AS y FROM ev WHERE {w} IS NOT NULL AND {n}_ret IS NOT NULL" for w in ("dpi5", "dpi10") for n, _ in H)
    + """), wr AS (SELECT *, rank() OVER (PARTITION BY "window", horizon ORDER BY x) + (count(*) OVER (PARTITION BY "window", horizon, x) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY "window", horizon ORDER BY y) + (count(*) OVER (PARTITION BY "window", horizon, y) - 1) / 2 AS ry FROM wx),
wg AS (SELECT "window", horizon, count(*) AS n, corr(x, y) AS a, corr(rx, ry) AS b, corr(pct, y) AS c FROM wr GROUP BY ALL HAVING count(*) >= 5),
wc AS (SELECT "window", horizon, n, unnest([{'kind': 'pearson', 'r': a}, {'kind': 'spearman', 'r': b}, {'kind': 'within', 'r': c}]) AS c FROM wg),
tt AS (SELECT "window", horizon, n, c.kind AS kind, c.r AS r, n - 2 AS df, c.r * sqrt((n - 2) / nullif(1 - c.r * c.r, 0)) AS t FROM wc)"""
)


@query(
    "study_relations",
    EVENT_SQL + RELATION_SQL + P_SQL + """SELECT "window", horizon, max(n) AS n, """ + ", ".join(f"round(max(r) FILTER (kind = '{k}'), 6) + 0.0 AS {k}, round(max(p) FILTER (kind = '{k}'), 6) + 0.0 AS {k}_p" for k in ("pearson", "spearman", "within")) + """ FROM tp GROUP BY "window", horizon""",
)
def study_relations(spark, d):
    out = N.relations(study(spark, d)).filter("n >= 5")
    return out.select("window", "horizon", "n", *(r6(c).alias(c) for k in ("pearson", "spearman", "within") for c in (k, f"{k}_p")))


@query(
    "study_summary",
    EVENT_SQL
    + LONG_SQL
    + """, hz AS (SELECT horizon, avg(ret) AS mean, median(ret) AS median, stddev_samp(ret) AS std, avg(CAST(ret > 0 AS DOUBLE)) AS positive, corr(dpi10, ret) AS r_dpi10, corr(dpi5, ret) AS r_dpi5 FROM lg GROUP BY horizon),
al AS (SELECT 'horizon' AS section, horizon AS item, metric, value FROM hz UNPIVOT INCLUDE NULLS (value FOR metric IN (mean, median, std, positive, r_dpi10, r_dpi5))
  UNION ALL SELECT 'sample', 'all', 'events', CAST(count(*) AS DOUBLE) FROM ev UNION ALL SELECT 'sample', 'all', 'names', CAST(count(DISTINCT symbol) AS DOUBLE) FROM ev
  UNION ALL SELECT 'sample', 'all', 'with_data', CAST(count(dpi10) AS DOUBLE) FROM ev UNION ALL SELECT 'timing', timing, 'events', CAST(count(*) AS DOUBLE) FROM ev GROUP BY timing)
SELECT section, item, metric, round(value, 6) + 0.0 AS value FROM al""",
)
def study_summary(spark, d):
    return N.summary(study(spark, d)).select("section", "item", "metric", r6("value").alias("value"))
