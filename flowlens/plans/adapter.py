"""The driver's tables in the roles of the raw inputs, in Spark and, under the same names, as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowlens.functions.store import cut
from flowlens.operators import panel as P

BENCH = "Brand#1"


class Source:
    """The session during one query. The panel's facts are written once in it, so its many branches scan the lines once."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.read, self.range, self.facts = spark, spark.read, spark.range, {}


def table(spark: Source | SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: Source | SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, d, short, total, volume, close), a row per brand and day with lines: the volume and price files' part."""
    kept = getattr(spark, "facts", {})
    if sf_dir not in kept:
        kept[sf_dir] = cut(daily(spark, sf_dir))
    return kept[sf_dir]


def days(spark: Source | SparkSession, sf_dir: str) -> DataFrame:
    """Sessions: weekdays on which anything shipped."""
    return P.calendar(facts(spark, sf_dir).select("d").distinct().filter(F.weekday("d") < 5))


def daily(spark: Source | SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", F.to_date("l_shipdate").alias("d"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    q, flag = F.col("l_quantity"), F.col("l_returnflag")
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("symbol", "d").agg(
        F.sum(F.when(flag == "R", q).otherwise(0.0)).alias("short"),
        F.sum(F.when(flag.isin("R", "A"), q).otherwise(0.0)).alias("total"),
        F.sum(q).alias("volume"),
        (F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / F.sum(q)).alias("close"),
    )


def panel(spark: Source | SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, t, d, short, total, volume, close, adjclose, dpi), a row per brand and session with lines."""
    return P.with_sessions(facts(spark, sf_dir), days(spark, sf_dir)).withColumn("adjclose", F.col("close")).withColumn("dpi", P.dpi())


def grid(spark: Source | SparkSession, sf_dir: str) -> DataFrame:
    """The panel on every session, with ``dd``, the moving average of dpi."""
    return P.moving_average(P.grid(panel(spark, sf_dir), days(spark, sf_dir)), "dpi", "dd")


def weights(spark: Source | SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, weight): share of the retail price, in percent."""
    own = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("symbol")).agg(F.sum(F.col("p_retailprice").cast("decimal(18,2)")).cast("double").alias("w"))
    return own.select("symbol", (F.col("w") / F.sum("w").over(W.partitionBy()) * 100).alias("weight"))


def membership(spark: Source | SparkSession, sf_dir: str) -> DataFrame:
    """(fund, level, symbol): per part type the 12 brands with most parts, per size bucket of 10 the first 10."""
    part = table(spark, sf_dir, "part")
    sector = part.groupBy(F.col("p_type").alias("fund"), F.col("p_brand").alias("symbol")).agg(F.count("*").alias("n")).withColumn("level", F.lit("sector")).withColumn("most", F.lit(12))
    size = F.concat(F.lit("size"), F.floor(F.col("p_size") / 10).cast("string"))
    sub = part.groupBy(size.alias("fund"), F.col("p_brand").alias("symbol")).agg(F.count("*").alias("n")).withColumn("level", F.lit("subsector")).withColumn("most", F.lit(10))
    both = sector.unionByName(sub)
    first = F.row_number().over(W.partitionBy("level", "fund").orderBy(F.desc("n"), "symbol"))
    return both.withColumn("_r", first).filter("_r <= most").select("fund", "level", "symbol")


def reports(spark: Source | SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, report_date, timing): first order of each brand in each quarter."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.substring("o_orderpriority", 1, 1).alias("prio"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    own = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    first = own.groupBy("symbol", F.date_trunc("quarter", "day").alias("_q")).agg(F.min(F.struct("day", "prio")).alias("m"))
    timing = F.when(F.col("m.prio").isin("1", "2"), "amc").when(F.col("m.prio").isin("3", "4"), "bmo").otherwise("intraday")
    return first.select("symbol", F.col("m.day").alias("report_date"), timing.alias("timing"))


SQL = """
WITH cal AS (SELECT d, CAST(row_number() OVER (ORDER BY d) - 1 AS INTEGER) AS t
  FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem) WHERE isodow(d) <= 5),
panel0 AS (SELECT p_brand AS symbol, cal.t, cal.d,
    sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS short,
    sum(CASE WHEN l_returnflag IN ('R', 'A') THEN l_quantity ELSE 0 END) AS total, sum(l_quantity) AS volume,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) / sum(l_quantity) AS close
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN cal ON cal.d = CAST(l_shipdate AS DATE) GROUP BY ALL),
panel AS (SELECT *, close AS adjclose, CASE WHEN total <> 0 THEN greatest(0.0, least(1.0, short / total)) END AS dpi FROM panel0),
grid0 AS (SELECT s.symbol, cal.t, cal.d, short, total, volume, close, adjclose, dpi
  FROM (SELECT DISTINCT symbol FROM panel) s CROSS JOIN cal LEFT JOIN panel USING (symbol, t)),
grid AS (SELECT *, avg(dpi) OVER (PARTITION BY symbol ORDER BY t RANGE BETWEEN 4 PRECEDING AND CURRENT ROW) AS dd FROM grid0)
"""


def fwd(h: int, table: str = "panel", price: str = "adjclose", part: str = "symbol") -> str:
    """SQL of the return over exactly h sessions."""
    return f"first({price}) OVER (PARTITION BY {part} ORDER BY t RANGE BETWEEN {h} FOLLOWING AND {h} FOLLOWING) / nullif({price}, 0) - 1"


DIX_SQL = """
, sums AS (SELECT t, sum(close * short) AS s, sum(close * total) AS dd_, count(*) AS n FROM panel WHERE symbol <> 'Brand#1' GROUP BY t),
daily AS (SELECT cal.t, cal.d, s, dd_, coalesce(n, 0) AS n FROM cal LEFT JOIN sums USING (t)),
usual AS (SELECT *, CASE WHEN count(*) OVER w >= 10 THEN list_aggregate(list(n) OVER w, 'quantile_cont', 0.5) ELSE 0 END AS u FROM daily
  WINDOW w AS (ORDER BY t RANGE BETWEEN 62 PRECEDING AND CURRENT ROW)),
dix AS (SELECT t, d, n, CASE WHEN n >= 5 AND n >= 0.6 * u AND dd_ <> 0 THEN greatest(0.0, least(1.0, s / nullif(dd_, 0))) END AS dix FROM usual)
"""

MEMBER_SQL = """
, counts AS (SELECT p_type AS fund, p_brand AS symbol, count(*) AS n, 'sector' AS level, 12 AS most FROM part GROUP BY ALL
  UNION ALL SELECT concat('size', CAST(floor(p_size / 10) AS BIGINT)), p_brand, count(*), 'subsector', 10 FROM part GROUP BY ALL),
membership AS (SELECT fund, level, symbol FROM (SELECT *, row_number() OVER (PARTITION BY level, fund ORDER BY n DESC, symbol) AS r FROM counts) WHERE r <= most)
"""

REPORT_SQL = """
, firsts AS (SELECT p_brand AS symbol, min(struct_pack(day := CAST(o_orderdate AS DATE), prio := substr(o_orderpriority, 1, 1))) AS m
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY p_brand, date_trunc('quarter', o_orderdate)),
reports AS (SELECT symbol, m.day AS report_date, CASE WHEN m.prio IN ('1', '2') THEN 'amc' WHEN m.prio IN ('3', '4') THEN 'bmo' ELSE 'intraday' END AS timing FROM firsts),
civil AS (SELECT CAST(unnest(generate_series((SELECT min(d) FROM cal), (SELECT max(d) FROM cal), INTERVAL 1 DAY)) AS DATE) AS day),
ahead AS (SELECT day, min(t) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t, d IS NOT NULL AS exact FROM civil LEFT JOIN cal ON day = d)
"""
