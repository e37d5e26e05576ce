"""Readers of landed raw files. All of them are lazy and declare their schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowlens import schema as Z
from flowlens.operators.panel import normal_symbol

#: Fixed value: what a listed symbol looks like.
SYMBOL = r"^[A-Z][A-Z0-9.\-]{0,6}$"


def parse_volumes(lines: DataFrame) -> DataFrame:
    """(symbol, d, short, total, at) from lines (value, path, at): the date is in the file's name.

    Headers, footers and lines with under five fields or unreadable numbers go;
    of a symbol's lines for a day the last one stays, by file time, then line order.
    """
    parts = F.split("value", r"\|")
    rows = lines.withColumn("_p", parts).withColumn("place", F.monotonically_increasing_id()).filter(F.size("_p") >= 5)
    rows = rows.select(
        F.trim(F.get("_p", 1)).alias("symbol"), F.to_date(F.regexp_extract("path", r"(\d{8})\.[A-Za-z]+$", 1), "yyyyMMdd").alias("d"),
        F.expr("try_cast(get(_p, 2) as double)").alias("short"), F.expr("try_cast(get(_p, 4) as double)").alias("total"), "at", "place",
    )
    rows = rows.filter("symbol <> '' and d is not null and short is not null and total is not null")
    last = W.partitionBy("symbol", "d").orderBy(F.desc("at"), F.desc("place"))
    return rows.withColumn("_r", F.row_number().over(last)).filter("_r = 1").select("symbol", "d", "short", "total", "at")


def volume_lines(raw: DataFrame) -> DataFrame:
    """Text lines with their file and its time."""
    return raw.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("at"))


def daily_volumes(spark: SparkSession, path: str, floor: str = "2018-08-01") -> DataFrame:
    """Off-exchange volume files, pipe-delimited, one per day, from the history floor on."""
    return parse_volumes(volume_lines(spark.read.text(path))).filter(F.col("d") >= F.lit(floor).cast("date")).drop("at")


def price_bars(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, d, close, adjclose, volume) from chart documents; the symbol is in the document or the file's name."""
    doc = spark.read.schema(Z.PRICE_FILE).json(path, multiLine=True).select("*", F.col("_metadata.file_name").alias("_f"))
    one = doc.select(F.explode("chart.result").alias("r"), "_f")
    quote, adjusted = F.get("r.indicators.quote", F.lit(0)), F.get("r.indicators.adjclose", F.lit(0))
    name = F.coalesce("r.meta.symbol", F.regexp_extract("_f", r"^(.*)\.json$", 1))
    rows = one.select(normal_symbol(name).alias("symbol"), F.posexplode(F.arrays_zip(F.col("r.timestamp").alias("ts"), quote["close"].alias("close"), quote["volume"].alias("volume"))).alias("i", "z"), adjusted["adjclose"].alias("_a"))
    rows = rows.select("symbol", "i", F.to_date(F.timestamp_seconds("z.ts")).alias("d"), F.nanvl("z.close", F.lit(None)).alias("close"), F.coalesce(F.get("_a", F.col("i")), "z.close").alias("adjclose"), F.col("z.volume").cast("double").alias("volume"))
    rows = rows.filter("close is not null or adjclose is not null or volume is not null")
    last = W.partitionBy("symbol", "d").orderBy(F.desc("i"))
    return rows.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r", "i")


def earnings_dates(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, report_date, timing) from a CSV with header; timing defaults to amc."""
    df = spark.read.csv(path, header=True)
    timing = F.lower(F.trim("timing")) if "timing" in df.columns else F.lit(None).cast("string")
    return df.select(normal_symbol("ticker").alias("symbol"), F.expr("try_cast(report_date as date)").alias("report_date"), F.coalesce(timing, F.lit("amc")).alias("timing")).filter("report_date is not null")


def filings(spark: SparkSession, first: str, more: str | None = None) -> DataFrame:
    """(path, form, filing_date, items, accepted) from filing documents: recent blocks, and continuation files with arrays at the root."""
    arrays = ("form", "filingDate", "items", "acceptanceDateTime")
    recent = spark.read.schema(Z.FILING_FILE).json(first, multiLine=True).select(F.col("_metadata.file_name").alias("path"), *(F.col(f"filings.recent.{a}").alias(a) for a in arrays))
    if more is not None:
        older = spark.read.schema(Z.FILING_ARRAYS).json(more, multiLine=True).select(F.col("_metadata.file_name").alias("path"), *arrays)
        recent = recent.unionByName(older)
    rows = recent.select("path", F.explode(F.arrays_zip(*arrays)).alias("z"))
    return rows.select("path", "z.form", F.expr("try_cast(z.filingDate as date)").alias("filing_date"), "z.items", F.try_to_timestamp("z.acceptanceDateTime").alias("accepted"))


def earnings_candidates(rows: DataFrame) -> DataFrame:
    """8-K filings with item 2.02: local date and timing; without a readable time the filing date and no timing."""
    from flowlens.operators.earnings import classify_timing

    day, timing = classify_timing(F.col("accepted"))
    own = rows.filter(F.col("form").startswith("8-K") & F.col("items").contains("2.02"))
    return own.withColumn("report_date", F.coalesce(day, "filing_date")).withColumn("timing", F.when(F.col("accepted").isNull(), "").otherwise(timing))


def company_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, cik) from a JSON object of objects; the number is padded to ten digits."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, struct<ticker:string, cik_str:bigint>>").alias("m"))
    rows = doc.select(F.explode(F.map_values("m")).alias("z"))
    return rows.select(normal_symbol("z.ticker").alias("symbol"), F.format_string("CIK%010d", F.col("z.cik_str")).alias("cik"))


def with_numbers(wanted: DataFrame, numbers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols with their number, symbols that have none)."""
    return wanted.join(numbers, "symbol"), wanted.join(numbers, "symbol", "left_anti")


def holdings_csv(spark: SparkSession, path: str) -> DataFrame:
    """(fund, symbol, place): equity rows below the line that begins with ``Ticker,``; each symbol where it came first.

    A holdings file is read whole: it is a small document, and its preamble has no fixed length.
    """
    doc = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1).alias("fund"), F.split(F.replace("value", F.lit("\r")), "\n").alias("l"))
    head = F.array_position(F.transform("l", lambda x: x.startswith("Ticker,")), F.lit(True)).cast("int")
    rows = doc.withColumn("_h", head).filter("_h > 0").select("fund", F.get("l", F.col("_h") - 1).alias("_head"), F.posexplode(F.slice("l", F.col("_h") + 1, F.greatest(F.size("l") - F.col("_h"), F.lit(0)))).alias("place", "line"))
    cells = lambda c: F.transform(F.split(c, r',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda x: F.trim(F.regexp_replace(x, r'^\s*"|"\s*$', "")))
    rows = rows.withColumn("c", cells("line")).withColumn("h", cells("_head"))
    kind = F.get("c", (F.array_position("h", "Asset Class") - 1).cast("int"))
    rows = rows.withColumn("symbol", F.upper(F.get("c", F.lit(0)))).filter((F.lower(kind) == "equity") & F.col("symbol").rlike(SYMBOL))
    return rows.groupBy("fund", "symbol").agg(F.min("place").alias("place"))


def holdings_xml(spark: SparkSession, path: str, merge: dict[str, str] | None = None) -> DataFrame:
    """(fund, symbol, weight) from spreadsheet XML; stray ampersands are escaped, cells stand where their Index says.

    Files are read row by row at the rows' end tags, so a large one is split; the XML source itself takes a row tag,
    but loses the rows that hold a stray ampersand. Rows that are no XML all the same are left out.
    ``merge``: secondary share class to primary; weights add up.
    """
    fund = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1).alias("fund")
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))  # order within a file
    ended = spark.read.text(path, lineSep="Row>").select(fund, "value", place.alias("row")).filter(F.col("value").rlike(r"</(?:\w+:)?\z"))  # a row's cells, up to its end tag
    cells = F.regexp_replace(F.regexp_replace("value", r"(?s)\A.*<(?:\w+:)?Row\b[^>]*>|</(?:\w+:)?\z", ""), r"&(?!amp;|lt;|gt;|quot;|apos;|#)", "&amp;")
    rows = ended.select("fund", "row", F.from_xml(F.concat(F.lit("<Row>"), cells, F.lit("</Row>")), Z.XML_ROW, {"ignoreNamespace": "true"}).alias("x"))
    # the running cell index: a cell's own Index, or one after the cell before it
    after = lambda acc: F.coalesce(F.get(acc, F.size(acc) - 1)["i"], F.lit(0)) + 1
    step = lambda acc, c: F.array_append(acc, F.struct(F.coalesce(c["_Index"], after(acc)).alias("i"), F.trim(c["Data"]["_VALUE"]).alias("v")))
    rows = rows.select("fund", "row", F.aggregate(F.coalesce("x.Cell", F.array()), F.array().cast("array<struct<i:int,v:string>>"), step).alias("c"))
    cells = rows.select("fund", "row", F.explode("c").alias("z")).select("fund", "row", "z.i", "z.v")
    own = W.partitionBy("fund")
    heads = cells.withColumn("_h", F.min(F.when(F.col("v") == "Ticker", F.col("row"))).over(own))
    col = lambda test: F.max(F.when((F.col("row") == F.col("_h")) & test, F.col("i"))).over(own)
    heads = heads.withColumn("_t", col(F.col("v") == "Ticker")).withColumn("_k", col(F.col("v") == "Asset Class")).withColumn("_w", col(F.lower("v").startswith("weight")))
    at = lambda c: F.max(F.when(F.col("i") == F.col(c), F.col("v")))
    lines = heads.filter("row > _h").groupBy("fund", "row").agg(F.upper(F.trim(at("_t"))).alias("symbol"), F.lower(at("_k")).alias("kind"), F.expr("try_cast(replace(max(case when i = _w then v end), ',', '') as double)").alias("weight"))
    lines = lines.filter(F.col("symbol").rlike(SYMBOL) & (F.coalesce("kind", F.lit("equity")) == "equity"))
    for old, new in (merge or {}).items():
        lines = lines.withColumn("symbol", F.when(F.col("symbol") == old, new).otherwise(F.col("symbol")))
    return lines.groupBy("fund", "symbol").agg(F.sum("weight").alias("weight"))


def event_table(spark: SparkSession, path: str) -> DataFrame:
    """The event table as :func:`flowlens.sources.sinks.write_events` wrote it, read again for reports."""
    return spark.read.csv(path, header=True, schema=Z.EVENT_TABLE, enforceSchema=False)


def ticker_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct symbols of a plain list, separated by blanks or commas."""
    return spark.read.text(path).select(F.explode(F.split(F.upper("value"), r"[\s,]+")).alias("symbol")).filter(F.col("symbol").rlike(SYMBOL)).distinct()


def wide_document(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(symbol, d, value) from a dates x symbols CSV; empty cells are left out."""
    df = spark.read.csv(path, header=True)
    first, *symbols = df.columns
    long = df.unpivot([first], symbols, "symbol", "_v")
    return long.select("symbol", F.to_date(first).alias("d"), F.expr("try_cast(_v as double)").alias(value)).filter(F.col(value).isNotNull())


def volume_table(spark: SparkSession, path: str, universe: str | None = None) -> DataFrame:
    """Accumulated volumes, partitioned by (universe, month)."""
    df = spark.read.parquet(path)
    return df if universe is None else df.filter(F.col("universe") == universe)


def latest_holdings(snapshots: DataFrame, today: Column | None = None) -> DataFrame:
    """Per fund the rows of its newest snapshot, on or before ``today``: last known good."""
    own = snapshots if today is None else snapshots.filter(F.col("snapshot_date") <= today)
    newest = own.groupBy("fund").agg(F.max("snapshot_date").alias("snapshot_date"))
    return own.join(newest, ["fund", "snapshot_date"], "left_semi")


def dimension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small static table from CSV: weights, sectors, funds, alias spans, first valid days, share classes."""
    return spark.read.csv(path, header=True, schema=schema)


def sector_of(symbols: DataFrame, static: DataFrame, from_funds: DataFrame) -> DataFrame:
    """Sector by the static table, else by the funds; also under the normalised symbol. Inputs: (symbol, sector)."""
    both = static.withColumn("_o", F.lit(0)).unionByName(from_funds.withColumn("_o", F.lit(1))).withColumn("_k", normal_symbol("symbol"))
    best = both.groupBy("_k").agg(F.min_by("sector", F.struct("_o", "sector")).alias("sector"))
    return symbols.withColumn("_k", normal_symbol("symbol")).join(best, "_k", "left").drop("_k")
