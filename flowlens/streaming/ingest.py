"""Incremental day-file ingest: new files only, a day replaces its predecessor.

The file source's checkpoint says which files are new. A micro-batch accepts a
day if it is not stored yet, or stored empty and among the last ``recheck`` days;
older days are final. Of several rows for a symbol and day the newest file's stays. The
store is partitioned by day and overwritten for the accepted days only, so a
batch that runs twice leaves the same table. No state is kept, so no watermark
is needed; ``today`` is a parameter, which makes replays agree.

Derived columns are kept in a second store. A day's frames look ``reach`` sessions back, so
a batch changes those of its days and of the sessions up to ``reach`` after them: these
days' partitions are replaced, from the raw partitions of ``reach`` sessions before on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowlens.functions.rolling import trailing
from flowlens.operators import panel as P
from flowlens.sources.files import parse_volumes, volume_lines

STORE = "symbol string, short double, total double, d date"


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The store, empty before the first batch. A day without rows is stored as one row without a symbol."""
    try:
        return spark.read.schema(STORE).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], STORE)


def volumes(store: DataFrame) -> DataFrame:
    """The stored rows proper."""
    return store.filter("symbol is not null")


def accept(batch_days: DataFrame, store: DataFrame, today: str, recheck: int = 6) -> DataFrame:
    """Days of a batch that may be written."""
    have = store.groupBy("d").agg(F.count("symbol").alias("_n"))
    old = F.col("_n").isNotNull() & ~((F.col("_n") == 0) & (F.col("d") >= F.date_sub(F.lit(today).cast("date"), recheck)))
    return batch_days.join(have, "d", "left").filter(~old).select("d")


def derive(rows: DataFrame, reach: int = 252, width: int = 5) -> DataFrame:
    """(symbol, dpi, dd, seen, share, d) of raw rows, with ``t`` numbered over their own days.

    ``dd`` is the mean of the last ``width`` sessions, ``share`` the part of the
    ``seen`` values of the last ``reach`` sessions that are no greater than the day's own.
    """
    sessions = P.with_sessions(rows, P.calendar(rows)).withColumn("dpi", P.dpi())
    both = trailing(P.moving_average(sessions, "dpi", "dd", width), ["symbol"], "dpi", reach, seen="seen", up_to="_le", by_sessions=True)
    return both.select("symbol", "dpi", "dd", "seen", (F.col("_le") / F.when(F.col("seen") > 0, F.col("seen"))).alias("share"), "d")


def refresh(spark: SparkSession, path: str, derived: str, changed: list, reach: int = 252) -> None:
    """Replace the derived partitions that ``changed`` days reach; days without rows are no sessions.

    Equal to deriving the whole store anew, as the tests show; it reads at most
    2 * reach sessions more than lie between the first and the last changed day.
    """
    first, last = min(changed), max(changed)
    days = volumes(stored(spark, path)).select("d").distinct()
    after = [r["d"] for r in days.filter(F.col("d") > last).orderBy("d").limit(reach - 1).collect()]
    before = [r["d"] for r in days.filter(F.col("d") < first).orderBy(F.desc("d")).limit(reach - 1).collect()]
    low, high = min([*before, first]), max([*after, last])
    rows = volumes(stored(spark, path)).filter(F.col("d").between(low, high))
    out = derive(rows, reach).filter(F.col("d") >= first)
    out.repartition("d").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("d").parquet(derived)


def merge_batch(lines: DataFrame, path: str, today: str, recheck: int = 6, derived: str | None = None, reach: int = 252) -> None:
    """Write the accepted days of one micro-batch of text lines (value, path, at), a file a day, and then what follows from them.

    Derived days are those of the whole batch, accepted now or in an earlier try, so a batch that failed between the two stores ends well.
    """
    spark = lines.sparkSession
    rows = parse_volumes(lines).drop("at")
    day = F.to_date(F.regexp_extract("path", r"(\d{8})\.[A-Za-z]+$", 1), "yyyyMMdd")
    days = lines.select(day.alias("d")).filter("d is not null").distinct()
    named = [r["d"] for r in days.collect()]  # a day a file, so ``files_per_batch`` at most; only these partitions are looked up
    ok = accept(days, stored(spark, path).filter(F.col("d").isin(named)), today, recheck)
    out = ok.join(rows, "d", "left").select("symbol", "short", "total", "d")
    out.repartition("d").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("d").parquet(path)
    if derived and named:
        refresh(spark, path, derived, named, reach)


def ingest(spark: SparkSession, source: str, path: str, checkpoint: str, today: str, recheck: int = 6, files_per_batch: int = 100, derived: str | None = None, reach: int = 252) -> StreamingQuery:
    """Start the stream over all files that are there now, and end. ``derived``: the store of derived columns, if one is kept."""
    raw = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(source)
    lines = volume_lines(raw)
    return lines.writeStream.foreachBatch(lambda df, _: merge_batch(df, path, today, recheck, derived, reach)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
