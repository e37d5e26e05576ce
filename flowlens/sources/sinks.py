"""Writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.schema import EVENT_TABLE


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header: residual panels, event tables, earnings dates."""
    df.write.mode("overwrite").csv(path, header=True)


def write_events(events: DataFrame, path: str) -> None:
    """The event table as CSV, with the columns of ``schema.EVENT_TABLE``."""
    names = [part.split()[0] for part in EVENT_TABLE.split(",")]
    write_csv(events.select(*names), path)


def pack(panel: DataFrame, value: str, digits: int = 4) -> DataFrame:
    """(symbol, vals): a symbol's values in session order, rounded; symbols without any go. A row holds one symbol's sessions."""
    entry = F.struct("t", F.round(value, digits).alias("v"))
    packed = panel.groupBy("symbol").agg(F.array_sort(F.collect_list(entry)).alias("_e"), F.count(value).alias("_n")).filter("_n > 0")
    return packed.select("symbol", F.transform("_e", lambda e: e["v"]).alias("vals"))


def write_payload(measures: dict[str, DataFrame], path: str) -> None:
    """JSON lines (measure, symbol, vals) of packed panels."""
    parts = [df.select(F.lit(name).alias("measure"), "symbol", "vals") for name, df in measures.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    both.write.mode("overwrite").partitionBy("measure").json(path)


def write_report(rollups: dict[str, DataFrame], path: str) -> None:
    """JSON lines (section, row) of the study's rollups."""
    parts = [df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("row")) for name, df in rollups.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    both.write.mode("overwrite").json(path)


def write_volumes(df: DataFrame, path: str, universe: str) -> None:
    """Append to the accumulated volumes, replacing the months that ``df`` has."""
    rows = df.withColumn("universe", F.lit(universe)).withColumn("month", F.date_format("d", "yyyy-MM"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("universe", "month").parquet(path)


def store_panel(panel: DataFrame, name: str, buckets: int = 64) -> None:
    """The panel as a table of the catalogue, in ``buckets`` by symbol, each sorted by session in one file.

    Windows and aggregations by symbol read it without a shuffle, whatever they
    are; so do joins of two panels of equal buckets on the symbol.
    """
    panel.repartition(buckets, "symbol").write.mode("overwrite").bucketBy(buckets, "symbol").sortBy("symbol", "t").saveAsTable(name)
