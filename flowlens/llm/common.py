"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.store import cut, shared_dir

__all__ = ["BLANKS", "aside", "cut", "row_hash", "shared_dir", "table", "words"]

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column | str) -> Column:
    """Words of a text, split at ASCII white space only; null gives none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def aside(docs: DataFrame, *needed: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with all columns but the first of each name ``needed`` renamed by their place, and the names in order.

    So no name of a caller's is in an operator's way, whatever it is;
    ``.select(*names).toDF(*docs.columns)`` gives the columns their own again.
    """
    names = [c if c in needed and docs.columns.index(c) == k else f"_c{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*names), names


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns; those that hold maps, which have no hash, count as JSON."""
    quoted = {f.name: F.col(f"`{f.name}`") for f in df.schema.fields}
    return F.xxhash64(*(F.to_json(F.struct(quoted[f.name])) if "map<" in f.dataType.simpleString() else quoted[f.name] for f in df.schema.fields))
