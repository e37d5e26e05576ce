"""Tables written on the way, in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only on one machine (a local master: tests, a laptop) is one made below the
    temporary folder where the session names none; on a cluster that is an
    error, since executors would write to disks of their own.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="flowlens-checkpoints-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(path)
    return path


def cut(df: DataFrame, codec: str | None = None, parts: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there; the table is deleted when the application ends.

    ``parts``: files of a small table, which later jobs then need not open by the dozen.

    A Parquet table rather than ``checkpoint()``: later reads prune columns and
    see row counts, and a lost executor costs nothing that is already written.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"cut-{uuid.uuid4().hex}")
    out = (df.repartition(parts) if parts else df).write
    (out.option("compression", codec) if codec else out).parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
