"""Tables between the rounds of a job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset a local session gets one of its own, and a cluster is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not getattr(context, "_sparkledger_folder", None):
        context._sparkledger_folder = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
    return context._sparkledger_folder


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: its plan ends there, and lost executors lose nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, each computed once per row.

    They come out of a generator, so that filters and columns behind it read them; those of a projection would be copied into every filter, and
    patterns matched again for each use. Columns of ``df`` with the same names are replaced.
    """
    made = F.inline(F.array(F.struct(*[c.alias(f"_made_{name}") for name, c in columns.items()])))
    kept = [F.col(c) for c in df.columns if c not in columns]
    return df.select(*kept, made).withColumnsRenamed({f"_made_{name}": name for name in columns})
