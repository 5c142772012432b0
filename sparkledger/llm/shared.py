"""Tables in the folder that driver and executors share, and the defaults for null columns."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The white space of the word and line rules: blank and the controls 09 to 0D.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
NOT_WORD = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset a local session gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context = spark.sparkContext  # the setting itself can't be changed in a running session
    if not getattr(context, "_sparkledger_folder", None):
        context._sparkledger_folder = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
    return context._sparkledger_folder


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Removes the folders of kept tables that nothing reads any more. What was made of them has to be written before."""
    for table in tables:
        for path in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            folder = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def numbered(df: DataFrame, order: list[Column], out: str, upto: Column | None = None) -> DataFrame:
    """Numbers rows from 1 over the whole table by ``order``, columns given by name; with ``upto``, numbers beyond it are null.

    Rows are cut into ranges of the order, written, and numbered within their range; a row per range carries the counts on.
    No window sees more than one range, and ranges that start beyond ``upto`` are not sorted at all.
    """
    placed = kept_table(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_count"))
    # One row for each range: as many as a shuffle has partitions.
    before = F.coalesce(F.sum("_count").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = kept_table(counts.select("_range", before.alias("_before")), "starts")
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    known = placed.join(F.broadcast(starts), "_range")
    limit = upto if upto is not None else F.lit(2**63 - 1)
    number = F.col("_before") + inside
    near = known.filter(F.col("_before") < limit).withColumn(out, number).withColumn(out, F.when(F.col(out) <= limit, F.col(out)))
    far = known.filter(F.coalesce(F.col("_before") >= limit, F.lit(True))).withColumn(out, F.lit(None).cast("bigint"))
    return near.unionByName(far).select(*df.columns, out)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; the plain ``lower`` does it where a text is ASCII only."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session, so that they need no installed copy."""
    context = spark.sparkContext
    if getattr(context, "_has_sparkledger", False):
        return
    package = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="package-")) / "sparkledger.zip"
    with zipfile.ZipFile(path, "w") as bundle:
        for file in sorted(package.rglob("*.py")):
            bundle.write(file, file.relative_to(package.parent))
    context.addPyFile(str(path))
    context._has_sparkledger = True
