"""Where a row stands in its file and in its table: numbers from counts per split and their running sums.

A file may be read in many splits by many tasks. Each split numbers its own rows as it reads them; one row per split carries the counts
on, so no row moves to be numbered and no file has to fit into a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPLIT = ("file_time", "source_file", "file_start")


def with_file_columns(rows: DataFrame) -> DataFrame:
    """Adds the file of each row, the time it was last changed and the place where the row's split begins. ``rows`` comes straight from a file
    source, as a table or as a stream."""
    return rows.select(
        "*",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_modification_time").alias("file_time"),
        F.col("_metadata.file_block_start").alias("file_start"),
    )


def with_positions(rows: DataFrame, line: str = "line_no", seq: str | None = None, after=None) -> DataFrame:
    """Adds ``line``, the row's number in its file from 1, and with ``seq`` its number over all files in the order of their times and names.

    ``rows`` has the columns of :func:`with_file_columns` and nothing has moved or dropped rows since they were read. Numbers do not depend on
    how files were cut into splits. With ``after``, a column or number, ``seq`` counts on from it. The running sums see one row for each split.
    """
    marked = rows.withColumn("_at", F.monotonically_increasing_id())
    counts = marked.groupBy(*SPLIT).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = lambda w: F.coalesce(F.sum("_rows").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = counts.select("source_file", "file_start", "_first", before(W.partitionBy("source_file").orderBy("file_start")).alias("_lines"), before(W.orderBy(*SPLIT)).alias("_seqs"))
    inside = F.col("_at") - F.col("_first") + 1
    out = marked.join(sums, ["source_file", "file_start"]).withColumn(line, F.col("_lines") + inside)
    if seq:
        start = F.lit(0) if after is None else (after if not isinstance(after, int) else F.lit(after))
        out = out.withColumn(seq, (start + F.col("_seqs") + inside).cast("bigint"))
    return out.select(*rows.columns, line, *([seq] if seq else []))


def number_kept(rows: DataFrame, out: str, after: int = 0, split: tuple[str, ...] = SPLIT, place: str = "line_no") -> DataFrame:
    """Contiguous numbers from ``after`` + 1 for those rows of a read that were kept, in the order of their splits and places.

    Each split is numbered by itself, so a window holds the rows of one split at most; one row per split carries the counts on.
    """
    inside = F.row_number().over(W.partitionBy(*split).orderBy(place))
    counts = rows.groupBy(*split).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(W.orderBy(*split).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = counts.select(*split, before.alias("_before"))
    joined = rows.withColumn("_inside", inside).join(sums, list(split))
    return joined.withColumn(out, (F.lit(after) + F.col("_before") + F.col("_inside")).cast("bigint")).select(*rows.columns, out)
