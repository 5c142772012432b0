"""Line dedup: lines that many documents share stay in one of them.

Lines are exploded and hashed, distinct documents are counted per hash, and the lines over the threshold
leave every document but the last that holds them. Only (hash, id, position) rows are shuffled; a text moves
at most once, to meet the positions that it loses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BLANKS, kept_table, lower_ascii


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 40) -> DataFrame:
    """(id, of, at, h1, h2): a row for each line whose key is long enough, with a 128-bit hash of the key.

    ``of`` is a hash of the whole text; with the id it tells rows apart that repeat an id.
    """
    lines = docs.filter(F.col(id_col).isNotNull() & (F.length(text_col) >= least_chars)).select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("of"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("at", "line")
    )
    keyed = lines.filter(F.length("line") >= least_chars).select("id", "of", "at", line_key(F.col("line")).alias("key"))
    return keyed.filter(F.length("key") >= least_chars).select(
        "id", "of", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(17), "key").alias("h2")
    )


def dropped_lines(lines: DataFrame, least_docs: int = 5) -> DataFrame:
    """(id, of, drops): the sorted positions that each document loses.

    The count of distinct documents is combined before both shuffles, so a line in a third of all documents
    is no hot task. The join back is a plain sort-merge join, which adaptive execution cuts at hot hashes.
    """
    common = (
        lines.groupBy("h1", "h2")
        .agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper"))
        .filter(F.col("n") >= least_docs)
        .select("h1", "h2", "keeper")
    )
    lost = lines.join(common, ["h1", "h2"]).filter(F.col("id") != F.col("keeper"))
    return lost.groupBy("id", "of").agg(F.array_sort(F.collect_set("at")).alias("drops"))


def without(lines: Column, drops: Column) -> Column:
    """``lines`` without the sorted positions ``drops``: the stretches between them, each copied once."""
    ends = F.concat(drops, F.array(F.size(lines)))
    stretches = F.transform(
        ends,
        lambda end, i: F.slice(
            lines,
            F.when(i == 0, F.lit(1)).otherwise(F.get(drops, i - 1) + 2),
            F.when(i == 0, end).otherwise(end - F.get(drops, i - 1) - 1),
        ),
    )
    return F.flatten(stretches)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """``docs`` plus ``n_lines``, ``n_dropped`` and ``kept`` (the text that stays).

    A key of at least ``least_chars`` code points in at least ``least_docs`` distinct ids loses all its lines
    except in the largest id that holds it. A null or empty text is one empty line. Rows without an id neither
    count nor lose lines. Rows that repeat an id count as one document. Columns of ``docs`` named like the three results are replaced; other
    columns pass. Empty tables give empty tables.
    """
    found = kept_table(shared_lines(docs, id_col, text_col, least_chars), "lines")
    lost = dropped_lines(found, least_docs)
    # As a struct, so that no column of the documents can clash with those of the other side.
    base = docs.drop("n_lines", "n_dropped", "kept")
    doc = lambda name: F.col("doc").getField(name)
    rows = base.select(F.struct(*[base[c] for c in base.columns]).alias("doc"))
    joined = rows.join(lost, (doc(id_col) == F.col("id")) & (F.xxhash64(doc(text_col)) == F.col("of")), "left")
    text = F.coalesce(doc(text_col), F.lit(""))
    lines = F.split(text, "\n", -1)
    return joined.select(
        *[doc(c).alias(c) for c in base.columns],
        F.size(lines).cast("bigint").alias("n_lines"),
        F.coalesce(F.array_size("drops"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("drops").isNull(), text).otherwise(F.array_join(without(lines, F.col("drops")), "\n")).alias("kept"),
    )
