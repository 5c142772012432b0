"""Quality rules by host: a document is judged by its own rules and by how its host's documents fare.

Rule failures are summed by host, each host's failure rate is shrunk towards the rate of all hosts with a beta
prior fitted to the hosts themselves (method of moments), and the verdict joins back to the documents.
Texts are read once; only a row of counts per document is kept and joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import kept_table, ship_package
from .words import blocks, hashed_words, runs, word_spans

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: np.ndarray) -> int:
    """Words in a run of three that the text holds twice or more."""
    if len(words) < 4:
        return 0
    grams = runs(words, 3)
    _, where, count = np.unique(grams, return_inverse=True, return_counts=True)
    again = count[where] > 1
    covered = np.zeros(len(words), bool)
    for j in range(3):
        covered[j : j + len(grams)] |= again
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def text_counts(column: pa.Array) -> list[np.ndarray]:
    """The counts of ``COUNTS`` for each text; characters are code points."""
    out = [np.zeros(len(column), np.int64) for _ in COUNTS]
    for first, rows, data, offsets in blocks(column):
        solid = np.zeros(len(data) + 1, np.int64)
        # A byte that continues a code point is none of its own.
        starts, ends = word_spans(data, offsets)
        lead = (data & 0xC0) != 0x80
        np.cumsum(lead, out=solid[1:])
        chars = solid[ends] - solid[starts]
        index = np.searchsorted(starts, offsets)
        sums = np.concatenate(([0], np.cumsum(chars)))
        symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
        here = slice(first, first + rows)
        out[0][here] = np.diff(index)
        out[1][here] = sums[index[1:]] - sums[index[:-1]]
        out[2][here] = symbols[offsets[1:]] - symbols[offsets[:-1]]
    for row, text in enumerate(column):
        out[3][row] = repeated_lines(text.as_py() or "")
    # Case counts here, so words are compared as they stand.
    for first, words, index in hashed_words(column, fold=False):
        for row in range(len(index) - 1):
            out[4][first + row] = repeated_words(words[index[row] : index[row + 1]])
    return out


def counted(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(id, host, counts) per row."""
    kinds = {c: docs.schema[c].dataType.simpleString() for c in (id_col, host_col)}
    schema = f"`{id_col}` {kinds[id_col]}, `{host_col}` {kinds[host_col]}, " + ", ".join(f"{c} bigint" for c in COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = text_counts(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, counts)], names=[id_col, host_col, *COUNTS])

    ship_package(docs.sparkSession)
    return docs.select(id_col, host_col, text_col).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def soft_failures(most_symbols: float, most_dup_lines: float, mean_word: tuple[float, float]) -> Column:
    """How many of the softer rules a document fails: symbols per word, repeated lines per word, mean word length."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    mean = F.col("word_chars") / n
    rules = (F.col("n_symbols") > most_symbols * n, F.col("n_dup_lines") > most_dup_lines * n, ~mean.between(*mean_word))
    return sum((r.cast("int") for r in rules[1:]), rules[0].cast("int"))


def host_rates(docs: DataFrame, host_col: str, failed: Column) -> DataFrame:
    """(host, n, failures, rate): failure rates shrunk by the beta prior that fits the hosts' own rates.

    The prior's mean is the overall rate; its weight comes from the variance between hosts, less what chance gives. Hosts
    that differ no more than by chance share one rate.
    """
    hosts = docs.groupBy(host_col).agg(F.count(F.lit(1)).alias("n"), F.sum(failed.cast("bigint")).alias("failures"))
    p = F.col("failures") / F.col("n")
    sums = hosts.agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("all"), F.sum("failures").alias("bad"), F.sum(F.col("n") * p * p).alias("squares"), F.sum(F.col("n") * F.col("n")).alias("nn")
    )
    mean = F.col("bad") / F.col("all")
    spread = F.col("squares") - F.col("all") * mean * mean
    effective = F.col("all") - F.col("nn") / F.col("all")
    between = (spread - (F.col("k") - 1) * mean * (1 - mean)) / effective
    weight = F.when((effective > 0) & (between > 0), F.greatest(mean * (1 - mean) / between - 1, F.lit(1.0))).otherwise(F.lit(1e12))
    prior = sums.select(F.coalesce(mean, F.lit(0.0)).alias("mean"), F.coalesce(weight, F.lit(1e12)).alias("weight"))
    # One row on the other side.
    return hosts.join(F.broadcast(prior)).select(
        host_col, "n", "failures", ((F.col("failures") + F.col("mean") * F.col("weight")) / (F.col("n") + F.col("weight"))).alias("rate")
    )


def judge_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    worst_rate: float = 0.5,
    most_symbols: float = 0.3,
    most_dup_lines: float = 0.05,
    mean_word: tuple[float, float] = (2.5, 14.0),
) -> DataFrame:
    """(id, host, counts, base_failed, soft_failures, host_rate, kept) per row.

    A document that fails a base rule goes. Of the others, one that fails a softer rule goes if its host's shrunk failure
    rate is over ``worst_rate``, or if it fails two of them; a document that fails none stays whatever its host.
    Null and empty texts have no words and fail; null hosts are one host; repeated rows give a row each; an empty table gives an
    empty one. Other columns of ``docs`` are not read, whatever their names.
    """
    rows = kept_table(counted(docs, id_col, text_col, host_col), "rules")
    soft = soft_failures(most_symbols, most_dup_lines, mean_word)
    rows = rows.withColumn("base_failed", base_failed()).withColumn("soft_failures", soft)
    rates = host_rates(rows, host_col, F.col("base_failed") | (F.col("soft_failures") > 0)).select(F.col(host_col).alias("_host"), F.col("rate").alias("host_rate"))
    # Few columns on both sides; a host with a third of all rows is split by the adaptive join.
    joined = rows.join(rates, F.col(host_col).eqNullSafe(F.col("_host")), "left").drop("_host")
    allowed = F.when(F.col("host_rate") > worst_rate, 0).otherwise(1)
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("soft_failures") <= allowed))
