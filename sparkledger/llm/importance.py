"""Resampling towards a target distribution by importance weights over hashed word n-grams.

The pre-tokeniser of the tokenizers library (a regular expression Split, nothing trained) gives the words of the lower-cased text with
their offsets. Windows of one to three offset pairs are the features; the CRC of a window follows from the CRCs and lengths of its words,
so no n-gram text is built. The buckets of all documents and of all target texts make two histograms, their smoothed log ratio is the gain of
a bucket, and a document weighs the sum of its gains. Gumbel noise from the id turns the best weights into a draw without replacement.

The buckets of a document are kept once, as the differences of their sorted numbers, so texts are cut only once.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import PreTokenizedString, Regex
from tokenizers.pre_tokenizers import Split

from .shared import kept_table, numbered, ship_package

BUCKETS = 10_000
LONGEST = 3  # words of a window
PIECE = 1 << 20  # bytes of a text that are cut into words at a time
WORDS = r"[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+"
#: Words of up to so many bytes go through the tables below, longer ones through zlib.
SHORT = 48


def _byte_table() -> np.ndarray:
    """What CRC-32 does with one byte, for each of the 256 low bytes."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


def _shift_tables(one: np.ndarray) -> np.ndarray:
    """[n, k, v]: the CRC whose k-th byte is v and whose others are 0, after n zero bytes."""
    out = np.empty((SHORT + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(SHORT):
        out[n + 1] = one[out[n] & np.uint32(255)] ^ (out[n] >> np.uint32(8))
    return out


ONE = _byte_table()
SHIFT = _shift_tables(ONE)


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each span of ``data``."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    at, longest = starts[order], int(sizes.max(initial=0))
    sums = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    # Spans by falling size: those with a j-th byte are the first ones.
    counts = len(sizes) - np.cumsum(np.bincount(np.minimum(sizes, SHORT), minlength=SHORT + 1))
    for j in range(min(longest, SHORT)):
        n = counts[j]
        part = sums[:n]
        sums[:n] = ONE[(part ^ data[at[:n] + j]) & 255] ^ (part >> np.uint32(8))
    out = np.empty_like(sums)
    out[order] = sums ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(sizes > SHORT):
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    return out


def followed(before: np.ndarray, crcs: np.ndarray, sizes: np.ndarray, word) -> np.ndarray:
    """The CRCs of texts with CRC ``before``, a blank, and the words with these CRCs and sizes; ``word(i)`` gives the bytes of a long one."""
    blank = ONE[((before ^ np.uint32(0xFFFFFFFF)) ^ np.uint32(32)) & np.uint32(255)] ^ ((before ^ np.uint32(0xFFFFFFFF)) >> np.uint32(8))
    spaced = blank ^ np.uint32(0xFFFFFFFF)
    near = np.minimum(sizes, SHORT)
    moved = crcs.copy()
    for k in range(4):
        moved ^= SHIFT[near, k, (spaced >> np.uint32(8 * k)) & np.uint32(255)]
    for i in np.flatnonzero(sizes > SHORT):
        moved[i] = zlib.crc32(word(i), int(spaced[i]))
    return moved


def pieces(data: bytes) -> Iterator[bytes]:
    """A text in pieces that end at a blank or another byte outside words."""
    at = 0
    while at < len(data):
        stop = min(len(data), at + PIECE)
        while stop < len(data) and not (data[stop] < 0x30 or 0x3A <= data[stop] <= 0x60 or 0x7B <= data[stop] <= 0x7F):
            stop += 1
        yield data[at:stop]
        at = stop


def offset_pairs(split: Split, data: bytes) -> np.ndarray:
    """The first and last byte offsets of the words, as the pre-tokeniser gives them."""
    found = []
    at = 0
    for piece in pieces(data):
        cut = PreTokenizedString(piece.decode())
        split.pre_tokenize(cut)
        pairs = [pair for _, pair, _ in cut.get_splits(offset_referential="original", offset_type="byte")]
        found.append(np.array(pairs, np.int64).reshape(-1, 2) + at)
        at += len(piece)
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def text_buckets(split: Split, text: str | None, buckets: int, longest: int) -> tuple[int, np.ndarray]:
    """The count of words of a text, and the sorted buckets of all its features."""
    data = (text or "").encode().lower()  # bytes: only A-Z change
    pairs = offset_pairs(split, data)
    if len(pairs) == 0:
        return 0, np.zeros(0, np.uint16)
    raw = np.frombuffer(data, np.uint8)
    starts, ends = pairs[:, 0], pairs[:, 1]
    sizes, crcs = ends - starts, word_crcs(raw, starts, ends)
    windows, parts = crcs, [crcs % buckets]
    for n in range(1, min(longest, len(crcs))):
        windows = followed(windows[:-1], crcs[n:], sizes[n:], lambda i, n=n: raw[starts[i + n] : ends[i + n]])
        parts.append(windows % buckets)
    return len(crcs), np.sort(np.concatenate(parts).astype(np.uint16))


def bucket_table(docs: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(id, n_words, n_features, steps): per row the differences of its sorted bucket numbers, 16 bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Split(Regex(WORDS), "removed", invert=True)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                words, features, steps = [], [], []
                for text in part.column(1):
                    n, found = text_buckets(split, text.as_py(), buckets, longest)
                    words.append(n)
                    features.append(len(found))
                    steps.append(np.diff(found, prepend=np.uint16(0)).astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(words, pa.int64()), pa.array(features, pa.int64()), pa.array(steps, pa.binary())], names=["id", "n_words", "n_features", "steps"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_words bigint, n_features bigint, steps binary")


def unpacked(steps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps, "<u2"), dtype=np.int64)


def histogram(table: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows fall into each bucket; a task sends ``buckets`` rows at most, the driver gets as many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for steps in batch.column(0):
                counts += np.bincount(unpacked(steps.as_py()), minlength=buckets)
        filled = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array(counts[filled], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in table.select("steps").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket: thousandths of the log ratio of the target's share to the raw one, each bucket counted once more, rounded down."""
    all_raw, all_target, more = int(raw.sum()), int(target.sum()), len(raw)
    ratio = lambda s, t: math.log(float((t + 1) * (all_raw + more)) / float((s + 1) * (all_target + more)))
    return np.array([math.floor(1000 * ratio(s, t)) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def noise(seed: int, name: str) -> int:
    """Thousandths of a Gumbel variate that the seed and the id fix, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(table: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """(id, n_words, n_features, weight, score) of a bucket table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [int(gain[unpacked(steps.as_py())].sum()) for steps in batch.column(4)]
            scores = [w + noise(seed, name) for w, name in zip(weights, batch.column(1).to_pylist(), strict=True)]
            columns = [batch.column(0), batch.column(2), batch.column(3), pa.array(weights, pa.int64()), pa.array(scores, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "n_features", "weight", "score"])

    name = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    kind = table.schema["id"].dataType.simpleString()
    return table.select("id", name, "n_words", "n_features", "steps").mapInArrow(run, f"id {kind}, n_words bigint, n_features bigint, weight bigint, score bigint")


def share(percent: int, count: Column) -> Column:
    return F.floor(F.lit(percent) * count / 100)


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 5,
    least_words: int = 20,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    buckets: int = BUCKETS,
) -> DataFrame:
    """(id, n_features, weight, score, rank) per row: ``percent`` of the rows with ``least_words`` words or more are drawn, ranked from 1.

    ``target`` is a table of texts from the wanted distribution. Higher scores are drawn first, ties by the smaller id; rows that repeat an id
    have one noise and follow their weights. A null id draws as the text "null" and comes first among equal scores. Null, empty and
    wordless texts have no features and weigh 0. Without target texts all gains follow the raw counts alone; an empty table gives an empty
    one. Other columns of both tables are not read, whatever their names. ``buckets`` may be 65,535 at most.
    """
    ship_package(docs.sparkSession)
    table = kept_table(bucket_table(docs, id_col, text_col, buckets), "features")
    wanted = bucket_table(target.select(F.lit(0).alias("_id"), target_col), "_id", target_col, buckets)
    gain = gains(histogram(table, buckets), histogram(wanted, buckets))
    rows = kept_table(scored(table, gain, seed), "scores")
    able = rows.filter(F.col("n_words") >= least_words)
    drawn = able.agg(share(percent, F.count(F.lit(1)))).scalar()
    ranked = numbered(able, [F.desc("score"), F.asc_nulls_first("id"), F.desc("weight"), F.col("n_features")], "rank", drawn)
    others = rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(others).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
