"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata of a text.

Every feature has a weight and a short vector; a pair of features adds the product of their values and vectors. The sum over all
pairs takes linear time: half of (square of the sum less sum of the squares), factor by factor.

Learned on a bounded sample of labelled rows (``SAMPLE`` of each label, by a hash of their id, never by their order).
Scoring is a pass over the rows with the model, a few hundred kilobytes whatever the corpus, in each task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .host_rules import text_counts
from .shared import ship_package
from .words import blocks, hashed_words

SAMPLE = 4000
WORD_BITS = 13
BINS = 12
RANK = 8
EPOCHS = 12
STATS = ("symbols", "capitals", "digits", "marks", "bars", "word_length", "dup_lines", "repeats", "lines", "distinct", "words", "chars")
N_WORDS = 1 << WORD_BITS
N_FEATURES = N_WORDS + len(STATS) * BINS


def _in(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


_CLASSES = {
    "symbols": _in("#*$%&<>@^~=_"),
    "capitals": _in("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "digits": _in("0123456789"),
    "marks": _in("!?.,;:"),
    "bars": _in("|/\\"),
}


def statistics(column: pa.Array) -> np.ndarray:
    """Structure and size of each text as numbers from 0 to 1, in the order of ``STATS``."""
    n = len(column)
    out = {name: np.zeros(n) for name in STATS}
    counts = dict(zip(("words", "chars", "symbols", "dup_lines", "repeats"), text_counts(column), strict=True))
    words = np.maximum(counts["words"], 1)
    for first, rows, data, offsets in blocks(column):
        here = slice(first, first + rows)
        size = np.maximum(np.diff(offsets), 1)
        for name, table in (*_CLASSES.items(), ("lines", _in("\n"))):
            sums = np.concatenate(([0], np.cumsum(table[data])))
            out[name][here] = (sums[offsets[1:]] - sums[offsets[:-1]]) / size
    for first, hashes, index in hashed_words(column):
        for row in range(len(index) - 1):
            own = hashes[index[row] : index[row + 1]]
            out["distinct"][first + row] = len(np.unique(own)) / max(1, len(own))
    out["word_length"] = np.minimum(counts["chars"] / words / 20, 1)
    out["dup_lines"] = np.minimum(counts["dup_lines"] * 10 / words, 1)
    out["repeats"] = counts["repeats"] / words
    out["words"] = np.minimum(np.log1p(counts["words"]) / 12, 1)
    out["chars"] = np.minimum(np.log1p(counts["chars"]) / 14, 1)
    # Shares of single characters are small; the root spreads them.
    return np.stack([out[s] if s in ("word_length", "repeats", "distinct", "words", "chars") else np.sqrt(np.minimum(out[s], 1)) for s in STATS], 1)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature numbers, values, index of each row's first): words with root counts, scaled to length 1, then one bin per statistic."""
    stats = statistics(column)
    bins = N_WORDS + np.arange(len(STATS)) * BINS + np.minimum((stats * BINS).astype(np.int64), BINS - 1)
    ids, values, index = [], [], [0]
    for first, hashes, starts in hashed_words(column):
        slots = (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        for row in range(len(starts) - 1):
            own, count = np.unique(slots[starts[row] : starts[row + 1]], return_counts=True)
            value = np.sqrt(count)
            value = value / max(np.sqrt((value**2).sum()), 1e-9)
            ids += [own, bins[first + row]]
            values += [value, np.full(len(STATS), 0.5)]
            index.append(index[-1] + len(own) + len(STATS))
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(1, np.int64)
    return np.concatenate(ids), np.concatenate(values), np.array(index)


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def logits(self, ids: np.ndarray, values: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic, and the sums of vectors that a training step needs. No row may be empty; none is, for the bins."""
        if len(index) == 1:
            return np.zeros(0), np.zeros((0, RANK))
        weighted = self.vectors[ids] * values[:, None]
        sums = np.add.reduceat(weighted, index[:-1], axis=0)
        squares = np.add.reduceat(weighted * weighted, index[:-1], axis=0)
        linear = np.add.reduceat(self.weights[ids] * values, index[:-1])
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(1), sums


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], shift: float, seed: int = 1) -> Machine:
    """Steps with adapted rates over batches of 64. ``shift`` moves the scores from the sample's share of labels to the true one."""
    random = np.random.default_rng(seed)
    labels = np.array([r[0] for r in rows], float)
    learns = len(set(labels)) > 1
    machine = Machine(0.0, np.zeros(N_FEATURES), random.normal(0, 0.02 if learns else 0.0, (N_FEATURES, RANK)))
    seen = [np.full(1, 1e-8), np.full(N_FEATURES, 1e-8), np.full((N_FEATURES, RANK), 1e-8)]
    for _ in range(EPOCHS if learns else 0):
        order = random.permutation(len(rows))
        for start in range(0, len(order), 64):
            chosen = [rows[i] for i in order[start : start + 64]]
            ids, values = np.concatenate([c[1] for c in chosen]), np.concatenate([c[2] for c in chosen])
            sizes = np.array([len(c[1]) for c in chosen])
            index = np.concatenate(([0], np.cumsum(sizes)))
            logits, sums = machine.logits(ids, values, index)
            error = (logistic(logits) - labels[order[start : start + 64]]) / len(chosen)
            of = np.repeat(np.arange(len(chosen)), sizes)
            pull = error[of] * values
            slots, where = np.unique(ids, return_inverse=True)
            by_weight = np.bincount(where, pull, len(slots)) + 1e-5 * machine.weights[slots]
            each = pull[:, None] * (sums[of] - machine.vectors[ids] * values[:, None])
            by_vector = np.stack([np.bincount(where, each[:, f], len(slots)) for f in range(RANK)], 1) + 1e-5 * machine.vectors[slots]
            seen[0] += error.sum() ** 2
            machine.bias -= 0.1 * error.sum() / np.sqrt(seen[0][0])
            seen[1][slots] += by_weight**2
            machine.weights[slots] -= 0.1 * by_weight / np.sqrt(seen[1][slots])
            seen[2][slots] += by_vector**2
            machine.vectors[slots] -= 0.05 * by_vector / np.sqrt(seen[2][slots])
    machine.bias += shift
    return Machine(machine.bias, machine.weights.astype(np.float32), machine.vectors.astype(np.float32))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Machine:
    """A machine from at most ``sample`` labelled rows of each label that are not held out.

    Both sides of the sample are bounded, so their join is a broadcast and their features come to the driver. Null labels and labels of
    unknown documents are left out; an id with several labels counts as its largest. Without labels every score is the share
    of label 1, or one half.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_label"))
    shares = dict(known.groupBy("_label").count().collect())
    order = F.xxhash64(F.lit(11), id_col)
    parts = [known.filter(F.col("_label") == v).orderBy(order, id_col).limit(sample) for v in (0, 1)]
    chosen = parts[0].unionByName(parts[1]).withColumnRenamed(id_col, "_id")
    texts = docs.select(id_col, F.col(text_col).alias("_text")).join(F.broadcast(chosen), F.col(id_col) == F.col("_id")).select("_label", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                ids, values, index = features(part.column(1))
                split = lambda x, kind, index=index: pa.ListArray.from_arrays(pa.array(index, pa.int32()), pa.array(x, kind))
                yield pa.RecordBatch.from_arrays([part.column(0), split(ids.astype(np.int32), pa.int32()), split(values, pa.float32())], names=["label", "ids", "amounts"])

    ship_package(docs.sparkSession)
    found = texts.mapInArrow(run, "label int, ids array<int>, amounts array<float>").toArrow()
    rows = [
        (label, np.asarray(ids.values, np.int64), np.asarray(values.values, float))
        for label, ids, values in zip(found.column(0).to_pylist(), found.column(1), found.column(2), strict=True)
    ]
    rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes()))  # the same machine however the rows arrive
    have = [sum(r[0] == v for r in rows) for v in (0, 1)]
    true = [shares.get(v, 0) for v in (0, 1)]
    odds = lambda n: np.log((n[1] + 1) / (n[0] + 1))
    return train(rows, odds(true) - (odds(have) if all(have) else 0.0))


def score_documents(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) per row; a null text scores like an empty one, repeated rows give a row each, an empty table an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                logits, _ = machine.logits(*features(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(logistic(logits), pa.float64())], names=[id_col, "score"])

    ship_package(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")


def filter_documents(docs: DataFrame, machine: Machine, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, as they stand; the texts move to Python and back once, and are not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                logits, _ = machine.logits(*features(part.column(part.schema.get_field_index(text_col))))
                yield part.filter(pa.array(logistic(logits) >= least))

    ship_package(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
