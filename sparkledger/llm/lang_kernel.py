"""Language by string kernel: which n-grams of 1 to 3 characters a text has, whatever their number (blended spectrum, presence).

The kernel of two texts is the share of n-grams they have in common (cosine of presence vectors). Nyström landmarks turn it into
a short vector, and ridge regression of each language against the rest scores it. All of it is matrix products over a batch of texts.

Learned on a bounded sample: at most ``SAMPLE`` documents a language, ``LANDMARKS`` of them as landmarks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import kept_table, ship_package

SAMPLE = 150
LANDMARKS = 160
SLOTS = 1 << 13
RIDGE = 0.01
LETTER = regex.compile(r"\p{L}")
BATCH = 128


def presence(texts: list[str]) -> np.ndarray:
    """A row of 0 and 1 per text: which slots its hashed n-grams of 1 to 3 code points take; n-grams never cross texts."""
    out = np.zeros((len(texts), SLOTS), np.float32)
    for row, text in enumerate(texts):
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        line = out[row]
        for at in range(0, len(points), 1 << 20):
            part = points[at : at + (1 << 20) + 2]
            h = np.zeros(len(part), np.uint64)
            for n in range(1, 4):
                if len(part) < n:
                    break
                h = h[: len(part) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + part[n - 1 :] + np.uint64(n)
                g = h ^ (h >> np.uint64(29))
                line[((g * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 13)).astype(np.int64)] = 1
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows * rows).sum(1, keepdims=True)), 1e-9)


@dataclass
class Kernel:
    langs: list[str]
    landmarks: np.ndarray  # slots x landmarks, unit columns
    map: np.ndarray  # landmarks x landmarks: the inverse root of their kernel matrix
    ridge: np.ndarray  # landmarks + 1 x languages

    def scores(self, texts: list[str]) -> np.ndarray:
        mapped = (unit(presence(texts)) @ self.landmarks) @ self.map
        return mapped @ self.ridge[:-1] + self.ridge[-1]


def fit(sample: list[tuple[str, str]]) -> Kernel | None:
    """From (language, text) pairs, in an order of their own; None without any."""
    langs = sorted({lang for lang, _ in sample})
    if not langs:
        return None
    x = unit(presence([t for _, t in sample]))
    y = np.array([[1.0 if lang == name else -1.0 for name in langs] for lang, _ in sample])
    chosen = np.unique(np.linspace(0, len(sample) - 1, min(LANDMARKS, len(sample))).astype(int))
    marks = x[chosen]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
    keep = values > 1e-6 * values.max()
    root = (vectors[:, keep] / np.sqrt(values[keep])) @ vectors[:, keep].T
    z = np.hstack([(x @ marks.T) @ root, np.ones((len(x), 1))])
    penalty = RIDGE * len(x) * np.eye(z.shape[1])
    penalty[-1, -1] = 0
    # Rare languages weigh as much as frequent ones.
    each = np.array([1 / sum(a == lang for a, _ in sample) for lang, _ in sample]) * len(x) / len(langs)
    solved = np.linalg.solve(z.T @ (z * each[:, None]) + penalty, z.T @ (y * each[:, None]))
    return Kernel(langs, np.ascontiguousarray(marks.T.astype(np.float32)), root.astype(np.float32), solved.astype(np.float32))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Kernel | None:
    """A kernel model from at most ``sample`` whole texts a language, first by a hash of their id; held-out rows and null or empty ones are not read."""
    rows = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit(5), id_col).alias("key")
    )
    # Spark keeps the first keys of each language in every task before it shuffles; texts stay where they are.
    first = W.partitionBy("lang").orderBy("key", "text")
    keys = rows.select("lang", "key").withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("key"))).filter(F.col("n") <= sample)
    # ``sample`` keys a language, written, so that Spark knows their size: it sends them to the texts while they are small, and joins by key beyond.
    chosen = kept_table(keys.select("lang", "key").distinct(), "sample")
    near = rows.join(chosen, ["lang", "key"], "left_semi").withColumn("n", F.row_number().over(first))
    found = near.filter(F.col("n") <= sample).orderBy("key", "lang", "text").select("lang", "text").collect()
    return fit([(r.lang, r.text) for r in found])


def identify(docs: DataFrame, model: Kernel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) per row; the score is the softmax of the one-versus-rest values.

    ``und`` with score 0 for null texts, texts without a letter, and without a model. Whole texts are read; repeated rows give a row
    each; an empty table gives an empty one. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                texts = [t or "" for t in part.column(1).to_pylist()]
                names, values = ["und"] * len(texts), [0.0] * len(texts)
                which = [i for i, t in enumerate(texts) if LETTER.search(t)] if model else []
                if which:
                    raw = np.exp(4 * model.scores([texts[i] for i in which]).astype(float))
                    shares = raw / raw.sum(1, keepdims=True)
                    for i, best, row in zip(which, shares.argmax(1), shares, strict=True):
                        names[i], values[i] = model.langs[best], float(row[best])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(values, pa.float64())], names=[id_col, "lang_pred", "score"])

    ship_package(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")
