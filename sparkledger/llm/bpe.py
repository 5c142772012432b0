"""Byte-pair encoding of whole texts with a public vocabulary, and decoding.

A text is cut at white space, each chunk at the pattern of the vocabulary's tokenizer. A word is a doubly linked list of
symbols and a priority queue of the merges that its neighbours allow; a merge relinks the list and leaves stale
entries in the queue, which are skipped when they come up. Decoding concatenates the vocabulary's strings.

Every task works on its own rows. The vocabulary file is read once per Python worker; ids of words that
were met before come from a table of bounded size, which changes the time but never the result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import ship_package

END = "</w>"
# The special strings' ids are in the file; the pattern is the one the vocabulary was made with.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + SPACE + r"\p{L}\p{N}]+"
WORDS_KEPT = 300_000


def byte_names() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    shown = set(own)
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Encoder:
    """Vocabulary, merge ranks and the words met so far."""

    def __init__(self, path: str, words_kept: int = WORDS_KEPT):
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        vocab = made["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        by_id = {i: s for s, i in (vocab | self.special).items()}
        self.names = [by_id.get(i, "") for i in range(max(by_id) + 1)]
        self.ranks = {}
        for rank, pair in enumerate(made["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        names = byte_names()
        self.inner = [vocab[c] for c in names]
        self.last = [vocab[c + END] for c in names]
        self.piece = regex.compile(PIECE)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.space = regex.compile("[" + SPACE + "]+")
        self.words: dict[str, list[int]] = {}
        self.chunks: dict[str, list[int]] = {}
        self.words_kept = words_kept

    def word(self, data: bytes) -> list[int]:
        """Ids of one word: merges by rank, then by place."""
        n = len(data)
        ids = [self.inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        if n == 1:
            return ids
        ranks = self.ranks
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, left, right, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one of the two has been merged away since
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if r := ranks.get((new, ids[k])):
                    heapq.heappush(queue, (r[0], i, new, ids[k], r[1]))
            h = before[i]
            if h >= 0 and (r := ranks.get((ids[h], new))):
                heapq.heappush(queue, (r[0], h, ids[h], new, r[1]))
        return [i for i in ids if i >= 0]

    def plain(self, chunk: str) -> list[int]:
        """Ids of a chunk without white space and special strings."""
        normal = unicodedata.normalize("NFC", chunk)
        # Each character by itself, as the rule for a final sigma depends on its neighbours.
        normal = normal.lower() if "Σ" not in normal else "".join(c.lower() for c in normal)
        out: list[int] = []
        for piece in self.piece.findall(normal):
            got = self.words.get(piece)
            if got is None:
                got = self.word(piece.encode("utf-8"))
                if len(piece) < 64:
                    if len(self.words) >= self.words_kept:
                        self.words.clear()
                    self.words[piece] = got
            out += got
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        parts = self.split_special.split(text) if self.split_special and "<|" in text else [text]
        chunks = self.chunks
        for i, part in enumerate(parts):
            if i % 2:
                out.append(self.special[part])
                continue
            for chunk in self.space.split(part) if any(c in part for c in "\x1c\x1d\x1e\x1f") else part.split():
                got = chunks.get(chunk)
                if got is None:
                    got = self.plain(chunk)
                    if len(chunk) < 64:
                        if len(chunks) >= self.words_kept:
                            chunks.clear()
                        chunks[chunk] = got
                out += got
        return out

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's strings, joined as the file's decoder says: it names none, which means by one blank."""
        names = self.names
        return " ".join([names[i] for i in ids])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokens: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) per row, and ``ids`` where ``tokens`` is set.

    ``path`` is a vocabulary file that every worker can open. A null text is empty and has no ids. Repeated rows give a
    row each; very long texts and words are encoded whole (a word costs n log n); an empty table gives an empty one. Other
    columns of ``docs`` are not read.
    """
    fields = [f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}", "n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        own = encoder(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                counts, shas, decoded, lists = [], [], [], []
                for value in part.column(1):
                    ids = own.encode(value.as_py() or "")
                    packed = np.array(ids, dtype="<u4")
                    counts.append(len(ids))
                    shas.append(hashlib.sha256(packed.tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(own.decode(ids).encode("utf-8")).hexdigest())
                    if tokens:
                        lists.append(packed.astype("<i4"))
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if tokens:
                    columns.append(pa.array(lists, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    ship_package(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(run, ", ".join(fields + (["ids array<int>"] if tokens else [])))


def decode_tokens(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` plus ``out``, the text of the ids; null ids give null, no ids an empty text."""
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.functions import arrow_udf

    @arrow_udf("string")
    def decoded(ids: pa.Array) -> pa.Array:
        own = encoder(path)
        return pa.array([None if x is None else own.decode(x) for x in ids.to_pylist()], pa.string())

    ship_package(df.sparkSession)
    return df.withColumn(out, decoded(F.col(ids_col)))
