"""Grouping the spelling variants of a corpus' words by an index of variable-length grams.

A gram dictionary is pruned by frequency: it holds the grams that stand at more places of the words than a limit. A word is cut
at every position into the shortest gram that is not in the dictionary (or has the longest length allowed), so the frequent grams of short
words grow longer and no list gets long. A gram depends on its own characters alone: one edit touches only the grams across its place.
The most grams that any place has is the word's bound of affected grams.

Words of n letters meet words of n and of n + 1 letters in class n, all cut by the longest length of that class. Two words one edit apart
share all grams before the edit at the same start, and all behind it at a start moved by the difference in length. Among a word's grams in
an order that all words share, the rarest first, only as many as the bound and one more have their lists merged: one of them is shared by both
words' parts. What meets in a list is verified by its edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, kept_table, ship_package

LEAST_LENGTH = 6
LEAST_COUNT = 5
TIMES = 5  # a form is so many times as frequent as its variant
SHORTEST, LONGEST = 2, 8  # lengths of grams
LIMIT = 32  # places of a gram that stays out of the dictionary
SHARE = 18  # a dictionary has 2^SHARE grams of a length at most: in a larger vocabulary the limit rises
FLUSH = 200_000  # words that a task counts before it sends them on
RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST_LENGTH)
TO_LOWER = str.maketrans(UPPER, LOWER)


def counted_runs(docs: DataFrame, id_col: str, text_col: str, modulus: int | None) -> DataFrame:
    """(word, n): partial counts of the runs of all texts; runs that the id and the modulus choose lose a character first."""

    def sent(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                found = Counter(map(itemgetter(0), RUN.finditer(text.as_py() or "")))
                start = zlib.crc32(f"{name.as_py() or ''}:".encode())
                for word, n in found.items():
                    word = word.translate(TO_LOWER)
                    if modulus:
                        h = zlib.crc32(word.encode(), start)
                        if h % modulus == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < LEAST_LENGTH:
                                continue
                    counts[word] += n
                if len(counts) > FLUSH:
                    yield sent(counts)
                    counts = Counter()
        yield sent(counts)

    return docs.select(F.col(id_col).cast("string"), text_col).mapInArrow(run, "word string, n bigint")


def longest_gram(n: int) -> int:
    """The longest gram of class ``n``: half of it, so that a gram is always left on one side of an edit."""
    return max(SHORTEST, min(LONGEST, n // 2))


def gram_dictionary(words: DataFrame) -> dict[str, int]:
    """The grams shorter than ``LONGEST`` that stand at more places than the limit, with their counts.

    The limit grows with the words, so the driver gets ``(LONGEST - SHORTEST) * 2^SHARE`` grams at most. It only decides how long
    grams are; no word and no pair is lost by it.
    """
    places = words.agg(F.coalesce(F.sum(F.length("word")), F.lit(0)).alias("n")).first()["n"]
    limit = max(LIMIT, places >> SHARE)
    starts = F.sequence(F.lit(1), F.length("word") - F.col("q") + 1)
    sized = words.select("word", F.explode(F.sequence(F.lit(SHORTEST), F.least(F.length("word"), F.lit(LONGEST - 1)))).alias("q"))
    grams = sized.select(F.explode(F.transform(starts, lambda p: F.substring(F.col("word"), p, F.col("q")))).alias("gram"))
    return {r.gram: r.n for r in grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).collect()}


def cut_word(word: str, longest: int, known: dict[str, int]) -> list[tuple[int, int]]:
    """(start, end) of the gram at each position: the shortest out of the dictionary, of ``longest`` characters, or up to the word's end."""
    out = []
    for start in range(len(word) - SHORTEST + 1):
        end = start + SHORTEST
        while end < len(word) and end - start < longest and word[start:end] in known:
            end += 1
        out.append((start, end))
    return out


def most_affected(grams: list[tuple[int, int]], n: int) -> int:
    """The most grams that one edit can touch: those across one place. An insertion touches no more than a change beside it."""
    across = np.zeros(n + 1, np.int64)
    for start, end in grams:
        across[start] += 1
        across[end] -= 1
    return int(np.cumsum(across).max(initial=0))


def merged_grams(word: str, longest: int, known: dict[str, int]) -> list[tuple[int, str]]:
    """(start, gram) of those grams of a word whose lists are merged."""
    grams = cut_word(word, longest, known)
    take = most_affected(grams, len(word)) + 1
    named = [(known.get(word[s:e], 0), zlib.crc32(word[s:e].encode()), word[s:e], s) for s, e in grams]
    return [(s, gram) for _, _, gram, s in sorted(named)[:take]]


def index_rows(words: DataFrame, known: dict[str, int]) -> DataFrame:
    """(key, side, word, n): the lists of the index. Side 0 has words of a class' own length, 1 the same moved on by one place, 2 the longer words."""
    shared = words.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams_known = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                made = []
                for i, word in enumerate(part.column(0).to_pylist()):
                    for n in range(max(LEAST_LENGTH, len(word) - 1), len(word) + 1):
                        for at, gram in merged_grams(word, longest_gram(n), grams_known):
                            made += [(n, at + (side == 1), gram, side, i) for side in ((0, 1) if n == len(word) else (2,))]
                classes, places, grams, sides, of = zip(*made, strict=True) if made else ((),) * 5
                rows = part.take(pa.array(of, pa.int64()))
                columns = [pa.array(classes, pa.int32()), pa.array(places, pa.int32()), pa.array(grams, pa.string()), pa.array(sides, pa.int8()), rows.column(0), rows.column(1)]
                yield pa.RecordBatch.from_arrays(columns, names=["class", "at", "gram", "side", "word", "n"])

    made = words.select("word", "n").mapInArrow(run, "class int, at int, gram string, side tinyint, word string, n bigint")
    # Equal hashes may join two lists; what meets in one is verified.
    return made.select(F.xxhash64("class", "at", "gram").alias("key"), "side", "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """(a, an, b, bn): each pair of words one edit apart, once."""
    rows = kept_table(index_rows(words, gram_dictionary(words)), "grams")
    left = rows.filter("side < 2").select("key", F.col("side").alias("s"), F.col("word").alias("a"), F.col("n").alias("an"))
    right = rows.filter("side <> 1").select("key", F.col("side").alias("t"), F.col("word").alias("b"), F.col("n").alias("bn"))
    longer = F.length("b") - F.length("a")
    sides = ((F.col("t") == 2) & (longer == 1)) | ((F.col("s") == 0) & (F.col("t") == 0) & (longer == 0) & (F.col("a") < F.col("b")))
    near = (left["key"] == right["key"]) & sides & (F.levenshtein("a", "b", 1) == 1)
    return left.join(right, near).select("a", "an", "b", "bn").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: where following forms ends. Every round doubles the steps."""
    steps = kept_table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        made = kept_table(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        steps = made.select("word", "root")
        if made.filter("moved").isEmpty():
            return steps


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int | None = None) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of ``LEAST_LENGTH`` letters and ``LEAST_COUNT`` occurrences or more.

    Words are maximal runs of A-Z, a-z and the letters from U+00C0 to U+00FF (with the two signs among them), A-Z in lower case. ``n_near``
    counts the words one insertion, deletion or replacement apart; the most frequent of them (ties: the least in code points) is the form if it
    is ``TIMES`` times as frequent; the root is where forms end, the word itself if it has none. With ``modulus``, runs whose CRC-32 with
    the id it divides lose a character first (a null id counts as empty). Null and empty texts have no words; rows that repeat an id count each.
    An empty table gives an empty one. Other columns are not read, whatever their names.
    """
    ship_package(docs.sparkSession)
    counts = counted_runs(docs, id_col, text_col, modulus).groupBy("word").agg(F.sum("n").alias("n"))
    words = kept_table(counts.filter((F.col("n") >= LEAST_COUNT) & (F.length("word") >= LEAST_LENGTH)), "words")
    pairs = kept_table(near_words(words), "near")
    ways = pairs.union(pairs.select("b", "bn", "a", "an")).toDF("word", "n", "near", "near_n")
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near"))).alias("best")
    met = ways.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.first("n").alias("_n"), best)
    fits = -F.col("best.rank") >= TIMES * F.col("_n")
    formed = kept_table(met.select("word", "n_near", F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.rank")).alias("form_n")), "forms")
    ends = roots(formed.filter("form is not null"))
    out = words.join(formed, "word", "left").join(ends, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
