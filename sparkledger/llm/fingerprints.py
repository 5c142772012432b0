"""Bottom-k sketches of shingle hashes: the k smallest distinct hashes of a text.

The sketch of a whole is the k smallest of its parts' sketches, so sketches merge across rows, files and
days. Two sketches give the resemblance and containment of their texts, one gives the count of its distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import NOT_WORD, bound, lower_ascii, text_or_empty

K = 128
WORDS = 5
# xxhash64 is spread evenly over all longs, from the least to the largest.
LEAST, RANGE = float(-(2**63)), float(2**64)


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of the runs of ``words`` words (A-Z in lower case); a shorter text is one run, an empty one has none."""
    parts = F.transform(F.filter(F.split(lower_ascii(text), NOT_WORD), lambda w: w != ""), lambda w: F.xxhash64(w))
    return bound(parts, lambda p: F.when(F.size(p) == 0, F.array().cast("array<bigint>")).otherwise(_runs(p, words)))


def _runs(parts: Column, words: int) -> Column:
    starts = F.sequence(F.lit(0), F.greatest(F.size(parts) - words, F.lit(0)))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(parts, i + j) for j in range(words)]))


def smallest(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """The bottom-k sketch of a text: at most ``k`` hashes, ascending."""
    return smallest(shingle_hashes(text, words), k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_sketches(df: DataFrame, keys: list[str], sketch_col: str, k: int = K, salts: int = 64) -> DataFrame:
    """One sketch per key over any number of rows. Salted first, so that no task holds all rows of a hot key."""
    longs = df.select(*keys, F.pmod(F.xxhash64(sketch_col), F.lit(salts)).alias("_salt"), F.explode(sketch_col).alias("_h")).distinct()
    for part in ([*keys, "_salt"], keys):
        ranked = longs.withColumn("_rank", F.row_number().over(W.partitionBy(*part).orderBy("_h")))
        longs = ranked.filter(F.col("_rank") <= k).drop("_rank")
        if "_salt" in part:
            longs = longs.drop("_salt").distinct().withColumn("_salt", F.lit(0))
    return longs.groupBy(*keys).agg(F.array_sort(F.collect_list("_h")).alias(sketch_col))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity, 0 to 1; two empty sketches are alike."""
    def of(both: Column) -> Column:
        common = F.size(F.array_intersect(F.array_intersect(both, a), b))
        return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(common / F.size(both).cast("double"))

    return bound(merged(a, b, k), of)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has, 0 to 1; an empty ``a`` is contained."""
    whole = bound(merged(a, b, k), lambda both: distinct_shingles(both, k))
    share = resemblance(a, b, k) * whole / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(share, F.lit(1.0)))


def distinct_shingles(sketch_: Column, k: int = K) -> Column:
    """Estimated count of distinct shingles; exact while the sketch is not full."""
    largest = (F.element_at(sketch_, -1).cast("double") - F.lit(LEAST)) / F.lit(RANGE)
    return F.when(F.size(sketch_) < k, F.size(sketch_).cast("double")).otherwise((k - 1) / largest)


def as_text(sketch_: Column) -> Column:
    """The sketch as hexadecimal text, 16 digits a hash."""
    return F.array_join(F.transform(sketch_, lambda h: F.lpad(F.hex(h), 16, "0")), "")


#: Bytes of text that a range of ids holds, about.
RANGE_BYTES = 64 << 20


def cuts_of(docs: DataFrame, id_col: str, parts: int) -> list:
    """At most ``parts`` - 1 ids that cut the table into ranges of about as many rows, for ids of any type that can be ordered."""
    ids = docs.select(F.col(id_col).alias("id")).filter("id is not null")
    least = ids.repartitionByRange(parts, "id").groupBy(F.spark_partition_id().alias("part")).agg(F.min("id").alias("cut"))
    return sorted({row["cut"] for row in least.collect()})[1:]  # an id for each range


def with_next(docs: DataFrame, id_col: str, text_col: str, parts: int):
    """(id, own, text, next) in descending id; the next of the smallest id is the largest. With it the order that ``next`` follows.

    Ids are cut into ``parts`` ranges, each a window of its own. The first document of a range is also sent to the end of the range before
    it, so texts move once and no window spans the table. Equal ids follow the hash of their text; null ids come last.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    cuts = cuts_of(docs, id_col, parts)
    kind = docs.schema[id_col].dataType
    lits = lambda values: [F.lit(v).cast(kind) for v in values]
    # A small two-level search: the block of cuts first, then the cut. A null id is in the lowest range.
    step = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    if cuts:
        block = F.size(F.filter(F.array(*lits(b[0] for b in blocks)), lambda c: c <= F.col("id")))
        inside = F.get(F.array(*[F.array(*lits(b)) for b in blocks]), block - 1)
        part = F.when(F.col("id").isNull() | (block == 0), F.lit(0)).otherwise((block - 1) * step + F.size(F.filter(inside, lambda c: c <= F.col("id"))))
    else:
        part = F.lit(0)
    ranged = rows.withColumn("part", part)
    first = ranged.groupBy("part").agg(F.max("id").alias("first"))
    # What stands before a range in descending order is the next higher range that has rows; the highest follows the lowest.
    up = F.coalesce(F.lead("part").over(W.orderBy("part")), F.min("part").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    ahead = first.select(F.col("part").alias("of"), up.alias("to"), "first")
    # At most one row for each of the ``parts`` ranges, so this side is small whatever the table holds.
    heads_only = (
        ranged.join(F.broadcast(ahead), (F.col("part") == F.col("of")) & F.col("id").eqNullSafe(F.col("first")))
        .groupBy(F.col("to").alias("part"))
        .agg(F.max_by(F.struct("id", "text"), F.xxhash64("text")).alias("head"))
        .select("head.id", "head.text", "part", F.lit(False).alias("own"))
    )
    both = ranged.select("id", "text", "part", F.lit(True).alias("own")).unionByName(heads_only).withColumn("tie", F.xxhash64("text"))
    order = W.partitionBy("part").orderBy(F.desc("own"), F.desc_nulls_last("id"), F.desc("tie"))
    return both.withColumn("next", F.lead("text").over(order)), order


def fingerprint_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, words: int = WORDS, parts: int | None = None
) -> DataFrame:
    """Per document: n_chars, edited text, both sketches, and their likeness to each other and to the next document.

    Ranges of ids are windows: as many as a shuffle has partitions, more where a range would hold over ``RANGE_BYTES`` of text, or ``parts``.
    The edited text ends in the next document's first floor(n_chars / 3) code points in place of its own last. A null text is
    empty; an empty text has an empty sketch, alike only to empty ones; equal texts have equal sketches. Rows that
    repeat an id give a row each, null ids come last in the order; ids may be of any type that can be ordered; a single document is its own next. An empty table gives an
    empty one. Other columns of ``docs`` are not read.
    """
    if parts is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("n")).first()["n"]
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    paired, order = with_next(docs, id_col, text_col, parts)
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next"), F.lit(1), cut))
    made = paired.select(
        "id", "own", "tie", "part", n.cast("bigint").alias("n_chars"), edited.alias("edited"), sketch(F.col("text"), k, words).alias("sketch")
    )
    follow = made.withColumn("next_sketch", F.lead("sketch").over(order)).filter("own").withColumn("edited_sketch", sketch(F.col("edited"), k, words))
    return follow.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited",
        "sketch",
        "edited_sketch",
        "next_sketch",
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("n_shingles"),
    )
