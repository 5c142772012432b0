"""Near-duplicate detection with tensored minhash bands.

Two small collections of ``SIDE`` sub-keys, each of ``WIDTH`` minhashes, are computed per text. Every pair of one key of the first
and one of the second collection is the key of a table: ``SIDE``^2 tables of ``2 * WIDTH`` minhashes each, out of
``2 * SIDE * WIDTH`` minhashes in place of ``2 * SIDE^2 * WIDTH``. Two texts of similarity s meet in a table unless they differ in all
sub-keys of one collection: they are missed with a probability of about ``2 * (1 - s^WIDTH)^SIDE``, 0.00015 at 0.8 and 0.00002
at 0.82. Links are confirmed on the full shingle sets.

A table key can only be shared if both of its sub-keys are, so sub-keys that a single class has are dropped before tables are formed:
a text without a relative costs its sub-keys only. Of the classes left, those with so many shingles of their own, held by no other of them, that
no link is possible are dropped too, and pairs are bounded by what either can share: the copies of a text that were changed too much to be
linked would all meet each other. Equal sets are one class. In a table each class first meets the most central one, whose
sub-keys are shared most widely; a group of many copies gives a row per copy. Of the classes that are still apart from another of a table, two meet if
they share one of their rarest shingles at places that leave enough behind them for a link, and a table: copies of one text that are no copies
of each other share its shingles, but each has rarer ones before them. Both are exact, so no pair of a table that can be linked is lost.

Rows made by exploding, and what is counted of them, are merged and never broadcast: Spark takes them for no more bytes than the file of the rows they
come from, a row of up to ``SIDE``^2 table keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ngram_join import class_id, components, fits, verified, wanted_classes, whole_sets
from .shared import dropped, kept_table, ship_package
from .words import mix, shingle_sets

SIDE = 18
WIDTH = 4


def seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed odd factors and masks, one pair for each minhash."""
    steps = np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    drawn = mix(steps)
    return drawn[:count] | np.uint64(1), drawn[count:]


def sub_keys(grams: np.ndarray, side: int, width: int, factors: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """The 2 * ``side`` sub-keys of a set: hashes of ``width`` minhashes and the key's own number."""
    least = np.empty(2 * side * width, np.uint64)
    for k in range(len(least)):
        least[k] = ((grams ^ masks[k]) * factors[k]).min()
    out = np.arange(1, 2 * side + 1, dtype=np.uint64)
    for column in least.reshape(2 * side, width).T:
        out = mix(out ^ column) + column
    return out.view(np.int64)


def hashed(docs: DataFrame, id_col: str, text_col: str, size: int, side: int, width: int) -> DataFrame:
    """(id, n, c, keys) per row; a class brings its sub-keys once per task, its other rows have none."""
    factors, masks = seeds(2 * side * width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            sizes, names, keys = [], [], []
            for _, grams in shingle_sets(batch.column(1), size):
                c = class_id(grams)
                sizes.append(len(grams))
                names.append(c)
                fresh = len(grams) > 0 and c not in seen
                keys.append(sub_keys(grams, side, width, factors, masks) if fresh else None)
                seen.add(c)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "n", "c", "keys"]
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, n bigint, c bigint, keys array<bigint>")


def shared_keys(classes: DataFrame, side: int) -> DataFrame:
    """(c, n, firsts, seconds, reach): the sub-keys of each class that another class has too, and how many classes they reach."""
    rows = classes.select("c", "n", F.posexplode("keys").alias("at", "key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    met = rows.join(shared.hint("merge"), "key").groupBy("c", "n")
    of = lambda half: F.collect_list(F.when(half, F.col("key")))
    made = met.agg(of(F.col("at") < side).alias("firsts"), of(F.col("at") >= side).alias("seconds"), F.sum("held").alias("reach"))
    return made.filter((F.size("firsts") > 0) & (F.size("seconds") > 0))


def own_shingles(sets: DataFrame) -> DataFrame:
    """(c, own): how many shingles of a class no other class of ``sets`` has. Counted with partial sums, so a hot shingle is no hot task."""
    held = sets.select(F.explode("grams").alias("gram"), "c").groupBy("gram").agg(F.min("c").alias("c"), F.max("c").alias("_high"))
    return held.filter("c = _high").groupBy("c").agg(F.count(F.lit(1)).alias("own"))


def within_reach(shared: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """The classes of ``shared`` with enough shingles for a link that others have too; ``common`` is their number."""
    known = shared.join(own, "c", "left").withColumn("common", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")
    return known.filter(100 * F.col("common") >= percent * F.col("n"))


def can_link(common: str, n: str, other: str, m: str, percent: int) -> Column:
    """Whether two classes can share enough: the intersection has at most what either of them shares with any class."""
    return F.least(common, other) * (100 + percent) >= percent * (F.col(n) + F.col(m))


def in_tables(shared: DataFrame) -> DataFrame:
    """(key, c, n, reach, common): a row per table key, the pairs of first and second sub-keys, with what else ``shared`` tells of the class."""
    rest = [x for x in shared.columns if x not in ("firsts", "seconds")]
    both = shared.select(*rest, "seconds", F.explode("firsts").alias("first")).select(*rest, "first", F.explode("seconds").alias("second"))
    rows = both.select(F.xxhash64("first", "second").alias("key"), *rest)
    many = rows.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1").select("key")
    return rows.join(many.hint("merge"), "key", "left_semi")


def central_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): each class of a table with the table's most central one, ``b``."""
    rank = F.struct((-F.col("reach")).alias("r"), F.col("c").alias("b"), F.col("n").alias("bn"), F.col("common").alias("bcommon"))
    leaders = rows.groupBy("key").agg(F.min(rank).alias("lead")).select("key", "lead.b", "lead.bn", "lead.bcommon")
    met = rows.join(leaders.hint("merge"), "key").filter((F.col("c") != F.col("b")) & fits("n", "bn", percent) & can_link("common", "n", "bcommon", "bn", percent))
    return met.select(F.col("c").alias("a"), "b").distinct()


def mixed_tables(rows: DataFrame) -> DataFrame:
    """The rows of the tables that hold several components; no pair is left to find in the others."""
    mixed = rows.groupBy("key").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).filter("_low <> _high").select("key")
    return rows.join(mixed.hint("merge"), "key", "left_semi")


def size_band(n: Column) -> Column:
    """A number that grows with ``n``: its first six bits and how many follow, so a band spans a 32nd of its sizes at most."""
    rest = F.greatest(F.length(F.bin(n)) - 6, F.lit(0))
    return rest * 32 + F.call_function("shiftright", n, rest)


def rarest_shingles(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(key, c, n, label, common) of each class as the larger and as the smaller one of a pair, for the shingles that can be the first of a link.

    ``sets`` has (c, n, label, grams). All shingles are ordered by the classes that hold them, the rarest first; ``common`` counts a class's shingles from this one on.
    The larger of two linked sets has fewer before the first shared one the nearer their sizes are, so it comes to the bands of sizes that its
    place allows, the smaller one to its own band. Rows of the label that most holders of a shingle have meet those of others only.
    """
    each = sets.select("c", "n", "label", F.explode("grams").alias("gram"))
    of = each.groupBy("gram", "label").agg(F.count(F.lit(1)).alias("_count")).groupBy("gram")
    held = of.agg(F.sum("_count").alias("held"), F.max_by("label", "_count").alias("lead"), (F.min("label") != F.max("label")).alias("mixed")).filter("held > 1")
    known = each.join(held.hint("merge"), "gram").groupBy("c", "n", "label").agg(F.sort_array(F.collect_list(F.struct("held", "gram", "lead", "mixed"))).alias("shared"))
    # Shingles of one class stand before all others.
    placed = known.select("c", "n", "label", F.size("shared").alias("_shared"), F.posexplode("shared").alias("_at", "_of"))
    rows = placed.select("c", "n", "label", (F.col("_shared") - F.col("_at")).cast("bigint").alias("common"), "_of.gram", (F.col("label") != F.col("_of.lead")).alias("other"), "_of.mixed")
    first = kept_table(rows.filter(F.col("mixed") & (100 * F.col("common") >= percent * F.col("n"))).drop("mixed"), "rarest")
    least = F.ceil(percent * F.col("n") / 100.0 - 1e-9)
    most = F.least(F.col("n"), F.floor((F.col("common") * (100 + percent) - percent * F.col("n")) / float(percent) + 1e-9))
    key = lambda band, kind: F.xxhash64("gram", band, kind).alias("key")
    rest = ["c", "n", "label", "common"]
    bands = first.filter(most >= least).select("*", F.explode(F.sequence(size_band(least), size_band(most))).alias("band"))
    larger = bands.select(key("band", "other"), *rest)
    own = first.filter((100 + percent) * F.col("common") >= 2 * percent * F.col("n"))
    kinds = F.explode(F.when(F.col("other"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True))))
    smaller = own.select("*", size_band(F.col("n")).alias("band"), kinds.alias("kind")).select(key("band", "kind"), *rest)
    return larger, smaller


def pairs_apart(rows: DataFrame, percent: int, smaller: DataFrame | None = None) -> DataFrame:
    """(a, b): the classes of a key, or those of ``rows`` with those of ``smaller``, that are in different components so far and whose sizes fit."""
    other = (rows if smaller is None else smaller).select("key", F.col("c").alias("b"), F.col("n").alias("bn"), F.col("common").alias("bcommon"), F.col("label").alias("bl"))
    once = F.col("c") < F.col("b") if smaller is None else F.col("n") >= F.col("bn")
    met = rows.join(other.hint("merge"), "key").filter(once & (F.col("label") != F.col("bl")) & fits("n", "bn", percent) & can_link("common", "n", "bcommon", "bn", percent))
    return met.select(F.least("c", "b").alias("a"), F.greatest("c", "b").alias("b")).distinct()


def in_one_table(pairs: DataFrame, shared: DataFrame) -> DataFrame:
    """The pairs that meet in a table: they share a first and a second sub-key."""
    side = lambda x: shared.select(F.col("c").alias(x), F.col("firsts").alias(f"{x}firsts"), F.col("seconds").alias(f"{x}seconds"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.filter(F.arrays_overlap("afirsts", "bfirsts") & F.arrays_overlap("aseconds", "bseconds")).select("a", "b")


def linked(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, size: int, percent: int, side: int) -> DataFrame:
    """(c, label) of every class with a confirmed link."""
    shared = kept_table(shared_keys(classes, side), "shared")
    both = shared.select("c", F.lit(True).alias("as_a"), F.lit(True).alias("as_b"))
    own = own_shingles(whole_sets(docs, classes, both, id_col, text_col, size))
    possible = kept_table(within_reach(shared, own, percent), "possible")
    tables = kept_table(in_tables(possible), "tables")

    def sets_of(wanted: DataFrame) -> DataFrame:
        return whole_sets(docs, classes, wanted, id_col, text_col, size)

    pairs = kept_table(central_pairs(tables, percent), "pairs")
    sets = kept_table(sets_of(wanted_classes(pairs)), "grams")
    joined = components(kept_table(verified(pairs, sets, percent), "links"))
    dropped(sets, pairs)
    apart = kept_table(tables.join(joined, "c", "left").withColumn("label", F.coalesce("label", "c")), "apart")
    mixed = kept_table(mixed_tables(apart).select("c", "n", "label").distinct(), "mixed")
    dropped(apart, tables)
    read = sets_of(mixed.select("c", F.lit(True).alias("as_a"), F.lit(True).alias("as_b"))).select("c", "grams")
    sets = kept_table(read.join(mixed, "c").dropDuplicates(["c"]), "grams")
    larger, smaller = rarest_shingles(sets, percent)
    pairs = kept_table(in_one_table(pairs_apart(larger, percent, smaller), possible), "pairs")
    further = kept_table(verified(pairs, sets.join(wanted_classes(pairs), "c"), percent), "links")
    dropped(sets, pairs)
    return components(joined.filter("c <> label").select(F.col("c").alias("a"), F.col("label").alias("b")).union(further))


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, side: int = SIDE, width: int = WIDTH
) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row: the size of its shingle set, the least id that its links reach, and whether that is its own.

    Words are cut at white space, A-Z as a-z; a text of fewer than ``size`` words is one shingle. Two rows link when 100 * intersection
    >= percent * union of their sets and they meet in a table. Null, empty and blank texts have empty sets, link with nothing and are kept.
    Rows that repeat an id give a row each; rows without an id link with nothing, have no component and are not kept. An empty table
    gives an empty one. Other columns are not read, whatever their names.
    """
    ship_package(docs.sparkSession)
    rows = kept_table(hashed(docs, id_col, text_col, size, side, width), "hashed")
    usable = rows.filter("n > 0 and id is not null")
    # A row without sub-keys follows one that has them in its task, unless that one has no id.
    keyed = rows.filter("n > 0").groupBy("c").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("keys", ignorenulls=True).alias("keys"))
    classes = kept_table(keyed.filter("id is not null"), "classes")
    named = docs.filter(F.col(id_col).isNotNull()).select(id_col, text_col)
    labels = linked(named, classes, id_col, text_col, size, percent, side)
    groups = classes.select("c", "id").join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
    least = groups.groupBy("label").agg(F.min("id").alias("component_id"))
    of = groups.join(least, "label").select("c", "component_id")
    linked_rows = usable.join(of, "c").select("id", "n", "component_id")
    alone = rows.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return linked_rows.union(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))
