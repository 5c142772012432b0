"""Near-duplicate join: documents whose sets of word n-grams have a Jaccard similarity of a threshold or more.

Prefix filter under several global orders. Under any order of all n-grams, two sets that are similar enough share
tokens in their prefixes of ``|x| - ceil(t |x|) + 1``; with the sizes of both known they share a certain number. Candidates come from
buckets of the first order; the prefixes of the second and third order are intersected before any whole set is read.
All orders put frequent n-grams last, by a count sketch of fixed size, and shuffle equal counts by their own seed. What stands before
the first shared token of the first order is not shared, which bounds the overlap: a copy with many n-grams of its own meets nobody.

Equal sets are one class. In a bucket every class first meets one leader only, the class with the fewest n-grams before the token, so a
group of many near copies yields a row per copy and mostly meets its original. Classes that are joined by then need no more pairs; those
left apart meet all others of their bucket, so no link between different components is lost. Links make components; pairs within one are
never all listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import dropped, kept_table, ship_package
from .words import mix, shingle_sets

BINS = 1 << 20  # of the sketches: counts for the orders, bits for a reader's filter; both 1 to 4 MB at any size
SLICE = 1 << 14
MARKS = 1 << 24  # bits of the bitmap of shared tokens; a fuller one only lets more tokens into the exact join
ORDERS = 3


def class_id(grams: np.ndarray) -> int:
    """A signed 64-bit name of a set; 0 for the empty one."""
    if len(grams) == 0:
        return 0
    total = mix(np.array([int(mix(grams ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64)) ^ len(grams)], np.uint64))
    return int(total.view(np.int64)[0]) or 1


def added(slices: DataFrame) -> np.ndarray:
    """Sums the slices of all tasks; a reader holds a slice of each number at a time, the driver gets ``BINS`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(data.as_py(), np.uint32)
                sums[at] = np.minimum(sums[at].astype(np.uint64) + part, 2**32 - 1).astype(np.uint32) if at in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["at", "data"])

    out = np.zeros(BINS, np.uint32)
    # The second pass adds the few parts of a slice that the first leaves.
    once = slices.repartition("at", "task").select("at", "data").mapInArrow(run, "at int, data binary")
    for row in once.repartition("at").mapInArrow(run, "at int, data binary").collect():
        out[row["at"] * SLICE : (row["at"] + 1) * SLICE] += np.frombuffer(row["data"], np.uint32)
    return out


def slices_of(counts: np.ndarray) -> list[tuple[int, bytes]]:
    return [(i, counts[i * SLICE : (i + 1) * SLICE].astype(np.uint32).tobytes()) for i in range(BINS // SLICE) if counts[i * SLICE : (i + 1) * SLICE].any()]


def described(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, n, c) per row and, with ``at``, each task's part of the count sketch (a set counts once in a task)."""
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, task, kind = np.zeros(BINS, np.int64), set(), 0, None
        for batch in batches:
            kind = batch.column(0).type
            sizes, names = [], []
            for _, grams in shingle_sets(batch.column(1), size):
                sizes.append(len(grams))
                names.append(class_id(grams))
                if names[-1] not in seen:
                    seen.add(names[-1])
                    np.add.at(counts, (grams >> np.uint64(44)).astype(np.int64), 1)
            task = task or (names[0] if names else 0)
            rest = [pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), *rest], names=["id", "n", "c", "at", "task", "data"])
        parts = slices_of(np.minimum(counts, 2**32 - 1))
        if parts:
            n = len(parts)
            columns = [pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([p[0] for p in parts], pa.int32()), pa.array([task % 16] * n, pa.int32()), pa.array([p[1] for p in parts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "c", "at", "task", "data"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {id_type.simpleString()}, n bigint, c bigint, at int, task int, data binary")


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def prefixes(docs: DataFrame, text_col: str, size: int, percent: int, levels: np.ndarray) -> DataFrame:
    """(c, n, p1, p2, p3): the prefixes of each class under the three orders; a class comes once per task.

    The first holds whole hashes in their order, the others 32 bits of each, which may join two tokens but never part equal ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            names, sizes, lists = [], [], [[] for _ in range(ORDERS)]
            for _, grams in shingle_sets(batch.column(0), size):
                c = class_id(grams)
                if len(grams) == 0 or c in seen:
                    continue
                seen.add(c)
                take = prefix_length(len(grams), percent)
                level = levels[(grams >> np.uint64(44)).astype(np.int64)].astype(np.uint64) << np.uint64(58)
                for k in range(ORDERS):
                    place = level | (mix(grams ^ np.uint64(k + 1)) >> np.uint64(6))
                    if k == 0:  # equal places keep the order of the hashes, the same in every set
                        lists[k].append(grams[np.argsort(place, kind="stable")[:take]].view(np.int64))
                        continue
                    first = grams[np.argpartition(place, take - 1)[:take]] if take < len(grams) else grams
                    lists[k].append(np.unique((first >> np.uint64(7)).astype(np.uint32)).view(np.int32))
                names.append(c)
                sizes.append(len(grams))
            kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), *(pa.array(v, t) for v, t in zip(lists, kinds, strict=True))], names=["c", "n", "p1", "p2", "p3"]
            )

    return docs.select(text_col).mapInArrow(run, "c bigint, n int, p1 array<bigint>, p2 array<int>, p3 array<int>")


def slot_of(name: str) -> Column:
    """The place of a value in a bitmap."""
    return F.shiftrightunsigned(F.xxhash64(name), 44).alias("slot")


def marked_slots(rows: DataFrame, name: str) -> np.ndarray:
    """The packed bitmap, of fixed size, of the values of a column."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken, task = np.zeros(BINS, np.int64), 0
        for batch in batches:
            slots = np.asarray(batch.column(0), np.int64)
            taken[slots] = 1
            task = task or int(slots.sum() % 16) if len(slots) else task
        parts = slices_of(taken)
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([task] * len(parts), pa.int32()), pa.array([p[1] for p in parts], pa.binary())], names=["at", "task", "data"])

    return np.packbits(added(rows.select(slot_of(name)).mapInArrow(bits, "at int, task int, data binary")) > 0)


def with_marks(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows whose last column, a slot, is marked."""
    marked = np.unpackbits(bitmap).astype(bool)
    for batch in batches:
        yield batch.filter(pa.array(marked[np.asarray(batch.column(batch.num_columns - 1), np.int64)]))


def fits(a: str, b: str, percent: int) -> Column:
    """Whether two sizes allow the threshold."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def can_overlap(a: str, apos: str, b: str, bpos: str, percent: int) -> Column:
    """Whether sets whose first shared token stands at these places can share as much as their sizes ask for.

    A pair over the threshold passes in the bucket of its first shared token; other buckets may leave it out.
    """
    return F.least(F.col(a) - F.col(apos), F.col(b) - F.col(bpos)) * (100 + percent) >= percent * (F.col(a) + F.col(b))


def packed_marks(values: DataFrame) -> np.ndarray:
    """A bitmap of fixed size, packed, of the top bits of the hashes in a column; the driver gets its 2 MB once."""
    name, part = values.columns[0], MARKS >> 10

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = np.zeros(MARKS, bool)
        for batch in batches:
            taken[mark_of(np.asarray(batch.column(0), np.int64))] = True
        rows = np.packbits(taken).reshape(1 << 10, part // 8)
        filled = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array([rows[i].tobytes() for i in filled], pa.binary())], names=["at", "data"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row = np.frombuffer(data.as_py(), np.uint8)
                sums[at] = sums[at] | row if at in sums else row
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([r.tobytes() for r in sums.values()], pa.binary())], names=["at", "data"])

    out = np.zeros((1 << 10, part // 8), np.uint8)
    for row in values.select(name).mapInArrow(bits, "at int, data binary").repartition("at").mapInArrow(joined, "at int, data binary").collect():
        out[row["at"]] = np.frombuffer(row["data"], np.uint8)
    return out.reshape(-1)


def mark_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - MARKS.bit_length() + 1)).astype(np.int64)


def in_buckets(made: DataFrame) -> DataFrame:
    """(token, pos, c, n) of the first order for tokens of two classes or more.

    Counted with partial sums, so a hot token is no hot task. A bitmap of fixed size keeps the tokens of one class, most of them, in their task; the
    join that follows is exact.
    """
    held = made.select(F.explode("p1").alias("token"), "c").groupBy("token").agg(F.min("c").alias("_low"), F.max("c").alias("_high"))
    shared = kept_table(held.filter("_low <> _high").select("token"), "tokens")
    bitmap = packed_marks(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.unpackbits(bitmap).astype(bool)
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                lists = part.column(2)
                tokens = np.asarray(lists.flatten(), np.int64)
                sizes = np.asarray(pc.list_value_length(lists), np.int64)
                row = np.repeat(np.arange(len(sizes)), sizes)
                pos = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                keep = marked[mark_of(tokens)]
                of = pa.array(row[keep])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tokens[keep]), pa.array(pos[keep].astype(np.int32)), part.column(0).take(of), part.column(1).take(of)], names=["token", "pos", "c", "n"]
                )

    rows = made.select("c", "n", "p1").mapInArrow(run, "token bigint, pos int, c bigint, n int")
    return rows.join(shared, "token", "left_semi")


def overlap_enough(p: str, percent: int) -> Column:
    """Whether two prefixes of one order share as many tokens as the sizes ask for.

    With an overlap of at least o the prefixes of lengths |x| - o + m and |y| - o + m share m tokens; m is taken so that
    both fit into the stored prefixes. Tokens that fell together in 32 bits lower what is asked.
    """
    least = F.ceil(percent * (F.col("an") + F.col("bn")) / (100.0 + percent) - 1e-9)
    length = lambda n: F.col(n) - F.ceil(percent * F.col(n) / 100.0 - 1e-9) + 1
    lost = length("an") - F.size(f"a{p}") + length("bn") - F.size(f"b{p}")
    asked = F.least(length("an") - F.col("an"), length("bn") - F.col("bn")) + least - lost
    return F.size(F.array_intersect(f"a{p}", f"b{p}")) >= F.greatest(asked, F.lit(1))


def filtered(pairs: DataFrame, made: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose prefixes of every further order share enough tokens.

    A bitmap of fixed size keeps the prefixes of most other classes out of the shuffle; the joins that follow are exact.
    """
    bitmap = marked_slots(pairs.select(F.col("a").alias("c")).union(pairs.select("b")), "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in with_marks(batches, bitmap):
            yield part.select(["c", "n", "p2", "p3"])

    once = made.select("c", "n", "p2", "p3", slot_of("c")).mapInArrow(run, "c bigint, n int, p2 array<int>, p3 array<int>").dropDuplicates(["c"])
    side = lambda x: once.select(F.col("c").alias(x), F.col("n").alias(f"{x}n"), F.col("p2").alias(f"{x}p2"), F.col("p3").alias(f"{x}p3"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.filter(overlap_enough("p2", percent) & overlap_enough("p3", percent)).select("a", "b")


def star_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): each class of a bucket with its leader ``b``, the class with the least part of its set before the token."""
    rank = F.struct((F.col("pos") / F.col("n")).alias("r"), F.xxhash64("c").alias("h"), F.col("c").alias("b"), F.col("n").alias("bn"), F.col("pos").alias("bpos"))
    leaders = rows.groupBy("token").agg(F.min(rank).alias("lead")).select("token", "lead.b", "lead.bn", "lead.bpos")
    met = rows.join(leaders, "token").filter((F.col("c") != F.col("b")) & fits("n", "bn", percent) & can_overlap("n", "pos", "bn", "bpos", percent))
    return met.select(F.col("c").alias("a"), "b").distinct()


def all_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): the classes of a bucket that are still apart and whose sizes and places fit."""
    other = rows.select("token", F.col("c").alias("b"), F.col("n").alias("bn"), F.col("pos").alias("bpos"), F.col("label").alias("bl"))
    apart = (F.col("c") < F.col("b")) & (F.col("label") != F.col("bl"))
    met = rows.join(other, "token").filter(apart & fits("n", "bn", percent) & can_overlap("n", "pos", "bn", "bpos", percent))
    return met.select(F.col("c").alias("a"), "b").distinct()


def whole_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(c, grams, as_a, as_b) of the ``wanted`` classes, read from one document each.

    A bitmap of fixed size keeps most other documents from being cut into n-grams; the join that follows is exact.
    """
    ids = classes.join(wanted, "c").select("c", "id", "as_a", "as_b")
    bitmap = marked_slots(ids, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in with_marks(batches, bitmap):
            for start in range(0, part.num_rows, 1000):
                some = part.slice(start, 1000)
                sets = [grams for _, grams in shingle_sets(some.column(1), size)]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array([class_id(g) for g in sets], pa.int64()), pa.array([g.view(np.int64) for g in sets], pa.list_(pa.int64()))], names=["id", "c", "grams"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(id_col, text_col, slot_of(id_col)).mapInArrow(run, f"id {kind}, c bigint, grams array<bigint>")
    return read.join(ids, ["id", "c"]).select("c", "grams", "as_a", "as_b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose whole sets reach the threshold, in whole numbers.

    The sets of ``a`` move to their pairs and with them to ``b``; of the sets only those that some pair names as its ``b``, marked when they were
    read, wait there.
    """
    a = sets.filter("as_a").select(F.col("c").alias("a"), F.col("grams").alias("ag"))
    b = sets.filter("as_b").select(F.col("c").alias("b"), F.col("grams").alias("bg"))
    common = F.size(F.array_intersect("ag", "bg"))
    counted = pairs.join(a, "a").join(b, "b").select("a", "b", common.alias("i"), (F.size("ag") + F.size("bg")).alias("s"))
    return counted.filter(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select("a", "b")


def wanted_classes(pairs: DataFrame) -> DataFrame:
    """(c, as_a, as_b): the classes that pairs name, and on which side."""
    side = lambda name: pairs.select(F.col(name).alias("c"), F.lit(name == "a").alias("as_a"), F.lit(name == "b").alias("as_b"))
    return side("a").union(side("b")).groupBy("c").agg(F.bool_or("as_a").alias("as_a"), F.bool_or("as_b").alias("as_b"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(c, label) of every class with a link: the least name that its links reach. Labels spread along links and then jump to their label's label."""
    both = both_ways(edges)
    labels = kept_table(both.groupBy(F.col("a").alias("c")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("c").alias("b"), "label"), "b").groupBy(F.col("a").alias("c")).agg(F.min("label").alias("near"))
        step = labels.join(near, "c").select("c", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("c").alias("label"), F.col("label").alias("next"))
        made = kept_table(step.join(jump, "label").select("c", F.least("label", "next").alias("label"), "old"), "labels")
        labels = made.select("c", "label")
        if made.filter("label <> old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id) per row: the size of its n-gram set and the least id that its links reach.

    Words are cut at white space, A-Z as a-z; a text of fewer than ``size`` words is one n-gram. Two rows link when
    100 * intersection >= percent * union of their sets. Null, empty and blank texts have empty sets and link with nothing. Rows
    that repeat an id give a row each; rows without an id link with nothing and have no component. An empty table gives an
    empty one. Other columns are not read, whatever their names.
    """
    ship_package(docs.sparkSession)
    known = kept_table(described(docs, id_col, text_col, size), "sets")
    rows = known.filter("at is null").select("id", "n", "c")
    classes = kept_table(rows.filter("n > 0 and id is not null").groupBy("c").agg(F.min("id").alias("id")), "classes")
    counts = added(known.filter("at is not null").select("at", "task", "data"))
    levels = np.minimum(np.log2(counts.astype(float) + 1), 63).astype(np.uint8)
    named = docs.filter(F.col(id_col).isNotNull()).select(id_col, text_col)
    labels = linked(named, classes, levels, id_col, text_col, size, percent)
    groups = classes.join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
    least = groups.groupBy("label").agg(F.min("id").alias("component_id"))
    of = groups.join(least, "label").select("c", "component_id")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    out = rows.join(of, "c", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), own).alias("component_id"))
    return out


def linked(docs: DataFrame, classes: DataFrame, levels: np.ndarray, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """(c, label) of every class with a link. Leaders first, then all pairs of a bucket that are still apart."""
    made = kept_table(prefixes(docs, text_col, size, percent, levels), "prefixes")
    buckets = kept_table(in_buckets(made).distinct(), "buckets")

    def links_of(found: DataFrame) -> DataFrame:
        pairs = kept_table(filtered(kept_table(found, "met"), made, percent), "pairs")
        sets = kept_table(whole_sets(docs, classes, wanted_classes(pairs), id_col, text_col, size), "grams")
        links = kept_table(verified(pairs, sets, percent), "links")
        dropped(sets, pairs)
        return links

    joined = components(links_of(star_pairs(buckets, percent)))
    apart = kept_table(buckets.join(joined, "c", "left").withColumn("label", F.coalesce("label", "c")), "apart")
    dropped(buckets)
    further = links_of(all_pairs(apart, percent))
    dropped(apart, made)
    return components(joined.filter("c <> label").select(F.col("c").alias("a"), F.col("label").alias("b")).union(further))
