"""Helpers that keep a job balanced when one key holds a large share of all rows.

* ``first_by`` / ``last_by`` are aggregates, so each map task reduces its rows before the shuffle.
* The ``chunked_*`` windows cut a group at fixed steps of its integer position. Each chunk is a
  task of bounded size; only one small row per chunk meets in the second, per-group window.
* ``contained_in`` finds "text contains key" by an equi join on one short anchor per key and verifies
  the pairs, so nothing like a cross join is ever built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .kept import kept_table

CHUNK = 100_000
TEXT_SPAN = 512
# Characters of a key that its anchor has, where the key has so many; of many keys longer ones have more.
GRAM = 3


def _names(df: DataFrame, keys) -> list[str]:
    return [c for c in df.columns if c not in keys]


def first_by(df: DataFrame, keys: list[str], order: list[str] | Column, count_as: str | None = None) -> DataFrame:
    """First whole row per key by ``order``; map-side combined."""
    rank = order if isinstance(order, Column) else F.struct(*order)
    rest = _names(df, keys)
    aggs = [F.min_by(F.struct(*rest), rank).alias("_row")]
    if count_as:
        aggs.append(F.count(F.lit(1)).alias(count_as))
    extra = [count_as] if count_as else []
    return df.groupBy(*keys).agg(*aggs).select(*keys, "_row.*", *extra).select(*df.columns, *extra)


def last_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last whole row per key by ``order``; map-side combined."""
    rest = _names(df, keys)
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return out.select(*keys, "_row.*").select(*df.columns)


def least_by(df: DataFrame, keys: list[str], order: list[str], count_as: str | None = None) -> DataFrame:
    """:func:`first_by` for columns ``order`` of ``df``, with each value held once on its way: the columns of the order are part of the row.

    Rows of equal order fall by their other columns. Rows with a map or a variant cannot be compared and go by :func:`first_by`.
    """
    if any(kind in df.schema.simpleString() for kind in ("map<", ":variant", "<variant")):
        return first_by(df, keys, order, count_as)
    row = F.min(F.struct(*order, *[c for c in _names(df, keys) if c not in order])).alias("_row")
    counted, extra = ([F.count(F.lit(1)).alias(count_as)], [count_as]) if count_as else ([], [])
    return df.groupBy(*keys).agg(row, *counted).select(*keys, "_row.*", *extra).select(*df.columns, *extra)


def digest(values: list[Column]) -> Column:
    """128 bits that stand for a list of values; equal for equal lists only, up to collisions. Each value goes in with its length, so none runs into the next."""
    text = [v.cast("string") for v in values]
    return F.unhex(F.md5(F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])))


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank_as: str | None = None) -> DataFrame:
    """First n rows per key. Spark limits each group before the shuffle, so a hot key stays small."""
    name = rank_as or "_rank"
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return ranked if rank_as else ranked.drop(name)


def _chunk(pos: str, size: int) -> Column:
    return F.floor(F.col(pos) / F.lit(size)).alias("_chunk")


def chunked_running_sum(df: DataFrame, keys: list[str], pos: str, value: Column, out: str, size: int = CHUNK) -> DataFrame:
    """Running sum of ``value`` in ``pos`` order within ``keys``; ``pos`` is a unique integer."""
    cut = df.withColumn("_v", value).withColumn("_chunk", _chunk(pos, size))
    inside = cut.withColumn("_run", F.sum("_v").over(W.partitionBy(*keys, "_chunk").orderBy(pos).rowsBetween(W.unboundedPreceding, 0)))
    carry = (
        cut.groupBy(*keys, "_chunk")
        .agg(F.sum("_v").alias("_part"))
        .withColumn("_before", F.sum("_part").over(W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)))
        .select(*keys, "_chunk", "_before")
    )
    joined = inside.join(carry, [*keys, "_chunk"])
    total = F.coalesce(F.col("_run"), F.lit(0)) + F.coalesce(F.col("_before"), F.lit(0))
    return joined.withColumn(out, total).select(*df.columns, out)


def chunked_row_number(df: DataFrame, keys: list[str], pos: str, out: str, size: int = CHUNK) -> DataFrame:
    return chunked_running_sum(df, keys, pos, F.lit(1).cast("bigint"), out, size)


def tree_row_number(df: DataFrame, at: str, order: Column, out: str, bits: int = 16) -> DataFrame:
    """Number of each row over the whole table by ``order``, whose first part is the integer ``at``.

    Rows are numbered within runs of 2^bits values of ``at``; the runs are counted, and their counts summed, level by level up to the
    top of 64 bits. No window sees more than 2^bits nodes, nor more than the rows of one run, however sparse ``at`` is.
    """
    lead = F.col(at).cast("bigint")
    rows = df.withColumn("_n0", F.shiftright(lead, bits))
    inside = rows.withColumn("_run", F.row_number().over(W.partitionBy("_n0").orderBy(order)))
    counts = [rows.groupBy("_n0").agg(F.count(F.lit(1)).alias("_c0"))]
    tops = -(-64 // bits) - 1
    for k in range(1, tops):
        up = F.shiftright(F.col(f"_n{k - 1}"), bits).alias(f"_n{k}")
        counts.append(counts[-1].groupBy(up).agg(F.sum(f"_c{k - 1}").alias(f"_c{k}")))
    before = None
    for k in range(tops - 1, -1, -1):
        # The nodes of the top level, at most 2^bits, share one parent.
        parent = F.shiftright(F.col(f"_n{k}"), bits) if k < tops - 1 else F.lit(0)
        nodes = counts[k].withColumn("_up", parent)
        sums = F.coalesce(F.sum(f"_c{k}").over(W.partitionBy("_up").orderBy(f"_n{k}").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        nodes = nodes.withColumn("_sum", sums)
        if before is not None:
            nodes = nodes.join(before.withColumnRenamed(f"_n{k + 1}", "_up"), "_up").withColumn("_sum", F.col("_sum") + F.col("_before"))
        before = nodes.select(f"_n{k}", F.col("_sum").alias("_before"))
    return inside.join(before, "_n0").withColumn(out, F.col("_before") + F.col("_run")).select(*df.columns, out)


def chunked_fill_forward(df: DataFrame, keys: list[str], pos: str, value: Column, out: str, size: int = CHUNK) -> DataFrame:
    """Last non-null ``value`` at or before each row, in ``pos`` order within ``keys``."""
    cut = df.withColumn("_v", value).withColumn("_chunk", _chunk(pos, size))
    inside = cut.withColumn(
        "_last", F.last("_v", ignorenulls=True).over(W.partitionBy(*keys, "_chunk").orderBy(pos).rowsBetween(W.unboundedPreceding, 0))
    )
    carry = (
        cut.groupBy(*keys, "_chunk")
        .agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(pos))).alias("_end"))
        .withColumn("_before", F.last("_end", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)))
        .select(*keys, "_chunk", "_before")
    )
    joined = inside.join(carry, [*keys, "_chunk"])
    return joined.withColumn(out, F.coalesce("_last", "_before")).select(*df.columns, out)


def chunked_frame(df: DataFrame, keys: list[str], pos: str, reach: int, size: int = CHUNK) -> DataFrame:
    """Rows with their chunk and, at the chunk edges, copies of up to ``reach`` neighbours.

    A bounded frame over (keys, _chunk) ordered by ``pos`` then equals the frame over ``keys``
    when ``pos`` has no gaps; rows with ``_own`` false are the copies, to be dropped afterwards.
    """
    shifts = F.array_distinct(
        F.array(
            F.floor(F.col(pos) / F.lit(size)),
            F.floor((F.col(pos) - reach) / F.lit(size)),
            F.floor((F.col(pos) + reach) / F.lit(size)),
        )
    )
    spread = df.withColumn("_chunk", F.explode(shifts)).filter(F.col("_chunk") >= 0)
    return spread.withColumn("_own", F.col("_chunk") == F.floor(F.col(pos) / F.lit(size)))


def substrings(text: Column, lengths: Column, prefix_only: bool = False) -> Column:
    """All distinct substrings of ``text`` whose length is in ``lengths``."""
    size = F.length(text)
    fit = F.filter(lengths, lambda n: (n >= 1) & (n <= size))
    if prefix_only:
        return F.transform(fit, lambda n: F.substring(text, F.lit(1), n))
    grams = F.transform(fit, lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(text, i, n)))
    return F.array_distinct(F.flatten(grams))


def key_lengths(keys: DataFrame, key: str) -> Column:
    """The lengths that occur in a key column, as a scalar subquery."""
    return keys.agg(F.array_sort(F.collect_set(F.length(key)))).scalar()


def anchored(keys: DataFrame, gram: int = GRAM) -> DataFrame:
    """(_key, _gram, _off): each key with its rarest substring of ``gram`` characters and where that begins.

    A shorter key has one of ``GRAM`` characters, or is its own. Rare among the keys, so that a substring which many keys share draws no texts to all of them.
    """
    grams = keys.select("_key", F.explode(substrings(F.col("_key"), F.array(anchor_size(F.col("_key"), gram)))).alias("_gram"))
    counts = grams.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    # Merged, never broadcast: Spark takes exploded rows to be no more than the rows they come from.
    chosen = grams.join(counts.hint("merge"), "_gram").groupBy("_key").agg(F.min(F.struct("_n", "_gram")).alias("_a")).select("_key", "_a._gram")
    return chosen.withColumn("_off", F.instr("_key", F.col("_gram")))


def anchor_size(key: Column, gram: int) -> Column:
    return F.when(F.length(key) >= gram, gram).otherwise(F.least(F.length(key), F.lit(GRAM)))


# From so many keys on anchors are long, because all keys that share a short one meet every text that shows it.
MANY_KEYS = 1 << 14
LONG_GRAM = 8
# Up to so many keys, of no more characters in all, their anchors are a table small enough to be sent to all tasks.
FEW_KEYS = 1 << 14
FEW_CHARS = 1 << 20
# Bits of the map that tells a text's substrings from those that are no anchor, by the number of keys; a fuller one only lets more of them through.
ANCHOR_BITS = (1 << 17, 1 << 23)


def _slot(gram: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(bits))


def _anchor_map(anchors: DataFrame, bits: int) -> Column:
    """The bit map of the anchors, 64 bits to a number, as a scalar subquery of bounded size."""
    words = anchors.select(_slot(F.col("_gram"), bits).alias("s")).select((F.col("s") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(s % 64 AS int))").alias("b"))
    filled = words.groupBy("w").agg(F.bit_or("b").alias("b"))
    every = anchors.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("w")).join(filled, "w", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0).cast("bigint")).alias("b")))), lambda x: x["b"]).alias("m")).scalar()


# Up to so many rows, of no more characters in all, a table of keys is sent to all tasks.
FEW_ROWS = 1 << 16
FEW_ROW_CHARS = 1 << 23


def looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``table`` (one row per ``key``, no blank one) where it has their key, else nulls.

    The table is written once and counted: few rows are sent to all tasks, more are merged. Its plan ends at its file, so that a merge shuffles both
    sides and AQE can split a hot key, which it cannot where an aggregate over the same key sits on a side.
    """
    kept = kept_table(table, "looked-up")
    count, chars = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(F.to_json(F.struct(*kept.columns)))), F.lit(0))).first()
    few = count <= FEW_ROWS and chars <= FEW_ROW_CHARS
    return rows.join(F.broadcast(kept) if few else kept.hint("merge"), key, "left")


def contained_in(texts: DataFrame, text_id: str, text: str, keys: DataFrame, key: str, long_text: bool = False) -> DataFrame:
    """Distinct (text_id, key) pairs where the text contains the key.

    ``texts`` should be distinct already. The distinct keys and their anchors are written once, so that the plan of the keys ends there. Every key
    waits at one anchor, a few of its characters. The places of a text that show an anchor come to
    it with the few characters around them, as many as the longest key needs, never with the text; a bit map of bounded size drops all other places where
    they are read. For any number of keys: with many, anchors are longer, so that each stays with few keys. With ``long_text`` each text is first cut
    into spans that overlap by the longest key, so that a row never spreads a whole document.
    """
    wanted = kept_table(keys.select(F.col(key).alias("_key")).filter(F.col(key) != "").distinct(), "keys")
    count, longest, chars = wanted.agg(F.count(F.lit(1)), F.coalesce(F.max(F.length("_key")), F.lit(1)), F.coalesce(F.sum(F.length("_key")), F.lit(0))).first()
    gram = LONG_GRAM if count > MANY_KEYS else GRAM
    sizes = [r[0] for r in wanted.select(anchor_size(F.col("_key"), gram)).distinct().collect()]
    base = texts.select(F.col(text_id).alias("_id"), F.col(text).alias("_text"))
    if long_text:
        starts = F.sequence(F.lit(1), F.greatest(F.length("_text"), F.lit(1)), F.lit(TEXT_SPAN))
        base = base.select("_id", F.explode(starts).alias("_at"), "_text").select("_id", F.substring(F.col("_text"), F.col("_at"), F.lit(TEXT_SPAN + longest - 1)).alias("_text"))
    anchors = kept_table(anchored(wanted, gram), "anchors")
    sized = base.select("_id", "_text", F.explode(F.array(*[F.lit(n) for n in sizes]).cast("array<int>")).alias("_size")).filter(F.length("_text") >= F.col("_size"))
    places = sized.select("_id", "_text", "_size", F.explode(F.sequence(F.lit(1), F.length("_text") - F.col("_size") + 1)).alias("_at"))
    slots = min(max(ANCHOR_BITS[0], 1 << (16 * count).bit_length()), ANCHOR_BITS[1])
    grams = places.withColumn("_gram", F.substring(F.col("_text"), F.col("_at"), F.col("_size"))).withColumn("_slot", _slot(F.col("_gram"), slots))
    bits = F.get(_anchor_map(anchors, slots), (F.col("_slot") / 64).cast("int"))
    shown = grams.filter(F.getbit(bits, F.col("_slot") % 64) == 1)
    start = F.greatest(F.col("_at") - longest, F.lit(0)) + 1
    around = shown.select("_id", "_gram", (F.col("_at") - start).alias("_rel"), F.substring(F.col("_text"), start, F.col("_at") - start + longest).alias("_near"))
    begin = F.col("_rel") - F.col("_off") + 2
    same = (begin >= 1) & (F.substring(F.col("_near"), begin, F.length("_key")) == F.col("_key"))
    # The places are many more than the rows that Spark guesses them by, so they are never the side that is sent.
    small = count <= FEW_KEYS and chars <= FEW_CHARS
    met = around.join(F.broadcast(anchors) if small else anchors.hint("merge"), "_gram")
    return met.filter(same).select(F.col("_id").alias(text_id), F.col("_key").alias(key)).distinct()
