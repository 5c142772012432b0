"""Mixing sources to target weights by budgets that run down a tree of levels, such as domain, language, source.

A node's budget is split among its children by weight. A child takes no more tokens than it can give (its tokens
times the most epochs); what it leaves goes to its siblings by their weights, and only what all of them cannot take
is left to the parent's siblings, because a parent's own limit is the sum of its children's. Each leaf then takes whole
epochs and a token prefix of one more, in an order seeded by epoch.

Budgets are exact integers. Only (leaf, slice) sums meet in a window; single rows are numbered within the one slice
of a leaf where its prefix ends, so a leaf with a third of all rows is no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import kept_table

SLICE = 3  # hexadecimal digits of the order key that name a slice: 4,096 slices an epoch


def order_key(seed: int, epoch: Column, id_: Column) -> Column:
    """The place of a document in an epoch: a seeded hash, as text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_.cast("string"), F.lit("null"))))


def leaf_totals(docs: DataFrame, levels: list[str], tokens: str) -> DataFrame:
    return docs.groupBy(*levels).agg(F.sum(tokens).alias("available"))


def with_weights(leaves: DataFrame, levels: list[str], weights: list[DataFrame]) -> DataFrame:
    """Adds w1, w2, … : the weight of each leaf's node at each level; a node that no table names weighs 1.

    ``weights[i]`` has the first i + 1 level columns and ``weight`` (whole numbers, 0 leaves the node out).
    """
    out = leaves
    for i, table in enumerate(weights):
        keys = levels[: i + 1]
        t = table.groupBy(*keys).agg(F.max("weight").cast("bigint").alias(f"w{i + 1}"))
        renamed = t.select(*[F.col(k).alias(f"_{k}") for k in keys], f"w{i + 1}")
        on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        out = out.join(renamed, on, "left").drop(*[f"_{k}" for k in keys]).withColumn(f"w{i + 1}", F.coalesce(f"w{i + 1}", F.lit(1).cast("bigint")))
    return out


def split_budget(nodes: DataFrame, parents: list[str], name: str, weight: str, limit: str, budget: str, out: str) -> DataFrame:
    """Adds ``out``: each child's share of its parent's ``budget``, at most ``limit``, the rest shared among the others by weight.

    Children are taken from the smallest limit per weight. While a child's share of what is left reaches its limit it
    gets the limit; the others share the rest, rounded so that the shares add up. The result is the same as filling,
    capping and sharing again until nothing changes. Weight 0 gets nothing.
    """
    w, c = F.col(weight), F.when(F.col(weight) > 0, F.col(limit)).otherwise(F.lit(0).cast("bigint"))
    ratio = F.when(w > 0, c.cast("double") / w)
    base = W.partitionBy(*parents) if parents else W.partitionBy(F.lit(0))
    order = base.orderBy(F.col("_ratio").asc_nulls_first(), name)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    whole = base.orderBy(F.col("_ratio").asc_nulls_first(), name).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    step = (
        nodes.withColumn("_ratio", ratio)
        .withColumn("_limit", c)
        .withColumn("_left", F.col(budget) - F.coalesce(F.sum("_limit").over(before), F.lit(0)))
        .withColumn("_weights", F.sum(weight).over(whole) - F.coalesce(F.sum(weight).over(before), F.lit(0)))
        # The limit is reached if limit <= left * weight / weights, without dividing.
        .withColumn("_full", (w > 0) & (F.col("_limit").cast("decimal(28,0)") * F.col("_weights").cast("decimal(10,0)") <= F.col("_left").cast("decimal(28,0)") * w.cast("decimal(10,0)")))
        # A child after one that is not full is not full either.
        .withColumn("_full", F.coalesce(F.min(F.when(w > 0, F.col("_full"))).over(order.rowsBetween(W.unboundedPreceding, 0)), F.lit(True)))
    )
    rest = F.col(budget) - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_limit"))).over(whole), F.lit(0))
    open_ = F.when(F.col("_full"), F.lit(0)).otherwise(w)
    step = step.withColumn("_rest", rest).withColumn("_open", open_)
    upto, total = F.sum("_open").over(order.rowsBetween(W.unboundedPreceding, 0)), F.sum("_open").over(whole)
    share = lambda part: F.expr(f"cast(cast(_rest as decimal(28,0)) * cast({part} as decimal(10,0)) div cast(_total as decimal(10,0)) as bigint)")
    step = step.withColumn("_upto", upto).withColumn("_total", total)
    got = F.when(F.col("_full"), F.col("_limit")).otherwise(share("_upto") - share("(_upto - _open)"))
    return step.withColumn(out, got).drop("_ratio", "_limit", "_left", "_weights", "_full", "_rest", "_open", "_upto", "_total")


def leaf_budgets(leaves: DataFrame, levels: list[str], budget: Column, most_epochs: int) -> DataFrame:
    """Adds ``budget``, the tokens that each leaf is to give. ``leaves`` has ``available`` and w1, w2, … per leaf."""
    used = F.least(*[F.col(f"w{i + 1}") for i in range(len(levels))], F.lit(1).cast("bigint"))
    given = leaves.withColumn("_limit_leaf", F.when(used > 0, F.col("available") * most_epochs).otherwise(F.lit(0).cast("bigint"))).withColumn("_budget", budget.cast("bigint"))
    for i, level in enumerate(levels):
        parents, keys = levels[:i], levels[: i + 1]
        nodes = given.groupBy(*keys).agg(F.max(f"w{i + 1}").alias("_w"), F.sum("_limit_leaf").alias("_cap"), F.max("_budget").alias("_of"))
        shares = split_budget(nodes, parents, level, "_w", "_cap", "_of", "_got")
        renamed = shares.select(*[F.col(k).alias(f"_{k}") for k in keys], F.least("_got", "_cap").alias("_got"))
        on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        # A row per leaf, written between levels, so that a deep tree does not become one deep plan.
        given = kept_table(given.join(renamed, on).drop("_budget", *[f"_{k}" for k in keys]).withColumnRenamed("_got", "_budget"), "budgets")
    return given.withColumnRenamed("_budget", "budget").drop("_limit_leaf")


def take_prefixes(docs: DataFrame, budgets: DataFrame, levels: list[str], id_col: str, tokens: str, seed: int) -> DataFrame:
    """A row per document and epoch that takes part, with the tokens taken of it; the last one of a leaf may be cut.

    ``docs`` has a column ``_row`` that tells apart rows with the same id; it settles ties after the order key.
    """
    quota = budgets.filter("budget > 0 and available > 0").select(
        *[F.col(k).alias(f"_{k}") for k in levels],
        F.expr("budget div available").alias("_whole"),
        (F.col("budget") - F.expr("budget div available") * F.col("available")).alias("_part"),
    )
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in levels]
    asked = docs.join(quota, on).drop(*[f"_{k}" for k in levels])
    whole = asked.filter("_whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_whole")))).withColumn("taken", F.col(tokens))
    whole = whole.withColumn("_key", order_key(seed, F.col("epoch"), F.col(id_col))).drop("_whole", "_part")
    last = asked.filter("_part > 0").withColumn("epoch", F.col("_whole") + 1).drop("_whole")
    last = last.withColumn("_key", order_key(seed, F.col("epoch"), F.col(id_col))).withColumn("_slice", F.substring("_key", 1, SLICE))
    sums = last.groupBy(*levels, "_slice").agg(F.sum(tokens).alias("_sum"), F.max("_part").alias("_quota"))
    before = W.partitionBy(*levels).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    placed = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).filter(F.col("_before") < F.col("_quota"))
    marks = placed.select(*[F.col(k).alias(f"_{k}") for k in levels], F.col("_slice").alias("_at"), "_before", (F.col("_before") + F.col("_sum") > F.col("_quota")).alias("_ends"))
    reached = last.join(marks, [*on, F.col("_slice") == F.col("_at")]).drop("_at", *[f"_{k}" for k in levels])
    inside = reached.filter(~F.col("_ends")).withColumn("taken", F.col(tokens))
    run = W.partitionBy(*levels).orderBy("_key", "_row").rowsBetween(W.unboundedPreceding, -1)
    edge = (
        reached.filter("_ends")
        .withColumn("_run", F.col("_before") + F.coalesce(F.sum(tokens).over(run), F.lit(0)))
        .withColumn("taken", F.least(F.col(tokens), F.col("_part") - F.col("_run")))
        .drop("_run")
    )
    cut = inside.unionByName(edge).filter(F.col("taken") > 0).drop("_part", "_slice", "_before", "_ends")
    return whole.filter(F.col("taken") > 0).unionByName(cut)


def mix_sources(
    docs: DataFrame,
    levels: list[str],
    tokens: Column,
    weights: list[DataFrame],
    percent: int = 100,
    most_epochs: int = 4,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The mix of ``docs``: (levels, id, epoch, tokens, taken), a row per document and epoch that takes part.

    ``percent`` of all tokens are given out, or as many as the leaves can give in ``most_epochs``. A null level value is a
    node of its own. Documents without tokens take no part; a null count is 0. Rows that repeat an id are placed by the hash of
    their text. At least two levels are needed; columns of ``docs`` beyond levels, id, text and what ``tokens`` reads are
    left out, whatever their names. An empty table gives an empty mix.
    """
    rows = kept_table(
        docs.select(*levels, id_col, F.coalesce(tokens, F.lit(0)).cast("bigint").alias("tokens"), F.xxhash64(text_col).alias("_row")).filter("tokens > 0"), "mix"
    )
    leaves = kept_table(with_weights(leaf_totals(rows, levels, "tokens"), levels, weights), "leaves")
    total = leaves.agg(F.coalesce(F.sum("available"), F.lit(0))).scalar()
    budgets = leaf_budgets(leaves, levels, F.floor(total * percent / 100), most_epochs)
    return take_prefixes(rows, budgets, levels, id_col, "tokens", seed).select(*levels, id_col, "epoch", "tokens", "taken", "_row")
