"""Seller, item and buyer profiles from trusted invoice history, and draft totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import skew
from ..functions import text as T

SELLER = ["seller_name", "seller_tax_id"]
BUYER = ["buyer_name", "buyer_tax_id"]


def dedupe_keys() -> list[Column]:
    """The twelve business fields that make two exported lines the same line."""
    plain = lambda c: F.upper(T.squeeze(c)).alias(f"k_{c}")
    item = F.upper(T.squeeze(T.first_filled("full_item_name", "project_name"))).alias("k_item")
    money = [F.bround(F.coalesce(F.col(c).cast("decimal(28,10)"), F.lit(0)), 2).alias(f"k_{c}") for c in ("amount", "tax_amount", "amount_with_tax")]
    return [
        *[plain(c) for c in ("seller_tax_id", "seller_name", "buyer_tax_id", "buyer_name", "serial")],
        F.substring("invoice_date", 1, 10).alias("k_date"), item, plain("tax_code"), plain("tax_rate"), *money,
    ]


def dedupe_history(history: DataFrame, order: tuple[str, ...] = ("source_file", "line_key"), columns: tuple[str, ...] | None = None) -> DataFrame:
    """First occurrence per business key; ``copies`` counts the rows it stands for.

    An aggregate that holds each value once, not a window: copies collapse on the map side, however many there are. Rows travel with 128 bits of their key and with
    ``columns``, all by default; a caller that reads few of them names these, because an aggregate over whole rows cannot be pruned.
    """
    wanted = list(columns or history.columns)
    keyed = history.select(*dict.fromkeys([*wanted, *order]), skew.digest(dedupe_keys()).alias("_key"))
    return skew.least_by(keyed, ["_key"], list(order), count_as="copies").select(*wanted, "copies")


def _variants(history: DataFrame, keys: list[str], pos: str = "line_key") -> DataFrame:
    """One row per key combination: rows, amount, dates and where it was seen first."""
    return history.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("line_count"),
        F.sum("amount_with_tax").alias("total"),
        F.min(T.or_none("invoice_date")).alias("first_date"),
        F.max(T.or_none("invoice_date")).alias("last_date"),
        F.min(pos).alias("first_pos"),
    )


def seller_profiles(history: DataFrame) -> DataFrame:
    """Per seller: rows, invoices, buyers, dates, total and the most frequent coded item."""
    variants = _variants(history, [*SELLER, "project_name", "tax_category", "tax_code", "tax_rate"])
    top = F.min_by(F.struct("project_name", "tax_category", "tax_code", "tax_rate"), F.struct(-F.col("line_count"), "first_pos"))
    base = variants.groupBy(*SELLER).agg(
        F.sum("line_count").alias("history_rows"),
        F.coalesce(F.min("first_date"), F.lit("")).alias("date_min"),
        F.coalesce(F.max("last_date"), F.lit("")).alias("date_max"),
        F.sum("total").alias("total_amount_with_tax"),
        top.alias("top"),
    )
    # Distinct pairs first: a hot seller is spread over its invoices and buyers before it is counted.
    invoices = history.filter(~T.is_blank("serial")).select(*SELLER, "serial").distinct().groupBy(*SELLER).agg(F.count(F.lit(1)).alias("invoice_count"))
    buyers = history.select(*SELLER, *BUYER).distinct().groupBy(*SELLER).agg(F.count(F.lit(1)).alias("buyer_count"))
    return (
        base.join(invoices, SELLER, "left")
        .join(buyers, SELLER, "left")
        .select(
            *SELLER, "history_rows", F.coalesce("invoice_count", F.lit(0)).alias("invoice_count"), "buyer_count", "date_min", "date_max",
            "total_amount_with_tax",
            F.col("top.project_name").alias("primary_project"),
            F.col("top.tax_category").alias("primary_tax_category"),
            F.col("top.tax_code").alias("primary_tax_code"),
            F.col("top.tax_rate").alias("primary_tax_rate"),
            F.lit("official_history_export").alias("source_confidence"),
        )
    )


PROJECT = ["full_item_name", "tax_category", "project_name", "tax_code", "tax_rate", "unit"]


def project_profiles(history: DataFrame) -> DataFrame:
    """Per seller and item variant: lines, amount and confidence; a blank unit counts as 项."""
    unit = history.withColumn("unit", T.first_filled("unit", default="项"))
    return _variants(unit, [*SELLER, *PROJECT]).select(
        *SELLER, *PROJECT, "line_count", F.col("total").alias("total_amount_with_tax"),
        F.when(F.col("line_count") >= 2, "high").otherwise("medium").alias("confidence"),
    )


def buyer_profiles(history: DataFrame) -> DataFrame:
    """Per seller and buyer: lines, invoices, amount, dates and the items by frequency."""
    pair = [*SELLER, *BUYER]
    items = _variants(history, [*pair, "project_name"])
    named = F.when(~T.is_blank("project_name"), F.struct((-F.col("line_count")).alias("n"), "first_pos", "project_name"))
    listed = F.transform(
        F.array_sort(F.collect_list(named)), lambda x: F.concat_ws(":", x["project_name"], (-x["n"]).cast("string"))
    )
    base = items.groupBy(*pair).agg(
        F.sum("line_count").alias("line_count"),
        F.sum("total").alias("total_amount_with_tax"),
        F.coalesce(F.min("first_date"), F.lit("")).alias("first_date"),
        F.coalesce(F.max("last_date"), F.lit("")).alias("last_date"),
        F.array_join(listed, "；").alias("common_projects"),
    )
    invoices = history.filter(~T.is_blank("serial")).select(*pair, "serial").distinct().groupBy(*pair).agg(F.count(F.lit(1)).alias("invoice_count_hint"))
    return base.join(invoices, pair, "left").withColumn("invoice_count_hint", F.coalesce("invoice_count_hint", F.lit(0)))


def dominant_line(rows: DataFrame, seller: str = "seller_name", pos: str = "line_key") -> DataFrame:
    """Per seller the most frequent positive item; its specification comes from its last row."""
    marks = F.concat_ws(" ", *[c for c in ("note", "coding_reference", "invoice_status", "invoice_direction") if c in rows.columns])
    good = rows.filter(
        ~marks.rlike("红字|红冲|作废") & ~F.coalesce(F.col("amount_with_tax").cast("string"), F.lit("")).startswith("-") & ~T.is_blank("project_name")
    )
    key = ["project_name", "tax_category", "tax_code", "tax_rate", "unit"]
    counted = good.groupBy(seller, *key).agg(
        F.count(F.lit(1)).alias("n"), F.min(pos).alias("first_pos"), F.max_by("specification", pos).alias("specification")
    )
    top = counted.groupBy(seller).agg(F.min_by(F.struct(*key, "specification", "n"), F.struct(-F.col("n"), "first_pos")).alias("t")).select(seller, "t.*")
    return top.select(
        seller, "project_name", "tax_category", "tax_code",
        T.first_filled("tax_rate", default="1%").alias("tax_rate"), "specification",
        T.first_filled("unit", default="项").alias("unit"), F.lit("1").alias("quantity"),
        F.col("project_name").alias("matched_source"),
        F.when(F.col("n") >= 2, "high").otherwise("medium").alias("confidence"),
    )


def draft_totals(lines: DataFrame) -> DataFrame:
    """Per draft: total, coded and pending lines, and a preview of the first three names."""
    amount = T.resolved_amount("amount_with_tax", "quantity", "unit_price")
    named = ~T.is_blank("project_name")
    totals = lines.groupBy("draft_id").agg(
        F.count(F.lit(1)).alias("line_count"),
        F.sum(amount).alias("total_amount"),
        F.count_if(~T.is_blank("tax_category") | ~T.is_blank("coding_reference")).alias("coded"),
        F.count_if(T.is_blank("tax_category")).alias("pending"),
        F.count_if(named).alias("named"),
    )
    firsts = skew.top_n(lines.filter(named).select("draft_id", "line_no", T.strip("project_name").alias("name")), ["draft_id"], [F.col("line_no")], 3)
    preview = firsts.groupBy("draft_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "name"))), lambda x: x["name"]), " / ").alias("head")
    )
    return totals.join(preview, "draft_id", "left").select(
        "draft_id", "line_count", "total_amount", "coded", "pending",
        F.when(F.col("named") == 0, "待补充")
        .when(F.col("named") <= 3, F.col("head"))
        .otherwise(F.concat("head", F.lit(" 等 "), F.col("named").cast("string"), F.lit(" 项")))
        .alias("project_preview"),
    )


def batch_items(drafts: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per draft of a batch: buyer, amount, first item, lines and the first open issue."""
    amount = T.resolved_amount("amount_with_tax", "quantity", "unit_price")
    open_line = T.is_blank("project_name") | amount.isNull() | T.is_blank("tax_rate") | T.is_blank("tax_code")
    totals = lines.groupBy("draft_id").agg(
        F.count(F.lit(1)).alias("line_count"), F.sum(amount).alias("amount_total"), F.count_if(open_line).alias("open_lines"),
        F.min_by("project_name", "line_no").alias("project_summary"),
    )
    opened = F.concat(F.lit("明细中仍有 "), F.col("open_lines").cast("string"), F.lit(" 行缺少税收分类、税收编码、税率或金额"))
    return drafts.join(totals, "draft_id", "left").select(
        "batch_id", "draft_id",
        T.first_filled("buyer_name", default="待补全购买方名称").alias("buyer_name"), "invoice_kind", "amount_total",
        F.coalesce("project_summary", F.lit("")).alias("project_summary"), F.coalesce("line_count", F.lit(0)).alias("line_count"),
        F.when(T.is_blank("buyer_name"), "必填：请补全购买方名称")
        .when(T.is_blank("buyer_tax_id"), "必填：请补全购买方税号")
        .when(F.coalesce("open_lines", F.lit(0)) > 0, opened)
        .otherwise("")
        .alias("issue_summary"),
    )


def profile_documents(projects: DataFrame, buyers: DataFrame) -> DataFrame:
    """Nested profile documents: one per seller, whole and sorted at every size.

    The nesting is the exchange format; ``projects`` and ``buyers`` are the flat rows, which jobs over all sellers should use.
    """
    items = projects.select(
        *SELLER, F.lit(True).alias("is_project"), F.struct((-F.col("line_count")).alias("n"), *PROJECT, "confidence").alias("project"),
        F.lit(None).alias("buyer"),
    )
    people = buyers.select(*SELLER, F.lit(False).alias("is_project"), F.lit(None).alias("project"), F.struct((-F.col("line_count")).alias("n"), *BUYER).alias("buyer"))
    both = items.unionByName(people)
    docs = both.groupBy(*SELLER).agg(
        F.array_sort(F.collect_list("project")).alias("p"), F.array_sort(F.collect_list("buyer")).alias("b")
    )
    return docs.select(
        *SELLER, F.lit("official_history_export").alias("source_confidence"),
        F.transform("p", lambda x: F.struct(*[x[c].alias(c) for c in PROJECT], (-x["n"]).alias("line_count"), x["confidence"].alias("confidence"))).alias("project_profiles"),
        F.transform("b", lambda x: F.struct(*[x[c].alias(c) for c in BUYER], (-x["n"]).alias("line_count"))).alias("buyer_profiles"),
    )


def flatten_profiles(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profile documents back to item rows and buyer rows."""
    projects = documents.select(*SELLER, F.explode("project_profiles").alias("e")).select(*SELLER, "e.*")
    buyers = documents.select(*SELLER, F.explode("buyer_profiles").alias("e")).select(*SELLER, "e.*")
    return projects, buyers


def active_profiles(sellers: DataFrame, projects: DataFrame, buyers: DataFrame, tenant: str, seller_tax_id: str = "", seller_name: str = "") -> DataFrame:
    """Active sellers of a tenant, by id or part of the name, with their entries as documents."""
    chosen = sellers.filter((F.col("tenant") == (tenant.strip() or "default")) & (F.col("status") == "active"))
    if seller_tax_id.strip():
        chosen = chosen.filter(F.col("seller_tax_id") == seller_tax_id.strip())
    if seller_name.strip():
        chosen = chosen.filter(F.lower("seller_name").contains(seller_name.strip().lower()))
    wanted = chosen.select(*SELLER)
    documents = profile_documents(projects.join(wanted, SELLER, "left_semi"), buyers.join(wanted, SELLER, "left_semi"))
    return chosen.select(*SELLER, "updated_at").join(documents, SELLER, "left").orderBy(F.desc("updated_at"), "seller_name")
