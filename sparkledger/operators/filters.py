"""Row filters and predicates over history, lines, rules and record batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def trusted_history(history: DataFrame) -> DataFrame:
    """Normal, positive invoices without reversal marks. Plain predicates, so they reach the scan."""
    void = F.concat_ws(" ", "full_item_name", "invoice_status", "risk_level").rlike("红字|红冲|作废")
    return history.filter(
        F.coalesce("invoice_status", F.lit("")).isin("", "正常")
        & F.coalesce("is_positive", F.lit("")).isin("", "是")
        & (F.coalesce("amount_with_tax", F.lit(0)) >= 0)
        & (F.coalesce("amount", F.lit(0)) >= 0)
        & ~void
    )


def is_low_confidence(reference: str = "coding_reference", markers=T.LOW_CONFIDENCE_MARKERS) -> Column:
    return T.contains_any(F.concat_ws(" ", reference, "project_name", "specification"), markers)


def line_issues(lines: DataFrame) -> DataFrame:
    """Adds what a reviewer must check: missing fields, low-confidence source, exempt rate."""
    amount = T.resolved_amount("amount_with_tax", "quantity", "unit_price")
    missing = F.array_compact(
        F.array(
            F.when(T.is_blank("project_name"), "project_name"),
            F.when(amount.isNull(), "amount_with_tax"),
            F.when(T.is_blank("tax_rate"), "tax_rate"),
            F.when(T.is_blank("tax_code"), "tax_code"),
        )
    )
    return (
        lines.withColumn("missing", F.array_join(missing, ","))
        .withColumn("low_confidence", is_low_confidence(markers=T.REVIEW_MARKERS))
        .withColumn("exempt", T.canonical_rate("tax_rate").isin(*T.EXEMPT_WORDS))
    )


def review_filter(lines: DataFrame) -> DataFrame:
    """Only the lines that need a look."""
    return line_issues(lines).filter((F.col("missing") != "") | F.col("low_confidence") | F.col("exempt"))


def name_classes(df: DataFrame, column: str = "project_name") -> DataFrame:
    return (
        df.withColumn("generic", T.is_generic_name(column))
        .withColumn("weak", T.is_weak_name(column))
        .withColumn("low_confidence", T.is_low_confidence_name(column))
        .withColumn("uncoded", T.is_uncoded_name(column))
    )


# Totals, amount-in-words signs, marker cells and label prefixes of loose tables.
TOTAL_WORDS = ("合计", "小计", "总计")
MARKER_CELLS = ("大写", "小写", "未税", "含税", "合计")
LABEL_PREFIXES = (
    "税号", "统一社会信用代码", "纳税人识别号", "地址", "电话", "开户行", "银行账号", "账号", "日期", "备注",
    "业主单位名称", "业主开票要求", "证明材料", "发票申请联络函",
)
AMOUNT_IN_WORDS = "^[零〇一二三四五六七八九十百千万亿壹贰叁肆伍陆柒捌玖拾佰仟元角分整]+$"


def is_label(value: Column | str) -> Column:
    text = F.regexp_replace(T.strip(value), "[：:]", "")
    return text.rlike("^(" + "|".join(LABEL_PREFIXES) + ")")


def is_number_only(value: Column | str) -> Column:
    return F.regexp_replace(T.strip(value), "[,，]", "").rlike(r"^[0-9]+(\.[0-9]+)?$")


def is_summary_row() -> Column:
    name = T.strip("project_name")
    marker = F.lit(False)
    for cell in ("tax_category", "unit_price", "specification"):
        marker = marker | T.strip(cell).isin(*MARKER_CELLS)
    return (name != "") & (name.isin(*TOTAL_WORDS) | name.rlike(AMOUNT_IN_WORDS) | marker)


def drop_summary_rows(lines: DataFrame) -> DataFrame:
    """Keeps real detail rows: no totals, labels or bare numbers, and something to bill."""
    detail = (
        ~T.is_blank("amount_with_tax")
        | ~T.is_blank("tax_code")
        | ~T.is_blank("source_item_code")
        | (~T.is_blank("quantity") & ~T.is_blank("unit_price"))
    )
    return lines.filter(
        ~T.is_blank("project_name") & ~is_label("project_name") & ~is_number_only("project_name") & ~is_summary_row() & detail
    )


# Review results that release a rule.
APPROVED = ("approved", "ready", "publish", "published", "通过", "发布")


def publishable_rules(candidates: DataFrame, include_pending: bool = False) -> DataFrame:
    """Reviewed candidates that may be published; confidence becomes 'tenant_reviewed'."""
    keep = ~T.is_blank("raw_alias") & ~T.is_blank("tax_category")
    if not include_pending:
        keep = keep & T.strip("status").isin(*APPROVED)
    return candidates.filter(keep).select(
        T.strip("candidate_id").alias("rule_id"),
        T.strip("raw_alias").alias("raw_alias"),
        T.first_filled("normalized_invoice_name", F.element_at(F.split("raw_alias", "、"), 1)).alias("normalized_invoice_name"),
        T.strip("tax_category").alias("tax_category"),
        T.strip("tax_code").alias("tax_code"),
        T.strip("tax_treatment_or_rate").alias("tax_treatment_or_rate"),
        T.first_filled("decision_basis", default="中心端候选审核通过").alias("decision_basis"),
        F.lit("tenant_reviewed").alias("confidence"),
        T.strip("case_ids").alias("source_case_ids"),
        T.strip("company_names").alias("company_name"),
    )


REQUIRED_FIELDS = {
    "event": ("event_id", "case_id", "event_type", "created_at"),
    "rule": ("raw_alias", "tax_category"),
    "profile": ("seller_name", "seller_tax_id"),
    "extraction": ("项目名称", "金额", "税率"),
}


def valid_records(records: DataFrame, kind: str, batch: str = "batch_id", pos: str = "pos", fields=None) -> DataFrame:
    """All-or-nothing check per batch: the first record with a blank required field, and the field."""
    missing = None
    for field in fields or REQUIRED_FIELDS[kind]:
        missing = F.when(T.is_blank(field), field) if missing is None else missing.when(T.is_blank(field), field)
    marked = records.withColumn("_missing", missing)
    return marked.groupBy(batch).agg(
        F.count(F.lit(1)).alias("records"),
        F.min(F.when(F.col("_missing").isNotNull(), F.col(pos))).alias("first_bad_pos"),
        F.min_by("_missing", F.when(F.col("_missing").isNotNull(), F.col(pos))).alias("missing_field"),
    ).withColumn("valid", F.col("first_bad_pos").isNull())
