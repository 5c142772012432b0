"""Column standardisation of lines, names, ids, rules and texts (whole-table projections)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import skew
from ..functions import text as T


def standardize_lines(lines: DataFrame) -> DataFrame:
    """Adds ``amount``: stated amount, else quantity x price, two decimals half up."""
    return lines.withColumn("amount", T.resolved_amount("amount_with_tax", "quantity", "unit_price"))


def canonical_rates(lines: DataFrame) -> DataFrame:
    return lines.withColumn("rate", T.canonical_rate("tax_rate"))


def sheet_rates(lines: DataFrame) -> DataFrame:
    return lines.withColumn("sheet_rate", T.sheet_rate("tax_rate"))


def tax_preview(lines: DataFrame) -> DataFrame:
    """Tax inside each tax-inclusive line, rounded half up to cents; null without amount or rate."""
    # One projection per step: the rate text is read once, not once per use.
    rated = standardize_lines(lines).withColumn("_text", T.canonical_rate("tax_rate")).withColumn("_rate", T.rate_number("_text"))
    tax = F.round(F.col("amount") - F.col("amount") / (1 + F.col("_rate")), 2).cast("decimal(18,2)")
    return rated.withColumn("tax_amount", tax).drop("_text", "_rate")


def tax_totals(lines: DataFrame) -> DataFrame:
    """Per draft: amount and the sum of the rounded line taxes."""
    zero = F.lit(0).cast("decimal(18,2)")
    return tax_preview(lines).groupBy("draft_id").agg(
        F.coalesce(F.sum("amount"), zero).alias("amount_total"), F.coalesce(F.sum("tax_amount"), zero).alias("tax_total")
    )


def key_columns(df: DataFrame, column: str) -> DataFrame:
    return (
        df.withColumn("alias_key", T.alias_key(column))
        .withColumn("search_key", T.search_key(column))
        .withColumn("compact_key", T.compact_key(column))
        .withColumn("candidate_key", T.candidate_key(column))
    )


def split_full_name(value: Column | str) -> tuple[Column, Column]:
    """'*category*name' to (category, name); other names have no category."""
    text = T.strip(value)
    hit = text.rlike(r"^\*[^*]+\*.+$")
    category = F.when(hit, T.strip(F.regexp_extract(text, r"^\*([^*]+)\*(.+)$", 1))).otherwise("")
    name = F.when(hit, T.strip(F.regexp_extract(text, r"^\*([^*]+)\*(.+)$", 2))).otherwise(F.regexp_replace(text, r"^\*+|\*+$", ""))
    return category, name


def star_parts(value: Column | str) -> Column:
    return F.filter(F.transform(F.split(T.strip(value), r"\*"), T.strip), lambda p: p != "")


def split_parts_name(value: Column | str, parts: Column | None = None) -> tuple[Column, Column]:
    """First and last of the '*' parts; a single part is the name. ``parts``: a column that has them already."""
    parts = star_parts(value) if parts is None else parts
    many = F.size(parts) >= 2
    name = F.when(many, F.try_element_at(parts, F.lit(-1))).otherwise(F.regexp_replace(T.strip(value), r"^\*+|\*+$", ""))
    return F.when(many, F.try_element_at(parts, F.lit(1))).otherwise(""), name


def split_inline_name(category: Column | str, value: Column | str) -> tuple[Column, Column]:
    """Category typed in front of the name ('*c*n' or 'c*n'), used only where the line has none."""
    text = T.strip(value)
    starred, bare = r"^\*([^*]+)\*(.+)$", r"^([一-鿿A-Za-z0-9（）()、]{2,30})\*(.+)$"
    own = F.coalesce(F.col(category) if isinstance(category, str) else category, F.lit(""))
    given = F.col(value) if isinstance(value, str) else value
    out_category = (
        F.when(own != "", own)
        .when(text.rlike(starred), T.strip(F.regexp_extract(text, starred, 1)))
        .when(text.rlike(bare), T.strip(F.regexp_extract(text, bare, 1)))
        .otherwise(own)
    )
    out_name = (
        F.when(own != "", given)
        .when(text.rlike(starred), T.strip(F.regexp_extract(text, starred, 2)))
        .when(text.rlike(bare), T.strip(F.regexp_extract(text, bare, 2)))
        .otherwise(given)
    )
    return out_category, out_name


def split_item_names(df: DataFrame, column: str) -> DataFrame:
    strict, parts = split_full_name(column), split_parts_name(column)
    inline = split_inline_name(F.lit(""), column)
    return df.select(
        "*", strict[0].alias("category"), strict[1].alias("name"), parts[0].alias("first_part"), parts[1].alias("last_part"),
        inline[0].alias("inline_category"), inline[1].alias("inline_name"),
    )


def invoice_kinds(drafts: DataFrame) -> DataFrame:
    """Sheet spelling of kind, yes/no and contact-display fields."""
    return drafts.withColumn("sheet_kind", T.invoice_kind("invoice_kind")).withColumn(
        "contact_display",
        T.contact_display(F.lit(""), "buyer_address", "buyer_phone", "buyer_bank_name", "buyer_bank_account"),
    )


def tax_id_quality(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("needs_review", T.tax_id_needs_review(column)).withColumn("unreliable", T.tax_id_unreliable(column))


def expand_aliases(df: DataFrame, column: str, kind: str = "rule") -> DataFrame:
    """One row per alias with its place in the list; ``kind`` is 'rule' or 'buyer'."""
    aliases = T.split_aliases(column) if kind == "rule" else T.buyer_aliases(column)
    return df.select("*", F.posexplode(aliases).alias("alias_pos", "alias")).withColumn("alias_pos", F.col("alias_pos") + 1)


def rule_ids(rules: DataFrame) -> DataFrame:
    """Stable id from alias, category, code and rate keys."""
    basis = F.concat_ws("|", T.alias_key("raw_alias"), T.alias_key("tax_category"), T.alias_key("tax_code"), T.rate_key("tax_treatment_or_rate"))
    return rules.withColumn("rule_id", F.concat(F.lit("learned-"), F.substring(F.sha1(F.encode(basis, "UTF-8")), 1, 12)))


def chinese_amounts(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("amount_text", T.chinese_amount(column))


def token_columns(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("bigrams", T.bigrams(T.alias_key(column))).withColumn("tokens", T.business_tokens(column))


# Marker words of the document kinds.
HISTORY_MARKERS = ("发票号码", "开票日期", "销售方", "购买方", "税收分类编码", "价税合计")
INVOICE_MARKERS = ("发票号码", "价税合计", "购买方", "销售方", "税额", "电子发票")


def _marker_count(text: Column, markers) -> Column:
    total = F.lit(0)
    for marker in markers:
        total = total + text.contains(marker).cast("int")
    return total


def document_kind(name: Column, suffix: Column, text: Column) -> Column:
    """Kind of a material from its extension and the words in it."""
    compact, low = T.squeeze(text), F.lower(name)
    contract = low.contains("合同") | compact.contains("合同")
    sheet = (
        F.when(F.concat(low, compact).rlike("(?i)(余额表|收入|流水|银行流水|银行明细|his|对账)"), "财务流水/余额线索")
        .when(text.rlike("(?i)(车架号|车辆识别代号|合格证|机动车|VIN)"), "机动车异常表")
        .when(compact.rlike("开票联络函|发票申请|开发票"), "开票联络函/申请表")
        .when(contract, "合同/清单 Excel")
        .when(_marker_count(compact, HISTORY_MARKERS) >= 4, "税局历史 Excel")
        .otherwise("本次开票样单 Excel")
    )
    pdf = F.when(_marker_count(compact, INVOICE_MARKERS) >= 3, "样票 PDF").when(contract, "合同 PDF").otherwise("PDF 材料")
    word = F.when(
        compact.rlike("(开发票信息|开票信息|单位名称|纳税识别号|纳税人识别号|统一社会信用代码)"), "客户开票信息 Word"
    ).otherwise("Word 材料")
    plain = F.when(compact.rlike("(微信|群聊|聊天|客户说|麻烦|帮忙|开票|发票)"), "群文本/整理文本").otherwise("文本材料")
    return (
        F.when(suffix == ".zip", "压缩包材料")
        .when(suffix == ".7z", "压缩包需解压")
        .when(suffix.isin(".xls", ".xlsx", ".csv", ".tsv"), sheet)
        .when(suffix == ".pdf", pdf)
        .when(suffix.isin(".doc", ".docx"), word)
        .when(suffix.isin(".txt", ".md"), plain)
        .otherwise("文档材料")
    )


def classify_documents(docs: DataFrame) -> DataFrame:
    """Adds ``material_type`` from ``file_name`` and ``text``."""
    suffix = F.lower(F.regexp_extract("file_name", r"(\.[^.]+)$", 1))
    return docs.withColumn("material_type", document_kind(F.col("file_name"), suffix, F.coalesce("text", F.lit(""))))


def image_tag(name: Column) -> Column:
    """Tag of an uploaded picture from its file name; null for other files."""
    low = F.lower(name)
    return F.when(
        low.rlike(r"\.(png|jpg|jpeg|bmp|gif|webp)$"),
        F.when(low.rlike("(wechat|微信|群聊|聊天|screenshot|截图|longscreenshot)"), "群聊截图")
        .when(low.rlike("(车|牌|维修|事故|照片|photo|image)"), "车辆/现场照片")
        .otherwise("图片材料"),
    )


def material_tags(tagged: DataFrame, limit: int = 8) -> DataFrame:
    """First ``limit`` distinct tags per draft, in order of first appearance."""
    first = tagged.filter(~T.is_blank("tag")).groupBy("draft_id", "tag").agg(F.min("pos").alias("pos"))
    kept = skew.top_n(first, ["draft_id"], [F.col("pos"), F.col("tag")], limit)
    return kept.groupBy("draft_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag"))), lambda t: t["tag"]), " / ").alias("tags")
    )


def invoice_profile(texts: DataFrame, column: str = "text") -> DataFrame:
    """Invoice kind, medium and special business a request text asks for."""
    compact = F.regexp_replace(T.strip(column), " ", "")
    label = F.regexp_extract(
        compact, "(?:发票类型|票种|开票类型)[：:\t ]?(增值税专用发票|专用发票|专票|增票|增值税普通发票|普通发票|普票)", 1
    )
    ticked_special = compact.rlike("专用发票[（(]?[√✓✔]")
    ticked_normal = compact.rlike("普通发票[（(]?[√✓✔]")
    names_special = compact.contains("增值税专用发票") & ~compact.contains("普通发票")
    says_special = compact.rlike("(开专票|专票|电子专票|增票)")
    says_normal = compact.rlike("(开普票|普票|普通发票（?√|增值税普通发票（?√)")
    labelled_normal = label.isin("普通发票", "增值税普通发票", "普票")
    labelled_special = label.isin("增值税专用发票", "专用发票", "专票", "增票")
    special, normal = F.lit("增值税专用发票"), F.lit("普通发票")
    kind = (
        F.when(labelled_normal, normal)
        .when(labelled_special, special)
        .when(ticked_normal & ~ticked_special, normal)
        .when(ticked_special & ~ticked_normal, special)
        .when(says_normal & ~says_special, normal)
        .when(says_special & ~says_normal, special)
        .when(names_special, special)
        .otherwise(normal)
    )
    has_all = (
        compact.rlike("(税务登记号|税号|纳税人识别号|统一社会信用代码)")
        & compact.rlike("(开户行|开户银行)")
        & compact.rlike("(银行账号|账号)")
        & compact.rlike("(地址|电话)")
    )
    kind = F.when((kind == normal) & ~(says_normal | labelled_normal) & has_all, special).otherwise(kind)
    medium = F.when(compact.rlike("(纸质发票|纸票)"), "纸质发票").otherwise("电子发票")
    business = F.when(compact.rlike("(?i)(机动车|车架号|车辆识别代号|VIN|合格证|厂牌型号|发动机号|发动机号码)"), "机动车").otherwise("")
    return texts.select("*", kind.alias("invoice_kind"), medium.alias("invoice_medium"), business.alias("special_business"))
