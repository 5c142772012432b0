"""Import sheets, their validation, rejections and repairs, draft differences and review reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import skew
from ..functions import text as T
from ..functions.kept import kept_table
from . import taxonomy as tree
from .coding import LINE
from .filters import is_low_confidence

BASIC_SHEET, DETAIL_SHEET, EXTRA_SHEET = "1-发票基本信息", "2-发票明细信息", "4-附加要素信息"


# --- sheets ---------------------------------------------------------------------------------

def select_exports(ids: DataFrame, drafts: DataFrame, items: DataFrame) -> DataFrame:
    """Each id as a batch first (its drafts in order), else as a draft; others are reported as unknown.

    ``items`` lists the drafts of each batch: batch_id, item_pos, draft_id.
    """
    wanted = ids.select("identifier").distinct()
    as_batch = wanted.join(items.select(F.col("batch_id").alias("identifier"), "item_pos", "draft_id"), "identifier").select(
        "identifier", F.lit("draft_batch").alias("source_type"), "item_pos", "draft_id"
    )
    rest = wanted.join(items.select(F.col("batch_id").alias("identifier")).distinct(), "identifier", "left_anti")
    known = drafts.select(F.col("draft_id").alias("identifier")).distinct()
    as_draft = rest.join(known, "identifier", "left_semi").select(
        "identifier", F.lit("draft").alias("source_type"), F.lit(1).alias("item_pos"), F.col("identifier").alias("draft_id")
    )
    unknown = rest.join(known, "identifier", "left_anti").select(
        "identifier", F.lit("unknown").alias("source_type"), F.lit(0).alias("item_pos"), F.lit(None).cast("string").alias("draft_id")
    )
    return as_batch.withColumn("item_pos", F.col("item_pos").cast("bigint")).unionByName(as_draft.withColumn("item_pos", F.col("item_pos").cast("bigint"))).unionByName(
        unknown.withColumn("item_pos", F.col("item_pos").cast("bigint"))
    )


def sheet_money(value: Column | str) -> Column:
    """Two decimals for numbers, other text as it is."""
    number = T.parse_money(value)
    return F.when(number.isNull(), T.strip(value)).otherwise(T.money_text(number))


def basic_sheet(drafts: DataFrame) -> DataFrame:
    """One row per invoice."""
    return drafts.select(
        F.col("draft_id").alias("serial_no"), T.invoice_kind("invoice_kind").alias("invoice_type"), T.strip("special_business").alias("special_business_type"),
        F.lit("是").alias("price_includes_tax"), T.yes_no(F.lit("")).alias("natural_person"),
        "buyer_name", "buyer_tax_id", "buyer_address", "buyer_phone", "buyer_bank_name", "buyer_bank_account",
        T.contact_display(F.lit(""), "buyer_address", "buyer_phone", "buyer_bank_name", "buyer_bank_account").alias("contact_display"),
        T.strip("note").alias("note"),
    )


def detail_sheet(lines: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """One row per line with its resolved code and the rate as a fraction."""
    amount = T.money_text(T.resolved_amount("amount_with_tax", "quantity", "unit_price"))
    return tree.resolve_codes(lines, taxonomy, sheet=True).select(
        F.col("draft_id").alias("serial_no"), "line_no", "project_name", F.col("resolved_code").alias("tax_code"), "specification", "unit",
        sheet_money("quantity").alias("quantity"), sheet_money("unit_price").alias("unit_price"), amount.alias("amount"),
        T.sheet_rate("tax_rate").alias("tax_rate"), T.yes_no(F.lit("")).alias("preferential"), "resolved_short",
    )


def extra_sheet(drafts: DataFrame, fields: str = "extra_fields") -> DataFrame:
    """One row per non-blank extra field (a map column)."""
    return drafts.select(F.col("draft_id").alias("serial_no"), F.explode(fields).alias("name", "content")).filter(~T.is_blank("content"))


TEXT_HEADERS = ("项目名称", "赋码大类", "税收编码", "零件编码", "规格型号", "单位", "数量", "单价", "含税金额", "税率/征收率", "赋码说明")


def lines_to_text(lines: DataFrame) -> DataFrame:
    """Lines of a draft as one tab-separated table in line order, whole at every size."""
    amount = T.money_text(T.resolved_amount("amount_with_tax", "quantity", "unit_price"))
    row = F.concat_ws("\t", "project_name", "tax_category", "tax_code", "source_item_code", "specification", "unit", "quantity", "unit_price", amount, T.canonical_rate("tax_rate"), "coding_reference")
    rows = lines.select("draft_id", "line_no", row.alias("row"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "row"))), lambda x: x["row"])
    return rows.groupBy("draft_id").agg(F.array_join(F.concat(F.array(F.lit("\t".join(TEXT_HEADERS))), listed), "\n").alias("text"))


# --- validation -----------------------------------------------------------------------------

def _issue(when: Column, header: str, value: Column | str, message: str | Column) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    shown = F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))
    return F.when(when, F.struct(F.lit(header).alias("header"), T.strip(shown).alias("value"), text.alias("message")))


def _rows(df: DataFrame, sheet: str, row: str, issues: list[Column]) -> DataFrame:
    return df.select(F.lit(sheet).alias("sheet"), "serial_no", F.col(row).cast("bigint").alias("row"), F.explode(F.array_compact(F.array(*issues))).alias("i")).select(
        F.lit("error").alias("level"), "sheet", "serial_no", "row", "i.*"
    )


def summary_codes(codes: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Those of the distinct codes that have a more detailed entry below them."""
    wanted = codes.select("tax_code").filter(~T.is_blank("tax_code")).distinct().withColumn("prefix", tree.code_prefix("tax_code"))
    wanted = wanted.filter((F.col("prefix") != "") & (F.col("prefix") != F.col("tax_code")))
    lengths = skew.key_lengths(wanted, "prefix").alias("_lengths")
    starts = taxonomy.select("official_code", lengths).select(
        "official_code", F.explode(skew.substrings(F.col("official_code"), F.col("_lengths"), prefix_only=True)).alias("prefix")
    )
    return wanted.join(starts, "prefix").filter(F.col("official_code") != F.col("tax_code")).select("tax_code").distinct()


def validate_sheets(basic: DataFrame, detail: DataFrame, taxonomy: DataFrame, options: DataFrame | None = None) -> DataFrame:
    """One row per fault of the two sheets; ``basic`` has ``row``, ``detail`` has ``line_no`` as its row.

    ``options`` (sheet, header, value) lists the texts a template allows in a column.
    """
    need = lambda c, h: _issue(T.is_blank(c), h, c, f"{h} 为必填项")
    first = basic.filter(~T.is_blank("serial_no")).groupBy("serial_no").agg(F.min("row").alias("_first"), F.count(F.lit(1)).alias("_times"))
    repeated = first.filter(F.col("_times") > 1)
    contact = ~T.is_blank("buyer_address") | ~T.is_blank("buyer_phone") | ~T.is_blank("buyer_bank_name") | ~T.is_blank("buyer_bank_account")
    b = basic.join(repeated, "serial_no", "left")
    parts = [
        _rows(
            b, BASIC_SHEET, "row",
            [
                need("serial_no", "发票流水号"), need("invoice_type", "发票类型"), need("price_includes_tax", "是否含税"), need("buyer_name", "购买方名称"),
                _issue(F.col("row") > F.col("_first"), "发票流水号", "serial_no", "发票流水号重复"),
                _issue(F.col("invoice_type").contains("专用") & T.is_blank("buyer_tax_id"), "购买方纳税人识别号", "buyer_tax_id", "专票必须填写购买方纳税人识别号"),
                _issue(F.length("buyer_name") > 100, "购买方名称", "buyer_name", "购买方名称超过 100 字符"),
                _issue(~T.strip("price_includes_tax").isin("是", "否"), "是否含税", "price_includes_tax", "是否含税只能填写 是 或 否"),
                _issue(contact & T.is_blank("contact_display"), "是否展示购买方地址电话银行账号", "contact_display",
                       "已填写购买方地址/电话/开户行/账号时，应选择官方展示项，不能留空或填写 是/否"),
            ],
        )
    ]
    rate = T.strip("tax_rate")
    number = rate.try_cast(T.MONEY_TYPE)
    coarse = summary_codes(detail, taxonomy).withColumn("_coarse", F.lit(True))
    heads = basic.filter(~T.is_blank("serial_no")).select("serial_no").distinct().withColumn("_head", F.lit(True))
    d = detail.join(coarse, "tax_code", "left").join(heads, "serial_no", "left")
    parts.append(
        _rows(
            d, DETAIL_SHEET, "line_no",
            [
                need("serial_no", "发票流水号"), need("project_name", "项目名称"), need("tax_code", "商品和服务税收编码"), need("amount", "金额"), need("tax_rate", "税率"),
                _issue(~T.is_blank("serial_no") & F.col("_head").isNull(), "发票流水号", "serial_no", "明细中的发票流水号未在基本信息 sheet 中出现"),
                _issue(rate.endswith("%"), "税率", "tax_rate", "税率在批量导入模板中应填写小数，例如 13% 应填写 0.13"),
                _issue((rate != "") & ~rate.endswith("%") & number.isNull(), "税率", "tax_rate", "税率必须是小数，例如 0.13、0.03、0.01 或 0"),
                _issue((number < 0) | (number > 1), "税率", "tax_rate", "税率应在 0 到 1 之间，例如 13% 应填写 0.13"),
                _issue(F.col("_coarse"), "商品和服务税收编码", "tax_code", "该商品编码是汇总商品编码，税局要求使用下级具体商编"),
            ],
        )
    )
    lone = serial_difference(basic.select("serial_no"), detail.select("serial_no"))
    parts.append(
        lone.select(
            F.lit("error").alias("level"), F.lit(DETAIL_SHEET).alias("sheet"), "serial_no", F.lit(0).cast("bigint").alias("row"), F.lit("发票流水号").alias("header"),
            F.col("serial_no").alias("value"), F.lit("基本信息存在该发票流水号，但明细信息没有对应行").alias("message"),
        )
    )
    if options is not None:
        for df, sheet, row, columns in (
            (basic, BASIC_SHEET, "row", {"发票类型": "invoice_type", "是否含税": "price_includes_tax"}),
            (detail, DETAIL_SHEET, "line_no", {"单位": "unit"} if "unit" in detail.columns else {}),
        ):
            if columns:
                parts.append(_option_issues(df, sheet, row, columns, options))
    return reduce(DataFrame.unionByName, parts)


def _option_issues(df: DataFrame, sheet: str, row: str, columns: dict[str, str], options: DataFrame) -> DataFrame:
    own = options.filter(F.col("sheet") == sheet)
    cells = df.select("serial_no", F.col(row).cast("bigint").alias("row"), F.explode(F.array(*[F.struct(F.lit(h).alias("header"), T.strip(c).alias("value")) for h, c in columns.items()])).alias("c"))
    cells = cells.select("serial_no", "row", "c.header", "c.value").filter(F.col("value") != "")
    allowed = own.groupBy("header").agg(F.array_join(F.array_sort(F.collect_set("value")), " / ").alias("allowed"))
    bad = cells.join(own.select("header", "value").distinct(), ["header", "value"], "left_anti").join(allowed, "header")
    return bad.select(
        F.lit("error").alias("level"), F.lit(sheet).alias("sheet"), "serial_no", "row", "header", "value",
        F.concat(F.lit("字段值不在官方模板下拉选项内，可选值："), "allowed").alias("message"),
    )


def serial_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Serials of ``left`` that ``right`` lacks."""
    clean = lambda df: df.select(T.strip("serial_no").alias("serial_no")).filter(F.col("serial_no") != "")
    return clean(left).subtract(clean(right))


def validation_report(issues: DataFrame, file: str = "file") -> DataFrame:
    return issues.groupBy(file).agg(
        F.count(F.lit(1)).alias("issue_count"), F.count_if(F.col("level") == "error").alias("error_count"), F.count_if(F.col("level") == "warning").alias("warning_count")
    )


# --- rejections -----------------------------------------------------------------------------

# Field names in the order they are looked for, and the ones that mean the code.
CODE_FIELD = "商品和服务税收编码"
KNOWN_FIELDS = (
    "是否展示购买方地址电话银行账号", "是否展示销售方地址电话银行账号", "商品编码", "商品和服务税收编码", "商品和服务税收分类编码", "商品和服务分类简称",
    "购买方纳税人识别号", "购买方税号", "购买方名称", "发票流水号", "发票类型", "特定业务类型", "是否含税", "税率", "金额", "项目名称", "单位", "数量", "单价", "备注",
)
CODE_SPELLINGS = ("商品编码", "商品和服务税收分类编码")
DETAIL_FIELDS = (CODE_FIELD, "商品和服务分类简称", "税率", "金额", "项目名称", "单位", "数量", "单价")
NAMED_FIELD = f"([{T.HAN}A-Za-z0-9（）()/%]+?)(?:码值不正确|不能为空|不能为必填|必填|格式不正确)"
# What to do about each type of rejection.
ACTIONS = {
    "seller_qualification_restriction": "这是当前销售方主体权限/资质限制，不是文件格式错误，也不要直接回写成赋码库错误。请改用具备对应资质的开票主体，或由会计人工确认是否存在可开具的替代税目口径。",
    "seller_tax_rate_restriction": "这是当前销售方主体/票种允许税率限制。请按税局返回的可用税率调整草稿后保存修改。",
    "taxonomy_code_level_error": "当前编码层级过粗。请改用税局允许的下级具体商品和服务税收编码。",
    "template_option_error": "当前字段值不符合税局模板下拉项。请按失败原因改成官方允许值。",
    "missing_required_field": "当前开票信息有必填字段缺失。请回到草稿补齐对应字段后保存修改。",
    "tax_bureau_validation_error": "税局返回业务校验失败。请按失败原因人工复核草稿字段和当前开票主体限制。",
}
RATE_LIST = "请使用如下税率"


def _allowed_rate(raw: Column) -> Column:
    text = F.regexp_replace(raw, r"\s+", "")
    number = F.regexp_replace(text, "%$", "").cast(T.MONEY_TYPE)
    value = F.when(text.endswith("%") | (number > 1), number).otherwise(number * 100)
    return F.concat(T.cut_zeros(F.bround(value, 2).cast("decimal(38,2)").cast("string")), F.lit("%"))


def classify_failures(failures: DataFrame) -> DataFrame:
    """Field, type, sheet, allowed rates and advice from the wording of each rejection."""
    reason = F.col("reason")
    coarse = reason.rlike("汇总商品|具体商编")
    field = F.when(coarse, CODE_FIELD)
    for name in KNOWN_FIELDS:
        field = field.when(reason.contains(name), CODE_FIELD if name in CODE_SPELLINGS else name)
    field = field.when(reason.contains("不允许填写") & reason.rlike(r"(?U)\b\d{19}\b"), CODE_FIELD).otherwise(
        F.regexp_replace(F.regexp_extract(reason, NAMED_FIELD, 1), "^[，,。:： ]+|[，,。:： ]+$", "")
    )
    kind = (
        F.when(reason.contains("不属于涉税专业服务机构"), "seller_qualification_restriction")
        .when(reason.contains("税率不合法") & reason.contains(RATE_LIST), "seller_tax_rate_restriction")
        .when(coarse, "taxonomy_code_level_error")
        .when(reason.rlike("码值不正确|字段值不在官方模板下拉选项"), "template_option_error")
        .when(reason.rlike("不能为空|必填"), "missing_required_field")
        .otherwise("tax_bureau_validation_error")
    )
    head = F.regexp_extract(reason, "^\\s*([^:：]+)[:：]", 1)
    sheet = F.when(head != "", T.strip(head)).when(F.col("field_name").isin(*DETAIL_FIELDS), DETAIL_SHEET).otherwise("")
    listed = F.regexp_extract_all(F.substring_index(reason, RATE_LIST, -1), F.lit(r"\d+(?:\.\d+)?\s*%?"), F.lit(0))
    rates = F.when(F.col("failure_type") == "seller_tax_rate_restriction", F.array_distinct(F.transform(listed, _allowed_rate))).otherwise(F.array().cast("array<string>"))
    action = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    return (
        failures.withColumn("field_name", field)
        .withColumn("failure_type", kind)
        .withColumn("source_sheet", sheet)
        .withColumn("allowed_values", rates)
        .withColumn("suggested_value", F.coalesce(F.try_element_at("allowed_values", F.lit(1)), F.lit("")))
        .withColumn("suggested_action", F.element_at(action, F.col("failure_type")))
    )


def failure_summary(failures: DataFrame) -> DataFrame:
    """Counts by field, by type and by sheet in one pass."""
    named = failures.select(*[T.first_filled(c, default="未识别").alias(c) for c in ("field_name", "failure_type", "source_sheet")])
    columns = [F.col(c) for c in ("field_name", "failure_type", "source_sheet")]
    counted = named.groupingSets([[c] for c in columns], *columns).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    dimension = F.when(F.col("g") == 3, "field").when(F.col("g") == 5, "type").otherwise("sheet")
    return counted.select(dimension.alias("dimension"), F.coalesce(*columns).alias("value"), "n")


HEADER_FIELDS = ("购买方名称", "购买方纳税人识别号", "购买方税号", "发票类型", "特定业务类型")
REPAIR_FIELDS = {
    "税率": "line_tax_rate", CODE_FIELD: "line_tax_code", "商品和服务分类简称": "line_tax_code", "项目名称": "line_project_name", "单位": "line_unit",
    "数量": "line_quantity", "单价": "line_unit_price", "金额": "line_amount_with_tax",
}


def target_failures(failures: DataFrame, lines: DataFrame) -> DataFrame:
    """Ties each rejection to its draft line (row number less three, or the only line) and to a repair."""
    field, reason = F.col("field_name"), F.col("reason")
    on_line = (F.col("source_sheet") == DETAIL_SHEET) | field.isin(*[f for f in DETAIL_FIELDS if f != "商品和服务分类简称"])
    row = F.regexp_extract(reason, r"第\s*(\d+)\s*行", 1).try_cast("bigint")
    asked = failures.withColumn("_row", F.when(on_line & (row >= 4), row - 3)).withColumn("_on_line", on_line)
    named = lines.select("draft_id", F.col("line_no").alias("_row"), F.struct("line_no", "project_name", T.strip("tax_rate").alias("rate")).alias("_by_row"))
    only = lines.groupBy("draft_id").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("line_no", "project_name", T.strip("tax_rate").alias("rate"))).alias("_only")).filter(F.col("_n") == 1).drop("_n")
    same_rate = lines.groupBy("draft_id", T.strip("tax_rate").alias("_rate")).agg(F.count(F.lit(1)).alias("_same"))
    joined = asked.join(named, ["draft_id", "_row"], "left").join(only, "draft_id", "left")
    joined = joined.withColumn("_line", F.when(F.col("_on_line"), F.coalesce("_by_row", "_only")))
    joined = joined.withColumn("_rate", F.col("_line.rate")).join(same_rate, ["draft_id", "_rate"], "left")
    hit = F.col("_line").isNotNull()
    name = F.col("_line.project_name")
    label = F.concat(F.lit("第 "), F.col("_line.line_no").cast("string"), F.lit(" 行"), F.when(name != "", F.concat(F.lit("："), name)).otherwise(""))
    on_header = (F.col("source_sheet") == BASIC_SHEET) | field.isin(*HEADER_FIELDS)
    focus = (
        F.when(field.isin(CODE_FIELD, "商品和服务分类简称"), "检查税收编码，必要时改成税局允许的下级具体编码")
        .when(field == "税率", "按税局允许税率调整这一行后保存修改")
        .when(field.isin("购买方纳税人识别号", "购买方税号"), "核对购买方税号格式和专票必填要求")
        .when(field == "购买方名称", "核对购买方名称是否为空、过长或与税号不匹配")
        .when(field.isin("单位", "数量", "单价", "金额", "项目名称"), F.concat(F.lit("补齐或修正明细里的"), field))
        .when(reason.contains("不属于涉税专业服务机构"), "这是销售方资质限制，先确认开票主体或替代税目口径")
        .otherwise("按税局失败原因复核草稿字段")
    )
    repair = F.create_map(*[F.lit(x) for kv in REPAIR_FIELDS.items() for x in kv])
    value = F.when(field == "税率", F.col("suggested_value")).otherwise("")
    out = joined.withColumns(
        {
            "target_line_no": F.col("_line.line_no"),
            "target_scope": F.when(hit, "line").when(on_header, "draft").otherwise("invoice"),
            "target_label": F.when(hit, label).when(on_header, "发票抬头 / 基本信息").otherwise("整张发票"),
            "repair_focus": focus,
            "repair_field": F.coalesce(F.try_element_at(repair, field), F.lit("")),
            "repair_value": value,
        }
    )
    ready = (F.col("repair_field") != "") & (F.col("repair_value") != "") & F.col("target_line_no").isNotNull()
    spread = ready & (F.col("failure_type") == "seller_tax_rate_restriction") & (F.col("_rate") != "") & (F.col("_rate") != F.col("repair_value")) & (F.col("_same") > 1)
    return out.withColumns(
        {
            "repair_status": F.when(ready, "ready").otherwise(""),
            "repair_scope": F.when(spread, "matching_lines").otherwise(""),
            "repair_target_line_count": F.when(spread, F.col("_same")).otherwise(F.when(ready, 1).otherwise(0)),
        }
    ).drop("_row", "_on_line", "_by_row", "_only", "_line", "_rate", "_same")


def failure_issues(targeted: DataFrame) -> DataFrame:
    """One issue text per rejection for its draft."""
    focus = T.first_filled("repair_focus", "field_name", default="请人工复核")
    return targeted.select("draft_id", "pos", F.concat(F.lit("税局退回："), T.first_filled("target_label", default="整张发票"), F.lit("，"), focus, F.lit("。")).alias("issue"))


def apply_repairs(targeted: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Applies the suggested rates draft by draft, in record order. Returns (new lines, change log).

    Lines of a draft that have the same rate always move together, so the records are folded over the
    few distinct rates of the draft, never over its lines.
    """
    own = T.strip("tax_rate")
    keyed = lines.withColumn("_key", F.when(own == "", F.concat(F.lit("line:"), F.col("line_no").cast("string"))).otherwise(own))
    records = targeted.filter((F.col("repair_status") == "ready") & (F.col("repair_field") == "line_tax_rate")).select(
        "draft_id", "pos", F.col("target_line_no").alias("line_no"), F.col("repair_value").alias("value")
    )
    # Written once: the steps and the rates they start from read it.
    aimed = kept_table(records.join(keyed.select("draft_id", "line_no", "_key"), ["draft_id", "line_no"]), "repairs")
    steps = aimed.groupBy("draft_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("_key").alias("key"), "value"))).alias("steps"))
    values = keyed.filter(own != "").select("draft_id", "_key", own.alias("_value")).unionByName(aimed.select("draft_id", "_key", F.lit("").alias("_value")).filter(F.col("_key").startswith("line:")))
    start = values.join(steps.select("draft_id"), "draft_id", "left_semi").distinct().groupBy("draft_id").agg(F.map_from_entries(F.collect_list(F.struct("_key", "_value"))).alias("start"))
    log_type = "array<struct<pos:bigint,key:string,previous:string,applied:string>>"
    state = F.struct(F.col("start").cast("map<string,string>").alias("m"), F.array().cast(log_type).alias("log"))

    def step(acc, r):
        m = acc["m"]
        now = F.element_at(m, r["key"])
        moves = lambda k, v: (now != r["value"]) & F.when(now == "", k == r["key"]).otherwise(v == now)
        moved = F.map_keys(F.map_filter(m, moves))
        log = F.transform(moved, lambda k: F.struct(r["pos"].cast("bigint").alias("pos"), k.alias("key"), now.alias("previous"), r["value"].alias("applied")))
        return F.struct(
            F.transform_values(m, lambda k, v: F.when(moves(k, v), r["value"]).otherwise(v)).cast("map<string,string>").alias("m"),
            F.concat(acc["log"], log).cast(log_type).alias("log"),
        )

    folded = steps.join(start, "draft_id").select("draft_id", F.aggregate("steps", state, step).alias("s"))
    final = folded.select("draft_id", F.explode("s.m").alias("_key", "_new"))
    new_lines = keyed.join(final, ["draft_id", "_key"], "left").withColumn("tax_rate", F.when(F.col("_new").isNotNull() & (F.col("_new") != own), F.col("_new")).otherwise(F.col("tax_rate"))).select(*lines.columns)
    moved = folded.select("draft_id", F.explode("s.log").alias("l")).select("draft_id", "l.pos", F.col("l.key").alias("_key"), F.col("l.previous").alias("previous_value"), F.col("l.applied").alias("applied_value"))
    log = moved.join(keyed.select("draft_id", "_key", "line_no", "project_name"), ["draft_id", "_key"]).select("draft_id", "pos", "line_no", "project_name", "previous_value", "applied_value")
    return new_lines, log


def repair_decisions(targeted: DataFrame, applied: DataFrame | None = None) -> DataFrame:
    """Decision per rejection: applied, safe_auto_repair, not_auto_repairable or manual_review."""
    if applied is None:
        marked = targeted.withColumn("applied_line_count", F.lit(0).cast("bigint"))
    else:
        counts = applied.groupBy("draft_id", "pos").agg(F.count(F.lit(1)).alias("applied_line_count"))
        marked = targeted.join(counts, ["draft_id", "pos"], "left").withColumn("applied_line_count", F.coalesce("applied_line_count", F.lit(0)))
    safe = F.col("target_line_no").isNotNull() & (F.col("repair_field") != "") & (F.col("repair_value") != "")
    never = (
        (F.col("failure_type") == "seller_qualification_restriction")
        | (F.col("failure_type").isin("taxonomy_code_level_error", "tax_bureau_validation_error") & F.col("field_name").isin(CODE_FIELD, "商品和服务分类简称"))
        | F.col("reason").rlike("不属于涉税专业服务机构|不允许填写")
    )
    decision = F.when(F.col("applied_line_count") > 0, "applied").when(safe, "safe_auto_repair").when(never, "not_auto_repairable").otherwise("manual_review")
    wide = (F.col("repair_scope") == "matching_lines") | (F.col("applied_line_count") > 1)
    return marked.withColumn("repair_decision", decision).withColumn("is_global", wide)


def repair_report(decided: DataFrame) -> DataFrame:
    """Counts per draft; applied ones count lines, and rejections that touch several lines are told apart."""
    d = F.col("repair_decision")
    applied = F.when(d == "applied", F.col("applied_line_count")).otherwise(0)
    return decided.groupBy("draft_id").agg(
        F.count(F.lit(1)).alias("failure_count"), F.count_if(d == "safe_auto_repair").alias("actionable_count"), F.sum(applied).alias("applied_count"),
        F.count_if(d == "manual_review").alias("manual_review_count"), F.count_if(d == "not_auto_repairable").alias("non_auto_count"),
        F.sum(applied + d.isin("safe_auto_repair", "manual_review").cast("int")).alias("human_confirmation_count"), F.count_if("is_global").alias("global_count"),
    )


def failures_by_line(decided: DataFrame) -> DataFrame:
    """Rejections shown at their line; those that touch several lines are shown above the table instead."""
    return decided.filter(~F.col("is_global") & F.col("target_line_no").isNotNull()).select("draft_id", "target_line_no", "pos", "field_name", "repair_decision")


# --- differences ----------------------------------------------------------------------------

# How fields are named in a list of changes.
HEADER_LABELS = {
    "buyer_name": "购买方名称", "buyer_tax_id": "购买方税号", "buyer_address": "购买方地址", "buyer_phone": "购买方电话", "buyer_bank_name": "购买方开户行",
    "buyer_bank_account": "购买方银行账号", "invoice_kind": "发票类型", "special_business": "特定业务", "note": "备注",
}
LINE_LABELS = {
    "project_name": "项目名称", "tax_category": "赋码大类", "tax_code": "税收编码", "specification": "规格型号", "unit": "单位", "quantity": "数量",
    "unit_price": "单价", "amount_with_tax": "含税金额", "tax_rate": "税率", "coding_reference": "赋码说明",
}


def _changed(pairs) -> Column:
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.array_compact(F.array(*[F.when(text(b) != text(a), F.struct(label.alias("field_name"), text(b).alias("before"), text(a).alias("after"))) for label, b, a in pairs]))


def diff_drafts(before: DataFrame, after: DataFrame, lines_before: DataFrame, lines_after: DataFrame) -> DataFrame:
    """Changed header fields and line fields; lines that came or went are shown as JSON."""
    heads = before.alias("b").join(after.alias("a"), "draft_id").select(
        "draft_id", F.lit(0).cast("bigint").alias("line_no"), F.explode(_changed([(F.lit(label), F.col(f"b.{c}"), F.col(f"a.{c}")) for c, label in HEADER_LABELS.items()])).alias("d")
    )
    keys = ["draft_id", "line_no"]
    b = lines_before.select(*keys, F.struct(*LINE).alias("b"))
    a = lines_after.select(*keys, F.struct(*LINE).alias("a"))
    both = b.join(a, keys, "full").withColumn("head", F.concat(F.lit("第 "), F.col("line_no").cast("string"), F.lit(" 行")))
    one = lambda name, old, new: F.array(F.struct(name.alias("field_name"), old.alias("before"), new.alias("after")))
    # Lines meet once; what is shown of a line comes out of the row that holds both of its sides.
    shown = (
        F.when(F.col("a").isNull(), one(F.col("head"), F.to_json("b"), F.lit("已删除")))
        .when(F.col("b").isNull(), one(F.col("head"), F.lit("空"), F.to_json("a")))
        .otherwise(_changed([(F.concat("head", F.lit(label)), F.col(f"b.{c}"), F.col(f"a.{c}")) for c, label in LINE_LABELS.items()]))
    )
    return heads.unionByName(both.select(*keys, F.explode(shown).alias("d"))).select(*keys, "d.*", F.lit("user").alias("edit_source"))


# --- review ---------------------------------------------------------------------------------

def field_review(drafts: DataFrame, lines: DataFrame, limit: int = 4) -> DataFrame:
    """Up to four reasons per field why a person should look at a draft.

    ``drafts`` also has tags, warnings, ocr_status and context (the texts the draft came from).
    """
    amount = T.resolved_amount("amount_with_tax", "quantity", "unit_price")
    counts = lines.groupBy("draft_id").agg(
        F.count(F.lit(1)).alias("_lines"), F.count_if(T.is_blank("project_name")).alias("_no_name"), F.count_if(amount.isNull()).alias("_no_amount"),
        F.count_if(T.is_blank("tax_category") | T.is_blank("tax_code")).alias("_no_code"), F.count_if(is_low_confidence(markers=T.REVIEW_MARKERS)).alias("_low"),
    )
    d = drafts.join(counts, "draft_id", "left").fillna(0, ["_lines", "_no_name", "_no_amount", "_no_code", "_low"])
    tags, warnings = F.coalesce("tags", F.lit("")), F.coalesce("warnings", F.lit(""))
    image = tags.rlike("群聊截图|图片材料|车辆/现场照片")
    ocr_risk = ~F.coalesce("ocr_status", F.lit("")).isin("not_requested", "success", "") | warnings.contains("OCR")
    sample = tags.rlike("样票|发票")
    no_lines = F.col("_lines") == 0
    wants_note = F.concat_ws("\n", "context", warnings).rlike("发票对象|备注|项目名称|项目地址|样张|样票")
    many = lambda c, text: F.concat(F.col(c).cast("string"), F.lit(text))
    rules = [
        (T.is_blank("company_name"), "销售方", "销售方为空；现场提交前必须确认当前税局登录主体和材料主体一致。"),
        (warnings.contains("多个公司"), "销售方", "材料中出现多个公司名；需确认哪个是销售主体，避免把样票买方当成咱们客户。"),
        (warnings.contains("多个公司"), "购买方名称", "材料中出现多个公司名；需确认购买方没有和销售主体串位。"),
        (T.is_blank("buyer_name"), "购买方名称", "购买方名称未可靠识别；请从客户开票信息、样票或聊天截图核对。"),
        (T.is_blank("buyer_tax_id"), "购买方税号", "购买方税号缺失；上传税局前必须补全或确认客户不需要税号。"),
        (~T.is_blank("buyer_tax_id") & T.tax_id_needs_review("buyer_tax_id"), "购买方税号", "购买方税号格式可疑；请对照客户开票信息或发票样张逐位核对。"),
        (ocr_risk | image | sample, "购买方税号", "图片/OCR 容易把销售方税号、发票号码或二维码数字误当购买方税号；请对照原图逐位核对。"),
        (no_lines, "开票明细", "本地规则未形成明细；需要人工补充或等待智能识别结果。"),
        (no_lines, "金额", "未形成可用金额；请从本次文字、Excel 或聊天截图确认。"),
        (F.col("_no_name") > 0, "开票明细", many("_no_name", " 行缺项目名称；请核对客户材料中的项目/服务内容。")),
        (F.col("_no_amount") > 0, "金额", many("_no_amount", " 行缺含税金额；请核对本次开票金额，不要沿用样票旧金额。")),
        (F.col("_no_code") > 0, "税收编码", many("_no_code", " 行缺税收编码或赋码大类；建议先用一键智能赋码/人工复核。")),
        (F.col("_low") > 0, "开票明细", many("_low", " 行来自兜底、OCR、异常表或需人工复核来源；请逐行看命中来源。")),
        (wants_note & T.is_blank("note"), "备注", "客户材料提到发票对象/备注/样张要求，但草稿备注为空；请对照样张补全。"),
        (wants_note & ~T.is_blank("note"), "备注", "客户要求备注或发票对象按样张一致；请逐字核对备注内容。"),
        (tags.contains("样票 PDF") | warnings.contains("样票"), "金额", "样票里的金额可能是历史金额；以本次文字/聊天/Excel 明确金额为准。"),
        (warnings.contains("多个金额"), "金额", "材料中出现多个金额；需确认哪个是本次开票金额，哪些只是样票或历史金额。"),
        (tags.contains("财务流水/余额线索"), "开票明细", "财务流水/余额表只作线索，不应直接转成发票明细。"),
        (tags.contains("财务流水/余额线索"), "金额", "财务流水/余额表金额可能不是本次开票金额；请人工确认。"),
        (tags.contains("压缩包"), "附件", "压缩包材料可能只解析了部分文件；请确认附件内是否还有未识别材料。"),
        (image, "附件", "图片/截图已保留为附件；请对照原图核对系统识别出的字段。"),
    ]
    found = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(field).alias("field"), (F.lit(text) if isinstance(text, str) else text).alias("text"))) for when, field, text in rules]))
    fields = list(dict.fromkeys(field for _, field, _ in rules))

    def of(name: str) -> Column:
        own = F.transform(F.filter("_found", lambda x: x["field"] == name), lambda x: x["text"])
        return F.struct(F.lit(name).alias("field"), F.slice(own, 1, limit).alias("reasons"))

    per_field = F.array(*[of(f) for f in fields])
    return d.withColumn("_found", found).select("draft_id", F.explode(per_field).alias("r")).select("draft_id", "r.*").filter(F.size("reasons") > 0)


def draft_issues(drafts: DataFrame, lines: DataFrame) -> DataFrame:
    """Issue texts of each draft; line-level ones list the line numbers."""
    exempt = T.canonical_rate("tax_rate").isin(*T.EXEMPT_WORDS)
    other = F.coalesce("coding_reference", F.lit("")).contains("历史同项目还出现过")
    numbers = lambda when: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(when, F.col("line_no")))), lambda n: n.cast("string")), "、")
    found = lines.groupBy("draft_id").agg(
        F.count(F.lit(1)).alias("_n"), numbers(T.is_blank("tax_category") | T.is_blank("tax_code")).alias("_open"), numbers(exempt).alias("_exempt"), numbers(other).alias("_other")
    )
    d = drafts.join(found, "draft_id", "left")
    listed = lambda c, tail: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit("第 "), F.col(c), F.lit(tail)))
    issues = F.array_compact(
        F.array(
            F.when(T.is_blank("company_name"), "当前还没填写纳税主体名称；执行前请补充当前已登录企业。"),
            F.when(T.is_blank("buyer_name"), "当前还没自动识别出购买方名称，请在草稿页人工补充。"),
            F.when(F.coalesce("_n", F.lit(0)) == 0, "当前还没自动识别出开票明细，请在草稿页人工补充。"),
            listed("_open", " 行还没命中正式赋码库，请人工确认赋码大类 / 税率 / 税收编码。"),
            listed("_exempt", " 行命中了免税/不征税口径，请在执行前再次确认客户场景与票面口径一致。"),
            listed("_other", " 行在客户历史档案中还出现过其它品类或编码；系统已按最高频历史口径推荐，请人工复核本次项目归类。"),
            F.when(F.col("special_business") == "机动车", "系统从材料中识别出机动车线索，建议在草稿里确认 `特定业务 = 机动车` 后再执行。"),
        )
    )
    return d.select("draft_id", F.posexplode(issues).alias("pos", "issue"))


# Names of firms and sums in a text.
COMPANY = f"([{T.HAN}A-Za-z0-9（）()·\\-]{{2,40}}(?:有限公司|有限责任公司|个体工商户|中心|门诊部|医院|学校|大学|研究院|研究所|商店|饭店|物业|餐饮|传媒))"
_NUMBER, _UNIT = r"\d{1,8}+(?:\.\d{1,2}+)?+\s*+", "(?:元|块钱|块|万元)"
AMOUNT = (
    "(?s)(?<![A-Za-z0-9])(?:[¥￥]\\s*+" + _NUMBER + "|" + _NUMBER + _UNIT + "|(?<=[¥￥元块].{0,2})" + _NUMBER
    + "|(?<=(?:金额|合计|总共|共计|价税).{0,6})" + _NUMBER + "|" + _NUMBER + "(?=.{0,2}[¥￥元块]))"
)
AMOUNT_HINT = r"(?:[¥￥]\s*)?\d{1,8}(?:\.\d{1,2})?\s*(?:元|块钱|块)|金额|合计|总共|共计"


def extraction_confidence(docs: DataFrame) -> DataFrame:
    """Why an extraction needs a second look, and how far it can be trusted.

    ``docs``: text, raw_text, ocr_text, image_count, tags, buyer_name, buyer_tax_id, and line counts
    line_count, with_amount, with_name, complete, low_confidence.
    """
    text, tags = F.coalesce("text", F.lit("")), F.coalesce("tags", F.lit(""))
    companies = F.transform(F.regexp_extract_all(text, F.lit(COMPANY), F.lit(1)), lambda v: F.regexp_replace(v, "^[ ：:，,。；;（）()]+|[ ：:，,。；;（）()]+$", ""))
    reason = lambda when, message: F.when(when, F.lit(message) if isinstance(message, str) else message)
    has_lines = F.col("line_count") > 0
    reasons = F.array_compact(
        F.array(
            reason(F.col("image_count") > 0, F.concat(F.lit("包含 "), F.col("image_count").cast("string"), F.lit(" 张图片/截图：图片字段容易被 OCR 误读，建议视觉 LLM 复核。"))),
            reason(~T.is_blank("ocr_text"), "OCR 文本参与了解析：请复核图片/OCR 得到的购买方、税号、金额和备注。"),
            reason(tags.rlike("财务流水/余额线索|压缩包材料|压缩包需解压"), F.concat(F.lit("材料类型为 "), tags, F.lit("：不应仅按本地规则直接生成开票明细。"))),
            reason(tags.contains("样票 PDF") & F.col("raw_text").rlike(AMOUNT_HINT), "存在样票 PDF 和本次文字金额：需判断样票旧金额是否应被本次金额覆盖。"),
            reason(F.size(F.array_distinct(F.filter(companies, lambda c: c != ""))) >= 2, "材料中出现多个公司名称：需确认销售主体、购买方和样票主体没有串位。"),
            reason(F.regexp_count(text, F.lit(AMOUNT)) >= 2, "材料中出现多个金额：需确认哪个是本次开票金额，哪些只是样票/历史金额。"),
            reason(T.is_blank("buyer_name"), "购买方名称未可靠识别。"),
            reason(T.is_blank("buyer_tax_id"), "购买方税号未可靠识别。"),
            reason(~has_lines, "本地规则未形成开票明细。"),
            reason(has_lines & (F.col("with_amount") == 0), "本地规则未形成可靠含税金额。"),
            reason(has_lines & (F.col("with_amount") > 0) & (F.col("with_name") == 0), "本地规则未形成可靠项目名称。"),
            reason(F.col("low_confidence") > 0, "明细来源含兜底/异常/需人工复核标记，建议智能复核。"),
        )
    )
    strong = ~T.is_blank("buyer_name") & ~T.is_blank("buyer_tax_id") & has_lines & (F.col("complete") == F.col("line_count"))
    nothing = T.is_blank(text) & (F.col("image_count") == 0)
    some = F.size("reasons") > 0
    return (
        docs.withColumn("reasons", F.when(nothing, F.array().cast("array<string>")).otherwise(F.slice(F.array_distinct(reasons), 1, 10)))
        .withColumn("confidence", F.when(~some, "high").when(strong, "medium").otherwise("low"))
        .withColumn("needs_review", some & ~strong)
    )


# --- golden checks --------------------------------------------------------------------------

def golden_checks(actual: DataFrame, expected: DataFrame, key: str = "scenario_id") -> DataFrame:
    """Compares results with expectations per scenario: buyer, kind, counts, total, names, categories, rates, codes."""
    j = expected.select(key, *[F.col(c).alias(f"e_{c}") for c in expected.columns if c != key]).join(actual, key, "left")
    same = lambda c: F.coalesce(F.col(c) == F.col(f"e_{c}"), F.lit(False))
    same_set = lambda c: F.coalesce(F.array_sort(F.array_distinct(c)) == F.array_sort(F.array_distinct(f"e_{c}")), F.lit(False))
    checks = {
        "buyer_name": F.coalesce(F.col("buyer_name").contains(F.col("e_buyer_name")), F.lit(False)),
        "invoice_kind": same("invoice_kind"), "line_count": same("line_count"), "total_amount": same("total_amount"),
        "project_names": F.coalesce(F.size(F.array_except("e_project_names", "project_names")) == 0, F.lit(False)),
        "tax_categories": same_set("tax_categories"), "tax_rates": same_set("tax_rates"), "tax_codes": same_set("tax_codes"), "valid": same("valid"),
    }
    out = j.select(key, *[c.alias(f"ok_{n}") for n, c in checks.items()])
    every = reduce(lambda a, b: a & b, [F.col(f"ok_{n}") for n in checks])
    return out.withColumn("checks_passed", reduce(lambda a, b: a + b, [F.col(f"ok_{n}").cast("int") for n in checks])).withColumn("passed", every)
