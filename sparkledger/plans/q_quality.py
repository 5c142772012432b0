"""Queries over sheets, validation, rejections, repairs, differences and review."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import quality, standardize
from .q_coding import HIERARCHY_SQL, K, resolve_sql
from .q_standard import AMOUNT_SQL, RATE_SQL
from .registry import query
from .views import table, view

SHEET_RATE = "CASE WHEN tax_rate = '' THEN '' WHEN p = 0 THEN '0' WHEN p = 100 THEN '1' ELSE concat('0.', regexp_replace(lpad(cast(p AS varchar), 2, '0'), '0+$', '')) END"
PERCENT = "CASE WHEN tax_rate = '' THEN 3 WHEN tax_rate = '免税' THEN 0 WHEN tax_rate LIKE '0.%' THEN cast(cast(tax_rate AS decimal(4,2)) * 100 AS int) ELSE cast(regexp_replace(tax_rate, '[%％]', '') AS int) END"
IDS_SQL = "SELECT concat('B', cast(c_custkey AS string)) AS identifier FROM customer UNION ALL SELECT concat('D', cast(o_orderkey + 5 AS string)) FROM orders"


@query("select_exports", """WITH ids AS (SELECT DISTINCT concat('B', c_custkey) AS identifier FROM customer UNION SELECT DISTINCT concat('D', o_orderkey + 5) FROM orders)
SELECT identifier, 'draft_batch' AS source_type, d.draft_id FROM ids JOIN drafts d ON d.batch_id = identifier
UNION ALL SELECT identifier, CASE WHEN d.draft_id IS NULL THEN 'unknown' ELSE 'draft' END, d.draft_id FROM ids LEFT JOIN drafts d ON d.draft_id = identifier WHERE identifier NOT IN (SELECT batch_id FROM drafts)""")
def _(spark, sf):
    for t in ("customer", "orders"):
        table(spark, sf, t).createOrReplaceTempView(t)
    drafts = view(spark, sf, "drafts")
    return quality.select_exports(spark.sql(IDS_SQL), drafts, drafts.select("batch_id", F.col("draft_no").alias("item_pos"), "draft_id")).drop("item_pos")


@query("basic_sheet", """SELECT draft_id AS serial_no, CASE WHEN invoice_kind LIKE '%专%' THEN '增值税专用发票' ELSE '普通发票' END AS invoice_type, special_business AS special_business_type,
  '是' AS price_includes_tax, '否' AS natural_person, buyer_name, buyer_tax_id, note FROM drafts""")
def _(spark, sf):
    return quality.basic_sheet(view(spark, sf, "drafts")).select(
        "serial_no", "invoice_type", "special_business_type", "price_includes_tax", "natural_person", "buyer_name", "buyer_tax_id", "note")


@query("detail_sheet", f"""WITH l AS (SELECT *, {AMOUNT_SQL} AS amount_d, {PERCENT} AS p FROM dlines), {resolve_sql('l')}
SELECT draft_id AS serial_no, line_no, project_name, coalesce(CASE WHEN tax_code <> '' THEN coalesce(t0.leaf_code, tax_code) ELSE coalesce(t1.leaf_code, t2.leaf_code) END, '') AS tax_code,
  quantity, unit_price, coalesce(cast(amount_d AS varchar), '') AS amount, {SHEET_RATE} AS tax_rate
FROM l LEFT JOIN tree t0 ON t0.official_code = l.tax_code LEFT JOIN mc ON mc.k = {K('l.tax_category')} LEFT JOIN tree t1 ON t1.official_code = mc.official_code
LEFT JOIN mn ON mn.k = {K('l.project_name')} AND NOT (l.tax_category = '' AND l.project_name = '服务费') LEFT JOIN tree t2 ON t2.official_code = mn.official_code""")
def _(spark, sf):
    return quality.detail_sheet(view(spark, sf, "dlines"), view(spark, sf, "tax")).select(
        "serial_no", "line_no", "project_name", "tax_code", "quantity", "unit_price", "amount", "tax_rate")


@query("extra_sheet", """SELECT draft_id AS serial_no, '备注' AS name, note AS content FROM drafts WHERE note <> '' UNION ALL SELECT draft_id, '收款人', buyer_bank_name FROM drafts WHERE buyer_bank_name <> ''""")
def _(spark, sf):
    return quality.extra_sheet(view(spark, sf, "drafts").withColumn("extra_fields", F.create_map(F.lit("备注"), "note", F.lit("收款人"), "buyer_bank_name")))


@query("lines_to_text", f"""SELECT draft_id, concat('项目名称\t赋码大类\t税收编码\t零件编码\t规格型号\t单位\t数量\t单价\t含税金额\t税率/征收率\t赋码说明\n', string_agg(concat_ws('\t', project_name, tax_category, tax_code,
  source_item_code, specification, unit, quantity, unit_price, coalesce(cast({AMOUNT_SQL} AS varchar), ''), {RATE_SQL}, coding_reference), '\n' ORDER BY line_no)) AS text FROM dlines GROUP BY draft_id""")
def _(spark, sf):
    return quality.lines_to_text(view(spark, sf, "dlines"))


# Sheets with faults put in by what the line says.
BASIC_SQL = """SELECT CASE WHEN special_business = '机动车' THEN 'D1' ELSE draft_id END AS serial_no, draft_no AS row, CASE WHEN invoice_kind = '电子专票' THEN '增值税专用发票' ELSE invoice_kind END AS invoice_type,
  CASE WHEN note = '' THEN '是' ELSE 'yes' END AS price_includes_tax, CASE WHEN company_name = '' THEN repeat(buyer_name, 8) ELSE buyer_name END AS buyer_name, buyer_tax_id, buyer_address, buyer_phone, buyer_bank_name, buyer_bank_account,
  CASE WHEN buyer_bank_name = '' THEN '' ELSE '展示' END AS contact_display FROM drafts"""
DETAIL_SQL = """SELECT draft_id AS serial_no, line_no, project_name, CASE WHEN tax_category = 'PROMO' THEN '1010000000000000000' ELSE tax_code END AS tax_code, amount_with_tax AS amount, unit,
  CASE tax_rate WHEN '6' THEN '6' WHEN '1%' THEN '0.01' WHEN '3％' THEN 'abc' ELSE tax_rate END AS tax_rate FROM dlines"""
OPTIONS_SQL = "SELECT '1-发票基本信息' AS sheet, '发票类型' AS header, v AS value FROM (SELECT '普通发票' AS v UNION ALL SELECT '增值税普通发票') o UNION ALL SELECT '2-发票明细信息', '单位', '件'"


def _sheets(spark, sf):
    view(spark, sf, "drafts").createOrReplaceTempView("drafts")
    view(spark, sf, "dlines").createOrReplaceTempView("dlines")
    return spark.sql(BASIC_SQL), spark.sql(DETAIL_SQL), view(spark, sf, "tax"), spark.sql(OPTIONS_SQL)


ISSUES_SQL = f"""b AS ({BASIC_SQL}), d AS ({DETAIL_SQL}), {HIERARCHY_SQL},
coarse AS (SELECT DISTINCT tax_code FROM d WHERE tax_code <> '' AND rtrim(tax_code, '0') NOT IN ('', tax_code) AND EXISTS (SELECT 1 FROM tax WHERE official_code <> tax_code AND starts_with(official_code, rtrim(tax_code, '0')))),
f AS (SELECT serial_no, min(row) AS first_row FROM b GROUP BY serial_no),
bi AS (SELECT b.*, unnest([CASE WHEN buyer_name = '' THEN '购买方名称 为必填项' END, CASE WHEN row > first_row THEN '发票流水号重复' END, CASE WHEN invoice_type LIKE '%专用%' AND buyer_tax_id = '' THEN '专票必须填写购买方纳税人识别号' END,
  CASE WHEN length(buyer_name) > 100 THEN '购买方名称超过 100 字符' END, CASE WHEN price_includes_tax <> '是' THEN '是否含税只能填写 是 或 否' END,
  CASE WHEN concat(buyer_address, buyer_phone, buyer_bank_name, buyer_bank_account) <> '' AND contact_display = '' THEN '已填写购买方地址/电话/开户行/账号时，应选择官方展示项，不能留空或填写 是/否' END,
  CASE WHEN invoice_type = '增值税专用发票' THEN '字段值不在官方模板下拉选项内，可选值：增值税普通发票 / 普通发票' END]) AS message FROM b JOIN f ON f.serial_no = b.serial_no),
di AS (SELECT d.*, unnest([CASE WHEN project_name = '' THEN '项目名称 为必填项' END, CASE WHEN d.tax_code = '' THEN '商品和服务税收编码 为必填项' END, CASE WHEN amount = '' THEN '金额 为必填项' END, CASE WHEN tax_rate = '' THEN '税率 为必填项' END,
  CASE WHEN serial_no NOT IN (SELECT serial_no FROM b) THEN '明细中的发票流水号未在基本信息 sheet 中出现' END, CASE WHEN right(tax_rate, 1) = '%' THEN '税率在批量导入模板中应填写小数，例如 13% 应填写 0.13' END,
  CASE WHEN tax_rate IN ('abc', '免税') THEN '税率必须是小数，例如 0.13、0.03、0.01 或 0' END, CASE WHEN tax_rate = '6' THEN '税率应在 0 到 1 之间，例如 13% 应填写 0.13' END,
  CASE WHEN c.tax_code IS NOT NULL THEN '该商品编码是汇总商品编码，税局要求使用下级具体商编' END, CASE WHEN unit = '箱' THEN '字段值不在官方模板下拉选项内，可选值：件' END]) AS message FROM d LEFT JOIN coarse c ON c.tax_code = d.tax_code),
issues AS (SELECT '1-发票基本信息' AS sheet, serial_no, row, message FROM bi WHERE message IS NOT NULL UNION ALL SELECT '2-发票明细信息', serial_no, line_no, message FROM di WHERE message IS NOT NULL
  UNION ALL SELECT DISTINCT '2-发票明细信息', serial_no, 0, '基本信息存在该发票流水号，但明细信息没有对应行' FROM b WHERE serial_no NOT IN (SELECT serial_no FROM d))"""


@query("validate_sheets", f"WITH {ISSUES_SQL} SELECT sheet, serial_no, row, message FROM issues")
def _(spark, sf):
    return quality.validate_sheets(*_sheets(spark, sf)).select("sheet", "serial_no", "row", "message")


@query("validation_report", f"WITH {ISSUES_SQL} SELECT sheet AS file, count(*) AS issue_count, count(*) AS error_count, 0 AS warning_count FROM issues GROUP BY sheet")
def _(spark, sf):
    return quality.validation_report(quality.validate_sheets(*_sheets(spark, sf)).withColumnRenamed("sheet", "file"))


@query("serial_difference", "SELECT concat('D', o_orderkey) AS serial_no FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(spark, sf):
    serial = lambda t, c: table(spark, sf, t).select(F.concat(F.lit("D"), F.col(c).cast("string")).alias("serial_no"))
    return quality.serial_difference(serial("orders", "o_orderkey"), serial("lineitem", "l_orderkey"))


FAIL_SQL = """f AS (SELECT *, CASE WHEN reason LIKE '%税率不合法%' THEN '税率' WHEN reason LIKE '%商编%' OR reason LIKE '%不允许填写' THEN '商品和服务税收编码' WHEN reason LIKE '%购买方名称%' THEN '购买方名称'
    WHEN reason LIKE '单位%' THEN '单位' WHEN reason LIKE '某字段%' THEN '某字段' ELSE '' END AS field_name,
  CASE WHEN reason LIKE '%涉税%' THEN 'seller_qualification_restriction' WHEN reason LIKE '%税率不合法%' THEN 'seller_tax_rate_restriction' WHEN reason LIKE '%商编%' THEN 'taxonomy_code_level_error'
    WHEN reason LIKE '%码值不正确' THEN 'template_option_error' WHEN reason LIKE '%不能为空' THEN 'missing_required_field' ELSE 'tax_bureau_validation_error' END AS failure_type,
  CASE WHEN reason LIKE '2-%' THEN '2-发票明细信息' WHEN reason LIKE '1-%' THEN '1-发票基本信息' WHEN reason LIKE '第 %' THEN regexp_extract(reason, '^([^:：]+)[:：]', 1)
    WHEN reason LIKE '第%' OR reason LIKE '单位%' OR reason LIKE '编码%' THEN '2-发票明细信息' ELSE '' END AS source_sheet,
  CASE WHEN reason LIKE '%0.03%' THEN '3%,1%,0%' WHEN reason LIKE '%9\\%%' ESCAPE '\\' THEN '9%,6%' ELSE '' END AS allowed FROM failures),
n AS (SELECT draft_id, count(*) AS n, min(line_no) AS only_line FROM dlines GROUP BY draft_id),
t0 AS (SELECT f.*, CASE WHEN source_sheet = '2-发票明细信息' OR field_name IN ('税率', '商品和服务税收编码', '单位') THEN coalesce(CASE WHEN reason LIKE '%第%' THEN pos END, CASE WHEN n.n = 1 THEN only_line END) END AS target_line_no
  FROM f LEFT JOIN n ON n.draft_id = f.draft_id),
t AS (SELECT t0.*, project_name, tax_rate AS line_rate, CASE WHEN field_name = '税率' THEN split_part(allowed, ',', 1) ELSE '' END AS repair_value FROM t0 LEFT JOIN dlines l ON l.draft_id = t0.draft_id AND l.line_no = target_line_no),
same AS (SELECT draft_id, tax_rate, count(*) AS same FROM dlines GROUP BY ALL),
tt AS (SELECT t.*, CASE WHEN target_line_no IS NOT NULL THEN 'line' WHEN source_sheet LIKE '1-%' THEN 'draft' ELSE 'invoice' END AS target_scope,
  CASE WHEN repair_value <> '' AND target_line_no IS NOT NULL AND line_rate <> '' AND line_rate <> repair_value AND same > 1 THEN same ELSE CASE WHEN repair_value <> '' AND target_line_no IS NOT NULL THEN 1 ELSE 0 END END AS repair_target_line_count
  FROM t LEFT JOIN same ON same.draft_id = t.draft_id AND same.tax_rate = line_rate)"""


def _classified(spark, sf):
    return quality.classify_failures(view(spark, sf, "failures"))


def _targeted(spark, sf):
    return quality.target_failures(_classified(spark, sf), view(spark, sf, "dlines"))


@query("classify_failures", f"WITH {FAIL_SQL} SELECT draft_id, pos, field_name, failure_type, source_sheet, allowed AS allowed_values FROM f")
def _(spark, sf):
    return _classified(spark, sf).select("draft_id", "pos", "field_name", "failure_type", "source_sheet", F.array_join("allowed_values", ",").alias("allowed_values"))


@query("failure_summary", f"""WITH {FAIL_SQL} SELECT 'field' AS dimension, CASE WHEN field_name = '' THEN '未识别' ELSE field_name END AS value, count(*) AS n FROM f GROUP BY ALL UNION ALL SELECT 'type', failure_type, count(*) FROM f GROUP BY ALL
UNION ALL SELECT 'sheet', CASE WHEN source_sheet = '' THEN '未识别' ELSE source_sheet END, count(*) FROM f GROUP BY ALL""")
def _(spark, sf):
    return quality.failure_summary(_classified(spark, sf))


@query("target_failures", f"""WITH {FAIL_SQL} SELECT draft_id, pos, target_line_no, target_scope, repair_value, repair_target_line_count,
  CASE WHEN target_line_no IS NOT NULL THEN concat('第 ', target_line_no, ' 行', CASE WHEN project_name <> '' THEN concat('：', project_name) ELSE '' END) WHEN target_scope = 'draft' THEN '发票抬头 / 基本信息' ELSE '整张发票' END AS target_label FROM tt""")
def _(spark, sf):
    return _targeted(spark, sf).select("draft_id", "pos", "target_line_no", "target_scope", "repair_value", "repair_target_line_count", "target_label")


@query("failure_issues", f"""WITH {FAIL_SQL} SELECT draft_id, pos, concat('税局退回：', CASE WHEN target_line_no IS NOT NULL THEN concat('第 ', target_line_no, ' 行', CASE WHEN project_name <> '' THEN concat('：', project_name) ELSE '' END)
  WHEN target_scope = 'draft' THEN '发票抬头 / 基本信息' ELSE '整张发票' END, '，', CASE field_name WHEN '商品和服务税收编码' THEN '检查税收编码，必要时改成税局允许的下级具体编码' WHEN '税率' THEN '按税局允许税率调整这一行后保存修改'
  WHEN '购买方名称' THEN '核对购买方名称是否为空、过长或与税号不匹配' WHEN '单位' THEN '补齐或修正明细里的单位' ELSE CASE WHEN reason LIKE '%涉税%' THEN '这是销售方资质限制，先确认开票主体或替代税目口径' ELSE '按税局失败原因复核草稿字段' END END, '。') AS issue FROM tt""")
def _(spark, sf):
    return quality.failure_issues(_targeted(spark, sf))


# Rates move in two steps only: '13%' to '3%', and '1%' to '9%'; neither result is the start of the other.
@query("apply_repairs", f"""WITH {FAIL_SQL}, r13 AS (SELECT DISTINCT draft_id FROM tt WHERE repair_value = '3%' AND target_line_no IS NOT NULL), r1 AS (SELECT DISTINCT draft_id FROM tt WHERE repair_value = '9%' AND target_line_no IS NOT NULL)
SELECT draft_id, line_no, CASE WHEN tax_rate = '13%' AND draft_id IN (SELECT draft_id FROM r13) THEN '3%' WHEN tax_rate = '1%' AND draft_id IN (SELECT draft_id FROM r1) THEN '9%' ELSE tax_rate END AS tax_rate FROM dlines""")
def _(spark, sf):
    return quality.apply_repairs(_targeted(spark, sf), view(spark, sf, "dlines"))[0].select("draft_id", "line_no", "tax_rate")


@query("repair_log", f"""WITH {FAIL_SQL}, first_hit AS (SELECT draft_id, repair_value, min(pos) AS pos FROM tt WHERE repair_value <> '' AND target_line_no IS NOT NULL GROUP BY ALL)
SELECT l.draft_id, h.pos, line_no, tax_rate AS previous_value, repair_value AS applied_value FROM dlines l JOIN first_hit h ON h.draft_id = l.draft_id AND ((tax_rate = '13%' AND repair_value = '3%') OR (tax_rate = '1%' AND repair_value = '9%'))""")
def _(spark, sf):
    return quality.apply_repairs(_targeted(spark, sf), view(spark, sf, "dlines"))[1].drop("project_name")


DECISION_SQL = """CASE WHEN repair_value <> '' AND target_line_no IS NOT NULL THEN 'safe_auto_repair' WHEN failure_type = 'seller_qualification_restriction' OR field_name = '商品和服务税收编码' THEN 'not_auto_repairable' ELSE 'manual_review' END"""


@query("repair_report", f"""WITH {FAIL_SQL}, d AS (SELECT *, {DECISION_SQL} AS decision FROM tt) SELECT draft_id, count(*) AS failure_count, count(CASE WHEN decision = 'safe_auto_repair' THEN 1 END) AS actionable_count, 0 AS applied_count,
  count(CASE WHEN decision = 'manual_review' THEN 1 END) AS manual_review_count, count(CASE WHEN decision = 'not_auto_repairable' THEN 1 END) AS non_auto_count,
  count(CASE WHEN decision <> 'not_auto_repairable' THEN 1 END) AS human_confirmation_count, count(CASE WHEN repair_target_line_count > 1 THEN 1 END) AS global_count FROM d GROUP BY draft_id""")
def _(spark, sf):
    return quality.repair_report(quality.repair_decisions(_targeted(spark, sf)))


@query("failures_by_line", f"WITH {FAIL_SQL} SELECT draft_id, target_line_no, pos, field_name, {DECISION_SQL} AS repair_decision FROM tt WHERE target_line_no IS NOT NULL AND repair_target_line_count <= 1")
def _(spark, sf):
    return quality.failures_by_line(quality.repair_decisions(_targeted(spark, sf)))


LABELS = {**quality.LINE_LABELS}
DIFF_FIELDS = " UNION ALL ".join(
    f"SELECT a.draft_id, a.line_no, concat('第 ', a.line_no, ' 行{label}') AS field_name, b.{c} AS before, a.{c} AS after FROM lines_after a JOIN lines_before b ON a.draft_id = b.draft_id AND a.line_no = b.line_no WHERE a.{c} <> b.{c}"
    for c, label in LABELS.items())
PACK = "cast(to_json({{{}}}) AS varchar)".format(", ".join(f"'{c}': {c}" for c in ("project_name amount_with_tax tax_rate tax_category specification unit quantity unit_price tax_code source_item_code coding_reference").split()))


@query("diff_drafts", f"""{DIFF_FIELDS} UNION ALL SELECT draft_id, line_no, concat('第 ', line_no, ' 行'), {PACK}, '已删除' FROM lines_before b WHERE NOT EXISTS (SELECT 1 FROM lines_after a WHERE a.draft_id = b.draft_id AND a.line_no = b.line_no)
UNION ALL SELECT draft_id, line_no, concat('第 ', line_no, ' 行'), '空', {PACK} FROM lines_after a WHERE NOT EXISTS (SELECT 1 FROM lines_before b WHERE a.draft_id = b.draft_id AND a.line_no = b.line_no)
UNION ALL SELECT draft_id, 0, '备注', note, concat(note, '!') FROM drafts UNION ALL SELECT draft_id, 0, '购买方名称', buyer_name, 'x' FROM drafts""")
def _(spark, sf):
    drafts = view(spark, sf, "drafts")
    after = drafts.withColumn("note", F.concat("note", F.lit("!"))).withColumn("buyer_name", F.lit("x"))
    return quality.diff_drafts(drafts, after, view(spark, sf, "lines_before"), view(spark, sf, "lines_after")).drop("edit_source")


@query("field_review", f"""WITH c AS (SELECT draft_id, count(*) AS n, count(CASE WHEN project_name = '' THEN 1 END) AS no_name, count(CASE WHEN {AMOUNT_SQL} IS NULL THEN 1 END) AS no_amount,
  count(CASE WHEN tax_category = '' OR tax_code = '' THEN 1 END) AS no_code, count(CASE WHEN regexp_matches(coding_reference, '需人工复核|未命中|历史') THEN 1 END) AS low FROM dlines GROUP BY draft_id),
d AS (SELECT drafts.*, coalesce(n, 0) AS n, coalesce(no_name, 0) AS no_name, coalesce(no_amount, 0) AS no_amount, coalesce(no_code, 0) AS no_code, coalesce(low, 0) AS low, special_business <> '' AS image, buyer_address <> '' AS many
  FROM drafts LEFT JOIN c ON c.draft_id = drafts.draft_id)
SELECT * FROM (SELECT draft_id, '销售方' AS field, concat_ws('|', CASE WHEN company_name = '' THEN '销售方为空；现场提交前必须确认当前税局登录主体和材料主体一致。' END,
  CASE WHEN many THEN '材料中出现多个公司名；需确认哪个是销售主体，避免把样票买方当成咱们客户。' END) AS reasons FROM d
UNION ALL SELECT draft_id, '购买方名称', concat_ws('|', CASE WHEN many THEN '材料中出现多个公司名；需确认购买方没有和销售主体串位。' END, CASE WHEN buyer_name = '' THEN '购买方名称未可靠识别；请从客户开票信息、样票或聊天截图核对。' END) FROM d
UNION ALL SELECT draft_id, '购买方税号', concat_ws('|', CASE WHEN buyer_tax_id = '' THEN '购买方税号缺失；上传税局前必须补全或确认客户不需要税号。' WHEN buyer_tax_id LIKE '91%' THEN '购买方税号格式可疑；请对照客户开票信息或发票样张逐位核对。' END,
  CASE WHEN image THEN '图片/OCR 容易把销售方税号、发票号码或二维码数字误当购买方税号；请对照原图逐位核对。' END) FROM d
UNION ALL SELECT draft_id, '开票明细', concat_ws('|', CASE WHEN n = 0 THEN '本地规则未形成明细；需要人工补充或等待智能识别结果。' END, CASE WHEN no_name > 0 THEN concat(no_name, ' 行缺项目名称；请核对客户材料中的项目/服务内容。') END,
  CASE WHEN low > 0 THEN concat(low, ' 行来自兜底、OCR、异常表或需人工复核来源；请逐行看命中来源。') END) FROM d
UNION ALL SELECT draft_id, '金额', concat_ws('|', CASE WHEN n = 0 THEN '未形成可用金额；请从本次文字、Excel 或聊天截图确认。' END, CASE WHEN no_amount > 0 THEN concat(no_amount, ' 行缺含税金额；请核对本次开票金额，不要沿用样票旧金额。') END) FROM d
UNION ALL SELECT draft_id, '税收编码', CASE WHEN no_code > 0 THEN concat(no_code, ' 行缺税收编码或赋码大类；建议先用一键智能赋码/人工复核。') ELSE '' END FROM d
UNION ALL SELECT draft_id, '备注', CASE WHEN note <> '' THEN '客户要求备注或发票对象按样张一致；请逐字核对备注内容。' ELSE '' END FROM d
UNION ALL SELECT draft_id, '附件', CASE WHEN image THEN '图片/截图已保留为附件；请对照原图核对系统识别出的字段。' ELSE '' END FROM d) r WHERE reasons <> ''""")
def _(spark, sf):
    drafts = view(spark, sf, "drafts").withColumns({
        "tags": F.when(F.col("special_business") != "", "图片材料").otherwise(""), "warnings": F.when(F.col("buyer_address") != "", "多个公司").otherwise(""),
        "ocr_status": F.lit("not_requested"), "context": F.when(F.col("note") != "", "按样张填写").otherwise("")})
    return quality.field_review(drafts, view(spark, sf, "dlines")).select("draft_id", "field", F.array_join("reasons", "|").alias("reasons"))


@query("draft_issues", """WITH c AS (SELECT draft_id, string_agg(CASE WHEN tax_category = '' OR tax_code = '' THEN cast(line_no AS varchar) END, '、' ORDER BY line_no) AS open, string_agg(CASE WHEN tax_rate = '免税' THEN cast(line_no AS varchar) END, '、' ORDER BY line_no) AS exempt
  FROM dlines GROUP BY draft_id)
SELECT draft_id, issue FROM (SELECT d.draft_id, unnest([CASE WHEN company_name = '' THEN '当前还没填写纳税主体名称；执行前请补充当前已登录企业。' END, CASE WHEN buyer_name = '' THEN '当前还没自动识别出购买方名称，请在草稿页人工补充。' END,
  CASE WHEN c.draft_id IS NULL THEN '当前还没自动识别出开票明细，请在草稿页人工补充。' END, CASE WHEN open IS NOT NULL THEN concat('第 ', open, ' 行还没命中正式赋码库，请人工确认赋码大类 / 税率 / 税收编码。') END,
  CASE WHEN exempt IS NOT NULL THEN concat('第 ', exempt, ' 行命中了免税/不征税口径，请在执行前再次确认客户场景与票面口径一致。') END,
  CASE WHEN special_business = '机动车' THEN '系统从材料中识别出机动车线索，建议在草稿里确认 `特定业务 = 机动车` 后再执行。' END]) AS issue FROM drafts d LEFT JOIN c ON c.draft_id = d.draft_id) x WHERE issue IS NOT NULL""")
def _(spark, sf):
    return quality.draft_issues(view(spark, sf, "drafts"), view(spark, sf, "dlines")).drop("pos")


@query("extraction_confidence", """WITH d AS (SELECT *, n_chars % 7 AS k FROM documents) SELECT doc_id, concat_ws('|', CASE WHEN k = 0 THEN '包含 2 张图片/截图：图片字段容易被 OCR 误读，建议视觉 LLM 复核。' END,
  CASE WHEN lang = 'fr' THEN '材料类型为 压缩包材料：不应仅按本地规则直接生成开票明细。' END, CASE WHEN k = 1 THEN '材料中出现多个公司名称：需确认销售主体、购买方和样票主体没有串位。' END,
  CASE WHEN k IN (2, 3) THEN '材料中出现多个金额：需确认哪个是本次开票金额，哪些只是样票/历史金额。' END, CASE WHEN k = 4 THEN '购买方名称未可靠识别。' END, CASE WHEN lang = 'de' THEN '本地规则未形成开票明细。' END) AS reasons,
  CASE WHEN NOT (k IN (0, 1, 2, 3, 4) OR lang IN ('fr', 'de')) THEN 'high' WHEN k <> 4 AND lang <> 'de' THEN 'medium' ELSE 'low' END AS confidence FROM d""")
def _(spark, sf):
    k = F.col("n_chars") % 7
    extra = F.when(k == 1, "。沈阳甲有限公司，大连乙有限公司").when(k == 2, "。金额 100 合计 200").when(k == 3, "。100元，￥20.5").when(k == 5, "。金额 88").otherwise("")
    docs = table(spark, sf, "documents").select(
        "doc_id", F.concat("text", extra).alias("text"), F.lit("").alias("raw_text"), F.lit("").alias("ocr_text"), F.when(k == 0, 2).otherwise(0).alias("image_count"),
        F.when(F.col("lang") == "fr", "压缩包材料").otherwise("").alias("tags"), F.when(k == 4, "").otherwise("b").alias("buyer_name"), F.lit("t").alias("buyer_tax_id"),
        *[F.when(F.col("lang") == "de", 0).otherwise(3).alias(c) for c in ("line_count", "with_amount", "with_name", "complete")], F.lit(0).alias("low_confidence"))
    return quality.extraction_confidence(docs).select("doc_id", F.array_join("reasons", "|").alias("reasons"), "confidence")


FACTS_SQL = """SELECT draft_id, count(*) AS n, sum({amount}) AS total, list_sort(list(DISTINCT project_name)) AS names, list_sort(list(DISTINCT tax_category)) AS categories, list_sort(list(DISTINCT tax_rate)) AS rates,
  list_sort(list(DISTINCT tax_code)) AS codes FROM {lines} GROUP BY draft_id"""
GOLDEN = {"buyer_name": "a.draft_id IS NOT NULL", "invoice_kind": "a.draft_id IS NOT NULL", "line_count": "a.n = b.n", "total_amount": "a.total = b.total", "project_names": "list_has_all(a.names, b.names)",
          "tax_categories": "a.categories = b.categories", "tax_rates": "a.rates = b.rates", "tax_codes": "a.codes = b.codes", "valid": "a.draft_id IS NOT NULL"}


@query("golden_checks", f"""WITH a AS ({FACTS_SQL.format(amount=AMOUNT_SQL, lines='lines_after')}), b AS ({FACTS_SQL.format(amount=AMOUNT_SQL, lines='lines_before')}),
c AS (SELECT b.draft_id AS scenario_id, {", ".join(f"coalesce({test}, false) AS ok_{name}" for name, test in GOLDEN.items())} FROM b LEFT JOIN a ON a.draft_id = b.draft_id)
SELECT *, {" + ".join(f"ok_{name}::int" for name in GOLDEN)} AS checks_passed, {" AND ".join(f"ok_{name}" for name in GOLDEN)} AS passed FROM c""")
def _(spark, sf):
    def facts(name):
        lines = standardize.standardize_lines(view(spark, sf, name))
        return lines.groupBy(F.col("draft_id").alias("scenario_id")).agg(
            F.lit("b").alias("buyer_name"), F.lit("k").alias("invoice_kind"), F.count(F.lit(1)).alias("line_count"), F.sum("amount").alias("total_amount"),
            *[F.collect_set(c).alias(n) for c, n in (("project_name", "project_names"), ("tax_category", "tax_categories"), ("tax_rate", "tax_rates"), ("tax_code", "tax_codes"))], F.lit(True).alias("valid"))
    return quality.golden_checks(facts("lines_after"), facts("lines_before"))


@query("merge_name_lists", """SELECT c_custkey, CASE WHEN c_mktsegment = c2 THEN c2 ELSE concat(c_mktsegment, '、', c2) END AS names FROM (SELECT c_custkey, c_mktsegment, CASE WHEN c_nationkey > 12 THEN 'BUILDING' ELSE 'MACHINERY' END AS c2 FROM customer) c""")
def _(spark, sf):
    c = table(spark, sf, "customer").withColumn("c2", F.when(F.col("c_nationkey") > 12, "BUILDING").otherwise("MACHINERY"))
    return c.select("c_custkey", T.merge_name_list("c_mktsegment", "c2").alias("names"))
