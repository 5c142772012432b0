"""Queries over the standardisation and filter jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, standardize
from .registry import query
from .views import table, view

RATE_SQL = """CASE WHEN replace(trim(tax_rate), '％', '%') = '' THEN '3%'
  WHEN tax_rate IN ('免税', '不征税', '免征增值税') THEN tax_rate
  WHEN replace(tax_rate, '％', '%') LIKE '%\\%' ESCAPE '\\' THEN replace(tax_rate, '％', '%')
  ELSE concat(regexp_replace(cast(cast(CASE WHEN cast(tax_rate AS decimal(18,4)) <= 1 THEN cast(tax_rate AS decimal(18,4)) * 100
    ELSE cast(tax_rate AS decimal(18,4)) END AS decimal(18,2)) AS varchar), '\\.?0+$', ''), '%') END"""
AMOUNT_SQL = """cast(coalesce(try_cast(replace(amount_with_tax, '￥', '') AS decimal(18,2)),
  try_cast(quantity AS decimal(18,2)) * try_cast(unit_price AS decimal(18,2))) AS decimal(18,2))"""
# Rate in percent as a whole number; the rates of the draft lines are whole percents.
PERCENT_SQL = """CASE WHEN tax_rate = '' THEN 3 WHEN tax_rate = '免税' THEN 0
  WHEN tax_rate LIKE '0.%' THEN cast(cast(tax_rate AS decimal(4,2)) * 100 AS int)
  ELSE cast(regexp_replace(tax_rate, '[%％]', '') AS int) END"""


@query("standardize_lines", f"SELECT draft_id, line_no, {AMOUNT_SQL} AS amount FROM dlines")
def _(spark, sf):
    return standardize.standardize_lines(view(spark, sf, "dlines")).select("draft_id", "line_no", "amount")


@query("canonical_rates", f"SELECT draft_id, line_no, {RATE_SQL} AS rate FROM dlines")
def _(spark, sf):
    return standardize.canonical_rates(view(spark, sf, "dlines")).select("draft_id", "line_no", "rate")


@query("sheet_rates", f"""SELECT draft_id, line_no, CASE WHEN tax_rate = '' THEN '' WHEN p = 0 THEN '0' ELSE
  CASE WHEN p = 100 THEN '1' ELSE concat('0.', regexp_replace(lpad(cast(p AS varchar), 2, '0'), '0+$', '')) END END AS sheet_rate
FROM (SELECT *, {PERCENT_SQL} AS p FROM dlines) q""")
def _(spark, sf):
    return standardize.sheet_rates(view(spark, sf, "dlines")).select("draft_id", "line_no", "sheet_rate")


TAX_SQL = f"""SELECT draft_id, line_no, amount, CASE WHEN amount IS NOT NULL THEN
  cast((2 * cents * p + 100 + p) // (2 * (100 + p)) AS decimal(18,2)) / 1 ELSE NULL END AS tax_cents
FROM (SELECT draft_id, line_no, {AMOUNT_SQL} AS amount, cast({AMOUNT_SQL} * 100 AS bigint) AS cents, {PERCENT_SQL} AS p FROM dlines) q"""


@query("tax_preview", f"SELECT draft_id, line_no, amount, cast(tax_cents * 0.01 AS decimal(18,2)) AS tax_amount FROM ({TAX_SQL}) t")
def _(spark, sf):
    return standardize.tax_preview(view(spark, sf, "dlines")).select("draft_id", "line_no", "amount", "tax_amount")


@query("tax_totals", f"""SELECT draft_id, coalesce(sum(amount), 0) AS amount_total,
  coalesce(sum(cast(tax_cents * 0.01 AS decimal(18,2))), 0) AS tax_total FROM ({TAX_SQL}) t GROUP BY draft_id""")
def _(spark, sf):
    return standardize.tax_totals(view(spark, sf, "dlines"))


KEY_SQL = "upper(regexp_replace({0}, '[^0-9A-Za-z一-鿿]+', '', 'g'))"


@query("key_columns", f"""SELECT draft_id, line_no, {KEY_SQL.format('text')} AS alias_key, lower(replace(trim(text), ' ', '')) AS search_key,
  upper(replace(regexp_replace(text, '\\s+', '', 'g'), '，', ',')) AS compact_key,
  regexp_replace(upper(text), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS candidate_key
FROM (SELECT draft_id, line_no, concat(project_name, ' ，(', specification, ')') AS text FROM dlines) q""")
def _(spark, sf):
    lines = view(spark, sf, "dlines").select("draft_id", "line_no", F.concat("project_name", F.lit(" ，("), "specification", F.lit(")")).alias("text"))
    return standardize.key_columns(lines, "text").drop("text")


@query("split_item_names", """SELECT draft_id, line_no, project_name,
  CASE WHEN starred THEN split_part(project_name, '*', 2) ELSE '' END AS category,
  CASE WHEN starred THEN split_part(project_name, '*', 3) ELSE project_name END AS name,
  CASE WHEN starred THEN split_part(project_name, '*', 2) WHEN bare THEN split_part(project_name, '*', 1) ELSE '' END AS first_part,
  CASE WHEN starred THEN split_part(project_name, '*', 3) WHEN bare THEN split_part(project_name, '*', 2) ELSE project_name END AS last_part,
  CASE WHEN starred THEN split_part(project_name, '*', 2) WHEN bare THEN split_part(project_name, '*', 1) ELSE '' END AS inline_category,
  CASE WHEN starred THEN split_part(project_name, '*', 3) WHEN bare THEN split_part(project_name, '*', 2) ELSE project_name END AS inline_name
FROM (SELECT *, project_name LIKE '*%*%' AS starred, project_name LIKE '%*%' AND project_name NOT LIKE '*%' AS bare FROM dlines) q""")
def _(spark, sf):
    return standardize.split_item_names(view(spark, sf, "dlines").select("draft_id", "line_no", "project_name"), "project_name")


@query("invoice_kinds", """SELECT draft_id, CASE WHEN invoice_kind LIKE '%专%' THEN '增值税专用发票' ELSE '普通发票' END AS sheet_kind,
  CASE WHEN (buyer_address || buyer_phone) <> '' AND (buyer_bank_name || buyer_bank_account) <> '' THEN '展示地址、电话、开户银行及银行账号'
    WHEN (buyer_address || buyer_phone) <> '' THEN '展示地址、电话' WHEN (buyer_bank_name || buyer_bank_account) <> '' THEN '展示开户银行、银行账号'
    ELSE '' END AS contact_display FROM drafts""")
def _(spark, sf):
    return standardize.invoice_kinds(view(spark, sf, "drafts")).select("draft_id", "sheet_kind", "contact_display")


@query("tax_id_quality", """SELECT draft_id, buyer_tax_id,
  length(buyer_tax_id) NOT IN (15, 18, 20) OR (length(buyer_tax_id) = 18 AND regexp_matches(buyer_tax_id, '[IOSVZ]')) AS needs_review,
  length(buyer_tax_id) <> 18 OR len(list_distinct(string_split(buyer_tax_id, ''))) <= 4
    OR regexp_matches(buyer_tax_id, '^(0{6}|1{6}|2{6}|3{6}|4{6}|5{6}|9{6})') AS unreliable FROM drafts""")
def _(spark, sf):
    return standardize.tax_id_quality(view(spark, sf, "drafts").select("draft_id", "buyer_tax_id"), "buyer_tax_id")


@query("expand_rule_aliases", "SELECT entry_id, alias_pos, alias FROM rule_aliases")
def _(spark, sf):
    return standardize.expand_aliases(view(spark, sf, "rules"), "raw_alias").select("entry_id", "alias_pos", "alias")


@query("expand_buyer_aliases", """SELECT DISTINCT c_name, alias FROM (
  SELECT c_name, unnest([name, core, substr(core, 1, 4), right(core, 4), right(core, 3), right(core, 2)]) AS alias
  FROM (SELECT c_name, concat(c_name, '有限公司') AS name, c_name AS core FROM customer) q) a""")
def _(spark, sf):
    buyers = table(spark, sf, "customer").select("c_name", F.concat("c_name", F.lit("有限公司")).alias("name"))
    return standardize.expand_aliases(buyers, "name", "buyer").select("c_name", "alias")


@query("rule_ids", f"""SELECT entry_id, concat('learned-', substr(sha1(concat_ws('|', {KEY_SQL.format('raw_alias')}, {KEY_SQL.format('tax_category')},
  tax_code, replace(tax_treatment_or_rate, '%', ''))), 1, 12)) AS rule_id FROM rules""")
def _(spark, sf):
    return standardize.rule_ids(view(spark, sf, "rules")).select("entry_id", "rule_id")


# Amounts in words, built from the quantities of the whole line table.
WORDS = "translate(cast(cast(l_quantity AS int) AS string), '0123456789', '零一二三四五六七八九')"


@query("chinese_amounts", f"""SELECT words, n, CASE WHEN q < 10 THEN cast(q AS varchar) ELSE cast(q * 100 + 1000 AS varchar) END AS amount_text FROM (
  SELECT q, count(*) AS n, CASE WHEN q < 10 THEN {WORDS.replace('cast(cast(l_quantity AS int) AS string)', 'cast(q AS string)')}
   ELSE concat(CASE WHEN (q + 10) // 10 % 10 = 0 THEN '' ELSE concat(translate(cast((q + 10) // 10 AS string), '123456789', '一二三四五六七八九'), '仟') END,
     CASE WHEN q % 10 = 0 THEN '' ELSE translate(cast(q % 10 AS string), '123456789', '一二三四五六七八九') END) END AS words
  FROM (SELECT cast(l_quantity AS int) AS q FROM lineitem) l GROUP BY q) w""")
def _(spark, sf):
    q = F.col("q")
    digits = "一二三四五六七八九"
    word = lambda c: F.translate(c.cast("string"), "123456789", digits)
    words = F.when(q < 10, F.translate(q.cast("string"), "0123456789", "零" + digits)).otherwise(
        F.concat(word(F.floor((q + 10) / 10)), F.lit("仟"), F.when(q % 10 == 0, "").otherwise(word(q % 10)))
    )
    counted = table(spark, sf, "lineitem").select(F.col("l_quantity").cast("int").alias("q")).groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    return standardize.chinese_amounts(counted.withColumn("words", words), "words").select("words", "n", "amount_text")


@query("token_columns", """SELECT p_name, n, array_to_string(list_transform(range(1, length(k)), lambda i: substr(k, i, 2)), ' ') AS bigrams,
  array_to_string(list_distinct_sorted, ' ') AS tokens
FROM (SELECT p_name, count(*) AS n, upper(replace(p_name, ' ', '')) AS k, [upper(replace(p_name, ' ', '')), '服务'] AS list_distinct_sorted FROM part GROUP BY p_name) q""")
def _(spark, sf):
    names = table(spark, sf, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n"))
    keyed = standardize.token_columns(names.withColumn("text", F.concat("p_name", F.lit("服务"))), "text")
    plain = standardize.token_columns(names, "p_name").select("p_name", "bigrams")
    return keyed.drop("bigrams").join(plain, "p_name").select(
        "p_name", "n", F.array_join("bigrams", " ").alias("bigrams"), F.array_join("tokens", " ").alias("tokens")
    )


DOC_SQL = """SELECT doc_id, concat(source, CASE lang WHEN 'en' THEN '.pdf' WHEN 'fr' THEN '.xlsx' WHEN 'de' THEN '.docx' ELSE '.txt' END) AS file_name,
  concat(text, CASE WHEN n_chars < 200 THEN '' WHEN n_chars < 600 THEN ' 发票号码 价税合计 购买方 开票日期' WHEN n_chars < 1200 THEN ' 开票信息'
    WHEN n_chars < 2400 THEN ' 合同' ELSE ' 车架号' END) AS text FROM documents"""


@query("classify_documents", f"""SELECT doc_id, CASE
  WHEN file_name LIKE '%.xlsx' THEN CASE WHEN regexp_matches(lower(concat(file_name, regexp_replace(text, '\\s+', '', 'g'))), 'his|收入|流水') THEN '财务流水/余额线索'
    WHEN regexp_matches(lower(text), '车架号|vin') THEN '机动车异常表' WHEN text LIKE '%合同' THEN '合同/清单 Excel'
    WHEN text LIKE '%开票日期' THEN '税局历史 Excel' ELSE '本次开票样单 Excel' END
  WHEN file_name LIKE '%.pdf' THEN CASE WHEN text LIKE '%开票日期' THEN '样票 PDF' WHEN text LIKE '%合同' THEN '合同 PDF' ELSE 'PDF 材料' END
  WHEN file_name LIKE '%.docx' THEN CASE WHEN text LIKE '%开票信息' THEN '客户开票信息 Word' ELSE 'Word 材料' END
  ELSE CASE WHEN regexp_matches(text, '开票|发票') THEN '群文本/整理文本' ELSE '文本材料' END END AS material_type FROM ({DOC_SQL}) d""")
def _(spark, sf):
    table(spark, sf, "documents").createOrReplaceTempView("documents")
    return standardize.classify_documents(spark.sql(DOC_SQL)).select("doc_id", "material_type")


@query("material_tags", """SELECT draft_id, string_agg(tag, ' / ' ORDER BY pos, tag) AS tags FROM (
  SELECT draft_id, tag, pos, row_number() OVER (PARTITION BY draft_id ORDER BY pos, tag) AS rn FROM (
    SELECT concat('S', cast(l_suppkey AS varchar)) AS draft_id, concat(p_type, ' ', p_brand) AS tag, min(l_orderkey) AS pos
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) t) r WHERE rn <= 8 GROUP BY draft_id""")
def _(spark, sf):
    tagged = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("draft_id"), F.col("l_orderkey").alias("pos"),
        F.concat_ws(" ", "p_type", "p_brand").alias("tag"),
    )
    return standardize.material_tags(tagged)


CHAT_SQL = """SELECT conv_id, turn, concat(text, CASE WHEN turn = 0 THEN ' 开专票' WHEN turn = 1 THEN ' 票种：普通发票' WHEN turn = 2 THEN ' 增值税专用发票'
  WHEN turn = 3 THEN ' 税号 开户行 账号 电话 纸票' WHEN turn = 4 THEN ' 车架号 普票' ELSE ' 开票类型:增票' END) AS text FROM conversations"""


@query("invoice_profile", f"""SELECT conv_id, turn, CASE WHEN turn = 1 THEN '普通发票' WHEN turn = 4 THEN '普通发票' ELSE '增值税专用发票' END AS invoice_kind,
  CASE WHEN turn = 3 THEN '纸质发票' ELSE '电子发票' END AS invoice_medium,
  CASE WHEN turn = 4 OR regexp_matches(lower(replace(text, ' ', '')), 'vin') THEN '机动车' ELSE '' END AS special_business FROM ({CHAT_SQL}) c""")
def _(spark, sf):
    table(spark, sf, "conversations").createOrReplaceTempView("conversations")
    return standardize.invoice_profile(spark.sql(CHAT_SQL)).drop("text")


@query("trusted_history", "SELECT line_key, seller_name, amount_with_tax FROM trusted")
def _(spark, sf):
    return filters.trusted_history(view(spark, sf, "hist")).select("line_key", "seller_name", "amount_with_tax")


@query("review_filter", f"""SELECT * FROM (SELECT draft_id, line_no,
  concat_ws(',', CASE WHEN project_name = '' THEN 'project_name' END, CASE WHEN {AMOUNT_SQL} IS NULL THEN 'amount_with_tax' END,
    CASE WHEN tax_rate = '' THEN 'tax_rate' END, CASE WHEN tax_code = '' THEN 'tax_code' END) AS missing,
  regexp_matches(coding_reference, '兜底|异常|需人工复核|未命中|OCR|视觉|样票|历史') AS low_confidence,
  tax_rate = '免税' AS exempt FROM dlines) q WHERE missing <> '' OR low_confidence OR exempt""")
def _(spark, sf):
    return filters.review_filter(view(spark, sf, "dlines")).select("draft_id", "line_no", "missing", "low_confidence", "exempt")


@query("name_classes", """SELECT draft_id, line_no, project_name = '服务费' AS generic, project_name = '服务费' AS weak,
  project_name = '' OR (NOT regexp_matches(project_name, '[一-鿿]') AND length(regexp_replace(project_name, '[^A-Za-z0-9]+', '', 'g')) <= 6) AS low_confidence,
  project_name = '服务费' AS uncoded FROM dlines""")
def _(spark, sf):
    return filters.name_classes(view(spark, sf, "dlines")).select("draft_id", "line_no", "generic", "weak", "low_confidence", "uncoded")


LOOSE_SQL = """SELECT draft_id, line_no, amount_with_tax, tax_code, source_item_code, quantity, unit_price, specification,
  CASE WHEN project_name = '服务费' THEN '合计' WHEN tax_rate = '3％' AND unit = '箱' THEN '1,234.5' WHEN tax_rate = '6' AND unit = '箱' THEN '壹佰元整'
    WHEN tax_rate = '1%' AND unit = '箱' THEN '开户行：x' ELSE project_name END AS project_name,
  CASE WHEN tax_rate = '免税' AND unit = '箱' THEN '大写' ELSE tax_category END AS tax_category FROM dlines"""


@query("drop_summary_rows", """SELECT draft_id, line_no, project_name FROM dlines
WHERE project_name NOT IN ('', '服务费') AND NOT (unit = '箱' AND tax_rate IN ('3％', '6', '1%', '免税'))
  AND (amount_with_tax <> '' OR tax_code <> '' OR source_item_code <> '' OR (quantity <> '' AND unit_price <> ''))""")
def _(spark, sf):
    loose = view(spark, sf, "dlines")
    loose.createOrReplaceTempView("dlines")
    return filters.drop_summary_rows(spark.sql(LOOSE_SQL)).select("draft_id", "line_no", "project_name")


CANDIDATES_SQL = """SELECT concat('cand-', cast(p_partkey AS string)) AS candidate_id, CASE WHEN p_size = 7 THEN '' ELSE p_name END AS raw_alias, p_type AS tax_category,
  '' AS normalized_invoice_name, '' AS tax_code, '6%' AS tax_treatment_or_rate, '' AS decision_basis, '' AS case_ids, p_brand AS company_names,
  CASE p_type WHEN 'PROMO' THEN 'approved' WHEN 'SMALL' THEN '通过' WHEN 'LARGE' THEN 'pending_review' WHEN 'MEDIUM' THEN 'published' ELSE '' END AS status FROM part"""


@query("publishable_rules", f"""SELECT candidate_id AS rule_id, raw_alias, raw_alias AS normalized_invoice_name, tax_category, company_names AS company_name,
  'tenant_reviewed' AS confidence, '中心端候选审核通过' AS decision_basis FROM ({CANDIDATES_SQL}) c
WHERE raw_alias <> '' AND status IN ('approved', '通过', 'published')""")
def _(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("part")
    return filters.publishable_rules(spark.sql(CANDIDATES_SQL)).select(
        "rule_id", "raw_alias", "normalized_invoice_name", "tax_category", "company_name", "confidence", "decision_basis"
    )


EVENT_BATCH_SQL = """SELECT case_id AS batch_id, seq AS pos, event_id, CASE WHEN batch_id <> '' AND event_type = 'draft_created' THEN ' ' ELSE case_id END AS case_id,
  CASE WHEN draft_id LIKE '%-6' AND event_type = 'draft_updated' THEN '' ELSE event_type END AS event_type, created_at FROM cev"""


@query("valid_records", f"""SELECT batch_id, count(*) AS records, min(CASE WHEN bad THEN pos END) AS first_bad_pos,
  arg_min(CASE WHEN trim(case_id) = '' THEN 'case_id' ELSE 'event_type' END, CASE WHEN bad THEN pos END) AS missing_field,
  count(CASE WHEN bad THEN 1 END) = 0 AS valid
FROM (SELECT *, trim(case_id) = '' OR event_type = '' AS bad FROM ({EVENT_BATCH_SQL}) e) q GROUP BY batch_id""")
def _(spark, sf):
    view(spark, sf, "cev").createOrReplaceTempView("cev")
    return filters.valid_records(spark.sql(EVENT_BATCH_SQL), "event")
