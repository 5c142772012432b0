"""How the given tables stand in for invoice data.

Each view is one portable SQL text, so Spark and a checking engine see the same input. All views
run over the whole tables; a CASE on a column only varies the values, it drops no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

CODE = "concat('1', lpad(cast(p_size AS string), 2, '0'), lpad(replace(p_brand, 'Brand#', ''), 2, '0'), '00000000000000')"
LINE_NO = "(cast(l_linenumber AS bigint) * 1000000000000000 + cast(l_partkey AS bigint) * 1000000 + cast(l_suppkey AS bigint))"
MONEY = "cast(l_extendedprice AS decimal(18,2))"

VIEWS: dict[str, str] = {}

# One row per history line: line item with its order, buyer, seller and item.
VIEWS["hist"] = f"""
SELECT 'export_1.csv' AS source_file,
  concat(lpad(cast(l_orderkey AS string), 12, '0'), '-', lpad(cast({LINE_NO} AS string), 19, '0')) AS line_key,
  cast(l_orderkey AS string) AS serial,
  {LINE_NO} AS line_no,
  s_name AS seller_name,
  concat('91', lpad(cast(s_suppkey AS string), 16, '0')) AS seller_tax_id,
  c_name AS buyer_name,
  concat('92', lpad(cast(c_custkey AS string), 16, '0')) AS buyer_tax_id,
  substr(cast(l_shipdate AS string), 1, 19) AS invoice_date,
  {CODE} AS tax_code,
  concat('*', p_type, '*', p_name) AS full_item_name,
  p_type AS tax_category,
  p_name AS project_name,
  p_brand AS specification,
  CASE WHEN p_size > 25 THEN '箱' ELSE '' END AS unit,
  cast(l_quantity AS decimal(18,2)) AS quantity,
  cast(p_retailprice AS decimal(18,2)) AS unit_price,
  cast({MONEY} * (1 - cast(l_discount AS decimal(4,2))) AS decimal(18,2)) AS amount,
  concat(cast(cast(round(l_tax * 100) AS int) AS string), '%') AS tax_rate,
  cast({MONEY} * cast(l_discount AS decimal(4,2)) AS decimal(18,2)) AS tax_amount,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN -{MONEY} ELSE {MONEY} END AS amount_with_tax,
  CASE o_orderstatus WHEN 'F' THEN '正常' WHEN 'O' THEN '' ELSE '作废' END AS invoice_status,
  CASE l_returnflag WHEN 'R' THEN '否' WHEN 'A' THEN '' ELSE '是' END AS is_positive,
  CASE WHEN l_linestatus = 'F' AND l_linenumber = 7 THEN '红冲' ELSE '' END AS risk_level
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey
JOIN part ON l_partkey = p_partkey
"""

# The same history exported twice: the second export repeats the normal invoices.
_HIST_COLUMNS = re.findall(r" AS (\w+)(?:,|\nFROM)", VIEWS["hist"])
_HIST_COLUMNS = [c for c in _HIST_COLUMNS if c not in ("string", "bigint", "source_file", "int")]
_COLS = ", ".join(_HIST_COLUMNS)
VIEWS["hist_exports"] = f"""
SELECT source_file, {_COLS} FROM hist
UNION ALL
SELECT 'export_2.csv' AS source_file, {_COLS} FROM hist WHERE invoice_status = '正常'
"""

# Trusted history as plain SQL, for the queries that start behind the trust filter.
VIEWS["trusted"] = """
SELECT * FROM hist
WHERE invoice_status IN ('', '正常') AND is_positive IN ('', '是') AND amount_with_tax >= 0 AND amount >= 0 AND risk_level = ''
"""

# One draft per order.
VIEWS["drafts"] = """
SELECT concat('D', cast(o_orderkey AS string)) AS draft_id,
  concat('C', cast(o_custkey AS string)) AS case_id,
  concat('B', cast(o_custkey AS string)) AS batch_id,
  o_orderkey AS draft_no,
  CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN '' ELSE concat('沈阳第', cast(c_nationkey AS string), '贸易有限公司') END AS company_name,
  CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'P' THEN '' ELSE c_name END AS buyer_name,
  CASE o_orderstatus WHEN 'F' THEN concat('92', lpad(cast(c_custkey AS string), 16, '0'))
    WHEN 'O' THEN concat('91210102MAO', lpad(cast(c_custkey AS string), 7, '0')) ELSE '' END AS buyer_tax_id,
  CASE c_mktsegment WHEN 'BUILDING' THEN concat('沈阳市', cast(c_nationkey AS string), '号') ELSE '' END AS buyer_address,
  CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN concat('024-', lpad(cast(c_custkey AS string), 8, '0')) ELSE '' END AS buyer_phone,
  CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'BUILDING') THEN '工商银行' ELSE '' END AS buyer_bank_name,
  CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN concat('6222', lpad(cast(c_custkey AS string), 12, '0')) ELSE '' END AS buyer_bank_account,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '增值税专用发票' WHEN '2' THEN '电子专票' ELSE '普通发票' END AS invoice_kind,
  CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'O' THEN '机动车' ELSE '' END AS special_business,
  CASE o_orderstatus WHEN 'O' THEN concat('合同号 ', cast(o_orderkey AS string)) ELSE '' END AS note,
  substr(cast(o_orderdate AS string), 1, 19) AS created_at
FROM orders JOIN customer ON o_custkey = c_custkey
"""

# One draft line per line item, with the spelling variants operators really type.
VIEWS["dlines"] = f"""
SELECT concat('D', cast(l_orderkey AS string)) AS draft_id,
  {LINE_NO} AS line_no,
  CASE WHEN l_linenumber = 1 AND l_returnflag = 'R' THEN '服务费' WHEN l_linenumber = 2 AND l_returnflag = 'R' THEN ''
    WHEN l_linenumber = 3 AND l_returnflag = 'R' THEN concat('*', p_type, '*', p_name)
    WHEN l_linenumber = 4 AND l_returnflag = 'R' THEN concat(p_type, '*', p_name) ELSE p_name END AS project_name,
  CASE WHEN l_linenumber = 7 THEN '' WHEN l_returnflag = 'A' THEN concat('￥', cast({MONEY} AS string)) ELSE cast({MONEY} AS string) END AS amount_with_tax,
  CASE l_linenumber WHEN 1 THEN '13%' WHEN 2 THEN '' WHEN 3 THEN '免税' WHEN 4 THEN cast(cast(l_tax AS decimal(4,2)) AS string)
    WHEN 5 THEN '3％' WHEN 6 THEN '6' ELSE '1%' END AS tax_rate,
  CASE WHEN l_returnflag = 'N' THEN p_type ELSE '' END AS tax_category,
  p_brand AS specification,
  CASE WHEN p_size > 25 THEN '箱' ELSE '' END AS unit,
  CASE WHEN l_linenumber = 7 AND l_returnflag = 'N' THEN '' ELSE cast(cast(l_quantity AS decimal(18,2)) AS string) END AS quantity,
  cast(cast(p_retailprice AS decimal(18,2)) AS string) AS unit_price,
  CASE WHEN l_returnflag = 'A' THEN {CODE} ELSE '' END AS tax_code,
  CASE WHEN l_linenumber = 5 THEN p_brand ELSE '' END AS source_item_code,
  CASE WHEN l_returnflag <> 'A' THEN '' WHEN l_linenumber = 1 THEN '人工修正赋码: 税率' WHEN l_linenumber = 2 THEN '命中 内置基础规则: a -> b'
    WHEN l_linenumber = 3 THEN '官方分类候选 a / b' WHEN l_linenumber = 4 THEN '智能推荐，需人工复核: 大类'
    WHEN l_linenumber = 5 THEN '历史开票档案推荐' WHEN l_linenumber = 6 THEN '未命中规则，可点击智能赋码' ELSE '命中 客户规则: a -> b' END AS coding_reference
FROM lineitem JOIN part ON l_partkey = p_partkey
"""

_DL = ("project_name amount_with_tax tax_rate tax_category specification unit quantity unit_price tax_code source_item_code "
       "coding_reference").split()
_KEEP = ", ".join(c for c in _DL if c not in ("tax_category", "tax_code", "tax_rate", "coding_reference"))

# The draft lines before an edit and after it: categories, codes and rates change, lines come and go.
VIEWS["lines_before"] = "SELECT * FROM dlines WHERE NOT (tax_category = 'PROMO' AND unit = '箱')"
VIEWS["lines_after"] = f"""
SELECT draft_id, line_no, {_KEEP},
  CASE WHEN tax_rate = '6' THEN '0.06' WHEN tax_rate = '13%' AND unit = '箱' THEN '9%' ELSE tax_rate END AS tax_rate,
  CASE WHEN tax_category = '' THEN concat('类', specification) ELSE tax_category END AS tax_category,
  CASE WHEN tax_category = 'SMALL' THEN '1010101000000000000' ELSE tax_code END AS tax_code,
  CASE WHEN tax_category = 'SMALL' THEN '智能推荐，需人工复核: 大类' WHEN tax_category = 'LARGE' THEN '智能赋码调用失败，需人工确认: x'
    WHEN tax_category = 'MEDIUM' THEN '工程材料规则，需人工复核: 钢板' ELSE coding_reference END AS coding_reference
FROM dlines WHERE NOT (tax_rate = '' AND unit = '箱')
"""

# Coding rules of three tiers from the words of the item names.
VIEWS["rules"] = """
SELECT 2 AS tier, concat('F-', noun) AS entry_id, noun AS raw_alias, concat(noun, ' goods') AS normalized_invoice_name,
  category AS tax_category, '' AS tax_code, '13%' AS tax_treatment_or_rate, '内置基础规则' AS source_label
FROM (SELECT split_part(p_name, ' ', 2) AS noun, min(p_type) AS category FROM part GROUP BY split_part(p_name, ' ', 2)) f
UNION ALL
SELECT 1, concat('L-', adjective), concat(adjective, '、', adjective, ' ', noun, ' set'), concat(adjective, ' ', noun), category,
  '1020300000000000000', '6%', '本地即时规则'
FROM (SELECT split_part(p_name, ' ', 1) AS adjective, min(split_part(p_name, ' ', 2)) AS noun, max(p_type) AS category
  FROM part GROUP BY split_part(p_name, ' ', 1)) l
UNION ALL
SELECT 0, concat('T-', p_name), p_name, concat(p_name, ' (reviewed)'), category, '', '1%', '客户规则'
FROM (SELECT p_name, min(p_type) AS category FROM part GROUP BY p_name) t WHERE p_name LIKE 'red %'
"""
VIEWS["rule_aliases"] = """
SELECT tier, entry_id, normalized_invoice_name, tax_category, tax_code, tax_treatment_or_rate, source_label, 1 AS alias_pos,
  split_part(raw_alias, '、', 1) AS alias FROM rules
UNION ALL
SELECT tier, entry_id, normalized_invoice_name, tax_category, tax_code, tax_treatment_or_rate, source_label, 2,
  split_part(raw_alias, '、', 2) FROM rules WHERE split_part(raw_alias, '、', 2) <> ''
"""

# A category tree: regions over nations over item names, codes cut by trailing zeros.
VIEWS["tax"] = """
SELECT concat('1', lpad(cast(r_regionkey + 1 AS string), 2, '0'), '0000000000000000') AS official_code, r_name AS official_name,
  concat('区', r_name) AS category_short_name, concat('all goods of ', r_name) AS description FROM region
UNION ALL
SELECT concat('1', lpad(cast(n_regionkey + 1 AS string), 2, '0'), lpad(cast(n_nationkey + 1 AS string), 2, '0'), '00000000000000'),
  n_name, concat('类', n_name), concat('goods of ', n_name) FROM nation
UNION ALL
SELECT concat('1', lpad(cast(n_regionkey + 1 AS string), 2, '0'), lpad(cast(n_nationkey + 1 AS string), 2, '0'), '99000000000000'),
  concat('其他', n_name), concat('类', n_name), '' FROM nation WHERE n_regionkey IN (0, 2, 4)
UNION ALL
SELECT concat('1', lpad(cast(n_regionkey + 1 AS string), 2, '0'), lpad(cast(n_nationkey + 1 AS string), 2, '0'), lpad(cast(first_part + 1 AS string), 10, '0'), '0000'),
  p_name, category, concat('made by ', n_name, ': ', p_name)
FROM (SELECT p_name, min(p_partkey) AS first_part, min(p_type) AS category FROM part GROUP BY p_name) names
JOIN nation ON n_nationkey = first_part % 25
"""

# Case events: type and payload vary with the counter in props.
VIEWS["cev"] = """
SELECT concat('E', cast(event_id AS string)) AS event_id, event_id AS seq, concat('T', cast(user_id % 3 AS string)) AS tenant,
  concat('C', cast(user_id AS string)) AS case_id,
  CASE WHEN k % 2 = 0 THEN concat('D', cast(user_id AS string), '-', cast(k % 7 AS string)) ELSE '' END AS draft_id,
  CASE WHEN k % 5 = 0 THEN concat('B', cast(user_id AS string)) ELSE '' END AS batch_id,
  kind AS event_type, created_at, created_at AS received_at,
  concat('{"company_name":"', CASE WHEN k % 3 = 0 THEN '' ELSE concat('Co', cast(k % 9 AS string)) END,
    '","draft_id":"', CASE WHEN k % 6 = 1 THEN concat('P', cast(k AS string)) ELSE '' END,
    '","batch_id":"', CASE WHEN k % 6 = 2 THEN concat('Q', cast(k AS string)) ELSE '' END,
    '","buyer":{"name":"', CASE WHEN k % 4 = 0 THEN concat('Buyer', cast(k AS string)) ELSE '' END,
    '"},"buyer_name":"', CASE WHEN k % 4 = 1 THEN concat('Name', cast(k AS string)) ELSE '' END,
    '","extract_strategy":"', CASE k % 8 WHEN 0 THEN 'rules_only' WHEN 1 THEN 'rules_plus_vision' ELSE '' END,
    '","llm_provider":"', CASE WHEN k % 9 = 0 THEN 'prov' ELSE '' END,
    '","source_doc_status":"', CASE k % 7 WHEN 0 THEN 'success' WHEN 1 THEN 'not_requested' ELSE '' END,
    '","ocr_status":"', CASE k % 11 WHEN 0 THEN 'success' WHEN 1 THEN 'vision_deferred' ELSE '' END,
    '","item_count":', CASE WHEN kind = 'draft_batch_created' THEN cast(k % 5 AS string) ELSE '0' END,
    ',"error_count":', cast(k % 4 AS string), ',"warning_count":', cast(k % 5 AS string),
    ',"run_id":"', CASE WHEN k % 3 = 1 THEN concat('R', cast(k AS string)) ELSE '' END,
    '","status":"', CASE WHEN k % 2 = 0 THEN 'done' ELSE 'error' END,
    '","failure_count":', cast(k % 6 AS string), ',"preview_clicked":', CASE WHEN k % 10 < 6 THEN 'true' ELSE 'false' END,
    ',"failed":', CASE WHEN k % 5 = 0 THEN '1' ELSE '0' END, ',"changed":', cast(k % 3 AS string), ',"smart":', cast(k % 2 AS string),
    ',"diffs":[', CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN '{"field_name":"a"}' ELSE '{"field_name":"a"},{"field_name":"b"}' END,
    '],"lines":[', CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN '{"project_name":"a"}' ELSE '{"project_name":"a"},{"project_name":"b"}' END,
    '],"llm_metrics":[', CASE k % 7 WHEN 0 THEN '{"status":"success","provider":"m1","task_type":"code"}'
      WHEN 1 THEN '{"status":"failed","provider":"","task_type":"read"},{"status":"success","provider":"m2","task_type":"code"}' ELSE '' END,
    '],"material_summary":{"file_count":', CASE WHEN k % 6 < 2 THEN cast(k % 6 + 1 AS string) ELSE '0' END,
    ',"file_types":{', CASE k % 6 WHEN 0 THEN '".xlsx":1' WHEN 1 THEN '".png":1,".pdf":1' ELSE '' END,
    '},"file_names":[', CASE k % 6 WHEN 0 THEN concat('"f', cast(k AS string), '.xlsx"') WHEN 1 THEN concat('"f', cast(k AS string), '.png","a.pdf"') ELSE '' END,
    ']},"rules":[', CASE WHEN kind <> 'local_learned_rules_saved' THEN ''
      ELSE concat('{"raw_alias":"alias ', cast(k % 13 AS string), '","tax_category":"cat', cast(k % 2 AS string), '","tax_code":"c', cast(k % 3 AS string),
        '","tax_treatment_or_rate":"6%","company_name":"Co', cast(k % 4 AS string), '"},{"raw_alias":"ALIAS-', cast(k % 5 AS string),
        '","tax_category":"', CASE WHEN k % 10 = 2 THEN '' ELSE 'cat' END, '","tax_code":"","tax_treatment_or_rate":"","company_name":""}') END,
    ']}') AS payload
FROM (
  SELECT event_id, user_id, k, created_at,
    CASE event_type
      WHEN 'signup' THEN CASE k % 4 WHEN 0 THEN 'draft_created' WHEN 1 THEN 'draft_batch_created' WHEN 2 THEN 'local_learned_rules_saved' ELSE 'split_child_draft_created' END
      WHEN 'view' THEN CASE k % 4 WHEN 0 THEN 'draft_updated' WHEN 1 THEN 'manual_edits_recorded' WHEN 2 THEN 'batch_smart_code_completed' ELSE 'batch_sheet_saved' END
      WHEN 'click' THEN CASE k % 4 WHEN 0 THEN 'template_exported' WHEN 1 THEN 'batch_template_exported' WHEN 2 THEN 'tax_subject_mismatch_blocked' ELSE 'failure_repairs_applied' END
      WHEN 'purchase' THEN CASE k % 4 WHEN 0 THEN 'batch_run_queued' WHEN 3 THEN 'success_recorded' ELSE 'batch_run_finished' END
      ELSE 'failure_report_uploaded' END AS kind
  FROM (SELECT event_id, user_id, event_type, cast(regexp_extract(props, '([0-9]+)', 1) AS int) AS k, substr(cast(ts AS string), 1, 19) AS created_at FROM events) raw
) typed
"""

# Rejected lines of the import: the wording depends on the line.
VIEWS["failures"] = """
SELECT draft_id, line_no AS pos, draft_id AS serial_no,
  CASE tax_rate WHEN '13%' THEN concat('2-发票明细信息：第 ', cast(line_no + 3 AS string), ' 行税率不合法，请使用如下税率：0.03、0.01、0。')
    WHEN '' THEN concat('第', cast(line_no + 3 AS string), '行商品编码为汇总商品，请使用具体商编')
    WHEN '免税' THEN '1-发票基本信息：购买方名称不能为空' WHEN '3％' THEN '单位码值不正确'
    WHEN '6' THEN '编码 1010101000000000000 不允许填写' WHEN '1%' THEN concat('第 ', cast(line_no + 3 AS string), ' 行税率不合法，请使用如下税率：9%、6')
    ELSE CASE WHEN specification = 'Brand#1' THEN '不属于涉税专业服务机构，不能开具' ELSE '某字段格式不正确' END END AS reason
FROM dlines WHERE unit = '箱'
"""


def _words(text: str) -> set[str]:
    return set(re.findall(r"[a-z_]+", text))


def view_chain(names) -> list[str]:
    """Views needed by ``names``, dependencies first."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for other in VIEWS:
            if other != name and other in _words(VIEWS[name]):
                visit(other)
        order.append(name)

    for name in names:
        visit(name)
    return order


def with_views(body: str) -> str:
    """Put the views a statement uses in front of it."""
    used = [v for v in VIEWS if v in _words(body)]
    if not used:
        return body
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in view_chain(used))
    text = body.strip()
    if text.upper().startswith("WITH "):
        return f"WITH {ctes},\n{text[5:]}"
    return f"WITH {ctes}\n{text}"


# Tables that hold rows in number; the others are small at every scale they are read here.
FACTS = ("lineitem", "orders", "events", "documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. One in fewer splits than there are cores is spread over them.

    A table of many files has more splits than cores and is read as it is, without a shuffle.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in FACTS and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


# Bytes of a table's files up to which Spark may send the table: in memory its rows are up to thirty times as many.
SENT_BYTES = 4 << 20


def merged_if_large(df: DataFrame) -> DataFrame:
    """A table read from files, with the hint to merge it in joins where its files are larger than ``SENT_BYTES``."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.hint("merge") if size > SENT_BYTES else df


def view(spark: SparkSession, sf_dir: str, name: str, merged: tuple[str, ...] = ()) -> DataFrame:
    """A view as a DataFrame; only the tables it reads are registered. Those of ``merged`` are not sent to all tasks where they are large."""
    if name == "hist_exports":
        # Both exports come from one pass over the history, where the statement joins its tables once for each.
        hist = view(spark, sf_dir, "hist", merged)
        files = F.when(F.col("invoice_status") == "正常", F.array(F.lit("export_1.csv"), F.lit("export_2.csv"))).otherwise(F.array(F.lit("export_1.csv")))
        return hist.select(F.explode(files).alias("source_file"), *_HIST_COLUMNS)
    words = set().union(*[_words(VIEWS[v]) for v in view_chain([name])])
    for t in TABLES:
        if t in words:
            df = table(spark, sf_dir, t)
            (merged_if_large(df) if t in merged else df).createOrReplaceTempView(t)
    return spark.sql(with_views(f"SELECT * FROM {name}"))
