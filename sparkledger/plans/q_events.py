"""Queries over the case events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as ev
from .registry import query
from .views import table, view

J = "json_extract_string(payload, '$.{0}')".format
N = "cast(json_extract_string(payload, '$.{0}') AS bigint)".format
SMALL = {"size": 1000}

# Payload fields as columns, then what each event says about its case.
PARSED = f"""e AS (SELECT *, {J('company_name')} AS p_company, {J('draft_id')} AS p_draft, {J('batch_id')} AS p_batch, {J('buyer.name')} AS p_buyer, {J('buyer_name')} AS p_name,
  {J('extract_strategy')} AS p_strategy, {J('llm_provider')} AS p_provider, {J('source_doc_status')} AS p_doc, {J('ocr_status')} AS p_ocr, {N('item_count')} AS p_items,
  {N('error_count')} AS p_errors, {N('warning_count')} AS p_warnings, {J('run_id')} AS p_run, {J('status')} AS p_status, {N('failure_count')} AS p_failures,
  {J('preview_clicked')} = 'true' AS p_preview, {N('failed')} AS p_failed, {N('changed')} AS p_changed, {N('smart')} AS p_smart,
  json_array_length(payload, '$.diffs') AS p_diffs, json_array_length(payload, '$.lines') AS p_lines, {N('material_summary.file_count')} AS p_files,
  json_keys(payload, '$.material_summary.file_types') AS p_types, json_array_length(payload, '$.llm_metrics') AS p_metrics,
  CASE WHEN contains({J('llm_metrics')}, '"success"') THEN 1 ELSE 0 END AS p_success, CASE WHEN contains({J('llm_metrics')}, '"failed"') THEN 1 ELSE 0 END AS p_failure FROM cev)"""
OBS = """o AS (SELECT *, CASE WHEN event_type IN ('draft_created', 'split_child_draft_created', 'draft_batch_created') THEN 'draft' WHEN event_type IN ('draft_updated', 'manual_edits_recorded', 'batch_sheet_saved') THEN 'review'
    WHEN event_type = 'batch_smart_code_completed' THEN 'coding' WHEN event_type IN ('template_exported', 'batch_template_exported') THEN 'export'
    WHEN event_type IN ('tax_subject_mismatch_blocked', 'batch_run_queued', 'batch_run_finished') THEN 'tax' WHEN event_type IN ('failure_report_uploaded', 'failure_repairs_applied') THEN 'repair'
    WHEN event_type = 'success_recorded' THEN 'confirm' ELSE 'input' END AS phase,
  CASE event_type WHEN 'draft_created' THEN '生成单张草稿' WHEN 'split_child_draft_created' THEN '生成单张草稿' WHEN 'draft_batch_created' THEN '生成批量草稿' WHEN 'draft_updated' THEN '保存草稿修改'
    WHEN 'manual_edits_recorded' THEN '人工修改字段' WHEN 'batch_sheet_saved' THEN '保存批量复核修改' WHEN 'batch_smart_code_completed' THEN '点击批量智能赋码/复核'
    WHEN 'template_exported' THEN '生成/校验税局模板' WHEN 'batch_template_exported' THEN '生成/校验税局模板' WHEN 'tax_subject_mismatch_blocked' THEN '提交前识别税局主体'
    WHEN 'batch_run_queued' THEN '发起税局批量上传' WHEN 'batch_run_finished' THEN '税局返回处理结果' WHEN 'failure_report_uploaded' THEN '上传/解析税局失败明细'
    WHEN 'failure_repairs_applied' THEN '应用税局退回修复建议' WHEN 'success_recorded' THEN '人工确认开票结果' ELSE event_type END AS action,
  CASE WHEN event_type = 'batch_smart_code_completed' THEN CASE WHEN p_failed > 0 THEN 'warning' WHEN p_changed + p_smart > 0 THEN 'ok' ELSE 'no_change' END
    WHEN event_type IN ('template_exported', 'batch_template_exported') THEN CASE WHEN p_errors > 0 THEN 'blocked' ELSE 'ok' END
    WHEN event_type = 'tax_subject_mismatch_blocked' THEN 'blocked' WHEN event_type = 'batch_run_queued' THEN 'running'
    WHEN event_type = 'batch_run_finished' THEN CASE WHEN p_status = 'done' THEN 'ok' ELSE 'failed' END WHEN event_type = 'failure_report_uploaded' THEN 'warning' ELSE 'ok' END AS state,
  list_filter([p_strategy, CASE WHEN p_doc = 'success' THEN 'document_parser' ELSE '' END, CASE WHEN p_ocr = 'success' THEN 'ocr' ELSE '' END, CASE WHEN p_provider <> '' THEN 'llm_extraction' ELSE '' END,
    CASE WHEN event_type = 'batch_smart_code_completed' THEN 'tax_code_router' ELSE '' END, CASE WHEN event_type = 'batch_smart_code_completed' AND p_smart > 0 THEN 'llm_taxonomy' ELSE '' END,
    CASE WHEN event_type = 'batch_smart_code_completed' AND p_changed > 0 AND p_smart = 0 THEN 'deterministic_or_rule_coding' ELSE '' END,
    CASE WHEN event_type IN ('template_exported', 'batch_template_exported') THEN 'tax_template_validator' ELSE '' END,
    CASE WHEN event_type IN ('batch_run_queued', 'batch_run_finished', 'tax_subject_mismatch_blocked') THEN 'tax_browser_cdp' ELSE '' END,
    CASE WHEN event_type IN ('failure_report_uploaded', 'failure_repairs_applied') THEN 'tax_failure_parser' ELSE '' END,
    CASE WHEN list_contains(p_types, '.xlsx') THEN 'excel_parser' ELSE '' END, CASE WHEN list_contains(p_types, '.png') THEN 'image_material' ELSE '' END], lambda c: c <> '') AS caps,
  p_metrics > 0 OR p_provider <> '' OR (event_type = 'batch_smart_code_completed' AND p_smart > 0) AS llm_attempted,
  CASE WHEN event_type = 'batch_smart_code_completed' AND p_smart > 0 THEN 1 ELSE p_success END AS llm_success, p_failure AS llm_failed FROM e)"""


@query("observations", f"""WITH {PARSED}, {OBS} SELECT event_id, phase, action, state AS status, array_to_string(caps, ',') AS capabilities, llm_attempted, llm_success, llm_failed,
  CASE WHEN p_provider <> '' THEN p_provider WHEN p_metrics = 1 THEN 'm1' WHEN p_metrics = 2 THEN 'm2' ELSE '' END AS llm_provider,
  CASE p_metrics WHEN 1 THEN 'code' WHEN 2 THEN 'read,code' ELSE '' END AS llm_tasks, p_files AS file_count FROM o""")
def _(spark, sf):
    o = ev.observations(view(spark, sf, "cev"))
    return o.select("event_id", "phase", "action", "status", F.array_join("capabilities", ",").alias("capabilities"), "llm_attempted", "llm_success", "llm_failed",
                    "llm_provider", F.array_join("llm_tasks", ",").alias("llm_tasks"), "file_count")


@query("last_observations", f"""WITH {PARSED}, {OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY tenant, case_id ORDER BY seq DESC) AS back, count(*) OVER (PARTITION BY tenant, case_id) AS many FROM o)
SELECT tenant, case_id, least(many, 16) - back + 1 AS position, event_id, phase, action, state AS status, array_to_string(caps, ',') AS capabilities, llm_attempted FROM r WHERE back <= 16""")
def _(spark, sf):
    o = ev.last_observations(view(spark, sf, "cev"))
    return o.select("tenant", "case_id", "position", "event_id", "phase", "action", "status", F.array_join("capabilities", ",").alias("capabilities"), "llm_attempted")


STATUS_SQL = """CASE WHEN event_type IN ('draft_created', 'split_child_draft_created', 'draft_batch_created') THEN 'draft_generated'
  WHEN event_type IN ('template_exported', 'batch_template_exported') THEN CASE WHEN p_errors = 0 THEN 'template_ready' ELSE 'needs_review' END
  WHEN event_type = 'batch_run_queued' THEN 'tax_run_queued' WHEN event_type = 'tax_subject_mismatch_blocked' THEN 'subject_mismatch_blocked'
  WHEN event_type = 'batch_run_finished' THEN CASE WHEN p_status <> 'done' THEN 'tax_run_failed' WHEN p_preview THEN 'tax_preview_reached' ELSE 'tax_run_done' END
  WHEN event_type = 'success_recorded' THEN 'assistant_confirmed' END"""
MATERIAL_SQL = """CASE WHEN p_strategy = 'rules_plus_vision' THEN '图片/视觉识别' WHEN p_ocr = 'success' THEN '图片/OCR' WHEN p_doc = 'success' THEN '文档材料' WHEN p_items > 0 THEN '批量材料'
  WHEN p_files > 0 THEN concat(replace(array_to_string(list_sort(p_types), '/'), '.', ''), ' ', p_files, ' 个') END"""


def summary_sql(keys: str) -> str:
    last = lambda v, c: f"arg_max({v}, seq) FILTER ({c})"
    return f"""SELECT {keys}, coalesce({last('draft_id', "draft_id <> ''")}, arg_min(p_draft, seq) FILTER (p_draft <> ''), '') AS draft_id,
  coalesce({last('batch_id', "batch_id <> ''")}, arg_min(p_batch, seq) FILTER (p_batch <> ''), '') AS batch_id,
  arg_min(created_at, seq) AS created_at, arg_max(created_at, seq) AS last_at, arg_max(received_at, seq) AS last_received_at,
  coalesce({last('p_company', "p_company <> ''")}, '') AS company_name,
  coalesce({last("CASE WHEN p_buyer <> '' THEN p_buyer ELSE p_name END", "p_buyer <> '' OR p_name <> ''")}, '') AS buyer_name,
  coalesce({last('material', 'material IS NOT NULL')}, '未记录') AS material_type,
  coalesce({last('p_items', "event_type = 'draft_batch_created' AND p_items > 0")}, 1) AS invoice_count,
  coalesce({last('p_lines', 'p_lines > 0')}, 0) AS line_count, coalesce({last('p_strategy', "p_strategy <> ''")}, '') AS extract_strategy,
  coalesce({last('p_provider', "p_provider <> ''")}, '') AS llm_provider,
  coalesce(sum(p_diffs) FILTER (event_type = 'manual_edits_recorded'), 0) AS manual_edit_count,
  coalesce({last('p_errors', "event_type LIKE '%template_exported'")}, 0) AS export_error_count,
  coalesce({last('p_warnings', "event_type LIKE '%template_exported'")}, 0) AS export_warning_count,
  coalesce({last('p_run', "event_type LIKE 'batch_run%' AND p_run <> ''")}, '') AS run_id,
  coalesce({last('p_status', "event_type = 'batch_run_finished'")}, '') AS run_status,
  coalesce({last('p_failures', "event_type = 'batch_run_finished'")}, 0) AS failure_count,
  coalesce({last('p_preview', "event_type = 'batch_run_finished'")}, false) AS preview_reached,
  bool_or(event_type = 'success_recorded') AS assistant_confirmed, coalesce({last('state', 'state IS NOT NULL')}, 'created') AS status,
  arg_max(event_type, seq) AS last_event_type, count(*) AS event_count
FROM (SELECT *, {STATUS_SQL} AS state, {MATERIAL_SQL} AS material FROM e) x GROUP BY {keys}"""


@query("case_summary", f"WITH {PARSED} {summary_sql('tenant, case_id')}")
def _(spark, sf):
    return ev.case_summary(view(spark, sf, "cev")).drop("status_label")


STEP_SQL = f"""WITH {PARSED}, {OBS},
parts AS (SELECT tenant, case_id, seq, 0 AS sub, created_at, 'input' AS phase, '上传客户材料' AS action, 'ok' AS state, []::varchar[] AS caps, false AS own, llm_success, llm_failed FROM o WHERE p_files > 0
  UNION ALL SELECT tenant, case_id, seq, 1, created_at, 'parse', '解析上传材料', 'ok', caps, false, llm_success, llm_failed FROM o
    WHERE list_has_any(caps, ['rules_plus_vision', 'rules_only', 'document_parser', 'ocr', 'excel_parser', 'image_material'])
  UNION ALL SELECT tenant, case_id, seq, 2, created_at, phase, action, state, caps, true, llm_success, llm_failed FROM o),
ranked AS (SELECT *, CASE state WHEN 'running' THEN 2 WHEN 'warning' THEN 3 WHEN 'blocked' THEN 4 WHEN 'failed' THEN 5 ELSE 1 END AS sev FROM parts),
agg AS (SELECT tenant, case_id, phase, arg_max(state, (sev, seq, sub)) AS status, arg_max(created_at, (seq, sub)) AS last_at, sum(CASE WHEN own THEN llm_success ELSE 0 END) AS llm_success,
  sum(CASE WHEN own THEN llm_failed ELSE 0 END) AS llm_failed, count(CASE WHEN own AND state IN ('warning', 'blocked', 'failed', 'no_change') THEN 1 END) AS detail_count FROM ranked GROUP BY ALL),
acts AS (SELECT tenant, case_id, phase, string_agg(action, ',' ORDER BY ord) AS actions FROM (SELECT tenant, case_id, phase, action, min((seq, sub)) AS ord FROM parts GROUP BY ALL) a GROUP BY ALL),
caps AS (SELECT tenant, case_id, phase, string_agg(cap, ',' ORDER BY rn) AS capabilities FROM (SELECT *, row_number() OVER (PARTITION BY tenant, case_id, phase ORDER BY ord) AS rn FROM (
  SELECT tenant, case_id, phase, cap, min((seq, sub, i)) AS ord FROM (SELECT tenant, case_id, phase, seq, sub, unnest(caps) AS cap, generate_subscripts(caps, 1) AS i FROM parts) u GROUP BY ALL) v) w WHERE rn <= 8 GROUP BY ALL),
steps AS (SELECT c.tenant, c.case_id, ph.step_no, ph.phase, coalesce(status, 'pending') AS status, coalesce(last_at, '') AS last_at, coalesce(actions, '') AS actions, coalesce(capabilities, '') AS capabilities,
    coalesce(llm_success, 0) AS llm_success, coalesce(llm_failed, 0) AS llm_failed, coalesce(detail_count, 0) AS detail_count
  FROM (SELECT DISTINCT tenant, case_id FROM cev) c JOIN (SELECT unnest(range(1, 10)) AS step_no, unnest(['input', 'parse', 'draft', 'review', 'coding', 'export', 'tax', 'repair', 'confirm']) AS phase) ph ON TRUE
  LEFT JOIN agg ON agg.tenant = c.tenant AND agg.case_id = c.case_id AND agg.phase = ph.phase LEFT JOIN acts ON acts.tenant = c.tenant AND acts.case_id = c.case_id AND acts.phase = ph.phase
  LEFT JOIN caps ON caps.tenant = c.tenant AND caps.case_id = c.case_id AND caps.phase = ph.phase)"""


@query("workflow_steps", f"{STEP_SQL} SELECT * FROM steps")
def _(spark, sf):
    s = ev.workflow_steps(view(spark, sf, "cev"))
    return s.select("tenant", "case_id", "step_no", "phase", "status", "last_at", F.array_join("actions", ",").alias("actions"),
                    F.array_join("capabilities", ",").alias("capabilities"), "llm_success", "llm_failed", "detail_count")


@query("problem_phase", f"""{STEP_SQL} SELECT tenant, case_id, coalesce(arg_min(phase, (CASE status WHEN 'failed' THEN 1 WHEN 'blocked' THEN 2 WHEN 'warning' THEN 3 ELSE 4 END, step_no))
  FILTER (status IN ('failed', 'blocked', 'warning', 'no_change')), arg_max(phase, step_no) FILTER (status <> 'pending'), '') AS problem_phase FROM steps GROUP BY ALL""")
def _(spark, sf):
    return ev.problem_phase(ev.workflow_steps(view(spark, sf, "cev"))).drop("problem_label")


@query("case_rollups", f"""WITH {PARSED}, {OBS},
caps AS (SELECT tenant, case_id, string_agg(cap, ',' ORDER BY ord) AS capabilities FROM (SELECT *, row_number() OVER (PARTITION BY tenant, case_id ORDER BY ord) AS rn FROM (
  SELECT tenant, case_id, cap, min((seq, i)) AS ord FROM (SELECT tenant, case_id, seq, unnest(caps) AS cap, generate_subscripts(caps, 1) AS i FROM o) u GROUP BY ALL) v) w WHERE rn <= 12 GROUP BY ALL),
acts AS (SELECT tenant, case_id, string_agg(action, ',' ORDER BY ord) AS actions FROM (SELECT *, row_number() OVER (PARTITION BY tenant, case_id ORDER BY ord DESC) AS rn FROM (
  SELECT tenant, case_id, action, min(seq) AS ord FROM o GROUP BY ALL) v) w WHERE rn <= 10 GROUP BY ALL),
files AS (SELECT tenant, case_id, string_agg(f, ',' ORDER BY ord) AS files FROM (SELECT *, row_number() OVER (PARTITION BY tenant, case_id ORDER BY ord) AS rn FROM (
  SELECT tenant, case_id, f, min((seq, i)) AS ord FROM (SELECT tenant, case_id, seq, unnest(fs) AS f, generate_subscripts(fs, 1) AS i FROM (SELECT tenant, case_id, seq,
    from_json(json_extract(payload, '$.material_summary.file_names'), '["VARCHAR"]') AS fs FROM o) y) u GROUP BY ALL) v) w WHERE rn <= 12 GROUP BY ALL)
SELECT t.*, coalesce(capabilities, '') AS capabilities, actions, coalesce(files, '') AS files FROM (SELECT tenant, case_id, sum(llm_success) AS llm_success, sum(llm_failed) AS llm_failed,
  CASE WHEN NOT bool_or(llm_attempted) THEN '未调用' WHEN sum(llm_failed) > 0 THEN '有失败' WHEN sum(llm_success) > 0 THEN '成功' ELSE '已尝试/无推荐' END AS llm_label FROM o GROUP BY ALL) t
LEFT JOIN caps ON caps.tenant = t.tenant AND caps.case_id = t.case_id LEFT JOIN acts ON acts.tenant = t.tenant AND acts.case_id = t.case_id LEFT JOIN files ON files.tenant = t.tenant AND files.case_id = t.case_id""")
def _(spark, sf):
    r = ev.case_rollups(view(spark, sf, "cev"))
    return r.select("tenant", "case_id", "llm_success", "llm_failed", "llm_label", *[F.coalesce(F.array_join(c, ","), F.lit("")).alias(c) for c in ("capabilities", "actions", "files")])


@query("execution_metrics", f"""WITH {PARSED}, s AS ({summary_sql('case_id')}) SELECT count(*) AS case_count, sum(event_count) AS event_count, count(CASE WHEN status = 'tax_run_failed' THEN 1 END) AS failed_count,
  count(CASE WHEN preview_reached THEN 1 END) AS preview_count, count(CASE WHEN assistant_confirmed THEN 1 END) AS confirmed_count,
  (SELECT count(*) FROM cev WHERE event_type = 'failure_report_uploaded') AS pending_count FROM s""")
def _(spark, sf):
    e = view(spark, sf, "cev")
    return ev.execution_metrics(e, e.filter(F.col("event_type") == "failure_report_uploaded"))


@query("newest_cases", "SELECT case_id, max(created_at) AS last_at, count(*) AS event_count FROM cev GROUP BY case_id ORDER BY 2 DESC, 1 LIMIT 200")
def _(spark, sf):
    return ev.newest_cases(view(spark, sf, "cev")).select("case_id", "last_at", "event_count")


@query("case_timeline", "SELECT event_id, tenant, case_id, row_number() OVER (PARTITION BY tenant, case_id ORDER BY seq) AS position FROM cev")
def _(spark, sf):
    return ev.case_timeline(view(spark, sf, "cev").select("event_id", "tenant", "case_id", "seq"), size=1000).select("event_id", "tenant", "case_id", "position")


@query("last_events", "SELECT event_id, tenant, case_id FROM (SELECT *, row_number() OVER (PARTITION BY tenant, case_id ORDER BY seq DESC) AS rn FROM cev) r WHERE rn <= 12")
def _(spark, sf):
    return ev.last_events(view(spark, sf, "cev")).select("event_id", "tenant", "case_id")


@query("recent_events", "SELECT event_id, case_id, event_type FROM cev WHERE tenant = 'T1' ORDER BY received_at DESC, seq DESC LIMIT 50")
def _(spark, sf):
    return ev.recent_events(view(spark, sf, "cev"), "T1").select("event_id", "case_id", "event_type")


@query("recent_cases", f"""WITH {PARSED}, s AS ({summary_sql('tenant, case_id')}) SELECT case_id, event_count, status, last_received_at FROM s WHERE tenant = 'T2'
  AND case_id IN (SELECT case_id FROM cev WHERE tenant = 'T2' GROUP BY case_id ORDER BY max(received_at) DESC, case_id LIMIT 20)""")
def _(spark, sf):
    return ev.recent_cases(view(spark, sf, "cev"), "T2", 20).select("case_id", "event_count", "status", "last_received_at")


@query("store_stats", """SELECT (SELECT count(*) FROM cev) AS total_events, (SELECT count(DISTINCT (tenant, case_id)) FROM cev) AS total_cases, (SELECT count(DISTINCT tenant) FROM cev) AS total_tenants,
  (SELECT count(*) FROM rules) AS total_rule_packages, (SELECT count(*) FROM supplier WHERE s_acctbal > 0) AS total_seller_profiles, (SELECT count(*) FROM customer) AS total_buyer_profiles,
  (SELECT count(*) FROM part) AS total_line_profiles""")
def _(spark, sf):
    active = F.lit("active").alias("status")
    sellers = table(spark, sf, "supplier").select(F.when(F.col("s_acctbal") > 0, "active").otherwise("closed").alias("status"))
    return ev.store_stats(view(spark, sf, "cev"), view(spark, sf, "rules"), sellers, table(spark, sf, "customer").select(active), table(spark, sf, "part").select(active))


@query("rule_candidates", """WITH r AS (SELECT seq, received_at, case_id, draft_id, ord, rule ->> '$.raw_alias' AS raw_alias, rule ->> '$.tax_category' AS tax_category, rule ->> '$.tax_code' AS tax_code,
    rule ->> '$.tax_treatment_or_rate' AS rate, rule ->> '$.company_name' AS company FROM (SELECT *, unnest(rs) AS rule, generate_subscripts(rs, 1) AS ord FROM (
    SELECT seq, received_at, case_id, draft_id, from_json(json_extract(payload, '$.rules'), '["JSON"]') AS rs FROM cev WHERE tenant = 'T0' AND event_type = 'local_learned_rules_saved') q) x),
k AS (SELECT *, regexp_replace(upper(raw_alias), '[^\\p{L}\\p{N}]', '', 'g') AS ak FROM r WHERE raw_alias <> '' AND tax_category <> ''),
g AS (SELECT *, cast(row_number() OVER (ORDER BY pos) AS varchar) AS no FROM (SELECT ak, tax_category, tax_code, rate, min((seq, ord)) AS pos, count(*) AS evidence_count, arg_min(received_at, (seq, ord)) AS first_seen_at, arg_max(received_at, (seq, ord)) AS last_seen_at FROM k GROUP BY ALL) h),
c AS (SELECT ak, tax_category, tax_code, rate, string_agg(v, '、' ORDER BY o) AS company_names FROM (SELECT ak, tax_category, tax_code, rate, company AS v, min((seq, ord)) AS o FROM k WHERE company <> '' GROUP BY ALL) y GROUP BY ALL),
s AS (SELECT ak, tax_category, tax_code, rate, string_agg(v, '、' ORDER BY o) AS case_ids FROM (SELECT ak, tax_category, tax_code, rate, case_id AS v, min((seq, ord)) AS o FROM k GROUP BY ALL) y GROUP BY ALL),
n AS (SELECT ak, tax_category, tax_code, rate, string_agg(v, '、' ORDER BY o) AS raw_alias FROM (SELECT ak, tax_category, tax_code, rate, raw_alias AS v, min((seq, ord)) AS o FROM k GROUP BY ALL) y GROUP BY ALL)
SELECT concat('cand-', lpad(no, greatest(4, length(no))::int, '0')) AS candidate_id, n.raw_alias, g.tax_category, g.tax_code, g.rate AS tax_treatment_or_rate, evidence_count, first_seen_at, last_seen_at,
  coalesce(company_names, '') AS company_names, case_ids FROM g JOIN n ON n.ak = g.ak AND n.tax_category = g.tax_category AND n.tax_code = g.tax_code AND n.rate = g.rate
  JOIN s ON s.ak = g.ak AND s.tax_category = g.tax_category AND s.tax_code = g.tax_code AND s.rate = g.rate
  LEFT JOIN c ON c.ak = g.ak AND c.tax_category = g.tax_category AND c.tax_code = g.tax_code AND c.rate = g.rate""")
def _(spark, sf):
    return ev.rule_candidates(view(spark, sf, "cev"), "T0").select(
        "candidate_id", "raw_alias", "tax_category", "tax_code", "tax_treatment_or_rate", "evidence_count", "first_seen_at", "last_seen_at", "company_names", "case_ids")


PACKAGES_SQL = """SELECT event_id AS package_id, seq, tenant, concat('v', cast(seq AS string)) AS version, CASE WHEN draft_id = '' THEN 'active' ELSE 'retired' END AS status, received_at AS published_at,
  concat('[{"rule_id":"', event_id, '-1","raw_alias":"', case_id, '","tax_category":"a"},{"rule_id":"', event_id, '-2","raw_alias":"b","tax_category":"c"}]') AS rules_json FROM cev"""


@query("latest_rules", f"""SELECT tenant, package_id, version, rule_pos, concat(package_id, '-', rule_pos + 1) AS rule_id FROM (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY published_at DESC, seq DESC) AS rn
  FROM ({PACKAGES_SQL}) p WHERE status = 'active') r JOIN (SELECT unnest([0, 1]) AS rule_pos) n ON TRUE WHERE rn = 1""")
def _(spark, sf):
    view(spark, sf, "cev").createOrReplaceTempView("cev")
    return ev.latest_rules(spark.sql(PACKAGES_SQL)).select("tenant", "package_id", "version", "rule_pos", "rule_id")


FILES_SQL = """SELECT concat('S', cast(l_suppkey AS string)) AS draft_id, cast(l_orderkey AS bigint) * 8 + l_linenumber AS pos, cast(l_quantity AS bigint) AS size_bytes, '' AS stored_name,
  CASE l_returnflag WHEN 'A' THEN concat('a', cast(l_orderkey AS string), '.PNG') WHEN 'N' THEN concat('n', cast(l_orderkey AS string), '.xlsx') ELSE concat('r', cast(l_orderkey AS string)) END AS original_name FROM lineitem"""


@query("attachment_summary", f"""WITH f AS ({FILES_SQL}), n AS (SELECT draft_id, string_agg(original_name, ',' ORDER BY pos, original_name) AS file_names FROM (SELECT *, row_number() OVER (PARTITION BY draft_id ORDER BY pos, original_name) AS rn FROM f) r
  WHERE rn <= 12 GROUP BY draft_id) SELECT f.draft_id, count(*) AS file_count, sum(size_bytes) AS total_size_bytes, count(CASE WHEN original_name LIKE '%.PNG' THEN 1 END) AS png,
  count(CASE WHEN original_name LIKE '%.xlsx' THEN 1 END) AS xlsx, count(CASE WHEN original_name NOT LIKE '%.%' THEN 1 END) AS unknown, min(file_names) AS file_names FROM f JOIN n ON n.draft_id = f.draft_id GROUP BY f.draft_id""")
def _(spark, sf):
    table(spark, sf, "lineitem").createOrReplaceTempView("lineitem")
    a = ev.attachment_summary(spark.sql(FILES_SQL))
    kind = lambda k: F.coalesce(F.try_element_at("file_types", F.lit(k)), F.lit(0))
    return a.select("draft_id", "file_count", "total_size_bytes", kind(".png").alias("png"), kind(".xlsx").alias("xlsx"), kind("unknown").alias("unknown"), F.array_join("file_names", ",").alias("file_names"))


@query("draft_events", """SELECT d.draft_id, d.case_id, d.batch_id, 'draft_created' AS event_type, d.company_name, d.buyer_name, coalesce(n, 0) AS lines, coalesce(names, '') AS names FROM drafts d
LEFT JOIN (SELECT draft_id, count(*) AS n, string_agg(project_name, '|' ORDER BY line_no, project_name) AS names FROM dlines GROUP BY draft_id) l ON l.draft_id = d.draft_id""")
def _(spark, sf):
    e = ev.parse_payload(ev.draft_events(view(spark, sf, "drafts"), view(spark, sf, "dlines"), "draft_created", F.col("created_at")))
    return e.select("draft_id", "case_id", "batch_id", "event_type", F.col("p.company_name").alias("company_name"), F.col("p.buyer.name").alias("buyer_name"),
                    F.greatest(F.coalesce(F.size("p.lines"), F.lit(0)), F.lit(0)).alias("lines"), F.coalesce(F.array_join(F.col("p.lines.project_name"), "|"), F.lit("")).alias("names"))


LOG_SQL = """SELECT concat('{"event_id":"', event_id, '","case_id":"', case_id, '","draft_id":"', draft_id, '","batch_id":"', batch_id, '","event_type":"', event_type, '","created_at":"', created_at, '","payload":', payload, '}') AS value FROM cev"""


@query("read_case_events", "SELECT event_id, case_id, event_type, created_at, json_extract_string(payload, '$.run_id') AS run_id FROM cev")
def _(spark, sf):
    from ..sources.tables import event_rows

    view(spark, sf, "cev").createOrReplaceTempView("cev")
    e = ev.parse_payload(event_rows(spark.sql(LOG_SQL)))
    return e.select("event_id", "case_id", "event_type", "created_at", F.col("p.run_id").alias("run_id"))
