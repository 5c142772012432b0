"""Queries over profiles, history sources, ledger and sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, profiles
from ..sources import tables as src
from .q_standard import AMOUNT_SQL
from .registry import query
from .views import table, view


@query("read_rules", "SELECT tier, entry_id, raw_alias, tax_category, tax_code, source_label FROM rules")
def _(spark, sf):
    raw = view(spark, sf, "rules").withColumn("status", F.lit("ready")).withColumn("rule_id", F.col("entry_id"))
    tiers = [src.rule_entries(raw.filter(F.col("tier") == n), name) for name, (n, _) in src.TIERS.items()]
    return src.union_tiers(*tiers).select("tier", "entry_id", "raw_alias", "tax_category", "tax_code", "source_label")


@query("union_tiers", "SELECT tier, entry_id, raw_alias FROM rules UNION ALL SELECT 1, concat('X-', p_brand), p_brand FROM part GROUP BY p_brand")
def _(spark, sf):
    rules = view(spark, sf, "rules").select("tier", "entry_id", "raw_alias")
    brands = table(spark, sf, "part").select("p_brand").distinct().select(
        F.lit(1).alias("tier"), F.concat(F.lit("X-"), "p_brand").alias("entry_id"), F.col("p_brand").alias("raw_alias"))
    return src.union_tiers(rules, brands)


@query("read_taxonomy", "SELECT official_code, official_name, category_short_name, description FROM tax")
def _(spark, sf):
    return src.taxonomy_entries(view(spark, sf, "tax"))


HISTORY_RENAME = {n: h for h, n in src.HISTORY_HEADERS.items()}


@query("history_rows", "SELECT line_key, seller_name, buyer_name, tax_category, project_name, amount_with_tax, unit_price FROM hist")
def _(spark, sf):
    raw = view(spark, sf, "hist").drop("tax_category", "project_name", "source_file", "line_no").withColumnsRenamed(HISTORY_RENAME)
    return src.history_rows(raw).select("line_key", "seller_name", "buyer_name", "tax_category", "project_name", "amount_with_tax", "unit_price")


@query("dedupe_history", """SELECT min(concat(source_file, ' ', line_key)) AS first_row, count(*) AS copies, min(seller_name) AS seller_name FROM hist_exports
GROUP BY seller_tax_id, seller_name, buyer_tax_id, buyer_name, serial, substr(invoice_date, 1, 10), full_item_name, tax_code, tax_rate, amount, tax_amount, amount_with_tax""")
def _(spark, sf):
    return profiles.dedupe_history(view(spark, sf, "hist_exports"), columns=("source_file", "line_key", "seller_name")).select(
        F.concat_ws(" ", "source_file", "line_key").alias("first_row"), "copies", "seller_name")


SELLER_SQL = """WITH v AS (SELECT seller_name, seller_tax_id, project_name, tax_category, tax_code, tax_rate, count(*) AS n, min(line_key) AS p FROM trusted GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY seller_tax_id ORDER BY n DESC, p) AS rn FROM v),
base AS (SELECT seller_name, seller_tax_id, count(*) AS history_rows, count(DISTINCT serial) AS invoice_count, count(DISTINCT buyer_tax_id) AS buyer_count,
  min(invoice_date) AS date_min, max(invoice_date) AS date_max, sum(amount_with_tax) AS total_amount_with_tax FROM trusted GROUP BY ALL)
SELECT base.*, project_name AS primary_project, tax_category AS primary_tax_category, tax_code AS primary_tax_code, tax_rate AS primary_tax_rate
FROM base JOIN top ON base.seller_tax_id = top.seller_tax_id AND rn = 1"""


@query("seller_profiles", SELLER_SQL)
def _(spark, sf):
    return profiles.seller_profiles(filters.trusted_history(view(spark, sf, "hist"))).drop("source_confidence")


@query("project_profiles", """SELECT seller_name, seller_tax_id, full_item_name, tax_category, project_name, tax_code, tax_rate,
  CASE WHEN unit = '' THEN '项' ELSE unit END AS unit, count(*) AS line_count, sum(amount_with_tax) AS total_amount_with_tax,
  CASE WHEN count(*) >= 2 THEN 'high' ELSE 'medium' END AS confidence FROM trusted GROUP BY 1, 2, 3, 4, 5, 6, 7, 8""")
def _(spark, sf):
    return profiles.project_profiles(filters.trusted_history(view(spark, sf, "hist")))


@query("buyer_profiles", """WITH i AS (SELECT seller_name, seller_tax_id, buyer_name, buyer_tax_id, project_name, count(*) AS n, min(line_key) AS p FROM trusted GROUP BY ALL),
l AS (SELECT seller_tax_id, buyer_tax_id, string_agg(concat(project_name, ':', n), '；' ORDER BY n DESC, p) AS common_projects FROM i GROUP BY ALL)
SELECT b.*, common_projects FROM (SELECT seller_name, seller_tax_id, buyer_name, buyer_tax_id, count(*) AS line_count, sum(amount_with_tax) AS total_amount_with_tax,
  min(invoice_date) AS first_date, max(invoice_date) AS last_date, count(DISTINCT serial) AS invoice_count_hint FROM trusted GROUP BY ALL) b
JOIN l ON l.seller_tax_id = b.seller_tax_id AND l.buyer_tax_id = b.buyer_tax_id""")
def _(spark, sf):
    return profiles.buyer_profiles(filters.trusted_history(view(spark, sf, "hist")))


DOMINANT_SQL = """SELECT seller_name, project_name, tax_category, tax_code, tax_rate, specification, CASE WHEN unit = '' THEN '项' ELSE unit END AS unit,
  CASE WHEN n >= 2 THEN 'high' ELSE 'medium' END AS confidence
FROM (SELECT *, row_number() OVER (PARTITION BY seller_name ORDER BY n DESC, p) AS rn FROM (
  SELECT seller_name, project_name, tax_category, tax_code, tax_rate, unit, count(*) AS n, min(line_key) AS p, arg_max(specification, line_key) AS specification
  FROM hist WHERE invoice_status <> '作废' AND amount_with_tax >= 0 GROUP BY 1, 2, 3, 4, 5, 6) c) r WHERE rn = 1"""


@query("dominant_line", DOMINANT_SQL)
def _(spark, sf):
    return profiles.dominant_line(view(spark, sf, "hist")).drop("quantity", "matched_source")


@query("draft_totals", f"""WITH l AS (SELECT *, {AMOUNT_SQL} AS amount FROM dlines),
n AS (SELECT draft_id, project_name, row_number() OVER (PARTITION BY draft_id ORDER BY line_no) AS rn FROM dlines WHERE project_name <> ''),
h AS (SELECT draft_id, string_agg(project_name, ' / ' ORDER BY rn) FILTER (rn <= 3) AS head, count(*) AS named FROM n GROUP BY draft_id)
SELECT l.draft_id, count(*) AS line_count, sum(amount) AS total_amount, count(CASE WHEN tax_category <> '' OR coding_reference <> '' THEN 1 END) AS coded,
  count(CASE WHEN tax_category = '' THEN 1 END) AS pending,
  coalesce(min(CASE WHEN named <= 3 THEN head WHEN named > 3 THEN concat(head, ' 等 ', named, ' 项') END), '待补充') AS project_preview
FROM l LEFT JOIN h ON l.draft_id = h.draft_id GROUP BY l.draft_id""")
def _(spark, sf):
    return profiles.draft_totals(view(spark, sf, "dlines"))


@query("batch_items", f"""WITH t AS (SELECT draft_id, count(*) AS line_count, sum({AMOUNT_SQL}) AS amount_total, arg_min(project_name, line_no) AS project_summary,
  count(CASE WHEN project_name = '' OR {AMOUNT_SQL} IS NULL OR tax_rate = '' OR tax_code = '' THEN 1 END) AS open_lines FROM dlines GROUP BY draft_id)
SELECT batch_id, d.draft_id, CASE WHEN buyer_name = '' THEN '待补全购买方名称' ELSE buyer_name END AS buyer_name, invoice_kind, amount_total,
  coalesce(project_summary, '') AS project_summary, coalesce(line_count, 0) AS line_count,
  CASE WHEN buyer_name = '' THEN '必填：请补全购买方名称' WHEN buyer_tax_id = '' THEN '必填：请补全购买方税号'
    WHEN open_lines > 0 THEN concat('明细中仍有 ', open_lines, ' 行缺少税收分类、税收编码、税率或金额') ELSE '' END AS issue_summary
FROM drafts d LEFT JOIN t ON d.draft_id = t.draft_id""")
def _(spark, sf):
    return profiles.batch_items(view(spark, sf, "drafts"), view(spark, sf, "dlines"))


def _documents(spark, sf):
    rows = filters.trusted_history(view(spark, sf, "hist"))
    return profiles.profile_documents(profiles.project_profiles(rows), profiles.buyer_profiles(rows))


@query("profile_documents", """SELECT seller_name, seller_tax_id, string_agg(concat(project_name, '/', tax_code, '/', tax_rate, '/', unit, ':', n), '；'
  ORDER BY n DESC, full_item_name, tax_category, project_name, tax_code, tax_rate, unit) AS projects
FROM (SELECT seller_name, seller_tax_id, full_item_name, tax_category, project_name, tax_code, tax_rate, CASE WHEN unit = '' THEN '项' ELSE unit END AS unit, count(*) AS n
  FROM trusted GROUP BY ALL) p GROUP BY ALL""")
def _(spark, sf):
    listed = F.transform("project_profiles", lambda x: F.concat(
        F.concat_ws("/", x["project_name"], x["tax_code"], x["tax_rate"], x["unit"]), F.lit(":"), x["line_count"].cast("string")))
    return _documents(spark, sf).select("seller_name", "seller_tax_id", F.array_join(listed, "；").alias("projects"))


@query("read_profiles", """SELECT seller_name, 'buyer' AS kind, buyer_name AS name, count(*) AS line_count FROM trusted GROUP BY ALL
UNION ALL SELECT seller_name, 'project', concat_ws('/', full_item_name, tax_code, tax_rate, CASE WHEN unit = '' THEN '项' ELSE unit END), count(*) FROM trusted GROUP BY ALL""")
def _(spark, sf):
    projects, buyers = profiles.flatten_profiles(_documents(spark, sf))
    return buyers.select("seller_name", F.lit("buyer").alias("kind"), F.col("buyer_name").alias("name"), "line_count").unionByName(
        projects.select("seller_name", F.lit("project").alias("kind"), F.concat_ws("/", "full_item_name", "tax_code", "tax_rate", "unit").alias("name"), "line_count"))


@query("active_profiles", """SELECT seller_name, string_agg(concat(buyer_name, ':', n), '；' ORDER BY n DESC, buyer_name) AS buyers
FROM (SELECT seller_name, buyer_name, count(*) AS n FROM trusted WHERE seller_name LIKE '%Supplier%' GROUP BY ALL) b GROUP BY seller_name""")
def _(spark, sf):
    rows = filters.trusted_history(view(spark, sf, "hist"))
    sellers = rows.groupBy(*profiles.SELLER).agg(F.max("invoice_date").alias("updated_at")).select(
        "*", F.lit("default").alias("tenant"), F.lit("active").alias("status"))
    found = profiles.active_profiles(sellers, profiles.project_profiles(rows), profiles.buyer_profiles(rows), "", seller_name="supplier")
    listed = F.transform("buyer_profiles", lambda x: F.concat_ws(":", x["buyer_name"], x["line_count"].cast("string")))
    return found.select("seller_name", F.array_join(listed, "；").alias("buyers"))


@query("replace_ledger", f"""SELECT draft_id, line_no, amount FROM (SELECT draft_id, line_no, {AMOUNT_SQL} AS amount FROM lines_before
  WHERE draft_id NOT IN (SELECT draft_id FROM lines_after WHERE tax_category = 'SMALL')) o
UNION ALL SELECT draft_id, line_no, {AMOUNT_SQL} FROM lines_after WHERE draft_id IN (SELECT draft_id FROM lines_after WHERE tax_category = 'SMALL')""")
def _(spark, sf):
    after = view(spark, sf, "lines_after")
    saved = after.join(after.filter(F.col("tax_category") == "SMALL").select("draft_id").distinct(), "draft_id", "left_semi")
    from ..operators.standardize import standardize_lines

    return standardize_lines(src.replace_by_key(view(spark, sf, "lines_before"), saved, ["draft_id"])).select("draft_id", "line_no", "amount")


FILES_SQL = """SELECT concat('file:/data/in.box/', CASE cast(page_id AS bigint) % 5 WHEN 0 THEN '_档案库/' WHEN 1 THEN 'a/_收件箱/' WHEN 2 THEN 'a/历史开票明细/' ELSE '' END, 'p', cast(page_id AS string),
  CASE cast(page_id AS bigint) % 3 WHEN 0 THEN '.xlsx' WHEN 1 THEN '.PNG' ELSE '.txt' END) AS path, html FROM pages"""


@query("file_inventory", f"""WITH f AS (SELECT replace(path, 'file:/data/in.box/', '') AS relative_path, html FROM ({FILES_SQL}) p)
SELECT relative_path, CASE WHEN relative_path LIKE '%.xlsx' THEN 'excel_history_or_candidate' WHEN relative_path LIKE '%.PNG' THEN 'image_material' ELSE 'other' END AS type, strlen(html) AS size_bytes, sha256(html) AS sha256,
  CASE WHEN relative_path LIKE '%/_收件箱/%' THEN '收件箱归档文件' WHEN relative_path LIKE '%/历史开票明细/%' THEN '客户历史开票明细' WHEN relative_path LIKE '%.PNG' THEN '图片/截图材料，默认需人工复核' ELSE '' END AS note
FROM f WHERE relative_path NOT LIKE '_档案库/%'""")
def _(spark, sf):
    table(spark, sf, "pages").createOrReplaceTempView("pages")
    files = spark.sql(FILES_SQL).select("path", F.octet_length("html").cast("bigint").alias("length"), F.col("html").cast("binary").alias("content"))
    return src.file_inventory(files, "/data/in.box")
