"""Queries over the linking jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching, profiles
from .q_profiles import DOMINANT_SQL
from .q_standard import AMOUNT_SQL, RATE_SQL
from .registry import query
from .views import table, view

# Invoices: one per order, the total its order total; the seller by the nation of the buyer.
INVOICES_SQL = """SELECT cast(o_orderkey AS string) AS invoice_no, concat('seller ', cast(c_nationkey AS string)) AS seller_name, c_name AS buyer_name, concat('ID', cast(c_custkey AS string)) AS buyer_tax_id,
  cast(cast(floor(o_totalprice / 50000) * 50000 AS int) AS decimal(18,2)) AS total_amount, o_orderstatus <> 'P' AS is_positive, substr(cast(o_orderdate AS string), 1, 19) AS issued_at FROM orders JOIN customer ON o_custkey = c_custkey"""


def _sql(spark, sf, text, *names):
    for n in names:
        (view(spark, sf, n) if n in ("dlines", "drafts", "hist") else table(spark, sf, n)).createOrReplaceTempView(n)
    return spark.sql(text)


@query("assemble_invoices", """SELECT cast(o_orderkey AS varchar) AS invoice_no, o_orderstatus <> 'P' AND o_totalprice >= 0 AS is_positive, CASE WHEN o_orderpriority LIKE '1%' THEN '增值税专用发票' ELSE '普通发票' END AS invoice_kind,
  cast(cast(o_totalprice AS decimal(18,2)) AS varchar) AS total_amount, coalesce(n, 0) AS line_count, p_name AS project_name, cast(cast(l_extendedprice AS decimal(18,2)) AS varchar) AS amount_with_tax
FROM orders LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey) l ON l_orderkey = o_orderkey""")
def _(spark, sf):
    headers = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("invoice_no"), F.col("o_totalprice").cast("decimal(18,2)").alias("total_amount"), F.when(F.col("o_orderstatus") == "P", "否").otherwise("是").alias("positive_flag"),
        F.when(F.col("o_orderpriority").startswith("1"), "数电发票（增值税专用发票）").otherwise("数电发票（普通发票）").alias("kind_text"))
    lines = view(spark, sf, "hist").select(F.col("serial").alias("invoice_no"), F.col("line_no").alias("pos"), "full_item_name", F.abs("amount_with_tax").alias("amount_with_tax"), "tax_rate")
    return matching.assemble_invoices(headers, lines).select("invoice_no", "is_positive", "invoice_kind", "total_amount", "line_count", "project_name", "amount_with_tax")


# Requests that state id and amount: each customer asks for as many invoices per amount as it has open line items of that kind.
REQUESTS_SQL = """SELECT concat('D', cast(o_custkey AS string), '-', o_orderpriority) AS doc_id, o_orderkey AS req_pos, concat('seller ', cast(c_nationkey AS string)) AS company_name, concat('ID', cast(c_custkey AS string)) AS buyer_tax_id,
  c_name AS buyer_name, cast(cast(floor(o_totalprice / 50000) * 50000 AS int) AS string) AS amount FROM orders JOIN customer ON o_custkey = c_custkey"""


@query("match_requests", f"""WITH r AS (SELECT *, cast(amount AS decimal(18,2)) AS a, row_number() OVER (PARTITION BY doc_id, buyer_tax_id, amount ORDER BY req_pos) AS n FROM ({REQUESTS_SQL}) q),
i AS (SELECT *, row_number() OVER (PARTITION BY buyer_tax_id, total_amount ORDER BY issued_at DESC, invoice_no) AS n FROM ({INVOICES_SQL}) q WHERE is_positive),
m AS (SELECT r.doc_id, r.req_pos, i.invoice_no FROM r LEFT JOIN i ON i.buyer_tax_id = r.buyer_tax_id AND i.total_amount = r.a AND i.n = r.n)
SELECT * FROM m WHERE doc_id NOT IN (SELECT doc_id FROM m WHERE invoice_no IS NULL)""")
def _(spark, sf):
    invoices = _sql(spark, sf, INVOICES_SQL, "orders", "customer")
    return matching.match_requests(spark.sql(REQUESTS_SQL), invoices)


REISSUE_SQL = """SELECT cast(o_orderkey AS string) AS request_id, concat('seller ', cast(c_nationkey AS string)) AS company_name, concat('dzfp_', lpad(cast(o_orderkey AS string), 20, '0'), ' 作废，',
  CASE o_orderstatus WHEN 'F' THEN concat('开这个数', cast(cast(floor(o_totalprice / 50000) * 50000 + 50000 AS int) AS string)) ELSE '金额分别为 50000 100000' END) AS text FROM orders JOIN customer ON o_custkey = c_custkey"""


@query("match_reissues", f"""WITH i AS (SELECT lpad(invoice_no, 20, '0') AS invoice_no, seller_name, buyer_name, total_amount, is_positive, issued_at FROM ({INVOICES_SQL}) q),
t AS (SELECT lpad(cast(o_orderkey AS varchar), 20, '0') AS original_no, cast(o_orderkey AS varchar) AS request_id, c_name AS buyer, unnest(CASE o_orderstatus WHEN 'F' THEN [cast(floor(o_totalprice / 50000) * 50000 + 50000 AS int)] ELSE [50000, 100000] END) AS amount,
  unnest(CASE o_orderstatus WHEN 'F' THEN [0] ELSE [0, 1] END) AS pos FROM orders JOIN customer ON o_custkey = c_custkey),
m AS (SELECT t.*, i.invoice_no, row_number() OVER (PARTITION BY request_id, pos ORDER BY issued_at DESC, i.invoice_no) AS rn FROM t LEFT JOIN i ON i.buyer_name = buyer AND total_amount = amount AND is_positive AND i.invoice_no <> original_no)
SELECT request_id, original_no, pos, cast(amount AS decimal(28,2)) AS amount, invoice_no, bool_and(invoice_no IS NOT NULL) OVER (PARTITION BY request_id) AS matched_all FROM m WHERE rn = 1""")
def _(spark, sf):
    invoices = _sql(spark, sf, INVOICES_SQL, "orders", "customer").withColumn("invoice_no", F.lpad("invoice_no", 20, "0"))
    return matching.match_reissues(matching.reissue_requests(spark.sql(REISSUE_SQL)), invoices)


# Requests for the sums of the lines up to 2 and of the rest, which cut the original, or for one round sum, which another invoice may have.
AMT = "cast(l_extendedprice AS decimal(18,2))"
PIECES_SQL = f"""SELECT o_orderkey, cast(o_orderkey AS string) AS request_id, lpad(cast(o_orderkey AS string), 20, '0') AS original_no, concat('seller ', cast(c_nationkey AS string)) AS company_name, c_name AS buyer, o_orderstatus,
  cast(floor(o_totalprice / 50000) * 50000 + 50000 AS int) AS one, a, b FROM orders JOIN customer ON o_custkey = c_custkey
  LEFT JOIN (SELECT l_orderkey, sum(CASE WHEN l_linenumber <= 2 THEN {AMT} END) AS a, sum(CASE WHEN l_linenumber > 2 THEN {AMT} END) AS b FROM lineitem GROUP BY l_orderkey) s ON l_orderkey = o_orderkey"""
PIECE_LINES = f"SELECT lpad(cast(l_orderkey AS string), 20, '0') AS invoice_no, cast(l_linenumber AS bigint) * 1000000000000000 + cast(l_partkey AS bigint) * 1000000 + cast(l_suppkey AS bigint) AS line_no, {AMT} AS amount FROM lineitem"


@query("reissue_lines", f"""WITH i AS (SELECT lpad(invoice_no, 20, '0') AS invoice_no, seller_name, buyer_name, total_amount, is_positive, issued_at FROM ({INVOICES_SQL}) q), l AS ({PIECE_LINES}),
p AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN [cast(one AS decimal(18,2))] ELSE list_filter([cast(a AS decimal(18,2)), cast(b AS decimal(18,2))], lambda x: x IS NOT NULL) END AS amounts FROM ({PIECES_SQL}) q),
t AS (SELECT request_id, original_no, buyer, len(amounts) AS many, unnest(amounts) AS amount, generate_subscripts(amounts, 1) - 1 AS pos FROM p),
m AS (SELECT t.*, i.invoice_no, row_number() OVER (PARTITION BY request_id, pos ORDER BY issued_at DESC, i.invoice_no) AS rn FROM t LEFT JOIN i ON i.buyer_name = buyer AND total_amount = amount AND is_positive AND i.invoice_no <> original_no),
f AS (SELECT *, bool_and(invoice_no IS NOT NULL) OVER (PARTITION BY request_id) AS matched_all FROM m WHERE rn = 1),
c AS (SELECT invoice_no, count(*) AS n FROM l GROUP BY invoice_no)
SELECT request_id, pos AS group_no, f.invoice_no AS source_no, line_no, l.amount FROM f JOIN l ON l.invoice_no = f.invoice_no WHERE matched_all
UNION ALL SELECT request_id, CASE WHEN many = 2 AND line_no >= 3000000000000000 THEN 1 ELSE 0 END, original_no, line_no, CASE WHEN many = 1 AND n = 1 THEN f.amount ELSE l.amount END
FROM f JOIN l ON l.invoice_no = original_no JOIN c ON c.invoice_no = original_no WHERE NOT matched_all AND pos = 0""")
def _(spark, sf):
    invoices = _sql(spark, sf, INVOICES_SQL, "orders", "customer", "lineitem").withColumn("invoice_no", F.lpad("invoice_no", 20, "0"))
    asked = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("开这个数"), F.col("one").cast("string"))).otherwise(F.concat_ws(" ", F.lit("金额分别为"), F.col("a").cast("string"), F.col("b").cast("string")))
    texts = spark.sql(PIECES_SQL).select("request_id", "company_name", F.concat(F.lit("dzfp_"), "original_no", F.lit(" 作废，"), asked).alias("text"))
    return matching.reissue_lines(matching.reissue_requests(texts), invoices, spark.sql(PIECE_LINES), size=10**15)


# Targets are the sums of the lines numbered up to 2, of 3 to 4, and of the rest: exact cuts.
SPLIT_LINES = "SELECT cast(l_orderkey AS string) AS invoice_no, cast(l_linenumber AS bigint) * 1000000000000000 + cast(l_partkey AS bigint) * 1000000 + cast(l_suppkey AS bigint) AS line_no, cast(l_extendedprice AS decimal(18,2)) AS amount, CASE WHEN l_linenumber <= 2 THEN 0 WHEN l_linenumber <= 4 THEN 1 ELSE 2 END AS part FROM lineitem"


@query("split_by_targets", f"""WITH l AS ({SPLIT_LINES}), p AS (SELECT DISTINCT invoice_no, part FROM l), d AS (SELECT invoice_no, part, row_number() OVER (PARTITION BY invoice_no ORDER BY part) - 1 AS group_no FROM p)
SELECT l.invoice_no, line_no, group_no FROM l JOIN d ON d.invoice_no = l.invoice_no AND d.part = l.part""")
def _(spark, sf):
    lines = _sql(spark, sf, SPLIT_LINES, "lineitem")
    sums = lines.groupBy("invoice_no", "part").agg(F.sum("amount").alias("target"))
    before = F.size(F.filter("parts", lambda p: p < F.col("part")))
    targets = sums.join(sums.groupBy("invoice_no").agg(F.collect_set("part").alias("parts")), "invoice_no").select("invoice_no", before.alias("target_pos"), "target")
    return matching.split_by_targets(lines.drop("part"), targets, size=10**15).select("invoice_no", "line_no", "group_no")


VEHICLE_SQL = """SELECT concat('S', cast(l_suppkey AS string)) AS sheet, cast(l_orderkey AS bigint) * 8000000 + cast(l_linenumber AS bigint) * 1000000 + cast(l_partkey AS bigint) AS row, CASE WHEN l_returnflag = 'A' THEN concat('buyer ', cast(l_orderkey AS string)) ELSE '' END AS buyer,
  CASE WHEN l_linestatus = 'F' THEN concat('M', cast(l_partkey AS string), ' 车架号 V', cast(l_orderkey AS string), ' 价格 ', cast(cast(l_extendedprice AS decimal(18,2)) AS string)) ELSE '无' END AS info FROM lineitem"""


@query("fill_vehicle_rows", f"""SELECT sheet, row, concat('电动两轮摩托车 ', split_part(info, ' ', 1)) AS project_name, split_part(info, ' ', 5) AS amount_with_tax, concat('车架号 ', split_part(info, ' ', 3)) AS specification, coalesce(b, '') AS buyer_name
FROM (SELECT *, last_value(nullif(buyer, '') IGNORE NULLS) OVER (PARTITION BY sheet ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b FROM ({VEHICLE_SQL}) v) q WHERE info <> '无'""")
def _(spark, sf):
    return matching.fill_vehicle_rows(_sql(spark, sf, VEHICLE_SQL, "lineitem"), size=8000000 * 2000).select("sheet", "row", "project_name", "amount_with_tax", "specification", "buyer_name")


@query("dedupe_lines", f"""SELECT min(line_no) AS line_no, project_name, specification, quantity, unit_price FROM dlines GROUP BY project_name, specification, quantity, unit_price, coalesce(cast({AMOUNT_SQL} AS varchar), amount_with_tax)""")
def _(spark, sf):
    return matching.dedupe_lines(view(spark, sf, "dlines"), [], ["line_no"]).select("line_no", "project_name", "specification", "quantity", "unit_price")


MERGE = {"p": "lines_before", "s": "lines_after"}


def _sides(spark, sf):
    p = view(spark, sf, "lines_before").withColumn("tax_rate", F.when(F.col("tax_rate") == "6", "").otherwise(F.col("tax_rate")))
    p = p.withColumn("project_name", F.when(F.col("tax_category") == "LARGE", "").otherwise(F.col("project_name")))
    s = view(spark, sf, "lines_after").withColumn("unit_price", F.lit("9"))
    return p, s


P_SQL = "SELECT * REPLACE (CASE WHEN tax_rate = '6' THEN '' ELSE tax_rate END AS tax_rate, CASE WHEN tax_category = 'LARGE' THEN '' ELSE project_name END AS project_name) FROM lines_before"
PICK = lambda c, d="''": f"CASE WHEN rep THEN coalesce(s.{c}, '') WHEN alone THEN p.{c} WHEN coalesce(p.{c}, {d}) <> '' THEN coalesce(p.{c}, {d}) WHEN coalesce(s.{c}, '') <> '' THEN s.{c} ELSE {d} END AS {c}"


@query("merge_lines", f"""WITH p AS ({P_SQL}), s AS (SELECT * REPLACE ('9' AS unit_price) FROM lines_after),
fp AS (SELECT draft_id, count(*) AS pn, count(CASE WHEN project_name <> '' THEN 1 END) AS names, count({AMOUNT_SQL}) AS amounts FROM p GROUP BY draft_id), fs AS (SELECT draft_id, count(*) AS sn FROM s GROUP BY draft_id),
f AS (SELECT coalesce(fp.draft_id, fs.draft_id) AS draft_id, coalesce(pn IS NULL OR ((names = 0 OR amounts = 0) AND sn >= pn), false) AS rep, sn IS NULL AS alone FROM fp FULL JOIN fs ON fp.draft_id = fs.draft_id),
m AS (SELECT f.draft_id, coalesce(p.line_no, s.line_no) AS line_no, rep, alone, {PICK('project_name')}, {PICK('tax_rate', "'3%'").replace("coalesce(p.tax_rate, '3%')", "CASE WHEN p.line_no IS NULL THEN '3%' ELSE p.tax_rate END")}, {PICK('amount_with_tax')}, {PICK('unit_price')}, {PICK('tax_code')}
  FROM p FULL JOIN s ON p.draft_id = s.draft_id AND p.line_no = s.line_no JOIN f ON f.draft_id = coalesce(p.draft_id, s.draft_id) WHERE NOT rep OR s.line_no IS NOT NULL)
SELECT draft_id, line_no, project_name, tax_rate, unit_price, tax_code FROM m WHERE rep OR alone OR project_name <> '' OR amount_with_tax <> ''""")
def _(spark, sf):
    p, s = _sides(spark, sf)
    return matching.merge_lines(p, s, ("draft_id", "line_no")).select("draft_id", "line_no", "project_name", "tax_rate", "unit_price", "tax_code")


@query("merge_buyers", "SELECT draft_id, CASE WHEN buyer_name = '' THEN 'other' ELSE buyer_name END AS buyer_name, CASE WHEN buyer_tax_id = '' THEN case_id ELSE buyer_tax_id END AS buyer_tax_id, buyer_address FROM drafts")
def _(spark, sf):
    d = view(spark, sf, "drafts")
    other = d.withColumns({"buyer_name": F.lit("other"), "buyer_tax_id": F.col("case_id"), "buyer_address": F.lit("")})
    return matching.merge_buyers(d, other, "draft_id").select("draft_id", "buyer_name", "buyer_tax_id", "buyer_address")


NOTE = lambda label, a, b: f"CASE WHEN {a} <> '' AND {b} <> '' AND upper(replace({a}, ' ', '')) <> upper(replace({b}, ' ', '')) THEN concat('识别差异需确认：', {label}, '，规则识别为“', {a}, '”，智能识别为“', {b}, '”。') END"
LINE_LABEL = "concat('第 ', p.line_no, ' 行{}')".format
_R = lambda x: RATE_SQL.replace("tax_rate", f"{x}.tax_rate")


@query("extraction_conflicts", f"""WITH p AS ({P_SQL}), s AS (SELECT * FROM lines_after),
n AS (SELECT p.draft_id, p.line_no AS p, unnest([0, 2, 3]) AS i, unnest([{NOTE(LINE_LABEL('项目名称'), 'p.project_name', 's.project_name')}, {NOTE(LINE_LABEL('税率'), _R('p'), _R('s'))}, {NOTE(LINE_LABEL('税收编码'), 'p.tax_code', 's.tax_code')}]) AS text
  FROM p JOIN s ON p.draft_id = s.draft_id AND p.line_no = s.line_no
  UNION ALL SELECT d.draft_id, -2, 0, {NOTE("'购买方名称'", 'buyer_name', "'other'")} FROM drafts d
  UNION ALL SELECT a.draft_id, -1, 0, CASE WHEN a.n <> b.n THEN concat('识别差异需确认：规则识别出 ', a.n, ' 行明细，智能识别为 ', b.n, ' 行。') END FROM (SELECT draft_id, count(*) AS n FROM p GROUP BY draft_id) a JOIN (SELECT draft_id, count(*) AS n FROM s GROUP BY draft_id) b ON a.draft_id = b.draft_id)
SELECT draft_id, p, text FROM (SELECT *, row_number() OVER (PARTITION BY draft_id ORDER BY p, i) AS rn FROM n WHERE text IS NOT NULL) r WHERE rn <= 12""")
def _(spark, sf):
    p, _s = _sides(spark, sf)
    d = view(spark, sf, "drafts")
    return matching.extraction_conflicts(d, p, d.withColumn("buyer_name", F.lit("other")), view(spark, sf, "lines_after"), ("draft_id", "line_no"))


SOURCE_FILES = "SELECT concat('B', cast(o_custkey AS string)) AS batch_id, o_orderkey AS pos, CASE o_orderstatus WHEN 'F' THEN concat('img', cast(o_orderkey AS string), '.jpg') ELSE concat('pic_', cast(o_orderkey AS string), '.png') END AS original_name, '' AS stored_name FROM orders"
SOURCE_REQS = "SELECT concat('B', cast(o_custkey AS string)) AS batch_id, o_orderkey AS pos, CASE o_orderpriority WHEN '1-URGENT' THEN concat('IMG', cast(o_orderkey AS string), '.JPG') WHEN '2-HIGH' THEN concat('x/scan-00', cast(o_orderkey AS string), '.webp') ELSE 'none.jpg' END AS source_name FROM orders"


@query("match_sources", """SELECT concat('B', o_custkey) AS batch_id, o_orderkey AS file_pos, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderkey END AS req_pos FROM orders""")
def _(spark, sf):
    files = _sql(spark, sf, SOURCE_FILES, "orders")
    return matching.match_sources(files, spark.sql(SOURCE_REQS))


@query("match_subjects", """WITH a AS (SELECT s_name AS a, concat(s_name, '/91310000MA1FL0000X') AS subject FROM supplier), k AS (SELECT c_name, regexp_replace(upper(replace(c_name, 'Customer', 'Supplier')), '[^\\p{L}\\p{N}]', '', 'g') AS kb FROM customer)
SELECT subject, c_name AS buyer FROM a JOIN k ON contains(regexp_replace(upper(a), '[^\\p{L}\\p{N}]', '', 'g'), kb) OR contains(kb, regexp_replace(upper(a), '[^\\p{L}\\p{N}]', '', 'g'))""")
def _(spark, sf):
    a = table(spark, sf, "supplier").select(F.concat("s_name", F.lit("/91310000MA1FL0000X")).alias("subject"))
    b = table(spark, sf, "customer").select(F.col("c_name").alias("buyer"), F.regexp_replace("c_name", "Customer", "Supplier").alias("name"))
    return matching.match_subjects(a, b, "subject", "name").join(b.hint("merge"), "name").select("subject", "buyer")


@query("find_parent_batch", "SELECT draft_id, arg_max(batch_id, (modified, batch_id)) AS batch_id FROM (SELECT concat('P', l_partkey) AS draft_id, concat('S', l_suppkey) AS batch_id, l_shipdate AS modified FROM lineitem) i GROUP BY draft_id")
def _(spark, sf):
    items = table(spark, sf, "lineitem").select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("draft_id"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("batch_id"), F.col("l_shipdate").alias("modified"))
    return matching.find_parent_batch(table(spark, sf, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("draft_id")), items)


ASK_SQL = """SELECT cast(o_orderkey AS string) AS request_id, s_name AS seller_name, CASE WHEN o_orderstatus = 'F' THEN '' ELSE cast(cast(o_totalprice AS decimal(18,2)) AS string) END AS amount_with_tax, CASE WHEN o_orderpriority = '1-URGENT' THEN 'asked item' ELSE '' END AS project_name,
  '' AS tax_rate, '' AS tax_category, '' AS tax_code, '' AS specification, '' AS unit, '' AS quantity, concat(cast(o_orderkey AS string), '.png') AS source_name, CASE WHEN o_orderstatus = 'O' THEN cast(o_orderkey AS string) ELSE '' END AS order_no, '' AS email
FROM (SELECT *, o_custkey % (SELECT count(*) FROM supplier) + (SELECT min(s_suppkey) FROM supplier) AS sk FROM orders) o JOIN (SELECT s_suppkey, s_name FROM supplier) s ON s_suppkey = sk"""


@query("requests_to_lines", f"""WITH d AS ({DOMINANT_SQL}), r AS ({ASK_SQL}) SELECT request_id, CASE WHEN r.project_name <> '' THEN r.project_name ELSE coalesce(d.project_name, '') END AS project_name, amount_with_tax, coalesce(d.tax_rate, '') AS tax_rate, coalesce(d.tax_code, '') AS tax_code,
  coalesce(d.unit, '项') AS unit, r.project_name <> '' OR amount_with_tax <> '' AS to_be_coded, concat('n；来源图片：', source_name, CASE WHEN order_no <> '' THEN concat('；订单号：', order_no) ELSE '' END) AS note FROM r LEFT JOIN d ON d.seller_name = r.seller_name""")
def _(spark, sf):
    asks = _sql(spark, sf, ASK_SQL, "orders", "supplier")
    return matching.requests_to_lines(asks, profiles.dominant_line(view(spark, sf, "hist")), "n").select("request_id", "project_name", "amount_with_tax", "tax_rate", "tax_code", "unit", "to_be_coded", "note")


BUNDLE_SQL = """SELECT concat('B', cast(l_orderkey AS string)) AS bundle, concat(cast(l_partkey AS string), CASE l_returnflag WHEN 'A' THEN '.png' ELSE '.xlsx' END) AS file_name, cast(l_linenumber AS bigint) * 1000000 + l_partkey AS pos, CASE l_returnflag WHEN 'A' THEN '.png' ELSE '.xlsx' END AS suffix,
  CASE WHEN l_returnflag = 'R' THEN concat('seller ', cast(l_suppkey AS string)) ELSE '' END AS seller_name, l_discount >= 0.1 AS known FROM lineitem"""


@query("bundle_sellers", f"""WITH f AS ({BUNDLE_SQL}), v AS (SELECT bundle, seller_name, count(*) AS n, min(pos) AS p FROM f WHERE seller_name <> '' GROUP BY ALL), s AS (SELECT bundle, arg_min(seller_name, (-n, p)) AS bundle_seller FROM v GROUP BY bundle)
SELECT f.bundle, file_name, pos, coalesce(bundle_seller, '') AS bundle_seller, CASE WHEN known THEN 'duplicate' WHEN bundle_seller IS NULL THEN 'pending_review' WHEN seller_name <> '' THEN 'imported' ELSE 'candidate_only' END AS status FROM f LEFT JOIN s ON s.bundle = f.bundle""")
def _(spark, sf):
    return matching.bundle_sellers(_sql(spark, sf, BUNDLE_SQL, "lineitem")).select("bundle", "file_name", "pos", "bundle_seller", "status")


@query("bundle_counters", f"""WITH f AS ({BUNDLE_SQL}), b AS (SELECT bundle, bool_or(seller_name <> '') AS has FROM f GROUP BY bundle) SELECT (SELECT count(*) FROM b) AS bundles_seen, (SELECT count(*) FROM b WHERE has) AS bundles_with_seller,
  (SELECT count(*) FROM b WHERE NOT has) AS bundles_without_seller, count(*) AS seen, count(CASE WHEN NOT known AND seller_name <> '' THEN 1 END) AS history_excel_imported, count(CASE WHEN NOT known AND has AND seller_name = '' THEN 1 END) AS bundle_material_archived,
  count(CASE WHEN known THEN 1 END) AS duplicate, count(CASE WHEN NOT known AND NOT has THEN 1 END) AS to_review FROM f JOIN b ON b.bundle = f.bundle""")
def _(spark, sf):
    return matching.bundle_counters(matching.bundle_sellers(_sql(spark, sf, BUNDLE_SQL, "lineitem")))
