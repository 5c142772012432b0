"""Queries over the history hints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import filters, history, profiles
from .registry import query
from .views import table, view

BUYER_TEXTS = """SELECT cast(o_orderkey AS string) AS text_id, concat('please invoice ', CASE o_orderstatus WHEN 'F' THEN c_name WHEN 'O' THEN concat('for ', right(c_name, 4)) ELSE '' END, ' soon') AS text, 'all' AS scope
FROM orders JOIN customer ON o_custkey = c_custkey"""


@query("resolve_buyers", f"""WITH t AS ({BUYER_TEXTS}), a AS (SELECT c_name, concat('ID', c_custkey) AS id, unnest([c_name, substr(c_name, 1, 4), right(c_name, 4), right(c_name, 3), right(c_name, 2)]) AS alias, c_custkey AS pos FROM customer),
f AS (SELECT upper(alias) AS ak, arg_min(c_name, (pos, alias)) AS c_name, arg_min(id, (pos, alias)) AS id, min(pos) AS pos FROM a GROUP BY upper(alias)),
h AS (SELECT text_id, c_name, id, pos, length(ak) + CASE WHEN contains(text, c_name) THEN 20 ELSE 0 END AS score FROM (SELECT DISTINCT text_id, text, upper(replace(text, ' ', '')) AS x FROM t) t JOIN f ON contains(x, ak)
  UNION ALL SELECT text_id, c_name, concat('ID', c_custkey), c_custkey, length(c_name) + 20 FROM t JOIN customer ON text = concat('please invoice ', c_name, ' soon'))
SELECT text_id, c_name AS buyer_name, id AS buyer_tax_id, CASE WHEN score >= 6 THEN 'high' ELSE 'medium' END AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY score DESC, pos) AS rn FROM h) r WHERE rn = 1""")
def _(spark, sf):
    for t in ("orders", "customer"):
        table(spark, sf, t).createOrReplaceTempView(t)
    buyers = table(spark, sf, "customer").select(
        F.lit("all").alias("scope"), F.col("c_name").alias("buyer_name"), F.concat(F.lit("ID"), F.col("c_custkey").cast("string")).alias("buyer_tax_id"), F.col("c_custkey").alias("pos"))
    return history.resolve_buyers(spark.sql(BUYER_TEXTS), buyers).select("text_id", "buyer_name", "buyer_tax_id", "confidence")


@query("fill_buyers", """SELECT draft_id, CASE WHEN buyer_name = '' OR bad THEN c_name ELSE buyer_name END AS buyer_name, CASE WHEN buyer_tax_id = '' OR bad THEN real_id ELSE buyer_tax_id END AS buyer_tax_id FROM (
  SELECT d.*, c_name, concat('92', lpad(cast(c_custkey AS varchar), 16, '0')) AS real_id, length(buyer_tax_id) <> 18 OR len(list_distinct(string_split(buyer_tax_id, ''))) <= 4 AS bad
  FROM drafts d JOIN customer ON case_id = concat('C', c_custkey)) q""")
def _(spark, sf):
    drafts = view(spark, sf, "drafts").withColumn("text_id", F.col("draft_id"))
    buyers = table(spark, sf, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("case_id"), F.col("c_name"), F.concat(F.lit("92"), F.lpad(F.col("c_custkey").cast("string"), 16, "0")).alias("real_id"))
    matches = drafts.select("text_id", "case_id").join(buyers, "case_id").select("text_id", F.col("c_name").alias("matched_alias"), F.col("c_name").alias("buyer_name"), F.col("real_id").alias("buyer_tax_id"))
    return history.fill_buyers(drafts, matches).select("draft_id", "buyer_name", "buyer_tax_id")


def _profiles(spark, sf):
    rows = filters.trusted_history(view(spark, sf, "hist"))
    return profiles.project_profiles(rows), profiles.buyer_profiles(rows)


REQUESTS_SQL = """SELECT concat(s_name, '#', cast(s_nationkey AS string)) AS scope, s_name AS seller, CASE WHEN s_nationkey > 15 THEN 'nobody' ELSE '' END AS buyer_name, '' AS buyer_tax_id FROM supplier"""


@query("profile_rows", f"""WITH q AS ({REQUESTS_SQL}), p AS (SELECT DISTINCT seller_name, full_item_name, tax_category, project_name, tax_code, tax_rate, CASE WHEN unit = '' THEN '项' ELSE unit END AS unit FROM trusted),
b AS (SELECT DISTINCT seller_name, buyer_name, buyer_tax_id FROM trusted), n AS (SELECT seller_name, count(*) AS n FROM b GROUP BY ALL)
SELECT scope, 0 AS part, count(*) AS n_rows, sum(CASE WHEN q.buyer_name = '' THEN n ELSE 1 END) AS copies FROM q JOIN p ON p.seller_name = seller JOIN n ON n.seller_name = seller GROUP BY scope
UNION ALL SELECT scope, 1, count(*), count(*) FROM q JOIN b ON b.seller_name = seller WHERE q.buyer_name = '' GROUP BY scope
UNION ALL SELECT scope, 2, count(DISTINCT (h.buyer_name, h.buyer_tax_id, project_name, tax_category, tax_code, tax_rate, unit, specification, quantity)), count(*) FROM q JOIN hist h ON h.seller_name = seller WHERE q.buyer_name = '' GROUP BY scope""")
def _(spark, sf):
    table(spark, sf, "supplier").createOrReplaceTempView("supplier")
    ledger = view(spark, sf, "hist").withColumn("company_name", F.col("seller_name")).withColumn("quantity", F.col("quantity").cast("string"))
    rows = history.profile_rows(spark.sql(REQUESTS_SQL), *_profiles(spark, sf), ledger)
    return rows.groupBy("scope", "part").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("copies").alias("copies"))


# History of the sellers, one row per line, in line order.
def _rows(spark, sf, merged=()):
    hist = view(spark, sf, "trusted", merged)
    return hist.select(F.col("seller_name").alias("scope"), "project_name", "tax_category", "tax_code", "tax_rate", "unit", "specification", F.lit("2").alias("quantity"),
                       F.lit(1).cast("bigint").alias("line_count"), F.lit(1).cast("bigint").alias("copies"), F.col("line_key").alias("pos"))


EXACT_SQL = """v AS (SELECT seller_name AS scope, upper(replace(project_name, ' ', '')) AS key, project_name, tax_category, tax_code, unit, specification, count(*) AS w, min(line_key) AS p FROM trusted GROUP BY ALL),
tv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope, key ORDER BY w DESC, p) AS rn FROM v) x WHERE rn = 1),
rv AS (SELECT tv.scope, tv.key, t.tax_rate, count(*) AS w, min(line_key) AS p FROM tv JOIN trusted t ON t.seller_name = tv.scope AND t.project_name = tv.project_name AND t.tax_category = tv.tax_category AND t.tax_code = tv.tax_code
  AND t.unit = tv.unit AND t.specification = tv.specification GROUP BY ALL),
rr AS (SELECT *, row_number() OVER (PARTITION BY scope, key ORDER BY w DESC, p) AS rn FROM rv),
rt AS (SELECT scope, key, max(CASE WHEN rn = 1 THEN tax_rate END) AS tax_rate, count(*) AS n_rates, string_agg(tax_rate, '；' ORDER BY rn) FILTER (rn <= 4) AS samples FROM rr GROUP BY ALL),
cs AS (SELECT scope, key, count(*) AS n_codes, string_agg(c, '；' ORDER BY c) FILTER (rn <= 4) AS codes FROM (SELECT *, row_number() OVER (PARTITION BY scope, key ORDER BY c) AS rn FROM (
  SELECT DISTINCT scope, key, concat(tax_category, ' / ', tax_code) AS c FROM v) d) e GROUP BY ALL),
ex AS (SELECT tv.scope, tv.key, project_name, tax_category, tax_code, rt.tax_rate, specification, CASE WHEN unit = '' THEN '项' ELSE unit END AS unit, w,
  CASE WHEN w >= 2 AND n_codes = 1 THEN 'high' ELSE 'medium' END AS confidence,
  CASE WHEN n_rates > 1 THEN concat('客户本次未写税率，按历史最高频 ', rt.tax_rate, ' 推荐；历史税率还出现过 ', samples) END AS rate_note,
  CASE WHEN n_codes > 1 THEN concat('历史同项目还出现过 ', codes, '，本次按最高频品类推荐') END AS code_note
  FROM tv JOIN rt ON rt.scope = tv.scope AND rt.key = tv.key JOIN cs ON cs.scope = tv.scope AND cs.key = tv.key)"""


@query("exact_history", f"WITH {EXACT_SQL} SELECT scope, key, project_name, tax_category, tax_code, tax_rate, specification, unit, confidence, rate_note, code_note FROM ex")
def _(spark, sf):
    return history.exact_history(_rows(spark, sf)).drop("quantity", "weight")


# Item names as buyers ask for them: known ones, a part of them, a longer form, a weak one.
ASK_SQL = """SELECT DISTINCT s_name AS scope, CASE l_linenumber WHEN 1 THEN p_name WHEN 2 THEN split_part(p_name, ' ', 2) WHEN 3 THEN concat('best ', p_name) WHEN 4 THEN concat(p_type, ' 服务') ELSE '服务费' END AS name, '' AS text_id
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey"""
FUZZY_SQL = """rk AS (SELECT *, least(row_number() OVER (PARTITION BY seller_name ORDER BY line_key) - 1, 20) AS rank FROM trusted),
it AS (SELECT seller_name AS scope, project_name AS item, upper(replace(project_name, ' ', '')) AS p, count(*) AS freq, arg_min(tax_code, (-(rank // 5), line_key)) AS tax_code, arg_min(tax_rate, (-(rank // 5), line_key)) AS tax_rate,
    min((-(rank // 5), line_key)) AS o, max(rank // 5) AS idx FROM rk GROUP BY ALL),
asks AS (SELECT DISTINCT scope, upper(replace(name, ' ', '')) AS key FROM ask),
sc AS (SELECT a.scope, a.key, it.item, it.tax_code, it.tax_rate, CASE WHEN key = p THEN 120 WHEN contains(p, key) THEN 90 WHEN contains(key, p) THEN 75 ELSE 0 END + CASE WHEN key = '服务费' THEN 15 ELSE 0 END + 18 + least(freq, 8) + idx AS score, o
  FROM asks a JOIN it ON it.scope = a.scope),
fz AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope, key ORDER BY score DESC, o[2]) AS rn FROM sc WHERE score >= 36) x WHERE rn = 1)"""


@query("fuzzy_history", f"WITH ask AS ({ASK_SQL}), {FUZZY_SQL.replace('o[2]', 'struct_extract_at(o, 2)')} SELECT scope, key, item AS project_name, tax_code, tax_rate, score FROM fz")
def _(spark, sf):
    for t in ("supplier", "part", "lineitem"):
        table(spark, sf, t).createOrReplaceTempView(t)
    rows = history.ranked_rows(_rows(spark, sf), ["pos"])
    asks = spark.sql(ASK_SQL).select("scope", T.compact_key("name").alias("key"), "text_id")
    return history.fuzzy_history(asks, rows).select("scope", "key", "project_name", "tax_code", "tax_rate", "score")


HINT_LINES = """SELECT draft_id, line_no, s_name AS scope, '' AS text_id, project_name, tax_rate, tax_category, specification, unit, quantity, tax_code, coding_reference FROM dlines JOIN supplier ON s_suppkey = line_no % 1000000"""


@query("apply_history", f"""WITH {EXACT_SQL}, l AS ({HINT_LINES}), ask AS (SELECT scope, project_name AS name FROM l), {FUZZY_SQL.replace('o[2]', 'struct_extract_at(o, 2)')},
j AS (SELECT l.*, ex.project_name IS NOT NULL AS exact, ex.project_name AS e_name, ex.tax_code AS e_code, ex.tax_rate AS e_rate, concat_ws('；', rate_note, code_note) AS notes, fz.item AS f_name, fz.tax_code AS f_code, fz.tax_rate AS f_rate
  FROM l LEFT JOIN ex ON ex.scope = l.scope AND ex.key = upper(replace(l.project_name, ' ', '')) AND l.project_name <> '' LEFT JOIN fz ON fz.scope = l.scope AND fz.key = upper(replace(l.project_name, ' ', '')) AND ex.project_name IS NULL)
SELECT draft_id, line_no, CASE WHEN exact AND tax_code = '' THEN e_name WHEN NOT exact AND project_name = '服务费' AND f_name IS NOT NULL THEN f_name ELSE project_name END AS project_name,
  CASE WHEN tax_code <> '' THEN tax_code WHEN exact THEN e_code WHEN project_name <> '' THEN coalesce(f_code, '') ELSE '' END AS tax_code,
  CASE WHEN tax_rate = '' AND exact AND (tax_code = '' OR tax_code = e_code) THEN e_rate WHEN tax_rate = '' AND NOT exact AND project_name <> '' THEN coalesce(f_rate, '') ELSE tax_rate END AS tax_rate FROM j""")
def _(spark, sf):
    table(spark, sf, "supplier").createOrReplaceTempView("supplier")
    # The job holds several of these tables at once, so none that is large is sent.
    large = ("customer", "part", "orders")
    view(spark, sf, "dlines", large).createOrReplaceTempView("dlines")
    rows = history.ranked_rows(_rows(spark, sf, large), ["pos"])
    return history.apply_history(spark.sql(HINT_LINES), rows).select("draft_id", "line_no", "project_name", "tax_code", "tax_rate")
