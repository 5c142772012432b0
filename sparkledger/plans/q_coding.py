"""Queries over the category tree and the coding jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coding, taxonomy
from .q_standard import KEY_SQL, RATE_SQL
from .registry import query
from .views import table, view

K = KEY_SQL.format

CONTEXT_SQL = """SELECT concat('D', cast(l_orderkey AS string)) AS context_id, concat('need ', max(p_name), ' at 税率：3%') AS context_text
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey"""


def _contexts(spark, sf):
    for t in ("lineitem", "part"):
        table(spark, sf, t).createOrReplaceTempView(t)
    return spark.sql(CONTEXT_SQL)


HIERARCHY_SQL = """pref AS (SELECT official_code AS code, official_name AS name, rtrim(official_code, '0') AS prefix FROM tax),
loose AS (SELECT DISTINCT p.code FROM pref p JOIN pref c ON c.code <> p.code AND starts_with(c.code, p.prefix) AND p.prefix <> ''),
pairs AS (SELECT p.code AS parent, p.name AS parent_name, c.code AS child, c.name AS child_name FROM pref p
  JOIN pref c ON c.code <> p.code AND starts_with(c.code, p.prefix) AND p.prefix <> '' AND p.prefix <> p.code),
flagged AS (SELECT *, child_name LIKE '其他%' OR contains(child_name, concat('其他', parent_name)) AS other,
  child NOT IN (SELECT parent FROM pairs) AS leaf FROM pairs),
leafs AS (SELECT parent, count(*) AS children, coalesce(CASE WHEN bool_or(other) THEN min(CASE WHEN other AND leaf THEN child END)
  ELSE min(CASE WHEN leaf THEN child END) END, min(child)) AS leaf_code FROM flagged GROUP BY parent),
tree AS (SELECT pref.code AS official_code, name AS official_name, loose.code IS NOT NULL AS is_summary, coalesce(children, 0) AS children,
  coalesce(leaf_code, pref.code) AS leaf_code FROM pref LEFT JOIN loose ON loose.code = pref.code LEFT JOIN leafs ON parent = pref.code)"""


@query("code_hierarchy", f"WITH {HIERARCHY_SQL} SELECT * FROM tree")
def _(spark, sf):
    return taxonomy.code_hierarchy(view(spark, sf, "tax"))


RULE_SQL = f"""a AS (SELECT *, {K('alias')} AS ak FROM rule_aliases),
n AS (SELECT DISTINCT project_name, {K('project_name')} AS nk FROM src),
h AS (SELECT project_name, a.*, CASE WHEN nk = ak THEN 100 WHEN contains(nk, ak) THEN 90 ELSE 88 END AS score FROM n JOIN a
  ON nk <> '' AND (contains(nk, ak) OR (contains(ak, nk) AND project_name <> '服务费'))),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_name ORDER BY score DESC, tier, entry_id, alias_pos) AS rn FROM h) x WHERE rn = 1)"""
CONTEXT_BEST_SQL = f"""ctx AS (SELECT context_id, context_text, {K('context_text')} AS ck FROM ({CONTEXT_SQL}) z),
cbest AS (SELECT * FROM (SELECT context_id, a.*, row_number() OVER (PARTITION BY context_id ORDER BY tier, entry_id, alias_pos) AS rn
  FROM ctx JOIN a ON contains(ck, ak)) x WHERE rn = 1)"""


@query("match_rules", f"""WITH src AS (SELECT * FROM dlines), {RULE_SQL}, {CONTEXT_BEST_SQL}
SELECT draft_id, line_no, coalesce(b.entry_id, c.entry_id) AS entry_id, coalesce(b.alias, c.alias) AS matched_alias, coalesce(b.score, 55) AS score
FROM src LEFT JOIN best b ON src.project_name = b.project_name
LEFT JOIN cbest c ON c.context_id = src.draft_id AND b.entry_id IS NULL AND (src.project_name IN ('', '服务费'))
WHERE coalesce(b.entry_id, c.entry_id) IS NOT NULL""")
def _(spark, sf):
    lines = view(spark, sf, "dlines").select("draft_id", "line_no", "project_name", F.col("draft_id").alias("context_id"))
    out = coding.match_rules(lines, view(spark, sf, "rules"), _contexts(spark, sf))
    return out.filter(F.col("rule").isNotNull()).select("draft_id", "line_no", "rule.entry_id", "rule.matched_alias", "rule.score")


SUGGEST_SQL = f"""e AS (SELECT *, {K('official_name')} AS ok, {K('category_short_name')} AS sk FROM tax),
sq AS (SELECT DISTINCT {K('name')} AS q FROM names WHERE {K('name')} <> ''),
sg AS (SELECT q, unnest(CASE WHEN length(q) < 2 THEN [q] ELSE list_transform(range(1, length(q)), lambda i: substr(q, i, 2)) END) AS gram FROM sq),
oh AS (SELECT q, official_code, count(*) AS hits FROM sg JOIN e ON contains(ok, gram) GROUP BY ALL),
sh AS (SELECT q, official_code, count(*) AS hits FROM sg JOIN e ON contains(sk, gram) GROUP BY ALL),
sc AS (SELECT sq.q, e.*, CASE WHEN sq.q = ok THEN 98 WHEN length(sq.q) >= 2 AND contains(ok, sq.q) THEN 88 WHEN length(ok) >= 2 AND contains(sq.q, ok) THEN 74
    WHEN oh.hits > 0 THEN least(64 + oh.hits * 6, 78) ELSE 0 END AS os,
  CASE WHEN sq.q = sk THEN 92 WHEN length(sq.q) >= 2 AND contains(sk, sq.q) THEN 82 WHEN length(sk) >= 2 AND contains(sq.q, sk) THEN 70
    WHEN sh.hits > 0 THEN least(58 + sh.hits * 5, 72) ELSE 0 END AS ss
  FROM sq JOIN e ON TRUE LEFT JOIN oh ON oh.q = sq.q AND oh.official_code = e.official_code LEFT JOIN sh ON sh.q = sq.q AND sh.official_code = e.official_code),
sug AS (SELECT * FROM (SELECT q, official_code, official_name, category_short_name, greatest(os, ss) AS score,
  row_number() OVER (PARTITION BY q ORDER BY greatest(os, ss) DESC, official_code) AS rn FROM sc WHERE greatest(os, ss) > 0) x WHERE rn = 1)"""


@query("suggest_taxonomy", f"""WITH names AS (SELECT project_name AS name FROM dlines UNION ALL SELECT concat(p_name, ' ', p_type) FROM part UNION ALL SELECT n_name FROM nation),
{SUGGEST_SQL} SELECT q, official_code, score FROM sug""")
def _(spark, sf):
    names = view(spark, sf, "dlines").select("project_name").unionByName(
        table(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("project_name"))
    ).unionByName(table(spark, sf, "nation").select(F.col("n_name").alias("project_name")))
    return taxonomy.suggest_taxonomy(names, view(spark, sf, "tax")).select("q", "official_code", "score")


def resolve_sql(source: str) -> str:
    """Code per distinct (category, name) of ``source``, by category first, promoted to a leaf."""
    def ranked(name, key, equal):
        return f"""{name} AS (SELECT * FROM (SELECT k, official_code, category_short_name, row_number() OVER (PARTITION BY k ORDER BY s DESC, official_code) AS rn FROM (
  SELECT k, x.*, CASE WHEN {equal} = 120 AND sk = k THEN 120 WHEN ok = k THEN 110 WHEN sk = k THEN 105 WHEN contains(ok, k) THEN 90 WHEN contains(sk, k) THEN 88
    WHEN sk <> '' AND contains(k, sk) THEN 70 ELSE 0 END AS s
  FROM (SELECT DISTINCT {key} AS k FROM {source} WHERE {key} <> '') q JOIN x ON TRUE) m WHERE s > 0) r WHERE rn = 1)"""
    return f"""x AS (SELECT *, {K('official_name')} AS ok, {K('category_short_name')} AS sk FROM tax),
{ranked('mc', K('tax_category'), 120)}, {ranked('mn', K('project_name'), 105)},
{HIERARCHY_SQL}, short AS (SELECT official_code AS leaf_code, category_short_name AS leaf_short FROM tax)"""


@query("resolve_codes", f"""WITH src AS (SELECT s_name, r.*, n_name FROM dlines r JOIN (SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey) s
  ON s_suppkey = line_no % 1000000), l AS (SELECT draft_id, line_no, project_name, CASE WHEN tax_category = 'PROMO' THEN n_name ELSE tax_category END AS tax_category, tax_code FROM src),
{resolve_sql('l')}
SELECT draft_id, line_no, coalesce(CASE WHEN tax_code <> '' THEN tax_code ELSE coalesce(t1.leaf_code, t2.leaf_code) END, '') AS resolved_code
FROM l LEFT JOIN mc ON mc.k = {K('l.tax_category')} LEFT JOIN tree t1 ON t1.official_code = mc.official_code
LEFT JOIN mn ON mn.k = {K('l.project_name')} AND NOT (l.tax_category = '' AND l.project_name = '服务费') LEFT JOIN tree t2 ON t2.official_code = mn.official_code""")
def _(spark, sf):
    sellers = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    lines = view(spark, sf, "dlines").withColumn("s_suppkey", F.col("line_no") % 1000000).join(sellers, "s_suppkey").withColumn(
        "tax_category", F.when(F.col("tax_category") == "PROMO", F.col("n_name")).otherwise(F.col("tax_category")))
    return taxonomy.resolve_codes(lines, view(spark, sf, "tax")).select("draft_id", "line_no", "resolved_code")


@query("search_taxonomy", f"""WITH {HIERARCHY_SQL}, q AS (SELECT DISTINCT lower(replace(w, ' ', '')) AS q FROM (SELECT p_name AS w FROM part UNION ALL SELECT split_part(p_name, ' ', 2) FROM part
  UNION ALL SELECT p_type FROM part UNION ALL SELECT n_name FROM nation UNION ALL SELECT concat('10', cast(n_nationkey AS string)) FROM nation) w),
k AS (SELECT tax.*, is_summary, lower(replace(tax.official_name, ' ', '')) AS kn, lower(category_short_name) AS ks, lower(replace(description, ' ', '')) AS kd
  FROM tax JOIN tree ON tax.official_code = tree.official_code),
s AS (SELECT q, k.*, CASE WHEN q = official_code THEN 120 WHEN starts_with(official_code, q) THEN 105 WHEN kn = q THEN 100 WHEN ks = q THEN 92 WHEN starts_with(kn, q) THEN 88
  WHEN starts_with(ks, q) THEN 82 WHEN contains(kn, q) THEN 72 WHEN contains(ks, q) THEN 64 ELSE 38 END + CASE WHEN is_summary THEN 0 ELSE 8 END AS score
  FROM q JOIN k ON starts_with(official_code, q) OR contains(kn, q) OR contains(ks, q) OR contains(kd, q))
SELECT q, rank, official_code, is_summary, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, is_summary, official_code) AS rank FROM s) r WHERE rank <= 40""")
def _(spark, sf):
    part, nation = table(spark, sf, "part"), table(spark, sf, "nation")
    words = part.select(F.explode(F.array("p_name", F.split_part("p_name", F.lit(" "), F.lit(2)), "p_type")).alias("query")).unionByName(
        nation.select(F.explode(F.array("n_name", F.concat(F.lit("10"), F.col("n_nationkey").cast("string")))).alias("query")))
    return taxonomy.search_taxonomy(words, view(spark, sf, "tax")).select("q", "rank", "official_code", "is_summary", "score")


ITEMS_SQL = """SELECT DISTINCT p_name AS project_name, CASE p_type WHEN 'PROMO' THEN '一次性针' WHEN 'SMALL' THEN 'LED' ELSE p_brand END AS specification, p_type AS tax_category FROM part"""
CAND_SQL = f"""t AS (SELECT DISTINCT concat_ws(' ', project_name, specification, tax_category) AS item_text FROM items),
e AS (SELECT *, {K('official_name')} AS ok, {K('category_short_name')} AS sk, {K('description')} AS dk FROM tax2),
g AS (SELECT item_text, unnest(list_transform(range(1, length({K('item_text')})), lambda i: substr({K('item_text')}, i, 2))) AS gram FROM t),
gs AS (SELECT item_text, official_code, sum(CASE WHEN contains(ok, gram) THEN 10 WHEN contains(sk, gram) THEN 7 WHEN contains(dk, gram) THEN 3 ELSE 0 END) AS s
  FROM g JOIN e ON contains(ok, gram) OR contains(sk, gram) OR contains(dk, gram) GROUP BY ALL),
hs AS (SELECT item_text, official_code, CASE WHEN contains(item_text, 'LED') AND contains(official_name, '照明') THEN 64 ELSE 0 END * (CASE WHEN regexp_matches(official_name, '户外照明') THEN 1 ELSE 0 END)
    + CASE WHEN contains(item_text, '针') AND (contains(official_name, '医') OR contains(description, '医用')) THEN 32 ELSE 0 END
    + CASE WHEN contains(item_text, '针') AND contains(concat(official_name, description), '针') THEN 45 ELSE 0 END AS s FROM t JOIN e ON TRUE),
al AS (SELECT item_text, official_code, sum(s) AS score FROM (SELECT * FROM gs UNION ALL SELECT * FROM hs WHERE s > 0) u GROUP BY ALL),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_text ORDER BY score DESC, official_code) AS rank FROM al WHERE score > 0) r WHERE rank <= 80)"""
TAX2_SQL = """SELECT official_code, CASE WHEN official_name LIKE '%ring' THEN concat('户外照明', official_name) WHEN official_name LIKE '%gear' THEN concat('医', official_name) ELSE official_name END AS official_name,
  category_short_name, CASE WHEN official_name LIKE 'red%' THEN concat(description, '针') ELSE description END AS description FROM tax"""


@query("taxonomy_candidates", f"WITH items AS ({ITEMS_SQL}), tax2 AS ({TAX2_SQL}), {CAND_SQL} SELECT item_text, rank, official_code, score FROM cand")
def _(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("part")
    view(spark, sf, "tax").createOrReplaceTempView("tax")
    return taxonomy.taxonomy_candidates(spark.sql(ITEMS_SQL), spark.sql(TAX2_SQL)).select("item_text", "rank", "official_code", "score")


CHOICE_ITEMS = "SELECT draft_id, line_no, project_name, specification, tax_category, tax_code, coding_reference FROM dlines"
CHOICES_SQL = f"""SELECT {K('p_name')} AS choice_key, CASE WHEN p_name LIKE 'red%' THEN '9999999999999999999' ELSE code END AS code, '' AS name FROM (
  SELECT official_name AS p_name, official_code AS code FROM tax WHERE category_short_name NOT LIKE '区%' AND category_short_name NOT LIKE '类%') n WHERE p_name NOT LIKE 'blue%'"""


@query("apply_choices", f"""WITH items AS ({CHOICE_ITEMS}), tax2 AS (SELECT * FROM tax),
{CAND_SQL.replace("concat_ws(' ', project_name, specification, tax_category)", "trim(concat_ws(' ', project_name, specification, tax_category))")},
c AS ({CHOICES_SQL}), src AS (SELECT *, trim(concat_ws(' ', project_name, specification, tax_category)) AS item_text FROM ({CHOICE_ITEMS}) i),
j AS (SELECT src.*, c.code, cand.official_code AS hit, x.category_short_name AS hit_short, x.official_name AS hit_name, src.item_text IN (SELECT item_text FROM cand) AS any_cand,
    tax_category = '' OR tax_code = '' OR coding_reference = '' OR coding_reference LIKE '未命中规则%' AS open
  FROM src LEFT JOIN c ON c.choice_key = {K('project_name')} LEFT JOIN cand ON cand.item_text = src.item_text AND cand.official_code = c.code LEFT JOIN tax x ON x.official_code = cand.official_code)
SELECT draft_id, line_no, CASE WHEN tax_category <> '' THEN tax_category ELSE coalesce(hit_short, '') END AS tax_category,
  CASE WHEN tax_code <> '' THEN tax_code ELSE coalesce(hit, '') END AS tax_code,
  CASE WHEN hit IS NOT NULL THEN concat('智能推荐，需人工复核: 大类 ', hit_short, ' / 细分 ', hit_name, ' / 编码 ', hit) WHEN NOT open THEN coding_reference
    WHEN NOT any_cand THEN '待智能赋码: 官方分类库暂无可用候选，请人工确认' WHEN code IS NULL THEN '待智能赋码: 本地规则未命中，LLM 未启用，请人工选择税收分类'
    ELSE '智能赋码返回结果未命中官方候选，需人工确认' END AS coding_reference FROM j""")
def _(spark, sf):
    view(spark, sf, "dlines").createOrReplaceTempView("dlines")
    view(spark, sf, "tax").createOrReplaceTempView("tax")
    lines = spark.sql(CHOICE_ITEMS)
    choices = spark.sql(CHOICES_SQL.replace(", 'g')", ")"))
    return coding.apply_choices(lines, choices, view(spark, sf, "tax")).select("draft_id", "line_no", "tax_category", "tax_code", "coding_reference")


@query("code_lines", f"""WITH src0 AS (SELECT *, CASE WHEN tax_category = '' AND project_name LIKE '*%*%' THEN split_part(project_name, '*', 2)
    WHEN tax_category = '' AND project_name LIKE '%*%' THEN split_part(project_name, '*', 1) ELSE tax_category END AS cat,
    CASE WHEN tax_category = '' AND project_name LIKE '*%*%' THEN split_part(project_name, '*', 3)
    WHEN tax_category = '' AND project_name LIKE '%*%' THEN split_part(project_name, '*', 2) ELSE project_name END AS nm FROM dlines),
src AS (SELECT draft_id, line_no, nm AS project_name, cat AS tax_category, tax_rate, tax_code, specification, coding_reference FROM src0),
{RULE_SQL}, {CONTEXT_BEST_SQL},
m AS (SELECT src.*, coalesce(b.entry_id, c.entry_id) AS rid, coalesce(b.alias, c.alias) AS al, coalesce(b.normalized_invoice_name, c.normalized_invoice_name) AS nn,
    coalesce(b.tax_category, c.tax_category) AS rc, coalesce(b.tax_code, c.tax_code) AS rk, coalesce(b.tax_treatment_or_rate, c.tax_treatment_or_rate) AS rr,
    coalesce(b.source_label, c.source_label) AS rl, b.entry_id IS NULL AS by_context
  FROM src LEFT JOIN best b ON src.project_name = b.project_name
  LEFT JOIN cbest c ON c.context_id = src.draft_id AND b.entry_id IS NULL AND (src.project_name IN ('', '服务费'))),
r AS (SELECT draft_id, line_no, CASE WHEN project_name = '' THEN nn WHEN by_context THEN project_name WHEN {K('project_name')} = {K('nn')} THEN project_name
    WHEN contains({K('project_name')}, {K('al')}) OR contains({K('al')}, {K('project_name')}) THEN nn ELSE project_name END AS project_name,
  CASE WHEN tax_rate = '' THEN rr ELSE tax_rate END AS tax_rate,
  CASE WHEN tax_category = '' THEN rc ELSE tax_category END AS tax_category, CASE WHEN tax_code = '' THEN rk ELSE tax_code END AS tax_code,
  CASE WHEN coding_reference = '' THEN concat('命中 ', rl, ': ', al, ' -> ', rc, ' / ', rr) ELSE coding_reference END AS coding_reference FROM m WHERE rid IS NOT NULL),
{resolve_sql('r')}
SELECT r.draft_id, r.line_no, r.project_name, r.tax_rate, r.tax_category, CASE WHEN tax_code = '' THEN coalesce(t1.leaf_code, t2.leaf_code, '') ELSE tax_code END AS tax_code,
  CASE WHEN tax_code = '' AND NOT contains(coding_reference, coalesce(t1.leaf_code, t2.leaf_code)) THEN concat(coding_reference, '; 官方编码 ', coalesce(t1.leaf_code, t2.leaf_code)) ELSE coding_reference END AS coding_reference
FROM r LEFT JOIN mc ON mc.k = {K('r.tax_category')} LEFT JOIN tree t1 ON t1.official_code = mc.official_code
LEFT JOIN mn ON mn.k = {K('r.project_name')} LEFT JOIN tree t2 ON t2.official_code = mn.official_code""")
def _(spark, sf):
    lines = view(spark, sf, "dlines").withColumn("context_id", F.col("draft_id"))
    out = coding.code_lines(lines, view(spark, sf, "rules"), view(spark, sf, "tax"), _contexts(spark, sf))
    return out.select("draft_id", "line_no", "project_name", "tax_rate", "tax_category", "tax_code", "coding_reference")


@query("coding_states", """SELECT coding_state, candidate_status, count(*) AS n FROM (SELECT CASE WHEN coding_reference LIKE '人工修正赋码%' THEN 'manual_correction' WHEN coding_reference LIKE '命中 %' THEN 'auto_hit_formal'
  WHEN coding_reference LIKE '官方分类候选 %' THEN 'taxonomy_candidate' WHEN tax_category <> '' THEN 'manual_or_external_fill' ELSE 'unresolved' END AS coding_state,
  CASE WHEN coding_reference LIKE '人工修正赋码%' THEN 'manual_correction' WHEN coding_reference LIKE '命中 %' THEN ''
  WHEN coding_reference LIKE '官方分类候选 %' THEN 'taxonomy_only' WHEN tax_category <> '' THEN 'manual_fill_without_formal_hit' ELSE 'unresolved' END AS candidate_status FROM dlines) s GROUP BY ALL""")
def _(spark, sf):
    return coding.coding_states(view(spark, sf, "dlines")).groupBy("coding_state", "candidate_status").agg(F.count(F.lit(1)).alias("n"))


BA = "a.draft_id = b.draft_id AND a.line_no = b.line_no"
CANON_A, CANON_B = (RATE_SQL.replace("tax_rate", f"{s}.tax_rate") for s in "ab")


@query("mark_manual_changes", f"""SELECT draft_id, line_no, CASE WHEN known AND changes <> '' THEN concat('人工修正赋码: ', changes,
    CASE WHEN ref <> '' AND ref NOT LIKE '人工修正赋码%' THEN concat('；原依据: ', ref) ELSE '' END) ELSE ref END AS coding_reference
FROM (SELECT a.draft_id, a.line_no, b.draft_id IS NOT NULL AS known, a.coding_reference AS ref, concat_ws('；',
  CASE WHEN a.tax_category <> b.tax_category THEN concat('赋码大类: ', CASE WHEN b.tax_category = '' THEN '空' ELSE b.tax_category END, ' -> ', a.tax_category) END,
  CASE WHEN a.tax_code <> b.tax_code THEN concat('税收编码: ', CASE WHEN b.tax_code = '' THEN '空' ELSE b.tax_code END, ' -> ', a.tax_code) END,
  CASE WHEN {CANON_A} <> {CANON_B} THEN concat('税率: ', {CANON_B}, ' -> ', {CANON_A}) END) AS changes
FROM lines_after a LEFT JOIN lines_before b ON {BA}) q""")
def _(spark, sf):
    return coding.mark_manual_changes(view(spark, sf, "lines_before"), view(spark, sf, "lines_after")).select("draft_id", "line_no", "coding_reference")


@query("coding_outcome", f"""SELECT a.draft_id, count(*) AS total, count(CASE WHEN a.coding_reference LIKE '智能推荐%' THEN 1 END) AS recommended,
  count(CASE WHEN regexp_matches(a.coding_reference, '^(智能赋码调用失败|智能赋码返回结果未命中|待智能赋码)') THEN 1 END) AS failed,
  count(CASE WHEN a.coding_reference <> b.coding_reference OR a.tax_category <> b.tax_category OR a.tax_code <> b.tax_code THEN 1 END) AS changed,
  count(CASE WHEN a.coding_reference LIKE '智能推荐%' OR contains(a.coding_reference, 'LLM') THEN 1 END) AS from_smart,
  count(CASE WHEN contains(a.coding_reference, '工程材料规则') THEN 1 END) AS from_engineering, count(CASE WHEN contains(a.coding_reference, '本地') THEN 1 END) AS from_local,
  count(CASE WHEN contains(a.coding_reference, '客户规则') THEN 1 END) AS from_tenant, count(CASE WHEN regexp_matches(a.coding_reference, '历史|档案') THEN 1 END) AS from_history,
  count(CASE WHEN contains(a.coding_reference, '官方分类候选') THEN 1 END) AS from_official FROM lines_after a JOIN lines_before b ON {BA} GROUP BY a.draft_id""")
def _(spark, sf):
    return coding.coding_outcome(view(spark, sf, "lines_before"), view(spark, sf, "lines_after"))


KNOWN_SQL = """SELECT concat('K-', p_name) AS rule_id, p_name AS raw_alias, CASE WHEN p_name LIKE 'red%' THEN 'OTHER' ELSE 'SMALL' END AS tax_category,
  '1010101000000000000' AS tax_code, CASE WHEN p_name LIKE 'red%' THEN '9%' ELSE '13%' END AS tax_treatment_or_rate, CASE WHEN p_name LIKE 'old%' THEN 'pending_review' ELSE 'ready' END AS status
FROM part WHERE p_name NOT LIKE 'blue%' GROUP BY p_name"""


# The edits also rename the items of one unit, so a rule hears of several spellings.
RENAMED_SQL = """SELECT a.* EXCLUDE (project_name), CASE WHEN unit = '箱' AND project_name <> '' THEN concat(project_name, ' ', specification) ELSE project_name END AS project_name FROM lines_after a"""


@query("learn_rules", f"""WITH ra AS ({RENAMED_SQL}), rk AS (SELECT a.draft_id, a.line_no, a.project_name, a.tax_category, a.tax_code, {CANON_A} AS rate, b.draft_id IS NULL AS is_new,
    coalesce(b.tax_category, '') AS bc, coalesce(b.tax_code, '') AS bk, coalesce({CANON_B}, '3%') AS brate, coalesce(b.project_name, '') AS bn
  FROM ra a LEFT JOIN lines_before b ON {BA}),
cand AS (SELECT *, concat_ws('|', {K('tax_category')}, {K('tax_code')}, replace(rate, '%', '')) AS target, CASE WHEN bn <> '' THEN {K('bn')} ELSE {K('project_name')} END AS ka FROM rk
  WHERE project_name <> '' AND tax_category <> '' AND (tax_category <> bc OR tax_code <> bk OR rate <> brate OR project_name <> bn) AND (tax_code <> '' OR tax_category <> bc)),
spelt AS (SELECT ka, target, (draft_id, line_no, 0) AS spot, bn AS v FROM cand WHERE bn <> '' UNION ALL SELECT ka, target, (draft_id, line_no, 1), project_name FROM cand),
spelt1 AS (SELECT ka, target, {K('v')} AS k, min(spot) AS spot, arg_min(v, spot) AS v FROM spelt GROUP BY ALL),
names AS (SELECT ka, target, list(v ORDER BY spot) AS vs FROM spelt1 GROUP BY ALL),
origin1 AS (SELECT ka, target, {K('bn')} AS k, min((draft_id, line_no)) AS spot, arg_min(bn, (draft_id, line_no)) AS v FROM cand WHERE bn <> '' GROUP BY ALL),
origins AS (SELECT ka, target, string_agg(v, '、' ORDER BY spot) AS original_project_name FROM origin1 GROUP BY ALL),
grp AS (SELECT ka, target, count(*) AS evidence, min((draft_id, line_no)) AS pos, arg_max(project_name, (draft_id, line_no)) AS last_name FROM cand GROUP BY ALL),
srcs AS (SELECT ka, target, string_agg(concat('learned:', draft_id, ':', line_no), ';' ORDER BY draft_id, line_no) AS sources FROM (SELECT DISTINCT ka, target, draft_id, line_no FROM cand) c GROUP BY ALL),
known AS (SELECT *, {K('raw_alias')} AS ka, concat_ws('|', tax_category, tax_code, replace(tax_treatment_or_rate, '%', '')) AS target FROM ({KNOWN_SQL}) k WHERE status <> 'pending_review'),
st AS (SELECT grp.*, known.rule_id AS merged, known.raw_alias AS known_alias FROM grp LEFT JOIN known ON known.ka = grp.ka AND known.target = grp.target),
claims AS (SELECT {K('v')} AS a, st.target, pos, ka FROM st JOIN (SELECT n.ka AS nka, n.target AS nt, unnest(first_aliases) AS v FROM (SELECT cand.ka, cand.target,
  arg_min(CASE WHEN bn = '' OR {K('bn')} = {K('project_name')} THEN [CASE WHEN bn <> '' THEN bn ELSE project_name END] ELSE [bn, project_name] END, (draft_id, line_no)) AS first_aliases FROM cand GROUP BY ALL) n) f
  ON nka = st.ka AND nt = st.target WHERE merged IS NULL),
cl AS (SELECT a, arg_min(target, (pos, target)) AS first_target, arg_min(ka, (pos, target)) AS first_ka FROM claims GROUP BY a),
judged AS (SELECT claims.ka, claims.target, min(o.rule_id) AS known_id, min(CASE WHEN first_target <> claims.target THEN concat('learned-', substr(sha1(concat(first_ka, '|', first_target)), 1, 12)) END) AS batch_id
  FROM claims LEFT JOIN cl ON cl.a = claims.a LEFT JOIN known o ON o.ka = claims.a AND o.target <> claims.target GROUP BY ALL)
SELECT CASE WHEN merged IS NOT NULL THEN merged WHEN coalesce(known_id, batch_id) IS NOT NULL THEN concat('conflict-', substr(sha1(concat(st.ka, '|', st.target)), 1, 12))
    ELSE concat('learned-', substr(sha1(concat(st.ka, '|', st.target)), 1, 12)) END AS rule_id, evidence,
  CASE WHEN merged IS NOT NULL THEN 'merged' WHEN coalesce(known_id, batch_id) IS NOT NULL THEN 'pending_review' ELSE 'ready' END AS status,
  coalesce(known_id, batch_id, '') AS conflict_with_rule_id, last_name AS final_project_name, sources AS source_case_ids, coalesce(original_project_name, '') AS original_project_name,
  CASE WHEN merged IS NULL THEN array_to_string(vs, '、') ELSE concat_ws('、', known_alias, nullif(array_to_string(list_filter(vs, lambda v: {K('v')} <> {K('known_alias')}), '、'), '')) END AS raw_alias
FROM st JOIN names ON names.ka = st.ka AND names.target = st.target JOIN srcs ON srcs.ka = st.ka AND srcs.target = st.target LEFT JOIN origins ON origins.ka = st.ka AND origins.target = st.target LEFT JOIN judged ON judged.ka = st.ka AND judged.target = st.target""")
def _(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("part")
    view(spark, sf, "lines_after").createOrReplaceTempView("lines_after")
    learned = coding.learn_rules(view(spark, sf, "lines_before"), spark.sql(RENAMED_SQL.replace("EXCLUDE", "EXCEPT")), spark.sql(KNOWN_SQL))
    return learned.select("rule_id", "evidence", "status", "conflict_with_rule_id", "final_project_name", "source_case_ids", "original_project_name", "raw_alias")
