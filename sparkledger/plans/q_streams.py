"""Queries over the batch forms of the incremental jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as ev
from ..sources import tables as src
from ..streaming import jobs
from .q_events import PARSED, summary_sql
from .registry import query
from .views import table, view

# Three sends: the second repeats the views, the third the clicks.
SENDS_SQL = """SELECT 1 AS batch_no, seq, event_id, tenant FROM cev WHERE event_type LIKE 'draft%' OR event_type LIKE '%code%'
UNION ALL SELECT 2, seq, event_id, tenant FROM cev WHERE event_type LIKE 'draft%' OR event_type LIKE '%template%' UNION ALL SELECT 3, seq, event_id, tenant FROM cev"""


def _sends(spark, sf):
    view(spark, sf, "cev").createOrReplaceTempView("cev")
    return spark.sql(SENDS_SQL)


@query("ingest_counts", f"""WITH s AS ({SENDS_SQL}), f AS (SELECT event_id, min(batch_no) AS batch_no FROM s GROUP BY event_id), a AS (SELECT batch_no, count(*) AS accepted FROM f GROUP BY batch_no)
SELECT s.batch_no, count(*) AS event_count, coalesce(min(accepted), 0) AS accepted, count(*) - coalesce(min(accepted), 0) AS duplicates FROM s LEFT JOIN a ON a.batch_no = s.batch_no GROUP BY s.batch_no""")
def _(spark, sf):
    return jobs.ingest_report(_sends(spark, sf))[1]


@query("ingest_accepted", f"WITH s AS ({SENDS_SQL}) SELECT event_id, min(batch_no) AS batch_no FROM s GROUP BY event_id")
def _(spark, sf):
    return jobs.ingest_report(_sends(spark, sf))[0].select("event_id", "batch_no")


@query("profile_upsert", """SELECT 'T' AS tenant, concat('91', c_custkey) AS seller_tax_id, CASE WHEN c_acctbal > 0 THEN concat(c_name, ' new') ELSE c_name END AS seller_name, CASE WHEN c_acctbal > 0 THEN 2 ELSE 1 END AS batch FROM customer""")
def _(spark, sf):
    c = table(spark, sf, "customer")
    row = lambda df, name, n: df.select(F.lit("T").alias("tenant"), F.concat(F.lit("91"), F.col("c_custkey").cast("string")).alias("seller_tax_id"), name.alias("seller_name"), F.lit(n).alias("batch"))
    old = row(c, F.col("c_name"), 1)
    new = row(c.filter(F.col("c_acctbal") > 0), F.concat("c_name", F.lit(" new")), 2)
    return jobs.upsert(old, jobs.clean_profiles(new, "seller"), jobs.SELLER_KEY, ["batch"])


@query("publish_rules", """SELECT 'a' AS tenant, 'v2' AS version, '2024-01-02T00:00:00' AS published_at, row_number() OVER (ORDER BY entry_id) - 1 AS rule_pos, entry_id AS rule_id, raw_alias, normalized_invoice_name, tax_category, tax_code,
  tax_treatment_or_rate FROM rules""")
def _(spark, sf):
    rules = view(spark, sf, "rules").withColumn("rule_id", F.col("entry_id"))
    old = jobs.rule_packages(rules.filter(F.col("tier") == 0), "a", "v1", "2024-01-01T00:00:00")
    new = jobs.rule_packages(rules, "a", "v2", "2024-01-02T00:00:00")
    return ev.latest_rules(old.unionByName(new)).drop("package_id")


@query("pending_events", """SELECT event_id, 'next' AS place FROM (SELECT event_id FROM cev WHERE event_type <> 'failure_report_uploaded' ORDER BY seq LIMIT 50) a
UNION ALL SELECT event_id, 'later' FROM cev WHERE event_type <> 'failure_report_uploaded' AND event_id NOT IN (SELECT event_id FROM cev WHERE event_type <> 'failure_report_uploaded' ORDER BY seq LIMIT 50)""")
def _(spark, sf):
    log = view(spark, sf, "cev")
    first, later = jobs.pending_events(log, log.filter(F.col("event_type") == "failure_report_uploaded"))
    mark = lambda df, p: df.select("event_id", F.lit(p).alias("place"))
    return mark(first, "next").unionByName(mark(later, "later"))


# Documents stand in for arriving files; of every ninth the content was seen before.
ARRIVED_SQL = """SELECT concat(source, '/d', cast(doc_id AS string), CASE lang WHEN 'en' THEN '.xlsx' WHEN 'de' THEN '.png' ELSE '.txt' END) AS relative_path, lang, source, text FROM documents"""


@query("new_files", f"""WITH f AS (SELECT relative_path, lang, source, strlen(text) AS size_bytes, sha256(text) AS sha256 FROM ({ARRIVED_SQL}) a), m AS (SELECT DISTINCT sha256(text) AS sha256 FROM documents WHERE doc_id % 9 = 0)
SELECT relative_path, CASE lang WHEN 'en' THEN 'excel_history_or_candidate' WHEN 'de' THEN 'image_material' ELSE 'other' END AS type, size_bytes, sha256,
  CASE WHEN sha256 IN (SELECT sha256 FROM m) OR relative_path <> min(relative_path) OVER (PARTITION BY sha256) THEN 'duplicate' WHEN lang = 'en' AND source <> 'src1' THEN 'imported' WHEN lang = 'en' THEN 'failed'
    WHEN lang = 'de' THEN 'candidate_only' ELSE 'unsupported' END AS status FROM f""")
def _(spark, sf):
    documents = table(spark, sf, "documents")
    documents.createOrReplaceTempView("documents")
    content = F.col("text").cast("binary")
    files = spark.sql(ARRIVED_SQL).select(F.concat(F.lit("/in/"), "relative_path").alias("path"), F.octet_length("text").cast("bigint").alias("length"), content.alias("content"), "source")
    sellers = files.select(F.regexp_replace("path", "^/in/", "").alias("relative_path"), F.when(F.col("source") != "src1", F.col("source")).otherwise("").alias("seller_name"))
    known = documents.filter(F.col("doc_id") % 9 == 0).select(F.sha2(content, 256).alias("sha256"))
    return jobs.new_files(src.file_inventory(files, "/in").join(sellers, "relative_path"), known)


@query("case_states", f"WITH {PARSED} {summary_sql('tenant, case_id')}")
def _(spark, sf):
    # Partial states of three requests, merged as the store merges them, and finished.
    log = view(spark, sf, "cev")
    parts = [ev.partial_states(log.filter(F.pmod("seq", F.lit(3)) == k)) for k in (1, 0, 2)]
    return ev.finish_states(ev.merge_states(ev.merge_states(parts[0].unionByName(parts[1])).unionByName(parts[2]))).drop("status_label")
