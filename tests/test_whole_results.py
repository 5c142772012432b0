"""Sizes beyond every former limit: nothing is cut, and order holds."""

from pyspark.sql import functions as F

from sparkledger.functions import skew
from sparkledger.operators import events, matching, profiles, quality
from sparkledger.streaming import jobs

RULE = ("raw_alias", "normalized_invoice_name", "tax_category", "tax_code", "tax_treatment_or_rate")


def test_published_rules_come_back(spark, tmp_path):
    rules = spark.range(5000).select(F.concat(F.lit("r"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("rule_id"), *[F.concat(F.lit(c), "id").alias(c) for c in RULE])
    for version, some in (("v1", rules.limit(3)), ("v2", rules)):
        jobs.publish_rules(jobs.rule_packages(some, "t", version, f"2024-01-0{version[1]}T00:00:00"), str(tmp_path))
    latest = events.latest_rules(jobs.read_packages(spark, str(tmp_path)))
    assert latest.select("rule_id").exceptAll(rules.select("rule_id")).count() == 0 and latest.count() == 5000
    assert sorted(r.rule_pos for r in latest.collect()) == list(range(5000))


def test_twelve_targets(spark):
    lines = spark.createDataFrame([("a", i, 10.0 + i) for i in range(12)], "invoice_no string, line_no bigint, amount double")
    targets = spark.createDataFrame([("a", i, 10.0 + i) for i in range(12)], "invoice_no string, target_pos int, target double")
    assert [r.group_no for r in matching.split_by_targets(lines, targets).orderBy("line_no").collect()] == list(range(12))


def test_one_target_replaces_the_amount_of_one_line(spark):
    lines = spark.createDataFrame([("a", 1, 10.0), ("b", 1, 4.0), ("b", 2, 6.0)], "invoice_no string, line_no bigint, amount double")
    targets = spark.createDataFrame([("a", 0, 7.0), ("b", 0, 7.0)], "invoice_no string, target_pos int, target double")
    got = {(r.invoice_no, r.line_no): r.amount for r in matching.split_by_targets(lines, targets).collect()}
    assert got == {("a", 1): 7.0, ("b", 1): 4.0, ("b", 2): 6.0}


def test_thirty_actions(spark):
    rows = [("t", "c", i, f"e{i}", "d", "b", f"kind{i:02d}", f"2024-01-01T00:00:{i:02d}", "{}") for i in range(30)]
    log = spark.createDataFrame(rows, "tenant string, case_id string, seq bigint, event_id string, draft_id string, batch_id string, event_type string, created_at string, payload string")
    step = events.workflow_steps(log).filter("phase = 'input'").first()
    assert step.actions == [f"kind{i:02d}" for i in range(30)]


def test_long_draft_is_one_event_and_one_table(spark):
    kinds = ("project_name", "amount_with_tax", "tax_rate", "tax_category", "tax_code", "source_item_code", "specification", "unit", "quantity", "unit_price", "coding_reference")
    lines = spark.range(5000).select(F.lit("d").alias("draft_id"), F.col("id").alias("line_no"), *[F.concat(F.lit("n" if c == "project_name" else ""), F.col("id").cast("string")).alias(c) for c in kinds])
    names = ("case_id", "draft_id", "batch_id", "company_name", "buyer_name", "buyer_tax_id", "invoice_kind", "special_business", "note")
    drafts = spark.createDataFrame([tuple("d" for _ in names)], ", ".join(f"{n} string" for n in names))
    made = events.draft_events(drafts, lines.repartition(5), "draft_created")
    listed = made.select(F.from_json("payload", "lines array<struct<project_name:string>>").alias("p")).select("p.lines.project_name").collect()
    assert [r.project_name for r in listed] == [[f"n{i}" for i in range(5000)]]
    text = quality.lines_to_text(lines.repartition(5)).collect()
    assert len(text) == 1 and [row.split("\t")[0] for row in text[0].text.split("\n")[1:]] == [f"n{i}" for i in range(5000)]


def test_large_seller_is_one_document(spark):
    seller = (F.lit("s").alias("seller_name"), F.lit("1").alias("seller_tax_id"))
    projects = spark.range(12000).select(*seller, *[F.concat(F.lit(c), "id").alias(c) for c in profiles.PROJECT], F.col("id").alias("line_count"), F.lit("high").alias("confidence"))
    buyers = spark.range(10).select(*seller, *[F.concat(F.lit(c), "id").alias(c) for c in profiles.BUYER], F.col("id").alias("line_count"))
    found = profiles.profile_documents(projects, buyers).collect()
    assert len(found) == 1
    assert [p.line_count for p in found[0].project_profiles] == list(range(11999, -1, -1)) and len(found[0].buyer_profiles) == 10


def test_all_reports_make_candidates(spark):
    rows = [("t", i, f"e{i}", "d", "local_learned_rules_saved", f"2024-01-01T{i:06d}", f'{{"rules":[{{"raw_alias":"a{i}","tax_category":"c"}}]}}', "c") for i in range(5200)]
    log = spark.createDataFrame(rows, "tenant string, seq bigint, event_id string, draft_id string, event_type string, received_at string, payload string, case_id string")
    assert events.rule_candidates(log, "t").count() == 5200
    assert events.rule_candidates(log, "t", limit=5).count() == 5


def test_candidates_past_four_digits_keep_their_own_ids(spark):
    rules = [",".join(f'{{"raw_alias":"a{i * 1001 + k}","tax_category":"c"}}' for k in range(1001)) for i in range(10)]
    rows = [("t", (i - 2) * 2**33, f"e{i}", "d", "local_learned_rules_saved", f"2024-01-{i + 1:02d}", f'{{"rules":[{r}]}}', "c") for i, r in enumerate(rules)]
    log = spark.createDataFrame(rows, "tenant string, seq bigint, event_id string, draft_id string, event_type string, received_at string, payload string, case_id string")
    got = {r.raw_alias: r.candidate_id for r in events.rule_candidates(log, "t").select("raw_alias", "candidate_id").collect()}
    assert got == {f"a{i}": f"cand-{i + 1:04d}" for i in range(10010)}
    assert got["a9999"] == "cand-10000" and got["a999"] == "cand-1000"


def test_numbers_over_sparse_and_dense_positions(spark):
    places = sorted({*range(-70, 300), *(k * 10**14 - 5 * 10**17 for k in range(10000)), -(2**63), 2**63 - 1})
    df = spark.createDataFrame([(p,) for p in places], "at bigint").repartition(7)
    for bits in (4, 16):
        got = {r.at: r.n for r in skew.tree_row_number(df, "at", F.col("at"), "n", bits).collect()}
        assert got == {p: i + 1 for i, p in enumerate(places)}
