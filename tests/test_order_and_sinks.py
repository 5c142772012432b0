"""Arrival order, repeatable commits, and readers of real files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sparkledger.operators import events as ev
from sparkledger.operators import profiles
from sparkledger.sources import tables as src
from sparkledger.sources.keyed import KeyedTable
from sparkledger.sources.positions import with_file_columns, with_positions
from sparkledger.streaming import jobs

# A case that ends confirmed: five events whose ids and times say nothing about their order.
FIVE = ("draft_created", "manual_edits_recorded", "template_exported", "batch_run_finished", "success_recorded")


def event(i, kind, case="c", **payload):
    return {"event_id": f"{case}-e{i}", "case_id": case, "draft_id": f"d{i}", "batch_id": "", "event_type": kind, "created_at": "2026-01-01T00:00:00", "payload": {"company_name": f"c{i}", **payload}}


def put_lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows), encoding="utf-8")


def some_events(rng, cases, n):
    kinds = [*FIVE, "batch_run_queued", "draft_batch_created", "failure_report_uploaded"]
    made = []
    for i in range(n):
        made.append(event(i, rng.choice(kinds), f"c{rng.randrange(cases)}", status=rng.choice(["done", "error"]), error_count=rng.randrange(3), item_count=rng.randrange(3), diffs=[{"field_name": "a"}] * rng.randrange(3)))
    return made


def test_positions_do_not_depend_on_splits(spark, tmp_path):
    for name, n in (("b.txt", 700), ("a.txt", 900), ("c.txt", 1)):
        (tmp_path / name).write_text("".join(f"{name} {i}\n" for i in range(1, n + 1)))
    seen = []
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("128m", "1k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            rows = with_positions(with_file_columns(spark.read.text(str(tmp_path))), seq="seq", after=10)
            assert size == "128m" or rows.select("file_start").distinct().count() > 5
            found = {r.value: (r.line_no, r.seq) for r in rows.collect()}
            assert all(line == int(value.split()[1]) for value, (line, _) in found.items())
            assert sorted(seq for _, seq in found.values()) == list(range(11, 1612))
            seen.append(found)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert seen[0] == seen[1]


def test_five_events_in_order_from_files_and_streams(spark, tmp_path):
    put_lines(tmp_path / "in" / "c.jsonl", [event(i, kind) for i, kind in enumerate(FIVE)])
    read = src.read_case_events(spark, str(tmp_path / "in"), "t")
    assert [(r.event_id, r.seq, r.tenant, bool(r.received_at), len(r.request_id)) for r in read.orderBy("seq").collect()] == [(f"c-e{i}", i + 1, "t", True, 12) for i in range(5)]
    table, log = str(tmp_path / "t"), str(tmp_path / "log")
    jobs.ingest_events(jobs.read_event_stream(spark, str(tmp_path / "in")), table, log, str(tmp_path / "cp"), "t").awaitTermination()
    store = jobs.EventStore(spark, table, log)
    assert [(r.event_id, r.seq) for r in store.events.read().orderBy("seq").collect()] == [(f"c-e{i}", i + 1) for i in range(5)]
    for summary in (store.summary(), ev.case_summary(read), jobs.case_states(store.events.read())):
        row = summary.first()
        assert (row.last_event_type, row.status, row.company_name, row.draft_id, row.event_count) == ("success_recorded", "assistant_confirmed", "c4", "d4", 5)


def test_states_of_batches_equal_the_summary(spark, tmp_path):
    rng = random.Random(5)
    sent = some_events(rng, 7, 90)
    table, log, cp = str(tmp_path / "t"), str(tmp_path / "log"), str(tmp_path / "cp")
    runs = [sent[:40], sent[40:60] + sent[10:30], sent[60:] + sent[:5]]  # later requests repeat events of earlier ones
    for i, rows in enumerate(runs):
        put_lines(tmp_path / "in" / f"{i}.jsonl", rows)
        jobs.ingest_events(jobs.read_event_stream(spark, str(tmp_path / "in")), table, log, cp, "t").awaitTermination()
    store = jobs.EventStore(spark, table, log)
    first = sorted(map(str, store.events.read().drop("received_at").collect()))
    # The last request again, as after a lost driver: with all of it written, and with a part.
    again = with_file_columns(spark.read.schema(src.EVENT_SCHEMA).json(str(tmp_path / "in" / "2.jsonl")))
    store.accept(again, "t", "", "", f"{cp}#2")
    assert sorted(map(str, store.events.read().drop("received_at").collect())) == first
    accepted = store.events.read()
    assert [r.event_id for r in accepted.orderBy("seq").collect()] == [r["event_id"] for r in sent]
    assert [r.seq for r in accepted.orderBy("seq").collect()] == list(range(1, 91))
    want = ev.case_summary(accepted)
    assert sorted(map(str, store.summary().select(*want.columns).collect())) == sorted(map(str, want.collect()))
    counted = {(r.event_count, r.accepted, r.duplicates, r.last_seq) for r in store.log.read().collect()}
    assert counted == {(40, 40, 0, 40), (40, 20, 20, 60), (35, 30, 5, 90)}
    # Another checkpoint begins at batch 0 and adds its events behind the others.
    put_lines(tmp_path / "more" / "x.jsonl", [event(0, "draft_created", "new"), sent[0]])
    jobs.ingest_events(jobs.read_event_stream(spark, str(tmp_path / "more")), table, log, str(tmp_path / "cp2"), "t").awaitTermination()
    last = store.events.read().orderBy(F.desc("seq")).first()
    assert (last.event_id, last.seq, store.events.read().count()) == ("new-e0", 91, 91)


def test_a_request_reads_the_buckets_it_touches(spark, tmp_path):
    index = KeyedTable(spark, str(tmp_path), ["event_id"], 32)
    for part in range(3):
        index.add(spark.range(200 * part, 200 * part + 200).select(F.concat(F.lit("e"), "id").alias("event_id")))
    one = spark.createDataFrame([("e5",), ("e404",)], "event_id string")
    rows = index.read_for(one)
    assert len(rows.inputFiles()) <= 6 < len(index.read().inputFiles())
    assert rows.join(one, "event_id").count() == 2 and rows.count() < 600


def test_ids_expire_behind_the_watermark(spark, tmp_path):
    rows = [{**event(i, "draft_created"), "created_at": f"2026-01-{day:02d}T00:00:00"} for i, day in ((0, 1), (0, 2), (1, 3), (1, 3))]
    put_lines(tmp_path / "in" / "a.jsonl", rows)
    stream = jobs.expiring_events(jobs.read_event_stream(spark, str(tmp_path / "in")), "2 days")
    query = stream.writeStream.format("memory").queryName("expiring").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.event_id for r in spark.table("expiring").collect()) == ["c-e0", "c-e1"]


def test_partial_states_merge_in_any_grouping(spark):
    rng = random.Random(9)
    rows = [(r["event_id"], i, "t", r["case_id"], r["draft_id"], "", r["event_type"], r["created_at"], r["created_at"], json.dumps(r["payload"])) for i, r in enumerate(some_events(rng, 4, 60))]
    log = spark.createDataFrame(rows, "event_id string, seq bigint, tenant string, case_id string, draft_id string, batch_id string, event_type string, created_at string, received_at string, payload string")
    parts = [ev.partial_states(log.filter(F.col("seq") % 3 == k)) for k in (2, 0, 1)]
    merged = ev.merge_states(ev.merge_states(parts[0].unionByName(parts[1])).unionByName(parts[2]))
    assert sorted(map(str, ev.finish_states(merged).collect())) == sorted(map(str, ev.case_summary(log).collect()))


def test_last_observations(spark):
    rows = [(f"e{i}", i, "t", f"c{i % 2}", "", "", f"kind{i}", "x", "x", "{}") for i in range(50)]
    log = spark.createDataFrame(rows, "event_id string, seq bigint, tenant string, case_id string, draft_id string, batch_id string, event_type string, created_at string, received_at string, payload string")
    got = ev.last_observations(log).filter("case_id = 'c1'").orderBy("position").collect()
    assert [(r.position, r.action) for r in got] == [(i + 1, f"kind{19 + 2 * i}") for i in range(16)]


# --- commits ---------------------------------------------------------------------------------

def test_ledger_in_another_layout_has_no_old_rows(spark, tmp_path):
    ledger = lambda v, n=20: spark.createDataFrame([(f"d{i}", 1, v) for i in range(n)], "draft_id string, line_no int, v string")
    src.write_ledger(spark, str(tmp_path), ledger("old"), parts=64)
    src.write_ledger(spark, str(tmp_path), ledger("new"), parts=16)
    assert sorted((r.draft_id, r.v) for r in src.read_ledger(spark, str(tmp_path)).collect()) == sorted((f"d{i}", "new") for i in range(20))
    src.write_ledger(spark, str(tmp_path), ledger("newer", 1), parts=16)
    assert sorted(r.v for r in src.read_ledger(spark, str(tmp_path)).collect()) == ["new"] * 19 + ["newer"]


def test_commits_with_one_label_count_once(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), ["k"], 4, most_parts=3)
    rows = lambda a, b: spark.range(a, b).select(F.col("id").alias("k"))
    table.add(rows(0, 10), "a")
    table.add(rows(10, 20), "b")
    table.add(rows(10, 20), "b")
    table.add(rows(20, 21), "c")
    assert sorted(r.k for r in table.read().collect()) == list(range(21))
    assert sorted(r.k for r in table.read("c").collect()) == list(range(20))
    for i in range(21, 40):  # folders of a bucket become one again
        table.add(rows(i, i + 1))
    assert sorted(r.k for r in table.read().collect()) == list(range(40))
    assert max(len(parts) for parts in table.state().live.values()) <= 3
    table.clean(1)
    assert len(table.commits()) == 1 and sorted(r.k for r in table.read().collect()) == list(range(40))
    assert len(table._children("data")) <= 24


def test_a_torn_commit_is_not_seen(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), ["k"], 2)
    rows = spark.range(5).select(F.col("id").alias("k"))
    table.add(rows)
    rows.withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(str(tmp_path / "data" / "commit=2"))
    (tmp_path / "manifests" / "2").mkdir()
    assert table.read().count() == 5
    table.add(spark.range(5, 7).select(F.col("id").alias("k")))
    assert sorted(r.k for r in table.read().collect()) == list(range(7))


def test_new_columns_and_empty_commits(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), ["k"], 2)
    assert table.read() is None
    table.commit(spark.createDataFrame([], "k bigint"))
    assert table.read().count() == 0
    table.commit(spark.createDataFrame([(1, "x"), (None, "n")], "k bigint, v string"))
    table.commit(spark.createDataFrame([(2,)], "k bigint"))
    assert sorted(map(tuple, table.read().select("k", "v").collect()), key=str) == [(1, "x"), (2, None), (None, "n")]


def test_published_twice_is_published_once(spark, tmp_path):
    rules = spark.createDataFrame([(f"r{i}", f"a{i}", "n", "c", "", "3%") for i in range(3)], "rule_id string, raw_alias string, normalized_invoice_name string, tax_category string, tax_code string, tax_treatment_or_rate string")
    for _ in range(2):
        jobs.publish_rules(jobs.rule_packages(rules, "t", "v1", "2024-01-01T00:00:00"), str(tmp_path))
    jobs.publish_rules(jobs.rule_packages(rules.limit(1), "other", "v1", "2024-01-01T00:00:00"), str(tmp_path))
    got = ev.latest_rules(jobs.read_packages(spark, str(tmp_path))).groupBy("tenant").count().collect()
    assert {r.tenant: r["count"] for r in got} == {"t": 3, "other": 1}


def test_case_log_takes_an_event_once(spark, tmp_path):
    log = spark.createDataFrame([(f"e{i}", f"c{i % 300}", "k") for i in range(600)], "event_id string, case_id string, event_type string")
    for _ in range(2):
        src.write_case_events(log, str(tmp_path), buckets=8)
    read = src.read_case_log(spark, str(tmp_path))
    assert sorted(map(tuple, read.select(*log.columns).collect())) == sorted(map(tuple, log.collect()))
    assert len({f.rsplit("/", 2)[1] for f in read.inputFiles()}) == 8


def test_saved_drafts_and_their_feedback(spark, tmp_path):
    drafts = spark.createDataFrame([("d1", "c", "co", "b", "x", "n"), ("d2", "c", "co", "b", "x", "n")], "draft_id string, case_id string, company_name string, buyer_name string, buyer_tax_id string, note string")
    names = "project_name amount_with_tax tax_rate tax_category specification unit quantity unit_price tax_code source_item_code coding_reference"
    line = lambda d, n, reference, category="cat": (d, n, "p", "", "0.03", category, "", "", "2", "1.005", "", "", reference)
    lines = lambda rows: spark.createDataFrame(rows, "draft_id string, line_no bigint, " + ", ".join(f"{c} string" for c in names.split()))
    first = lines([line("d1", 9, "命中 内置基础规则: a"), line("d1", 4, "人工修正赋码: 税率"), line("d2", 1, "", "")])
    src.save_drafts(spark, str(tmp_path), drafts, first, F.lit("2026-01-01T00:00:00"), parts=4)
    ledger = src.read_ledger(spark, str(tmp_path / "ledger"))
    assert ledger.columns == src.LEDGER_COLUMNS
    assert sorted((r.draft_id, r.line_no, r.saved_at, r.coding_state, r.amount_with_tax, r.tax_rate) for r in ledger.collect()) == [
        ("d1", "1", "2026-01-01T00:00:00", "manual_correction", "2.01", "3%"), ("d1", "2", "2026-01-01T00:00:00", "auto_hit_formal", "2.01", "3%"), ("d2", "1", "2026-01-01T00:00:00", "unresolved", "2.01", "3%"),
    ]
    pool = lambda: sorted((r.draft_id, r.line_no, r.candidate_status) for r in KeyedTable(spark, str(tmp_path / "feedback"), ["draft_id"]).read().collect())
    assert pool() == [("d1", "1", "manual_correction"), ("d2", "1", "unresolved")]
    src.save_drafts(spark, str(tmp_path), drafts.filter("draft_id = 'd1'"), lines([line("d1", 1, "命中 内置基础规则: a")]), parts=4)
    assert pool() == [("d2", "1", "unresolved")]
    assert src.read_ledger(spark, str(tmp_path / "ledger")).count() == 2


# --- files -----------------------------------------------------------------------------------

def history_csv(path, headers, rows, mark=""):
    path.write_text(mark + "\n".join([",".join(headers), *[",".join(str(r.get(h, "")) for h in headers) for r in rows]]) + "\n", encoding="utf-8")


def history_row(seller, buyer, amount, serial="1"):
    return {"数电发票号码": serial, "销方识别号": "91" + seller, "销方名称": seller, "购方识别号": "92", "购买方名称": buyer, "税收分类编码": "10", "货物或应税劳务名称": "*c*p", "税率": "3%", "价税合计": amount, "金额": amount, "税额": 0}


@pytest.mark.parametrize("multi_line", [False, True])
def test_history_files_by_their_own_headers(spark, tmp_path, multi_line):
    headers = list(history_row("", "", 0))
    rows = [history_row("s", f"b{i}", i) for i in range(1, 400)]
    history_csv(tmp_path / "a.csv", headers, rows)
    history_csv(tmp_path / "b.csv", ["更多", *reversed(headers)], [history_row("s", "b2", 2), history_row("s2", "new", 7)], "﻿")
    history_csv(tmp_path / "c.csv", ["价税合计", "税率", "x"], [{"价税合计": 9, "税率": "3%", "x": "y"}])
    history_csv(tmp_path / "d.csv", headers, [])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        read = src.read_history(spark, str(tmp_path / "*.csv"), multi_line)
        got = {(r.source_file.rsplit("/", 1)[1], r.line_key): (r.seller_name, r.buyer_name, float(r.amount_with_tax)) for r in read.collect()}
        assert got == {**{("a.csv", i + 1): ("s", f"b{i}", float(i)) for i in range(1, 400)}, ("b.csv", 2): ("s", "b2", 2.0), ("b.csv", 3): ("s2", "new", 7.0)}
        report = {r.source_file.rsplit("/", 1)[1]: (r.status, r.row_count, r.line_count) for r in src.history_files(spark, str(tmp_path / "*.csv"), multi_line).collect()}
        assert report == {"a.csv": ("imported", 399, 399), "b.csv": ("imported", 2, 2), "c.csv": ("refused", 1, 0), "d.csv": ("empty", 0, 0)}
        first = profiles.dedupe_history(read).filter("buyer_name = 'b2'").collect()
        assert [(r.source_file.rsplit("/", 1)[1], r.line_key, r.copies) for r in first] == [("a.csv", 3, 2)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_rule_and_taxonomy_and_profile_files(spark, tmp_path):
    names = src.FORMAL_COLUMNS.split()
    (tmp_path / "rules.csv").write_text("﻿" + ",".join(names) + "\nR1,s,foo、bar,Foo,机动车,1%,b,c,e,high,ready\nR2,s,baz,Baz,机动车,1%,b,c,e,high,pending\n", encoding="utf-8")
    rules = src.read_rules(spark, str(tmp_path / "rules.csv"), "formal").collect()
    assert [(r.entry_id, r.raw_alias, r.tier) for r in rules] == [("R1", "foo、bar", 2)]
    (tmp_path / "tax.csv").write_text("official_code,official_name,category_short_name,description\n1, a ,b,c\n2,,b,c\n", encoding="utf-8")
    assert [(r.official_code, r.official_name) for r in src.read_taxonomy(spark, str(tmp_path / "tax.csv")).collect()] == [("1", "a")]
    assert src.read_taxonomy(spark, str(tmp_path / "tax.csv"), "official_code").count() == 2
    sellers = spark.createDataFrame([("s", "1")], "seller_name string, seller_tax_id string")
    projects = sellers.select("*", *[F.lit(c).alias(c) for c in profiles.PROJECT], F.lit(3).cast("bigint").alias("line_count"), F.lit("high").alias("confidence"))
    buyers = sellers.select("*", *[F.lit(c).alias(c) for c in profiles.BUYER], F.lit(2).cast("bigint").alias("line_count"))
    for _ in range(2):
        src.write_profiles(str(tmp_path / "out"), sellers, projects, buyers, profiles.profile_documents(projects, buyers))
    back = src.read_profiles(spark, str(tmp_path / "out" / "documents")).collect()
    assert [(r.seller_name, r.project_profiles[0].line_count, r.buyer_profiles[0].line_count, bool(r.updated_at)) for r in back] == [("s", 3, 2, True)]
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "buyer_profiles")).count() == 1


def test_profiles_of_one_batch_in_order(spark, tmp_path):
    doc = lambda n: {"seller_name": f"s{n}", "seller_tax_id": "id", "buyer_profiles": [{"buyer_name": "b", "buyer_tax_id": "x", "line_count": n}, {"buyer_name": "b", "buyer_tax_id": "x", "line_count": n + 100}]}
    put_lines(tmp_path / "in" / "a.jsonl", [doc(i) for i in range(30)])
    out = str(tmp_path / "out")
    jobs.profile_upserts(jobs.read_profile_stream(spark, str(tmp_path / "in")), out, str(tmp_path / "cp"), "t").awaitTermination()
    assert [r.seller_name for r in jobs.current_profiles(spark, out, "seller").collect()] == ["s29"]
    assert [r.line_count for r in jobs.current_profiles(spark, out, "buyer").collect()] == [129]
