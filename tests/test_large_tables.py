"""Jobs whose plans have to hold on larger tables: what they send, how far they read, and the same rows as before."""

import itertools
import random

from pyspark.sql import functions as F

from sparkledger.functions import skew
from sparkledger.operators import history, matching


def sent(df, *columns):
    """The broadcast joins of the plan on these columns."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.split("\n") if "BroadcastHashJoin" in x and any(f"{c}#" in x for c in columns)]


def test_contained_in_sends_no_places_and_takes_long_anchors(spark, monkeypatch):
    for name in ("FEW_KEYS", "MANY_KEYS"):
        monkeypatch.setattr(skew, name, 10)
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("ab有") for _ in range(n))
    texts = [(i, word(rng.randrange(0, 900))) for i in range(10)]
    keys = [word(rng.randrange(1, 14)) for _ in range(300)] + [texts[1][1][40:60], texts[2][1][505:530]]
    want = {(i, k) for (i, t), k in itertools.product(texts, set(keys)) if k in t}
    t, k = spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame([(x,) for x in keys], "k string")
    for long_text in (False, True):
        found = skew.contained_in(t, "id", "t", k, "k", long_text)
        assert not sent(found, "_gram")
        assert {(r.id, r.k) for r in found.collect()} == want


def test_match_subjects_sends_no_names(spark):
    a = spark.createDataFrame([("Red Mill/91310000MA1FL0000X",), ("Blue",), (None,)], "a string")
    b = spark.createDataFrame([("red mill co",), ("BLUE",), ("green",), ("",)], "b string")
    pairs = matching.match_subjects(a, b, "a", "b")
    assert {tuple(r) for r in pairs.collect()} == {("Red Mill/91310000MA1FL0000X", "red mill co"), ("Blue", "BLUE")}
    assert not sent(pairs, "_ka", "_kb")


def test_resolve_buyers_reads_a_wording_once_per_scope(spark):
    texts = [(1, "s", "for 沈阳某某公司 now"), (2, "s", "for 沈阳某某公司 now"), (3, "t", "for 沈阳某某公司 now"), (4, "s", None), (None, "s", "沈阳某某公司"), (5, None, "沈阳某某公司"), (6, "s", "沈阳"), (6, "s", "大连其他公司")]
    buyers = [("s", "沈阳某某公司", "A", 1), ("s", "大连其他公司", "B", 2), ("t", "某某公司", "C", 1)]
    found = history.resolve_buyers(spark.createDataFrame(texts, "text_id int, scope string, text string"), spark.createDataFrame(buyers, "scope string, buyer_name string, buyer_tax_id string, pos int"))
    assert not sent(found, "said", "alias_key", "buyer_name", "text")
    assert {(r.text_id, r.matched_alias, r.buyer_tax_id) for r in found.collect()} == {(1, "沈阳某某公司", "A"), (2, "沈阳某某公司", "A"), (3, "某某公司", "C"), (6, "大连其他公司", "B")}


def test_computed_columns_are_not_copied_into_filters(spark):
    from sparkledger.functions.kept import computed

    df = spark.createDataFrame([(" a ", 1), ("b", 2)], "t string, n int")
    out = computed(df, t=F.regexp_replace("t", "a", "x"), u=F.col("n") + 1).filter((F.col("t") != "") & ~F.col("t").contains("y"))
    assert df.columns + ["u"] == ["t", "n", "u"] and sorted(out.columns) == ["n", "t", "u"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    assert {(r.t, r.n, r.u) for r in out.collect()} == {(" x ", 1, 2), ("b", 2, 3)}


def test_split_amounts_shuffles_marks_twice(spark):
    from sparkledger.operators import extract

    rows = [
        (1, "科技 一个点\n金额：\n100\n20.5\n20.5\n完\n77"), (2, "1% 服务\n88\nx\n7.5"), (3, "3%\n1\n2"), (4, "服务 1%\n金额\n5\n完\n6\n1234567"), (5, "服务 1%\n\n金额:\n 5 \n金额\n6.1\r\n9"), (6, "服务 1%\n5\n5.00"),
        (7, None), (None, "服务 1%\n5\n6"), (8, "服务 1%\n5"), (8, "服务 1%\nx\n6"),
    ]
    found = extract.split_amounts(spark.createDataFrame(rows, "doc_id int, text string"))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2
    want = [(1, 2, "100.00"), (1, 3, "20.50"), (2, 1, "88.00"), (2, 3, "7.50"), (4, 2, "5.00"), (4, 4, "6.00"), (5, 2, "5.00"), (5, 4, "6.10"), (5, 5, "9.00"), (8, 1, "5.00"), (8, 1, "5.00"), (8, 2, "6.00"), (8, 2, "6.00")]
    assert sorted((r.doc_id, r.n, r.amount_with_tax) for r in found.collect()) == want


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_resolved_codes_come_from_written_tables(spark):
    from sparkledger.operators import taxonomy

    lines = [(1, "", "Red Mill", ""), (2, "", "red-mill", "1010000000000000000"), (3, "FOOD", "x", ""), (4, None, None, None), (5, "", "", " "), (6, "food ", "Red Mill", "1020000000000000000")]
    tree = [("1010000000000000000", "food", "FOOD", ""), ("1010100000000000000", "其他food", "FOOD", ""), ("1020100000000000000", "red mill", "MILL", "")]
    df = spark.createDataFrame(lines, "line_no int, tax_category string, project_name string, tax_code string")
    found = taxonomy.resolve_codes(df, spark.createDataFrame(tree, "official_code string, official_name string, category_short_name string, description string"))
    # Neither side of a join with the lines holds an aggregate, so a hot key can be split or is not shuffled at all.
    assert "Aggregate" not in plan_of(found) and "Generate" not in plan_of(found)
    want = {1: "1020100000000000000", 2: "1010000000000000000", 3: "1010100000000000000", 4: "", 5: "", 6: "1020000000000000000"}
    assert {r.line_no: r.resolved_code for r in found.collect()} == want


def test_looked_up_sends_few_rows_only(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, ""), (4, None), (5, "a")], "n int, k string")
    table = spark.createDataFrame([("a", 7), ("c", 8)], "k string, v int")
    for most, join in ((1 << 16, "BroadcastHashJoin"), (1, "SortMergeJoin")):
        monkeypatch.setattr(skew, "FEW_ROWS", most)
        found = skew.looked_up(rows, table, "k")
        assert join in found._jdf.queryExecution().executedPlan().toString()
        assert {(r.n, r.v) for r in found.collect()} == {(1, 7), (2, None), (3, None), (4, None), (5, 7)}


def test_wordings_are_matched_once_and_meet_their_lines_by_text(spark):
    from sparkledger.operators import coding

    rules = [(1, "L", "blue mill", "B", "", "6%", "x", "blue"), (0, "T", "red mill", "R", "", "1%", "y", "red")]
    rules = spark.createDataFrame(rules, "tier int, entry_id string, normalized_invoice_name string, tax_category string, tax_code string, tax_treatment_or_rate string, source_label string, raw_alias string")
    lines = spark.createDataFrame([(1, "Blue wheel", "c"), (2, "", "c"), (3, "", "d"), (4, None, "e"), (5, "iron wheels", "c"), (6, "", None)], "n int, project_name string, context_id string")
    contexts = spark.createDataFrame([("c", "a blue one"), ("c", "a red one"), ("d", "a blue one"), ("e", None), (None, "a red one")], "context_id string, context_text string")
    found = coding.match_rules(lines, rules, contexts)
    assert "Generate" not in plan_of(found)
    got = {r.n: r.rule and (r.rule.entry_id, r.rule.score) for r in found.collect()}
    assert got == {1: ("L", 90), 2: ("T", 55), 3: ("L", 55), 4: None, 5: None, 6: None}


def test_history_copies_travel_by_a_digest(spark):
    from sparkledger.operators import profiles

    names = "source_file line_key seller_tax_id seller_name buyer_tax_id buyer_name serial invoice_date full_item_name project_name tax_code tax_rate".split()
    row = lambda f, k, seller="S 1", date="2024-01-01": (f, k, "1", seller, "2", "b", "9", date, "*x*y", "y", "10", "6%", 1.0, 0.1, 1.1)
    rows = [row("b", "1"), row("a", "2", "s1"), row("a", "3", date=None), row("a", "4", date=""), row("a", "5", "1S"), row("a", "6", date=None)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names) + ", amount double, tax_amount double, amount_with_tax double")
    whole, few = profiles.dedupe_history(df), profiles.dedupe_history(df, columns=("line_key",))
    assert whole.columns == [*df.columns, "copies"] and few.columns == ["line_key", "copies"]
    for found in (whole, few):
        assert "hashpartitioning(_key" in found._jdf.queryExecution().executedPlan().toString()
        assert {(r.line_key, r.copies) for r in found.collect()} == {("2", 2), ("3", 2), ("4", 1), ("5", 1)}
    assert {r.seller_name for r in whole.collect()} == {"s1", "S 1", "1S"}


def test_diff_drafts_joins_the_lines_once(spark):
    from sparkledger.operators import quality
    from sparkledger.operators.coding import LINE

    heads = lambda note: spark.createDataFrame([("d", *["h"] * (len(quality.HEADER_LABELS) - 1), note)], ", ".join(f"{c} string" for c in ("draft_id", *quality.HEADER_LABELS)))
    lines = lambda *rows: spark.createDataFrame([("d", n, v, *["x"] * (len(LINE) - 2), None) for n, v in rows], "draft_id string, line_no bigint, " + ", ".join(f"{c} string" for c in LINE))
    found = quality.diff_drafts(heads("a"), heads("b"), lines((1, "p"), (2, "q"), (3, "r")), lines((2, "q"), (3, "s"), (4, "t")))
    assert plan_of(found).count("Join ") == 2
    got = {(r.line_no, r.field_name): (r.before[:1], r.after[:1]) for r in found.collect()}
    assert got == {(0, "备注"): ("a", "b"), (1, "第 1 行"): ("{", "已"), (3, "第 3 行项目名称"): ("r", "s"), (4, "第 4 行"): ("空", "{")}


def test_lines_to_dedupe_travel_by_a_digest(spark):
    names = "project_name specification quantity unit_price amount_with_tax".split()
    rows = [(3, "a", "", "1", "2", "2"), (1, " a ", "", "1", "2", "2.00"), (2, "", "a", "1", "2", "2"), (4, None, "a", "1", "2", "2"), (5, "a", "", "1", "2", "3")]
    found = matching.dedupe_lines(spark.createDataFrame(rows, "line_no int, " + ", ".join(f"{n} string" for n in names)), [], ["line_no"])
    assert "hashpartitioning(_key" in found._jdf.queryExecution().executedPlan().toString()
    assert {r.line_no for r in found.collect()} == {1, 2, 5}


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_strip_looks_at_the_ends_only(spark):
    from sparkledger.functions import text as T

    chars = spark.range(0x10000).filter("id < 55296 or id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    texts = chars.select("c", F.concat("c", F.lit(" a"), "c", F.lit("b "), "c").alias("t"))
    by_pattern = F.regexp_replace("t", r"(?U)^\s+|\s+$", ""), F.regexp_replace("t", r"(?U)\s+", "")
    odd = texts.select("c", T.strip("t").alias("a"), T.squeeze("t").alias("b"), by_pattern[0].alias("x"), by_pattern[1].alias("y")).filter("a <> x or b <> y")
    assert odd.collect() == []
    assert "regexp" not in optimized(texts.select(T.strip("t"))).split("Project")[1]
    assert spark.createDataFrame([(None,), ("　",)], "t string").select(T.strip("t").alias("s")).collect() == [("",), ("",)]


EVENTS = [
    ("T", "C", 1, "draft_created", "t1", '{"extract_strategy":"rules_only","material_summary":{"file_names":["a.png","b.pdf"]}}'),
    ("T", "C", 2, "batch_smart_code_completed", "t2", '{"smart":1}'),
    ("T", "C", 3, "draft_created", "t3", None),
    ("T", None, 4, "odd", "t4", "{"),
]


def test_payloads_of_a_case_are_read_once(spark):
    from sparkledger.operators import events as ev

    rows = spark.createDataFrame(EVENTS, "tenant string, case_id string, seq bigint, event_type string, created_at string, payload string")
    rolled, steps = ev.case_rollups(rows), ev.workflow_steps(rows)
    assert "from_json" not in optimized(rolled) and "from_json" not in optimized(steps)
    one = rolled.filter("case_id = 'C'").first()
    assert (one.capabilities, one.files, one.actions) == (["rules_only", "tax_code_router", "llm_taxonomy"], ["a.png", "b.pdf"], ["生成单张草稿", "点击批量智能赋码/复核"])
    assert steps.filter("case_id = 'C' and phase = 'draft'").first().last_at == "t3"


def test_learned_edits_are_joined_once(spark):
    from sparkledger.operators import coding

    schema = "draft_id string, line_no int, project_name string, tax_category string, tax_code string, tax_rate string"
    before = spark.createDataFrame([("d", 1, " pen", "x", "", "3%"), ("d", 2, "ink", "x", "1", None)], schema)
    after = spark.createDataFrame([("d", 1, "pen ", "y", "7", "0.13"), ("d", 2, "ink", "x", "1", "3％"), ("e", 1, "cap", "z", "", "")], schema)
    rules = spark.createDataFrame([("K", "cap", "z", "", "3%", "ready")], "rule_id string, raw_alias string, tax_category string, tax_code string, tax_treatment_or_rate string, status string")
    learned = coding.learn_rules(before, after, rules)
    assert "b_tax_rate" not in optimized(learned)
    assert {(r.raw_alias, r.status, r.tax_treatment_or_rate) for r in learned.collect()} == {("pen", "ready", "13%"), ("cap", "merged", "3%")}


def test_sheet_headers_are_tokenised_once(spark):
    from sparkledger.operators import extract

    rows = [("s", 1, 0, ["note", ""]), ("s", 1, 1, ["序号", "商品名称（必填）", "金额", "税率(%)", None]), ("s", 1, 2, ["1", " 2、pen ", "￥1,5", "13", ""]), ("s", 1, 3, ["2", "合计", "15", "", ""]), ("t", 1, 0, None)]
    lines = extract.table_to_lines(spark.createDataFrame(rows, "source string, sheet int, row bigint, cells array<string>"))
    assert optimized(lines).count("%]+, ") <= 1  # the pattern of a header's token
    assert [(r.project_name, r.amount_with_tax, r.tax_rate, r.unit) for r in lines.collect()] == [("pen", "15.00", "13%", "项")]


def test_remarks_and_invoice_lines_are_cut_once(spark):
    from sparkledger.operators import extract

    text = "备注：合同 7\n第二行\n数量 3\n开票人 x\n项目名称：沈阳市项目部\n顷\n顺目地址：大连"
    notes = extract.extract_notes(spark.createDataFrame([(1, text), (2, None), (2, "项目地址:a")], "doc_id int, text string"))
    assert "split(" not in optimized(notes)
    assert sorted((r.doc_id, r.note) for r in notes.collect()) == [(1, "合同 7\n第二行\n项目名称:沈阳市项目部\n项目地址:大连"), (2, "项目地址:a"), (2, "项目地址:a")]
    heads = spark.createDataFrame([("i", "10", "", "专用"), ("j", "-1", "", ""), (None, "1", "", "")], "invoice_no string, total_amount string, positive_flag string, kind_text string")
    items = spark.createDataFrame([("i", "*c*n", "3", ""), ("i", "**m**", "2", "6%"), ("i", "", "2", ""), ("j", "k", "x", "")], "invoice_no string, full_item_name string, amount_with_tax string, tax_rate string")
    whole = matching.assemble_invoices(heads, items)
    assert "split(" not in optimized(whole)
    assert {(r.invoice_no, r.line_count, r.tax_category, r.project_name, r.amount_with_tax, r.tax_rate) for r in whole.collect()} == {("i", 2, "c", "n", "3.00", "1%"), ("i", 2, "", "m", "2.00", "6%"), ("j", 0, None, None, None, None)}


def test_history_is_read_once_for_items(spark):
    row = "scope string, project_name string, tax_category string, tax_code string, tax_rate string, unit string, specification string, quantity string, line_count bigint, copies bigint, pos bigint"
    rows = spark.createDataFrame([("s", "red pen", "c", "1", "0.13", "", "", "2", 1, 1, 1), ("s", "Red Pen", "c", "1", "13%", "", "", "2", 1, 1, 2), ("s", "blue ink", "c", "2", "6%", "", "", "1", 1, 1, 3)], row)
    ranked = history.ranked_rows(rows, ["pos"])
    found = history.fuzzy_history(spark.createDataFrame([("s", "BESTREDPEN", ""), ("s", "服务费", ""), ("t", "X", "")], "scope string, key string, text_id string"), ranked)
    assert "LogicalRDD" not in optimized(found)
    assert {r.key: r.project_name for r in found.collect()} == {"BESTREDPEN": "red pen"}


def test_apply_history_sends_no_history(spark, monkeypatch, tmp_path):
    """Files of history hold it in a twentieth of its bytes, so neither it nor the large tables that it is read from are sent, however small they look."""
    from sparkledger.functions.kept import kept_table
    from sparkledger.plans import views

    row = ("s1", "steel ring", "SMALL", "101", "13%", "箱", "B1", "2", 1, 1, "p1")
    rows = spark.createDataFrame([row, (*row[:1], "red bolt", *row[2:-1], "p2")], "scope string, project_name string, tax_category string, tax_code string, tax_rate string, unit string, specification string, quantity string, line_count bigint, copies bigint, pos string")
    asks = [("s1", "t", 1, "steel ring"), ("s1", "t", 2, "best red bolt"), ("s1", "t", 3, "服务费"), ("s2", "t", 4, "steel ring"), ("s1", "t", 5, "")]
    lines = spark.createDataFrame([(*a, "", "", "", "", "", "", "") for a in asks], "scope string, text_id string, line_no int, project_name string, tax_rate string, tax_category string, specification string, unit string, quantity string, tax_code string, coding_reference string")
    ranked = history.ranked_rows(kept_table(rows, "rows"), ["pos"])
    assert not sent(ranked, "scope", "pos")
    out = history.apply_history(lines, ranked)
    assert not [x for x in sent(out, "scope", "key", "_key", "text_id", "p") if "_gram#" not in x]  # anchors of few names are sent
    assert {(r.line_no, r.project_name, r.tax_code) for r in out.collect()} == {(1, "steel ring", "101"), (2, "best red bolt", "101"), (3, "服务费", ""), (4, "steel ring", ""), (5, "", "")}
    spark.createDataFrame([(1, "steel ring")], "p_partkey bigint, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    read = spark.read.parquet(f"{tmp_path}/part.parquet")
    join = lambda: spark.range(3).join(views.merged_if_large(read), F.col("id") == F.col("p_partkey"))
    assert sent(join(), "p_partkey")
    monkeypatch.setattr(views, "SENT_BYTES", 0)
    assert not sent(join(), "p_partkey") and [r.p_name for r in join().collect()] == ["steel ring"]


def test_cut_pointers_ask_only_lines_that_a_chain_can_reach(spark):
    """A target is looked for where the targets before it and itself end, not at every pair of lines that lie it apart."""
    from pyspark.sql import functions as F

    rng = random.Random(11)
    lines, want = [], {}
    for i in range(40):
        amounts = [rng.choice([0.0, 0.01, 0.5, 1.0, 1.0, 2.0, 7.25]) for _ in range(rng.randrange(2, 30))]
        cuts = sorted(rng.sample(range(1, len(amounts)), min(len(amounts) - 1, rng.randrange(1, 6)))) if i % 5 else [1]
        lines += [(f"i{i}", n, a) for n, a in enumerate(amounts)]
        want[f"i{i}"] = [round(sum(amounts[a:b]) + rng.choice([-0.01, 0.0, 0.0, 0.01]), 2) for a, b in zip([0, *cuts], [*cuts, len(amounts)], strict=True)]
    targets = [(i, k, t) for i, ts in want.items() for k, t in enumerate(ts)] + [("i3", 1, 1.0), ("i4", 0, None), ("i4", None, 1.0), ("i6", -1, 5.0)]
    cents = F.round(F.col("t").cast("decimal(28,2)") * 100).cast("decimal(38,0)").alias("cents")
    asked = spark.createDataFrame(targets, "invoice_no string, k int, t double").select("invoice_no", "k", cents)
    runs, sums = {}, []
    for i, n, a in lines:
        runs[i] = runs.get(i, 0) + round(a * 100)
        sums.append((i, n, runs[i]))
    table = spark.createDataFrame(sums, "invoice_no string, line_no bigint, run bigint").withColumn("run", F.col("run").cast("decimal(38,0)"))
    pointers = matching.cut_pointers(table, asked)
    # Every chain of cuts from the first line, step by step over all pairs.
    reached = {(i, 0, None, 0) for i in want}
    plain, place = set(), {(i, n): r for i, n, r in sums}
    while reached:
        further = set()
        for i, k, start, run in reached:
            for t in {round(x * 100) for j, q, x in targets if j == i and q == k and x is not None}:
                stops = [n for j, n, r in sums if j == i and abs(r - run - t) <= 1 and (start is None or n > start)]
                further |= {(i, k, start, n) for n in stops[:1]}
        least = {}
        for i, k, start, n in further:
            least[i, k, start] = min(n, least.get((i, k, start), n))
        fresh = {(*key, n) for key, n in least.items()} - plain
        plain |= fresh
        reached = {(i, k + 1, n, place[i, n]) for i, k, _, n in fresh}
    found = {(r.invoice_no, r.k, r.start, r.stop) for r in pointers.collect()}
    assert len(plain) > 60 and plain <= found
    repeated = spark.createDataFrame([("a", n, 100 * (n + 1)) for n in range(200)], "invoice_no string, line_no bigint, run bigint").withColumn("run", F.col("run").cast("decimal(38,0)"))
    three = spark.createDataFrame([("a", k, 6000 if k < 3 else 2000) for k in range(4)], "invoice_no string, k int, cents int").withColumn("cents", F.col("cents").cast("decimal(38,0)"))
    assert matching.cut_pointers(repeated, three).count() == 4


def test_least_by_holds_each_value_once(spark):
    from sparkledger.functions import skew

    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["f1", "f2", None]), rng.choice([1, 2, 3, None]), f"x{n}") for n in range(60)]
    df = spark.createDataFrame(rows, "k string, file string, n int, value string")
    least = skew.least_by(df, ["k"], ["file", "n"], count_as="copies")
    assert least.columns == ["k", "file", "n", "value", "copies"]
    top = lambda r: ((r[1] is not None, r[1] or ""), (r[2] is not None, r[2] or 0), r[3])
    want = {(*min((r for r in rows if r[0] == k), key=top), sum(r[0] == k for r in rows)) for k in ("a", "b", None)}
    assert {tuple(r) for r in least.collect()} == want
    mapped = df.withColumn("m", F.create_map("k", "n")).filter("k is not null")
    assert skew.least_by(mapped, ["k"], ["file", "n"]).count() == 2


def test_dedupe_history_reads_both_exports_at_once(spark, tmp_path):
    from datetime import datetime

    from sparkledger.operators import profiles
    from sparkledger.plans import views

    day = datetime(1996, 9, 13)
    tables = {
        "lineitem": ([(o, 1, 1, n, 2.0, 10.0 * n, 0.1, 0.05, "N", "O", day) for o in (1, 2, 3) for n in (1, 1, 2)], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
        "orders": ([(1, 1, "F"), (2, 1, "O"), (3, 1, None)], "o_orderkey bigint, o_custkey bigint, o_orderstatus string"), "customer": ([(1, "c")], "c_custkey bigint, c_name string"),
        "supplier": ([(1, "s")], "s_suppkey bigint, s_name string"), "part": ([(1, "steel ring", "Brand#7", "LARGE", 1, 9.0)], "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    both = views.view(spark, str(tmp_path), "hist_exports")
    for name in tables:
        spark.read.parquet(f"{tmp_path}/{name}.parquet").createOrReplaceTempView(name)
    stated = spark.sql(views.with_views("SELECT * FROM hist_exports"))
    assert both.schema.simpleString() == stated.schema.simpleString() and both.count() == 12
    assert both.exceptAll(stated).isEmpty() and stated.exceptAll(both).isEmpty()
    found = profiles.dedupe_history(both, columns=("source_file", "line_key", "seller_name"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey#") and plan.count("Relation [l_orderkey#") == 1
    assert "min_by" not in plan
    assert sorted((r.source_file, r.line_key[:12], r.copies) for r in found.collect()) == [("export_1.csv", f"{o:012d}", c) for o, cs in ((1, (2, 4)), (2, (1, 2)), (3, (1, 2))) for c in cs]


def test_table_to_lines_sends_cells_once(spark):
    """A header is told where its row is read; only places go to the shuffle for the first rows of a sheet, and what all lines have alike does not go at all."""
    from sparkledger.operators import extract

    head, line = ["序号", "项目名称", "数量", "含税总价（元）"], ["1", "螺栓", "2", "10.5"]
    rows = [("a", 0, n, ["x", None, "合计", "螺栓"]) for n in range(5)] + [("a", 0, 5, head), ("a", 0, 6, line), ("a", 0, 7, line), ("a", 0, 8, head), ("a", 0, None, head), (None, 0, 1, head), (None, 0, 2, line)]
    rows += [("late", 0, n, None if n % 2 else ["", "-"]) for n in range(50)] + [("late", 0, 50, head), ("late", 0, 51, line)]
    rows += [("last", 0, n, ["", "-"]) for n in range(49)] + [("last", 0, 49, head), ("last", 0, 50, line), ("last", 1, 1, line)]
    rows += [("none", 0, None, ["-"]) for n in range(50)] + [("none", 0, 1, head), ("none", 0, 2, line)]  # rows without a place stand first
    df = spark.createDataFrame(rows, "source string, sheet int, row bigint, cells array<string>")
    found = extract.table_to_lines(df)
    assert {(r.source, r.row, r.project_name, r.quantity, r.amount_with_tax, r.tax_code, r.coding_reference[:5]) for r in found.collect()} == {(s, n, "螺栓", "2", "10.50", "", "Excel") for s, n in (("a", 6), ("last", 50))}
    assert {r.source for r in extract.table_to_lines(df, None).collect()} == {"a", "late", "last", "none"}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.split("\n") if "WindowGroupLimit" in x or "Window [" in x]
    assert windows and not [x for x in windows if "cells" in x or " h#" in x] and "tokens" not in plan.split("Window [")[-1]
    aggregates = [x for x in plan.split("\n") if "Aggregate [" in x and "project_name" in x]
    assert aggregates and not [x for x in aggregates if "coding_reference" in x.split("min(struct")[-1] or "tax_code" in x.split("min(struct")[-1]]


def test_profile_rows_reads_buyers_and_items_once(spark):
    """The plan behind the buyers and items ends at a table of what is asked for; their readers do not go through the history again."""
    items = spark.createDataFrame([("s", "1", "steel ring", "SMALL", "101", "13%", "", 2, 7), ("t", "2", "bolt", "SMALL", "102", "6%", "箱", 1, 7)], "seller_name string, seller_tax_id string, project_name string, tax_category string, tax_code string, tax_rate string, unit string, line_count bigint, marker int")
    buyers = spark.createDataFrame([("s", "1", b, f"id {b}", 7) for b in "abb"] + [("t", "2", "c", None, 7), (None, "2", "d", "id d", 7)], "seller_name string, seller_tax_id string, buyer_name string, buyer_tax_id string, marker int")
    requests = spark.createDataFrame([("r1", "s", "", ""), ("r2", "s", "", "id a"), ("r3", "1", "b", ""), ("r4", "s", "x", ""), ("r5", "2", "", "")], "scope string, seller string, buyer_name string, buyer_tax_id string")
    rows = history.profile_rows(requests, items.filter("marker = 7"), buyers.filter("marker = 7"))
    assert "marker" not in rows._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.scope, r.part, r.project_name, r.unit, r.quantity, r.line_count, r.copies, r.buyer_name) for r in rows.collect())
    item = lambda scope, copies, name="steel ring", unit="项", count=2: (scope, 0, name, unit, "1", count, copies, "")
    only = lambda scope, buyer: (scope, 1, "", "", "", 1, 1, buyer)
    assert got == sorted([item("r1", 3), item("r2", 1), item("r3", 2), item("r4", 1), item("r5", 1, "bolt", "箱", 1), *[only("r1", b) for b in "abb"], only("r2", "a"), only("r3", "b"), only("r3", "b"), only("r5", "c")])


def test_context_rules_read_the_lines_once(spark):
    """Whether a text is asked for is told by spellings and written; its readers do not go through all lines again."""
    from sparkledger.operators import coding

    rules = spark.createDataFrame([(1, "e1", "steel goods", "metal", "101", "13%", "rules", "steel"), (1, "e2", "bolt goods", "metal", "102", "6%", "rules", "bolt")], "tier int, entry_id string, normalized_invoice_name string, tax_category string, tax_code string, tax_treatment_or_rate string, source_label string, raw_alias string")
    names = [None, "", "服务费", "a1", "一个很长的材料名称", " ", "x|y"]
    lines = spark.createDataFrame([(i, f"c{i}", n, 7) for i, n in enumerate(names)] + [(9, None, None, 7)], "line_no int, context_id string, project_name string, marker int").filter("marker = 7")
    contexts = spark.createDataFrame([(f"c{i}", "we bought steel here") for i in range(7)] + [("c8", "bolt"), (None, "bolt")], "context_id string, context_text string")
    aliases = coding.alias_table(rules)
    found = coding.match_rules(lines, rules, contexts)
    assert {(r.line_no, r.rule.entry_id if r.rule else None) for r in found.collect()} == {(0, "e1"), (1, "e1"), (2, "e1"), (3, "e1"), (4, None), (5, "e1"), (6, "e1"), (9, None)}
    spelt = lines.select("project_name").distinct()
    by_context = coding._context_rules(lines, spelt, contexts, aliases, "context_id")
    assert {r.context_id for r in by_context.collect()} == {f"c{i}" for i in (0, 1, 2, 3, 5, 6)}
    assert "marker" not in by_context._jdf.queryExecution().optimizedPlan().toString()
