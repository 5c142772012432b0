"""Fixed examples of the domain, brute-force comparisons, and the incremental jobs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sparkledger.functions import skew
from sparkledger.functions import text as T
from sparkledger.operators import coding, extract, matching, quality
from sparkledger.operators import events as ev
from sparkledger.operators import history
from sparkledger.sources import tables as src
from sparkledger.streaming import jobs

LINE = coding.LINE


def lines_df(spark, rows):
    base = dict.fromkeys(LINE, "")
    data = [(r["draft_id"], r["line_no"], *[r.get(c, "3%" if c == "tax_rate" else base[c]) for c in LINE]) for r in rows]
    return spark.createDataFrame(data, "draft_id string, line_no bigint, " + ", ".join(f"{c} string" for c in LINE))


@pytest.mark.parametrize("text,want", [("一万三", "13000"), ("一千二", "1200"), ("伍佰", "500"), ("三千零五十", "3050"), ("十二", "12"), ("一二", "12"), ("两万", "20000"), ("abc", "")])
def test_chinese_amount(spark, text, want):
    assert spark.range(1).select(T.chinese_amount(F.lit(text)).alias("v")).first()[0] == want


def test_rates(spark):
    got = {v: tuple(spark.range(1).select(T.canonical_rate(F.lit(v)).alias("a"), T.sheet_rate(F.lit(v)).alias("b"), T.rate_key(F.lit(v)).alias("c")).first()) for v in ("13%", "0.13", "1%", "0.01", "", "免税", "6％")}
    assert got["13%"] == ("13%", "0.13", "13") and got["0.13"] == ("13%", "0.13", "13")
    assert got["1%"][2] == got["0.01"][2] == "1"
    assert got[""] == ("3%", "", "") and got["免税"] == ("免税", "0", "免税") and got["6％"][0] == "6%"


RULES = "tier int, entry_id string, raw_alias string, normalized_invoice_name string, tax_category string, tax_code string, tax_treatment_or_rate string, source_label string"


def rules_df(spark):
    return spark.createDataFrame(
        [(0, "t1", "记账", "代理记账", "经纪代理", "", "6%", "客户规则"), (2, "f1", "代理记账服务", "代理记账服务", "企业管理", "", "3%", "内置基础规则"), (2, "f2", "帆布袋", "帆布袋", "纺织产品", "", "1%", "内置基础规则"),
         (1, "l1", "记账", "x", "other", "", "", "本地即时规则")], RULES)


def test_rule_matching(spark):
    lines = spark.createDataFrame([("a", "代理记账服务", "c1"), ("b", "本月记账", "c1"), ("c", "A4复印纸", "c1"), ("d", "服务费", "c1"), ("e", "袋", "c2")], "draft_id string, project_name string, context_id string")
    contexts = spark.createDataFrame([("c1", "这里要帆布袋"), ("c2", "无")], "context_id string, context_text string")
    got = {r.draft_id: (r.rule.entry_id, r.rule.score) if r.rule else None for r in coding.match_rules(lines, rules_df(spark), contexts).collect()}
    # An equal name of a lower tier beats a contained alias of a higher one; ties go to the higher tier.
    assert got == {"a": ("f1", 100), "b": ("t1", 90), "c": None, "d": ("f2", 55), "e": ("f2", 88)}


def test_pattern_rules(spark):
    names = ["员工餐费", "丁腈检查手套", "玉米秸秆", "A4纸", "桌面文件架", "螺栓"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", coding.pattern_hint("n", F.lit("")).alias("h"))
    got = {r.n: r.h.code if r.h else None for r in df.collect()}
    assert got == {"员工餐费": "3070401000000000000", "丁腈检查手套": "1070508010000000000", "玉米秸秆": "1010111010000000000", "A4纸": "1060105020000000000", "桌面文件架": "1060401030000000000", "螺栓": None}


def test_failures_and_repairs(spark):
    lines = lines_df(spark, [{"draft_id": "d", "line_no": i, "project_name": f"p{i}", "tax_rate": r} for i, r in ((1, "13%"), (2, "13%"), (3, "6%"), (4, "13%"))])
    failures = spark.createDataFrame(
        [("d", 1, "2-发票明细信息：第 4 行税率不合法，请使用如下税率：0.03、0.01、0。"), ("d", 2, "不属于涉税专业服务机构"), ("d", 3, "1-发票基本信息：购买方名称不能为空"), ("d", 4, "第 6 行税率不合法，请使用如下税率：3%")],
        "draft_id string, pos bigint, reason string")
    classified = quality.classify_failures(failures)
    first = classified.filter("pos = 1").first()
    assert first.allowed_values == ["3%", "1%", "0%"] and first.suggested_value == "3%" and first.field_name == "税率"
    targeted = quality.target_failures(classified, lines)
    new, log = quality.apply_repairs(targeted, lines)
    assert {r.line_no: r.tax_rate for r in new.collect()} == {1: "3%", 2: "3%", 3: "3%", 4: "3%"}
    assert sorted((r.pos, r.line_no, r.previous_value) for r in log.collect()) == [(1, 1, "13%"), (1, 2, "13%"), (1, 4, "13%"), (4, 3, "6%")]
    decided = {r.pos: r.repair_decision for r in quality.repair_decisions(targeted).collect()}
    assert decided == {1: "safe_auto_repair", 2: "not_auto_repairable", 3: "manual_review", 4: "safe_auto_repair"}
    report = quality.repair_report(quality.repair_decisions(targeted, log)).first()
    assert (report.applied_count, report.manual_review_count, report.non_auto_count) == (4, 1, 1)


def test_reissue(spark):
    number = "26212000000640589836"
    texts = spark.createDataFrame([("a", "s", f"dzfp_{number} 作废 开这个数16886.3"), ("b", "s", f"{number} 分三笔，金额分别为 47060 9750 16160")], "request_id string, company_name string, text string")
    asked = matching.reissue_requests(texts)
    assert {r.request_id: [float(a) for a in r.amounts] for r in asked.collect()} == {"a": [16886.30], "b": [47060.0, 9750.0, 16160.0]}
    invoices = spark.createDataFrame(
        [(number, "s", "b1", 72970.00, True, "2026-01-01"), ("n2", "s", "b1", 16886.30, True, "2026-01-02"), ("n3", "s", "b1", -16886.30, False, "2026-01-03"), ("n4", "s", "b2", 16886.30, True, "2026-01-04")],
        "invoice_no string, seller_name string, buyer_name string, total_amount double, is_positive boolean, issued_at string")
    got = {(r.request_id, r.pos): (r.invoice_no, r.matched_all) for r in matching.match_reissues(asked, invoices).collect()}
    assert got[("a", 0)] == ("n2", True) and got[("b", 0)] == (None, False)
    lines = spark.createDataFrame([(number, 1, 40000.0), (number, 2, 7060.0), (number, 3, 9750.0), (number, 4, 16160.0)], "invoice_no string, line_no bigint, amount double")
    targets = spark.createDataFrame([(number, 0, 47060.0), (number, 1, 9750.0), (number, 2, 16160.0)], "invoice_no string, target_pos int, target double")
    assert [r.group_no for r in matching.split_by_targets(lines, targets).orderBy("line_no").collect()] == [0, 0, 1, 2]
    bad = targets.withColumn("target", F.col("target") + 1)
    assert matching.split_by_targets(lines, bad).count() == 0


def plain_cuts(amounts, targets):
    """Group of each line, None for the lines that no run takes; None where the targets don't cut the invoice."""
    if len(targets) == 1:
        return [0] * len(amounts)
    groups, at = [None] * len(amounts), 0
    for k, target in enumerate(targets):
        run, first = 0, at
        while at < len(amounts):
            run += abs(round(amounts[at] * 100))
            groups[at] = k
            at += 1
            if abs(run - round(target * 100)) <= 1:
                break
        if at == first:
            return None
    return groups


def test_cuts_against_brute_force(spark):
    rng = random.Random(8)
    lines, targets, want = [], [], {}
    for i in range(80):
        no, amounts = f"i{i}", [rng.choice([1.0, 2.0, -1.5, 0.01, 3.25, 0.0]) for _ in range(rng.randrange(1, 25))]
        places = sorted(rng.sample(range(1, len(amounts) + 1), rng.randrange(0, min(6, len(amounts))))) + [len(amounts)]
        cuts = [sum(abs(a) for a in amounts[lo:hi]) + rng.choice([0, 0, 0.01, -0.01]) for lo, hi in zip([0, *places], places, strict=False)]
        if rng.random() < 0.3:
            cuts[rng.randrange(len(cuts))] += 50
        lines += [(no, 10 * n, a) for n, a in enumerate(amounts)]
        targets += [(no, k, round(float(t), 2)) for k, t in enumerate(cuts)]
        for n, group in enumerate(plain_cuts(amounts, [round(t, 2) for t in cuts]) or []):
            if group is not None:
                want[no, 10 * n] = group
    long = [(("long", n, 1.0)) for n in range(1500)]
    got = matching.split_by_targets(spark.createDataFrame(lines + long, "invoice_no string, line_no bigint, amount double"),
                                    spark.createDataFrame(targets + [("long", k, 3.0) for k in range(500)], "invoice_no string, target_pos int, target double"))
    assert {(r.invoice_no, r.line_no): r.group_no for r in got.collect()} == {**want, **{("long", n): n // 3 for n in range(1500)}}


def test_reissues_fall_back_to_the_original(spark):
    a, b = "1" * 20, "2" * 20
    texts = spark.createDataFrame([("r1", "co", f"{a} 重开 金额分别为 47060 9750 16160"), ("r2", "co", f"{b} 开这个数 70.5 重开"), ("r3", "co", f"{b} 重开 金额分别为 3 4")], "request_id string, company_name string, text string")
    invoices = spark.createDataFrame([(a, "co", "x", 72970.0, False, "2024-01-01"), (b, "co", "x", 50.0, True, "2024-01-01"), ("3" * 20, "co", "x", 70.5, True, "2024-01-02")],
                                     "invoice_no string, seller_name string, buyer_name string, total_amount double, is_positive boolean, issued_at string")
    lines = spark.createDataFrame([(a, 1, 40000.0, "p"), (a, 2, 7060.0, "q"), (a, 3, 9750.0, "r"), (a, 4, 16160.0, "s"), (b, 1, 50.0, "t"), ("3" * 20, 1, 70.5, "u")], "invoice_no string, line_no bigint, amount double, name string")
    got = matching.reissue_lines(matching.reissue_requests(texts), invoices, lines).collect()
    assert sorted((r.request_id, r.group_no, r.source_no[0], r.name) for r in got) == [("r1", 0, "1", "p"), ("r1", 0, "1", "q"), ("r1", 1, "1", "r"), ("r1", 2, "1", "s"), ("r2", 0, "3", "u")]


def test_bounds_can_be_lifted(spark):
    texts = spark.createDataFrame([("r", "1" * 20 + " 重开 金额分别为 " + " ".join(str(100 + i) for i in range(14)))], "request_id string, text string")
    assert [matching.reissue_requests(texts, most).select(F.size("amounts").alias("n")).first().n for most in (10, None)] == [10, 14]
    notes = spark.createDataFrame([("d", "备注：工程一\n" + "\n".join(f"工程{i}" for i in range(9)))], "doc_id string, text string")
    assert [len(extract.extract_notes(notes, most).first().note.split("\n")) for most in (6, None)] == [6, 10]


def test_exclusive_requests_against_brute_force(spark):
    rng = random.Random(7)
    invoices = [(f"i{n:03d}", f"seller{rng.randrange(2)}", f"buyer{rng.randrange(3)}", f"id{rng.randrange(3)}", float(rng.randrange(3)), rng.random() < 0.9, f"2026-01-{rng.randrange(1, 28):02d}") for n in range(60)]
    requests = [(f"d{n % 12}", n, rng.choice(["", "seller1"]), rng.choice(["", "id0", "id1"]), rng.choice(["", "buyer1", "buyer"]), rng.choice(["", "1", "2"])) for n in range(40)]
    either = lambda a, b: not a or not b or a in b or b in a
    want = {}
    for doc in {r[0] for r in requests}:
        used, taken = set(), {}
        for _, pos, company, tax_id, name, amount in sorted(r for r in requests if r[0] == doc):
            fit = [i for i in invoices if i[5] and i[0] not in used and either(company, i[1]) and (not tax_id or i[3] == tax_id) and either(name, i[2]) and (not amount or i[4] == float(amount))]
            if not (tax_id or amount or name or company):
                fit = []
            best = min(fit, key=lambda i: (tuple(-ord(c) for c in i[6]), i[0]), default=None)
            taken[pos] = best[0] if best else None
            used.add(taken[pos])
        if all(taken.values()):
            want.update({(doc, p): i for p, i in taken.items()})
    got = matching.match_requests(
        spark.createDataFrame(requests, "doc_id string, req_pos bigint, company_name string, buyer_tax_id string, buyer_name string, amount string"),
        spark.createDataFrame(invoices, "invoice_no string, seller_name string, buyer_name string, buyer_tax_id string, total_amount double, is_positive boolean, issued_at string"))
    assert {(r.doc_id, r.req_pos): r.invoice_no for r in got.collect()} == want and want


def test_platform_blocks(spark):
    text = "[01.png]\n抬头：沈阳甲有限公司\n税号 91210102MA0ABCDE12\n开票金额 ￥25.89\n[02.png]\n抬头：大连乙有限公司\n建议开票金额 1463\n订单号：123456789012\n[03.png]\n别的\n"
    blocks = extract.split_blocks(spark.createDataFrame([("d", text)], "doc_id string, text string"))
    rows = {r.block: r for r in extract.platform_requests(blocks).collect()}
    assert len(rows) == 3 and rows[1].amount_with_tax == "25.89" and rows[2].amount_with_tax == "14.63"
    assert rows[1].buyer_name == "沈阳甲有限公司" and rows[1].buyer_tax_id == "91210102MA0ABCDE12" and rows[2].order_no == "123456789012"


def test_requests_without_invoices_make_lines(spark):
    head = "购买方信息\n{}\n纳税人识别号 {}\n销售方信息 92210102MA0ABCDE34\n开票信息\n发票类型 {}\n{}"
    texts = [
        ("d1", 1, "01_a.png", head.format("北京乙网络技术有限公司", "91110108MA0ABCDE12", "增值税专票 3%", "*现代服务*技术支持服务费 ¥ 9 合计 ￥100.505\n账单ID）20260102030405060708")),
        ("d1", 2, "02_b.png", head.format("大连丙贸易有限公司", "", "普票", "*现代服务*信息咨询服务费 ¥25")),
        ("d1", 3, "c.png", "别的 服务费 ¥25"),
        ("d2", 1, "d.png", head.format("大连丙贸易有限公司", "", "普通发票 免税", "")),
    ]
    blocks = spark.createDataFrame([(d, b, "甲", s, t) for d, b, s, t in texts], "doc_id string, block int, company_name string, source_name string, text string")
    # Written out between the steps, so that each is planned once.
    kept = lambda df: spark.createDataFrame(df.collect(), df.schema)
    asked = kept(extract.platform_invoice_blocks(blocks))
    projects = spark.createDataFrame(
        [("甲", "1", "信息咨询服务费", "现代服务", "3049900000000000000", "1%", "次", "", "1", 5), ("甲", "1", "推广服务费", "广告服务", "3040300000000000000", "6%", "项", "", "1", 9)],
        "seller_name string, seller_tax_id string, project_name string, tax_category string, tax_code string, tax_rate string, unit string, specification string, quantity string, line_count bigint")
    buyers = spark.createDataFrame([("甲", "1", "别家", "", 1)], "seller_name string, seller_tax_id string, buyer_name string, buyer_tax_id string, line_count bigint")
    rows = history.profile_rows(asked, projects, buyers).withColumn("pos", -F.col("line_count"))
    rows = kept(history.ranked_rows(rows, ["pos"]))
    invoices = spark.createDataFrame([("d2", "i1", True), ("d1", "i2", False)], "doc_id string, invoice_no string, is_positive boolean")
    made = lambda inv: {(r.doc_id, r.block): r for r in matching.lines_without_invoices(asked, inv, rows).collect()}
    got = made(invoices)
    assert set(got) == {("d1", 1), ("d1", 2)}
    one, two = got["d1", 1], got["d1", 2]
    assert (one.source_name, one.buyer_name, one.buyer_tax_id, one.invoice_kind, one.note) == ("a.png", "北京乙网络技术有限公司", "91110108MA0ABCDE12", "增值税专用发票", "202601020304050607")
    # A weak name takes that of the history, and its code; the rate stated in the request stays.
    assert (one.project_name, one.amount_with_tax, one.tax_rate, one.tax_category, one.tax_code, one.unit, one.quantity) == ("推广服务费", "100.50", "6%", "现代服务", "3040300000000000000", "项", "1")
    assert (two.project_name, two.amount_with_tax, two.tax_rate, two.tax_code, two.invoice_kind, two.buyer_tax_id) == ("信息咨询服务费", "25.00", "1%", "3049900000000000000", "普通发票", "")
    assert "历史开票档案精确匹配" in two.coding_reference and "b.png；含税金额 25.00" in two.source_excerpt
    rest = {(r.doc_id, r.block): r for r in asked.collect()}["d2", 1]
    assert (rest.amount_with_tax, rest.tax_rate, rest.project_name, rest.note) == ("", "免税", "服务费", "")


def test_stated_amount_takes_the_place_of_the_line(spark):
    texts = [("one", "这次开票金额 880.5元", ""), ("two", "这次开票金额 880元", ""), ("both", "这次 100元，不对，是 90元", ""), ("fix", "1580", "车辆维修 税率 13%"), ("none", "改成 1580", "汽修 6 %"),
             ("far", "编号 123 是以前说过的那一张单子里面写着的东西，别的什么都没有变", "汽修"), ("id", "A12345 的材料", "汽修")]
    items = [("one", 3, "螺栓", "35", "", ""), ("two", 1, "螺栓", "35", "3%", ""), ("two", 2, "纸箱", "35", "3%", ""), ("both", 1, "螺栓", "35", "3%", ""), ("fix", 1, "机油", "35", "3%", "桶"), ("fix", 2, "维修", "35", "", ""), ("far", 1, "螺栓", "35", "3%", "")]
    lines = spark.createDataFrame([(d, 1, n, a, m, r, u) for d, n, a, m, r, u in items], "doc_id string, strategy int, n bigint, project_name string, amount_with_tax string, tax_rate string, unit string")
    lines = lines.withColumns({c: F.lit("") for c in LINE if c not in lines.columns})
    out = extract.apply_stated_amount(lines, spark.createDataFrame(texts, "doc_id string, raw_text string, reference_text string"))
    got = {(r.doc_id, r.n): (r.project_name, r.amount_with_tax, r.tax_rate, r.unit, r.quantity) for r in out.collect()}
    assert out.columns == lines.columns and got == {
        ("one", 3): ("螺栓", "880.5", "1%", "项", "1"), ("two", 1): ("螺栓", "35", "3%", "", ""), ("two", 2): ("纸箱", "35", "3%", "", ""), ("both", 1): ("螺栓", "35", "3%", "", ""),
        ("fix", 1): ("机油", "35", "3%", "桶", ""), ("fix", 2): ("维修", "1580", "13%", "项", "1"), ("none", 1): ("维修费", "1580", "6%", "项", "1"), ("far", 1): ("螺栓", "35", "3%", "", "")}


def test_source_name_of_a_note(spark):
    notes = spark.createDataFrame([("x；来源图片：a b.png ；订单号：1",), ("来源图片：",), ("别的",), (None,)], "note string")
    assert [r[0] for r in notes.select(extract.source_name_of("note")).collect()] == ["a b.png", "", "", ""]


def test_steps_list_the_actions_in_trouble(spark):
    kinds = ["failure_report_uploaded", "failure_repairs_applied", "failure_report_uploaded", "batch_run_finished"]
    rows = [("t", "c", i, f"e{i}", "d", "b", k, f"2024-01-01T00:00:0{i}", "{}") for i, k in enumerate(kinds)]
    log = spark.createDataFrame(rows, "tenant string, case_id string, seq bigint, event_id string, draft_id string, batch_id string, event_type string, created_at string, payload string")
    got = {r.phase: (r.details, r.detail_count) for r in ev.workflow_steps(log).collect()}
    assert got["repair"] == (["上传/解析税局失败明细"] * 2, 2) and got["tax"] == (["税局返回处理结果"], 1) and got["draft"] == ([], 0)


def test_sheet_rate_header(spark):
    rows = [("s", 0, 0, ["工程清单"]), ("s", 0, 1, ["序号", "清单名称", "规格/项目特征", "单位", "数量", "含税总价(元)", "税率(%)"]), ("s", 0, 2, ["1", "1、钢板", "x", "", "2.50", "100", "1"]), ("s", 0, 3, ["", "合计", "", "", "", "100", ""])]
    got = extract.table_to_lines(spark.createDataFrame(rows, "source string, sheet int, row bigint, cells array<string>")).collect()
    assert len(got) == 1 and (got[0].project_name, got[0].tax_rate, got[0].quantity, got[0].unit, got[0].amount_with_tax) == ("钢板", "1%", "2.5", "项", "100.00")


def test_text_strategies(spark):
    docs = {
        "table": "项目名称\t数量\t金额\t税率\n螺栓\t2\t35\t13%\n合计\t\t35",
        "detail": "开票明细：\n1. 纸箱，规格型号：40支/箱，单位：箱，数量：59，含税金额：3,540，税率：13%",
        "chat": "老板麻烦开票\n矿泉水 3箱 120元\n",
        "free": "螺栓 3 40 120",
        "printed": "*餐饮服务*餐费 6%次 100 6\n合计 106",
    }
    got = {r.doc_id: r for r in extract.extract_lines(spark.createDataFrame(list(docs.items()), "doc_id string, text string")).collect()}
    assert {k: (v.strategy, v.project_name, v.amount_with_tax, v.tax_rate) for k, v in got.items()} == {
        "table": (1, "螺栓", "35", "13%"), "detail": (2, "纸箱", "3540", "13%"), "chat": (7, "矿泉水", "120", "3%"), "free": (10, "螺栓", "120", "3%"), "printed": (4, "餐费", "106.00", "6%")}


def test_similar_history_keeps_the_name(spark):
    rows = history.ranked_rows(spark.createDataFrame([("s", "干混抹灰砂浆", "非金属矿物制品", "1080107000000000000", "13%", "吨", "", "1", 3, 1, 0)],
                               "scope string, project_name string, tax_category string, tax_code string, tax_rate string, unit string, specification string, quantity string, line_count bigint, copies bigint, pos bigint"), ["pos"])
    line = lines_df(spark, [{"draft_id": "d", "line_no": 1, "project_name": "网采材料-干混抹灰砂浆"}]).withColumns({"scope": F.lit("s"), "text_id": F.lit("")})
    got = history.apply_history(line, rows).first()
    assert (got.project_name, got.tax_code, got.tax_rate) == ("网采材料-干混抹灰砂浆", "1080107000000000000", "13%") and "相似项目候选" in got.coding_reference


def test_learning_conflict(spark):
    before = lines_df(spark, [{"draft_id": "d", "line_no": i, "project_name": n} for i, n in ((1, "螺栓"), (2, "纸箱"), (3, "纸箱"))])
    after = lines_df(spark, [{"draft_id": "d", "line_no": 1, "project_name": "螺栓", "tax_category": "金属", "tax_code": "1"}, {"draft_id": "d", "line_no": 2, "project_name": "纸箱", "tax_category": "纸", "tax_code": "2"},
                             {"draft_id": "d", "line_no": 3, "project_name": "纸箱", "tax_category": "木", "tax_code": "3"}])
    rules = spark.createDataFrame([("r1", "螺栓", "五金", "9", "3%", "ready")], "rule_id string, raw_alias string, tax_category string, tax_code string, tax_treatment_or_rate string, status string")
    got = {r.tax_category: (r.status, r.conflict_with_rule_id) for r in coding.learn_rules(before, after, rules).collect()}
    assert got["金属"] == ("pending_review", "r1") and got["纸"][0] == "ready" and got["木"][0] == "pending_review"


def test_learning_folds_edits_onto_the_known_rule(spark):
    line = lambda i, name, **kw: {"draft_id": "d", "line_no": i, "project_name": name, **kw}
    before = lines_df(spark, [line(1, "foo"), line(2, "foo"), line(3, "new"), line(4, "New")])
    coded = {"tax_category": "cat", "tax_code": "1"}
    after = lines_df(spark, [line(1, "foo one", **coded), line(2, "foo two", **coded), line(3, "new a", **coded), line(4, "new b", **coded)])
    rules = spark.createDataFrame([("r1", "foo、bar", "cat", "1", "3%", "ready", "old:1", "FOO")], "rule_id string, raw_alias string, tax_category string, tax_code string, tax_treatment_or_rate string, status string, source_case_ids string, original_project_name string")
    got = {r.status: r for r in coding.learn_rules(before, after, rules).collect()}
    merged, ready = got["merged"], got["ready"]
    assert (merged.rule_id, merged.raw_alias, merged.normalized_invoice_name, merged.evidence) == ("r1", "foo、bar、foo one、foo two", "foo two", 2)
    assert (merged.source_case_ids, merged.original_project_name, merged.final_project_name) == ("old:1;learned:d:1;learned:d:2", "FOO", "foo two")
    assert (ready.raw_alias, ready.normalized_invoice_name, ready.source_case_ids, ready.original_project_name) == ("new、new a、new b", "new b", "learned:d:3;learned:d:4", "new")


def test_skewed_windows_equal_plain_ones(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", n, rng.randrange(9), rng.choice(["a", "b", None, None])) for n in range(400)]
    df = spark.createDataFrame(rows, "k string, pos bigint, v bigint, t string")
    total, last, want = {}, {}, {}
    for k, pos, v, t in rows:
        total[k] = total.get(k, 0) + v
        last[k] = t if t else last.get(k)
        want[pos] = (total[k], last[k])
    sums = {r.pos: r.s for r in skew.chunked_running_sum(df, ["k"], "pos", F.col("v"), "s", 17).collect()}
    filled = {r.pos: r.f for r in skew.chunked_fill_forward(df, ["k"], "pos", F.col("t"), "f", 17).collect()}
    assert {p: (sums[p], filled[p]) for p in want} == want


@pytest.mark.parametrize("count", [60, 700])
def test_contained_in_against_brute_force(spark, count):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abc有限") for _ in range(n))
    texts = [(i, word(rng.randrange(0, 1500))) for i in range(12)]
    keys = [word(rng.randrange(1, 9)) for _ in range(count)]
    want = {(i, k) for (i, t), k in itertools.product(texts, set(keys)) if k in t}
    t, k = spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame([(x,) for x in keys], "k string")
    for long_text in (False, True):
        assert {(r.id, r.k) for r in skew.contained_in(t, "id", "t", k, "k", long_text).collect()} == want


EVENTS = [("e1", "c", "d1", "", "draft_created", "2026-01-01T00:00:00", "", '{"company_name":"甲","lines":[{"project_name":"a"}]}'), ("e2", "c", "d1", "", "template_exported", "2026-01-01T00:00:01", "", '{"error_count":0}')]


def test_event_ingest_twice(spark, tmp_path):
    rows = spark.createDataFrame(EVENTS, src.EVENT_SCHEMA)
    inbox, table, log = str(tmp_path / "inbox"), str(tmp_path / "table"), str(tmp_path / "log")
    for _ in range(2):
        rows.coalesce(1).write.mode("append").json(inbox)
        jobs.ingest_events(jobs.read_event_stream(spark, inbox), table, log, str(tmp_path / "cp"), "t").awaitTermination()
    store = jobs.EventStore(spark, table, log)
    assert sorted((r.event_count, r.accepted, r.duplicates) for r in store.log.read().collect()) == [(2, 0, 2), (2, 2, 0)]
    assert store.events.read().count() == 2


def test_case_state_stream_equals_batch(spark, tmp_path):
    data = [(f"e{i}", i, "t", f"c{i % 3}", f"d{i}" if i % 2 else "", "", k, f"2026-01-01T00:00:{i:02d}", f"2026-01-01T00:00:{i:02d}", '{"company_name":"甲%d","status":"done","preview_clicked":true}' % i)
            for i, k in enumerate(["draft_created", "manual_edits_recorded", "template_exported", "batch_run_queued", "batch_run_finished", "success_recorded"] * 3)]
    schema = "event_id string, seq bigint, tenant string, case_id string, draft_id string, batch_id string, event_type string, created_at string, received_at string, payload string"
    df = spark.createDataFrame(data, schema)
    path = str(tmp_path / "in")
    df.repartition(3).write.parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = jobs.case_states(stream).writeStream.outputMode("complete").format("memory").queryName("case_states").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = ev.case_summary(df)
    live = spark.table("case_states").select(*batch.columns)
    assert sorted(map(str, live.collect())) == sorted(map(str, batch.collect()))


def test_ledger_and_files(spark, tmp_path):
    path = str(tmp_path / "ledger")
    first = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "draft_id string, line_no int, v string")
    src.write_ledger(spark, path, first, parts=4)
    src.write_ledger(spark, path, spark.createDataFrame([("a", 1, "new")], "draft_id string, line_no int, v string"), parts=4)
    assert sorted((r.draft_id, r.line_no, r.v) for r in src.read_ledger(spark, path).collect()) == [("a", 1, "new"), ("b", 1, "z")]
    inbox = tmp_path / "files"
    (inbox / "x").mkdir(parents=True)
    for name, body in (("a.png", "1"), ("x/b.png", "1"), ("c.txt", "2")):
        (inbox / name).write_text(body)
    for _ in range(2):
        jobs.file_intake(spark, str(inbox), str(tmp_path / "manifest"), str(tmp_path / "cp")).awaitTermination()
        (inbox / "d.png").write_text("1")
    got = {r.relative_path: r.status for r in spark.read.parquet(str(tmp_path / "manifest")).collect()}
    assert got == {"a.png": "candidate_only", "x/b.png": "duplicate", "c.txt": "unsupported", "d.png": "duplicate"}


def test_profile_stream(spark, tmp_path):
    doc = lambda name, n: [("s1", "id1", "", "", [("*c*p", "c", "p", "1", "3%", "", n, "high")], [(name, "b1", n)])]
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n in (1, 2):
        spark.createDataFrame(doc("buyer", n), src.PROFILE_SCHEMA).coalesce(1).write.mode("append").json(inbox)
        stream = spark.readStream.schema(src.PROFILE_SCHEMA).json(inbox)
        jobs.profile_upserts(stream, out, str(tmp_path / "cp"), "t").awaitTermination()
    assert [r.line_count for r in jobs.current_profiles(spark, out, "buyer").collect()] == [2]
    assert [(r.line_count, r.unit) for r in jobs.current_profiles(spark, out, "line").collect()] == [(2, "项")]
