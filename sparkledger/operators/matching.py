"""Linking of invoices, requests, files, batches and extraction results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import skew
from ..functions import text as T
from ..functions.kept import computed, kept_table
from . import history
from .coding import LINE
from .quality import sheet_money  # noqa: F401  (re-exported for sheet writers)
from .standardize import split_parts_name, star_parts


def assemble_invoices(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """History headers with their lines in order, one row per line; ``line_count`` tells the invoices apart.

    Kept flat on purpose: an invoice of any length stays spread over the tasks.
    """
    category, name = split_parts_name("full_item_name", F.col("_parts"))
    amount = T.money_text(T.parse_money(F.col("amount_with_tax").cast("string")), half_even=True)
    read = {"tax_category": category, "project_name": name, "amount_with_tax": amount}
    good = computed(computed(lines, _parts=star_parts("full_item_name")), **read).filter((F.col("amount_with_tax") != "") & (F.col("project_name") != ""))
    good = good.withColumn("tax_rate", T.first_filled("tax_rate", default="1%")).select(*lines.columns, *[c for c in read if c not in lines.columns])
    good = kept_table(good, "lines")  # read twice: counted, and joined
    counts = good.groupBy("invoice_no").agg(F.count(F.lit(1)).alias("line_count"))
    total = T.money_text(T.parse_money(F.col("total_amount").cast("string")), half_even=True)
    heads = headers.filter(~T.is_blank("invoice_no")).withColumn("total_amount", total).withColumns(
        {
            "is_positive": (T.strip("positive_flag") != "否") & ~F.col("total_amount").startswith("-"),
            "invoice_kind": F.when(F.col("kind_text").contains("专用"), "增值税专用发票").otherwise("普通发票"),
        }
    )
    return heads.join(counts, "invoice_no", "left").withColumn("line_count", F.coalesce("line_count", F.lit(0))).join(good, "invoice_no", "left")


def _either_way(a: Column, b: Column) -> Column:
    a, b = T.strip(a), T.strip(b)
    return (a == "") | (b == "") | a.contains(b) | b.contains(a)


def name_pairs(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b) of distinct non-blank names where either holds the other."""
    x = left.select(T.strip(a).alias(a)).filter(F.col(a) != "").distinct()
    y = right.select(T.strip(b).alias(b)).filter(F.col(b) != "").distinct()
    one = skew.contained_in(x.withColumn("_x", F.col(a)), a, "_x", y, b)
    two = skew.contained_in(y.withColumn("_y", F.col(b)), b, "_y", x, a)
    return one.select(a, b).unionByName(two.select(a, b)).distinct()


def match_subjects(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of company names that agree: equal keys, or one key inside the other."""
    x = left.select(a, T.subject_key(a).alias("_ka")).distinct()
    y = right.select(b, T.subject_key(b).alias("_kb")).distinct()
    pairs = name_pairs(x, y, "_ka", "_kb")
    # Merged: names in columns are far more than the compressed bytes that Spark would broadcast them by.
    return x.hint("merge").join(pairs, "_ka").join(y.hint("merge"), "_kb").select(a, b)


def match_requests(requests: DataFrame, invoices: DataFrame, most: int | None = None) -> DataFrame:
    """Each request takes the newest positive invoice that agrees with what it states; an invoice goes once.

    ``requests``: doc_id, req_pos, company_name, buyer_tax_id, buyer_name, amount. Requests of a document
    choose in order; if one finds nothing, the whole document gets nothing. A request can lose at most
    as many invoices as there are requests before it, so ``most`` (the largest document) candidates per
    request are always enough; it is counted when not given.
    """
    if most is None:
        most = requests.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 1
    ask = requests.select("doc_id", "req_pos", *[T.strip(c).alias(c) for c in ("company_name", "buyer_tax_id", "buyer_name")], T.parse_money("amount").cast("decimal(18,2)").alias("amount"))
    ask = ask.withColumn("req", F.struct("doc_id", "req_pos"))
    inv = invoices.filter(F.col("is_positive")).select(
        "invoice_no", F.col("seller_name").alias("i_seller"), F.col("buyer_name").alias("i_name"), F.col("buyer_tax_id").alias("i_id"), F.col("total_amount").cast("decimal(18,2)").alias("i_total"), "issued_at"
    )
    newest = [F.desc("issued_at"), F.col("invoice_no")]
    has_id, has_amount, has_name = F.col("buyer_tax_id") != "", F.col("amount").isNotNull(), F.col("buyer_name") != ""
    same_seller, same_name = _either_way(F.col("company_name"), F.col("i_seller")), _either_way(F.col("buyer_name"), F.col("i_name"))
    keep = ["req", "doc_id", "req_pos", "exact", "invoice_no", "issued_at"]

    def arm(asks: DataFrame, keys: list[str], on, exact: bool) -> DataFrame:
        # Invoices alike in every compared field: only the newest ``most`` of them can be chosen.
        short = skew.top_n(inv, list(dict.fromkeys([*keys, "i_seller", "i_name"])), newest, most)
        return asks.join(short, on).filter(same_seller & same_name).withColumn("exact", F.lit(exact)).select(*keep)

    both = arm(ask.filter(has_id & has_amount), ["i_id", "i_total"], (F.col("buyer_tax_id") == F.col("i_id")) & (F.col("amount") == F.col("i_total")), True)
    by_id = arm(ask.filter(has_id & ~has_amount), ["i_id"], F.col("buyer_tax_id") == F.col("i_id"), False)
    by_amount = arm(ask.filter(~has_id & has_amount), ["i_total"], F.col("amount") == F.col("i_total"), False)
    names = name_pairs(ask.filter(~has_id & ~has_amount & has_name), inv, "buyer_name", "i_name")
    by_name = arm(ask.filter(~has_id & ~has_amount & has_name).join(names.withColumnRenamed("i_name", "_n"), "buyer_name"), [], F.col("_n") == F.trim("i_name"), False)
    sellers = name_pairs(ask.filter(~has_id & ~has_amount & ~has_name), inv, "company_name", "i_seller")
    by_seller = arm(ask.filter(~has_id & ~has_amount & ~has_name).join(sellers.withColumnRenamed("i_seller", "_s"), "company_name"), [], F.col("_s") == F.trim("i_seller"), False)
    pairs = both.unionByName(by_id).unionByName(by_amount).unionByName(by_name).unionByName(by_seller)
    few = skew.top_n(pairs, ["req"], newest, most)
    # Requests of a document that all state id and amount compete only within the same id and amount.
    loose = ask.filter(~(has_id & has_amount)).select("doc_id").distinct().withColumn("_loose", F.lit(True))
    part = F.when(F.col("_loose"), "").otherwise(F.concat_ws("|", "buyer_tax_id", F.col("amount").cast("string")))
    group = ask.join(loose, "doc_id", "left").select("req", "doc_id", "req_pos", part.alias("part"))
    offers = few.groupBy("req").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.expr("-unix_timestamp(cast(issued_at as timestamp))").alias("t"), "invoice_no"))), lambda x: x["invoice_no"]).alias("offers"))
    queue = group.join(offers, "req", "left").groupBy("doc_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("req_pos", F.coalesce("offers", F.array().cast("array<string>")).alias("offers")))).alias("queue")
    )
    kind = "struct<used:array<string>,taken:array<struct<req_pos:bigint,invoice_no:string>>>"
    start = F.from_json(F.lit('{"used":[],"taken":[]}'), kind)

    def choose(acc, r):
        pick = F.try_element_at(F.filter(r["offers"], lambda o: ~F.array_contains(acc["used"], o)), F.lit(1))
        return F.struct(
            F.when(pick.isNotNull(), F.array_append(acc["used"], pick)).otherwise(acc["used"]).alias("used"),
            F.array_append(acc["taken"], F.struct(r["req_pos"].cast("bigint").alias("req_pos"), pick.alias("invoice_no"))).alias("taken"),
        ).cast(kind)

    taken = queue.select("doc_id", F.explode(F.aggregate("queue", start, choose)["taken"]).alias("t")).select("doc_id", "t.*")
    failed = taken.filter(F.col("invoice_no").isNull()).select("doc_id").distinct()
    return taken.join(failed, "doc_id", "left_anti")


def lines_without_invoices(requests: DataFrame, invoices: DataFrame, rows: DataFrame, pos: str = "pos") -> DataFrame:
    """The other form of :func:`match_requests`: where no invoice can be used, each request gives a line, filled from history.

    ``requests`` as of ``extract.platform_invoice_blocks``; ``rows`` as :func:`history.apply_history` takes them, by the scope of the
    requests. An invoice can be used when it is positive and, with ``line_count`` given, has lines; ``invoices`` with a doc_id
    count for their document, else for all.
    """
    usable = invoices.filter("is_positive")
    if "line_count" in invoices.columns:
        usable = usable.filter(F.col("line_count") > 0)
    if "doc_id" in invoices.columns:
        bare = requests.join(usable.select("doc_id").distinct(), "doc_id", "left_anti")
    else:
        bare = requests.filter(usable.agg(F.count(F.lit(1)) == 0).scalar())
    # The rate and the name are all the text that history looks at.
    asked = bare.withColumn("text_id", F.concat_ws("\n", T.or_none("project_name"), T.or_none("tax_rate")))
    texts = asked.select("text_id", F.col("text_id").alias("text")).distinct()
    excerpt = F.concat(F.lit("平台开票截图直接生成草稿；来源图片 "), "source_name", F.lit("；含税金额 "), T.first_filled("amount_with_tax", default="待补全"), F.lit("；客户档案用于补充常用项目/税码。"))
    return history.apply_history(asked, rows, texts, pos).withColumn("source_excerpt", excerpt).drop("text_id", "scope")


# How an instruction names the new amount.
TARGETS = (
    r"开这个数\s*(\d{2,}(?:\.\d{1,2})?)",
    r"按(?:这个|新)?(?:金额|数)\s*(\d{2,}(?:\.\d{1,2})?)\s*重开",
    r"重开[^\d]{0,10}(\d{2,}(?:\.\d{1,2})?)",
)
MOST_TARGETS = 10


def reissue_requests(texts: DataFrame, most: int | None = MOST_TARGETS) -> DataFrame:
    """Per instruction text: original invoice numbers and target amounts, both in order. No match, no row.

    The first ``most`` amounts count, by definition ten; None takes all.
    """
    text = F.coalesce("text", F.lit(""))
    numbers = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<!\d)(\d{20})(?!\d)"), F.lit(1)))
    listed = F.regexp_extract_all(F.regexp_extract(text, r"金额\s*分别\s*(?:为|是)?\s*([0-9.,，、\s和及]+)", 1), F.lit(r"\d{2,}(?:\.\d{1,2})?"), F.lit(0))
    single = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in TARGETS]
    raw = F.transform(F.concat(listed, *single), lambda a: a.try_cast("decimal(28,2)"))
    amounts = F.array_distinct(F.filter(raw, lambda a: (a > 0) & (a < 100000000)))
    amounts = amounts if most is None else F.slice(amounts, 1, most)
    is_reissue = T.squeeze("text").rlike(r"重开|重新开|再开|分[两二三四五六七八九十0-9]+(?:笔|张)|作废|红冲|冲红")
    return texts.select("*", numbers.alias("numbers"), amounts.alias("amounts")).filter(is_reissue & (F.size("numbers") > 0) & (F.size("amounts") > 0))


def match_reissues(requests: DataFrame, invoices: DataFrame) -> DataFrame:
    """Per request and target amount the newest other positive invoice of the same buyer with that total.

    ``requests``: request_id, company_name, numbers, amounts. ``matched_all`` is false where one amount
    has none; such requests fall back to cutting up the original invoice.
    """
    inv = invoices.select("invoice_no", "seller_name", "buyer_name", F.col("total_amount").cast("decimal(28,2)").alias("total"), "is_positive", "issued_at")
    numbered = requests.select("request_id", "company_name", "amounts", F.posexplode("numbers").alias("n", "invoice_no"))
    original = numbered.join(inv.select("invoice_no", F.col("buyer_name").alias("buyer")), "invoice_no").groupBy("request_id", "company_name", "amounts").agg(F.min_by(F.struct("invoice_no", "buyer"), "n").alias("o"))
    targets = original.select("request_id", "company_name", F.col("o.invoice_no").alias("original_no"), F.col("o.buyer").alias("buyer"), F.posexplode("amounts").alias("pos", "amount"))
    # Alike invoices compete only by date; two are kept because the newest may be the original itself.
    pool = skew.top_n(inv.filter("is_positive"), ["buyer_name", "total", "seller_name"], [F.desc("issued_at"), F.col("invoice_no")], 2)
    by_buyer = targets.filter(F.col("buyer") != "").join(pool, (F.col("total") == F.col("amount")) & (F.col("buyer_name") == F.col("buyer")))
    anyone = skew.top_n(inv.filter("is_positive"), ["total", "seller_name"], [F.desc("issued_at"), F.col("invoice_no")], 2)
    by_total = targets.filter(F.col("buyer") == "").join(anyone, F.col("total") == F.col("amount"))
    found = by_buyer.unionByName(by_total).filter((F.col("invoice_no") != F.col("original_no")) & _either_way(F.col("company_name"), F.col("seller_name")))
    best = found.groupBy("request_id", "pos").agg(F.min_by("invoice_no", F.struct(F.expr("-unix_timestamp(cast(issued_at as timestamp))"), "invoice_no")).alias("invoice_no"))
    out = targets.join(best, ["request_id", "pos"], "left")
    full = out.groupBy("request_id").agg(F.bool_and(F.col("invoice_no").isNotNull()).alias("matched_all"))
    return out.join(full, "request_id").select("request_id", "original_no", "pos", "amount", "invoice_no", "matched_all")


def cut_pointers(sums: DataFrame, targets: DataFrame) -> DataFrame:
    """(invoice_no, k, start, stop): where a run that begins behind line ``start`` first meets target ``k``. Starts that never meet it have no row.

    ``sums``: invoice_no, line_no and the running sum ``run`` in cents; a start is a line's running sum, or 0 before the first one. An equi join
    finds the sums that lie a target apart, one cent to either side. A cut behind target ``k`` that a chain of cuts from the first line leads to
    is as far from the start as the targets up to ``k``, up to a cent for each; no other line is asked for that target.
    """
    known = targets.filter("k >= 0 and cents is not null")
    # The sums of the targets up to ``k``; where a number has several targets, of the least and of the largest ones.
    for name, order in (("low", F.col("cents").asc()), ("high", F.col("cents").desc())):
        upto = W.partitionBy("invoice_no").orderBy("k", order)
        known = known.withColumn("_first", F.when(F.lag("k").over(upto).eqNullSafe(F.col("k")), 0).otherwise(F.col("cents")))
        known = known.withColumn(name, F.sum("_first").over(upto.rowsBetween(W.unboundedPreceding, 0)).cast("decimal(38,0)"))
    near = sums.join(known.select("invoice_no", "k", "cents", "low", "high"), "invoice_no").filter(F.col("run").between(F.col("low") - F.col("k") - 1, F.col("high") + F.col("k") + 1))
    asked = near.select("invoice_no", "k", F.col("line_no").alias("stop"), F.explode(F.array(*[(F.col("run") - F.col("cents") + d).cast("decimal(38,0)") for d in (-1, 0, 1)])).alias("run"))
    firsts = targets.select("invoice_no", F.lit(None).cast("bigint").alias("start"), F.lit(0).cast("decimal(38,0)").alias("run")).distinct()
    starts = sums.select("invoice_no", F.col("line_no").alias("start"), "run").unionByName(firsts)
    met = starts.join(asked.filter("run >= 0"), ["invoice_no", "run"]).filter(F.col("start").isNull() | (F.col("stop") > F.col("start")))
    return met.groupBy("invoice_no", "k", "start").agg(F.min("stop").alias("stop"))


def cut_chain(pointers: DataFrame, most: int) -> DataFrame:
    """(invoice_no, k, stop): the cuts that the pointers lead to from the start of each invoice, as far as they go.

    Pointers are doubled round by round: after j rounds one jumps over 2^j targets, and the places reached so far jump along with it. A job of as
    many rounds as ``most`` has binary digits, each over the pointers alone.
    """
    places = pointers.filter("k = 0 and start is null").select("invoice_no", F.lit(0).alias("k"), "stop")
    jumps, step = pointers, 1
    while step < most:
        hop = jumps.select("invoice_no", (F.col("k") - 1).alias("k"), F.col("start").alias("stop"), F.col("stop").alias("next"))
        further = places.join(hop, ["invoice_no", "k", "stop"]).select("invoice_no", (F.col("k") + step).alias("k"), F.col("next").alias("stop"))
        places = kept_table(places.unionByName(further), "cuts")
        follow = jumps.select("invoice_no", (F.col("k") - step).alias("k"), F.col("start").alias("stop"), F.col("stop").alias("next"))
        jumps = kept_table(jumps.join(follow, ["invoice_no", "k", "stop"]).select("invoice_no", "k", "start", F.col("next").alias("stop")), "jumps")
        step *= 2
    return places


def split_by_targets(lines: DataFrame, targets: DataFrame, size: int = skew.CHUNK) -> DataFrame:
    """Cuts the ordered lines of an invoice into runs, each ending where its sum meets the next target.

    ``lines``: invoice_no, line_no, amount; ``targets``: invoice_no, target_pos (0-based), target. One
    target takes all lines. Otherwise every target needs a run, or the invoice gives no rows; a target
    never met takes what is left, so it has to be the last. Where one target meets one line, the line gets the target as its amount.
    Works on running sums and pointers between them, never on whole invoices.
    """
    # Targets and running sums are read in several places each, so they are written once.
    wanted = kept_table(targets.select("invoice_no", F.col("target_pos").cast("int").alias("k"), F.round(F.col("target").cast("decimal(28,2)") * 100).cast("decimal(38,0)").alias("cents")), "targets")
    counts = wanted.groupBy("invoice_no").agg(F.count(F.lit(1)).alias("n_targets"))
    ends = lines.groupBy("invoice_no").agg(F.max("line_no").alias("last_no"), F.count(F.lit(1)).alias("_lines"))
    several = counts.filter("n_targets > 1").select("invoice_no")
    work = lines.join(several, "invoice_no", "left_semi").select("invoice_no", "line_no", F.coalesce(F.abs("amount"), F.lit(0)).cast("decimal(28,2)").alias("a"))
    sums = kept_table(skew.chunked_running_sum(work, ["invoice_no"], "line_no", F.col("a"), "run", size).select("invoice_no", "line_no", (F.col("run") * 100).cast("decimal(38,0)").alias("run")), "sums")
    pointers = kept_table(cut_pointers(sums, wanted.join(several, "invoice_no", "left_semi")), "pointers")
    most = counts.agg(F.max("n_targets")).first()[0] or 0
    chain = cut_chain(pointers, most)
    # The pointers end at the first target that is not met; it takes the rest, and all before it have their runs.
    cuts = chain.groupBy("invoice_no").agg(F.max("k").alias("met"), F.array_sort(F.collect_list("stop")).alias("ends"), F.max("stop").alias("stop"))
    whole = counts.join(ends, "invoice_no").join(cuts, "invoice_no", "left").withColumn("met", F.coalesce("met", F.lit(-1)) + 1)
    rest = (F.col("met") == F.col("n_targets") - 1) & (F.coalesce("stop", F.lit(-(2**63)).cast("bigint")) < F.col("last_no"))
    usable = whole.filter((F.col("n_targets") == 1) | (F.col("met") == F.col("n_targets")) | rest)
    until = F.when((F.col("n_targets") > 1) & (F.col("met") == F.col("n_targets")), F.col("stop")).otherwise(F.col("last_no"))
    only = wanted.filter("k = 0").join(counts.filter("n_targets = 1"), "invoice_no").select("invoice_no", (F.col("cents") / 100).alias("_target"))
    placed = lines.join(usable.select("invoice_no", "n_targets", "_lines", F.coalesce("ends", F.array().cast("array<bigint>")).alias("ends"), until.alias("_until")), "invoice_no").join(only, "invoice_no", "left")
    alone = (F.col("_lines") == 1) & (F.col("n_targets") == 1)
    placed = placed.withColumn("amount", F.when(alone, F.col("_target").cast(lines.schema["amount"].dataType)).otherwise(F.col("amount")))
    # Such a line counts as one piece; its price would no longer fit.
    for name, value in (("quantity", T.first_filled("quantity", default="1") if "quantity" in lines.columns else None), ("unit_price", F.lit(""))):
        if name in lines.columns:
            placed = placed.withColumn(name, F.when(alone, value).otherwise(F.col(name)))
    group = F.when(F.col("n_targets") == 1, 0).otherwise(F.size(F.filter("ends", lambda e: e < F.col("line_no"))))
    return placed.filter(F.col("line_no") <= F.col("_until")).select(*lines.columns, group.alias("group_no"))


def reissue_lines(requests: DataFrame, invoices: DataFrame, lines: DataFrame, size: int = skew.CHUNK) -> DataFrame:
    """The lines of every draft that reissue requests ask for: (request_id, group_no, source_no, the columns of ``lines``).

    A request all of whose amounts have an invoice takes those invoices' lines, one draft each. Otherwise the original invoice is cut up at the
    amounts; a request whose amounts do not cut it gives no rows. ``requests`` and ``invoices`` as for :func:`match_reissues`; ``lines``: invoice_no,
    line_no, amount and what else a line has.
    """
    # Written once: the taken lines, the copies and their targets all read the matches, and the cut reads its copies several times.
    found = kept_table(match_reissues(requests, invoices), "reissues")
    taken = found.filter("matched_all").select("request_id", F.col("pos").alias("group_no"), "invoice_no")
    whole = taken.join(lines, "invoice_no").select("request_id", "group_no", F.col("invoice_no").alias("source_no"), *[c for c in lines.columns if c != "invoice_no"])
    open_ = found.filter(~F.col("matched_all"))
    # A request cuts its own copy of the original, so the copy goes by the request's id.
    own = open_.select("request_id", "original_no").distinct().join(lines.withColumnRenamed("invoice_no", "original_no"), "original_no")
    copies = kept_table(own.withColumnRenamed("request_id", "invoice_no").withColumnRenamed("original_no", "source_no"), "copies")
    targets = open_.select(F.col("request_id").alias("invoice_no"), F.col("pos").alias("target_pos"), F.col("amount").alias("target"))
    cut = split_by_targets(copies, targets, size).withColumnRenamed("invoice_no", "request_id")
    return whole.unionByName(cut.select(*whole.columns))


def fill_vehicle_rows(rows: DataFrame, size: int = skew.CHUNK) -> DataFrame:
    """Vehicle sheet rows (sheet, row, buyer, info) to lines: buyer filled down, model, VIN and price from the text."""
    filled = skew.chunked_fill_forward(rows, ["sheet"], "row", T.or_none("buyer"), "current_buyer", size)
    pattern = r"(.+?)\s*车架号\s*([A-Za-z0-9]+)\s*价格\s*(\d+(?:\.\d{1,2})?)"
    part = lambda i: F.regexp_extract("info", pattern, i)
    buyer = F.coalesce("current_buyer", F.lit(""))
    return filled.filter(F.col("info").rlike(pattern)).select(
        "sheet", "row", F.concat(F.lit("电动两轮摩托车 "), T.strip(part(1))).alias("project_name"), T.money_text(T.parse_money(part(3)), half_even=True).alias("amount_with_tax"), F.lit("1%").alias("tax_rate"),
        F.lit("机动车").alias("tax_category"), F.concat(F.lit("车架号 "), part(2)).alias("specification"), F.lit("辆").alias("unit"), F.lit("1").alias("quantity"), F.lit("").alias("unit_price"),
        F.concat(F.lit("机动车合格证异常表解析，需人工复核：按错误信息提取车型/车架号/价格；购买方线索："), buyer, F.lit("。")).alias("coding_reference"), buyer.alias("buyer_name"),
    )


def dedupe_lines(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First line per name, specification, quantity, price and resolved amount within ``keys``."""
    amount = T.first_filled(T.money_text(T.resolved_amount("amount_with_tax", "quantity", "unit_price")), "amount_with_tax")
    # Rows travel with 128 bits of the five values, not with a second copy of them.
    marked = lines.withColumn("_key", skew.digest([*[T.strip(c) for c in ("project_name", "specification", "quantity", "unit_price")], amount]))
    return skew.first_by(marked, [*keys, "_key"], order).select(*lines.columns)


BUYER_FIELDS = ("buyer_name", "buyer_tax_id", "buyer_address", "buyer_phone", "buyer_bank_name", "buyer_bank_account")


def merge_buyers(primary: DataFrame, secondary: DataFrame, key: str = "doc_id") -> DataFrame:
    """Field-wise: the first source where it has a value, else the second."""
    s = secondary.select(key, *[F.col(c).alias(f"s_{c}") for c in BUYER_FIELDS])
    return primary.select(key, *BUYER_FIELDS).join(s, key, "full").select(key, *[T.first_filled(c, f"s_{c}").alias(c) for c in BUYER_FIELDS])


def merge_lines(primary: DataFrame, secondary: DataFrame, keys=("doc_id", "pos")) -> DataFrame:
    """Merges two extractions by position; the second replaces a weak first one that is not longer."""
    doc, pos = keys
    amount = T.resolved_amount("amount_with_tax", "quantity", "unit_price")
    p_facts = primary.groupBy(doc).agg(F.count(F.lit(1)).alias("p_n"), F.count_if(~T.is_blank("project_name")).alias("p_names"), F.count_if(amount.isNotNull()).alias("p_amounts"))
    s_facts = secondary.groupBy(doc).agg(F.count(F.lit(1)).alias("s_n"))
    facts = p_facts.join(s_facts, doc, "full").select(
        doc, (F.col("p_n").isNull() | (((F.col("p_names") == 0) | (F.col("p_amounts") == 0)) & (F.col("s_n") >= F.col("p_n")))).alias("_replace"), F.col("s_n").isNull().alias("_alone")
    )
    s = secondary.select(doc, pos, F.lit(True).alias("_s"), *[F.col(c).alias(f"s_{c}") for c in LINE])
    j = primary.select(doc, pos, F.lit(True).alias("_p"), *LINE).join(s, [doc, pos], "full").join(facts, doc)
    text = lambda c: F.coalesce(c, F.lit(""))

    def pick(c: str) -> Column:
        default = "3%" if c == "tax_rate" else ""
        # A side that has no line at a position counts as an empty line with the default rate.
        own, other = F.when(F.col("_p").isNull(), default).otherwise(text(c)), text(f"s_{c}")
        merged = F.when(own != "", own).when(other != "", other).otherwise(default)
        return F.when(F.col("_replace"), text(f"s_{c}")).when(F.col("_alone"), text(c)).otherwise(merged).alias(c)

    out = j.filter(~F.coalesce("_replace", F.lit(False)) | F.col("_s").isNotNull()).select(doc, pos, F.col("_replace"), F.col("_alone"), *[pick(c) for c in LINE])
    keep = F.col("_replace") | F.col("_alone") | (F.col("project_name") != "") | (F.col("amount_with_tax") != "")
    return out.filter(keep).drop("_replace", "_alone")


def extraction_conflicts(primary_buyers: DataFrame, primary: DataFrame, secondary_buyers: DataFrame, secondary: DataFrame, keys=("doc_id", "pos"), limit: int = 12) -> DataFrame:
    """Where two extractions of a document disagree; at most ``limit`` notes per document, in order."""
    doc, pos = keys
    key = lambda c: F.upper(F.regexp_replace(F.regexp_replace(T.strip(c), " ", ""), "，", ","))

    def note(label: Column, own: Column, other: Column) -> Column:
        text = F.concat(F.lit("识别差异需确认："), label, F.lit("，规则识别为“"), own, F.lit("”，智能识别为“"), other, F.lit("”。"))
        # Equal texts have equal keys, so only those that differ are looked at.
        return F.when((own != other) & (key(own) != "") & (key(other) != "") & (key(own) != key(other)), text)

    sb = secondary_buyers.select(doc, *[F.col(c).alias(f"s_{c}") for c in ("buyer_name", "buyer_tax_id")])
    heads = primary_buyers.join(sb, doc).select(
        doc, F.posexplode(F.array(note(F.lit("购买方名称"), F.col("buyer_name"), F.col("s_buyer_name")), note(F.lit("购买方税号"), F.col("buyer_tax_id"), F.col("s_buyer_tax_id")))).alias("i", "text")
    ).select(doc, F.lit(-2).cast("bigint").alias("p"), "i", "text")
    count = lambda df, n: df.groupBy(doc).agg(F.count(F.lit(1)).alias(n))
    sizes = count(primary, "a").join(count(secondary, "b"), doc).filter(F.col("a") != F.col("b")).select(
        doc, F.lit(-1).cast("bigint").alias("p"), F.lit(0).alias("i"),
        F.concat(F.lit("识别差异需确认：规则识别出 "), F.col("a").cast("string"), F.lit(" 行明细，智能识别为 "), F.col("b").cast("string"), F.lit(" 行。")).alias("text"),
    )
    facts = lambda df, x: df.select(doc, pos, F.struct(T.strip("project_name").alias("name"), T.money_text(T.resolved_amount("amount_with_tax", "quantity", "unit_price")).alias("amount"), T.canonical_rate("tax_rate").alias("rate"), T.strip("tax_code").alias("code")).alias(x))
    both = facts(primary, "x").join(facts(secondary, "y"), [doc, pos])
    label = lambda n: F.concat(F.lit("第 "), F.col(pos).cast("string"), F.lit(f" 行{n}"))
    parts = F.array(*[note(label(n), F.col(f"x.{c}"), F.col(f"y.{c}")) for c, n in (("name", "项目名称"), ("amount", "金额"), ("rate", "税率"), ("code", "税收编码"))])
    rows = both.select(doc, F.col(pos).cast("bigint").alias("p"), F.posexplode(parts).alias("i", "text"))
    all_notes = heads.unionByName(sizes).unionByName(rows).filter(F.col("text").isNotNull())
    return skew.top_n(all_notes, [doc], [F.col("p"), F.col("i")], limit).select(doc, "p", "text")


def match_sources(files: DataFrame, requests: DataFrame, size: int = skew.CHUNK) -> DataFrame:
    """A request for each uploaded file: by equal file name, then stored name, then last number in the name.

    Equal keys pair off in order, each request goes once; a file without one keeps null. ``files``:
    batch_id, pos, original_name, stored_name; ``requests``: batch_id, pos, source_name.
    """
    base = lambda c: F.lower(T.strip(F.element_at(F.split(F.coalesce(c, F.lit("")), "/"), -1)))
    stem = lambda c: F.regexp_replace(base(c), r"\.[^.]*$", "")

    def number(c) -> Column:
        found = F.try_element_at(F.regexp_extract_all(stem(c), F.lit(r"\d+"), F.lit(0)), F.lit(-1))
        return F.when(found.isNotNull(), T.first_filled(F.regexp_replace(found, "^0+", ""), default="0"))

    f = kept_table(files.select("batch_id", F.col("pos").alias("file_pos"), F.array(base("original_name"), base("stored_name"), F.coalesce(number(T.first_filled("original_name", "stored_name")), F.lit(""))).alias("keys")), "files")
    r = kept_table(requests.select("batch_id", F.col("pos").alias("req_pos"), F.array(base("source_name"), base("source_name"), F.coalesce(number("source_name"), F.lit(""))).alias("keys")), "requests")
    done = None
    for i in range(3):
        a, b = f.withColumn("k", F.col("keys")[i]).filter(F.col("k") != ""), r.withColumn("k", F.col("keys")[i]).filter(F.col("k") != "")
        if done is not None:
            a = a.join(done.select("batch_id", "file_pos"), ["batch_id", "file_pos"], "left_anti")
            b = b.join(done.select("batch_id", "req_pos"), ["batch_id", "req_pos"], "left_anti")
        a = skew.chunked_row_number(a.select("batch_id", "k", "file_pos"), ["batch_id", "k"], "file_pos", "n", size)
        b = skew.chunked_row_number(b.select("batch_id", "k", "req_pos"), ["batch_id", "k"], "req_pos", "n", size)
        # Written once: the next rounds and the result read it.
        hit = kept_table(a.join(b, ["batch_id", "k", "n"]).select("batch_id", "file_pos", "req_pos"), "hits")
        done = hit if done is None else done.unionByName(hit)
    return f.select("batch_id", "file_pos").join(done, ["batch_id", "file_pos"], "left")


def find_parent_batch(drafts: DataFrame, items: DataFrame) -> DataFrame:
    """Newest batch that holds each draft; ``items``: batch_id, modified, draft_id."""
    newest = items.groupBy("draft_id").agg(F.max_by("batch_id", F.struct("modified", "batch_id")).alias("batch_id"))
    return drafts.select("draft_id").distinct().join(newest, "draft_id")


def requests_to_lines(requests: DataFrame, profile: DataFrame, note: str = "") -> DataFrame:
    """One draft line per request: the request's value, else the seller's usual item, else a default.

    ``profile`` is the seller's dominant line, keyed by ``seller_name``.
    """
    fields = ("project_name", "tax_category", "tax_code", "tax_rate", "specification", "unit", "matched_source")
    p = profile.select("seller_name", *[F.col(c).alias(f"p_{c}") for c in fields])
    own = ~T.is_blank("project_name") | ~T.is_blank("amount_with_tax") | ~T.is_blank("tax_rate") | ~T.is_blank("tax_code")
    usual = F.when(
        T.is_blank("p_project_name") & T.is_blank("p_tax_code"), "批量模式待人工补全，需人工复核"
    ).otherwise(
        F.concat(F.lit("销售主体历史开票档案推荐，需人工复核: "), "p_matched_source", F.lit(" -> "), T.first_filled("p_tax_category", default="未记录大类"), F.lit(" / "), T.first_filled("p_tax_code", default="未记录编码"))
    )
    notes = F.concat_ws("；", F.when(F.lit(note.strip()) != "", F.lit(note.strip())), F.concat(F.lit("来源图片："), "source_name"), F.when(~T.is_blank("order_no"), F.concat(F.lit("订单号："), "order_no")), F.when(~T.is_blank("email"), F.concat(F.lit("邮箱："), "email")))
    pick = lambda c: T.first_filled(c, f"p_{c}").alias(c)
    return requests.join(p, "seller_name", "left").select(
        "request_id", "seller_name", pick("project_name"), F.coalesce("amount_with_tax", F.lit("")).alias("amount_with_tax"),
        T.first_filled("tax_rate", "p_tax_rate", F.when(~T.is_blank("p_tax_code"), "1%")).alias("tax_rate"), pick("tax_category"), pick("specification"),
        T.first_filled("unit", "p_unit", default="项").alias("unit"), T.first_filled("quantity", default="1").alias("quantity"), F.lit("").alias("unit_price"), pick("tax_code"), F.lit("").alias("source_item_code"),
        F.when(own, "视觉大模型识别，需人工复核").otherwise(usual).alias("coding_reference"), notes.alias("note"), own.alias("to_be_coded"),
    )


def bundle_sellers(files: DataFrame) -> DataFrame:
    """Seller of each bundle of files: the most frequent one among its history files, the first on ties.

    ``files``: bundle, file_name, pos, suffix, seller_name ('' unless a history file), known (seen before).
    Every file gets its outcome; bundles without a seller go to review.
    """
    voted = files.filter(~T.is_blank("seller_name")).groupBy("bundle", "seller_name").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
    seller = voted.groupBy("bundle").agg(F.min_by("seller_name", F.struct(-F.col("n"), "first_pos")).alias("bundle_seller"))
    j = files.join(seller, "bundle", "left").withColumn("bundle_seller", F.coalesce("bundle_seller", F.lit("")))
    image = F.lower("suffix").isin(".png", ".jpg", ".jpeg", ".webp", ".bmp")
    history = ~T.is_blank("seller_name")
    status = (
        F.when(F.col("known"), "duplicate")
        .when(F.col("bundle_seller") == "", "pending_review")
        .when(history, "imported")
        .otherwise("candidate_only")
    )
    kind = F.when(history, "tax_bureau_history_excel").when(image, "image_candidate").otherwise("bundle_material_candidate")
    return j.withColumn("status", status).withColumn("file_type", kind)


def bundle_counters(placed: DataFrame) -> DataFrame:
    """Outcome counts over all bundles."""
    per = placed.groupBy("bundle", "bundle_seller").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("status") == s).alias(s) for s in ("imported", "candidate_only", "duplicate", "pending_review")]
    )
    return per.agg(
        F.count(F.lit(1)).alias("bundles_seen"), F.count_if(F.col("bundle_seller") != "").alias("bundles_with_seller"), F.count_if(F.col("bundle_seller") == "").alias("bundles_without_seller"),
        F.sum("n").alias("seen"), F.sum("imported").alias("history_excel_imported"), F.sum("candidate_only").alias("bundle_material_archived"), F.sum("duplicate").alias("duplicate"), F.sum("pending_review").alias("to_review"),
    )
