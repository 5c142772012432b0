"""Hints from invoice history: buyers named in a text, and codes, rates and names of known items.

Lines carry a ``scope`` (the seller, or seller and buyer) and history rows belong to a scope. Matching
works on the distinct names of a scope. History rows that repeat only because a seller has several
buyers are kept once with their number in ``copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import skew
from ..functions import text as T
from ..functions.kept import computed, kept_table
from .profiles import SELLER

ROW = ["project_name", "tax_category", "tax_code", "tax_rate", "unit", "specification", "quantity", "line_count"]


# --- buyers ---------------------------------------------------------------------------------

def resolve_buyers(texts: DataFrame, buyers: DataFrame) -> DataFrame:
    """Best known buyer per text: longest alias in it, 20 more when the full name is there.

    ``texts``: text_id, scope, text. ``buyers``: scope, buyer_name, buyer_tax_id, pos. Only the first
    buyer of an alias can win by it, so shared short aliases do not multiply.
    """
    known = buyers.filter(~T.is_blank("buyer_name") & ~T.is_blank("buyer_tax_id")).select("scope", T.strip("buyer_name").alias("buyer_name"), T.strip("buyer_tax_id").alias("buyer_tax_id"), "pos")
    aliased = known.select("*", F.explode(T.buyer_aliases("buyer_name")).alias("alias")).withColumn("alias_key", T.compact_key("alias")).filter(F.col("alias_key") != "")
    aliases = skew.first_by(aliased, ["scope", "alias_key"], ["pos", "buyer_name", "alias"])
    # Requests repeat their wording, so a wording of a scope is looked at once; the table gives it a number.
    wordings = texts.select("scope", "text").filter(F.col("scope").isNotNull() & F.col("text").isNotNull()).distinct()
    said = kept_table(wordings.withColumn("said", F.monotonically_increasing_id()), "wordings")
    compact = said.select("said", T.compact_key("text").alias("_text")).filter(F.col("_text") != "")
    held = skew.contained_in(compact, "said", "_text", aliases, "alias_key", long_text=True)
    full = skew.contained_in(said, "said", "text", known, "buyer_name", long_text=True)
    scope = said.select("said", "scope").hint("merge")
    row = ["said", "alias", "buyer_name", "buyer_tax_id", "pos", "score"]
    # Merged: aliases are exploded, and the buyers compressed, so Spark takes both for smaller than they are.
    by_alias = held.join(scope, "said").join(aliases.hint("merge"), ["scope", "alias_key"]).withColumn("score", F.length("alias_key")).select(*row)
    names = skew.first_by(known, ["scope", "buyer_name"], ["pos", "buyer_tax_id"])
    by_name = full.join(scope, "said").join(names.hint("merge"), ["scope", "buyer_name"]).withColumn("alias", F.col("buyer_name")).withColumn("score", F.length(T.compact_key("buyer_name")) + 20).select(*row)
    order = F.struct((-F.col("score")).alias("s"), "pos", "alias")
    found = by_alias.unionByName(by_name).groupBy("said").agg(F.min_by(F.struct("alias", "buyer_name", "buyer_tax_id", "score"), order).alias("b"), F.min(order).alias("o"))
    worded = said.join(found.hint("merge"), "said").select("scope", "text", "b", "o")
    best = texts.filter(F.col("text_id").isNotNull()).select("text_id", "scope", "text").join(worded.hint("merge"), ["scope", "text"]).groupBy("text_id").agg(F.min_by("b", "o").alias("b"))
    return best.select(
        "text_id", F.col("b.alias").alias("matched_alias"), "b.buyer_name", "b.buyer_tax_id", F.when(F.col("b.score") >= 6, "high").otherwise("medium").alias("confidence")
    )


def fill_buyers(drafts: DataFrame, matches: DataFrame, key: str = "text_id") -> DataFrame:
    """Fills a missing or unreliable id from the match, only where the names agree."""
    m = matches.select(key, *[F.col(c).alias(f"m_{c}") for c in ("matched_alias", "buyer_name", "buyer_tax_id")])
    name, found = F.regexp_replace(F.coalesce("buyer_name", F.lit("")), " ", ""), F.regexp_replace(F.coalesce("m_buyer_name", F.lit("")), " ", "")
    agree = (name == "") | name.contains(F.col("m_matched_alias")) | found.contains(name) | name.contains(found)
    use = F.col("m_buyer_name").isNotNull() & agree & ~F.coalesce(F.col("buyer_tax_id") == F.col("m_buyer_tax_id"), F.lit(False))
    weak = T.tax_id_unreliable("buyer_tax_id")
    return drafts.join(m, key, "left").withColumns(
        {
            "buyer_name": F.when(use & (T.is_blank("buyer_name") | weak), F.col("m_buyer_name")).otherwise(F.col("buyer_name")),
            "buyer_tax_id": F.when(use & (T.is_blank("buyer_tax_id") | weak), F.col("m_buyer_tax_id")).otherwise(F.col("buyer_tax_id")),
        }
    ).select(*drafts.columns)


# --- history rows ---------------------------------------------------------------------------

def profile_rows(requests: DataFrame, projects: DataFrame, buyers: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """History rows of each request (scope, seller, buyer_name, buyer_tax_id).

    A seller's items stand once per target buyer: the buyers that match, else the one asked for, else
    all, else a blank one. They are returned once with that number in ``copies``; buyer-only rows and
    the ledger lines of the seller follow. The id decides before the name.
    """
    # Buyers and items are read in many places, each with filters of its own, so they are written once with the columns that are asked for.
    buyers = kept_table(buyers.select(*SELLER, "buyer_name", "buyer_tax_id"), "buyers")
    projects = kept_table(projects.select(*SELLER, *[c for c in ROW if c in projects.columns]), "items")
    asked = requests.select("scope", "seller", "buyer_name", "buyer_tax_id").distinct()
    sellers = projects.select(*SELLER).unionByName(buyers.select(*SELLER)).distinct()
    named = asked.join(sellers.select(*SELLER, F.explode(F.array_distinct(F.array(*SELLER))).alias("seller")), "seller")
    by_id = ~T.is_blank("buyer_tax_id")
    by_name = ~by_id & ~T.is_blank("buyer_name")
    b = buyers.select(*SELLER, F.col("buyer_name").alias("b_name"), F.col("buyer_tax_id").alias("b_id"))
    hit_id = named.filter(by_id).join(b.withColumn("buyer_tax_id", F.col("b_id")), [*SELLER, "buyer_tax_id"])
    hit_name = named.filter(by_name).join(b.withColumn("buyer_name", F.col("b_name")), [*SELLER, "buyer_name"])
    open_hits = named.filter(~by_id & ~by_name).join(b, SELLER)
    columns = ["scope", *SELLER, "b_name", "b_id"]
    matched = hit_id.select(*columns).unionByName(hit_name.select(*columns)).unionByName(open_hits.select(*columns))
    copies = matched.groupBy("scope", *SELLER).agg(F.count(F.lit(1)).alias("n"))
    scoped = named.join(copies, ["scope", *SELLER], "left").select("scope", *SELLER, F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)).alias("copies"))
    text = lambda c, default="": T.first_filled(c, default=default).alias(c)
    have = set(projects.columns)
    item = projects.select(
        *SELLER, "project_name", "tax_category", "tax_code", "tax_rate", text("unit", "项"), *[text(c, d) if c in have else F.lit(d).alias(c) for c, d in (("specification", ""), ("quantity", "1"))],
        F.coalesce(F.col("line_count").cast("bigint"), F.lit(1)).alias("line_count"),
    )
    rows = scoped.join(item, SELLER).select("scope", "copies", *ROW, F.lit("").alias("buyer_name"), F.lit(0).alias("part"))
    only = matched.select("scope", F.lit(1).cast("bigint").alias("copies"), *[F.lit(1).cast("bigint").alias(c) if c == "line_count" else F.lit("").alias(c) for c in ROW], F.col("b_name").alias("buyer_name"), F.lit(1).alias("part"))
    out = rows.unionByName(only)
    if ledger is not None:
        book = ledger.select(F.col("company_name").alias("seller"), F.col("buyer_name").alias("l_name"), F.col("buyer_tax_id").alias("l_id"), *[F.col(c) if c in ledger.columns else F.lit(1 if c == "line_count" else "").alias(c) for c in ROW])
        # Lines of the same buyer and item are votes for one row, so they are counted before the join.
        book = book.groupBy("seller", "l_name", "l_id", *[c for c in ROW if c != "line_count"]).agg(F.count(F.lit(1)).alias("copies"), F.max("line_count").cast("bigint").alias("line_count"))
        joined = asked.join(book, "seller")
        keep = F.when(by_id, (F.col("l_id") == "") | (F.col("l_id") == F.col("buyer_tax_id"))).when(by_name, F.col("l_name") == F.col("buyer_name")).otherwise(True)
        out = out.unionByName(joined.filter(keep).select("scope", "copies", *ROW, F.col("l_name").alias("buyer_name"), F.lit(2).alias("part")))
    return out


def history_rate(value: Column | str) -> Column:
    """Rate text as history groups it; exempt words are one, blank stays blank."""
    text = T.plain_percent(T.strip(value))
    number = text.try_cast(T.MONEY_TYPE)
    scaled = F.when(number <= 1, number * 100).otherwise(number)
    return (
        F.when(text.isin("免税", "免征增值税"), "免税")
        .when((text == "不征税") | (text == "") | text.endswith("%") | number.isNull(), text)
        .otherwise(F.concat(T.cut_zeros(scaled.cast("string")), F.lit("%")))
    )


def exact_history(rows: DataFrame, pos: str = "pos") -> DataFrame:
    """Weighted vote per scope and item key: the item variant, then the rate within it."""
    weight = F.greatest(F.coalesce(F.col("line_count").cast("bigint"), F.lit(1)), F.lit(1)) * F.col("copies")
    variant = ["project_name", "tax_category", "tax_code", "unit", "specification"]
    clean = rows.select("scope", *[T.strip(c).alias(c) for c in variant], F.col("tax_rate").alias("raw_rate"), T.first_filled("quantity", default="1").alias("quantity"), weight.alias("w"), F.col(pos).alias("pos"))
    coded = computed(clean, key=T.compact_key("project_name")).filter((F.col("key") != "") & (F.col("tax_code") != "")).withColumn("rate", history_rate("raw_rate"))
    by = ["scope", "key"]
    rates = coded.groupBy(*by, *variant, "rate").agg(
        F.sum("w").alias("w"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"),
        F.max_by(T.first_filled("raw_rate", "rate"), "pos").alias("shown"), F.max_by("quantity", "pos").alias("quantity"),
    )
    voted = F.when(F.col("rate") != "", F.struct((-F.col("w")).alias("n"), F.col("first_pos").alias("p"), "rate", "shown"))
    variants = rates.groupBy(*by, *variant).agg(
        F.sum("w").alias("weight"), F.min("first_pos").alias("first_pos"), F.max_by("quantity", "last_pos").alias("quantity"), F.array_sort(F.collect_list(voted)).alias("rates")
    )
    label = F.concat_ws(" / ", T.first_filled("tax_category", default="未记录大类"), T.first_filled("tax_code", default="未记录编码"))
    best = variants.groupBy(*by).agg(
        F.min_by(F.struct(*variant, "weight", "quantity", "rates"), F.struct(-F.col("weight"), "first_pos")).alias("v"), F.array_sort(F.collect_set(label)).alias("codes")
    ).select(*by, "v.*", "codes")
    top = F.try_element_at("rates", F.lit(1))
    several = F.size("rates") > 1
    rate_note = F.when(
        several,
        F.concat(F.lit("客户本次未写税率，按历史最高频 "), top["rate"], F.lit(" 推荐；历史税率还出现过 "), F.array_join(F.transform(F.slice("rates", 1, 4), lambda r: r["rate"]), "；")),
    )
    code_note = F.when(F.size("codes") > 1, F.concat(F.lit("历史同项目还出现过 "), F.array_join(F.slice("codes", 1, 4), "；"), F.lit("，本次按最高频品类推荐")))
    return best.select(
        *by, "project_name", "tax_category", "tax_code", F.coalesce(top["shown"], F.lit("")).alias("tax_rate"), "specification", T.first_filled("unit", default="项").alias("unit"), "quantity",
        rate_note.alias("rate_note"), code_note.alias("code_note"),
        F.when((F.col("weight") >= 2) & (F.size("codes") == 1), "high").otherwise("medium").alias("confidence"), "weight",
    )


LEAST_SCORE = 36


def fuzzy_history(asks: DataFrame, rows: DataFrame, texts: DataFrame | None = None, pos: str = "pos") -> DataFrame:
    """Best similar history item per distinct (scope, key, text_id), from a score of 36 up.

    ``asks``: scope, key (compact item name) and text_id; ``rows`` has the place in the scope's list as
    ``rank`` (0-based; 20 stands for all later places). ``texts``: text_id, text.
    """
    known = computed(rows, p=T.compact_key("project_name")).filter(F.col("p") != "")
    reach = F.least(F.col("rank") * F.col("copies") + F.col("copies") - 1, F.lit(20))
    static = F.when(~T.is_blank("tax_code"), 12).otherwise(0) + F.when(~T.is_blank("tax_category"), 6).otherwise(0) + F.floor(reach / 5)
    payload = F.struct(T.strip("project_name").alias("project_name"), *[T.strip(c).alias(c) for c in ROW if c not in ("project_name", "line_count")])
    # Name, tokens and frequency belong to the item name, so one row per name can win.
    items = known.groupBy("scope", T.strip("project_name").alias("item"), "p").agg(
        F.min_by(F.struct(static.alias("s"), F.col(pos).alias("pos"), payload.alias("row")), F.struct(-static, pos)).alias("best"), F.sum("copies").alias("freq")
    ).select("scope", "item", "p", (F.col("best.s") + F.least("freq", F.lit(8))).alias("base"), F.col("best.pos").alias("pos"), F.col("best.row").alias("row"))
    # Items and questions are written once: each of their many readers would go through the whole history, or all lines, again. Their files repeat names
    # and scopes and so hold them in a twentieth of their bytes, by which Spark would send them; they and what is made of them are merged.
    items = kept_table(items, "items")
    asked = kept_table(asks.select("scope", "key", "text_id").distinct().withColumn("weak", F.col("key").isin(*T.WEAK_NAMES)), "asked")
    names = asked.select("scope", "key").filter(F.col("key") != "").distinct()
    keys, targets = names.select("key").distinct(), items.select("p").distinct()
    within = skew.contained_in(targets.withColumn("p2", F.col("p")), "p", "p2", keys, "key").withColumn("n", F.lit(90))
    around = skew.contained_in(keys.withColumn("k2", F.col("key")), "key", "k2", targets, "p").withColumn("n", F.lit(75))
    near = within.select("key", "p", "n").unionByName(around.select("key", "p", "n"))
    near = near.withColumn("n", F.when(F.col("key") == F.col("p"), 120).otherwise(F.col("n"))).groupBy("key", "p").agg(F.max("n").alias("n"))
    close = names.join(near.hint("merge"), "key").join(items.select("scope", "p").distinct().hint("merge"), ["scope", "p"]).select("scope", "key", "p", "n", F.lit(0).alias("tokens"))
    ask_tokens = names.select("scope", "key", F.explode(T.business_tokens("key")).alias("token"))
    item_tokens = items.select("scope", "p", F.explode(T.business_tokens("p")).alias("token")).distinct()
    shared = ask_tokens.join(item_tokens.hint("merge"), ["scope", "token"]).groupBy("scope", "key", "p").agg(F.count(F.lit(1)).alias("tokens")).select("scope", "key", "p", F.lit(0).alias("n"), F.col("tokens").cast("int"))
    related = close.unionByName(shared).groupBy("scope", "key", "p").agg(F.max("n").alias("n"), F.max("tokens").alias("tokens"))
    related = related.select("scope", "key", "p", F.when(F.col("n") > 0, F.col("n")).otherwise(F.col("tokens") * 22).alias("name_score"))
    pairs = asked.join(related.hint("merge"), ["scope", "key"]).select("scope", "key", "text_id", "p", "name_score", F.lit(0).alias("text_score"))
    if texts is not None:
        compact = texts.select("text_id", T.compact_key("text").alias("_text")).filter(F.col("_text") != "")
        said = skew.contained_in(compact, "text_id", "_text", item_tokens.select("token").distinct(), "token", long_text=True)
        heard = asked.join(said.hint("merge"), "text_id").join(item_tokens.hint("merge"), ["scope", "token"]).groupBy("scope", "key", "text_id", "p").agg((F.count(F.lit(1)) * 18).cast("int").alias("text_score"))
        pairs = pairs.unionByName(heard.select("scope", "key", "text_id", "p", F.lit(0).alias("name_score"), "text_score"))
    by = ["scope", "key", "text_id"]
    scored = pairs.groupBy(*by, "p").agg(F.max("name_score").alias("name_score"), F.max("text_score").alias("text_score")).join(items.hint("merge"), ["scope", "p"]).join(asked.select(*by, "weak").hint("merge"), by)
    total = F.col("name_score") + F.col("text_score") + F.col("base") + F.when(F.col("weak"), 15).otherwise(0)
    first = scored.select(*by, total.alias("score"), "pos", "row")
    # A weak name can take any item of its scope; without a relation only the scope's best one matters.
    plain = items.groupBy("scope").agg(F.min_by(F.struct("base", "pos", "row"), F.struct(-F.col("base"), "pos")).alias("b"))
    second = asked.filter("weak").join(plain.hint("merge"), "scope").select(*by, (F.col("b.base") + 15).alias("score"), F.col("b.pos").alias("pos"), F.col("b.row").alias("row"))
    best = first.unionByName(second).filter(F.col("score") >= LEAST_SCORE).groupBy(*by).agg(F.min_by(F.struct("row", "score"), F.struct(-F.col("score"), "pos")).alias("m"))
    return best.select(*by, "m.row.*", F.col("m.score").alias("score"))


def ranked_rows(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``rank``: the place of a row in its scope, 20 for everything later (later places score alike)."""
    first = skew.top_n(rows, ["scope"], [F.col(c) for c in order], 20, "_r").select("scope", *order, "_r").distinct()
    return rows.join(first.hint("merge"), ["scope", *order], "left").withColumn("rank", F.coalesce(F.col("_r") - 1, F.lit(20))).drop("_r")


def _note(reference: Column, note: Column) -> Column:
    return F.when(F.coalesce(reference, F.lit("")) == "", note).when(reference.contains(note), reference).otherwise(F.concat(reference, F.lit("; "), note))


def apply_history(lines: DataFrame, rows: DataFrame, texts: DataFrame | None = None, pos: str = "pos") -> DataFrame:
    """Fills lines from history: an exact item first, else a similar one. ``lines`` has scope and text_id.

    An explicit name keeps its name and takes codes from safe matches only; a weak name takes the
    history name. A different code already there only gets a note. A rate gives way when blank or 3%.
    """
    base = kept_table(lines.withColumn("_key", T.compact_key("project_name")), "lines")
    exact = kept_table(exact_history(rows, pos), "exact")
    ex = exact.select(F.col("scope"), F.col("key").alias("_key"), F.struct("project_name", "tax_category", "tax_code", "tax_rate", "specification", "unit", "rate_note", "code_note").alias("_e"))
    asks = base.select("scope", F.col("_key").alias("key"), "text_id").distinct()
    open_asks = asks.join(exact.select("scope", "key").hint("merge"), ["scope", "key"], "left_anti")
    fz = fuzzy_history(open_asks, rows, texts, pos).select(
        "scope", F.col("key").alias("_key"), "text_id", F.struct("project_name", "tax_category", "tax_code", "tax_rate", "specification", "unit").alias("_f")
    )
    j = base.join(ex.hint("merge"), ["scope", "_key"], "left").join(fz.hint("merge"), ["scope", "_key", "text_id"], "left")
    if texts is None:
        j = j.withColumn("_said", F.lit(""))
    else:
        j = j.join(texts.select("text_id", T.stated_rate("text").alias("_said")).hint("merge"), "text_id", "left").withColumn("_said", F.coalesce("_said", F.lit("")))
    is_exact = F.col("_e").isNotNull()
    said = T.or_none("_said")
    notes = F.array_join(F.array_compact(F.array(F.when(is_exact, F.coalesce(F.concat(F.lit("本次材料明确 "), said), F.col("_e.rate_note"))), F.col("_e.code_note"))), "；")
    source = F.when(is_exact, F.concat("_e.project_name", F.when(notes != "", F.concat(F.lit("（"), notes, F.lit("）"))).otherwise(""))).otherwise(F.col("_f.project_name"))
    m = lambda c: F.when(is_exact, F.col(f"_e.{c}")).otherwise(F.col(f"_f.{c}"))
    j = computed(
        j,
        **{
            "_source": source, "_weak": F.col("_key").isin(*T.WEAK_NAMES),
            **{f"_m_{c}": m(c) for c in ("project_name", "tax_category", "tax_code", "specification", "unit")},
            "_m_rate": F.when(is_exact, F.coalesce(said, "_e.tax_rate")).otherwise(F.col("_f.tax_rate")),
        },
    )
    j = computed(j, _right=T.compact_key("_m_project_name"))
    left, right = F.col("_key"), F.col("_right")
    overlap = F.size(F.array_intersect(T.business_tokens("_key"), T.business_tokens("_m_project_name"))) > 0
    safe = (left != "") & (right != "") & (left.contains(right) | right.contains(left) | overlap)
    hint_only = ~is_exact & ~F.col("_weak")
    # Whether a match counts is told once a line; nearly every column asks for it.
    found = F.col("_m_project_name").isNotNull() & ~(hint_only & ((F.col("_m_tax_category") == "") & (F.col("_m_tax_code") == ""))) & ~(hint_only & ~safe)
    j = computed(j, _found=found)
    found = F.col("_found")
    clash = found & ~hint_only & (F.col("tax_code") != "") & (F.col("_m_tax_code") != "") & (F.col("tax_code") != F.col("_m_tax_code"))
    rename = found & ((is_exact & (F.col("tax_code") == "")) | (~is_exact & ~hint_only)) & (F.col("_m_project_name") != "")
    fill = found & ~clash
    put = lambda c: F.when((found if c == "tax_category" else fill) & (F.coalesce(c, F.lit("")) == "") & (F.col(f"_m_{c}") != ""), F.col(f"_m_{c}")).otherwise(F.col(c))
    target = F.concat_ws(" / ", T.first_filled("_m_tax_category", default="未记录大类"), T.first_filled("_m_tax_code", default="未记录编码"), T.first_filled("_m_rate", default="未记录税率"))
    prefix = F.when(hint_only, "历史开票档案相似项目候选，需人工复核: ").when(is_exact, "历史开票档案精确匹配，需人工复核: ").otherwise("历史开票档案推荐，需人工复核: ")
    note = F.when(
        clash, F.concat(F.lit("历史开票档案提示，需人工复核: "), "_source", F.lit(" 历史编码为 "), "_m_tax_code", F.lit("，当前编码为 "), "tax_code")
    ).otherwise(F.concat(prefix, F.col("_source"), F.lit(" -> "), target))
    spec_ok = fill & ~hint_only & (F.coalesce("specification", F.lit("")) == "") & (F.col("_m_specification") != "") & ~T.is_weak_name("_m_specification")
    return j.withColumns(
        {
            "coding_reference": F.when(found, _note(F.col("coding_reference"), note)).otherwise(F.col("coding_reference")),
            "project_name": F.when(rename, F.col("_m_project_name")).otherwise(F.col("project_name")),
            "tax_category": put("tax_category"), "tax_code": put("tax_code"), "unit": put("unit"),
            "tax_rate": F.when(fill & (F.coalesce("tax_rate", F.lit("")).isin("", "3%")) & (F.coalesce("_m_rate", F.lit("")) != ""), F.col("_m_rate")).otherwise(F.col("tax_rate")),
            "specification": F.when(spec_ok, F.col("_m_specification")).otherwise(F.col("specification")),
            "quantity": F.when(fill & ~hint_only & (F.coalesce("quantity", F.lit("")) == ""), "1").otherwise(F.col("quantity")),
        }
    ).select(*lines.columns)
