"""The category tree: hierarchy, suggestion, code resolution, search and candidate lists.

Every "contains" test is an equi join on substrings, every "starts with" test one on prefixes, and
names are made distinct before they are matched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import skew
from ..functions import text as T
from ..functions.kept import kept_table

ENTRY = ["official_code", "official_name", "category_short_name"]


def code_prefix(code: Column | str) -> Column:
    return F.regexp_replace(F.col(code) if isinstance(code, str) else code, "0+$", "")


def child_pairs(taxonomy: DataFrame, strict: bool) -> DataFrame:
    """(parent, child) over all levels. ``strict`` wants at least one cut zero on the parent."""
    codes = taxonomy.select("official_code").distinct()
    parents = codes.select(F.col("official_code").alias("parent"), code_prefix("official_code").alias("prefix")).filter(F.col("prefix") != "")
    if strict:
        parents = parents.filter(F.col("prefix") != F.col("parent"))
    lengths = skew.key_lengths(parents, "prefix").alias("_lengths")
    starts = codes.select(F.col("official_code").alias("child"), lengths).select(
        "child", F.explode(skew.substrings(F.col("child"), F.col("_lengths"), prefix_only=True)).alias("prefix")
    )
    return starts.join(parents, "prefix").filter(F.col("child") != F.col("parent")).select("parent", "child")


def code_hierarchy(taxonomy: DataFrame) -> DataFrame:
    """Per code: both forms of the summary test and the leaf it is promoted to."""
    loose = child_pairs(taxonomy, strict=False).select(F.col("parent").alias("official_code")).distinct().withColumn("is_summary", F.lit(True))
    pairs = child_pairs(taxonomy, strict=True)
    inner = pairs.select(F.col("parent").alias("child")).distinct().withColumn("child_is_inner", F.lit(True))
    names = skew.first_by(taxonomy.select("official_code", "official_name"), ["official_code"], ["official_name"])
    named = (
        pairs.join(inner, "child", "left")
        .join(names.select(F.col("official_code").alias("child"), F.col("official_name").alias("child_name")), "child")
        .join(names.select(F.col("official_code").alias("parent"), F.col("official_name").alias("parent_name")), "parent")
    )
    other = F.col("child_name").startswith("其他") | F.col("child_name").contains(F.concat(F.lit("其他"), "parent_name"))
    leaf = F.col("child_is_inner").isNull()
    promoted = named.groupBy(F.col("parent").alias("official_code")).agg(
        F.coalesce(
            F.when(F.bool_or(other), F.min(F.when(other & leaf, F.col("child")))).otherwise(F.min(F.when(leaf, F.col("child")))),
            F.min("child"),
        ).alias("leaf_code"),
        F.count(F.lit(1)).alias("children"),
    )
    return (
        names.join(loose, "official_code", "left")
        .join(promoted, "official_code", "left")
        .select(
            "official_code", "official_name", F.coalesce("is_summary", F.lit(False)).alias("is_summary"),
            F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("leaf_code", "official_code").alias("leaf_code"),
        )
    )


def _keyed(taxonomy: DataFrame, pos: str) -> DataFrame:
    return taxonomy.select(
        *ENTRY, F.col(pos).alias("pos"), T.alias_key("official_name").alias("official_key"), T.alias_key("category_short_name").alias("short_key")
    )


def _first_entries(keyed: DataFrame, field: str) -> DataFrame:
    """First entry in file order per key of a field; later ones can never win."""
    return skew.first_by(keyed.filter(F.col(field) != "").select(*ENTRY, "pos", F.col(field).alias("target")), ["target"], ["pos"])


def _pairs(queries: DataFrame, targets: DataFrame, reverse: bool) -> DataFrame:
    """(q, target) where the target contains the query, or with ``reverse`` the query the target."""
    if reverse:
        return skew.contained_in(queries, "q", "q2", targets, "target")
    found = skew.contained_in(targets.select("target", F.col("target").alias("t2")), "target", "t2", queries, "q")
    return found.select("q", "target")


def suggest_taxonomy(names: DataFrame, taxonomy: DataFrame, column: str = "project_name", pos: str = "official_code") -> DataFrame:
    """Best entry per distinct name key ``q``: equal, contained, contains, then shared character pairs."""
    q = names.select(T.alias_key(column).alias("q")).filter(F.col("q") != "").distinct()
    doubled = q.withColumn("q2", F.col("q"))
    keyed = _keyed(taxonomy, pos)
    scored = []
    # Scores for equal, contained and reverse contained, then base, step and top for pairs.
    for rank, (field, label, equal, inside, around, base, step, most) in enumerate(
        (("official_key", "taxonomy_name", 98, 88, 74, 64, 6, 78), ("short_key", "taxonomy_short", 92, 82, 70, 58, 5, 72))
    ):
        entries = _first_entries(keyed, field)
        targets = entries.select("target")
        held = _pairs(doubled, targets, reverse=False).filter(F.length("q") >= 2)
        holding = _pairs(doubled, targets.filter(F.length("target") >= 2), reverse=True)
        same = q.join(targets, q["q"] == targets["target"])
        grams = q.select("q", F.explode(T.bigrams(F.col("q"))).alias("gram")).groupBy("q", "gram").agg(F.count(F.lit(1)).alias("times"))
        index = targets.select("target", F.explode(F.array_distinct(F.concat(T.bigrams(F.col("target")), F.filter(F.split("target", ""), lambda c: c != "")))).alias("gram"))
        shared = grams.join(index, "gram").select("q", "target", F.lit(0).alias("kind"), "times")
        kind = lambda df, n: df.select("q", "target", F.lit(n).alias("kind"), F.lit(0).cast("bigint").alias("times"))
        pairs = kind(same, 3).unionByName(kind(held, 2)).unionByName(kind(holding, 1)).unionByName(shared)
        best = pairs.groupBy("q", "target").agg(F.max("kind").alias("kind"), F.sum("times").alias("hits"))
        k = F.col("kind")
        scored.append(
            best.join(entries, "target").select(
                "q", *ENTRY, "pos", F.lit(rank).alias("rank"),
                F.when(k == 3, equal).when(k == 2, inside).when(k == 1, around)
                .otherwise(F.least(F.lit(base) + F.col("hits") * step, F.lit(most))).cast("int").alias("score"),
                F.concat(F.lit(label), F.element_at(F.array(*[F.lit(x) for x in ("_bigram", "_reverse_contains", "_contains", "_exact")]), k + 1)).alias("matched_on"),
            )
        )
    both = scored[0].unionByName(scored[1])
    row = F.struct(*ENTRY, "score", "matched_on")
    return both.groupBy("q").agg(F.min_by(row, F.struct(-F.col("score"), "pos", "rank")).alias("s")).select("q", "s.*")


def match_entries(queries: DataFrame, taxonomy: DataFrame, short_equal: int, pos: str = "official_code") -> DataFrame:
    """Entry per distinct query key ``q`` for code resolution; the first best in file order."""
    q = queries.select("q").filter(F.col("q") != "").distinct()
    doubled = q.withColumn("q2", F.col("q"))
    keyed = _keyed(taxonomy, pos)
    official, short = _first_entries(keyed, "official_key"), _first_entries(keyed, "short_key")

    def arm(pairs: DataFrame, entries: DataFrame, score) -> DataFrame:
        return pairs.join(entries, "target").select("q", *ENTRY, "pos", F.lit(score).alias("score"))

    equal = lambda entries: q.join(entries.select("target"), F.col("q") == F.col("target"))
    arms = [
        arm(equal(official), official, 110),
        arm(equal(short), short, short_equal),
        arm(_pairs(doubled, official.select("target"), False), official, 90),
        arm(_pairs(doubled, short.select("target"), False), short, 88),
        arm(_pairs(doubled, short.select("target"), True), short, 70),
    ]
    union = arms[0]
    for a in arms[1:]:
        union = union.unionByName(a)
    return union.groupBy("q").agg(F.min_by(F.struct(*ENTRY, "score"), F.struct(-F.col("score"), "pos")).alias("m")).select("q", "m.*")


def resolve_codes(
    lines: DataFrame, taxonomy: DataFrame, sheet: bool = False, pos: str = "official_code",
    categories: DataFrame | None = None, names: DataFrame | None = None,
) -> DataFrame:
    """Adds ``resolved_code`` and ``resolved_short``: by category, else by item name, promoted to a leaf.

    Lines with a code keep it; the sheet form also promotes that code and takes its short name.
    ``categories`` and ``names`` (column ``v``) may list the values as the lines spell them, where a caller knows
    them without running the plan behind ``lines`` once more. Each spelling is matched once, and lines meet the result by their spelling.
    """
    code = T.strip("tax_code")
    taxonomy = kept_table(taxonomy, "taxonomy")
    shorts = skew.first_by(taxonomy.select("official_code", "category_short_name"), ["official_code"], ["category_short_name"])
    leaf = kept_table(code_hierarchy(taxonomy).select("official_code", "leaf_code").join(
        shorts.select(F.col("official_code").alias("leaf_code"), F.col("category_short_name").alias("leaf_short")), "leaf_code", "left"
    ).select("official_code", F.struct("leaf_code", "leaf_short").alias("leaf")), "leaves")

    def dimension(given: DataFrame | None, column: str, short_equal: int, key: str, out: str) -> DataFrame:
        values = (lines.select(F.col(column).alias("v")) if given is None else given).distinct()
        spelt = kept_table(values.select("v", T.alias_key("v").alias("q")).filter(F.col("q") != ""), "spellings")
        found = match_entries(spelt, taxonomy, short_equal, pos).join(leaf, "official_code")
        return spelt.join(found, "q").select(F.col("v").alias(key), F.col("leaf").alias(out))

    base = lines.withColumns({"_cv": F.col("tax_category"), "_nv": F.col("project_name")})
    found = skew.looked_up(base, dimension(categories, "tax_category", 120, "_cv", "_by_category"), "_cv")
    found = skew.looked_up(found, dimension(names, "project_name", 105, "_nv", "_by_name"), "_nv")
    if sheet:
        found = skew.looked_up(found.withColumn("_given", code), leaf.select(F.col("official_code").alias("_given"), F.col("leaf").alias("_own")), "_given")
    else:
        found = found.withColumn("_own", F.lit(None).cast("struct<leaf_code:string,leaf_short:string>"))
    # A general name is not looked up on its own, only next to a category.
    allowed = F.when((T.alias_key("tax_category") != "") | ~T.is_uncoded_name("project_name"), F.col("_by_name"))
    best = F.coalesce("_by_category", allowed)
    own_short = T.or_none("tax_category")
    return found.withColumn("_best", best).select(
        *lines.columns,
        F.when(code != "", F.coalesce("_own.leaf_code", code)).otherwise(F.coalesce("_best.leaf_code", F.lit(""))).alias("resolved_code"),
        F.coalesce(F.when(code != "", F.coalesce(own_short, "_own.leaf_short")).otherwise(F.coalesce("_best.leaf_short", own_short)), F.lit("")).alias("resolved_short"),
    )


def search_taxonomy(queries: DataFrame, taxonomy: DataFrame, column: str = "query", limit: int = 40) -> DataFrame:
    """Ranked entries per distinct query over code, name, short name and description."""
    q = queries.select(T.search_key(column).alias("q")).filter(F.col("q") != "").distinct()
    fields = {"code": "official_code", "name": "official_name", "short": "category_short_name", "description": "description"}
    entries = taxonomy.filter(~T.is_blank("official_code")).select(
        *ENTRY, "description", *[T.search_key(c).alias(f"k_{f}") for f, c in fields.items()]
    )
    lengths = skew.key_lengths(q, "q").alias("_lengths")
    by_code = entries.select("official_code", "k_code", lengths).select(
        "official_code", F.explode(skew.substrings(F.col("k_code"), F.col("_lengths"), prefix_only=True)).alias("q")
    ).join(q, "q", "left_semi").select("official_code", "q")
    pairs = by_code
    for f in ("name", "short", "description"):
        pairs = pairs.unionByName(skew.contained_in(entries, "official_code", f"k_{f}", q, "q"))
    joined = pairs.distinct().join(entries, "official_code").join(code_hierarchy(taxonomy).select("official_code", "is_summary"), "official_code")
    k = F.col("q")
    score = (
        F.when(k == F.col("k_code"), 120)
        .when(F.col("k_code").startswith(k), 105)
        .when(F.col("k_name") == k, 100)
        .when(F.col("k_short") == k, 92)
        .when(F.col("k_name").startswith(k), 88)
        .when(F.col("k_short").startswith(k), 82)
        .when(F.col("k_name").contains(k), 72)
        .when(F.col("k_short").contains(k), 64)
        .otherwise(38)
    )
    ranked = joined.withColumn("score", score + F.when(F.col("is_summary"), 0).otherwise(8))
    return skew.top_n(ranked, ["q"], [F.desc("score"), F.col("is_summary"), F.col("official_code")], limit, "rank").select(
        "q", "rank", *ENTRY, "is_summary", "score"
    )


# Words in an item text, and the entry wording they hint at with its weight.
HINTS = (
    ("(?i)亚克力|有机玻璃|展示牌|标牌|铭牌|招牌|指示牌", (
        ("塑料板|塑料制品|其他塑料制品|塑料零件", 52), ("发光标志|发光铭牌|标志牌|指示牌|铭牌", 48), ("装饰用纤维增强塑料制品", 36))),
    ("(?i)LED|灯带|灯具|灯饰|照明", (
        ("灯具及照明装置|装饰用灯|室内照明灯具|户外照明", 64), ("电光源|半导体光电器件|发光二极管", 46), ("灯用电器附件|照明装置零件", 28))),
    ("不锈钢|挂钩|五金|金属", (("金属制品|钢铁制品|钢铁制紧固件|其他金属制品", 56), ("钢丝|不锈钢|紧固件|挂钩", 34))),
    ("清洁剂|洗涤剂|去污|玻璃清洁|清洁液", (("合成洗涤剂|洗涤剂|擦洗膏|去污粉", 64), ("日用杂品|清洁清扫", 34))),
    ("防滑|地垫|脚垫|门垫|浴室垫|垫子", (("地毯|浴室垫|门前垫|机制地毯|挂毯", 62), ("日用塑料制品|其他塑料制品|橡胶制品|纺织产品", 38))),
)
# Words of medical goods.
MEDICAL = "医|药|械|针|电极|耗材|一次性|导管|探头|诊断|治疗|手术|卫生"
# Entries offered when too few others fit.
FALLBACK_CODES = (
    "1070601990000000000", "1070601020000000000", "1070601120000000000", "1060512040000000000",
    "1070222020000000000", "1070299030000000000", "1060507020000000000", "1060507000000000000",
    "1090424000000000000", "1090424030000000000", "1090424050000000000", "1090423990000000000",
    "1090516030000000000", "1080414990000000000", "1080414010000000000", "1060401990000000000",
)
FEW_CANDIDATES = 18


def taxonomy_candidates(items: DataFrame, taxonomy: DataFrame, limit: int = 80, fallback=FALLBACK_CODES, pos: str = "official_code") -> DataFrame:
    """Ranked candidate entries per distinct item text: shared character pairs plus wording hints.

    ``items`` has project_name, specification and tax_category; the result is keyed by ``item_text``.
    """
    item_text = T.strip(F.concat_ws(" ", "project_name", "specification", "tax_category"))
    texts = items.select(item_text.alias("item_text")).filter(F.col("item_text") != "").distinct()
    entries = taxonomy.select(*ENTRY, "description", F.col(pos).alias("pos"))
    haystack = F.concat_ws(" ", "official_name", "category_short_name", "description")
    name_desc = F.concat("official_name", F.coalesce("description", F.lit("")))
    text = F.col("item_text")

    def grams_of(column: Column) -> Column:
        key = T.alias_key(column)
        return F.array_distinct(F.concat(T.bigrams(key), F.filter(F.split(key, ""), lambda c: c != "")))

    fields = (("official_name", 10), ("category_short_name", 7), ("description", 3))
    index = None
    for column, weight in fields:
        part = entries.select("official_code", F.explode(grams_of(F.col(column))).alias("feature"), F.lit(weight).alias("weight"))
        index = part if index is None else index.unionByName(part)
    index = index.groupBy("official_code", "feature").agg(F.max("weight").alias("weight"))
    wanted = texts.select("item_text", F.explode(T.bigrams(T.alias_key("item_text"))).alias("feature")).groupBy("item_text", "feature").agg(
        F.count(F.lit(1)).alias("times")
    )
    # Hints become features of their own, so that they ride on the same equi join.
    entry_hints, text_hints = [], []
    for family, (words, patterns) in enumerate(HINTS):
        for i, (pattern, weight) in enumerate(patterns):
            name = f"#hint{family}.{i}"
            entry_hints.append(F.when(haystack.rlike(pattern), F.struct(F.lit(name).alias("feature"), F.lit(weight).alias("weight"))))
            text_hints.append(F.when(text.rlike(words), F.lit(name)))
    medical = F.col("official_code").startswith("109024") | F.col("official_name").contains("医") | F.col("description").rlike("医疗|医用")
    for name, on_entry, on_text, weight in (
        ("#medical", medical, text.rlike(MEDICAL), 32),
        ("#needle", name_desc.rlike("注射|穿刺|针"), text.contains("针"), 45),
        ("#electrode", name_desc.rlike("电极|高频|诊断|治疗|监护"), text.contains("电极"), 28),
    ):
        entry_hints.append(F.when(on_entry, F.struct(F.lit(name).alias("feature"), F.lit(weight).alias("weight"))))
        text_hints.append(F.when(on_text, F.lit(name)))
    hint_index = entries.select("official_code", F.explode(F.array_compact(F.array(*entry_hints))).alias("h")).select("official_code", "h.feature", "h.weight")
    hint_texts = texts.select("item_text", F.explode(F.array_compact(F.array(*text_hints))).alias("feature"), F.lit(1).cast("bigint").alias("times"))
    scored = (
        wanted.unionByName(hint_texts)
        .join(index.unionByName(hint_index), "feature")
        .groupBy("item_text", "official_code")
        .agg(F.sum(F.col("times") * F.col("weight")).alias("score"))
    )
    top = skew.top_n(scored, ["item_text"], [F.desc("score"), F.col("official_code")], limit, "rank")
    counts = top.groupBy("item_text").agg(F.count(F.lit(1)).alias("n"))
    known = entries.select("official_code", "pos").withColumnRenamed("pos", "file_pos")
    spare = (
        texts.join(counts, "item_text", "left")
        .filter(F.coalesce("n", F.lit(0)) < min(FEW_CANDIDATES, limit))
        .select("item_text", F.coalesce("n", F.lit(0)).alias("n"), F.explode(F.array(*[F.lit(c) for c in fallback])).alias("official_code"))
        .join(known, "official_code")
        .join(top.select("item_text", "official_code"), ["item_text", "official_code"], "left_anti")
    )
    numbered = skew.top_n(spare, ["item_text"], [F.col("file_pos")], limit, "extra").select(
        "item_text", "official_code", F.lit(0).cast("bigint").alias("score"), (F.col("n") + F.col("extra")).cast("int").alias("rank")
    )
    both = top.select("item_text", "official_code", "score", "rank").unionByName(numbered).filter(F.col("rank") <= limit)
    return both.join(entries.select(*ENTRY), "official_code").select("item_text", "rank", *ENTRY, "score")
