"""Readers and writers: rules, category tree, history exports, profile documents, events, files, ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as St

from ..functions import text as T
from ..operators.coding import coding_states
from ..operators.standardize import split_full_name
from .keyed import KeyedTable, replace_by_key  # noqa: F401
from .positions import with_file_columns, with_positions


def _strings(names: str) -> St.StructType:
    return St.StructType([St.StructField(n, St.StringType()) for n in names.split()])


RULE_COLUMNS = (
    "rule_id status raw_alias normalized_invoice_name tax_category tax_code tax_treatment_or_rate decision_basis confidence "
    "source_case_ids company_name source_operator original_project_name final_project_name conflict_with_rule_id created_at "
    "updated_at hit_count"
)
FORMAL_COLUMNS = (
    "entry_id library_segment raw_alias normalized_invoice_name tax_category tax_treatment_or_rate decision_basis source_case_ids "
    "primary_evidence confidence status"
)
# Tiers in order of preference and how a hit names them.
TIERS = {"tenant": (0, "客户规则"), "learned": (1, "本地即时规则"), "formal": (2, "内置基础规则")}


def rule_entries(rows: DataFrame, tier: str) -> DataFrame:
    """Usable rules of a tier: ready, and for the two own tiers with alias and category."""
    order, label = TIERS[tier]
    keep = T.strip("status") == "ready"
    if tier != "formal":
        keep = keep & ~T.is_blank("raw_alias") & ~T.is_blank("tax_category")
    code = F.lit("") if tier == "formal" else T.strip("tax_code")
    return rows.filter(keep).select(
        F.lit(order).alias("tier"),
        T.strip("entry_id" if tier == "formal" else "rule_id").alias("entry_id"),
        *[T.strip(c).alias(c) for c in ("raw_alias", "normalized_invoice_name", "tax_category")],
        code.alias("tax_code"),
        T.strip("tax_treatment_or_rate").alias("tax_treatment_or_rate"),
        F.lit(label).alias("source_label"),
    )


def read_rules(spark: SparkSession, path: str, tier: str) -> DataFrame:
    schema = _strings(FORMAL_COLUMNS if tier == "formal" else RULE_COLUMNS)
    return rule_entries(spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path), tier)


def union_tiers(*tiers: DataFrame) -> DataFrame:
    """Rule tiers in one table; ``tier`` and ``entry_id`` keep the order of preference."""
    return reduce(DataFrame.unionByName, tiers)


def taxonomy_entries(rows: DataFrame, need: str = "official_name") -> DataFrame:
    """Entries with a name (to suggest from) or with a code (to search in)."""
    columns = ("official_code", "official_name", "category_short_name", "description")
    return rows.select(*[T.strip(c).alias(c) for c in columns]).filter(F.col(need) != "")


def read_taxonomy(spark: SparkSession, path: str, need: str = "official_name") -> DataFrame:
    schema = _strings("official_code official_name category_short_name description")
    return taxonomy_entries(spark.read.schema(schema).option("header", True).csv(path), need)


# Headers of the official history export and the names used here.
HISTORY_HEADERS = {
    "数电发票号码": "serial", "销方识别号": "seller_tax_id", "销方名称": "seller_name", "购方识别号": "buyer_tax_id",
    "购买方名称": "buyer_name", "开票日期": "invoice_date", "税收分类编码": "tax_code", "货物或应税劳务名称": "full_item_name",
    "规格型号": "specification", "单位": "unit", "数量": "quantity", "单价": "unit_price", "金额": "amount", "税率": "tax_rate",
    "税额": "tax_amount", "价税合计": "amount_with_tax", "发票来源": "invoice_source", "发票票种": "invoice_kind",
    "发票状态": "invoice_status", "是否正数发票": "is_positive", "发票风险等级": "risk_level",
}
REQUIRED_HISTORY = ("销方识别号", "销方名称", "购方识别号", "购买方名称", "税收分类编码", "货物或应税劳务名称", "税率", "价税合计")
HISTORY_MONEY = ("amount", "tax_amount", "amount_with_tax", "unit_price")


def history_rows(raw: DataFrame) -> DataFrame:
    """Export rows with their official headers to typed history lines; a table lacking one is refused."""
    missing = sorted(set(REQUIRED_HISTORY) - set(raw.columns))
    if missing:
        raise ValueError("history export lacks the headers " + ", ".join(missing))
    named = raw.select(
        *[F.col(f"`{h}`").alias(n) if h in raw.columns else F.lit("").alias(n) for h, n in HISTORY_HEADERS.items()],
        *[c for c in raw.columns if c not in HISTORY_HEADERS],
    )
    category, name = split_full_name("full_item_name")
    kept = named.filter(~T.is_blank("seller_name") & ~T.is_blank("seller_tax_id")).withColumns({"tax_category": category, "project_name": name})
    return kept.withColumns({c: T.parse_money(F.col(c).cast("string")).cast("decimal(18,2)") for c in HISTORY_MONEY})


#: Cells that a row of an export is read with; the official export has 21.
MOST_CELLS = 64


def _history_cells(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """(source_file, line_no, cells) of all rows of all files, blank rows aside; the header is row 1 of its file."""
    names = [f"_{i}" for i in range(MOST_CELLS)]
    raw = spark.read.schema(_strings(" ".join(names))).option("header", False).option("multiLine", multi_line).option("escape", '"').csv(path)
    rows = with_positions(with_file_columns(raw))
    return rows.select("source_file", "line_no", F.array(*[F.col(n) for n in names]).alias("cells"))


def _history_headers(cells: DataFrame) -> DataFrame:
    """Per file: the place of every official header (0: absent) and the required ones that it lacks."""
    first = cells.filter("line_no = 1").select("source_file", F.transform("cells", lambda c: F.regexp_replace(T.strip(F.coalesce(c, F.lit(""))), "^\ufeff", "")).alias("h"))
    places = F.array(*[F.coalesce(F.array_position("h", h), F.lit(0)).cast("int") for h in HISTORY_HEADERS])
    lacking = F.array_compact(F.array(*[F.when(~F.array_contains("h", h), F.lit(h)) for h in sorted(REQUIRED_HISTORY)]))
    return first.select("source_file", places.alias("places"), lacking.alias("missing"))


def read_history(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Line exports as CSV, each file by its own header; ``line_key`` is the row's number in its file, the header being 1.

    Files may order and omit columns as they like. A file that lacks a required header gives no rows; :func:`history_files` names
    it. ``multi_line`` reads values with line breaks; each file is then one task.
    """
    cells = _history_cells(spark, path, multi_line)
    good = _history_headers(cells).filter(F.size("missing") == 0).select("source_file", "places")
    rows = cells.filter("line_no > 1").join(good, "source_file")
    # Place 0 stands for a header that the file has not.
    values = [F.coalesce(F.when(F.get("places", F.lit(i)) > 0, F.get("cells", F.get("places", F.lit(i)) - 1)), F.lit("")).alias(h) for i, h in enumerate(HISTORY_HEADERS)]
    return history_rows(rows.select(*values, "source_file", F.col("line_no").alias("line_key")))


def history_files(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """(source_file, status, missing, row_count, line_count) per file: 'imported', 'refused' for want of a header, or 'empty' without usable rows."""
    cells = _history_cells(spark, path, multi_line)
    rows = cells.groupBy("source_file").agg(F.count_if(F.col("line_no") > 1).alias("row_count"))
    lines = read_history(spark, path, multi_line).groupBy("source_file").agg(F.count(F.lit(1)).alias("line_count"))
    counted = _history_headers(cells).join(rows, "source_file").join(lines, "source_file", "left").withColumn("line_count", F.coalesce("line_count", F.lit(0).cast("bigint")))
    status = F.when(F.size("missing") > 0, "refused").when(F.col("line_count") == 0, "empty").otherwise("imported")
    return counted.select("source_file", status.alias("status"), F.array_join("missing", "、").alias("missing"), "row_count", "line_count")


PROFILE_SCHEMA = St.StructType(
    [
        St.StructField("seller_name", St.StringType()),
        St.StructField("seller_tax_id", St.StringType()),
        St.StructField("source_confidence", St.StringType()),
        St.StructField("updated_at", St.StringType()),
        St.StructField(
            "project_profiles",
            St.ArrayType(
                St.StructType(
                    [St.StructField(c, St.StringType()) for c in "full_item_name tax_category project_name tax_code tax_rate unit".split()]
                    + [St.StructField("line_count", St.LongType()), St.StructField("confidence", St.StringType())]
                )
            ),
        ),
        St.StructField(
            "buyer_profiles",
            St.ArrayType(
                St.StructType(
                    [St.StructField("buyer_name", St.StringType()), St.StructField("buyer_tax_id", St.StringType()), St.StructField("line_count", St.LongType())]
                )
            ),
        ),
    ]
)


def read_profiles(spark: SparkSession, path: str, array_files: bool = False) -> DataFrame:
    """Profile documents: JSON lines as written here, or whole-file JSON arrays; broken ones give no rows."""
    reader = spark.read.schema(PROFILE_SCHEMA).option("mode", "DROPMALFORMED")
    return reader.option("multiLine", array_files).json(path)


def write_profiles(path: str, sellers: DataFrame, projects: DataFrame, buyers: DataFrame, documents: DataFrame) -> None:
    """The three flat tables as CSV with header, and the documents as JSON lines."""
    for name, df in (("seller_profiles", sellers), ("seller_project_profiles", projects), ("buyer_profiles", buyers)):
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    documents.withColumn("updated_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).write.mode("overwrite").json(f"{path}/documents")


# Extensions by file type and the notes of the inventory.
SHEET_SUFFIXES = (".xlsx",)
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".webp", ".bmp")
INBOX, HISTORY_DIR, PROFILE_DIR = "_收件箱", "历史开票明细", "_档案库"


def file_inventory(files: DataFrame, root: str) -> DataFrame:
    """Per file: path below ``root``, type, size, hash and note.

    ``files``: path, length and content, as the binaryFile source gives them. A row holds a whole file, so that source
    refuses files over its own limit of 2 GB.
    """
    base = root.removeprefix("file:").strip("/") + "/"
    plain = F.regexp_replace("path", "^(file:)?/*", "")
    relative = F.when(plain.startswith(base), F.ltrim(F.substring(plain, len(base) + 1, 2**31 - 1), F.lit("/"))).otherwise(plain)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    image = suffix.isin(*IMAGE_SUFFIXES)
    parts = F.split("relative_path", "/")
    return (
        files.withColumn("relative_path", relative)
        .filter((F.element_at(parts, 1) != PROFILE_DIR) & ~F.col("path").endswith(".DS_Store"))
        .select(
            "relative_path",
            F.when(suffix.isin(*SHEET_SUFFIXES), "excel_history_or_candidate").when(image, "image_material").otherwise("other").alias("type"),
            F.col("length").alias("size_bytes"),
            F.sha2("content", 256).alias("sha256"),
            F.when(F.array_contains(parts, INBOX), "收件箱归档文件")
            .when(F.array_contains(parts, HISTORY_DIR), "客户历史开票明细")
            .when(image, "图片/截图材料，默认需人工复核")
            .otherwise("")
            .alias("note"),
        )
    )


def read_file_inventory(spark: SparkSession, root: str) -> DataFrame:
    return file_inventory(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root), root)


LEDGER_PARTS = 64
LEDGER_COLUMNS = (
    "case_id draft_id line_no saved_at company_name buyer_name buyer_tax_id project_name tax_category tax_code source_item_code specification unit "
    "quantity unit_price amount_with_tax tax_rate coding_reference coding_state note"
).split()
FEEDBACK_COLUMNS = [
    *("case_id", "draft_id", "line_no", "saved_at", "candidate_status"),
    *(c for c in LEDGER_COLUMNS[4:] if c != "coding_state"),
]


def ledger_rows(drafts: DataFrame, lines: DataFrame, saved_at: Column) -> DataFrame:
    """The ledger's row of every draft line: numbered by ``line_no`` from 1 in its draft, with resolved amount, normal rate and coding state."""
    number = F.row_number().over(W.partitionBy("draft_id").orderBy("line_no"))
    amount = F.coalesce(T.money_text(T.resolved_amount("amount_with_tax", "quantity", "unit_price")), F.lit(""))
    made = lines.withColumn("amount_with_tax", amount).withColumn("tax_rate", T.canonical_rate("tax_rate")).withColumn("line_no", number.cast("string"))
    head = drafts.select("draft_id", *[c for c in ("case_id", "company_name", "buyer_name", "buyer_tax_id", "note")])
    return coding_states(made.join(head, "draft_id")).withColumn("saved_at", saved_at).select(*LEDGER_COLUMNS, "candidate_status")


def write_ledger(spark: SparkSession, path: str, new: DataFrame, parts: int = LEDGER_PARTS, label: str = "") -> None:
    """Replace the drafts in ``new``; only the ledger's buckets that they fall into are rewritten. Another number of ``parts`` lays the ledger out anew."""
    KeyedTable(spark, path, ["draft_id"], parts).commit(new, label=label)


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    return KeyedTable(spark, path, ["draft_id"]).read()


def save_drafts(spark: SparkSession, path: str, drafts: DataFrame, lines: DataFrame, saved_at: Column | None = None, parts: int = LEDGER_PARTS, label: str = "") -> None:
    """Saves drafts in one go: their ledger rows under ``path``/ledger, and their place in the feedback pool under ``path``/feedback.

    Both replace what the drafts had before; a draft none of whose lines waits for feedback any more leaves the pool.
    """
    when = saved_at if saved_at is not None else F.lit(spark.sql("SELECT date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss\")").first()[0])
    rows = ledger_rows(drafts, lines, when)
    write_ledger(spark, f"{path}/ledger", rows.select(*LEDGER_COLUMNS), parts, label)
    saved = drafts.select("draft_id").distinct()
    merge = lambda old, new: old.join(saved, "draft_id", "left_anti").unionByName(new, allowMissingColumns=True)
    pool = rows.filter(F.col("candidate_status") != "").select(*FEEDBACK_COLUMNS)
    KeyedTable(spark, f"{path}/feedback", ["draft_id"], parts).commit(pool, merge, label, saved)


EVENT_SCHEMA = St.StructType(
    [St.StructField(n, St.StringType()) for n in "event_id case_id draft_id batch_id event_type created_at schema_version payload".split()]
)


def event_rows(lines: DataFrame) -> DataFrame:
    """JSON lines (column ``value``) to events; blank and unreadable lines are dropped, further columns stay."""
    parsed = F.from_json("value", EVENT_SCHEMA, {"mode": "PERMISSIVE"})
    others = [c for c in lines.columns if c != "value"]
    rows = lines.filter(~T.is_blank("value")).select(parsed.alias("e"), *others).select("e.*", *others)
    return rows.filter(F.coalesce(*[F.col(c) for c in EVENT_SCHEMA.names]).isNotNull())


def read_case_events(spark: SparkSession, path: str, tenant: str = "default") -> DataFrame:
    """Event logs of a folder, one file per case or many; the payload stays JSON text.

    ``seq`` is the order of arrival: files by the time of their last change and their name, lines as they stand. An event counts as received when
    its file was last changed, and its file is its request.
    """
    lines = with_positions(with_file_columns(spark.read.option("recursiveFileLookup", True).text(path)), seq="seq")
    received = F.date_format("file_time", "yyyy-MM-dd'T'HH:mm:ss")
    return event_rows(lines).select(
        *EVENT_SCHEMA.names, "seq", F.lit(tenant).alias("tenant"), received.alias("received_at"), request_id(F.lit(tenant), F.col("source_file")).alias("request_id"), "source_file", "line_no"
    )


def request_id(*parts: Column) -> Column:
    """Twelve hexadecimal digits that name a request and stay the same when it is read again."""
    return F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, 12)


def case_log(spark: SparkSession, path: str, buckets: int = 64) -> KeyedTable:
    return KeyedTable(spark, path, ["case_id"], buckets, form="json")


def write_case_events(events: DataFrame, path: str, buckets: int = 64, label: str = "") -> None:
    """Adds events to a log of JSON lines in hashed buckets of their case. Events whose id the log has are left out, so a repeated write adds nothing."""
    log = case_log(events.sparkSession, path, buckets)
    log.commit(events.dropDuplicates(["event_id"]), lambda old, new: old.unionByName(new.join(old.select("event_id"), "event_id", "left_anti"), allowMissingColumns=True), label)


def read_case_log(spark: SparkSession, path: str) -> DataFrame | None:
    return case_log(spark, path).read()
