"""Incremental jobs: event ingest, live case states, profile upserts, rule publishing, file intake.

Every ``foreachBatch`` writes its own ``batch=<id>`` folder and overwrites it when the batch is run
again, so a lost executor or driver never doubles rows. State lives in these tables, not in memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import skew
from ..functions import text as T
from ..operators import events as ev
from ..sources import tables as src
from ..sources.keyed import KeyedTable
from ..sources.positions import SPLIT, number_kept, with_file_columns, with_positions

SELLER_KEY = ["tenant", "seller_tax_id"]
BUYER_KEY = ["tenant", "seller_tax_id", "buyer_tax_id", "buyer_name"]
LINE_KEY = ["tenant", "seller_tax_id", "project_name", "tax_category", "tax_code", "tax_rate", "unit"]


def _stored(spark: SparkSession, path: str, but: int | None = None) -> DataFrame | None:
    """Rows of the finished batches, null when there are none; ``but`` leaves the running batch out."""
    try:
        df = spark.read.option("basePath", path).parquet(path)
    except Exception as exc:
        if "PATH_NOT_FOUND" in str(exc) or "UNABLE_TO_INFER_SCHEMA" in str(exc):
            return None
        raise
    return df if but is None else df.filter(F.col("batch") != but)


def _put(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


# --- events ---------------------------------------------------------------------------------

#: Hash buckets of the event table (by case), of the index of seen ids, and of the case states.
EVENT_BUCKETS, SEEN_BUCKETS, STATE_BUCKETS = 64, 256, 64


def accept_events(batch: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Events of a batch whose id was never seen, the first of each id. The id is global over tenants."""
    fresh = skew.first_by(batch, ["event_id"], ["seq"])
    return fresh if stored is None else fresh.join(stored.select("event_id"), "event_id", "left_anti")


def ingest_report(batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Several request batches (batch_no, seq, event_id, …) at once: accepted events and counts per batch."""
    accepted = skew.first_by(batches, ["event_id"], ["batch_no", "seq"])
    sent = batches.groupBy("batch_no").agg(F.count(F.lit(1)).alias("event_count"))
    taken = accepted.groupBy("batch_no").agg(F.count(F.lit(1)).alias("accepted"))
    counts = sent.join(taken, "batch_no", "left").withColumn("accepted", F.coalesce("accepted", F.lit(0)))
    return accepted, counts.withColumn("duplicates", F.col("event_count") - F.col("accepted"))


class EventStore:
    """Accepted events, the index of their ids, the log of requests and the case states, below one folder or where they are told to be."""

    def __init__(self, spark: SparkSession, events: str, log: str, seen: str | None = None, states: str | None = None):
        self.events = KeyedTable(spark, events, ["case_id"], EVENT_BUCKETS)
        self.seen = KeyedTable(spark, seen or f"{events}-seen", ["event_id"], SEEN_BUCKETS)
        self.states = KeyedTable(spark, states or f"{events}-states", ["tenant", "case_id"], STATE_BUCKETS)
        self.log = KeyedTable(spark, log, ["request_id"], 1)

    def mark(self, but: str | None = None) -> int:
        """The highest arrival number that a finished request gave out."""
        log = self.log.read(but)
        return 0 if log is None else log.agg(F.coalesce(F.max("last_seq"), F.lit(0)).alias("n")).first()["n"]

    def accept(self, batch: DataFrame, tenant: str, source: str, sent_at: str, label: str) -> None:
        """Takes one request in: a row per event read, in arrival order by its file columns, or by ``seq`` where the sender numbers events itself.

        Events with a new id get the numbers after the highest of all requests before, so a request that is taken in again under its label gives the
        same rows and the same numbers. Of the index, only the buckets that the request's ids fall into are read.
        """
        request = src.request_id(F.lit(tenant), F.lit(label))
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
        rows, place = (batch, ["seq"]) if "seq" in batch.columns else (with_positions(batch), [*SPLIT, "line_no"])
        first = skew.first_by(rows, ["event_id"], place)
        known = self.seen.read_for(first.select("event_id"), label)
        fresh = first if known is None else first.join(known.select("event_id"), "event_id", "left_anti")
        if "seq" not in batch.columns:
            fresh = number_kept(fresh, "seq", self.mark(label))
        stamped = fresh.withColumns({"tenant": F.lit(tenant), "received_at": now, "request_id": request})
        self.events.add(stamped.select(*src.EVENT_SCHEMA.names, "seq", "tenant", "received_at", "request_id"), label)
        # What is stored counts: it gives the same rows however often it is read.
        taken = self.events.read_commit().filter(F.col("request_id") == request)
        self.seen.add(taken.select("event_id", "seq"), label)
        merge = lambda old, new: ev.merge_states(old.unionByName(new))
        self.states.commit(ev.partial_states(taken), merge, label)
        done = taken.agg(F.count(F.lit(1)).alias("accepted"), F.max("seq").alias("last_seq")).select(F.struct("*").alias("d")).scalar()
        counts = batch.agg(F.count(F.lit(1)).alias("event_count")).withColumn("d", done)
        times = [request.alias("request_id"), F.lit(tenant).alias("tenant"), F.lit(source).alias("source"), F.lit(sent_at).alias("sent_at"), now.alias("received_at")]
        self.log.add(counts.select(*times, "event_count", "d.accepted", (F.col("event_count") - F.col("d.accepted")).alias("duplicates"), "d.last_seq"), label)

    def summary(self) -> DataFrame:
        """The state of every case; equal to the case summary of all accepted events."""
        return ev.finish_states(self.states.read())


def ingest_events(stream: DataFrame, table: str, log: str, checkpoint: str, tenant: str = "default", source: str = "", sent_at: str = "") -> StreamingQuery:
    """Takes a stream of events into an :class:`EventStore`, a request per batch; a batch that runs again takes the place of its first run."""
    store = EventStore(stream.sparkSession, table, log)

    def write(batch: DataFrame, number: int) -> None:
        store.accept(batch, tenant, source, sent_at, f"{checkpoint}#{number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_event_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """JSON-line event files as they arrive, each row with its place of arrival."""
    return with_file_columns(spark.readStream.schema(src.EVENT_SCHEMA).options(**options).json(path))


def expiring_events(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """A stream without repeats of an event id that come within ``delay`` of each other by creation time.

    The state store forgets an id after the delay: bounded state for feeds that repeat events soon or never. A later repeat passes, and so does one
    with an unreadable time; :func:`ingest_events` remembers every id.
    """
    timed = stream.withColumn("created_time", F.to_timestamp("created_at")).withWatermark("created_time", delay)
    return timed.dropDuplicatesWithinWatermark(["event_id"])


def case_states(stream: DataFrame, keys: tuple[str, ...] = ("tenant", "case_id")) -> DataFrame:
    """The case summary as a running aggregate over numbered events; write it in update or complete mode."""
    return ev.case_summary(stream, keys)


def pending_events(log: DataFrame, acknowledged: DataFrame, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """Events not acknowledged yet, in order: the next batch of ``limit``, and what stays behind."""
    waiting = log.join(acknowledged.select("event_id").distinct(), "event_id", "left_anti")
    first = waiting.orderBy("seq").limit(limit)
    return first, waiting.join(first.select("event_id"), "event_id", "left_anti")


# --- profiles -------------------------------------------------------------------------------

def upsert(old: DataFrame | None, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last write per key."""
    return skew.last_by(new if old is None else old.unionByName(new, allowMissingColumns=True), keys, order)


def clean_profiles(rows: DataFrame, kind: str) -> DataFrame:
    """Rows with what their key needs; incomplete ones are skipped."""
    if kind == "seller":
        return rows.filter(~T.is_blank("seller_name") & ~T.is_blank("seller_tax_id"))
    if kind == "buyer":
        return rows.filter(~T.is_blank("seller_tax_id") & (~T.is_blank("buyer_name") | ~T.is_blank("buyer_tax_id")))
    named = rows.filter(~T.is_blank("seller_tax_id") & (~T.is_blank("project_name") | ~T.is_blank("tax_code")))
    return named.withColumn("unit", T.first_filled("unit", default="项"))


def read_profile_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return with_file_columns(spark.readStream.schema(src.PROFILE_SCHEMA).options(**options).json(path))


def profile_upserts(stream: DataFrame, path: str, checkpoint: str, tenant: str = "default") -> StreamingQuery:
    """Logs each batch of profile documents as seller, buyer and line rows plus a row of counts.

    Writing stays cheap at any table size; :func:`current_profiles` gives the last write per key: the later batch, in it the later document by its file's
    time, name and line, in it the later entry. A stream without file columns keeps the order in which its batch is read.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = with_positions(batch, seq="pos") if "source_file" in batch.columns else batch.withColumn("pos", F.monotonically_increasing_id())
        stamped = rows.withColumns({"tenant": F.lit(tenant), "status": F.lit("active")})
        both = ["tenant", "status", "seller_name", "seller_tax_id", "pos"]
        good = clean_profiles(stamped, "seller")
        entries = lambda name: good.select(*both, F.posexplode(name).alias("at", "e")).select(*both, "at", "e.*")
        _put(good.select(*both, F.lit(0).alias("at"), "source_confidence", "updated_at"), f"{path}/sellers", number)
        _put(clean_profiles(entries("buyer_profiles"), "buyer"), f"{path}/buyers", number)
        _put(clean_profiles(entries("project_profiles"), "line"), f"{path}/lines", number)
        spark = batch.sparkSession
        count = lambda name: spark.read.parquet(f"{path}/{name}/batch={number}").agg(F.count(F.lit(1)).alias("n")).scalar()
        one = spark.range(1).select(count("sellers").alias("seller_count"), count("buyers").alias("buyer_count"), count("lines").alias("line_profile_count"))
        _put(one, f"{path}/batches", number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_profiles(spark: SparkSession, path: str, kind: str) -> DataFrame:
    name, key = {"seller": ("sellers", SELLER_KEY), "buyer": ("buyers", BUYER_KEY), "line": ("lines", LINE_KEY)}[kind]
    return skew.last_by(spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}"), key, ["batch", "pos", "at"]).drop("pos", "at")


# --- rules ----------------------------------------------------------------------------------

def rule_packages(rules: DataFrame, tenant: str, version: str, published_at: str, note: str = "", entries: int = 2000) -> DataFrame:
    """Rules as package rows; a long list is several rows of one package, cut by rule id."""
    n = rules.agg(F.count(F.lit(1)).alias("n")).scalar()
    fields = ("rule_id", "raw_alias", "normalized_invoice_name", "tax_category", "tax_code", "tax_treatment_or_rate")
    placed = rules.select(*fields, F.ceil(n / F.lit(entries)).alias("_parts")).withColumn("seq", F.when(F.col("_parts") <= 1, 0).otherwise(F.pmod(F.xxhash64("rule_id"), "_parts")))
    packed = placed.groupBy("seq").agg(F.to_json(F.array_sort(F.collect_list(F.struct(*fields)))).alias("rules_json"), F.count(F.lit(1)).alias("rule_count"))
    clean_tenant, clean_version = tenant.strip() or "default", version.strip() or published_at
    package = F.concat(F.lit("rules-"), F.substring(F.sha1(F.lit(f"{clean_tenant}|{clean_version}|{published_at}").cast("binary")), 1, 12))
    return packed.select(
        package.alias("package_id"), F.lit(clean_tenant).alias("tenant"), F.lit(clean_version).alias("version"), F.lit("active").alias("status"), F.lit(published_at).alias("published_at"),
        F.col("seq").cast("bigint").alias("seq"), "rules_json", "rule_count", F.lit(note).alias("note"),
    )


def publish_rules(packages: DataFrame, path: str) -> None:
    """Adds packages; one that is published again, with its id, takes the place of its first form."""
    packages.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant", "package_id").parquet(path)


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# --- files ----------------------------------------------------------------------------------

def new_files(files: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """Status of arriving files by content: duplicate, imported, candidate or unsupported.

    ``files``: relative_path, type, size_bytes, sha256, and optionally seller_name for readable history.
    """
    sellers = F.col("seller_name") if "seller_name" in files.columns else F.lit("")
    first = files.groupBy("sha256").agg(F.min("relative_path").alias("_first"))
    j = files.join(first, "sha256")
    if manifest is None:
        j = j.withColumn("_known", F.lit(False))
    else:
        j = j.join(manifest.select("sha256").distinct().withColumn("_known", F.lit(True)), "sha256", "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    sheet = F.col("type") == "excel_history_or_candidate"
    status = (
        F.when(F.col("_known") | (F.col("relative_path") != F.col("_first")), "duplicate")
        .when(sheet & ~T.is_blank(sellers), "imported")
        .when(sheet, "failed")
        .when(F.col("type") == "image_material", "candidate_only")
        .otherwise("unsupported")
    )
    return j.select("relative_path", "type", "size_bytes", "sha256", status.alias("status"))


def file_intake(spark: SparkSession, inbox: str, manifest: str, checkpoint: str) -> StreamingQuery:
    """Watches a folder and logs each new file with its status; content seen before is a duplicate."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(inbox)

    def write(batch: DataFrame, number: int) -> None:
        _put(new_files(src.file_inventory(batch, inbox), _stored(batch.sparkSession, manifest, number)), manifest, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
