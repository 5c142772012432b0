"""Secret scan: candidate spans by pattern, told apart by who else holds the same value.

A value that many owners hold is an example or a default; one that a single owner holds, in few repositories, looks
live. Values meet in the corpus as hashes only, with counts of distinct repositories and owners.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import kept_table, text_or_empty

# The three kinds that always count, with the least length of what is tested. Runs of one class are
# matched from their least length on: a shorter run has no part that is long enough.
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
BASE = (("assign", ASSIGN, 2, 6), ("access", r"(AKIA[A-Z0-9]{16,})", 1, 20), ("hex", r"([0-9a-f]{24,})", 1, 24))
# Kinds that count only where the corpus shows one owner: prefixed service tokens, signed web tokens, key headers.
MORE = (
    ("service", r"((?:ghp|gho|ghs|glpat|xoxb|xoxp|sk|rk|pk)[_-][A-Za-z0-9_-]+)", 1, 24),
    ("signed", r"(eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)", 1, 40),
)
KINDS = [k for k, *_ in (*BASE, *MORE)]


def matches(text: Column, pattern: str, group: int, least: int, kind: int, quick: str) -> Column:
    """Spans of all leftmost matches, their value being ``group``; those with a value under ``least`` characters go.

    The texts between the matches give the offsets: a match starts where all pieces and matches before it end.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.zip_with(
        F.zip_with(F.split(text, pattern, -1), whole, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m"))),
        values,
        lambda g, v: F.struct(g["gap"].alias("gap"), F.length(g["m"]).alias("size"), v.alias("value")),
    )
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:int,start:int,stop:int,value:string>>").alias("found"))

    def add(state: Column, s: Column) -> Column:
        start = state["at"] + s["gap"]
        stop = start + F.coalesce(s["size"], F.lit(0))
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), stop.alias("stop"), s["value"].alias("value"))
        good = F.length(s["value"]) >= least
        return F.struct(stop.alias("at"), F.when(good, F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"))

    found = F.aggregate(steps, empty, add, lambda s: s["found"])
    return F.when(text.rlike(quick), found).otherwise(F.array().cast("array<struct<kind:int,start:int,stop:int,value:string>>"))


# A plain test for each kind, true for every text with a match long enough.
QUICK = {
    "assign": r"[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6}",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
    # The longest prefix leaves 18 of the 24 characters to what follows its separator.
    "service": r"[_-][A-Za-z0-9_-]{18}",
    "signed": r"eyJ[A-Za-z0-9_-]",
}


def candidates(docs: DataFrame, id_col: str, text_col: str, owner: Column, repository: Column) -> DataFrame:
    """(row, id, owner, repository, spans): a row per document; the texts stay behind."""
    text = F.col("_text")
    found = [matches(text, pattern, group, least, i, QUICK[kind]) for i, (kind, pattern, group, least) in enumerate((*BASE, *MORE))]
    return (
        docs.withColumn("_text", text_or_empty(text_col))
        .select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), owner.alias("owner"), repository.alias("repository"), F.concat(*found).alias("found"))
        .withColumn(
            "spans",
            F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), F.sha2(s["value"], 256).alias("hash"))),
        )
        .drop("found")
    )


def ownership(found: DataFrame) -> DataFrame:
    """(hash, repositories, owners): for each candidate value, how many distinct repositories and owners hold it.

    Repeats go first, combined before the shuffle; then each (hash, repository, owner) is one row.
    """
    held = found.select("owner", "repository", F.explode("spans").alias("s")).select(F.col("s.hash").alias("hash"), "owner", "repository").distinct()
    owners = held.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return owners.groupBy("hash").agg(F.sum("n").alias("repositories"), F.count("owner").alias("owners"))


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner: Column | None = None,
    repository: Column | None = None,
    most_owners: int = 1,
    most_repositories: int = 3,
) -> DataFrame:
    """(id, spans) per document; a span is (kind, start, stop, hash, repositories, owners, live), by start, then kind.

    Spans of the base kinds are all listed; ``live`` tells whether at most ``most_owners`` owners and
    ``most_repositories`` repositories hold the value. Spans of the further kinds are listed only where live. A null owner or
    repository is one of its own. Null and empty texts, and texts without candidates, give an empty list; rows that
    repeat an id give a row each; an empty table gives an empty one. Other columns are not read, whatever their names.
    """
    owner = F.coalesce((F.col("source") if owner is None else owner).cast("string"), F.lit(""))
    repository = F.coalesce((F.col("source") if repository is None else repository).cast("string"), F.lit(""))
    found = kept_table(candidates(docs, id_col, text_col, owner, repository), "secrets")
    known = ownership(found)
    each = found.filter(F.size("spans") > 0).select("row", F.explode("spans").alias("s")).select("row", "s.*")
    live = (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)
    judged = each.join(known, "hash").withColumn("live", live).filter(F.col("live") | (F.col("kind") < len(BASE)))
    listed = judged.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "stop", "hash", "repositories", "owners", "live"))).alias("spans")
    )
    some = found.filter(F.size("spans") > 0).select("row", "id").join(listed, "row", "left")
    none = found.filter(F.size("spans") == 0).select("row", "id", F.lit(None).cast(listed.schema["spans"].dataType).alias("spans"))
    spans = F.coalesce("spans", F.array().cast(listed.schema["spans"].dataType))
    return some.unionByName(none).select(F.col("id").alias(id_col), spans.alias("spans"))


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order of the list."""
    word = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(word, s["kind"]), s["start"], s["stop"])), ",")
