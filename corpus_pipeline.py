"""From raw documents to encoded training text, in five stages; each works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkledger.llm import bpe, line_dedup, mixing, ngram_join, quality_fm
from sparkledger.llm.queries import MIX_LEVELS, MIX_SEED, mix_weights, vocabulary_path, with_domain, word_count
from sparkledger.llm.shared import kept_table

#: Share of the tokens that the mix gives out, at most once each.
MIX_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine takes for good ones; it learns on the labels of these documents.

    Each row is judged by its own text, a null one as empty; equal rows go or stay together. Without usable labels all rows score the
    same 0.5 and stay. An empty table stays empty.
    """
    machine = quality_fm.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_fm.filter_documents(docs, machine)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share; a document without any line left goes. ``n_chars`` follows the text.

    Rows that lose no line stay as they are, null and empty texts among them. Rows that repeat an id count as one document: each of them keeps the
    lines that its id keeps. An empty table stays empty.
    """
    made = line_dedup.dedup_lines(docs)
    left = made.filter((F.col("n_dropped") == 0) | (F.length(F.btrim("kept")) > 0))
    changed = F.col("n_dropped") > 0
    replaced = {"text": F.when(changed, F.col("kept")).otherwise(F.col("text")), "n_chars": F.when(changed, F.length("kept").cast("bigint")).otherwise(F.col("n_chars"))}
    return left.select(*[replaced.get(c, F.col(c)).alias(c) for c in docs.columns])


def row_key(docs: DataFrame) -> Column:
    """What tells rows apart: id and text. Rows without an id come behind all others."""
    no_id = F.col("doc_id").isNull()
    return F.struct(no_id.alias("no_id"), F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType)).alias("id"), F.xxhash64("text").alias("text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words, 0.8): the one with the least id, of equal ids the one with the least text hash.

    Rows are told apart by id and text, so a text stays though another text under its id goes. Of rows with equal id and text one stays, the first
    by its other columns. Rows without an id count behind all ids. Null, empty and blank texts resemble nothing. An empty table stays empty.
    """
    keyed = docs.withColumn("_key", row_key(docs))
    found = kept_table(ngram_join.near_duplicates(keyed, id_col="_key"), "near")
    gone = found.filter(F.col("component_id") != F.col("_key")).select("_key")
    again = found.groupBy("_key").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1").select("_key")
    left = keyed.join(gone, "_key", "left_anti")
    # Few rows are repeated, and only they are put in order.
    repeated = left.join(again, "_key", "left_semi")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    first = repeated.withColumn("_n", F.row_number().over(W.partitionBy("_key").orderBy(*others) if others else W.partitionBy("_key").orderBy("_key"))).filter("_n = 1")
    return left.join(again, "_key", "left_anti").select(*docs.columns).unionByName(first.select(*docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, whole and once each: a leaf's last one is kept when the prefix reaches it.

    Rows are told apart by id and text; rows equal in both are taken together if one is. Rows without a word are not taken. An empty table stays
    empty.
    """
    taken = mixing.mix_sources(with_domain(docs), MIX_LEVELS, word_count(), mix_weights(spark), percent=MIX_PERCENT, most_epochs=1, seed=MIX_SEED)
    ids = kept_table(taken.select(F.col("doc_id").alias("_taken"), "_row").distinct(), "mix")
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_taken"]) & (F.xxhash64(docs["text"]) == ids["_row"]), "left_semi").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, with their count and checksums; a row for each row, null texts as empty ones."""
    return bpe.encode_documents(docs, vocabulary_path())


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram join", near_duplicates), ("mixing", mix), ("bpe", encode)]

#: A trained classifier has no SQL form; ``tests/llm`` holds the rows of every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = kept_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
