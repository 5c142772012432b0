"""The operators of this package as registered queries over the test tables, with the statements that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprints, host_rules, importance, lang_kernel, line_dedup, minhash, mixing, ngram_join, pii, quality_fm, secrets, spelling
from .shared import WORD

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = "word_bpe_49k.json"
MIX_LEVELS = ["domain", "lang", "source"]
MIX_DOMAINS = {"web": 5, "books": 3, "news": 2}
MIX_LANGS = {"en": 6, "de": 2, "fr": 2, "es": 1}
MIX_SEED = 7


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def with_domain(docs: DataFrame) -> DataFrame:
    """Sources fall into three domains by their number."""
    number = F.coalesce(F.regexp_extract("source", r"([0-9]{1,6})$", 1).try_cast("int"), F.lit(0)) % 3
    return docs.withColumn("domain", F.when(number == 0, "web").when(number == 1, "books").otherwise("news"))


def mix_weights(spark: SparkSession) -> list[DataFrame]:
    domains = spark.createDataFrame(list(MIX_DOMAINS.items()), "domain string, weight bigint")
    langs = spark.createDataFrame([(d, lang, w) for d in MIX_DOMAINS for lang, w in MIX_LANGS.items()], "domain string, lang string, weight bigint")
    sources = spark.createDataFrame([], "domain string, lang string, source string, weight bigint")
    return [domains, langs, sources]


def word_count():
    return F.regexp_count("text", F.lit(WORD))


def _weight_sql(values: dict, column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " ELSE 1 END"


def _level_sql(i: int) -> str:
    """Statement parts that give each node of a level its share of its parent's budget."""
    keys = ", ".join(MIX_LEVELS[: i + 1])
    part = f"PARTITION BY {', '.join(MIX_LEVELS[:i])} " if i else ""
    order = f"{part}ORDER BY ratio NULLS FIRST, {MIX_LEVELS[i]} ROWS BETWEEN UNBOUNDED PRECEDING AND"
    return f"""a{i} AS (SELECT {keys}, max(w{i + 1}) AS w, sum(available * 3) AS cap, max(b{i}) AS b FROM g{i} GROUP BY {keys}),
r{i} AS (SELECT *, CASE WHEN w > 0 THEN cap ELSE 0 END AS c, CASE WHEN w > 0 THEN CAST(cap AS double) / w END AS ratio FROM a{i}),
s{i} AS (SELECT *, b - coalesce(sum(c) OVER ({order} 1 PRECEDING), 0) AS remains, sum(w) OVER ({part}) - coalesce(sum(w) OVER ({order} 1 PRECEDING), 0) AS ws FROM r{i}),
f{i} AS (SELECT *, coalesce(min(CASE WHEN w > 0 THEN CAST(CAST(c AS hugeint) * ws <= CAST(remains AS hugeint) * w AS int) END) OVER ({order} CURRENT ROW), 1) = 1 AS whole FROM s{i}),
t{i} AS (SELECT *, b - coalesce(sum(CASE WHEN whole THEN c END) OVER ({part}), 0) AS rest, CASE WHEN whole THEN 0 ELSE w END AS free FROM f{i}),
u{i} AS (SELECT *, sum(free) OVER ({order} CURRENT ROW) AS upto, sum(free) OVER ({part}) AS frees FROM t{i}),
g{i + 1} AS (SELECT g.*, CASE WHEN whole THEN c ELSE CAST(rest * upto // frees - rest * (upto - free) // frees AS bigint) END AS b{i + 1}
  FROM g{i} g JOIN u{i} USING ({keys}))"""


MIX_SQL = rf"""
WITH d AS (SELECT doc_id, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens,
  CASE coalesce(TRY_CAST(regexp_extract(source, '([0-9]{{1,6}})$', 1) AS int), 0) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'books' ELSE 'news' END AS domain FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens) AS available FROM d WHERE tokens > 0 GROUP BY ALL),
g0 AS (SELECT *, {_weight_sql(MIX_DOMAINS, 'domain')} AS w1, {_weight_sql(MIX_LANGS, 'lang')} AS w2, 1 AS w3, (SELECT sum(available) * 80 // 100 FROM leaves) AS b0 FROM leaves),
{_level_sql(0)},
{_level_sql(1)},
{_level_sql(2)},
q AS (SELECT domain, lang, source, b3 // available AS times, b3 % available AS part FROM g3),
asked AS (SELECT d.*, times, part FROM d JOIN q USING (domain, lang, source) WHERE tokens > 0),
full_epochs AS (SELECT domain, lang, source, doc_id, unnest(range(1, CAST(times AS bigint) + 1)) AS epoch, tokens, tokens AS taken FROM asked),
last_epoch AS (SELECT *, part - coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat('{MIX_SEED}:', CAST(times + 1 AS bigint), ':', doc_id)) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM asked)
SELECT * FROM full_epochs UNION ALL SELECT domain, lang, source, doc_id, CAST(times + 1 AS bigint), tokens, CAST(least(tokens, room) AS bigint) FROM last_epoch WHERE room > 0
"""


@query("op1_mix_sources", MIX_SQL)
def op1(spark, sf_dir):
    docs = with_domain(documents(spark, sf_dir))
    return mixing.mix_sources(docs, MIX_LEVELS, word_count(), mix_weights(spark), percent=80, most_epochs=3, seed=MIX_SEED).drop("_row")


@query("op2_ngram_join")
def op2(spark, sf_dir):
    return ngram_join.near_duplicates(documents(spark, sf_dir), size=4, percent=85)


@query("op3_pii")
def op3(spark, sf_dir):
    return pii.find_pii(documents(spark, sf_dir)).drop("pii")


@query("op4_quality")
def op4(spark, sf_dir):
    docs = documents(spark, sf_dir)
    machine = quality_fm.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_fm.score_documents(docs, machine)
    return scored.select("doc_id", quality_fm.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op5_secrets")
def op5(spark, sf_dir):
    found = secrets.scan_secrets(documents(spark, sf_dir), repository=F.concat_ws("/", "source", "lang"))
    base = F.filter("spans", lambda s: s["kind"] < len(secrets.BASE))
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{secrets.KINDS[i]}") for i in range(len(secrets.BASE))],
        F.sha2(secrets.span_list(base), 256).alias("base_sha256"),
        secrets.span_list(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("bigint").alias("n_live"),
    )


LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.doc_id, l.pos, l.line, c.k IS NOT NULL AND c.keeper <> l.doc_id AS gone FROM keyed l LEFT JOIN common c ON l.k = c.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op6_line_dedup", LINES_SQL)
def op6(spark, sf_dir):
    out = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_language")
def op7(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = lang_kernel.identify(docs, lang_kernel.learn(docs))
    return found.select("doc_id", lang_kernel.held_out().alias("held_out"), "lang_pred", "score")


RULES_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS (SELECT doc_id, i, concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3) x),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) x WHERE c > 1),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) x GROUP BY doc_id),
dups AS (SELECT doc_id, sum(c - 1) AS n FROM (SELECT doc_id, line, count(*) AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) l
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line) x GROUP BY doc_id),
counts AS (SELECT d.doc_id, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  coalesce(dups.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words FROM d LEFT JOIN dups ON dups.doc_id = d.doc_id LEFT JOIN repeated ON repeated.doc_id = d.doc_id),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CAST(n_symbols > 0.3 * greatest(n_words, 1) AS int) + CAST(n_dup_lines > 0.05 * greatest(n_words, 1) AS int)
  + CAST(NOT (word_chars / greatest(n_words, 1) BETWEEN 2.5 AND 14.0) AS int) AS soft FROM counts),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed OR soft > 0) AS bad FROM judged GROUP BY source),
sums AS (SELECT count(*) AS k, sum(n) AS total, sum(bad) / sum(n) AS mean, sum(n * (bad / n) * (bad / n)) AS squares, sum(n * n) AS nn FROM hosts),
fitted AS (SELECT mean, total - nn / total AS effective, (squares - total * mean * mean - (k - 1) * mean * (1 - mean)) / nullif(total - nn / total, 0) AS spread FROM sums),
prior AS (SELECT mean, CASE WHEN effective > 0 AND spread > 0 THEN greatest(mean * (1 - mean) / spread - 1, 1.0) ELSE 1e12 END AS weight FROM fitted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND soft <= CASE WHEN (bad + mean * weight) / (n + weight) > 0.5 THEN 0 ELSE 1 END AS kept
FROM judged JOIN hosts ON hosts.source = judged.source, prior
"""


@query("op8_host_rules", RULES_SQL)
def op8(spark, sf_dir):
    judged = host_rules.judge_documents(documents(spark, sf_dir))
    return judged.select("doc_id", *host_rules.COUNTS, "base_failed", "kept")


@query("op9_bpe")
def op9(spark, sf_dir):
    return bpe.encode_documents(documents(spark, sf_dir), vocabulary_path(), tokens=False)


@query("op10_fingerprints")
def op10(spark, sf_dir):
    made = fingerprints.fingerprint_documents(documents(spark, sf_dir))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("sketch")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "n_shingles",
    )


@query("op11_minhash")
def op11(spark, sf_dir):
    return minhash.deduplicate(documents(spark, sf_dir), size=4, percent=80)


@query("op12_importance")
def op12(spark, sf_dir):
    return importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), percent=5, least_words=20, seed=42)


@query("op13_spelling")
def op13(spark, sf_dir):
    return spelling.group_variants(documents(spark, sf_dir), modulus=199)
