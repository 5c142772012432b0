"""Every stage of the pipeline, row by row against a plain version of it, on the test documents and on odd rows."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkledger.llm import quality_fm
from sparkledger.llm.queries import MIX_SQL, vocabulary_path

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def ascii_lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def rows_of(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def plain_lines(rows):
    key = lambda line: ascii_lower(line.strip(SPACE))
    held = defaultdict(set)
    for doc, text, *_ in rows:
        if doc is not None:
            for line in (text or "").split("\n"):
                held[key(line)].add(doc)
    gone = {k: max(ids) for k, ids in held.items() if len(k) >= 40 and len(ids) >= 5}
    out = Counter()
    for doc, text, lang, source, n in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if doc is None or gone.get(key(line), doc) == doc]
        if len(kept) == len(lines):
            out[(doc, text, lang, source, n)] += 1
        elif "\n".join(kept).strip(" "):
            out[(doc, "\n".join(kept), lang, source, len("\n".join(kept)))] += 1
    return out


def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def survivors(rows, hashes):
    """Keys (id, text) that stay: the least of each group, from all pairs."""
    order = lambda r: (r[0] is None, r[0] or 0, hashes[r[1]])
    keys = sorted({(r[0], r[1]) for r in rows}, key=order)
    sets = [shingles(text) for _, text in keys]
    group = list(range(len(keys)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                group[b] = a
    return {keys[i] for i in range(len(keys)) if top(i) == i}


def check_near(spark, docs, out):
    hashes = dict(docs.select("text", F.xxhash64("text")).distinct().collect())
    rows = [tuple(r[c] for c in COLUMNS) for r in docs.collect()]
    kept = survivors(rows, hashes)
    got = rows_of(out)
    assert set(got) <= set(rows) and all(n == 1 for n in got.values())
    assert Counter((r[0], r[1]) for r in got) == Counter(kept)


def check_mix(docs, out, tmp_path):
    path = str(tmp_path / "mix_input")
    docs.write.mode("overwrite").parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    taken = {r[0] for r in con.execute(f"SELECT DISTINCT doc_id FROM ({MIX_SQL.replace('available * 3', 'available * 1')}) m").fetchall()}
    assert rows_of(out) == rows_of(docs.filter(F.col("doc_id").isin(sorted(taken))))


def test_stages_against_plain_versions(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def step(name, source):
        stages[name](spark, source, SF).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    good = step("quality classifier", docs)
    machine = quality_fm.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scored = {r.doc_id for r in quality_fm.score_documents(docs, machine).filter("score >= 0.5").collect()}
    assert rows_of(good) == rows_of(docs.filter(F.col("doc_id").isin(sorted(scored))))
    lined = step("line dedup", good)
    assert rows_of(lined) == plain_lines([tuple(r[c] for c in COLUMNS) for r in good.collect()])
    unique = step("n-gram join", lined)
    check_near(spark, lined, unique)
    mixed = step("mixing", unique)
    check_mix(unique, mixed, tmp_path)
    made = step("bpe", mixed).collect()
    tokenizer = Tokenizer.from_file(vocabulary_path())
    tokenizer.no_padding()
    tokenizer.no_truncation()
    want = {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in mixed.collect()}
    assert {r.doc_id: r.n_tokens for r in made} == want and len(made) == len(want)


def test_rows_that_repeat_an_id(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    base, clean = text(120), text(90)
    rows = [(1, base, "en", "s", 1), (2, base + " tail", "en", "s", 2), (2, clean, "en", "s", 3), (3, clean, "en", "s", 4), (3, clean, "en", "s", 4), (3, clean, "de", "s", 5)]
    rows += [(4, "alone", "en", "s", 6), (4, "alone", "en", "s", 6), (None, base, "en", "s", 7), (None, text(50), None, None, None), (5, None, "en", "s", 0), (5, None, "en", "s", 0), (6, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    out = corpus_pipeline.near_duplicates(spark, docs, SF)
    check_near(spark, docs, out)
    got = rows_of(out)
    assert (2, clean, "en", "s", 3) in got and (2, base + " tail", "en", "s", 2) not in got and (1, base, "en", "s", 1) in got
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("name", ["line dedup", "n-gram join"])
def test_stages_on_odd_rows_against_plain_versions(spark, odd_docs, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, odd_docs, SF)
    assert out.columns == odd_docs.columns
    if name == "line dedup":
        assert rows_of(out) == plain_lines([tuple(r[c] for c in COLUMNS) for r in odd_docs.collect()])
    else:
        check_near(spark, odd_docs, out)
