"""The language kernel against its plain formula, and fingerprints over ids of any type."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkledger.llm import fingerprints, lang_kernel

SF = "/root/testdata/sf0.001"


def slots(text):
    found = set()
    text = text.lower()
    for i in range(len(text)):
        h = 0
        for n, ch in enumerate(text[i : i + 3], 1):
            h = (h * 0x9E3779B97F4A7C15 + ord(ch) + n) % 2**64
            found.add((((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) % 2**64) >> 51)
    return found


def alike(a, b):
    return len(a & b) / math.sqrt(len(a) * len(b)) if a and b else 0.0


def plain_model(sample):
    """(languages, landmark sets, weights of the kernel values, constants), by the formulas of Nyström and of weighted ridge regression."""
    langs = sorted({lang for lang, _ in sample})
    sets = [slots(text) for _, text in sample]
    marks = [sets[i] for i in sorted(set(np.linspace(0, len(sample) - 1, min(lang_kernel.LANDMARKS, len(sample))).astype(int)))]
    k = np.array([[alike(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(k)
    keep = values > 1e-6 * values.max()
    root = (vectors[:, keep] / np.sqrt(values[keep])) @ vectors[:, keep].T
    z = np.array([[alike(a, b) for b in marks] for a in sets]) @ root
    z = np.hstack([z, np.ones((len(z), 1))])
    w = np.diag([len(sample) / len(langs) / sum(x == lang for x, _ in sample) for lang, _ in sample])
    y = np.array([[1.0 if lang == name else -1.0 for name in langs] for lang, _ in sample])
    d = np.diag([lang_kernel.RIDGE * len(sample)] * (z.shape[1] - 1) + [0.0])
    beta = np.linalg.solve(z.T @ w @ z + d, z.T @ w @ y)
    return langs, marks, root @ beta[:-1], beta[-1]


def test_scores_equal_the_formula(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    usable = docs.filter(~lang_kernel.held_out() & F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text", F.xxhash64(F.lit(5), "doc_id").alias("key")).collect()
    sample = []
    for lang in {r.lang for r in usable}:
        sample += sorted((r.key, r.lang, r.text) for r in usable if r.lang == lang)[:20]
    sample = [(lang, text) for _, lang, text in sorted(sample)]
    langs, marks, weights, constants = plain_model(sample)
    got = {r.doc_id: r for r in lang_kernel.identify(docs, lang_kernel.learn(docs, sample=20)).collect()}
    for row in docs.collect():
        if not any(ch.isalpha() for ch in row.text or ""):
            assert got[row.doc_id].lang_pred == "und"
            continue
        have = slots(row.text)
        values = np.array([alike(have, m) for m in marks]) @ weights + constants
        shares = np.exp(4 * values) / np.exp(4 * values).sum()
        best = int(values.argmax())
        # The operator computes in 32 bits.
        assert abs(got[row.doc_id].score - shares[best]) < 0.02
        assert got[row.doc_id].lang_pred == langs[best] or np.sort(values)[-1] - np.sort(values)[-2] < 0.01


def test_sample_takes_ties_and_repeated_ids(spark):
    rows = [(1, "aa bb"), (1, "cc dd"), (1, "cc dd"), (2, None), (3, ""), (4, "ee ff")]
    docs = spark.createDataFrame([(i, t, "en" if i < 4 else "de") for i, t in rows], "doc_id bigint, text string, lang string")
    model = lang_kernel.learn(docs, sample=2)
    assert model is None or set(model.langs) <= {"en", "de"}
    assert lang_kernel.identify(docs, model).count() == 6


@pytest.mark.parametrize("kind", ["string", "decimal(12,2)", "date"])
def test_fingerprints_over_any_ids(spark, kind):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(0, 60)))) for i in range(70)]
    docs = spark.createDataFrame(rows, "n int, text string")
    named = {"string": F.concat(F.lit("id"), "n"), "decimal(12,2)": (F.col("n") / 4).cast(kind), "date": F.date_add(F.lit("2024-01-01").cast("date"), "n")}[kind]
    docs = docs.select(named.alias("doc_id"), "text").repartition(4)
    texts = {r.doc_id: r.text for r in docs.collect()}
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs, parts=6).collect()}
    for own, following in zip(order, order[1:] + order[:1], strict=True):
        n = len(texts[own])
        assert got[own].edited == texts[own][: n - n // 3] + texts[following][: n // 3]
    assert len(got) == len(texts)


def test_ranges_follow_the_size_of_the_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * 200) for i in range(100)] + [(None, "last " * 40), (None, None)], "doc_id bigint, text string")
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 5000)
    assert len(fingerprints.cuts_of(docs, "doc_id", 20)) >= 15
    made = {(r.doc_id, r.edited) for r in fingerprints.fingerprint_documents(docs).collect()}
    # Null ids come last: the smallest id is followed by the null row with the larger text hash, the last row by the largest id.
    nulls = docs.filter("doc_id is null").select(F.coalesce("text", F.lit("")).alias("t")).orderBy(F.desc(F.xxhash64("t"))).collect()
    own = "word " * 200
    after = [nulls[0].t, nulls[1].t, own]
    cut = lambda text, following: text[: len(text) - len(text) // 3] + following[: len(text) // 3]
    want = {(i, cut(own, own)) for i in range(1, 100)} | {(0, cut(own, after[0])), (None, cut(after[0], after[1])), (None, cut(after[1], after[2]))}
    assert made == want
