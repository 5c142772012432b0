import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkledger.llm import lang_kernel, mixing, quality_fm
from sparkledger.llm.queries import MIX_LEVELS, mix_weights, with_domain, word_count

SF = "/root/testdata/sf0.01"


def test_sum_of_squares_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    machine = quality_fm.Machine(0.3, rng.normal(size=quality_fm.N_FEATURES), rng.normal(size=(quality_fm.N_FEATURES, quality_fm.RANK)))
    ids, values = np.array([3, 9, 700, 8200, 5]), rng.normal(size=5)
    logits, _ = machine.logits(ids, values, np.array([0, 4, 5]))
    pairs = sum(values[i] * values[j] * machine.vectors[ids[i]] @ machine.vectors[ids[j]] for i in range(4) for j in range(i))
    assert logits[0] == pytest.approx(0.3 + machine.weights[ids[:4]] @ values[:4] + pairs)
    assert logits[1] == pytest.approx(0.3 + machine.weights[5] * values[4])


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    machine = quality_fm.learn(docs, labels)
    scored = quality_fm.score_documents(docs, machine).join(labels, "doc_id").filter(quality_fm.held_out())
    right = scored.agg(F.avg((F.col("quality") == (F.col("score") >= 0.5).cast("int")).cast("double"))).first()[0]
    assert right > 0.95


def test_quality_odd_rows(odd_docs, no_docs, no_labels):
    machine = quality_fm.learn(odd_docs, no_labels)
    scored = quality_fm.score_documents(odd_docs, machine)
    assert scored.count() == odd_docs.count() and scored.filter("score between 0 and 1").count() == odd_docs.count()
    assert quality_fm.score_documents(no_docs, machine).count() == 0
    assert quality_fm.filter_documents(odd_docs, machine).count() == odd_docs.count()


def test_language_held_out(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = lang_kernel.identify(docs, lang_kernel.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter(lang_kernel.held_out())
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    odd = lang_kernel.identify(odd_docs, lang_kernel.learn(odd_docs))
    assert odd.count() == odd_docs.count()
    assert {r.lang_pred for r in odd.filter("doc_id in (20, 21, 22)").collect()} == {"und"}
    assert lang_kernel.identify(no_docs, lang_kernel.learn(no_docs)).count() == 0


def fill(budget, children):
    """Shares by weight, capped, the rest shared again until nothing changes. children: name -> (weight, limit)."""
    got, left = {}, dict(children)
    while True:
        total = sum(w for w, _ in left.values())
        full = {k: c for k, (w, c) in left.items() if w and c * total <= budget * w}
        if not full:
            return got | {k: (budget * w / total if total else 0) for k, (w, _) in left.items()}
        k = min(full, key=lambda k: full[k] / left[k][0])
        got[k] = full[k]
        budget -= full[k]
        del left[k]


def test_budgets_equal_repeated_filling(spark):
    rng = random.Random(9)
    for case in range(4):
        nodes = [(f"n{i}", rng.choice([0, 1, 1, 2, 5]), rng.randrange(1, 2000), 1000 + 500 * case) for i in range(8)]
        df = spark.createDataFrame(nodes, "name string, w bigint, cap bigint, b bigint")
        got = {r.name: r.got for r in mixing.split_budget(df, [], "name", "w", "cap", "b", "got").collect()}
        want = fill(1000 + 500 * case, {n: (w, c if w else 0) for n, w, c, _ in nodes})
        assert all(abs(got[n] - want[n]) <= 1 for n, *_ in nodes)
        assert sum(got.values()) == min(1000 + 500 * case, sum(c for _, w, c, _ in nodes if w))


def test_mix_is_exact_and_repeatable(spark, odd_docs, no_docs):
    docs = with_domain(spark.read.parquet(f"{SF}/documents.parquet"))
    args = (MIX_LEVELS, word_count(), mix_weights(spark))
    mixed = mixing.mix_sources(docs, *args, percent=80, most_epochs=3, seed=7)
    total = docs.agg(F.sum(word_count())).first()[0]
    assert mixed.agg(F.sum("taken")).first()[0] == total * 80 // 100
    again = mixing.mix_sources(docs.repartition(7), *args, percent=80, most_epochs=3, seed=7)
    assert mixed.exceptAll(again).count() == 0 and again.exceptAll(mixed).count() == 0
    # A document takes part in every epoch before its last, and at most one document of a leaf is cut.
    assert mixed.groupBy("doc_id").agg(F.max("epoch").alias("m"), F.count("*").alias("n")).filter("m <> n and m <> n + 1").count() == 0
    assert mixed.filter("taken < tokens").groupBy(*MIX_LEVELS).count().filter("count > 1").count() == 0
    assert mixing.mix_sources(with_domain(odd_docs), *args, most_epochs=1).agg(F.sum("taken")).first()[0] > 0
    assert mixing.mix_sources(with_domain(no_docs), *args).count() == 0


def test_pipeline(spark, odd_docs, tmp_path):
    docs, columns = spark.read.parquet(f"{SF}/documents.parquet"), None
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        columns = columns or docs.columns
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(docs.count())
        if name != "bpe":
            assert docs.columns == columns
    assert counts[0] > counts[1] >= counts[2] > counts[3] > counts[4] == counts[5] > 0


def test_stages_on_odd_rows(spark, odd_docs, no_docs, no_labels, tmp_path):
    no_labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, str(tmp_path)).count()
