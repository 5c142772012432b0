import collections
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkledger.llm import bpe, fingerprints, host_rules, line_dedup, ngram_join, pii, secrets, words
from sparkledger.llm.queries import vocabulary_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sample_texts(n, letters, size, seed=1):
    rng = random.Random(seed)
    return [None, ""] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, size))) for _ in range(n)]


def test_words_and_counts():
    texts = sample_texts(800, "aAbé# \n", 80) + ["q" * 300000 + " b c", "\x1c x y"]
    for (_, grams), text in zip(words.shingle_sets(pa.array(texts), 4), texts, strict=True):
        ws = WORD.findall((text or "").translate(FOLD))
        assert len(grams) == len({tuple(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))} if ws else ())
    for text, *got in zip(texts, *host_rules.text_counts(pa.array(texts)), strict=True):
        ws = WORD.findall(text or "")
        seen = collections.Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
        again = {i + j for i in range(len(ws) - 2) if seen[tuple(ws[i : i + 3])] > 1 for j in range(3)}
        lines = [line for line in (text or "").split("\n") if WORD.search(line)]
        assert got == [len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)]


def test_long_text_is_hashed_whole(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(4000))
    whole = [g.tolist() for _, g in words.shingle_sets(pa.array([text, "a b"]), 3)]
    monkeypatch.setattr(words, "BLOCK", 1000)
    assert [g.tolist() for _, g in words.shingle_sets(pa.array([text, "a b"]), 3)] == whole


def brute_components(rows, size, percent):
    sets = {}
    for i, text in rows:
        ws = WORD.findall((text or "").translate(FOLD))
        sets[i] = {tuple(ws[j : j + size]) for j in range(max(1, len(ws) - size + 1))} if ws else set()
    least = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and least[a] != least[b]:
                    least[a] = least[b] = min(least[a], least[b])
                    changed = True
    return {i: (len(s), least[i]) for i, s in sets.items()}


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_join_equals_brute_force(spark, size, percent):
    rng = random.Random(8)
    rows, at = [], 0
    for _ in range(12):  # chains of edits, so that groups are linked through their members
        ws = [f"w{rng.randrange(60)}" for _ in range(rng.choice([2, 5, 40, 120]))]
        for _ in range(rng.randint(1, 9)):
            rows.append((at, " ".join(ws)))
            at += 1
            for _ in range(max(1, len(ws) // 100)):
                ws[rng.randrange(len(ws))] = f"n{rng.randrange(10**6)}"
    rows += [(at, None), (at + 1, " ")]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), size=size, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, size, percent)


def test_join_when_leaders_leave_many_apart(spark, monkeypatch):
    """Leaders that meet nobody: the pairs that are apart are all met."""
    monkeypatch.setattr(ngram_join, "star_pairs", lambda rows, percent: rows.select(F.col("c").alias("a"), F.col("c").alias("b")).filter("a <> b"))
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    rows = []
    for i in range(30):
        ws = list(base)
        for _ in range(3):
            ws[rng.randrange(100)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(ws)))
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), size=4, percent=70).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 4, 70)


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_pii(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            luhn = sum(sum(divmod(d * 2, 10)) if i % 2 else d for i, d in enumerate(digits[::-1])) % 10 == 0
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base_spans():
    for text in sample_texts(4000, "a0.@-+ 1(9é%_", 60)[1:] + ["1" * 3000 + ".1.2.3", "4111 1111 1111 1111"]:
        assert [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b, _ in pii.find_spans(text) if k < pii.BASE] == plain_pii(text)


def test_pii_adds_confirmed_spans():
    good = "my bank account: DE89 3704 0044 0532 0130 00, thanks"
    assert [pii.KINDS[k] for k, *_ in pii.find_spans(good)] == ["iban"]
    assert not [k for k, *_ in pii.find_spans(good.replace("0130 00", "0130 01")) if pii.KINDS[k] == "iban"]
    assert [pii.KINDS[k] for k, *_ in pii.find_spans("ssn 123-45-6789")] == ["national"]
    assert pii.find_spans("number 123-45-6789 of the list") == []


def test_pii_accounts_before_other_tokens():
    accounts = ["ES9121000418450200051332", "AT611904300234573201", "CZ6508000000192000145399", "SE45 5000 0000 0583 9825 7466", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    for account in accounts:
        for after in ("", " EUR 50", " EUR", " BANK AB", " 2024", " 2024 BANK", " EURO99", " NR12 ABCD 1234", ", EUR", "\n2024"):
            for before in ("account ", "account AB12 ", "NR12 ABCD 1234 "):
                text = before + account + after
                assert [text[a:b] for a, b in pii.ibans(text)] == [account], text
    for text in (" ".join(accounts), " EUR ".join(accounts)):
        assert [text[a:b] for a, b in pii.ibans(text)] == accounts
    assert not list(pii.ibans("account ES9121000418450200051333 EUR"))
    assert len(list(pii.ibans("ES91 2100 0418 4502 0005 1333 " * 20000))) == 0


def test_pii_rows(odd_docs, no_docs):
    assert pii.find_pii(odd_docs).count() == odd_docs.count()
    assert pii.find_pii(no_docs).count() == 0


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def plain_secrets(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_secrets(spark, odd_docs, no_docs):
    rng = random.Random(2)
    bits = ["token=", "Password: '", "api_key\" = ", "secret:", "AKIA", "A1B2C3D4E5F6G7H8I9", "0123456789abcdef", "é ", "short", "abcdef.123456", " ", "\n"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 12))), f"o{i % 4}") for i in range(400)] + [(400, None, None), (401, "", "o1")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = secrets.scan_secrets(docs)
    base = got.select("doc_id", secrets.span_list(F.filter("spans", lambda s: s["kind"] < 3)).alias("s")).collect()
    assert {r.doc_id: r.s for r in base} == {i: plain_secrets(t or "") for i, t, _ in rows}
    assert secrets.scan_secrets(odd_docs).count() == odd_docs.count()
    assert secrets.scan_secrets(no_docs).count() == 0


def test_secrets_shortest_service_tokens(spark):
    heads = ["ghp_", "gho_", "ghs_", "glpat-", "xoxb-", "xoxp-", "sk-", "rk_", "pk_"]
    rows = [(10 * i + size - 23, f"see {head}{'Qz7' * 8}"[: 4 + size], f"s{i}") for i, head in enumerate(heads) for size in (23, 24, 25)]
    got = {r.doc_id: len(r.spans) for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert got == {i: int(i % 10 > 0) for i, *_ in rows}


def test_secrets_ownership(spark):
    shared, own = "ghp_" + "a1B2" * 8, "ghp_" + "z9Y8" * 8
    rows = [(i, f"use {shared}", f"o{i}", f"r{i}") for i in range(3)] + [(9, f"use {own} and token={shared}", "o9", "r9")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, repo string")
    got = {r.doc_id: [(secrets.KINDS[s.kind], s.live, s.owners, s.repositories) for s in r.spans] for r in secrets.scan_secrets(docs, repository=F.col("repo")).collect()}
    assert got[0] == []
    assert ("service", True, 1, 1) in got[9] and ("assign", False, 4, 4) in got[9]


def plain_lines(rows):
    keys = collections.defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                keys[key(line)].add(i)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(keys[key(x)]) < 5 or max(keys[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_line_dedup(spark, odd_docs, no_docs):
    rng = random.Random(5)
    stock = ["Ä" * 45, "a line of forty code points and a few more", "A Line of forty code points and a few more  ", "short", "", "another line that is long enough to be counted"]
    rows = [(i, "\n".join(rng.choice(stock) for _ in range(rng.randint(0, 6)))) for i in range(40)] + [(40, None)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in got} == plain_lines(rows)
    out = line_dedup.dedup_lines(odd_docs)
    assert out.count() == odd_docs.count() and out.filter("n_dropped > 0").count() == 11
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_bpe_equals_library(odd_docs, no_docs):
    tokenizers = pytest.importorskip("tokenizers")
    theirs, ours = tokenizers.Tokenizer.from_file(vocabulary_path()), bpe.Encoder(vocabulary_path())
    pool = "abcXYZ's 'S12é́İΣσß　中😀ﬁ²Ⅷ‍\x1c\x85\n!?<|>"
    for text in [t or "" for t in sample_texts(1500, pool, 40)] + ["it's <|endoftext|>x<|startoftext|>", "ab" * 20000]:
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert ours.encode(text) == ids
        assert ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False)
    out = bpe.encode_documents(odd_docs, vocabulary_path())
    assert out.count() == odd_docs.count()
    assert out.filter("n_tokens <> size(ids)").count() == 0
    assert bpe.decode_tokens(out, vocabulary_path()).filter(F.sha2("decoded", 256) != F.col("decoded_sha256")).count() == 0
    assert bpe.encode_documents(no_docs, vocabulary_path()).count() == 0


def test_fingerprints(spark, odd_docs, no_docs):
    rng = random.Random(6)
    rows = [(i * 7, " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.choice([0, 3, 30, 600])))) for i in range(60)] + [(1000, None), (1001, "one two three")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs, parts=7).collect()}
    order = sorted(dict(rows), reverse=True)
    texts = {i: t or "" for i, t in rows}
    for i, following in zip(order, order[1:] + order[:1], strict=True):
        n = len(texts[i])
        assert got[i].n_chars == n and got[i].edited == texts[i][: n - n // 3] + texts[following][: n // 3]
        assert got[i].next_sketch == got[following].sketch
        ws = [x.split() for x in (texts[i], got[i].edited)]
        a, b = ({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set() for w in ws)
        true = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(got[i].near_edited - true) < (0.2 if len(a | b) > fingerprints.K else 1e-9)
        assert abs(got[i].n_shingles - len(a)) <= 0.4 * len(a)
    assert fingerprints.fingerprint_documents(odd_docs).count() == odd_docs.count()
    assert fingerprints.fingerprint_documents(no_docs).count() == 0


def test_sketches_merge(spark):
    parts = spark.createDataFrame([("a", " ".join(f"w{i}" for i in range(s, s + 300))) for s in (0, 100, 250)] + [("b", "")], "k string, text string")
    sketched = parts.select("k", fingerprints.sketch(F.col("text"), 64, 1).alias("s"))
    merged = fingerprints.merge_sketches(sketched, ["k"], "s", 64, salts=3)
    whole = spark.createDataFrame([("a", " ".join(f"w{i}" for i in range(550)))], "k string, text string").select(fingerprints.sketch(F.col("text"), 64, 1).alias("s"))
    assert merged.filter("k = 'a'").first().s == whole.first().s


def test_host_rules(spark, odd_docs, no_docs):
    good, junk = " ".join(f"w{i}" for i in range(80)), " ".join(f"w{i}###" for i in range(80))
    rows = [(i, junk if i % 10 else good, "bad") for i in range(200)] + [(300 + i, good if i % 50 else junk, "fine") for i in range(200)] + [(600, "few words", "fine")]
    out = host_rules.judge_documents(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    kept = {(r.source, r.soft_failures): r.kept for r in out.filter("not base_failed").collect()}
    assert kept == {("bad", 1): False, ("bad", 0): True, ("fine", 0): True, ("fine", 1): True}
    assert not out.filter("doc_id = 600").first().kept
    assert host_rules.judge_documents(odd_docs).count() == odd_docs.count()
    assert host_rules.judge_documents(no_docs).count() == 0


def test_join_on_odd_rows(odd_docs, no_docs):
    out = ngram_join.near_duplicates(odd_docs).collect()
    by = collections.defaultdict(set)
    for r in out:
        by[r.doc_id].add((r.n_shingles > 0, r.component_id))
    assert len(out) == odd_docs.count()
    assert all(by[30 + i] == {(True, 30)} for i in range(5)) and by[20] == {(False, 20)} and by[25] == {(True, 25)}
    assert {c for _, c in by[None]} == {None}
    assert ngram_join.near_duplicates(no_docs).count() == 0


