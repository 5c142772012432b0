"""Minhash near-dedup, importance resampling and spelling variants against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkledger.llm import importance, minhash, spelling
from sparkledger.llm.shared import numbered



def words_of(rng, n, stock=400):
    return " ".join(f"w{rng.randrange(stock)}" for _ in range(n))


def shingles(text, size):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set()


def plain_components(rows, size, percent):
    """(n, least reachable id) by position, from all pairs."""
    sets = [shingles(text, size) for _, text in rows]
    label = {i: i for i in range(len(rows))}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                label[top(i)] = top(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[top(i)] = min(least.get(top(i), key), key)
    return [(len(sets[i]), least.get(top(i)) if rows[i][0] is not None else None) for i in range(len(rows))]


def near_rows():
    rng = random.Random(11)
    rows = [(i, words_of(rng, rng.randrange(3, 120))) for i in range(60)]
    for group in range(6):
        base = words_of(rng, 150, 10**5).split()
        for copy in range(12):
            edited = list(base)
            for _ in range(copy):
                edited[rng.randrange(len(edited))] = f"new{rng.randrange(10**6)}"
            rows.append((100 + 20 * group + copy, " ".join(edited)))
    chain = words_of(rng, 200, 10**5).split()
    for step in range(10):  # each is near the next one, the ends are far apart
        rows.append((400 - step, " ".join(chain[8 * step : 8 * step + 120])))
    common = words_of(rng, 60, 10**5)
    rows += [(500 + i, f"{words_of(rng, 80, 10**5)} {common}") for i in range(30)]
    return rows


@pytest.mark.parametrize("size, percent", [(4, 80), (5, 80)])
def test_minhash_components_against_all_pairs(spark, size, percent):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    out = {r.doc_id: r for r in minhash.deduplicate(docs, size=size, percent=percent).collect()}
    for (key, _), (n, component) in zip(rows, plain_components(rows, size, percent), strict=True):
        assert (out[key].n_shingles, out[key].component_id, out[key].kept) == (n, component, component == key)


def test_minhash_on_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = [(key, n, component, component is not None and key == component) for (key, _), (n, component) in zip(rows, plain_components(rows, 5, 80), strict=True)]
    got = minhash.deduplicate(odd_docs)
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert minhash.deduplicate(no_docs).collect() == []
    texts = odd_docs.withColumn("doc_id", odd_docs["doc_id"].cast("string"))
    assert minhash.deduplicate(texts).count() == len(rows)


def test_tensored_keys_are_pairs_of_small_collections(spark):
    shared = spark.createDataFrame([(1, 9, [1, 2], [3, 4], 4), (2, 9, [1, 5], [3, 6], 4)], "c bigint, n bigint, firsts array<bigint>, seconds array<bigint>, reach bigint")
    rows = minhash.in_tables(shared).collect()
    assert len({r.key for r in rows}) == 1 and {r.c for r in rows} == {1, 2}  # of four keys each, one is shared


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_buckets(text):
    ws = plain_words(text)
    return [zlib.crc32(" ".join(ws[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(ws) - n + 1)]


def plain_resample(rows, target):
    raw, wanted = Counter(), Counter()
    for _, text in rows:
        raw.update(plain_buckets(text))
    for text in target:
        wanted.update(plain_buckets(text))
    s_all, t_all = sum(raw.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 10000) / ((raw[b] + 1) * (t_all + 10000)))) for b in raw}
    out = []
    for key, text in rows:
        found = plain_buckets(text)
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"42:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = [i for i, (_, text) in enumerate(rows) if len(plain_words(text)) >= 20]
    able.sort(key=lambda i: (-out[i][3], out[i][0] is not None, out[i][0] or 0, -out[i][2], out[i][1]))
    for place, i in enumerate(able[: 5 * len(able) // 100]):
        out[i][4] = place + 1
    return [tuple(row) for row in out]


def test_resampling_against_plain_version(spark):
    rng = random.Random(12)
    marks = ["  ", ", ", ".\n", " été ", "-", "_", " 漢字 ", " \x00", " x" + "long" * 30 + " ", "É", " É" * 2, "'"]
    rows = [(i, "".join(w.title() + rng.choice(marks) for w in words_of(rng, rng.randrange(0, 90), 60).split())) for i in range(400)]
    rows += [(400, None), (401, ""), (402, " . \n"), (403, "ß" * 5000), (404, "é " * 30 + "漢" * 60)]
    target = [words_of(rng, 60, 20) for _ in range(15)] + [None, ""]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    assert Counter(map(tuple, got.collect())) == Counter(plain_resample(rows, target))


def test_resampling_on_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    target = odd_docs.limit(0).select("text")
    assert Counter(map(tuple, importance.resample(odd_docs, target).collect())) == Counter(plain_resample(rows, []))
    assert importance.resample(no_docs, odd_docs.select("text")).collect() == []


def test_long_texts_are_cut_at_breaks(monkeypatch):
    text = "".join(random.Random(1).choice(["Ab", "é", " ", "x", ". ", "漢字", "\n"]) for _ in range(3000))
    split = importance.Split(importance.Regex(importance.WORDS), "removed", invert=True)
    whole = importance.text_buckets(split, text, 10000, 3)
    monkeypatch.setattr(importance, "PIECE", 7)
    n, found = importance.text_buckets(split, text, 10000, 3)
    assert n == whole[0] and list(found) == list(whole[1]) == sorted(plain_buckets(text))


def test_numbered_over_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(50), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    want, order = {b: i + 1 for i, (a, b) in enumerate(sorted(rows))}, [F.col("a"), F.col("b")]
    assert {r.b: r.n for r in numbered(df, order, "n").collect()} == want
    half = numbered(df, order, "n", spark.range(1).selectExpr("1000 as x").select("x").scalar())
    assert {r.b: r.n for r in half.collect()} == {b: n if n <= 1000 else None for b, n in want.items()}


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, modulus):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{low}".encode())
            if modulus and h % modulus == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            counts[low] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = defaultdict(list)
    for a in counts:
        near[a] = [b for b in counts if one_apart(a, b)]
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda b: (-counts[b], b), default=None)
        if best is not None and counts[best] >= 5 * n:
            form[w] = best
    out = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, n, len(near[w]), form.get(w), counts[form[w]] if w in form else None, root))
    return out


def variant_rows(rng, letters="abcdeé", n=260):
    rows = []
    stock = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 15))) for _ in range(60)]
    stock += ["aaaaaaa", "aaaaaaaa", "ababababab", "abababababa", "bababababab", "ÀÉÉèèèç"]
    for i in range(n):
        ws = []
        for _ in range(40):
            w = list(rng.choice(stock[: 1 + rng.randrange(len(stock))]))
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = rng.choice(["", "a", "b", "q"])
            ws.append("".join(w).title() if rng.random() < 0.2 else "".join(w))
        rows.append((i, rng.choice([" ", ", ", "-", "1"]).join(ws)))
    return rows


@pytest.mark.parametrize("limit, modulus", [(0, 199), (3, 7), (32, None)])
def test_variants_against_all_pairs(spark, monkeypatch, limit, modulus):
    monkeypatch.setattr(spelling, "LIMIT", limit)
    rows = variant_rows(random.Random(limit))
    rows += [(1000, None), (1001, ""), (None, "nowhere " * 9), (None, "nowheres " * 50), (1002, "x" * 3000 + " " + "y" * 5999), *[(1003 + i, "z" * 3000) for i in range(5)]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = spelling.group_variants(docs, modulus=modulus)
    assert {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got.collect()} == plain_variants(rows, modulus)


def test_unaffected_grams_survive_an_edit():
    """The bound and the lists behind it, on words alone: of all pairs one edit apart, the merged lists share a gram."""
    rng = random.Random(3)
    known = {"".join(rng.choice("ab") for _ in range(rng.randrange(2, 7))): rng.randrange(1, 9) for _ in range(60)}
    for _ in range(4000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(6, 14)))
        at = rng.randrange(len(a) + 1)
        b = rng.choice([a[:at] + rng.choice("abc") + a[at:], a[:at] + rng.choice("abc") + a[at + 1 :]])
        if a == b or len(b) < len(a):
            continue
        top = spelling.longest_gram(len(a))
        first = spelling.merged_grams(a, top, known)
        second = set(spelling.merged_grams(b, top, known))
        moved = {(s, g) for s, g in first} | ({(s + 1, g) for s, g in first} if len(b) > len(a) else set())
        assert moved & second


def test_variants_on_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = spelling.group_variants(odd_docs, modulus=199)
    assert {tuple(r) for r in got.select("word", "n", "n_near", "form", "form_n", "root").collect()} == plain_variants(rows, 199)
    assert spelling.group_variants(no_docs).collect() == []


def test_queries_read_whole_tables(spark):
    from sparkledger.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = QUERIES["op11_minhash"](spark, folder).collect()
    plain = plain_components(docs, 4, 80)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(k, n, c, k == c) for (k, _), (n, c) in zip(docs, plain, strict=True)}
    assert Counter(map(tuple, QUERIES["op12_importance"](spark, folder).collect())) == Counter(plain_resample(docs, target))
    found = QUERIES["op13_spelling"](spark, folder).select("word", "n", "n_near", "form", "form_n", "root")
    assert {tuple(r) for r in found.collect()} == plain_variants(docs, 199)


def test_copies_changed_too_much_do_not_meet(spark):
    """Pairs and tables of the minhash operator hold no class whose own shingles rule a link out, and no table of one component."""
    sets = spark.createDataFrame([(1, list(range(10))), (2, list(range(9))), (3, [*range(6), 90, 91, 92, 93]), (3, [*range(6), 90, 91, 92, 93]), (4, [*range(6), 80, 81, 82, 83])], "c bigint, grams array<bigint>")
    own = {r.c: r.own for r in minhash.own_shingles(sets).collect()}
    assert own == {1: 1, 3: 4, 4: 4}
    shared = sets.distinct().selectExpr("c", "size(grams) n")
    near = minhash.within_reach(shared, spark.createDataFrame(list(own.items()), "c bigint, own bigint"), 80)
    assert {(r.c, r.common) for r in near.collect()} == {(1, 9), (2, 9)}
    rows = spark.createDataFrame([(7, 1, 10, 9, 1), (7, 2, 10, 9, 2), (7, 5, 10, 8, 5), (8, 1, 10, 9, 1), (8, 3, 10, 9, 1)], "key bigint, c bigint, n bigint, common bigint, label bigint")
    mixed = minhash.mixed_tables(rows)
    assert {r.key for r in mixed.collect()} == {7}
    assert {tuple(r) for r in minhash.pairs_apart(mixed, 80).collect()} == {(1, 2)}


def test_copies_of_one_text_do_not_all_meet(spark, monkeypatch):
    """Copies of a text that are no copies of each other: the second round makes a few pairs for each at most, and loses no link."""
    rng = random.Random(3)
    base = words_of(rng, 150, 10**6).split()
    rows = [(0, " ".join(base))]
    for copy in range(1, 151):  # five edits each, one of them made by other copies too
        edited, places = list(base), rng.sample(range(5, 145, 5), 7)
        for place in places[:4]:
            edited[place] = f"own{copy}x{place}"
        edited[places[4]] = f"often{rng.randrange(3)}"
        rows.append((copy, " ".join(edited)))
        if copy % 15 == 0:  # a chain of three that hangs together and not with the first text
            for step, place in enumerate(places[5:]):
                edited[place] = f"own{copy}y{place}"
                rows.append((1000 * (step + 1) - copy, " ".join(edited)))
    made, kept = [], minhash.kept_table

    def counted(df, name):
        table = kept(df, name)
        made.extend([table.count()] if name == "pairs" else [])
        return table

    monkeypatch.setattr(minhash, "kept_table", counted)
    docs = spark.createDataFrame([*rows, *rows[-40:]], "doc_id bigint, text string").repartition(4)
    out = {(r.doc_id, r.n_shingles, r.component_id) for r in minhash.deduplicate(docs, size=4).collect()}
    assert out == {(key, n, component) for (key, _), (n, component) in zip(rows, plain_components(rows, 4, 80), strict=True)}
    assert len({component for _, _, component in out}) == 151
    assert len(made) == 2 and 20 <= made[1] <= 3 * len(rows)


def test_rarest_shingles_meet_for_every_link(spark):
    """All links between labels are found by the rarest shingles, whatever the sizes of the two sets."""
    rng = random.Random(7)
    sets, base = {}, list(range(0, 600))
    for c in range(1, 121):
        n = rng.randrange(60, 130) if c % 2 else rng.randrange(2, 40)
        start = rng.randrange(0, 20)
        grams = set(base[start : start + n])
        for _ in range(rng.randrange(n // 7 + 1)):
            grams.discard(rng.choice(sorted(grams))) if rng.random() < 0.6 and len(grams) > 1 else grams.add(1000 + rng.randrange(400))
        sets[c] = grams
    rows = spark.createDataFrame([(c, len(g), c % 7, sorted(g)) for c, g in sets.items()], "c bigint, n bigint, label bigint, grams array<bigint>")
    links = {(a, b) for a in sets for b in sets if a < b and a % 7 != b % 7 and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    larger, smaller = minhash.rarest_shingles(rows, 80)
    found = {tuple(r) for r in minhash.pairs_apart(larger, 80, smaller).collect()}
    assert len(links) > 50 and links <= found and len(found) < 60 * 119
    bands = [r.band for r in spark.range(1, 3000).select(minhash.size_band(F.col("id")).alias("band")).collect()]
    assert bands == sorted(bands) and bands[:63] == list(range(1, 64)) and len(set(bands)) < 300


def test_minhash_sends_no_exploded_rows(spark, monkeypatch):
    """Table keys and shingles are many more bytes than the rows that Spark guesses them by, so their joins are merged even where those look small."""
    written = minhash.kept_table  # a table of a file, so that its size is known
    monkeypatch.setattr(minhash, "kept_table", lambda df, name: df)
    classes = written(spark.createDataFrame([(c, 10, [1, 2, 3, 10 * c]) for c in (1, 2, 3)], "c bigint, n bigint, keys array<bigint>"), "classes")
    shared = minhash.shared_keys(classes, 2)
    tables = minhash.in_tables(shared.withColumn("common", F.col("n")))
    labelled = tables.withColumn("label", F.col("c"))
    sets = written(spark.createDataFrame([(c, 10, c, [*range(9), 90 + c]) for c in (1, 2, 3)], "c bigint, n bigint, label bigint, grams array<bigint>"), "sets")
    larger, smaller = minhash.rarest_shingles(sets, 80)
    made = {
        "shared": shared, "tables": tables, "central": minhash.central_pairs(tables, 80), "mixed": minhash.mixed_tables(labelled), "larger": larger,
        "smaller": smaller, "apart": minhash.pairs_apart(labelled, 80), "met": minhash.pairs_apart(larger, 80, smaller),
    }
    for name, df in made.items():
        plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
        assert not [x for x in plan if "BroadcastHashJoin" in x and ("key#" in x or "gram#" in x)], name
    assert {(r.c, tuple(sorted(r.firsts)), tuple(r.seconds)) for r in shared.collect()} == {(c, (1, 2), (3,)) for c in (1, 2, 3)}
    assert {(r.a, r.b) for r in made["central"].collect()} == {(2, 1), (3, 1)}
    assert {(r.a, r.b) for r in made["met"].collect()} == {(1, 2), (1, 3), (2, 3)}
