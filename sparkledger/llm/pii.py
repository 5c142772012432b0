"""Personal data: patterns propose spans, checks confirm them, words nearby adjust their score.

E-mail, network address, card and phone spans that pass their checks are always kept. Bank accounts (mod 97) and national ids
(by their number rules) are added only where check and context together reach the least score.

A pass over the rows: no shuffle, and a task holds a batch of texts at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import ship_package

# Kinds in the order of the lists, and the patterns of the four base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "national")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
NATIONAL = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# What a passed check is worth, what a word nearby adds or takes, and what an added kind needs.
CHECKED = {"email": 0.8, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.8, "national": 0.4}
CONTEXT = {
    "email": r"mail|contact|write",
    "ip": r"\bip\b|address|host|server|login",
    "card": r"card|visa|credit|payment|cvv|karte|carte|tarjeta",
    "phone": r"phone|call|tel\b|mobile|fax|contact",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "national": r"ssn|social security|national id|tax id",
}
AGAINST = re.compile(r"example|version|isbn|order no|serial|test", re.IGNORECASE)
FOR = {kind: re.compile(words, re.IGNORECASE) for kind, words in CONTEXT.items()}
NEARBY = 40
LEAST_SCORE = 0.6


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod_97(account: str) -> bool:
    """The bank account check: country and check digits to the end, letters as 10 to 35, remainder 1."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: from each at sign back over the local part, no further than the match before."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        end = found.end() if found else max(end, at + 1)
        at = text.find("@", max(at + 1, end))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Dotted numbers in fours, left to right; a four with a part over 255 is used up and dropped."""
    for chain in DOTTED.finditer(text):
        start, parts = chain.start(), chain.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield start, start + size
            start += size + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for found in CARD.finditer(text):
        if 13 <= found.end() - found.start() <= 37:
            digits = found.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield found.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for found in PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in found.group()) <= 15:
            yield found.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """The pattern proposes the longest span; where that fails, its shorter ends at a blank are tested, longest first.

    The search goes on behind an account, or behind the first group of a span without one, so a span uses up no other account.
    """
    found = IBAN.search(text)
    while found:
        start, end = found.span()
        while end > start and not (15 <= len(account := text[start:end].replace(" ", "")) <= 34 and mod_97(account)):
            end = text.rfind(" ", start, end)
        if end > start:
            yield start, end
        found = IBAN.search(text, max(end, start + 4))


def nationals(text: str) -> Iterator[tuple[int, int]]:
    for found in NATIONAL.finditer(text):
        area, group, serial = found.groups()
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield found.span()


FINDERS = (emails, addresses, cards, phones, ibans, nationals)
BASE = 4
ANY_DIGIT = re.compile(r"[0-9]")


def score(text: str, kind: str, start: int, end: int) -> float:
    """What the check is worth, more with a fitting word within ``NEARBY`` characters, less with one that speaks against it."""
    around = text[max(0, start - NEARBY) : start] + " " + text[end : end + NEARBY]
    value = CHECKED[kind] + (0.2 if FOR[kind].search(around) else 0.0) - (0.3 if AGAINST.search(around) else 0.0)
    return round(min(1.0, max(0.0, value)), 2)


def find_spans(text: str) -> list[tuple[int, int, int, float]]:
    """(kind, start, end, score) by kind, then start; offsets in code points."""
    out = []
    digits = ANY_DIGIT.search(text) is not None
    for kind, finder in enumerate(FINDERS):
        if kind and not digits:
            break
        for start, end in finder(text):
            worth = score(text, KINDS[kind], start, end)
            if kind < BASE or worth >= LEAST_SCORE:
                out.append((kind, start, end, worth))
    return out


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("score", pa.float64())])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pii, counts, base_sha256, spans) per row.

    ``pii`` lists kind, start, end, value and score by kind, then start; n_email, n_ip, n_card and n_phone count the base kinds,
    whose kind:start:end, comma-joined, make ``base_sha256``; ``spans`` joins all. Null and empty texts have no
    spans; repeated rows give a row each; texts are read whole, in time linear in their length; an empty table gives
    an empty one. Other columns of ``docs`` are not read, whatever their names.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    counts = ["n_email", "n_ip", "n_card", "n_phone"]
    schema = f"`{id_col}` {id_type}, " + ", ".join(f"{c} bigint" for c in counts)
    schema += ", base_sha256 string, spans string, pii array<struct<kind:string,start:int,end:int,value:string,score:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, shas, lists, spans = [[], [], [], []], [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                found = find_spans(text)
                for kind in range(BASE):
                    numbers[kind].append(sum(f[0] == kind for f in found))
                names = [f"{KINDS[k]}:{a}:{b}" for k, a, b, _ in found]
                base = ",".join(n for n, f in zip(names, found, strict=True) if f[0] < BASE)
                shas.append(hashlib.sha256(base.encode()).hexdigest())
                lists.append(",".join(names))
                spans.append([{"kind": KINDS[k], "start": a, "end": b, "value": text[a:b], "score": s} for k, a, b, s in found])
            columns = [batch.column(0), *(pa.array(n, pa.int64()) for n in numbers), pa.array(shas, pa.string()), pa.array(lists, pa.string()), pa.array(spans, pa.list_(SPAN))]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, *counts, "base_sha256", "spans", "pii"])

    ship_package(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(run, schema)
