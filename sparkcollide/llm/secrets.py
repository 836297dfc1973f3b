"""Secret scan: fixed patterns, and credential values that are costly to guess.

The guess cost of a value is the cheapest way to build it from dictionary
words, dates, repeats, keyboard walks and brute-force spans, found by dynamic
programming over end positions; costs are log10 of the guesses, so that spans
add.  Values after credential words whose cost reaches ``min_cost`` are added
to the pattern matches as kind ``guess``; the matches themselves always stay.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcollide.llm.common import carried, row_batch

# The patterns of the base kinds, in listed order, with the shortest match kept.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "guess"]
#: Credential context: a wider set of names, also "is", and values with any signs.
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|api[_ -]?key)["']?\x20{0,3}(?:[:=]|\bis\b)\x20{0,3}["']?([^\s"'<>,;]{6,})""", re.I | re.A)
HINTS = ("pass", "pwd", "secret", "token", "credential", "key")
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d", re.A)
LONGEST_WORD = 24
MIN_COST = 8.0


@cache
def dictionary(path: str) -> dict[str, float]:
    """log10 rank of the whole words of a vocabulary file, whose order is that of their frequency."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    words = [w[:-4] for w in sorted(vocab, key=vocab.get) if w.endswith("</w>") and len(w) > 6 and w[:-4].isalpha() and w[:-4].isascii()]
    return {w: math.log10(2 + k) for k, w in enumerate(words)}


def _neighbours() -> set[tuple[str, str]]:
    steps = {(a, b) for row in ROWS for a, b in zip(row, row[1:], strict=False)}
    return steps | {(b, a) for a, b in steps}


NEXT = _neighbours()
_CLASS = ((re.compile("[0-9]"), 10), (re.compile("[a-z]"), 26), (re.compile("[A-Z]"), 26))


def _alphabet(c: str) -> float:
    return math.log10(next((n for p, n in _CLASS if p.match(c)), 33))


def guess_cost(value: str, words: dict[str, float]) -> tuple[float, list[tuple[str, int, int]]]:
    """Smallest log10 guesses of a value and the spans that reach it.

    Ties go to the span found first: word, date, repeat, walk, brute force.
    Words are bounded by LONGEST_WORD and a run's every end is tried by its
    start alone, so a value of n characters takes O(n) steps of bounded work.
    """
    n, low = len(value), value.lower()
    best: list[float] = [0.0] + [math.inf] * n
    via: list[tuple[str, int]] = [("", 0)] * (n + 1)
    join = math.log10(2)

    def offer(kind: str, a: int, b: int, cost: float) -> None:
        cost += best[a] + (join if a else 0)
        if cost < best[b] - 1e-12:
            best[b], via[b] = cost, (kind, a)

    repeat = walk = 1  # lengths of the runs that end just before i
    dates: dict[int, list[int]] = {}
    for i in range(n):
        for m in (DATE.match(value, i),) if value[i].isdigit() else ():
            if m and m.end() - i >= 4:
                dates.setdefault(i, []).append(m.end())
    starts_r = starts_w = 0
    for i in range(n):
        a = i
        for b in range(a + 3, min(n, a + LONGEST_WORD) + 1):
            r = words.get(low[a:b])
            if r is not None:
                offer("word", a, b, r + (0 if value[a:b] == low[a:b] else join))
        for b in dates.get(i, ()):
            offer("date", a, b, 4.6 if b - a > 4 else 2.1)
        if i and value[i] == value[i - 1]:
            repeat += 1
        else:
            repeat, starts_r = 1, i
        if i and (low[i - 1], low[i]) in NEXT:
            walk += 1
        else:
            walk, starts_w = 1, i
        if repeat >= 3:
            offer("repeat", starts_r, i + 1, _alphabet(value[i]) + math.log10(repeat))
        if walk >= 4:
            offer("walk", starts_w, i + 1, 1.7 + math.log10(walk))
        kind, s = via[i]
        cost = _alphabet(value[i])
        if i and kind == "brute":  # a brute-force span goes on without a new joint
            if best[i] + cost < best[i + 1] - 1e-12:
                best[i + 1], via[i + 1] = best[i] + cost, ("brute", s)
        else:
            offer("brute", i, i + 1, cost)
    spans, b = [], n
    while b:
        kind, a = via[b]
        spans.append((kind, a, b))
        b = a
    return best[n], spans[::-1]


def find(text: str, words: dict[str, float], min_cost: float) -> list[tuple[int, int, int, float]]:
    """(start, kind number, end, cost) of all secrets of a text, ordered; code points, end exclusive."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end(), 0.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        for m in CONTEXT.finditer(text):
            value = m[1].rstrip(".:)]}")
            if len(value) >= 6:
                cost, _ = guess_cost(value, words)
                if cost >= min_cost:
                    out.append((m.start(1), 3, m.start(1) + len(value), cost))
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), 0.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), 0.0) for m in HEX.finditer(text)]
    return sorted(out)


def scan(docs: DataFrame, vocabulary: str, min_cost: float = MIN_COST, redact: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, spans, redacted, carry): secrets of every whole text, in order.

    ``spans`` is an array of (kind, start, end, cost), empty where nothing is
    found; ``redacted`` is the text with every span, overlapping ones merged,
    replaced by ``redact`` (null unless asked for).  Null text: empty.  Columns
    named in ``carry`` come along in a struct, others are not read.  One narrow
    pass, no shuffle.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("cost", pa.float64())])

    def run(batches):
        words = dictionary(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                spans, texts = [], []
                for t in part.column(1).to_pylist():
                    t = t or ""
                    got = find(t, words, min_cost)
                    spans.append([{"kind": KINDS[k], "start": a, "end": b, "cost": c} for a, k, b, c in got])
                    if redact is None:
                        texts.append(None)
                        continue
                    keep, end = [], 0
                    for a, _, b, _ in got:
                        if a >= end:
                            keep += [t[end:a], redact]
                        end = max(end, b)
                    texts.append("".join(keep) + t[end:])
                yield row_batch(doc_id=part.column(0), spans=pa.array(spans, pa.list_(span)), redacted=pa.array(texts, pa.string()), carry=part.column(2))

    rows = docs.select("doc_id", "text", carried(carry))
    return rows.mapInArrow(run, f"doc_id long, spans array<struct<kind:string,start:int,end:int,cost:double>>, redacted string, carry {rows.schema['carry'].dataType.simpleString()}")


def op2_secrets(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Counts and digests of the found spans, one row per document."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return scan(docs, vocabulary).select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), count("guess").alias("n_guess"),
        F.array_max(F.transform("spans", lambda s: s["cost"])).alias("max_cost"),
    )
