"""Conversation repair, periodic runs and nearest neighbours against brute force on small tables."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from sparkcollide.llm import conversations, nearest, periods
from tests.llm.fixtures import WORD, by_id, clashing, documents, texts

BLANKS = re.compile(r"[\x20\x09-\x0D]*\Z")
NEXT = {"": "u", "s": "u", "a": "u", "u": "a"}


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# --- conversations -----------------------------------------------------------------
def plain_repair(turns):
    """Cheapest, then least edits with whole strings: turns are (initial, must go, truncated)."""
    best = {"": (0, "")}

    def offer(to, state, value):
        if state not in to or value < to[state]:
            to[state] = value

    def inserted(b):
        b = dict(b)
        for _ in range(3):
            for state, (cost, audit) in list(b.items()):
                offer(b, NEXT[state], (cost + 5, audit + "I"))
        return b

    for initial, go, cut in turns:
        new = {}
        for state, (cost, audit) in inserted(best).items():
            offer(new, state, (cost + 2, audit + "D"))
            if not go:
                stay = cost + 5 * cut
                if initial == "s" and state == "" or initial in ("u", "a") and initial == NEXT[state]:
                    offer(new, initial, (stay, audit + "K"))
                offer(new, NEXT[state], (stay + 1, audit + "R"))
        best = new
    best = inserted(best)
    return min(best[s] for s in ("", "a") if s in best)


def plain_conversation(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, marks, count = set(), [], dict(blank=0, duplicate=0, truncated=0)
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            count[fault] += 1
        marks.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    cost, audit = plain_repair(marks)
    lines, state, left = [], "", iter(rows)
    for e in audit:
        role, text = ("", "") if e == "I" else next(left)[1:]
        if e in "IR":
            role = {"u": "user", "a": "assistant"}[NEXT[state]]
        if e != "D":
            lines.append(f"{role}:{text}")
            state = role[:1]
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return dict(gaps=gaps, illegal=illegal, cost=cost, audit=audit, repaired_sha256=sha("\n".join(lines)), **count)


def plain_op11(rows):
    by = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        part = by.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            part += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {conv: dict(conv_id=conv, **plain_conversation(part)) for conv, part in by.items()}


def conversation_rows(n=90, seed=2):
    r = random.Random(seed)
    rows = [(c, None if r.random() < 0.03 else t, r.choice(["user", "assistant", "system", "tool", "", None]) if r.random() < 0.3 else ("user", "assistant")[t % 2], r.choice(["a.", "b!", " ", "", "c", None, f"{c} {t}?", "é" * 9 + "."]))
            for c in range(n) for t in range(r.choice([1, 2, 3, 8, 30]))]
    rows += [(7, 1, "user", "a."), (7, 1, "user", "a."), (None, 0, "user", "x."), (None, 1, "assistant", "x" * 50000 + ".")]
    rows += [(500, t, ("user", "assistant")[t % 2], f"{t % 40}.") for t in range(900)]
    return rows


def test_conversations_match_brute_force(spark):
    rows = conversation_rows()
    table = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).drop("copy")
    want = plain_op11(rows)
    for block in (conversations.BLOCK, 5):  # 5: conversations in many linked segments
        got = by_id(conversations.repair(conversations.damage(table), block).drop("repaired"), "conv_id")
        assert got == want
    assert by_id(conversations.op11_repair(table), "conv_id") == want
    assert conversations.op11_repair(table.limit(0)).count() == 0


def test_conversation_text_and_one_partition(spark):
    rows = [(1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "assistant", "Yes"), (2, 0, "system", "S.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    got = by_id(conversations.repair(table, keep_text=True), "conv_id")
    assert (got[1]["audit"], got[1]["cost"], got[1]["repaired"]) == ("DDD", 6, "")
    assert got[2]["audit"] == "D" and got[2]["repaired_sha256"] == sha("")


def test_trails_with_colliding_hashes(monkeypatch):
    monkeypatch.setattr(conversations, "MOD", 3)  # nearly all prefixes collide
    r = random.Random(4)
    for _ in range(300):
        turns = [(r.choice("suax"), r.random() < 0.2, r.random() < 0.3) for _ in range(r.choice([3, 12, 40]))]
        walk = conversations.Walk(conversations.Trails(), [(0, 0), None, None, None])
        for t in turns:
            walk.turn(*t)
        cost, node = walk.finish()
        assert (cost, walk.trails.string(node)) == plain_repair(turns)


# --- periodic runs -----------------------------------------------------------------
def plain_runs(w, least=6, power=4):
    out = {}
    for q in range(1, len(w) // power + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, power * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def plain_op12(doc, text):
    w = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc).encode()), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
    return dict(
        doc_id=doc, n_runs=len(runs), start=top[0], length=top[1], period=top[2], exponent_milli=1000 * top[1] // top[2] if runs else None,
        runs_sha256=sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), collapsed_sha256=sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def test_runs_match_brute_force(spark):
    r = random.Random(6)
    rows = texts() + ["a " * 700, "x " + "a b " * 50 + "a c", " ".join("one two three".split() * 5), "one", "b b b b b", "b b b b b b"]
    rows += [" ".join(r.choice("abc"[:k]) for _ in range(n)) for k in (1, 2, 3) for n in (7, 40, 200)]
    rows += [" ".join(str(bin(i).count("1") & 1) for i in range(3000))]  # no run of three periods
    table = list(enumerate(rows))
    got = by_id(periods.op12_runs(clashing(documents(spark, table))))
    assert got == {i: plain_op12(i, t) for i, t in table}
    assert sum(x["n_runs"] for x in got.values()) > 12
    assert periods.op12_runs(documents(spark).limit(0)).count() == 0
    again = periods.op12_runs(documents(spark, [(None, "a a a a a a"), (3, "a a a a a a"), (3, "a a a a a a")])).collect()
    assert len(again) == 3 and again[0]["n_runs"] == 1


def test_runs_of_random_words():
    r = random.Random(9)
    for _ in range(400):
        words = []
        for _ in range(r.randrange(1, 5)):
            w = [r.randrange(r.choice([1, 2, 3, 9])) for _ in range(r.choice([0, 1, 6, 30, 150]))]
            if len(w) > 5 and r.random() < 0.5:
                p, a = r.randrange(1, 9), r.randrange(len(w))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            words.append(w)
        first = np.cumsum([0] + [len(w) for w in words])
        _, ids = np.unique(np.array([100 * k + x for k, w in enumerate(words) for x in w], np.int64), return_inverse=True)
        got = sorted((s, e - s, q) for s, e, q in periods.runs_of(ids, first).T.tolist())
        assert got == [(s + first[k], n, q) for k, w in enumerate(words) for s, n, q in plain_runs(w)]


# --- nearest neighbours ------------------------------------------------------------
def plain_nearest(rows, query, top=20):
    out = {}
    fit = [(i, k, np.array(v, float)) for k, (i, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    for i, k, q in fit:
        if query(i):
            found = sorted((-float((q * v).sum()), j is None, j or 0) for j, m, v in fit if m != k)
            out[i] = [(None if n else j, -s) for s, n, j in found[:top]]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_nearest_small_table_is_exact(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.standard_normal(8).tolist()) for i in range(120)]
    rows += [(200 + i, [1.0] + [0.0] * 7) for i in range(60)]  # copies: ties go to the smaller id
    rows += [(300, None), (301, []), (320, [0.0] * 8), (340, [None] + [1.0] * 7), (360, [float("nan")] * 8), (380, [float("inf")] + [0.0] * 7), (None, [2.0] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = answers(nearest.op13_nearest(clashing(table))), plain_nearest(rows, lambda i: i is not None and i % 20 == 0)
    assert set(got) == set(want)
    for q in want:
        assert [j for j, _ in got[q]] == [j for j, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12)
    few = answers(nearest.op13_nearest(table.where("vec_id < 3 or vec_id = 20")))
    assert [len(v) for v in few.values()] == [3, 3]
    assert nearest.op13_nearest(table.limit(0)).count() == 0


def test_nearest_recall_with_hot_cluster_and_norms(spark, monkeypatch):
    monkeypatch.setattr(nearest, "LIST", 64)
    monkeypatch.setattr(nearest, "TILE", 100)  # lists and queries in several cells
    r = np.random.default_rng(3)
    x = r.standard_normal((3000, 16)) * r.uniform(0.2, 3, (3000, 1))
    x[:1000] = x[0] + 0.05 * r.standard_normal((1000, 16))
    rows = list(enumerate(x.tolist()))
    got = answers(nearest.op13_nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    want = plain_nearest(rows, lambda i: i % 20 == 0)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    for q, found in got.items():
        exact = [float((x[q] * x[j]).sum()) for j, _ in found]
        assert np.allclose(exact, [s for _, s in found], rtol=1e-12) and sorted(exact, reverse=True) == exact


def test_graph_search_reaches_all_lists():
    r = np.random.default_rng(4)
    x = r.standard_normal((4096, 12))
    index = nearest.build(x, 200_000, float(np.sqrt((x * x).sum(1)).max()))
    q = nearest._directed(x[:300])
    exact = nearest._distances(q, index.centroids)
    dist, at = nearest.search(index, q, 1.1)
    found = sum(np.isfinite(dist).sum(1))
    assert len(index.centroids) == 128 and found >= 0.99 * (exact <= 1.1 * exact.min(1)[:, None]).sum()
