"""Periodic runs of words, found on a grammar of each text.

A text's word ids are compressed by Re-Pair: in rounds, repeated pairs that are
the most frequent ones of both their symbols become nonterminals, all their
occurrences at once.  What is left of a text is joined by a balanced tree, so
that every run of words crosses the boundary of one node that holds it whole.
Runs across a boundary are computed once a node: a run of four periods has two
of them on one side, so the word pair at the boundary comes again one period
away, within half the node's side.  Those places are looked up in the sorted
list of word pairs; prefix hashes verify and extend them.  A nonterminal's runs
are then set to every place where it was put into the text, and the intervals
that no neighbouring word extends are the maximal runs.

Texts are handled whole, many at once, in chunks of bounded size (a longer text
makes a longer chunk).
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcollide.llm.common import row_batch
from sparkcollide.llm.words import Chunk, chunks

MIN_LENGTH = 6
MIN_POWER = 4
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
SCHEMA = f"doc_id long, n_words long, n_runs long, runs {RUNS}, collapsed string"
PRIMES = ((2147483647, 1103515245), (2147483629, 69069069))  # (modulus below 2**31, base)


@cache
def _powers(lane: int, size: int) -> np.ndarray:
    prime, base = PRIMES[lane]
    out = np.ones(1, np.int64)
    while len(out) < size:  # by doubling: base**(n + i) = base**n * base**i
        out = np.concatenate([out, out * (int(out[-1]) * base % prime) % prime])
    return out


class SpanHash:
    """Equality of spans of ids by two polynomial prefix hashes modulo primes."""

    def __init__(self, ids: np.ndarray):
        size = 1 << max(12, int(len(ids) + 1).bit_length())
        self.lanes = []
        for lane, (prime, _) in enumerate(PRIMES):
            value = (ids * (40503 + 2 * lane) + 12345) % prime
            sums = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(value * _powers(lane, size)[: len(ids)] % prime, out=sums[1:])
            self.lanes.append((prime, _powers(lane, size), sums))

    def equal(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """ids[i:i+length] == ids[j:j+length], for i <= j."""
        same = np.ones(len(i), bool)
        for prime, power, sums in self.lanes:
            a, b = (sums[i + length] - sums[i]) % prime, (sums[j + length] - sums[j]) % prime
            same &= a * power[j - i] % prime == b
        return same

    def extend(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """Longest common extension of places i < j, at most ``most`` words: forward from them, or back from before them."""
        low, high = np.zeros(len(i), np.int64), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            shift = mid if back else 0
            same = self.equal(i - shift, j - shift, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def grammar(ids: np.ndarray, row: np.ndarray):
    """Re-Pair of many texts at once; the ids of different rows differ.

    Returns rules (first word, boundary, end of a nonterminal's first occurrence),
    occurrences (rule, first word), sorted by rule, and the places of the symbols left.
    """
    cur, at, size = ids.astype(np.int64), np.arange(len(ids)), int(ids.max()) + 1 if len(ids) else 0
    of = row
    live = np.ones(max(0, len(cur) - 1), bool)
    rules, found, made = [], [], 0
    while True:
        live &= of[:-1] == of[1:]
        place = np.flatnonzero(live)
        pair, inverse, count = np.unique(cur[place] * size + cur[place + 1], return_inverse=True, return_counts=True)
        often = np.flatnonzero(count > 1)
        live[place] = count[inverse] > 1
        if not len(often):
            break
        left, right = np.divmod(pair[often], size)
        score = count[often] * np.int64(len(often)) + np.arange(len(often))[::-1]
        symbols, ends = np.unique(np.concatenate([left, right]), return_inverse=True)
        best = np.zeros(len(symbols), np.int64)
        np.maximum.at(best, ends, np.concatenate([score, score]))
        taken = (best[ends[: len(often)]] == score) & (best[ends[len(often) :]] == score)
        rank = np.full(len(pair), -1, np.int64)
        rank[often[taken]] = np.arange(taken.sum())
        mine = rank[inverse]
        here, mine = place[mine >= 0], mine[mine >= 0]
        # only pairs of equal symbols overlap: every other one of a streak
        fresh = np.concatenate([[True], np.diff(here) > 1])
        streak = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        keep = (np.arange(len(here)) - streak) % 2 == 0
        here, mine = here[keep], mine[keep]
        end = np.append(at, len(ids))
        order = np.argsort(mine, kind="stable")
        first = order[np.flatnonzero(np.concatenate([[True], np.diff(mine[order]) > 0]))]
        rules.append(np.stack([at[here[first]], at[here[first] + 1], end[here[first] + 2]]))
        found.append(np.stack([mine[order] + made, at[here[order]]]))
        made += int(taken.sum())
        cur[here] = size + mine
        size += int(taken.sum())
        stay = np.ones(len(cur), bool)
        stay[here + 1] = False
        # a pair is counted again if it was repeated or has a new symbol
        again = np.append(live, False)
        again[here] = True
        again[here[here > 0] - 1] = True
        cur, at, of = cur[stay], at[stay], of[stay]
        live = again[stay][:-1]
    rule = np.concatenate(rules, axis=1) if rules else np.zeros((3, 0), np.int64)
    occurrence = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return rule, occurrence, at


def tree(at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Nodes (start, boundary, end) of balanced trees over the symbols at ``at``; ``first``: each row's first word, and the end."""
    head = np.searchsorted(at, first)
    row = np.repeat(np.arange(len(first) - 1), np.diff(head))
    j = np.arange(len(at)) - head[row]
    inner = np.flatnonzero(j > 0)
    j, row = j[inner], row[inner]
    step = j & -j
    end = np.append(at, first[-1])
    return np.stack([end[inner - step], end[inner], end[np.minimum(inner + step, head[row + 1])]])


def crossing(nodes: np.ndarray, ids: np.ndarray, spans: SpanHash, min_length: int, min_power: int) -> np.ndarray:
    """Runs (node, start, end, period) across the nodes' boundaries, within the nodes; min_power is 4 or more."""
    a, b, e = nodes
    nothing = np.zeros((4, 0), np.int64)
    if not len(a):
        return nothing
    _, gram = np.unique(ids[:-1] * (int(ids.max()) + 1) + ids[1:], return_inverse=True)
    key = np.sort(gram * np.int64(len(ids)) + np.arange(len(gram)))
    mid = b - 1
    lead = gram[mid] * np.int64(len(ids))
    low = np.searchsorted(key, lead + mid - (b - a) // 2)
    high = np.searchsorted(key, lead + mid + (e - b) // 2, "right")
    many = high - low
    node = np.repeat(np.arange(len(a)), many)
    of = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + low[node]
    other = key[of] % len(ids) + 1
    node, other = node[other != b[node]], other[other != b[node]]
    # right of the boundary: [b, b + q) again at b + q; left: [b - 2q, b - q) again at b - q
    q = np.abs(other - b[node])
    i = np.where(other > b[node], b[node], b[node] - 2 * q)
    ok = spans.equal(i, i + q, q)
    node, other, q = node[ok], other[ok], q[ok]
    i = np.minimum(other, b[node])
    right = spans.extend(i, i + q, e[node] - i - q, False)
    left = spans.extend(i, i + q, i - a[node], True)
    start, end = i - left, i + q + right
    ok = (end - start >= np.maximum(min_length, min_power * q)) & (start < b[node]) & (end > b[node])
    return np.stack([node[ok], start[ok], end[ok], q[ok]])


def runs_of(ids: np.ndarray, first: np.ndarray, min_length: int = MIN_LENGTH, min_power: int = MIN_POWER) -> np.ndarray:
    """Maximal runs (start, end, period) of many texts: ids differ between texts, text k is ids[first[k]:first[k+1]]."""
    if len(ids) < 2:
        return np.zeros((3, 0), np.int64)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    spans = SpanHash(ids)
    rule, occurrence, at = grammar(ids, row)
    own = crossing(rule, ids, spans, min_length, min_power)
    top = crossing(tree(at, first), ids, spans, min_length, min_power)
    # a nonterminal's runs at all places of the nonterminal
    lo, hi = np.searchsorted(occurrence[0], own[0]), np.searchsorted(occurrence[0], own[0], "right")
    many = hi - lo
    k = np.repeat(np.arange(own.shape[1]), many)
    place = occurrence[1][np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + lo[k]]
    shift = place - rule[0][own[0][k]]
    start, end, q = (np.concatenate(x) for x in ((own[1][k] + shift, top[1]), (own[2][k] + shift, top[2]), (own[3][k], top[3])))
    before, after = np.maximum(start - 1, 0), np.minimum(end, len(ids) - 1)
    more = (start > first[row[start]]) & (ids[before] == ids[before + q]) | (end < first[row[start] + 1]) & (ids[after] == ids[after - q])
    start, end, q = start[~more], end[~more], q[~more]
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    new = np.ones(len(start), bool)  # of equal intervals the smallest period
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return np.stack([start[new], end[new], q[new]])


def _found(min_length: int, min_power: int):
    def run(batches):
        for batch in batches:
            lead, share = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            texts = pc.fill_null(batch.column(1), "")
            for c in chunks(texts):
                yield _chunk(batch.column(0), texts, c, lead[c.lo : c.hi], share[c.lo : c.hi], min_length, min_power)

    return run


def _chunk(doc: pa.Array, texts: pa.Array, c: Chunk, lead: np.ndarray, share: np.ndarray, min_length: int, min_power: int) -> pa.RecordBatch:
    first, n, row = c.first, np.diff(c.first), c.row_of_word()
    # a share of each text is repeated: word i >= a becomes word a + (i - a) % p
    word = np.arange(len(row))
    a = np.where(n > 0, lead % np.maximum(n, 1), 0)
    p = np.where(share > 0, 1 + (n - a) // np.maximum(share, 1), 0)
    i = word - first[row]
    put = np.where((p[row] > 0) & (i >= a[row]), a[row] + (i - a[row]) % np.maximum(p[row], 1), i) + first[row]
    _, ids = np.unique(c.word_hash(), return_inverse=True)
    kinds = int(ids.max()) + 1 if len(ids) else 1
    _, ids = np.unique(row * np.int64(kinds) + ids[put], return_inverse=True)
    start, end, q = runs_of(ids, first, min_length, min_power)
    gone = np.zeros(len(row) + 1, np.int64)
    np.add.at(gone, start + q, 1)
    np.add.at(gone, end, -1)
    stay = np.cumsum(gone[:-1]) == 0
    has = np.searchsorted(start, first)
    kept = []
    for k, text in enumerate(texts.slice(c.lo, c.hi - c.lo).to_pylist()):
        words = text.encode().split()  # the ASCII blanks, as in words.py
        if p[k] or has[k + 1] > has[k]:
            s = slice(first[k], first[k + 1])
            words = [words[x] for x in (put[s] - first[k])[stay[s]].tolist()]
        kept.append(b" ".join(words).decode())
    runs = pa.StructArray.from_arrays([pa.array(start - first[row[start]]), pa.array(end - start), pa.array(q)], ["start", "length", "period"])
    return row_batch(
        doc_id=doc.slice(c.lo, c.hi - c.lo), n_words=n.astype(np.int64), n_runs=np.diff(has).astype(np.int64),
        runs=pa.ListArray.from_arrays(pa.array(has.astype(np.int32)), runs), collapsed=pa.array(kept, pa.string()),
    )


def find_runs(docs: DataFrame, lead: Column | None = None, share: Column | None = None, min_length: int = MIN_LENGTH, min_power: int = MIN_POWER) -> DataFrame:
    """(doc_id, n_words, n_runs, runs, collapsed): the maximal periodic runs of each text's words.

    A run is a stretch with smallest period ``period``, at least min_power
    periods and min_length words long, that no neighbouring word extends;
    ``runs`` is sorted by start, then period.  ``collapsed`` holds, joined by one
    space, the words that are in no run after its first period.  ``lead`` and
    ``share`` ask for a text made periodic first: with n words, from word
    a = lead % n on it repeats its next 1 + floor((n - a) / share) words; a share
    of 0 or null leaves the text as it is.  Null or empty texts have no words and
    no runs.  Each row is judged alone, so repeated rows, ties and null ids change
    nothing; other columns are not read.  An empty table gives no rows.
    """
    if min_power < 4:
        raise ValueError("min_power must be 4 or more")
    zero = F.lit(0).cast("long")
    cols = [zero if c is None else F.coalesce(c.cast("long"), zero) for c in (lead, share)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", cols[0].alias("lead"), cols[1].alias("share"))
    return rows.mapInArrow(_found(min_length, min_power), SCHEMA)


def op12_runs(docs: DataFrame) -> DataFrame:
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    found = find_runs(docs, g, F.when(h % 10 == 0, g % 8 + 3))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = found.withColumn("m", longest).select(
        "doc_id", "n_runs", (-F.col("m.start")).alias("start"), F.col("m.length").alias("length"), (-F.col("m.period")).alias("period"),
        F.floor(F.col("m.length") * 1000 / -F.col("m.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
    return found
