"""Byte-level BPE by a segment tree over adjacent pair ranks.

A word's symbols stand in the leaves of a tree whose inner nodes keep the
smaller of two keys; a key is (rank of the pair starting here, position), so
the root names the leftmost pair of the lowest rank.  A merge changes three
leaves and the nodes above them.  Words up to ``WIDE`` bytes are encoded many
at a time, each one row of a matrix of trees; longer ones one by one, in
O(n log n).  Null and empty texts have no ids; repeated rows get equal ids.
"""

from __future__ import annotations

import json
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcollide.llm.common import row_batch

# The published splitting pattern of byte-level BPE vocabularies.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same text cut coarser: a cut never divides a match of PIECES.
UNITS = r" ?\S+|\s+(?!\S)|\s+"
NONE = np.int64(2**62)
POS = 20  # bits of the position in a key
WIDE = 64
SPECIAL = "a \0"  # no unit of a text looks like this: it marks special tokens among them
CACHE = 500_000
SCHEMA = "doc_id long, ids binary, decoded string"


def byte_chars() -> dict[int, str]:
    """Printable stand-ins of all bytes: themselves where printable, else characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Bpe:
    """Vocabulary, merges and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        chars = byte_chars()
        back = {c: b for b, c in chars.items()}
        self.byte_id = np.array([vocab[chars[b]] for b in range(256)], np.int64)
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int64), made[order]
        self.rank_of = dict(zip(key.tolist(), range(len(pairs)), strict=True))
        self.made_of = made.tolist()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces, self.units = regex.compile(PIECES), regex.compile(UNITS)
        self.known: dict[str, bytes] = {SPECIAL + t: np.uint32(i).tobytes() for t, i in self.special.items()}

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NONE where it has none) and the id it merges into."""
        want = a << 32 | b
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        hit = (self.key[at] == want) & (a >= 0) & (b >= 0)
        return np.where(hit, self.rank[at], NONE), np.where(hit, self.made[at], -1)

    def encode_many(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words of at most WIDE bytes, a row of trees for each."""
        size = np.array([len(w) for w in words])
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        for width in (4, 8, 16, 32, 64):
            rows = np.flatnonzero((size <= width) & (size > width // 2 if width > 4 else size > 0))
            if not len(rows):
                continue
            n = len(rows)
            raw = np.frombuffer(b"".join(words[r].ljust(width, b"\0") for r in rows), np.uint8).reshape(n, width)
            place = np.arange(width)
            sym = np.where(place < size[rows, None], self.byte_id[raw], -1)
            nxt = np.where(place + 1 < size[rows, None], place + 1, width)
            prv = np.broadcast_to(place - 1, (n, width)).copy()
            right = np.concatenate([sym[:, 1:], np.full((n, 1), -1)], 1)
            rank, _ = self.pair(sym, right)
            tree = np.full((n, 2 * width), NONE, np.int64)
            tree[:, width:] = np.where(rank < NONE, rank << POS | place, NONE)
            for node in range(width - 1, 0, -1):
                tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
            live = np.flatnonzero(tree[:, 1] < NONE)
            while len(live):
                i = tree[live, 1] & ((1 << POS) - 1)
                j = nxt[live, i]
                after = nxt[live, j]
                _, sym[live, i] = self.pair(sym[live, i], sym[live, j])
                sym[live, j] = -1
                nxt[live, i] = after
                has = after < width
                prv[live[has], after[has]] = i[has]
                before = prv[live, i]
                for at, other in ((i, after), (np.where(before < 0, i, before), np.where(before < 0, after, i)), (j, np.full(len(j), width))):
                    second = np.where(other < width, sym[live, np.minimum(other, width - 1)], -1)
                    rank, _ = self.pair(sym[live, at], second)
                    node = at + width
                    tree[live, node] = np.where(rank < NONE, rank << POS | at, NONE)
                    while width > 1 and node[0] > 1:
                        node = node >> 1
                        tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])
                live = live[tree[live, 1] < NONE]
            keep = sym >= 0
            flat, ends = sym[keep].astype(np.uint32), np.cumsum(keep.sum(1))
            for r, ids in zip(rows.tolist(), np.split(flat, ends[:-1]), strict=True):
                out[r] = ids
        return out

    def encode_long(self, word: bytes) -> np.ndarray:
        """Ids of one word of any length."""
        n = len(word)
        sym = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        nxt, prv, none = list(range(1, n + 1)), list(range(-1, n - 1)), 1 << 80
        width = 1 << max(1, (n - 1).bit_length())
        rank_of = self.rank_of

        def key(i: int) -> int:
            j = nxt[i]
            r = rank_of.get(sym[i] << 32 | sym[j]) if j < n else None
            return none if r is None else r << 40 | i

        tree = [none] * (2 * width)
        tree[width : width + n] = [key(i) for i in range(n)]
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] < none:
            r, i = tree[1] >> 40, tree[1] & ((1 << 40) - 1)
            j = nxt[i]
            sym[i], sym[j], nxt[i] = self.made_of[r], -1, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            for at in (i, prv[i], j):
                if at < 0:
                    continue
                node = at + width
                tree[node] = none if at == j else key(at)
                while node > 1:
                    node >>= 1
                    tree[node] = min(tree[2 * node], tree[2 * node + 1])
        return np.array([s for s in sym if s >= 0], np.uint32)

    def learn(self, units: set[str]) -> None:
        """Encode units that the bounded cache lacks."""
        pieces = {u: self.pieces.findall(u) for u in units}
        words = list({p for ps in pieces.values() for p in ps} - self.known.keys())
        raw = [w.encode() for w in words]
        short = [w for w in raw if len(w) <= WIDE]
        ids = iter(self.encode_many(short))
        made = {w: (next(ids) if len(r) <= WIDE else self.encode_long(r)).tobytes() for w, r in zip(words, raw, strict=True)}
        known = self.known
        self.known.update({u: b"".join([made.get(p) or known[p] for p in ps]) for u, ps in pieces.items()})

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts: list[list[str]] = []
        for t in texts:
            if self.split and "<|" in t:
                row: list[str] = []
                at = 0
                for m in self.split.finditer(t):
                    row += [*self.units.findall(t[at : m.start()]), SPECIAL + m[0]]
                    at = m.end()
                parts.append(row + self.units.findall(t[at:]))
            else:
                parts.append(self.units.findall(t))
        new = set(chain.from_iterable(parts)) - self.known.keys()
        self.learn(new)
        get = self.known.__getitem__
        out = [b"".join(map(get, row)) for row in parts]
        if len(self.known) > CACHE:  # common units came first; the others go again
            for u in new:
                del self.known[u]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters, special tokens their text."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@cache
def load(path: str) -> Bpe:
    return Bpe(path)


def encode_decode(docs: DataFrame, vocabulary: str, rows_at_once: int = 1000) -> DataFrame:
    """Ids of every whole text and the text decoded from them: (doc_id, ids, decoded).

    ``ids`` holds little-endian unsigned 32-bit integers.  Other columns of
    ``docs`` are not read, so their names cannot clash.  A null doc_id stays
    null; a null text counts as empty; an empty table gives no rows.  One narrow
    pass: no shuffle, a lost task is simply encoded again.
    """

    def run(batches):
        bpe = load(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                ids = bpe.encode([t or "" for t in part.column(1).to_pylist()])
                yield row_batch(doc_id=part.column(0), ids=pa.array(ids, pa.binary()), decoded=pa.array([bpe.decode(x) for x in ids], pa.string()))

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op7_bpe(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Digest columns of the encoding round trip, one row per document."""
    return encode_decode(docs, vocabulary).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
