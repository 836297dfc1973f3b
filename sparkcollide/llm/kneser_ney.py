"""Interpolated modified Kneser-Ney language model over word pairs.

Counted in Spark, stored as sorted hash arrays in the shared folder, and
memory-mapped by the workers that score:

* words: sorted word hashes with their training counts; a word's place is its id
* pairs: for each shard, sorted keys (id of the context, id of the word), counts
* stats: sorted ids with the context's total and counts of its once, twice and
  more often seen followers, and the number of distinct contexts of the word

Words seen once in training share one class in pairs, as do unseen words; a
member of that class has an equal share of its probability.  A text is its
words between a begin mark (never predicted) and one end token.

The model's probabilities of all outcomes (known words, the end, the class's
members and one unseen word) sum to one after any context.
"""

from __future__ import annotations

import os
import re
import uuid
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcollide.llm.common import row_batch
from sparkcollide.llm.words import U64, Chunk, chunks, mix, signed
from sparkcollide.session import cut_lineage, scratch_dir

BLOCK = 1_500_000
SHARD = 1_000_000  # tokens whose pairs one shard holds, about
RANGE = 500_000  # rows of a key range
END = np.int64(0x2545F4914F6CDD1D)
COUNTED = "h long, c long"
STATS = "id long, total long, n1 long, n2 long, n3 long, three long, four long, contexts long"


def local_folder(spark: SparkSession, label: str) -> str:
    """A folder below spark.checkpoint.dir as a path that workers can map into memory."""
    path = scratch_dir(spark, label)
    if re.match(r"[a-z0-9]+:", path) and not path.startswith("file:"):
        raise ValueError(f"memory mapping needs a mounted shared folder in spark.checkpoint.dir, not {path}")
    path = re.sub(r"^file:/*", "/", path)
    os.makedirs(path, exist_ok=True)
    return path


def write_arrays(folder: str, name: str, arrays: list[np.ndarray]) -> str:
    """Write columns under a new name; a repeated task leaves another file that no manifest names."""
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    for k, a in enumerate(arrays):
        a.tofile(f"{path}.{k}.tmp")
        os.replace(f"{path}.{k}.tmp", f"{path}.{k}")
    return path


@cache
def mapped(path: str, kinds: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    return tuple(np.memmap(f"{path}.{k}", kind, "r") for k, kind in enumerate(kinds))


@dataclass
class Table:
    """Sorted key ranges on disk: first key, rows before and path of each range."""

    first: np.ndarray
    before: np.ndarray
    weight: np.ndarray
    paths: list[str]
    kinds: tuple[str, ...]

    def find(self, keys: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """(found, place, columns, weight before the range) of sorted distinct keys."""
        found, place = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        cols, weight = [np.zeros(len(keys), np.int64) for _ in range(columns)], np.zeros(len(keys), np.int64)
        cut = np.searchsorted(keys, self.first[1:]).tolist() if len(self.paths) > 1 else []
        for k, (lo, hi) in enumerate(zip([0, *cut], [*cut, len(keys)], strict=True)):
            if k >= len(self.paths) or lo == hi:
                continue
            held = mapped(self.paths[k], self.kinds)
            at = np.minimum(np.searchsorted(held[0], keys[lo:hi]), len(held[0]) - 1)
            found[lo:hi] = held[0][at] == keys[lo:hi]
            place[lo:hi], weight[lo:hi] = self.before[k] + at, self.weight[k]
            for c in range(columns):
                cols[c][lo:hi] = held[c + 1][at]
        return found, place, cols, weight


def write_table(df: DataFrame, key: str, columns: list[str], weigh: str | None, folder: str, name: str) -> Table:
    """Write a DataFrame as key ranges; only one line for each range reaches the driver."""

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        arrays = [np.concatenate([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for b in parts]) for k in range(1 + len(columns))]
        weights = arrays[1 + columns.index(weigh)] if weigh else np.zeros(1, np.int64)
        if weigh:
            arrays.append(np.cumsum(weights) - weights)
        path = write_arrays(folder, name, arrays)
        yield row_batch(first=[int(arrays[0][0])], n=[len(arrays[0])], weight=[int(weights.sum())], path=[path])

    n = df.count()
    parts = max(1, -(-n // RANGE))
    sorted_ = df.select(key, *columns).repartitionByRange(parts, key).sortWithinPartitions(key)
    rows = sorted(sorted_.mapInArrow(run, "first long, n long, weight long, path string").collect())
    num = lambda k: np.array([r[k] for r in rows], np.int64)
    before = lambda x: np.cumsum(x) - x
    return Table(num(0), before(num(1)), before(num(2)), [r[3] for r in rows], ("<i8",) * (1 + len(columns) + bool(weigh)))


def _tokens(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a chunk, each text's end included, and the first token of each text."""
    h = signed(c.word_hash())
    size = np.diff(c.first)
    first = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(first[-1], END)
    out[np.arange(len(h)) + c.row_of_word()] = h
    return out, first


def _blocks(batches, column: int, summarise):
    """Give ``summarise`` about BLOCK tokens at a time."""
    held, n = [], 0
    for batch in batches:
        for c in chunks(batch.column(column), lower=True):
            held.append(_tokens(c))
            n += len(held[-1][0])
            if n >= BLOCK:
                yield summarise(held)
                held, n = [], 0
    if held:
        yield summarise(held)


@dataclass
class Model:
    words: Table
    stats: Table | None
    shards: dict[int, str]
    tokens: int
    types: int
    singles: int
    pair_discounts: tuple[float, ...]
    word_discounts: tuple[float, ...]
    contexts: int
    outcomes: int
    word_kinds: tuple[int, int, int]

    @property
    def begin(self) -> int:
        return self.types

    @property
    def rare(self) -> int:
        return self.types + 1

    def ids(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id, count, tokens before it in id order); words seen at most once have the class's id."""
        distinct, back = np.unique(tokens, return_inverse=True)
        found, place, cols, weight = self.words.find(distinct, 2)
        count = np.where(found, cols[0], 0)
        own = count > 1
        return np.where(own, place, self.rare)[back], count[back], np.where(own, weight + cols[1], 0)[back]

    def keys(self, tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pair key and shard of each token, its id, its count and its context."""
        ids, count, before = self.ids(tokens)
        context, at, size = np.empty_like(ids), np.empty_like(ids), np.empty_like(ids)
        context[1:], at[1:], size[1:] = ids[:-1], before[:-1], count[:-1]
        context[first[:-1]], at[first[:-1]], size[first[:-1]] = self.begin, 0, self.tokens
        rare = context == self.rare
        at[rare], size[rare] = 0, self.tokens
        # a context's pairs take as many shards as its count asks for
        part = (mix(ids.astype(U64)) % (size // SHARD + 1).astype(U64)).astype(np.int64)
        return context << 32 | ids, at // SHARD + part, ids, count, context


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more; counts too thin to tell fall back to 1/2, 1, 3/2."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.1), float(k)) for k, d in zip((1, 2, 3), raw, strict=True))


def train(texts: DataFrame) -> Model:
    """Fit the model on the column ``text`` of all rows; null counts as empty."""
    spark = texts.sparkSession
    texts = texts.select("text")
    folder = local_folder(spark, "lm")

    def unigrams(batches):
        def of(held):
            h, c = np.unique(np.concatenate([t for t, _ in held]), return_counts=True)
            return row_batch(h=h, c=c.astype(np.int64))

        yield from _blocks(batches, 0, of)

    counted = cut_lineage(texts.mapInArrow(unigrams, COUNTED).groupBy("h").agg(F.sum("c").alias("c")), "words")
    tokens, types, singles = counted.agg(F.sum("c"), F.count("*"), F.sum((F.col("c") == 1).cast("long"))).first()
    if not tokens:
        return Model(Table(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), [], ()), None, {}, 0, 0, 0, (0.5, 1.0, 1.5), (0.5, 1.0, 1.5), 0, 1, (0, 0, 0))
    words = write_table(counted, "h", ["c"], "c", folder, "words")
    model = Model(words, None, {}, tokens, types, singles, (), (), 0, 0, (0, 0, 0))

    def pairs(batches):
        def of(held):
            sizes = np.cumsum([0] + [len(t) for t, _ in held])
            first = np.concatenate([f[:-1] + a for (_, f), a in zip(held, sizes, strict=False)] + [sizes[-1:]])
            key, shard, *_ = model.keys(np.concatenate([t for t, _ in held]), first)
            key, at, n = np.unique(key, return_index=True, return_counts=True)
            shard = shard[at]
            order = np.argsort(shard, kind="stable")
            return row_batch(shard=shard[order].astype(np.int32), key=key[order], n=n[order].astype(np.int32))

        yield from _blocks(batches, 0, of)

    def store(group, table):
        """One shard: sum the counts, write the arrays, report partial statistics of its ids."""
        key, back = np.unique(table.column("key").to_numpy(), return_inverse=True)
        n = np.bincount(back, weights=table.column("n").to_numpy()).astype(np.int64)
        path = write_arrays(folder, f"pairs-{group[0].as_py()}", [key, n])
        context, word = key >> 32, key & 0xFFFFFFFF
        ids, at = np.unique(np.concatenate([context, word]), return_inverse=True)
        a, b = at[: len(key)], at[len(key) :]
        of = lambda x: np.bincount(a, weights=x, minlength=len(ids)).astype(np.int64)
        cols = {"id": ids, "total": of(n), "n1": of(n == 1), "n2": of(n == 2), "n3": of(n > 2), "three": of(n == 3), "four": of(n == 4), "contexts": np.bincount(b, minlength=len(ids)).astype(np.int64)}
        out = {k: pa.array(np.append(v, group[0].as_py() if k == "id" else 0)) for k, v in cols.items()}
        return pa.table({**out, "path": pa.array([None] * len(ids) + [path], pa.string())})

    made = texts.mapInArrow(pairs, "shard int, key long, n int").groupBy("shard").applyInArrow(store, STATS + ", path string")
    made = cut_lineage(made, "pairs")
    model.shards = {r["id"]: r["path"] for r in made.where("path is not null").select("id", "path").collect()}
    names = [c.split()[0] for c in STATS.split(", ")][1:]
    stats = cut_lineage(made.where("path is null").groupBy("id").agg(*[F.sum(c).alias(c) for c in names]), "stats")
    kinds = [F.sum((F.col("contexts") == k).cast("long")) for k in (1, 2, 3, 4)] + [F.sum((F.col("contexts") > 2).cast("long"))]
    s = stats.agg(F.sum("n1"), F.sum("n2"), F.sum("three"), F.sum("four"), *kinds, F.sum("contexts"), F.sum((F.col("contexts") > 0).cast("long"))).first()
    model.pair_discounts, model.word_discounts = discounts(*s[:4]), discounts(*s[4:8])
    model.word_kinds, model.contexts, model.outcomes = (s[4], s[5], s[8]), s[9], s[10] + (0 if singles else 1)
    model.stats = write_table(stats, "id", ["total", "n1", "n2", "n3", "contexts"], None, folder, "stats")
    return model


def _pairs_of(model: Model, key: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Counts of distinct pairs."""
    count = np.zeros(len(key), np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for rows in np.split(order, cuts) if len(order) else []:
        path = model.shards.get(int(shard[rows[0]]))
        if path is None:
            continue
        keys, n = mapped(path, ("<i8", "<i8"))
        at = np.minimum(np.searchsorted(keys, key[rows]), len(keys) - 1)
        count[rows] = np.where(keys[at] == key[rows], n[at], 0)
    return count


def log_probabilities(model: Model, tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each token, and its training count."""
    if not model.tokens:
        return np.zeros(len(tokens)), np.zeros(len(tokens), np.int64)
    key, shard, ids, count, context = model.keys(tokens, first)
    distinct, at, back = np.unique(key, return_index=True, return_inverse=True)
    n = _pairs_of(model, distinct, shard[at])
    word, ctx = ids[at], context[at]
    nodes, where = np.unique(np.concatenate([word, ctx]), return_inverse=True)
    found, _, cols, _ = model.stats.find(nodes, 5)
    total, n1, n2, n3, contexts = (np.where(found, c, 0)[where] for c in cols)
    w, c = slice(0, len(word)), slice(len(word), None)
    cut = np.array([0.0, *model.word_discounts])
    kinds = np.array(model.word_kinds)
    spare = float((kinds * cut[1:]).sum())
    low = (np.maximum(contexts[w] - cut[np.minimum(contexts[w], 3)], 0) + spare / model.outcomes) / model.contexts
    cut = np.array([0.0, *model.pair_discounts])
    mass = n1[c] * cut[1] + n2[c] * cut[2] + n3[c] * cut[3]
    size = total[c]
    high = np.where(size > 0, (np.maximum(n - cut[np.minimum(n, 3)], 0) + mass * low) / np.maximum(size, 1), low)
    high = np.where(word == model.rare, high / (model.singles + 1), high)
    return np.log10(high)[back], count


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every whole text; null text is empty.

    ``base_score`` is that of single tokens with half a count added to each type
    and one unseen type; with no training tokens both scores are 0.
    """

    def run(batches):
        for batch in batches:
            for c in chunks(batch.column(1), lower=True):
                tokens, first = _tokens(c)
                p, count = log_probabilities(model, tokens, first)
                base = np.log10((count + 0.5) / (model.tokens + 0.5 * (model.types + 1)))
                each = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731  every text has its end token
                yield row_batch(doc_id=batch.column(0).slice(c.lo, c.hi - c.lo), n_tokens=np.diff(first), n_known=each((count > 0).astype(np.int64)), base_score=each(base), score=each(p))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def held_out(doc_id) -> Column:
    """A null doc_id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def op9_language_model(docs: DataFrame) -> DataFrame:
    """Train on the documents that are not held out, score all of them."""
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
