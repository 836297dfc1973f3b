"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words sums over common subsequences of three letters, gaps
weighing down by ``DECAY`` a letter, so "i-d.iot" or "idioott" stay close to
"idiot"; it is normalised and taken to the power ``SHARP``, and values below
``LEAST`` count as 0.  Landmarks are words of the training documents that go
with the label.  A sentence's value for a landmark is that of its closest word; the
landmarks' own kernel matrix turns that into Nyström features, on which a
linear support vector machine is trained, sentence by sentence, under their
document's label.  A document's margin is that of its worst sentence, and a
logistic curve makes it a score.

Fitting uses at most ``FIT_TOXIC`` + ``FIT_CLEAN`` labelled documents, chosen
by hash, and of each the ``FIT_SENTENCES`` sentences with the largest rows;
scoring covers every whole text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcollide.llm.common import carried, held, release, row_batch
from sparkcollide.session import cut_lineage

ORDER, DECAY, SHARP, LEAST = 3, 0.7, 3, 0.05
LANDMARKS = 96
LEAST_G = 30.0  # log-likelihood ratio of a landmark's counts in toxic and clean documents: chance words stay below
APART = 0.3  # landmarks are less alike than this
FIT_TOXIC, FIT_CLEAN, FIT_SENTENCES = 6_000, 9_000, 8
LONGEST = 24  # letters; longer words are read in overlapping parts
CACHE = 150_000
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
SPACED = re.compile(r"(?<!\S)(?:[^\W\d_][ .*_-]{1,2}){2,}[^\W\d_](?!\w)")
JUNK = re.compile(r"[\W\d_]+")


def subsequence_kernel(a: np.ndarray, b: np.ndarray, decay: float = DECAY, order: int = ORDER) -> np.ndarray:
    """Kernel of many pairs of words: rows of letter codes, 0 and -1 as fillers of the two sides."""
    a, b = a.T.copy(), b.T.copy()  # the pairs are the last axis, hence contiguous
    n, la, lb = a.shape[1], len(a), len(b)
    same = a[:, None] == b[None]
    ends = same * decay**2
    for _ in range(order - 1):
        upto = np.zeros((la + 1, lb + 1, n))
        for i in range(la):
            for j in range(lb):
                upto[i + 1, j + 1] = ends[i, j] + decay * (upto[i, j + 1] + upto[i + 1, j]) - decay**2 * upto[i, j]
        ends = same * decay**2 * upto[:-1, :-1]
    return ends.sum((0, 1))


def _codes(words: list[str], filler: int) -> np.ndarray:
    """Letter codes, one row a word, cut to the longest word."""
    wide = np.array(words, f"U{max(map(len, words))}")
    out = wide.view(np.uint32).reshape(len(words), -1).astype(np.int64)
    out[out == 0] = filler
    return out


def _letters(codes: np.ndarray, gap: int) -> np.ndarray:
    """Bits for the ordered letter pairs at most ``gap`` places apart, in two hashed masks."""
    out = np.zeros((2, len(codes)), np.uint64)
    for k in range(1, min(gap, codes.shape[1] - 1) + 1):
        a, b = codes[:, :-k], codes[:, k:]
        both = (a > 0) & (b > 0)
        for lane, h in enumerate((a * 7 + b * 31, a * 53 + b * 11)):
            out[lane] |= np.bitwise_or.reduce(np.where(both, np.uint64(1) << (h % 64).astype(np.uint64), np.uint64(0)), 1)
    return out


def _parts(word: str) -> list[str]:
    """A word's letters; longer words in overlapping parts of LONGEST letters."""
    word = word if word.isalpha() else JUNK.sub("", word)
    return [word[k : k + LONGEST] for k in range(0, max(1, len(word) - LONGEST // 2), LONGEST // 2)] if word else []


@dataclass
class Kernel:
    """Sharpened, normalised kernel values of words with fixed landmarks."""

    landmarks: list[str]
    known: dict[str, np.ndarray | None] = field(default_factory=dict)

    def __reduce__(self):
        return shared, (tuple(self.landmarks),)

    def pairs(self, words: list[str], left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Kernel of words[left] with landmarks[right], grouped by length so that little is padded."""
        out = np.zeros(len(left))
        size = np.array([len(w) for w in words])
        wide = np.array([len(m) for m in self.landmarks])
        own = np.zeros(len(words))
        for at in range(1, LONGEST + 1, 3):
            rows = np.flatnonzero((size >= at) & (size < at + 3))
            for k in range(0, len(rows), 1000):
                some = rows[k : k + 1000]
                c = _codes([words[r] for r in some], 0)
                own[some] = subsequence_kernel(c, np.where(c == 0, -1, c))
            chosen = np.flatnonzero(np.isin(left, rows))
            chosen = chosen[np.argsort(wide[right[chosen]], kind="stable")]
            for k in range(0, len(chosen), 1000):
                some = chosen[k : k + 1000]
                a, b = _codes([words[r] for r in left[some]], 0), _codes([self.landmarks[r] for r in right[some]], -1)
                out[some] = subsequence_kernel(a, b)
        c = _codes(self.landmarks, 0)
        base = subsequence_kernel(c, np.where(c == 0, -1, c))
        scale = np.sqrt(own[left] * base[right])
        value = np.where(scale > 0, out / np.where(scale > 0, scale, 1), 0) ** SHARP
        return np.where(value >= LEAST, value, 0)

    def learn(self, words: list[str]) -> None:
        """Fill the bounded cache: word to its kernel row, None where all values are 0.

        A word more than twice as long as a landmark counts with its best part
        of that length, or as a whole where that is closer.  A value is 0 by
        definition where the word has fewer than two thirds of the landmark's
        neighbouring letter pairs, up to two letters between them.
        """
        parts = {w: [p for p in _parts(w) if len(p) >= ORDER] for w in words}
        flat = sorted({p for ps in parts.values() for p in ps})
        rows: dict[str, np.ndarray] = {}
        if flat and self.landmarks:
            want, size = _letters(_codes(self.landmarks, 0), 1), np.array([len(m) for m in self.landmarks])

            def masks(some):
                return np.concatenate([_letters(_codes(some[k : k + 10_000], 0), 3) for k in range(0, len(some), 10_000)], 1)

            def fits(has, j):
                return np.logical_and.reduce([3 * np.bitwise_count(has[lane] & want[lane, j]) >= 2 * np.bitwise_count(want[lane, j]) for lane in range(2)])

            has, length = masks(flat), np.array([len(p) for p in flat])
            item = {p: k for k, p in enumerate(flat)}
            lefts, rights, owners = [], [], []
            for n in np.unique(size).tolist():
                alike = np.flatnonzero(size == n)
                fit = np.array([fits(has, j) for j in alike])
                cut = [(k, flat[k][at : at + 2 * n]) for k in np.flatnonzero(fit.any(0) & (length > 2 * n)).tolist() for at in range(0, len(flat[k]) - n, n)]
                owner, within = np.array([k for k, _ in cut], int), np.array([item.setdefault(p, len(item)) for _, p in cut], int)
                inner = masks([p for _, p in cut]) if cut else np.zeros((2, 0), np.uint64)
                for j, whole in zip(alike, fit, strict=True):
                    a, b = np.flatnonzero(whole), np.flatnonzero(whole[owner] & fits(inner, j))
                    lefts += [a, within[b]]
                    owners += [a, owner[b]]
                    rights.append(np.full(len(a) + len(b), j))
            left, right, owner = np.concatenate(lefts), np.concatenate(rights), np.concatenate(owners)
            pair, each = np.unique(left * len(size) + right, return_inverse=True)
            used, left = np.unique(pair // len(size), return_inverse=True)
            names = list(item)
            value = self.pairs([names[k] for k in used], left, pair % len(size))[each] if len(used) else np.zeros(0)
            for k in np.flatnonzero(value):
                row = rows.setdefault(flat[owner[k]], np.zeros(len(size)))
                row[right[k]] = max(row[right[k]], value[k])
        for w, ps in parts.items():
            hits = [rows[p] for p in ps if p in rows]
            self.known[w] = np.maximum.reduce(hits) if hits else None

    def sentences(self, texts: list[str]) -> list[list[np.ndarray]]:
        """Kernel rows of each text's sentences; those without any match are left out."""
        texts = [t.lower() for t in texts]
        texts = [SPACED.sub(lambda m: JUNK.sub("", m[0]), t) for t in texts]
        seen = [set(t.split()) for t in texts]
        new = sorted(set().union(*seen) - self.known.keys()) if seen else []
        self.learn(new)
        out = []
        for t, words in zip(texts, seen, strict=True):
            rows = []
            near = {w: k for w in words if (k := self.known[w]) is not None}
            if near:
                for s in SENTENCE.split(t):
                    hits = [near[w] for w in s.split() if w in near]
                    if hits:
                        rows.append(np.maximum.reduce(hits))
            out.append(rows)
        if len(self.known) > CACHE:  # common words came first; the others go again
            for w in new:
                del self.known[w]
        return out


def _kernel(landmarks: tuple[str, ...]) -> Kernel:
    return Kernel(list(landmarks))


def shared(landmarks: tuple[str, ...]) -> Kernel:
    """A worker's kernel for these landmarks; its tasks share the known words."""
    return held(_kernel, landmarks)


@dataclass
class Model:
    kernel: Kernel
    weights: np.ndarray  # on kernel rows: Nyström map and support vector machine in one
    bias: float
    slope: float
    shift: float

    def margins(self, texts: list[str]) -> np.ndarray:
        """Largest sentence margin of each text; a text without any match has that of an empty sentence."""
        return np.array([max([self.bias, *(float(r @ self.weights) + self.bias for r in rows)]) for rows in self.kernel.sentences(texts)])

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -40, 40)))


def support_vectors(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 1.0) -> tuple[np.ndarray, float]:
    """Linear support vector machine, squared hinge loss, by Newton steps on the primal; the classes weigh alike."""
    weight = weight * np.where(y > 0, 0.5 / max(weight[y > 0].sum(), 1), 0.5 / max(weight[y < 0].sum(), 1)) * len(y) * cost
    one = np.concatenate([x, np.ones((len(x), 1))], 1)
    ridge = np.diag(np.append(np.ones(x.shape[1]), 1e-6))
    w = np.zeros(one.shape[1])
    for _ in range(50):
        slack = 1 - y * (one @ w)
        in_ = slack > 0
        grad = ridge @ w - one[in_].T @ (weight[in_] * y[in_] * slack[in_])
        step = np.linalg.solve(ridge + (one[in_] * weight[in_, None]).T @ one[in_] + 1e-9 * np.eye(len(w)), grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def logistic(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighted logistic curve, by damped Newton steps."""
    x = np.stack([m, np.ones(len(m))], 1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (weight * (p - y)) + 1e-3 * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
        w = w - step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
    return float(w[0]), float(w[1])


def _spread(words: list[str], most: int) -> list[str]:
    """The first words that are not close to one taken before."""
    all_ = Kernel(words)
    all_.learn(words)
    taken: list[int] = []
    for k, w in enumerate(words):
        row = all_.known[w]
        if len(taken) < most and (row is None or not taken or row[taken].max() < APART):
            taken.append(k)
    return [words[k] for k in taken]


def _label_counts(batches):
    """Distinct words of each document, counted by label within a batch."""
    release()
    for batch in (b.slice(at, 2000) for b in batches for at in range(0, b.num_rows, 2000)):
        count: dict[str, list[int]] = {}
        for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for w in {p for w in set(SPACED.sub(lambda m: JUNK.sub("", m[0]), (t or "").lower()).split()) for p in _parts(w) if len(p) >= ORDER}:
                count.setdefault(w, [0, 0])[y] += 1
        yield row_batch(word=pa.array(list(count), pa.string()), clean=pa.array([c[0] for c in count.values()], pa.int64()), toxic=pa.array([c[1] for c in count.values()], pa.int64()))


def fit(docs: DataFrame, labels: DataFrame, landmarks: int = LANDMARKS) -> Model:
    """Train on the labelled rows: docs (doc_id, text), labels (doc_id, toxic).

    Repeated labels of one document: the larger.  Null labels are not used.
    With one class only, every text scores that class's share (0 without rows).
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = cut_lineage(known, "labels")
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        share = 1.0 if n.get(1) else 0.0
        return Model(Kernel([]), np.zeros(0), 0.0, 0.0, 40.0 * (2 * share - 1))
    chosen = known.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_TOXIC).union(known.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_CLEAN))
    # the sample is bounded by FIT_TOXIC + FIT_CLEAN ids, hence broadcast
    sample = cut_lineage(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic"), "sample")
    toxic, clean = min(n[1], FIT_TOXIC), min(n[0], FIT_CLEAN)
    counts = sample.select("text", "toxic").mapInArrow(_label_counts, "word string, clean long, toxic long")
    counts = counts.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    part = lambda k, share: F.when(k > 0, k * F.log(k / ((F.col("toxic") + F.col("clean")) * share))).otherwise(0.0)
    share = toxic / (toxic + clean)
    ratio = 2 * (part(F.col("toxic"), share) + part(F.col("clean"), 1 - share))
    best = counts.where(F.col("toxic") > 4 * share / (1 - share) * F.col("clean")).select("word", ratio.alias("g")).where(F.col("g") >= LEAST_G).orderBy(F.desc("g"), "word").limit(8 * landmarks)
    kernel = Kernel(_spread([r["word"] for r in best.collect()], landmarks))
    m = len(kernel.landmarks)
    if not m:
        share = n[1] / (n[0] + n[1])
        return Model(kernel, np.zeros(0), 0.0, 0.0, float(np.log(share / (1 - share))))
    left, right = np.divmod(np.arange(m * m), m)
    own = kernel.pairs(kernel.landmarks, left, right).reshape(m, m)
    value, vector = np.linalg.eigh((own + own.T) / 2)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T  # Nyström: features are kernel rows times this

    def features(batches):
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found, empty = [], []
            for t, rows in zip(texts, kernel.sentences(texts), strict=True):
                empty.append(max(1, len(SENTENCE.split(t)) - len(rows)))
                rows = sorted(rows, key=lambda r: -float(r @ r))[:FIT_SENTENCES]
                found.append(np.array(rows, np.float64).tobytes())
            yield row_batch(label=batch.column(2), empty=pa.array(empty, pa.int64()), rows=pa.array(found, pa.binary()))

    # at most FIT_TOXIC + FIT_CLEAN lines of FIT_SENTENCES rows
    got = sample.mapInArrow(features, "label int, empty long, rows binary").collect()
    each = [np.frombuffer(r["rows"], np.float64).reshape(-1, m) for r in got]
    y = np.array([2 * r["label"] - 1 for r in got])
    times = np.array([r["empty"] for r in got], float)
    x = np.concatenate([np.zeros((2, m)), *each]) @ root
    sign = np.concatenate([[1, -1], np.repeat(y, [len(e) for e in each])])
    weight = np.concatenate([[times[y > 0].sum(), times[y < 0].sum()], np.ones(sum(map(len, each)))])
    coef, bias = support_vectors(x, sign, weight)
    margin = np.array([max([bias, *(e @ root @ coef + bias)]) for e in each])
    slope, shift = logistic(margin, y > 0, np.where(y > 0, n[1] / toxic, n[0] / clean))
    return Model(kernel, root @ coef, bias, slope, shift)


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = (), keep_text: bool = False) -> DataFrame:
    """(doc_id, score, text, carry) of every whole text; null text is empty.

    ``text`` is null unless asked for, else the unchanged text; columns named in
    ``carry`` come along in a struct.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                text = part.column(1)
                yield row_batch(doc_id=part.column(0), score=model.scores([t or "" for t in text.to_pylist()]), text=text if keep_text else pa.nulls(len(text), text.type), carry=part.column(2))

    rows = docs.select("doc_id", "text", carried(carry))
    return rows.mapInArrow(run, f"doc_id long, score double, text string, carry {rows.schema['carry'].dataType.simpleString()}")


def held_out(doc_id: Column) -> Column:
    """A null doc_id is not held out (and has no label)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op5_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents; labels of held-out rows are never read for training."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
