"""Long repeated word spans by compaction of a sparse De Bruijn graph.

Nodes are anchors: of every window of ``WINDOW`` words, the word k-mer with the
smallest hash.  An edge is a path: the maximal run of windows with the same
anchor occurrence.  Where all occurrences of a repeated anchor lie on one path,
the path does not branch and stands for all its windows (compaction).  Where an
anchor lies on several paths, one occurrence of each is opened into single
windows, which are counted by their full hash.  Source coordinates then turn
repeated paths and windows into spans of their documents.  Equal windows have
equal anchors, so nothing is missed; window and path hashes have 128 bits.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcollide.llm.common import carried, release, row_batch, take
from sparkcollide.llm.words import U64, chunks, mix, signed, span_hash
from sparkcollide.session import cut_lineage

WINDOW = 35
KMER = 8
PATH = "doc_id long, th long, start int, windows int, anchor long, p1 long, p2 long"
SECOND = U64(0x5851F42D4C957F2D)


def _anchors(h: np.ndarray, first: np.ndarray, window: int, kmer: int):
    """Paths of a chunk: row, first window, number of windows, anchor hash."""
    size = np.diff(first)
    rows = np.flatnonzero(size >= window)
    if not len(rows):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),)
    i = np.arange(len(h) - kmer + 1)
    gram = span_hash(h, i, i + kmer, 1)
    bits = U64(len(gram)).item().bit_length()
    low = U64((1 << bits) - 1)
    best, width, span = gram & ~low | i.astype(U64), 1, window - kmer + 1
    while 2 * width <= span:
        best, width = np.minimum(best[:-width], best[width:]), 2 * width
    if width < span:
        best = np.minimum(best[: len(best) - (span - width)], best[span - width :])
    n = size[rows] - window + 1
    win = np.repeat(first[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    row = np.repeat(rows, n)
    at = (best[win] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])]))
    return row[new], win[new], np.diff(np.concatenate([new, [len(win)]])), gram[at[new]]


def _paths(window: int, kmer: int):
    def run(batches):
        release()
        for batch in batches:
            for c in chunks(batch.column(1)):
                h = c.word_hash()
                row, win, n, anchor = _anchors(h, c.first, window, kmer)
                if not len(row):
                    continue
                end = win + n - 1 + window
                p1, p2 = span_hash(h, win, end, 0), span_hash(mix(h ^ SECOND), win, end, 2)
                yield row_batch(
                    doc_id=take(batch.column(0), c.lo + row), th=take(batch.column(2), c.lo + row), start=(win - c.first[row]).astype(np.int32), windows=n.astype(np.int32),
                    anchor=signed(anchor), p1=signed(p1), p2=signed(p2),
                )

    return run


def _anchor_counts(window: int, kmer: int):
    def run(batches):
        release()
        for batch in batches:
            for c in chunks(batch.column(0)):
                anchor, n = np.unique(_anchors(c.word_hash(), c.first, window, kmer)[3], return_counts=True)
                if len(anchor):
                    yield row_batch(anchor=signed(anchor), n=n)

    return run


def _windows(window: int):
    """Full hashes of the asked windows: (doc_id, text, th, asked[(start, windows, n)])."""

    def run(batches):
        for batch in batches:
            asked, doc, th = batch.column(3), batch.column(0), batch.column(2)
            for c in chunks(batch.column(1)):
                part = asked.slice(c.lo, c.hi - c.lo)
                flat = part.flatten()
                if not len(flat):
                    continue
                start, n, seen = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
                row = np.repeat(np.arange(c.hi - c.lo), np.asarray(part.value_lengths()))
                of = np.repeat(np.arange(len(n)), n)
                pos = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n) + start[of]
                h = c.word_hash()
                at = pos + c.first[row[of]]
                yield row_batch(
                    doc_id=take(doc, c.lo + row[of]), th=take(th, c.lo + row[of]), pos=pos.astype(np.int32), seen=seen[of],
                    w1=signed(span_hash(h, at, at + window, 0)), w2=signed(span_hash(mix(h ^ SECOND), at, at + window, 2)),
                )

    return run


def _cut(batches, whole: bool = False):
    """Words outside the spans: (doc_id, text, spans) to the kept text and counts; whole: texts without spans stay as they are."""
    for batch in batches:
        words_n, removed, kept = [], [], []
        for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = (t or "").encode().split()  # the ASCII blanks, as in the other steps
            words_n.append(len(words))
            if spans:
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, [s["a"] for s in spans], 1)
                np.add.at(gone, [s["b"] for s in spans], -1)
                keep = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                removed.append(len(words) - len(keep))
                words = [words[k] for k in keep]
            else:
                removed.append(0)
            kept.append(t if whole and not spans else b" ".join(words).decode())
        yield row_batch(doc_id=batch.column(0), n_words=pa.array(words_n, pa.int64()), n_removed=pa.array(removed, pa.int64()), kept=pa.array(kept, pa.string()), carry=batch.column(3))


def repeated_spans(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """Spans (doc_id, th, a, b) in words whose windows also start elsewhere; ``th`` is the text's xxhash64."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    nodes = keyed.select("text").mapInArrow(_anchor_counts(window, kmer), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    nodes = cut_lineage(nodes, "nodes")  # written, so that a hot anchor's side of the join below can be split
    occurrences = cut_lineage(keyed.mapInArrow(_paths(window, kmer), PATH).join(nodes, "anchor", "left_semi"), "paths")
    paths = occurrences.groupBy("anchor", "p1", "p2").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("doc_id", "th", "start", "windows")])
    branching = occurrences.select("anchor", "p1", "p2").distinct().groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor")
    paths = cut_lineage(paths.join(branching.withColumn("branch", F.lit(True)), "anchor", "left"), "compact")
    whole = occurrences.join(paths.where("n > 1").select("anchor", "p1", "p2"), ["anchor", "p1", "p2"], "left_semi")
    spans = whole.select("doc_id", "th", F.col("start").alias("a"), (F.col("start") + F.col("windows") + window - 1).alias("b"))
    asked = paths.where("branch").groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "windows", "n")).alias("asked")).withColumnRenamed("doc_id", "d").withColumnRenamed("th", "h")
    opened = keyed.join(asked, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h"))).select("doc_id", "text", "th", "asked")
    opened = cut_lineage(opened.mapInArrow(_windows(window), "doc_id long, th long, pos int, seen long, w1 long, w2 long"), "windows")
    again = opened.groupBy("w1", "w2").agg(F.sum("seen").alias("n")).where("n > 1").select("w1", "w2")
    single = opened.where("seen = 1").join(again, ["w1", "w2"], "left_semi")
    return spans.union(single.select("doc_id", "th", F.col("pos").alias("a"), (F.col("pos") + window).alias("b")))


def remove_repeats(docs: DataFrame, window: int = WINDOW, kmer: int = KMER, carry: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, carry): each document without its repeated spans.

    All occurrences of a repeated window go, the first included, judged on the
    input.  Null or empty text: no words, kept text empty.
    Kept words are joined by one space; with ``whole``, a text that loses nothing
    is not touched.  Repeated rows repeat
    each other's windows.  A null doc_id is an id of its own.  Columns
    named in ``carry`` come along in a struct, others are not read.  Empty table:
    no rows.
    """
    spans = repeated_spans(docs, window, kmer).groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans")).toDF("d", "h", "spans")
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), carried(carry))
    joined = keyed.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")), "left")
    kind = keyed.schema["carry"].dataType.simpleString()
    return joined.select("doc_id", "text", "spans", "carry").mapInArrow(partial(_cut, whole=whole), f"doc_id long, n_words long, n_removed long, kept string, carry {kind}")


def op6_substring(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
