"""Best-fit packing of tokenized documents into sequences by sums of squares.

Open sequences are counted per gap (free tokens).  A piece goes where the sum
of the squared counts becomes smallest: a gap that is common is used up, a gap
that is rare is not made.  Full sequences and the unopened one count nothing.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcollide.llm.common import held, row_batch
from sparkcollide.session import cut_lineage

LENGTH = 4096
CACHE = 500_000
#: Pieces that one task packs together: large enough that its last, part-filled sequences are few.
GROUP = 20_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


#: Latin-1 letters, then signs without the apostrophe (contractions) and angle brackets (special tokens).
SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([-!\"#$%&()*+,./:;=?@|]*)")


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok, {}


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Ids of whole texts, little-endian.

    The vocabulary drops white space and no token spans it, so a text's ids are
    those of its blank-separated words in turn; each new word is encoded once
    by the tokenizer and kept in a bounded cache.
    """
    tok, known = held(_tokenizer, path)
    seen: set[bytes] = set()
    for t in texts:  # each text is split again below, as all words at once would be most of a worker's memory
        seen.update(t.encode().split())  # the ASCII blanks
    new = list(seen - known.keys())
    del seen
    # letters and the signs after them are tokens of their own, and case does not count: most new words are known parts
    parts = [(m[1].lower(), m[2]) if (m := SIMPLE.fullmatch(w)) else (w,) for w in (w.decode() for w in new)]
    ask = list({p.encode() for ps in parts for p in ps} - known.keys())
    for at in range(0, len(ask), 2000):  # an encoding takes many times the memory of its ids
        some = ask[at : at + 2000]
        for w, e in zip(some, tok.encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, "<u4").tobytes()
    for w, ps in zip(new, parts, strict=True):
        if w not in known:
            known[w] = b"".join([known[p.encode()] for p in ps])
    get = known.__getitem__
    out = [b"".join(map(get, t.encode().split())) for t in texts]
    if len(known) > CACHE:  # common words came first; the others go again
        for w in {*new, *ask}:
            del known[w]
    return out


def pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``length`` ids; only longer documents are cut. Each document ends with ``end_id``.

    Null text: empty, hence one piece that holds the end id alone.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                row, piece, start, size, crc, body = [], [], [], [], [], []
                for r, ids in enumerate(encode_texts([t or "" for t in part.column(1).to_pylist()], vocabulary)):
                    ids += np.uint32(end_id).tobytes()
                    for k, b in enumerate(range(0, len(ids), 4 * length)):
                        one = ids[b : b + 4 * length]
                        row.append(r), piece.append(k), start.append(b // 4), size.append(len(one) // 4), crc.append(zlib.crc32(one)), body.append(one if with_ids else None)
                yield row_batch(
                    doc_id=part.column(0).take(pa.array(row, pa.int64())), piece=pa.array(piece, pa.int32()), start=pa.array(start, pa.int64()), length=pa.array(size, pa.int64()),
                    ids_crc32=pa.array(crc, pa.int64()), ids=pa.array(body, pa.binary()),
                )

    out = docs.select("doc_id", "text").mapInArrow(run, PIECE)
    return out if with_ids else out.drop("ids")


def sum_of_squares(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, in the given order.

    Moving a sequence from gap g to g - s changes the sum by
    2 (N[g - s] - N[g]) + 2; opening one changes it by 2 N[length - s] + 1;
    filling one up (g = s) by -2 N[s] + 1.  Ties: the smallest gap left.
    """
    count = np.zeros(length + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(length + 1)]
    used: list[int] = []
    seq, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    never = np.iinfo(np.int64).max
    for k, s in enumerate(sizes.tolist()):
        if s == length:
            seq[k], offset[k] = len(used), 0
            used.append(s)
            continue
        old = count[s:length]  # gaps s .. length - 1
        change = np.where(old > 0, 2 * (count[: length - s] - old) + 2, never)
        if old[0]:
            change[0] = 1 - 2 * old[0]
        best = int(change.argmin())
        if change[best] <= 2 * count[length - s] + 1:
            gap = best + s
            b = open_at[gap].pop()
            count[gap] -= 1
        else:
            gap, b = length, len(used)
            used.append(0)
        seq[k], offset[k] = b, length - gap
        left = gap - s
        used[b] = length - left
        if left:
            open_at[left].append(b)
            count[left] += 1
    return seq, offset


def pack(found: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces.

    Pieces are dealt by hash into groups of about ``group``; a group is packed in
    one task, longest pieces first (ties by doc_id and piece), which is bounded
    work whatever the key distribution.  Groups grow in number with the data.
    Full pieces take part like any other.  Sequence numbers are unique, not dense.
    """
    n = found.count()
    groups = max(1, -(-n // group))
    cols = [c for c in found.columns]

    def run(key, table):
        size, piece = table.column("length").to_numpy(), table.column("piece").to_numpy()
        doc = table.column("doc_id").fill_null(-(2**63)).to_numpy()
        order = np.lexsort((table.column("start").to_numpy(), piece, doc, -size))
        seq, offset = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        seq[order], offset[order] = sum_of_squares(size[order], length)
        return pa.table([*(table.column(c) for c in cols), pa.array(seq + (key[0].as_py() << 32)), pa.array(offset)], names=[*cols, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id long, offset long"
    keyed = found.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("long"))
    return keyed.groupBy("_group").applyInArrow(run, schema)


def op3_best_fit(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per piece with its place; tokenized once, the pieces' lengths written before packing."""
    return pack(cut_lineage(pieces(docs, vocabulary), "pieces"))
