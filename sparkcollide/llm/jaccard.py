"""N-gram Jaccard join by T-occurrence search.

Two sets link when they share at least T = ceil(3 (n + m) / 7) of their n and m
shingles (a similarity of 0.75).  Under any one order of all shingles, linked
sets then share one of the first n - ceil(3 n / 4) + 1: these short inverted
lists are merged, the rest are probed by binary search (DivideSkip).  The order
puts known frequent shingles last and is by hash otherwise.

1. One row per document: set size and digest; frequent shingles, at most HOT.
2. Inverted lists of the first shingles, sorted, read in one stream; of each
   list, every set meets the list's first set (frequent lists are cut into
   salted parts, whose first sets meet again).
3. T-occurrence search settles these pairs; links give groups.
4. Sets of one list that are still in different groups are compared in cells of
   bounded size, by size, place and parities of hash regions; lists of the same
   sets are one list.  First a cell names a spanning forest of the pairs that
   could link, closest pairs first, fewer than it has sets; what these join
   needs no comparison any more.  Then the cells that are left name all pairs
   that could link and were not searched yet, which makes the groups exact.  No
   list of all pairs is made and no set of partners is capped.
"""

from __future__ import annotations

import heapq
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcollide.llm.common import components, release, row_batch, take
from sparkcollide.llm.words import Chunk, chunks, signed, span_hash
from sparkcollide.session import cut_lineage

WORDS = 5
HOT = 1 << 20  # frequent shingles known to every task: 8 MB at most
SALTS = 64
BLOCK = 1 << 21
MEMBERS = 256
CELL = 1024  # sets of one list in a block; two blocks make a cell
SETS = "doc_id long, th long, n_shingles long, sid long, spread binary, token long, times long"
LISTS = "token long, salt int, sid long, n int, pos int"
MET = LISTS + ", hub long, hub_n int, hub_pos int"


def shingle_sets(c: Chunk, words: int):
    """Sorted distinct shingle hashes of each row; fewer words make one shingle."""
    h, size = c.word_hash(), np.diff(c.first)
    i = np.arange(max(0, len(h) - words + 1))
    gram = span_hash(h, i, i + words, 1)
    whole = span_hash(h, c.first[:-1], c.first[1:], 1)
    for r in range(len(size)):
        if size[r] >= words:
            yield np.unique(gram[c.first[r] : c.first[r + 1] - words + 1])
        else:
            yield whole[r : r + 1] if size[r] else whole[:0]


def _digest(sets: list[np.ndarray]) -> np.ndarray:
    flat = np.concatenate(sets)
    ends = np.cumsum([len(s) for s in sets])
    return span_hash(flat, ends - [len(s) for s in sets], ends, 2)


def _spread(s: np.ndarray) -> bytes:
    """Parity of a set's shingles in each region of the hash range; twice as many regions for a set up to twice as large.

    Sets whose sizes allow a link differ at most by a factor of two here: the
    wider one is folded, as regions are the lowest bits of a hash.
    """
    n = max(len(s), 1)
    regions = max(64, 1 << (4 * n - 1).bit_length()) if n <= 512 else max(2048, 1 << (n - 1).bit_length())
    odd = np.bincount((s & np.uint64(regions - 1)).astype(np.int64), minlength=regions) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _describe(words: int):
    """Set size and digest of each document, and shingles seen twice or more in a block of them."""

    def often(held):
        token, times = np.unique(np.concatenate(held), return_counts=True)
        keep = times > 1
        none = pa.nulls(int(keep.sum()), pa.int64())
        return row_batch(doc_id=none, th=none, n_shingles=none, sid=none, spread=pa.nulls(int(keep.sum()), pa.binary()), token=signed(token[keep]), times=times[keep].astype(np.int64))

    def run(batches):
        release()
        held, n = [], 0
        for batch in batches:
            for c in chunks(batch.column(1), lower=True):
                sets = list(shingle_sets(c, words))
                none = pa.nulls(len(sets), pa.int64())
                yield row_batch(
                    doc_id=batch.column(0).slice(c.lo, len(sets)), th=batch.column(2).slice(c.lo, len(sets)), n_shingles=pa.array([len(s) for s in sets], pa.int64()),
                    sid=signed(_digest(sets)), spread=pa.array([_spread(x) for x in sets], pa.binary()), token=none, times=none,
                )
                held += sets
                n += sum(map(len, sets))
                if n >= BLOCK:
                    yield often(held)
                    held, n = [], 0
        if held:
            yield often(held)

    return run


def _lists(words: int, hot):
    """The first n - ceil(3 n / 4) + 1 shingles of each set with their places."""

    def run(batches):
        release()
        known = hot.value
        for batch in batches:
            for c in chunks(batch.column(0), lower=True):
                sets = list(shingle_sets(c, words))
                ids = signed(_digest(sets))
                token, salt, at, pos = [], [], [], []
                for r, s in enumerate(sets):
                    n = len(s)
                    if not n:
                        continue
                    often = np.zeros(n, bool)
                    if len(known):
                        k = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        often = known[k] == s
                    p = n - -(-3 * n // 4) + 1
                    rare = s[~often][:p]
                    rest = s[often][: p - len(rare)]
                    token += [rare, rest]
                    salt += [np.full(len(rare), -1), np.full(len(rest), int(ids[r]) % SALTS)]
                    at.append(np.full(p, r))
                    pos.append(np.arange(p))
                if not token:
                    continue
                at = np.concatenate(at)
                n = np.array([len(s) for s in sets])
                yield row_batch(token=signed(np.concatenate(token)), salt=np.concatenate(salt).astype(np.int32), sid=ids[at], n=n[at].astype(np.int32), pos=np.concatenate(pos).astype(np.int32))

    return run


def _meet(batches):
    """Rows sorted by (token, salt, sid): each distinct set of a list beside the list's first set.

    Lists of one set go, unless they are part of a frequent list.  Only the
    first and the last row of the open list are kept between batches.
    """
    release()
    hub = last = None
    shown = True
    for batch in batches:
        table = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(5)], 1)
        if last is not None:
            table = np.concatenate([last[None], table])
        new = np.ones(len(table), bool)
        new[1:] = (table[1:, :3] != table[:-1, :3]).any(1)
        if last is not None:
            new[0] = False
        end = table[-1]
        table = table[new]
        if len(table):
            prev = np.concatenate([(hub if hub is not None else table[0] - 1)[None], table[:-1]])
            opens = (table[:, :2] != prev[:, :2]).any(1)
            if hub is not None and not opens[0] and not shown:
                table, opens = np.concatenate([hub[None], table]), np.concatenate([[True], opens])
            at = np.maximum.accumulate(np.where(opens, np.arange(len(table)), -1))
            hubs = table[np.maximum(at, 0)].copy()
            if hub is not None:
                hubs[at < 0] = hub
            run = np.cumsum(opens)
            size = np.bincount(run)[run]
            emit = (size > 1) | (run == 0) | (table[:, 1] >= 0)
            hub, shown = hubs[-1], bool(emit[-1])
            out = np.concatenate([table, hubs[:, 2:]], 1)[emit]
            if len(out):
                kinds = (np.int64, np.int32, np.int64, np.int32, np.int32, np.int64, np.int32, np.int32)
                yield row_batch(**{name.split()[0]: out[:, k].astype(kinds[k]) for k, name in enumerate(MET.split(", "))})
        last = end


def possible(n, m, p, q):
    """Whether sets of n and m shingles that share the ones at places p and q can reach T."""
    low = F.least(n, m)
    return (4 * low >= 3 * F.greatest(n, m)) & (7 * (F.least(p, q) + 1 + F.least(n - p, m - q) - 1) >= 3 * (n + m))


def t_occurrence(query: np.ndarray, members: list[np.ndarray]) -> np.ndarray:
    """Which member sets share ceil(3 (n + m) / 7) or more shingles with the query.

    DivideSkip: the T - 1 longest lists are left out, the others are merged by a
    heap; each member found there is looked up in the long lists by binary search.
    """
    n = len(query)
    size = np.array([len(m) for m in members])
    need = -(-3 * (n + size) // 7)
    flat = np.concatenate(members)
    owner = np.repeat(np.arange(len(members)), size)
    order = np.argsort(flat, kind="stable")  # members ascend within a shingle
    flat, owner = flat[order], owner[order]
    a, b = np.searchsorted(flat, query), np.searchsorted(flat, query, "right")
    by_length = np.argsort(b - a, kind="stable")
    short, long = np.split(by_length, [n - min(n, max(0, int(need.min()) - 1))])
    count = np.zeros(len(members), np.int64)
    for member, hits in groupby(heapq.merge(*[owner[a[k] : b[k]].tolist() for k in short if b[k] > a[k]])):
        count[member] = sum(1 for _ in hits)
    found = np.flatnonzero(count)
    todo = found
    for left, k in zip(range(len(long), 0, -1), long, strict=True):
        if not len(todo):
            break
        if left % 32 == 0:
            todo = todo[count[todo] + left >= need[todo]]
        held = owner[a[k] : b[k]]
        if len(held) and len(todo):
            at = np.minimum(np.searchsorted(held, todo), len(held) - 1)
            count[todo] += held[at] == todo
    return count >= need


def _search(words: int):
    """Pairs sorted by their first set: (a, a_text, b, b_text) to the links (a, b)."""

    def of(text: str) -> np.ndarray:
        return next(s for c in chunks(pa.array([text]), lower=True) for s in shingle_sets(c, words))

    def run(batches):
        release()
        hub, query = None, None
        for batch in batches:
            firsts, texts = batch.column(0).to_numpy(), batch.column(1)
            cuts = np.flatnonzero(np.concatenate([[True], firsts[1:] != firsts[:-1]])).tolist() + [len(firsts)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if firsts[lo] != hub:
                    hub, query = firsts[lo], of(texts[lo].as_py())
                for at in range(lo, hi, MEMBERS):
                    part = batch.slice(at, min(MEMBERS, hi - at))
                    members = [s for c in chunks(part.column(3), lower=True) for s in shingle_sets(c, words)]
                    ok = t_occurrence(query, members)
                    if ok.any():
                        yield row_batch(a=part.column(0).to_numpy()[ok], b=part.column(2).to_numpy()[ok])

    return run


def _ragged(column: pa.Array):
    """Binary values as one array of 64-bit words, with the first word and the number of words of each."""
    held = column.to_pylist()
    width = np.array([len(v) // 8 for v in held], np.int64)
    return np.frombuffer(b"".join(held), "<u8"), np.cumsum(width) - width, width


def _distance(flat, start, width, p, q):
    """In how many regions the parities of rows p and q differ: no more than shingles are in one of the sets only."""
    out = np.zeros(len(p), np.int64)
    narrow = np.minimum(width[p], width[q])
    for w in np.unique(narrow):
        m = np.zeros((len(start), w), np.uint64)
        for times in (1, 2):
            rows = np.flatnonzero(width == times * w)
            at = start[rows][:, None] + np.arange(w)
            m[rows] = flat[at] if times == 1 else flat[at] ^ flat[at + w]
        step = max(1, (1 << 18) // int(w))
        pairs = np.flatnonzero(narrow == w)
        for k in range(0, len(pairs), step):
            some = pairs[k : k + step]
            out[some] = np.bitwise_count(m[p[some]] ^ m[q[some]]).sum(1, dtype=np.int64)
    return out


def _may_link(batches):
    """Drop pairs that cannot link: links have at most (n + m) / 7 shingles in one of the sets only."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            n, m = (part.column(k).to_numpy().astype(np.int64) for k in (4, 5))
            fit = np.flatnonzero(4 * np.minimum(n, m) >= 3 * np.maximum(n, m))
            flat, start, width = _ragged(pa.concat_arrays([part.column(2), part.column(3)]))
            keep = fit[7 * _distance(flat, start, width, fit, fit + len(n)) <= (n + m)[fit]]
            yield row_batch(a=part.column(0).to_numpy()[keep], b=part.column(1).to_numpy()[keep])


def _cell_pairs(n, pos, group, parity, block, i, j):
    """Row numbers of a cell's pairs that could link, and how far apart they are: blocks i and j of one list, or one block with itself."""
    one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
    for lo in range(0, len(one), 256):
        x = one[lo : lo + 256]
        a, b = (v.ravel() for v in np.meshgrid(x, two, indexing="ij"))
        keep = group[a] != group[b]
        if i == j:
            keep &= a < b
        a, b = a[keep], b[keep]
        keep = (4 * np.minimum(n[a], n[b]) >= 3 * np.maximum(n[a], n[b])) & (7 * (np.minimum(pos[a], pos[b]) + np.minimum(n[a] - pos[a], n[b] - pos[b])) >= 3 * (n[a] + n[b]))
        a, b = a[keep], b[keep]
        if len(a):
            far = 7 * _distance(*parity, a, b) / (n[a] + n[b])
            fine = far <= 1
            yield a[fine], b[fine], far[fine]


def _spanning(a, b, far, group):
    """Which pairs make a spanning forest of all of them, closest pairs first; rows of a group count as one."""
    label = np.unique(group, return_inverse=True)[1]
    kept, left = [], np.argsort(far, kind="stable")
    while True:
        left = left[label[a[left]] != label[b[left]]]
        if not len(left):
            return np.concatenate(kept) if kept else left
        x, y, place = label[a[left]], label[b[left]], np.arange(len(left))
        nearest = np.full(label.max() + 1, len(left))
        np.minimum.at(nearest, x, place)
        np.minimum.at(nearest, y, place)
        pick = np.unique(nearest[nearest < len(left)])
        kept.append(left[pick])
        root = np.arange(len(nearest))
        while True:
            new = root.copy()
            np.minimum.at(new, x[pick], root[y[pick]])
            np.minimum.at(new, y[pick], root[x[pick]])
            new = new[new]
            if np.array_equal(new, root):
                break
            root = new
        label = root[label]


def _cross(forest: bool):
    """Rows sorted by (token, i, j): the pairs of each cell that could link, or a spanning forest of them. One open cell is kept between batches."""

    def cells(table):
        token, i, j = (table.column(k).to_numpy() for k in range(3))
        cut = np.flatnonzero((token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        return [0, *cut.tolist(), len(token)]

    def work(table, cuts):
        i, j, block, sid, n, pos, group = (table.column(k).to_numpy() for k in range(1, 8))
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        flat, start, width = _ragged(table.column(8))
        found = []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi - lo > 1:
                c = slice(lo, hi)
                held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
                for more in _cell_pairs(n[c], pos[c], group[c], (flat, start[c], width[c]), block[c], i[lo], j[lo]):
                    if forest:
                        held = [np.concatenate(v) for v in zip(held, more, strict=True)]
                        if len(held[0]) > 1:
                            best = _spanning(*held, group[c])
                            held = [v[best] for v in held]
                    elif len(more[0]):
                        found.append(np.stack([sid[lo + more[0]], sid[lo + more[1]]], 1))
                if len(held[0]):
                    found.append(np.stack([sid[lo + held[0]], sid[lo + held[1]]], 1))
        if found:
            pairs = np.concatenate(found)
            pairs = np.unique(np.sort(pairs, 1), axis=0)
            yield row_batch(a=pairs[:, 0], b=pairs[:, 1])

    def run(batches):
        release()
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            table = table.combine_chunks()
            cuts = cells(table)
            if len(cuts) > 2:
                yield from work(table, cuts[:-1])
            rest = table.slice(cuts[-2])
        if rest is not None and rest.num_rows:
            table = rest.combine_chunks()
            yield from work(table, [0, table.num_rows])

    return run


def may_link(pairs: DataFrame, source: DataFrame) -> DataFrame:
    """Without the pairs (a, b) that sizes and parities rule out before any text is moved."""
    of = lambda side: source.select(F.col("sid").alias(side), F.col("spread").alias(f"{side}_spread"), F.col("n_shingles").alias(f"{side}_n"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_spread", "b_spread", "a_n", "b_n").mapInArrow(_may_link, "a long, b long")


def links(pairs: DataFrame, source: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Those pairs (a, b) of set digests that link. ``source``: one document of each set; texts: (doc_id, th, text)."""
    one = source.select(F.col("sid").alias("a"), F.col("doc_id").alias("a_doc"), F.col("th").alias("a_th"))
    two = source.select(F.col("sid").alias("b"), F.col("doc_id").alias("b_doc"), F.col("th").alias("b_th"))
    pairs = cut_lineage(pairs.join(one, "a").join(two, "b"), "candidates")
    same = lambda side: texts["doc_id"].eqNullSafe(F.col(f"{side}_doc")) & (texts["th"] == F.col(f"{side}_th"))
    with_b = pairs.join(texts, same("b")).select("a", "a_doc", "a_th", "b", F.col("text").alias("b_text"))
    both = with_b.join(texts, same("a")).select("a", F.col("text").alias("a_text"), "b", "b_text")
    return both.sortWithinPartitions("a").mapInArrow(_search(words), "a long, b long")


def link_groups(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, th, n_shingles, component_id): smallest doc_id reachable by links.

    No words or null text: an empty set, linked with nothing, its own component.
    Equal sets link, so repeated rows and copies share a component.  A row with
    a null doc_id links like others; its component is the smallest non-null id,
    null if there is none.  Other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text")).select("doc_id", "text", "th")
    seen = cut_lineage(texts.mapInArrow(_describe(words), SETS), "sets")
    frequent = seen.where("token is not null").groupBy("token").agg(F.sum("times").alias("times")).where("times > 8").orderBy(F.desc("times"), "token").limit(HOT)
    known = np.sort(np.array(frequent.select("token").toPandas()["token"], np.int64).view(np.uint64))
    hot = spark.sparkContext.broadcast(known)
    sets = seen.where("token is null").select("doc_id", "th", "n_shingles", "sid", "spread")
    lists = texts.select("text").mapInArrow(_lists(words, hot), LISTS)
    met = cut_lineage(lists.repartition("token", "salt").sortWithinPartitions("token", "salt", "sid").mapInArrow(_meet, MET), "met")

    source = cut_lineage(sets.where("n_shingles > 0").groupBy("sid").agg(F.first("doc_id").alias("doc_id"), F.first("th").alias("th"), F.min("doc_id").alias("low"), F.first("n_shingles").alias("n_shingles"), F.first("spread").alias("spread")), "source")
    star = met.where("sid <> hub").where(possible(F.col("n"), F.col("hub_n"), F.col("pos"), F.col("hub_pos"))).select(F.least("sid", "hub").alias("a"), F.greatest("sid", "hub").alias("b"))
    parts = met.where("salt >= 0").select("token", "hub", "hub_n", "hub_pos").distinct()
    top = parts.groupBy("token").agg(F.min("hub").alias("top"))
    star = star.union(parts.join(top, "token").where("hub <> top").select("top", "hub").toDF("a", "b"))
    near = cut_lineage(links(may_link(star.distinct(), source), source, texts, words), "near")
    group = components(near)

    # what is left: sets of one list in different groups; lists of the same sets are one
    named = met.join(group.withColumnRenamed("node", "sid"), "sid", "left").select("token", "sid", "n", "pos", F.coalesce("label", "sid").alias("g"))
    split = named.groupBy("token").agg(F.min("g").alias("x"), F.max("g").alias("y"), F.count("*").alias("k"), F.bit_xor("sid").alias("u"), F.bit_xor(F.xxhash64("sid")).alias("v")).where("x <> y")
    split = split.groupBy("k", "u", "v").agg(F.min("token").alias("token")).select("token", F.ceil(F.col("k") / CELL).cast("int").alias("blocks"))
    named = cut_lineage(named.join(split, "token").select("token", "sid", "n", "pos", "blocks", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int").alias("block")), "lists")
    asked = None
    for forest in (True, False):
        now = named.join(group.toDF("sid", "label"), "sid", "left").withColumn("g", F.coalesce("label", "sid"))
        if not forest:
            now = now.join(now.groupBy("token").agg(F.min("g").alias("x"), F.max("g").alias("y")).where("x <> y").select("token"), "token")
        cell = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")
        now = now.join(source.select("sid", "spread"), "sid").select("token", "sid", "n", "pos", "g", "block", "spread", cell)
        now = now.select("token", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "sid", "n", "pos", "g", "spread")
        rest = now.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(_cross(forest), "a long, b long").distinct()
        if forest:
            rest = asked = cut_lineage(rest, "asked")
        else:
            rest = rest.join(asked, ["a", "b"], "left_anti")
        late = cut_lineage(links(rest, source, texts, words), "late")
        late = late.join(group.toDF("a", "x"), "a", "left").join(group.toDF("b", "y"), "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
        over = components(late)
        known = group.join(over.toDF("label", "root"), "label", "left").select("node", F.coalesce("root", "label").alias("label"))
        group = cut_lineage(known.union(over.join(group.select("node"), "node", "left_anti").select("node", "label")), "group")

    final = group.withColumnRenamed("label", "root")
    rooted = cut_lineage(source.join(final, source["sid"] == final["node"], "left").select("sid", "low", F.coalesce("root", "sid").alias("root")), "rooted")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = cut_lineage(rooted.join(lowest, "root").select(F.col("sid").alias("s"), "component_id"), "named")
    return sets.join(named, (sets["sid"] == named["s"]) & (sets["n_shingles"] > 0), "left").select("doc_id", "th", "n_shingles", F.when(F.col("s").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op4_jaccard(docs: DataFrame) -> DataFrame:
    return link_groups(docs).select("doc_id", "n_shingles", "component_id")
