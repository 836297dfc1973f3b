"""Approximate nearest neighbours by largest inner product, with balanced posting lists.

The inner product becomes a distance: vectors are scaled by the largest norm and
get one more component, so that all have norm one; for a query of norm one the
nearest is then the one with the largest product.  A bounded sample is halved
again and again, by the main direction between two centres and always into equal
parts, which gives lists of equal share.  Their centroids are the nodes of a
graph in memory: each is linked with its nearest ones and, along the tree, with
its counterpart in every sibling branch.  The graph is searched best first, many
vectors at a time.

Every vector is written to the list of its nearest centroid and, if it lies near
a boundary, to others that are at most CLOSURE times as far.  A query looks into
all lists that are at most ``ratio`` times as far as its nearest; the ratio is the
smallest that finds RECALL of the neighbours within a second sample that the
centroids were not made from.  Lists and their queries meet in cells of bounded
size, however large a list is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcollide.llm.common import row_batch
from sparkcollide.session import cut_lineage

TOP = 20
LIST = 512  # vectors of a list, before those near its boundary come in
MOST_LISTS = 8192
SAMPLE = 32  # sampled vectors a list; one half makes centroids, the other the ratio
LEAST_SAMPLE = 4096  # vectors sampled at least, so that few lists have a sure ratio too
SAMPLE_VALUES = 1 << 24  # components of the whole sample
COPIES = 4
CLOSURE = 1.1
RECALL = 0.97
NEAR = 16  # graph links to nearest centroids
BEAM = 24
BATCH = 512
TILE = 4096  # vectors and queries of a cell
SLACK = 1e-9


@dataclass
class Index:
    norm: float
    dim: int
    centroids: np.ndarray
    links: np.ndarray
    ratio: float = 1.0


def _dense(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as doubles, shorter ones continued by zeros."""
    size = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(size) and (size == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(size), dim))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _lifted(x: np.ndarray, norm: float) -> np.ndarray:
    """Scaled vectors with the component that gives them norm one."""
    y = x / norm
    return np.hstack([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(1, keepdims=True)))])


def _directed(x: np.ndarray) -> np.ndarray:
    """Queries of norm one; their last component is zero."""
    y = x / np.abs(x).max(1, keepdims=True)
    return np.hstack([y / np.sqrt((y * y).sum(1, keepdims=True)), np.zeros((len(x), 1))])


def _leaves(x: np.ndarray, depth: int, rng) -> list[np.ndarray]:
    """Row numbers of 2**depth equal parts, in tree order."""
    parts = [np.arange(len(x))]
    for _ in range(depth):
        halves = []
        for rows in parts:
            y = x[rows]
            c = y[rng.choice(len(y), 2, replace=False)]
            for _ in range(6):
                order = np.argsort(y @ (c[1] - c[0]), kind="stable")
                low, high = order[: len(y) // 2], order[len(y) // 2 :]
                c = np.stack([y[low].mean(0), y[high].mean(0)])
            halves += [rows[low], rows[high]]
        parts = halves
    return parts


def _distances(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + (c * c).sum(1) - 2 * q @ c.T))


def _graph(c: np.ndarray) -> np.ndarray:
    """Linked centroids of each: nearest ones, and the counterpart in every sibling branch of the tree."""
    m = len(c)
    near = [np.argpartition(_distances(c[k : k + BATCH], c), min(NEAR, m - 1), axis=1)[:, : NEAR + 1] for k in range(0, m, BATCH)]
    sides = [np.arange(m)[:, None] ^ (1 << k) for k in range((m - 1).bit_length())]
    return np.hstack([np.concatenate(near), *sides]).astype(np.int32)


def search(index: Index, q: np.ndarray, ratio: float, beam: int = BEAM):
    """Lists per row, nearest first: (distances, lists), all with distance <= ratio * smallest that the graph leads to; inf pads."""
    c, links, m = index.centroids, index.links, len(index.centroids)
    rows = np.arange(len(q))[:, None]
    square = (c * c).sum(1)
    seen = np.zeros((len(q), m), bool)
    entry = np.unique(np.linspace(0, m - 1, min(m, 16)).astype(np.int64))
    at = np.broadcast_to(entry, (len(q), len(entry))).copy()
    seen[:, entry] = True
    own = (q * q).sum(1)[:, None]
    dist = np.sqrt(np.maximum(0, own + square[at] - 2 * q @ c[entry].T))
    opened = np.zeros(at.shape, bool)
    while True:
        order = np.argsort(dist, axis=1, kind="stable")
        dist, at, opened = dist[rows, order], at[rows, order], opened[rows, order]
        within = dist <= np.maximum(dist[:, :1] * ratio, dist[:, min(beam, dist.shape[1]) - 1 :][:, :1])
        width = int((within & np.isfinite(dist)).sum(1).max())
        dist, at, opened, within = dist[:, :width], at[:, :width], opened[:, :width], within[:, :width]
        todo = within & ~opened & np.isfinite(dist)
        active = np.flatnonzero(todo.any(1))
        if not len(active):
            break
        rank = np.cumsum(todo[active], axis=1)
        pick = todo[active] & (rank <= 4)
        r, k = np.nonzero(pick)
        r = active[r]
        opened[r, k] = True
        node = links[at[r, k]].ravel()
        r = np.repeat(r, links.shape[1])
        fresh = np.unique((r * np.int64(m) + node)[~seen[r, node]])
        if not len(fresh):
            continue
        r, node = np.divmod(fresh, m)
        seen[r, node] = True
        d = np.sqrt(np.maximum(0, own[r, 0] + square[node] - 2 * np.einsum("ij,ij->i", q[r], c[node])))
        many = np.bincount(r, minlength=len(q))
        slot = np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many)
        more, new = np.full((len(q), many.max()), np.inf), np.zeros((len(q), many.max()), np.int64)
        more[r, slot], new[r, slot] = d, node
        dist, at = np.hstack([dist, more]), np.hstack([at, new])
        opened = np.hstack([opened, np.isinf(more)])
    return np.where(dist <= dist[:, :1] * ratio, dist, np.inf), at


def build(sample: np.ndarray, n: int, norm: float) -> Index:
    """Centroids, graph and pruning ratio from sampled vectors of a table of n."""
    x, dim = _lifted(sample, norm), sample.shape[1]
    half = len(x) // 2
    depth = max(0, min(int(np.ceil(np.log2(max(1, n) / LIST))), MOST_LISTS.bit_length() - 1, int(np.log2(max(1, 2 * half / SAMPLE)))))
    fit, held = (x[:half], x[half:]) if depth else (x, x[:0])
    c = np.stack([fit[rows].mean(0) for rows in _leaves(fit, depth, np.random.default_rng(5))])
    index = Index(norm, dim, c, _graph(c))
    if depth:
        index.ratio = _ratio(index, sample[half:], held, n)
    return index


def _ratio(index: Index, raw: np.ndarray, held: np.ndarray, n: int) -> float:
    """Smallest ratio that finds RECALL of the held sample's own neighbours, taken at the density of the whole table."""
    near = max(1, round(TOP * len(held) / n))
    asked = np.arange(0, len(held), max(1, len(held) // 2048))
    q = _directed(raw[asked])
    product = q @ held.T
    product[np.arange(len(asked)), asked] = -np.inf
    want = np.argpartition(-product, near - 1, axis=1)[:, :near]
    to = _distances(q, index.centroids)
    listed = np.full((len(held), COPIES), -1)
    for k in range(0, len(held), BATCH):
        lists = _lists(index, held[k : k + BATCH])
        listed[k : k + BATCH, : lists.shape[1]] = lists
    need = np.where(listed[want] >= 0, to[np.arange(len(asked))[:, None, None], listed[want]], np.inf).min(2) / to.min(1)[:, None]
    return float(max(1.0, np.quantile(need, RECALL)))


def _lists(index: Index, x: np.ndarray) -> np.ndarray:
    """Lists of lifted vectors: the nearest, and up to COPIES in all within CLOSURE; -1 pads."""
    dist, at = search(index, x, CLOSURE)
    return np.where(np.isfinite(dist), at, -1)[:, :COPIES]


def _packed(lists: np.ndarray) -> pa.Array:
    keep = lists >= 0
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keep.sum(1))]).astype(np.int32)), pa.array(lists[keep].astype(np.int32)))


def _routed(shared, query: bool):
    """Adds the lists of each vector (node, ids, v) or query (node, query_id, v)."""

    def run(batches):
        index = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                part = batch.slice(k, BATCH)
                x = _dense(part.column(2), index.dim)
                if query:
                    dist, at = search(index, _directed(x), index.ratio)
                    lists = np.where(np.isfinite(dist), at, -1)
                else:
                    lists = _lists(index, _lifted(x, index.norm))
                yield pa.RecordBatch.from_arrays([*part.columns, _packed(lists)], names=[*batch.schema.names, "lists"])

    return run


def _best(k: int, dim: int, kind: str):
    """One cell: the k best vectors of a list for each of its queries, as (score, node, same, ids)."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    entry = to_arrow_type(DataType.fromDDL(kind))

    def run(key, left: pa.Table, right: pa.Table):
        node, ids = left.column("node").combine_chunks(), left.column("ids").combine_chunks()
        x = _dense(left.column("v").combine_chunks(), dim)
        asked, owner = right.column("node").combine_chunks(), right.column("query_id").combine_chunks()
        q = _dense(right.column("v").combine_chunks(), dim)
        out_row, out_at, out_score = [], [], []
        for at in range(0, len(q), 256):
            part = q[at : at + 256]
            product = part @ x.T
            bar = -np.partition(-product, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1] if len(x) else np.zeros(len(part))
            slack = SLACK * np.sqrt((part * part).sum(1))
            r, c = np.nonzero(~(product < (bar - slack * np.abs(x).max(initial=0))[:, None]))
            with np.errstate(all="ignore"):
                score = (part[r] * x[c]).sum(1)  # the same sum for equal vectors, wherever they stand
            score = np.where(np.isnan(score), -np.inf, score)
            keep = _leading(r, score, k)  # ties at the end are told apart by their ids later
            out_row.append(r[keep] + at), out_at.append(c[keep]), out_score.append(score[keep])
        row, at, score = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (out_row, out_at, out_score))
        same = (x[at] == q[row]).all(1) if len(row) else np.zeros(0, bool)
        take = pa.array(at)
        parts = pa.StructArray.from_arrays([pa.array(score, pa.float64()), node.take(take), pa.array(same), ids.take(take)], fields=list(entry))
        ends = np.searchsorted(row, np.arange(len(q) + 1)).astype(np.int32)
        return pa.table({"node": asked, "query_id": owner, "best": pa.ListArray.from_arrays(pa.array(ends), parts)})

    return run


def _leading(row: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores of each row, and of those that tie with the last; sorted by row, then score."""
    order = np.lexsort((-score, row))
    row, score = row[order], score[order]
    head, end = np.searchsorted(row, row), np.searchsorted(row, row, "right")
    last = np.minimum(head + k, end) - 1
    return order[(np.arange(len(row)) - head < k) | (score == score[last])]


def _merged(top: int):
    """Per query the top rows of its cells' best: (query_id, rank, vec_id, score)."""

    def run(batches):
        for batch in batches:
            query, best = batch.column(0).to_pylist(), batch.column(1)
            flat, row = best.flatten(), np.repeat(np.arange(len(query)), np.asarray(best.value_lengths()))
            _, first = np.unique(np.stack([row, flat.field("node").to_numpy()]), axis=1, return_index=True)  # a vector may be in several lists
            at = first[_leading(row[first], flat.field("score").to_numpy()[first], top + 1)]
            found: list[list] = [[] for _ in query]
            for k, e in zip(row[at].tolist(), flat.take(pa.array(at)).to_pylist(), strict=True):
                ids = e["ids"]
                if e["same"] and query[k] in ids:  # the query's own row
                    ids.remove(query[k])
                found[k] += [(-e["score"], i is None, i or 0, i) for i in ids]
            found = [sorted(f, key=lambda t: t[:3])[:top] for f in found]
            yield row_batch(
                query_id=pa.array([q for q, f in zip(query, found, strict=True) for _ in f], pa.int64()), rank=pa.array([k + 1 for f in found for k in range(len(f))], pa.int32()),
                vec_id=pa.array([t[3] for f in found for t in f], pa.int64()), score=pa.array([-t[0] for f in found for t in f], pa.float64()),
            )

    return run


def nearest(vectors: DataFrame, asks: Column, top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which ``asks`` holds, its ``top`` nearest other rows found.

    Nearness is the largest inner product in double precision, ties go to the
    smaller vec_id, nulls last; a row is never its own neighbour.  Vectors that
    are null, empty, zero or hold null or non-finite components take no part;
    shorter vectors count as continued by zeros.  Repeated rows are rows of their
    own, as candidates and as queries.  Labels and other columns are not read.  An
    empty table gives no rows.

    Equal vectors are one entry of the lists with the top + 1 smallest ids.  The
    index is made on the driver from a sample of at most SAMPLE_VALUES components
    and broadcast: at most MOST_LISTS centroids.  All rows are in lists.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), F.coalesce(asks, F.lit(False)).alias("asks"))
    fit = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(fit)
    same = Window.partitionBy("h", "v").orderBy(F.col("vec_id").asc_nulls_last())
    leading = rows.select("vec_id", F.xxhash64("v").alias("h"), "v").withColumn("k", F.row_number().over(same)).where(F.col("k") <= top + 1)
    one = leading.groupBy("h", "v").agg(F.array_sort(F.collect_list(F.struct(F.col("vec_id").isNull().alias("x"), "vec_id"))).alias("i"))
    one = one.select(F.monotonically_increasing_id().alias("node"), F.transform("i", lambda s: s["vec_id"]).alias("ids"), "v")
    one = cut_lineage(one, "vectors")
    largest = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    norm = F.col("m") * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.col("m")) * (x / F.col("m"))))
    facts = one.select("v", largest.alias("m")).agg(F.count("*").alias("n"), F.max(norm).alias("norm"), F.max(F.size("v")).alias("dim")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n, dim, norm = facts["n"], facts["dim"], min(facts["norm"], 1e300)
    lists = min(MOST_LISTS, 1 << max(0, int(np.ceil(np.log2(n / LIST)))))
    size = max(2, min(max(LEAST_SAMPLE, lists * SAMPLE), SAMPLE_VALUES // dim))
    sample = one.orderBy(F.xxhash64("v")).limit(size).select("v").toArrow().column(0).combine_chunks()
    index = build(_dense(sample, dim), n, norm)
    shared = spark.sparkContext.broadcast(index)

    kind = one.schema["v"].dataType.simpleString()
    listed = cut_lineage(one.mapInArrow(_routed(shared, False), f"node long, ids array<bigint>, v {kind}, lists array<int>"), "lists")
    queries = rows.where("asks").select(F.monotonically_increasing_id().alias("node"), F.col("vec_id").alias("query_id"), "v")
    queries = cut_lineage(queries.mapInArrow(_routed(shared, True), f"node long, query_id long, v {kind}, lists array<int>"), "queries")
    posts, asked = (d.select("*", F.explode("lists").alias("list")).drop("lists") for d in (listed, queries))
    tiles = lambda d, name: d.groupBy("list").agg(F.ceil(F.count("*") / TILE).cast("int").alias(name))
    # at most MOST_LISTS rows
    shape = F.broadcast(tiles(posts, "rows").join(tiles(asked, "columns"), "list"))
    deal = lambda d, own, other: d.join(shape, "list").select(
        *d.columns, F.pmod(F.xxhash64("node"), F.col(own)).cast("int").alias(own[0]), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other[0])
    )
    cell = ["list", "r", "c"]
    entry = "struct<score:double,node:bigint,same:boolean,ids:array<bigint>>"
    pair = deal(posts, "rows", "columns").groupBy(*cell).cogroup(deal(asked, "columns", "rows").groupBy(*cell))
    best = pair.applyInArrow(_best(top + 1, dim, entry), f"node long, query_id long, best array<{entry}>")
    best = best.groupBy("node").agg(F.first("query_id").alias("query_id"), F.flatten(F.collect_list("best")).alias("best"))
    return best.select("query_id", "best").mapInArrow(_merged(top), "query_id long, rank int, vec_id long, score double")


def op13_nearest(vectors: DataFrame) -> DataFrame:
    return nearest(vectors, F.col("vec_id") % 20 == 0)
