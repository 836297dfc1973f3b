"""Embedding near-duplicates by sorted projection passes.

In each pass, vectors are ordered by the signs of random projections, read as
one binary number, and each is compared with its neighbours in that order: its
own block of BLOCK places and the blocks beside it, and with all that share
the leading bits of its code, however many those are: where more than two
blocks share them, blocks further apart meet in cells of at most TILE by TILE
blocks.  A pair that meets in several passes counts in the first of them, which
both vectors' block numbers and leading bits tell, so counts and links need no
list of pairs.  A block's links leave it as counts and as a spanning forest.
Equal vectors are one vector with a weight.  The numbers of leading bits and of
passes follow from the number of vectors, so that a pair at the threshold itself
is met with probability RECALL, in a dense group as elsewhere.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkcollide.llm.common import components, row_batch
from sparkcollide.session import cut_lineage

BLOCK = 512
TILE = 32  # blocks on a side of a cell
RECALL = 0.98
BITS = 62
MIN_COSINE = 0.9


def passes_for(n: int, min_cosine: float, block: int = BLOCK, recall: float = RECALL) -> int:
    """Passes so that a pair at the threshold agrees in the leading bits that tell blocks apart at least once."""
    bits = max(0.0, math.log2(max(1, n) / block))
    met = (1 - math.acos(min_cosine) / math.pi) ** bits
    return 1 if met >= recall else math.ceil(math.log(1 - recall) / math.log(1 - met))


def leading_bits(n: int, block: int = BLOCK) -> int:
    """Whole bits of those that passes_for() counts on; vectors that share them are all compared."""
    return max(0, math.floor(math.log2(max(1, n) / block)))


@cache
def directions(pass_: int, dim: int) -> np.ndarray:
    return np.random.default_rng((17, pass_, dim)).standard_normal((dim, BITS))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])  # by a power of two, exact: no square overflows or vanishes
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _codes(passes: int):
    def run(batches):
        for batch in batches:
            size = np.asarray(batch.column(1).value_lengths())
            for dim in np.unique(size).tolist():
                rows = pa.array(np.flatnonzero(size == dim))
                node, x = batch.column(0).take(rows), _matrix(batch.column(1).take(rows), dim)
                for p in range(passes):
                    code = ((x @ directions(p, dim)) > 0).astype(np.int64) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    yield row_batch(p=np.full(len(code), p, np.int32), dim=np.full(len(code), dim, np.int32), code=code, node=node)

    return run


def _numbered(batches):
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield row_batch(part=np.full(n, part, np.int32), at=np.arange(at, at + n), p=batch.column(0), dim=batch.column(1), code=batch.column(2), node=batch.column(3))
        at += n


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest place of a group) after the links a-b."""
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for to in (label[a], label[b], a, b):
            np.minimum.at(new, to, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def _found(node: np.ndarray, label: np.ndarray, count: np.ndarray) -> pa.Table:
    """A forest's edges (a, b, 0) and link counts (a, null, n)."""
    tied = np.flatnonzero(label != np.arange(len(node)))
    some = np.flatnonzero(count)
    none = pa.nulls(len(some), pa.int64())
    return pa.table({
        "a": pa.array(np.concatenate([node[label[tied]], node[some]])), "b": pa.concat_arrays([pa.array(node[tied], pa.int64()), none]),
        "n": pa.array(np.concatenate([np.zeros(len(tied), np.int64), count[some]])),
    })


def _compare(min_cosine: float):
    """One block with itself and with the next: link counts of its vectors and a forest of the links."""

    def run(key, table):
        p = key[0].as_py()
        sizes = np.asarray(table.column("v").combine_chunks().value_lengths())
        node, weight = table.column("node").to_numpy(), table.column("weight").to_numpy()
        mine, blocks, leads = table.column("mine").to_numpy(zero_copy_only=False), table.column("blocks").combine_chunks(), table.column("leads").combine_chunks()
        blocks, leads = (c.flatten().to_numpy().reshape(len(node), -1) for c in (blocks, leads))
        count, a, b = np.zeros(len(node), np.int64), [], []
        for dim in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == dim)
            rows = rows[np.argsort(~mine[rows], kind="stable")]
            own = int(mine[rows].sum())
            x = _matrix(table.column("v").combine_chunks().take(pa.array(rows)), dim)
            i, j = np.nonzero(x[:own] @ x.T >= min_cosine)
            keep = j > i
            i, j = rows[i[keep]], rows[j[keep]]
            fresh = np.ones(len(i), bool)
            for q in range(p):  # met before?
                fresh &= (np.abs(blocks[i, q] - blocks[j, q]) > 1) & (leads[i, q] != leads[j, q])
            i, j = i[fresh], j[fresh]
            np.add.at(count, i, weight[j])
            np.add.at(count, j, weight[i])
            a.append(i), b.append(j)
        return _found(node, _merged(np.arange(len(node)), np.concatenate(a), np.concatenate(b)), count)

    return run


def _cell(min_cosine: float):
    """Blocks that share their leading bits and are not neighbours, one block a row: as _compare()."""

    def run(key, table):
        p, low, high = key[0].as_py(), key[3].as_py(), key[4].as_py()
        block, tile, many = table.column("block").to_numpy(), table.column("tile").to_numpy(), table.column("many").combine_chunks()
        ends = np.concatenate([[0], np.cumsum(np.asarray(many.value_lengths()))])
        many = many.flatten()
        node, weight = many.field("node").to_numpy(), many.field("weight").to_numpy().astype(np.float64)
        blocks, leads = (many.field(c).flatten().to_numpy().reshape(len(node), -1).T.copy() for c in ("blocks", "leads"))
        x = _matrix(many.field("v"), key[1].as_py())
        count, label = np.zeros(len(node)), np.arange(len(node))
        for k in np.flatnonzero(tile == low):
            for m in np.flatnonzero((tile == high) & (block > block[k] + 1)):
                i, j = slice(ends[k], ends[k + 1]), slice(ends[m], ends[m + 1])
                link = x[i] @ x[j].T >= min_cosine
                for q in range(p):  # met before?
                    if not link.any():
                        break
                    link &= (np.abs(blocks[q, i, None] - blocks[q, j]) > 1) & (leads[q, i, None] != leads[q, j])
                if link.any():
                    count[i] += link @ weight[j]
                    count[j] += weight[i] @ link
                    a, b = np.nonzero(link & (label[i, None] != label[j]))
                    label = _merged(label, a + ends[k], b + ends[m])
        return _found(node, label, count.astype(np.int64))

    return run


def near_duplicates(vectors: DataFrame, min_cosine: float = MIN_COSINE, block: int = BLOCK, passes: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per vector.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing; vectors of different length do not link.  Repeated rows
    are equal vectors and link.  A null vec_id takes part; the component's
    number is the smallest non-null id.  Labels and other columns are not read.
    Vectors are named by a 64-bit hash inside.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").alias("v"))
    fit = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.select("vec_id", F.when(fit, F.xxhash64("v")).alias("node"), F.when(fit, F.col("v")).alias("v"))
    one = cut_lineage(rows.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"), F.first("v").alias("v")), "vectors")
    n = one.count()
    passes, bits = passes or passes_for(n, min_cosine, block), leading_bits(n, block)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    coded = one.select("node", "v").mapInArrow(_codes(passes), "p int, dim int, code long, node long")
    numbered = cut_lineage(coded.repartitionByRange(parts, "p", "dim", "code", "node").sortWithinPartitions("p", "dim", "code", "node").mapInArrow(_numbered, "part int, at long, p int, dim int, code long, node long"), "order")
    # rows before each partition: one line a partition
    sizes = numbered.groupBy("part").agg(F.count("*").alias("k")).select(F.col("part").alias("of"), (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("before"))
    numbered = numbered.join(sizes, F.col("part") == F.col("of"))
    lead = F.shiftright("code", BITS - bits).cast("int")
    place = numbered.select("node", "p", "dim", lead.alias("lead"), F.floor((F.col("before") + F.col("at") - F.col("p") * F.lit(n)) / block).cast("int").alias("block"))
    places = F.array_sort(F.collect_list(F.struct("p", "block", "lead")))
    places = place.groupBy("node").agg(places.alias("c")).select("node", F.transform("c", lambda x: x["block"]).alias("blocks"), F.transform("c", lambda x: x["lead"]).alias("leads"))
    dealt = cut_lineage(one.join(places, "node").select("node", "weight", "v", "blocks", "leads"), "places")
    each = dealt.select("*", F.size("v").alias("dim"), F.posexplode(F.arrays_zip("blocks", "leads")).alias("p", "c")).select("node", "weight", "v", "blocks", "leads", "p", "dim", F.col("c.blocks").alias("block"), F.col("c.leads").alias("lead"))
    beside = F.array(F.struct(F.col("block").alias("cell"), F.lit(True).alias("mine")), F.struct((F.col("block") - 1).alias("cell"), F.lit(False).alias("mine")))
    near = each.select("node", "weight", "v", "blocks", "leads", "p", F.explode(beside).alias("c"))
    near = near.select("p", F.col("c.cell").alias("cell"), F.col("c.mine").alias("mine"), "node", "weight", "v", "blocks", "leads").where("cell >= 0")
    near = near.groupBy("p", "cell").applyInArrow(_compare(min_cosine), "a long, b long, n long")
    # leading bits that more than two blocks share; there are about as many (block, lead) as blocks
    lead = ["p", "dim", "lead"]
    pieces = cut_lineage(place.groupBy(*lead, "block").agg(F.count("*").alias("k")), "pieces")
    wide = pieces.groupBy(*lead).agg(F.min("block").alias("first"), F.max("block").alias("last")).where(F.col("last") - F.col("first") > 1)
    tile = ((F.col("block") - F.col("first")) / TILE).cast("int")
    wide = pieces.join(wide, lead).select(*lead, "block", tile.alias("tile"), ((F.col("last") - F.col("first")) / TILE).cast("int").alias("tiles"))
    packed = each.join(wide, [*lead, "block"]).groupBy(*lead, "block", "tile", "tiles").agg(F.collect_list(F.struct("node", "weight", "v", "blocks", "leads")).alias("many"))
    cells = packed.select(*lead, "block", "tile", "many", F.explode(F.sequence(F.lit(0), "tiles")).alias("other"))
    cells = cells.select(*lead, F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "block", "tile", "many")
    cells = cells.groupBy(*lead, "low", "high").applyInArrow(_cell(min_cosine), "a long, b long, n long")
    found = cut_lineage(near.union(cells), "links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    group = components(found.where("b is not null").select("a", "b"))
    named = one.join(counts, one["node"] == counts["a"], "left").join(group.withColumnRenamed("node", "g"), F.col("node") == F.col("g"), "left")
    named = cut_lineage(named.select("node", "low", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("label", "node").alias("root")), "named")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = cut_lineage(named.join(lowest, "root").select(F.col("node").alias("k"), "n_links", "component_id"), "classes")
    out = rows.select("vec_id", "node").join(named, F.col("node") == F.col("k"), "left")
    component = F.when(F.col("k").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op8_vectors(vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors)
