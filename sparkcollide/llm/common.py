"""Shared steps: connected components by joins, Arrow batch helpers, the model a worker holds."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcollide.session import cut_lineage

EDGE = "a long, b long"
_held: dict = {}


def release() -> None:
    """Give back to the system what this worker holds, before work that needs no model or another one."""
    if _held:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)


def held(make, *args):
    """What ``make(*args)`` gives, kept by this worker until it asks for another or releases it.

    A worker outlives its tasks and serves the operators that come next, so
    it would pile up their models and caches otherwise.
    """
    if (make, args) not in _held:
        release()
        _held[make, args] = make(*args)
    return _held[make, args]


def row_batch(**cols) -> pa.RecordBatch:
    """A record batch from equally long numpy arrays, Arrow arrays or lists."""
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in cols.values()], names=list(cols))


def take(column: pa.Array, rows: np.ndarray) -> pa.Array:
    return column.take(pa.array(rows))


def carried(columns: tuple[str, ...]) -> Column:
    """Columns that only pass through an Arrow function, in one struct; their names cannot clash there."""
    return (F.struct(*columns) if columns else F.lit(0)).alias("carry")


def _forest(batches):
    """Per batch of edges, a spanning forest: same connectivity, at most one edge per node."""
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = np.arange(len(nodes))
        x, y = at[: len(a)], at[len(a) :]
        while True:
            low = np.minimum(label[x], label[y])
            new = label.copy()
            np.minimum.at(new, label[x], low)
            np.minimum.at(new, label[y], low)
            np.minimum.at(new, x, low)
            np.minimum.at(new, y, low)
            new = new[new]
            if np.array_equal(new, label):
                break
            label = new
        keep = label != np.arange(len(nodes))
        yield row_batch(a=nodes[label[keep]], b=nodes[keep])


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node that has an edge: (node, label).

    Alternates large-star and small-star steps, each one aggregation and one
    join; a written table cuts the lineage between rounds, so a lost executor
    repeats one round at most.  Self-loops and repeated edges are harmless.
    An empty edge table gives an empty result.  Only row counts and sums reach
    the driver.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    edges = cut_lineage(edges.mapInArrow(_forest, EDGE).distinct(), "edges")
    # an edge is (a, b) with a < b; a forest of depth one has each b once and no b as an a
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        large = cut_lineage(large, "large")
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b")
        small = small.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a < b").union(low.select(F.col("m").alias("a"), "b"))
        edges = cut_lineage(small.distinct(), "small")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).union(edges.select("a", "a").distinct().toDF("node", "label"))
