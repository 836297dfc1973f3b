"""Session helpers: table access and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the cluster's shared checkpoint folder.

    The folder is read from ``spark.checkpoint.dir``; only where that is unset
    (tests, local mode) is a temporary folder made and recorded.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write once and read back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a NULL key meets a NULL key; the keys stand once, as in ``left.join(right, keys)``."""
    other = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & left[k].eqNullSafe(F.col(f"_k{i}"))
    return left.join(other, same, how).drop(*[f"_k{i}" for i in range(len(keys))])


FEW = 1 << 16  # keys that are sent to every task


def lookup(df: DataFrame, key: str, values_of: DataFrame, values: list[str]) -> DataFrame:
    """Attach per-key values of an aggregate with one row a key; any number of keys.

    The aggregate is made once. Up to FEW keys (classes, say) are broadcast, so
    that the rows of two hot keys are not two tasks; more are an ordinary join side.
    """
    known = cut_lineage(values_of.select(key, *values), "lookup")
    if known.count() <= FEW:
        known = F.broadcast(known)
    return df.join(known, key, "left").select(*df.columns, *values)
