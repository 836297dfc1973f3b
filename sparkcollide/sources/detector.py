"""Detector-level event tables: jets stored per event in bounded slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcollide.sources.fixtures import JET_KEYS

# Fixed value: slots per jet collection in the event record.
SLOTS = 100


def write_detector_events(jets: DataFrame, path: str) -> None:
    """SRC07 input: one row per (event, slice); a slice never exceeds one record.

    Jets are dealt to slices by key hash only when an event is larger than a
    record, so a hot event becomes many rows instead of one huge array.
    """
    sizes = jets.groupBy("event_id").agg(F.count("*").alias("_n"))
    keyed = jets.join(sizes, "event_id").withColumn(
        "slice", F.pmod(F.xxhash64(*JET_KEYS), F.ceil(F.col("_n") / (SLOTS / 2))).cast("int")
    )
    item = F.struct(
        "e", "px", "py", "pz",
        F.when(F.col("tag") == "b", 5).when(F.col("tag") == "c", 4).otherwise(1).alias("id"),
        F.when(F.col("tag") == "c", 1.0).otherwise(0.0).alias("ctag"),
        *JET_KEYS,
    )
    keyed.groupBy("event_id", "slice").agg(F.collect_list(item).alias("jets")).write.parquet(path)


def scan_detector_events(spark: SparkSession, paths: list[str], nmin: int | None = None, nmax: int | None = None) -> DataFrame:
    """SRC07: chained event files, optionally limited to ``[nmin, nmax)``.

    The range is on the event number, so it is pushed to the Parquet scan and
    does not depend on file order.
    """
    df = spark.read.parquet(*paths)
    if nmin is not None:
        df = df.filter(F.col("event_id") >= nmin)
    if nmax is not None:
        df = df.filter(F.col("event_id") < nmax)
    return df
