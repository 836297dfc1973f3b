"""Flat variable tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcollide.operators.ranking import distributed_row_number, leading_n
from sparkcollide.operators.reco import feature_names


PARTIAL_LIMIT = 1000  # Spark cuts groups to at most so many rows before a shuffle


def finite_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """FLT06: keep rows where every named column is a finite number."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return df.filter(reduce(lambda a, b: a & b, [ok(c) for c in columns]))


def scan_variables(spark: SparkSession, path: str, label: int, xsec: float = 1.0, max_events: int | None = None, include_weight: bool = False) -> DataFrame:
    """SRC08: features + label + weight * xsec; non-finite rows are dropped.

    ``max_events`` takes the first events of each sample, before that; small
    limits run before the shuffle, large ones by distributed ranks.
    """
    names = feature_names(8)
    df = spark.read.parquet(path).select("event_id", "sample", "weight", *names)
    if max_events is not None:
        if max_events <= PARTIAL_LIMIT:
            df = leading_n(df, ["sample"], [F.col("event_id").asc()], max_events).drop("rn")
        else:
            df = distributed_row_number(df, ["sample"], ["event_id"]).where(F.col("rn") <= max_events).drop("rn")
    df = finite_rows(df, ["weight", *names])
    if include_weight:
        df = df.withColumn("weight_feature", F.col("weight"))
    return df.withColumns({"label": F.lit(label), "weight": F.col("weight") * xsec})


def score_threshold(df: DataFrame, threshold: float) -> DataFrame:
    """FLT07: inclusive lower cut on the score."""
    return df.filter(F.col("score") >= threshold)


def drop_auxiliary(df: DataFrame, name: str) -> DataFrame:
    """FLT08: drop names that mention debug or smoke."""
    return df.filter(~F.col(name).rlike("(?i)debug|smoke"))


def concat_samples(groups: dict[int, list[DataFrame]]) -> DataFrame:
    """SET05: union of labelled samples."""
    labelled = [df.withColumn("label", F.lit(label)) for label, dfs in groups.items() for df in dfs]
    return reduce(lambda a, b: a.unionByName(b), labelled)
