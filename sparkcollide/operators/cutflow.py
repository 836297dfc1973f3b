"""Weighted cut flow and efficiencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcollide.operators.reco import FLAGS


def weighted_cutflow(events: DataFrame, reco: DataFrame, by: list[str]) -> DataFrame:
    """AGG01: weights after each cut per sample, with all input events counted.

    ``events`` carries every input event; ``reco`` the flags of the events
    that have all candidates. One join on the event key, one partial+final
    aggregation by sample.
    """
    joined = events.join(reco.select("event_id", F.lit(True).alias("has_cands"), *FLAGS), "event_id", "left")
    w = F.col("evweight")
    stages = {"w_cands": "has_cands", **{f"w_{f[5:]}": f for f in FLAGS}}
    return joined.groupBy(*by).agg(
        F.count("*").alias("events_in"),
        F.sum(w).alias("w_in"),
        *[F.sum(F.when(F.col(flag), w).otherwise(0.0)).alias(name) for name, flag in stages.items()],
        F.count(F.when(F.col("pass_pt"), 1)).alias("n_preselection"),
        F.count(F.when(F.col("pass_dr_hh"), 1)).alias("n_final"),
    )


def efficiencies(flow: DataFrame) -> DataFrame:
    """AGG02: passed over total weight, zero when nothing came in."""
    ratio = lambda num: F.when(F.col("w_in") != 0, F.col(num) / F.col("w_in")).otherwise(0.0)
    return flow.withColumns({"eff_preselection": ratio("w_pt"), "eff_final": ratio("w_dr_hh")})
