"""Sinks. Each writes a distributed dataset; single files only on request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcollide.operators import reco, select

SUMMARY_SCHEMA = T.StructType(
    [
        T.StructField(n, T.LongType() if "events" in n else T.DoubleType())
        for n in (
            "pt_cut_gev", "eta_cut", "min_delta_r_jets", "mc_events_in", "total_weight_in",
            "preselection_mc_events_out", "preselection_efficiency", "analysis_mc_events_out", "analysis_efficiency",
        )
    ]
)


def write_variables(df: DataFrame, path: str) -> None:
    """SNK01: every event with all candidates, whether or not later cuts pass."""
    df.write.partitionBy("sample").parquet(path)


def write_cutflow_summary(flow: DataFrame, path: str) -> None:
    """SNK02: one JSON record of counters, efficiencies and cut values."""
    ratio = lambda num: F.when(F.sum("w_in") != 0, F.sum(num) / F.sum("w_in")).otherwise(0.0)
    flow.agg(
        F.lit(select.PT_MIN).alias("pt_cut_gev"),
        F.lit(select.ETA_MAX).alias("eta_cut"),
        F.lit(reco.MIN_DR).alias("min_delta_r_jets"),
        F.sum("events_in").alias("mc_events_in"),
        F.round(F.sum("w_in"), 5).alias("total_weight_in"),
        F.sum("n_preselection").alias("preselection_mc_events_out"),
        F.round(ratio("w_pt"), 6).alias("preselection_efficiency"),
        F.sum("n_final").alias("analysis_mc_events_out"),
        F.round(ratio("w_dr_hh"), 6).alias("analysis_efficiency"),
    ).write.json(path)


def read_cutflow_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUMMARY_SCHEMA).json(path)


def write_pass_list(df: DataFrame, path: str) -> None:
    """SNK03: identifiers of events that pass."""
    df.select("event_id").write.parquet(path)
