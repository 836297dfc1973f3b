"""Table sinks: scores, points, metrics, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_scores(df: DataFrame, path: str) -> None:
    """SNK04: per-event score table."""
    df.write.parquet(path)


def write_points(df: DataFrame, path: str, metadata: dict[str, float]) -> None:
    """SNK05: fixed column order as CSV, and JSON records with a metadata block."""
    df.write.option("header", True).csv(path + "/csv")
    meta = F.struct(*[F.lit(v).alias(k) for k, v in metadata.items()])
    df.select(meta.alias("metadata"), F.struct(*df.columns).alias("point")).write.json(path + "/json")


# Columns of the published tables, in order.
BACKGROUND_COLUMNS = (
    "file", "process_id", "description", "local_lhe", "raw_xsec_pb", "b_quarks", "c_quarks", "light_jets", "c_mistags", "light_mistags", "entries", "selected_entries", "threshold", "xsec_fb",
    "raw_xsec_fb", "rate_factor", "effective_xsec_fb", "generated_events", "normalisation_weight", "normalisation_source", "expected_preselected_events", "expected_selected_events",
    "expected_selected_error", "raw_sigma_eff_fb", "effective_sigma_eff_fb", "analysis_efficiency", "xgboost_efficiency", "final_efficiency", "weighted_efficiency", "raw_weight_efficiency", "mean_score",
)
BACKGROUND_TOTALS = ("expected_preselected_events", "expected_selected_events", "effective_sigma_eff_fb", "raw_sigma_eff_fb")


def write_rows(df: DataFrame, path: str, columns: tuple[str, ...], block: str, metadata: dict) -> None:
    """Rows in a fixed column order (missing ones null) as CSV, and as JSON with a metadata block; metadata values may be one-row scalars."""
    rows = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])
    rows.write.option("header", True).csv(path + "/csv")
    meta = F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in metadata.items()])
    rows.select(meta.alias("metadata"), F.struct(*columns).alias(block)).write.json(path + "/json")


def write_backgrounds(df: DataFrame, path: str, model_file: str, threshold: float, luminosity: float) -> None:
    """SNK05: background table with the totals of its yields in the metadata."""
    totals = {f"{c}_total": df.agg(F.sum(c).alias("t")).scalar() for c in BACKGROUND_TOTALS}
    write_rows(df, path, BACKGROUND_COLUMNS, "background", {"model_file": model_file, "threshold": threshold, "luminosity_fb_inverse": luminosity} | totals)


def write_limits(df: DataFrame, path: str, columns: tuple[str, ...], metadata: dict) -> None:
    """SNK05: one row a point of the limit scan, with what the whole scan shares in the metadata."""
    write_rows(df, path, columns, "point", metadata)


def write_metrics(df: DataFrame, path: str) -> None:
    """SNK06: one-row metrics as JSON."""
    df.write.json(path)


def write_manifest(df: DataFrame, path: str) -> None:
    """SNK07: status table as CSV."""
    df.write.option("header", True).csv(path)
