"""Catalogues, logs and run directories as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcollide.functions import text

REQUIRED = ("process_id", "events", "cross_section_pb", "local_lhe")
OPTIONAL = ("description", "process", "notes", "b_quarks", "c_quarks", "light_jets")


def scan_process_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """SRC09: process CSV -> typed samples with flavour counts; blank rows skipped."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    missing = sorted(set(REQUIRED) - set(raw.columns))
    if missing:
        raise ValueError(f"missing required column(s): {', '.join(missing)}")
    for c in OPTIONAL:
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    rows = raw.filter((F.trim(F.coalesce("process_id", F.lit(""))) != "") & (F.trim(F.coalesce("local_lhe", F.lit(""))) != ""))
    explicit = {k: F.trim(c).try_cast("int") for k, c in (("b", "b_quarks"), ("c", "c_quarks"), ("l", "light_jets"))}
    fl = text.infer_flavours(explicit, F.col("process"), [F.col(c) for c in ("process", "description", "process_id", "notes")], F.col("process_id"))
    rows = rows.withColumn("_f", fl)
    pid = F.trim("process_id")
    return rows.select(
        pid.alias("process_id"), F.trim(F.coalesce("description", F.lit(""))).alias("description"), F.trim("local_lhe").alias("local_lhe"),
        F.col("events").cast("double").cast("long").alias("events"),
        F.col("cross_section_pb").cast("double").alias("xsec_pb"), (F.col("cross_section_pb").cast("double") * 1000).alias("xsec_fb"),
        F.concat(F.lit("HW-"), pid).alias("run_name"), F.concat(F.lit("HW-"), pid, F.lit("_var.smearCMS.root")).alias("var_file"),
        F.col("_f.b").alias("b_quarks"), F.col("_f.c").alias("c_quarks"), F.col("_f.l").alias("light_jets"),
    )


# Log patterns and unit factors (nb -> fb, pb -> fb).
WEIGHT_LINE = r"(?i)Integrated weight\s*\(pb\)\s*[:=]\s*([0-9.+\-eE]+)"
XSEC_LINE = r"(?i)cross-?section\s*[:=]\s*([0-9.+\-eE]+)\s*pb"
EVENTS_LINE = r"(?i)Number of Events\s*[:=]\s*(\d+)"
NEVENTS_LINE = r"(?i)^\s*(\d+)\s*=\s*nevents\b"
TOTAL_LINE = r"^\s*Total:\s+(\d+)\s+\d+\s+([0-9.+\-eE()]+)"
HTML_ERROR = r"<b>s=\s*([0-9.eE+-]+)\s*\+/-\s*([0-9.eE+-]+)\s*\(pb\)</b>"
NB_TO_FB, PB_TO_FB = 1.0e6, 1000.0


def _hit(pattern: str, group: int = 1) -> Column:
    return F.regexp_extract("line", pattern, group)


def extract_run_metadata(lines: DataFrame) -> DataFrame:
    """SRC10: (file, line_no, line) -> one row per file.

    Banner values keep the last match, the generator total the first; both
    are min/max aggregates, so a large log is never gathered.
    """
    x = F.coalesce(_hit(XSEC_LINE).try_cast("double"), _hit(WEIGHT_LINE).try_cast("double"))
    n = F.coalesce(_hit(NEVENTS_LINE).try_cast("long"), _hit(EVENTS_LINE).try_cast("long"))
    total_nb = F.regexp_replace(_hit(TOTAL_LINE, 2), r"\([^)]*\)", "").try_cast("double")
    rows = lines.select("file", "line_no", x.alias("x"), n.alias("n"), _hit(TOTAL_LINE).try_cast("long").alias("tn"), (total_nb * NB_TO_FB).alias("tx"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))
    first = lambda c: F.min_by(c, F.when(F.col("tx").isNotNull(), F.col("line_no")))
    return rows.groupBy("file").agg(
        last("x").alias("xsec_pb"), last("n").alias("generated_events"), first("tx").alias("total_fb"), first("tn").alias("total_events")
    )


SUMMARY_JSON = "total_weight_in double, mc_events_in double, preselection_weight_out double, preselection_efficiency double, analysis_weight_out double, analysis_mc_events_out double, analysis_efficiency double"
# Starts of the known log lines, by field.
LOG_FIELDS = {
    "total_weight_in": "total weight in", "mc_events_in": "total MC events in", "preselection_weight_out": "preselection weight out",
    "preselection_efficiency": "preselection efficiency", "fallback_weight_out": "8bs with pT", "analysis_weight_out": "total weight out",
    "analysis_mc_events_out": "actual MC events", "analysis_efficiency": "efficiency",
}


def scan_cutflow_summary(samples: DataFrame, jsons: DataFrame, logs: DataFrame) -> DataFrame:
    """SRC11: JSON summary if present, else values from the log, else missing."""
    js = jsons.select("sample", F.from_json("json", SUMMARY_JSON).alias("j"))
    line = F.trim("line")
    value = text.last_number(line)
    pick = lambda start: F.max_by(value, F.when(line.startswith(start), F.col("line_no")))
    lg = logs.groupBy("sample").agg(*[pick(s).alias(f) for f, s in LOG_FIELDS.items()])
    pre = F.coalesce("preselection_weight_out", "fallback_weight_out")
    w = F.when(F.col("total_weight_in") != 0, F.col("total_weight_in"))
    lg = lg.select(
        "sample", "total_weight_in", "mc_events_in", pre.alias("preselection_weight_out"), F.coalesce(pre / w, F.col("preselection_efficiency")).alias("preselection_efficiency"),
        "analysis_weight_out", "analysis_mc_events_out", F.coalesce("analysis_efficiency", F.col("analysis_weight_out") / w).alias("analysis_efficiency"),
    )
    fields = [c for c in lg.columns if c != "sample"]
    lg = lg.select("sample", F.struct(*fields).alias("l"))
    out = samples.join(js, "sample", "left").join(lg, "sample", "left")
    source = F.when(F.col("j").isNotNull(), "json").when(F.col("l").isNotNull(), "log").otherwise("missing")
    pick_field = lambda f: F.when(F.col("j").isNotNull(), F.col("j")[f]).otherwise(F.col("l")[f])
    return out.select(
        "sample", *[pick_field(f).alias(f) for f in fields], source.alias("summary_source"),
        F.when(source == "missing", "missing_analysis_summary").when(pick_field("analysis_efficiency").isNull(), "missing_analysis_summary").otherwise("ok").alias("status"),
    )


def scan_run_catalogue(dirs: DataFrame) -> DataFrame:
    """SRC12: (run_dir, has_lhe, has_var, generated_events, xsec_pb) -> catalogue with status."""
    group, c3, d4 = text.parse_point(F.col("run_dir"))
    status = F.when(F.col("has_var"), "ready_to_score").when(F.col("has_lhe"), "lhe_ready_needs_var_root").otherwise("waiting_for_lhe")
    return dirs.select("*", group.alias("run_group"), c3.alias("c3"), d4.alias("d4"), (F.col("xsec_pb") * PB_TO_FB).alias("xsec_fb"), status.alias("status"))


def scan_xsec_points(runs: DataFrame, html: DataFrame) -> DataFrame:
    """SRC13: completed runs with cross-section, error and runs per group.

    The error comes from the results page, else one per cent of the value.
    """
    err = F.regexp_extract(F.regexp_replace("html", "&plusmn;|&#177;|±", "+/-"), HTML_ERROR, 2).try_cast("double")
    group, c3, d4 = text.parse_point(F.col("run_name"))
    rows = runs.filter("has_lhe").join(html.select("run_id", err.alias("_err")), "run_id", "left")
    rows = rows.select("run_id", "run_name", group.alias("runnum"), c3.alias("c3"), d4.alias("d4"), "xsec_pb", "_err").filter(F.col("c3").isNotNull())
    per_group = rows.groupBy("runnum").agg(F.count("*").alias("runs_in_group"))
    fallback = F.greatest(F.abs("xsec_pb") * 0.01, F.lit(1e-30))
    return rows.join(per_group, "runnum").withColumn("xsec_error_pb", F.coalesce("_err", fallback)).drop("_err")
