"""Sample bookkeeping: rates, normalisation, yields, summaries, run selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default physics factors.
HBB, BTAG, CMISTAG, LMISTAG, K_FACTOR = 0.5824, 0.85, 0.1, 0.01, 2.0


def signal_rate(k: float = K_FACTOR, hbb: float = HBB, hbb_power: int = 4, btag: float = BTAG, btag_power: int = 8) -> float:
    """SCL11: K * BR^4 * eff_b^8."""
    return k * hbb**hbb_power * btag**btag_power


def background_rate(b: str = "b_quarks", c: str = "c_quarks", l: str = "light_jets", k: float = K_FACTOR) -> Column:
    """SCL11: K * eff_b^b * eff_c^c * eff_l^l; null counts give the fallback K."""
    value = F.lit(k) * F.pow(F.lit(BTAG), F.col(b)) * F.pow(F.lit(CMISTAG), F.col(c)) * F.pow(F.lit(LMISTAG), F.col(l))
    return F.coalesce(value, F.lit(k))


def normalisation(input_sum: Column, generated: Column, abs_sum: Column, rows: Column) -> tuple[Column, Column]:
    """SCL12: denominator and where it came from."""
    value = (
        F.when(input_sum > 0, input_sum).when(generated > 0, generated.cast("double")).when(abs_sum > 0, abs_sum).otherwise(rows.cast("double"))
    )
    source = F.when(input_sum > 0, "input_weight_sum").when(generated > 0, "generated_events").otherwise("loaded_weight_sum")
    return value, source


def sample_summary(rows: DataFrame, meta: DataFrame, luminosity: float) -> DataFrame:
    """AGG15: one row per sample with entries, normalisation and expected yield."""
    sums = rows.groupBy("sample_id").agg(F.count("*").alias("entries"), F.sum("weight").alias("sum_weight"), F.sum(F.abs("weight")).alias("sum_abs"))
    out = sums.join(meta, "sample_id")
    den, src = normalisation(F.col("input_weight_sum"), F.col("generated_events"), F.col("sum_abs"), F.col("entries"))
    eff_x = F.col("xsec_fb") * F.col("rate_factor")
    out = out.withColumns({"normalisation": den, "normalisation_source": src, "effective_xsec_fb": eff_x})
    out = out.withColumn("expected_preselected", F.lit(luminosity) * F.col("effective_xsec_fb") * F.col("sum_weight") / F.col("normalisation"))
    initial = F.lit(luminosity) * F.col("effective_xsec_fb")
    return out.withColumn("analysis_efficiency", F.when(initial != 0, F.col("expected_preselected") / initial).otherwise(0.0))


def mc_event_counts(summary: DataFrame) -> DataFrame:
    """AGG16: totals; the generated total is null if any sample is unknown."""
    known = F.sum("generated_events")
    return summary.groupBy("label").agg(
        F.count("*").alias("files"), F.sum("entries").alias("entries_read"),
        F.when(F.count("generated_events") == F.count("*"), known).alias("generated_events"),
        F.coalesce(known, F.lit(0)).alias("known_generated_events"),
    )


def score_points(rows: DataFrame, meta: DataFrame, threshold: float, luminosity: float) -> DataFrame:
    """AGG17: yields and efficiencies per sample at ``score >= threshold``.

    One conditional partial+final aggregation; samples without rows give none.
    """
    sel = F.col("score") >= threshold
    w = F.col("weight")
    s = rows.groupBy("sample_id").agg(
        F.count("*").alias("entries"), F.count(F.when(sel, 1)).alias("selected_entries"), F.sum(w).alias("sw"),
        F.sum(F.when(sel, w).otherwise(0.0)).alias("sw_sel"), F.sum(F.when(sel, w * w).otherwise(0.0)).alias("sw2_sel"),
        F.sum(F.abs(w)).alias("sa"), F.sum(F.abs(w) * F.col("score")).alias("sas"),
    )
    s = s.join(meta, "sample_id")
    den, src = normalisation(F.col("input_weight_sum"), F.col("generated_events"), F.col("sa"), F.col("entries"))
    eff_x = F.col("xsec_fb") * F.col("rate_factor")
    s = s.withColumns({"effective_xsec_fb": eff_x, "normalisation": den, "normalisation_source": src})
    scale = F.lit(luminosity) * F.col("effective_xsec_fb") / F.col("normalisation")
    s = s.withColumns(
        {
            "expected_preselected": scale * F.col("sw"), "expected_selected": scale * F.col("sw_sel"),
            "expected_selected_error": F.abs(scale) * F.sqrt("sw2_sel"), "_initial": F.lit(luminosity) * F.col("effective_xsec_fb"),
        }
    )
    ratio = lambda a, b: F.when(F.col(b) != 0, F.col(a) / F.col(b)).otherwise(0.0)
    s = s.withColumns(
        {
            "analysis_efficiency": ratio("expected_preselected", "_initial"), "classifier_efficiency": ratio("expected_selected", "expected_preselected"),
            "final_efficiency": ratio("expected_selected", "_initial"), "raw_efficiency": ratio("sw_sel", "sw"), "mean_score": ratio("sas", "sa"),
        }
    )
    return s.withColumns(
        {"raw_sigma_eff_fb": F.col("xsec_fb") * F.col("classifier_efficiency"), "effective_sigma_eff_fb": F.col("effective_xsec_fb") * F.col("classifier_efficiency")}
    ).drop("sw", "sw_sel", "sw2_sel", "sa", "sas", "_initial")


def background_totals(scored: DataFrame) -> DataFrame:
    """AGG18: sums of yields and sigma x efficiency over samples."""
    return scored.agg(
        F.count("*").alias("files"), F.sum("entries").alias("entries"), F.sum("selected_entries").alias("selected_entries"),
        *[F.sum(c).alias(c) for c in ("expected_preselected", "expected_selected", "effective_sigma_eff_fb")],
    )


def rollup_score_rows(scored: DataFrame, luminosity: float) -> DataFrame:
    """AGG19: totals with errors in quadrature and ratio-of-sums efficiencies."""
    t = scored.agg(
        F.sum("entries").alias("entries"), F.sum("selected_entries").alias("selected_entries"),
        F.sum("expected_preselected").alias("pre"), F.sum("expected_selected").alias("sel"),
        F.sqrt(F.sum(F.pow("expected_selected_error", 2))).alias("sel_error"), (F.lit(luminosity) * F.sum("effective_xsec_fb")).alias("initial"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return t.withColumns({"analysis_efficiency": ratio("pre", "initial"), "classifier_efficiency": ratio("sel", "pre"), "final_efficiency": ratio("sel", "initial")})


def background_xsec_summary(catalogue: DataFrame, summary: DataFrame) -> DataFrame:
    """AGG20: effective, preselected and final cross-section per process."""
    rows = catalogue.join(summary, "sample", "left").withColumn("rate_factor", background_rate())
    x = F.col("xsec_fb") * F.col("rate_factor")
    return rows.withColumn("effective_xsec_fb", x).withColumns(
        {"preselection_xsec_fb": F.col("effective_xsec_fb") * F.col("preselection_efficiency"), "output_xsec_fb": F.col("effective_xsec_fb") * F.col("analysis_efficiency")}
    )


def background_xsec_totals(rows: DataFrame) -> DataFrame:
    """AGG20: totals where a missing value counts as zero."""
    z = lambda c: F.sum(F.coalesce(c, F.lit(0.0))).alias(c)
    return rows.agg(z("effective_xsec_fb"), z("preselection_xsec_fb"), z("output_xsec_fb"), F.count("*").alias("processes"))


def best_run_per_point(runs: DataFrame, required_events: int | None = 10000) -> DataFrame:
    """WIN01: one selected run per (c3, d4); the rest get a status.

    The winner is a max over an ordering struct, a partial aggregate, so a
    point holding most of the runs needs no sort and no single-task window.
    Names without couplings are always kept.
    """
    order = F.coalesce(F.col("run_group").try_cast("int"), F.lit(-1))
    ok = F.lit(True) if required_events is None else F.col("generated_events") == required_events
    rows = runs.withColumns({"_key": F.struct(F.col("has_lhe"), order.alias("g"), F.col("run_name"), F.col("run_id")), "_ok": ok})
    best = rows.filter("_ok AND c3 IS NOT NULL AND d4 IS NOT NULL").groupBy("c3", "d4").agg(F.max("_key").alias("_best"))
    rows = rows.join(best, ["c3", "d4"], "left")
    status = (
        F.when(F.col("c3").isNull() | F.col("d4").isNull(), "selected").when(~F.col("_ok"), "nonmatching_events")
        .when(F.col("_key") == F.col("_best"), "selected").otherwise("duplicate")
    )
    return rows.withColumn("selection", status).drop("_key", "_ok", "_best")


# A parameter table is matched by key; it is broadcast by the optimizer only below
# spark.sql.autoBroadcastJoinThreshold, never by a hint.
def attach_params(files: DataFrame, key: str, values: DataFrame | list, name: str, default=None) -> DataFrame:
    """JN10: one value for all files, or exactly one per key; anything else fails."""
    if isinstance(values, list):
        if len(values) > 1:
            raise ValueError(f"{name}: give one value, or a table keyed by {key}")
        return files.withColumn(name, F.lit(values[0] if values else default))
    out = files.join(values.select(key, F.col(name)), key, "left")
    kind = values.schema[name].dataType
    n_values, n_files = (d.agg(F.count("*")).scalar() for d in (values, files))
    miss = F.raise_error(F.concat(F.lit(f"{name}: no value for "), F.col(key).cast("string"))).cast(kind)
    other = F.raise_error(F.concat(F.lit(f"{name}: expected 1 or "), n_files.cast("string"), F.lit(" values, got "), n_values.cast("string"))).cast(kind)
    return out.withColumn(name, F.when(n_values == n_files, F.coalesce(F.col(name), miss)).otherwise(other))


def attach_sample_metadata(facts: DataFrame, samples: DataFrame, how: str = "left") -> DataFrame:
    """JN01: equi join by sample; unmatched facts keep null metadata on ``left``."""
    return facts.join(samples, "sample", how)


def not_yet_processed(inputs: DataFrame, processed: DataFrame, key: str, force: bool = False) -> DataFrame:
    """JN05: inputs without an output, unless forced."""
    return inputs if force else inputs.join(processed.select(key), key, "left_anti")


def unique_paths(paths: DataFrame, order: str = "ord") -> DataFrame:
    """SET03: first occurrence of each path, as a min aggregate."""
    return paths.groupBy("path").agg(F.min(order).alias(order))


def resolve_sample_rates(files: DataFrame, explicit: DataFrame, totals: DataFrame, banners: DataFrame, log_weights: DataFrame, default_events: int) -> DataFrame:
    """JN13: explicit value > run total > parent banner > 1 fb (flagged)."""
    out = (
        files.join(explicit.select("file", F.col("xsec_fb").alias("_e")), "file", "left")
        .join(totals.select("file", F.col("total_fb").alias("_t"), F.col("total_events").alias("_tn")), "file", "left")
        .join(banners.select("run_dir", (F.col("xsec_pb") * 1000).alias("_b"), F.col("generated_events").alias("_bn")), "run_dir", "left")
        .join(log_weights.select("file", F.col("total_weight_in").alias("normalisation_weight")), "file", "left")
    )
    source = F.when(F.col("_e").isNotNull(), "explicit").when(F.col("_t").isNotNull(), "total").when(F.col("_b").isNotNull(), "banner").otherwise("default")
    events = F.coalesce("_tn", "_bn", F.lit(default_events).cast("long"))
    return out.select(
        "file", F.coalesce("_e", "_t", "_b", F.lit(1.0)).alias("xsec_fb"), source.alias("xsec_source"),
        events.alias("generated_events"), "normalisation_weight", (source == "default").alias("warning"),
    )


def expected_significance(rows: DataFrame, signal_events: Column, systematics: float, luminosity: float) -> DataFrame:
    """AGG33: S / sqrt(B + (alpha B)^2) with B summed over processes."""
    b = F.sum(F.col("efficiency") * F.col("xsec_fb") * F.col("factor")) * luminosity
    out = rows.agg(b.alias("background_events"), signal_events.alias("signal_events"))
    B = F.col("background_events")
    return out.withColumn("significance", F.when(B > 0, F.col("signal_events") / F.sqrt(B + F.pow(systematics * B, 2))))
