"""Counting-experiment limits, least-squares fits and curve labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcollide.functions import couplings as cf
from sparkcollide.functions import poisson


# --- Poisson ------------------------------------------------------------------------
@F.pandas_udf(T.DoubleType())
def _cdf(n: pd.Series, mean: pd.Series) -> pd.Series:
    return pd.Series(np.exp(poisson.log_cdf(n.to_numpy(float), mean.to_numpy(float))))


def poisson_cdf(n: Column, mean: Column) -> Column:
    """INF01: P(k <= n) by the incomplete gamma function, in memory that does not depend on n."""
    return _cdf(n.cast("double"), mean.cast("double"))


def poisson_median(mean: Column) -> Column:
    """INF01: smallest n with cdf >= 1/2; closed form above a mean of 100."""
    start = F.struct(F.exp(-mean).alias("t"), F.exp(-mean).alias("c"), F.lit(0).alias("n"))

    def step(acc, k):
        go = acc["c"] < 0.5
        t = acc["t"] * mean / k
        return F.when(go, F.struct(t.alias("t"), (acc["c"] + t).alias("c"), k.alias("n"))).otherwise(acc)

    # the median never exceeds the mean by one, so 102 terms cover means to 100
    small = F.aggregate(F.sequence(F.lit(1), F.lit(102)), start, step, lambda a: a["n"])
    large = F.floor(mean + 1.0 / 3.0 - 0.02 / mean).cast("int")
    return F.when(mean <= 0, 0).when(mean > 100, F.greatest(F.lit(0), large)).otherwise(small)


def upper_limit(method: str = "cls", cl: float = 0.95):
    """INF02: (background, observed) -> largest signal compatible with the observed count.

    ``cls`` divides by the probability without signal, ``classical`` does not.
    Steps and memory a row do not grow with its counts, but for the square root
    in the gamma function. A count that is impossible without signal and a limit
    above 1e9 raise.
    """
    if method not in ("cls", "classical"):
        raise ValueError(f"unknown limit method {method!r}: cls or classical")
    if not 0.0 < cl < 1.0:
        raise ValueError(f"confidence level {cl} is not inside (0, 1)")

    @F.pandas_udf("double")
    def limit(background: pd.Series, observed: pd.Series) -> pd.Series:
        b, n = background.to_numpy(float), observed.to_numpy(float)
        if len(b) and (np.nanmin(b) < 0 or np.nanmin(n) < 0):
            raise ValueError(f"background {np.nanmin(b)} or count {np.nanmin(n)} is below zero")
        out, known = np.full(len(b), np.nan), np.flatnonzero(~np.isnan(b) & ~np.isnan(n))
        out[known] = poisson.signal_limit(b[known], n[known], 1.0 - cl, method == "cls")
        return pd.Series(out)

    return limit


def limit_scan(points: DataFrame, background: Column, s95: Column, luminosity: float, alpha: float = 0.0, target: float = 2.0) -> DataFrame:
    """INF03: reach of every point against one background and one limit.

    ``background`` and ``s95`` are scalars (literals or one-row subqueries).
    """
    df = points.withColumns({"background_events": background, "required_signal_events": s95})
    b, need, s = F.col("background_events"), F.col("required_signal_events"), F.col("expected_selected")
    has_b, has_s = b > 0, s > 0
    gauss = F.when(has_b, target * F.sqrt(b))
    scale, gscale = F.when(has_s, need / s), F.when(has_s, gauss / s)
    root = F.when(has_b, s / F.sqrt(b))
    return df.withColumns(
        {
            "s_over_sqrt_b": root, "significance_with_systematics": cf.significance(s, b, alpha), "signal_scale_to_95cl": scale,
            "xsec_95cl_fb": F.col("xsec_fb") * scale, "excluded_95cl": s >= need, "gaussian_required_signal_events": gauss,
            "gaussian_signal_scale_to_target": gscale, "gaussian_xsec_target_fb": F.col("xsec_fb") * gscale,
            "gaussian_excluded": F.coalesce(root >= target, F.lit(False)),
            "sigma_eff_error_fb": F.col("expected_selected_error") / luminosity if luminosity > 0 else F.lit(0.0),
        }
    )


# --- least squares --------------------------------------------------------------------
def _normal_sums(df: DataFrame, terms: list[Column], value: Column, error: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sums of the normal equations, one row for each group of ``keys``."""
    k = len(terms)
    names = [f"_t{i}" for i in range(k)]
    rows = df.select(*keys, *[t.alias(n) for t, n in zip(terms, names)], value.alias("_v"), error.alias("_e"))
    rows = rows.selectExpr("*", "1/(_e*_e) AS _w")
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [f"sum(_t{i}*_t{j}*_w) AS g{i}_{j}" for i, j in upper] + [f"sum(_t{i}*_t{j}) AS d{i}_{j}" for i, j in upper]
    return rows.groupBy(*keys).agg(*map(F.expr, ["count(*) AS n", *sums, *[f"sum(_t{i}*_v*_w) AS b{i}" for i in range(k)]]))


def least_squares(df: DataFrame, terms: list[Column], value: Column, error: Column) -> dict:
    """Normal equations in one pass; only k(k+1)/2 + k sums reach the driver."""
    return _solved(_normal_sums(df, terms, value, error).first(), len(terms))


def surface_recovery(surfaces: DataFrame, points: DataFrame) -> DataFrame:
    """INF04: each of the known surfaces (surface, coefficients), taken at the points (c3, d4), is fitted on its own and compared.

    The points share one matrix of normal sums, made in one pass over them; a
    surface's right side is that matrix times its coefficients, so points and
    surfaces are never joined. (surface, coefficients, status, gap): the sum of
    absolute differences of the coefficients, null where the surface could not
    be fitted.
    """
    terms = cf.chebyshev_basis(F.col("c3"), F.col("d4"))
    k, one = len(terms), F.lit(1.0)
    sums = _normal_sums(points.select("c3", "d4"), terms, F.lit(0.0), F.lit(0.1))
    upper = [f"{p}{i}_{j}" for p in "gd" for i in range(k) for j in range(i, k)]
    matrix = sums.select(F.struct("n", *[(F.col(u) * one).alias(u) for u in upper]).alias("m")).scalar()
    rows = surfaces.select("surface", "coefficients", matrix.alias("m"))

    def solve(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                c, m = row["coefficients"], row["m"]
                known = np.array(c, float) if c is not None and None not in c and len(c) == k else np.full(k, np.nan)
                fit = {"status": "skipped", "coefficients": None}
                if np.isfinite(known).all():
                    side = np.array([[m[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)]) @ known
                    fit = _solved(m | {f"b{i}": float(v) for i, v in enumerate(side)}, k)
                gap = None if fit["coefficients"] is None else float(np.abs(known - fit["coefficients"]).sum())
                out.append({"surface": row["surface"], "coefficients": c, "status": fit["status"], "gap": gap})
            schema = pa.schema([batch.schema.field("surface"), ("coefficients", pa.list_(pa.float64())), ("status", pa.string()), ("gap", pa.float64())])
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.mapInArrow(solve, f"surface {rows.schema['surface'].dataType.simpleString()}, coefficients array<double>, status string, gap double")


def _solved(got, k: int) -> dict:
    if got["n"] < k:
        return {"status": "skipped", "n_points": got["n"], "n_terms": k, "coefficients": None}
    full = lambda p: np.array([[got[f"{p}{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    gram, plain = full("g"), full("d")
    size = np.sqrt(np.diag(gram))
    size[size == 0] = 1.0  # scaling keeps the small solve well conditioned
    coef = np.linalg.lstsq(gram / np.outer(size, size), np.array([got[f"b{i}"] for i in range(k)]) / size, rcond=None)[0] / size
    eig = np.clip(np.linalg.eigvalsh(plain), 0, None)
    return {
        "status": "ok", "n_points": got["n"], "n_terms": k, "coefficients": [float(c) for c in coef], "rank": int(np.linalg.matrix_rank(gram)),
        "condition": float(np.sqrt(eig[-1] / eig[0])) if eig[0] > 0 else float("inf"),
        "singular_values": [float(v) for v in np.sqrt(np.clip(np.linalg.eigvalsh(gram), 0, None))[::-1]],
    }


def fit_surface(points: DataFrame, terms=cf.CHEB_TERMS, k3=cf.K3_RANGE, k4=cf.K4_RANGE) -> DataFrame:
    """INF04: weighted surface fit over (c3, d4, value, error) as one row."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = points.filter(finite("c3") & finite("d4") & finite("value"))
    err = F.when(F.col("error") > 0, F.col("error")).otherwise(F.greatest(F.abs("value") * 0.05, F.lit(1e-30)))
    rows = rows.withColumn("error", err)
    fit = least_squares(rows, cf.chebyshev_basis(F.col("c3"), F.col("d4"), terms, k3, k4), F.col("value"), F.col("error"))
    lit = lambda v, t: F.lit(v).cast(t)
    arr = lambda v: F.array(*[F.lit(x) for x in v]) if v else F.lit(None).cast("array<double>")
    if fit["status"] != "ok":
        return rows.sparkSession.range(1).select(F.lit("skipped").alias("status"), lit(fit["n_points"], "long").alias("n_points"), lit(fit["n_terms"], "int").alias("n_terms"), arr(None).alias("coefficients"))
    coef = arr(fit["coefficients"])
    res = F.col("value") - cf.evaluate_surface(F.col("c3"), F.col("d4"), coef, terms, k3, k4)
    dof = max(fit["n_points"] - fit["n_terms"], 1)
    return rows.withColumn("_r", res).agg(
        F.lit("ok").alias("status"), F.count("*").alias("n_points"), F.lit(fit["n_terms"]).alias("n_terms"), F.lit(fit["rank"]).alias("rank"),
        F.lit(fit["condition"]).alias("condition"), (F.sum(F.pow(F.col("_r") / F.col("error"), 2)) / dof).alias("chi2_dof"),
        coef.alias("coefficients"), arr(fit["singular_values"]).alias("singular_values"),
        F.sqrt(F.avg(F.col("_r") * F.col("_r"))).alias("residual_rms"), F.max(F.abs("_r")).alias("max_abs_residual"),
    )


def fitted_points(points: DataFrame, coefficients: Column, luminosity: float, background: Column, s95: Column) -> DataFrame:
    """INF05: fitted value clipped at zero, with significance and exclusion."""
    s = F.lit(luminosity) * F.greatest(F.lit(0.0), cf.evaluate_surface(F.col("c3"), F.col("d4"), coefficients))
    df = points.withColumns({"fitted_events": s, "_b": background, "_n": s95})
    return df.withColumns(
        {"fitted_s_over_sqrt_b": F.when(F.col("_b") > 0, F.col("fitted_events") / F.sqrt("_b")), "fitted_excluded": F.col("fitted_events") >= F.col("_n")}
    ).drop("_b", "_n")


def fit_coupling_polynomial(points: DataFrame, model: str = "c3d4", weighted: bool = True) -> DataFrame:
    """INF12: linear coupling model, weighted (cross-section) or not (efficiency)."""
    cols = {v: F.col(v) for v in ("c3", "d4", "ct1", "ct2", "ct3") if v in points.columns}
    fit = least_squares(points, cf.basis(model, cols), F.col("value"), F.col("error") if weighted else F.lit(1.0))
    rows = [(model, i, t, c) for i, (t, c) in enumerate(zip(cf.MODELS[model].split(), fit["coefficients"] or []))]
    return points.sparkSession.createDataFrame(rows, "model string, i int, term string, coefficient double")


def fit_residual_report(points: DataFrame, fitted: Column, tolerance: float = 0.2) -> DataFrame:
    """AGG34: mean |x - fit| / x over non-zero values, and how many exceed it."""
    rel = F.abs(F.col("value") - fitted) / F.col("value")
    df = points.filter(F.col("value") != 0).withColumn("_rel", rel)
    return df.agg(F.count("*").alias("n"), F.avg("_rel").alias("mean_rel"), F.count(F.when(F.col("_rel") > tolerance, 1)).alias("n_flagged"))


# --- curves -----------------------------------------------------------------------------
def inside_polygon(points: DataFrame, x: str, y: str, vertices: list[tuple[float, float]]) -> DataFrame:
    """INF10: even-odd label against a published polyline given as a parameter."""
    edges = list(zip(vertices, vertices[1:] + vertices[:1]))
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in edges:
        if y1 == y2:
            continue
        straddles = (F.lit(y1) > F.col(y)) != (F.lit(y2) > F.col(y))
        at = F.lit(x1) + (F.col(y) - F.lit(y1)) * F.lit((x2 - x1) / (y2 - y1))
        crossings = crossings + (straddles & (F.col(x) < at)).cast("int")
    return points.withColumn("inside", crossings % 2 == 1)
