"""Dense grids over coupling space: evaluation, intervals, contours."""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcollide.functions import couplings as cf


def axis(lo: float, hi: float, n: int) -> Column:
    """n equally spaced values as an array column."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(lo)) + i * F.lit((hi - lo) / (n - 1)))


def mesh_grid(df: DataFrame, axes: dict[str, tuple[float, float, int]]) -> DataFrame:
    """JN11: every row times the axes; each axis adds its value and its index.

    Only the first axis is exploded before the rows are spread over the
    cluster, so even one surface row fills all tasks and the shuffle carries
    surfaces x first axis. The other axes explode in place; nothing is joined.
    """
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for k, (name, spec) in enumerate(axes.items()):
        df = df.select("*", F.posexplode(axis(*spec)).alias("i_" + name, name))
        if k == 0 and len(axes) > 1:
            df = df.repartition(spread, *[c for c in df.columns if c != "coefficients"])
    return df


def evaluate_grid(surfaces: DataFrame, c3: tuple, d4: tuple, luminosity: float) -> DataFrame:
    """INF06: surface on a c3 x d4 grid, clipped at zero, times luminosity."""
    g = mesh_grid(surfaces, {"c3": c3, "d4": d4})
    value = cf.evaluate_surface(F.col("c3"), F.col("d4"), F.col("coefficients"))
    return g.withColumn("value", value).withColumn("events", F.lit(luminosity) * F.greatest(F.lit(0.0), F.col("value"))).drop("coefficients")


def perturbativity(cells: DataFrame, keys: list[str]) -> DataFrame:
    """INF07: largest partial wave over the energy scan per cell, without a row per energy and without a shuffle."""
    return cells.select(*keys, cf.largest_wave("c3", "d4").alias("max_wave"))


def ratio_grid(grid: DataFrame, at_zero: Column) -> DataFrame:
    """INF08: ratio to the value at the origin; only positive ratios survive.

    Cells of a surface whose value at the origin is not positive have no ratio
    and ``reference_ok`` false; other surfaces are not affected.
    """
    ok = F.coalesce(at_zero > 0, F.lit(False))
    ratio = F.col("value") / F.when(ok, at_zero)
    return grid.withColumns({"reference_ok": ok, "ratio": F.when(ratio > 0, ratio)}).withColumn("log_ratio", F.log10("ratio"))


def log_levels(ratios: DataFrame, keys: list[str]) -> DataFrame:
    """INF08: logarithmic levels that span the positive ratios."""
    r = ratios.filter(F.col("ratio").isNotNull()).groupBy(*keys).agg(
        F.floor(F.log10(F.min("ratio"))).alias("lo"), F.ceil(F.log10(F.max("ratio"))).alias("hi")
    )
    n = F.least(F.lit(80), F.greatest(F.lit(12), (F.col("hi") - F.col("lo")) * 4 + 1)).cast("int")
    return r.withColumn("n_levels", n)


def contour_cells(grid: DataFrame, keys: list[str], level: float, value: str = "events") -> DataFrame:
    """INF09: points where the surface crosses a level between neighbours.

    Windows run along one grid line each, so they hold at most one axis.
    """

    def along(x: str, other: str) -> DataFrame:
        w = Window.partitionBy(*keys, f"i_{other}").orderBy(f"i_{x}")
        g = grid.select(*keys, x, other, f"i_{other}", F.col(value).alias("v"), F.lead(value).over(w).alias("v2"), F.lead(x).over(w).alias("x2"))
        g = g.filter((F.col("v") < level) != (F.col("v2") < level))
        cross = F.col(x) + (level - F.col("v")) / (F.col("v2") - F.col("v")) * (F.col("x2") - F.col(x))
        pos = {x: cross, other: F.col(other)}
        return g.select(*keys, F.lit(x).alias("direction"), pos["c3"].alias("c3"), pos["d4"].alias("d4"))

    return along("c3", "d4").unionByName(along("d4", "c3"))


# --- chi-square and intervals --------------------------------------------------------------
def chisq_grid(grid: DataFrame, keys: list[str], events: Column, sm_events: Column, delta: Column, prior: tuple[str, float] | None = None) -> DataFrame:
    """INF13: ((S_SM - S)/delta)^2 (+ prior) minus the minimum of its surface."""
    chi = F.pow((sm_events - events) / delta, 2)
    if prior is not None:
        chi = chi + F.pow(F.col(prior[0]) / prior[1], 2)
    g = grid.withColumn("chisq", chi)
    low = g.groupBy(*keys).agg(F.min("chisq").alias("_m"))
    return g.join(low, keys).withColumn("delta_chisq", F.col("chisq") - F.col("_m")).drop("_m")


def marginal(grid: DataFrame, keys: list[str], x: str, dx: float, dy: float) -> DataFrame:
    """INF14: normalised posterior density of one axis."""
    g = grid.withColumn("_p", F.exp(-F.col("delta_chisq") / 2))
    m = g.groupBy(*keys, f"i_{x}", x).agg(F.sum("_p").alias("_p"))
    t = m.groupBy(*keys).agg(F.sum("_p").alias("_t"))
    return m.join(t, keys).withColumn("density", F.col("_p") / (F.col("_t") * dx)).drop("_p", "_t")


def posterior_cdf(density: DataFrame, keys: list[str], x: str, dx: float) -> DataFrame:
    """WIN05: cumulative density along one axis, normalised by its last value."""
    w = Window.partitionBy(*keys).orderBy(f"i_{x}")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = density.withColumn("_c", F.sum(F.col("density") * dx).over(run))
    return c.withColumn("cdf", F.col("_c") / F.last("_c").over(full)).drop("_c")


def crossings(curve: DataFrame, keys: list[str], x: str, y: str, level: float) -> DataFrame:
    """WIN06: every linear crossing of a level along a curve."""
    w = Window.partitionBy(*keys).orderBy(f"i_{x}")
    c = curve.select(*keys, x, y, F.lead(x).over(w).alias("_x2"), F.lead(y).over(w).alias("_y2"))
    c = c.filter((F.col(y) < level) != (F.col("_y2") < level))
    return c.select(*keys, (F.col(x) + (level - F.col(y)) / (F.col("_y2") - F.col(y)) * (F.col("_x2") - F.col(x))).alias("crossing"))


def quantile(cdf: DataFrame, keys: list[str], x: str, q: float) -> DataFrame:
    """WIN06: x at cdf = q, clamped to the first and last grid value."""
    inner = crossings(cdf, keys, x, "cdf", q).groupBy(*keys).agg(F.min("crossing").alias("_c"))
    ends = cdf.groupBy(*keys).agg(F.min_by(x, f"i_{x}").alias("_lo"), F.min_by("cdf", f"i_{x}").alias("_c0"), F.max(x).alias("_hi"))
    out = ends.join(inner, keys, "left")
    return out.select(*keys, F.when(F.col("_c0") >= q, F.col("_lo")).otherwise(F.coalesce("_c", "_hi")).alias("quantile"))


def profile_intervals(grid: DataFrame, keys: list[str], x: str, cut: float = 3.84) -> DataFrame:
    """INF15: first and last x whose profiled chi-square is within the cut."""
    p = grid.groupBy(*keys, x).agg(F.min("delta_chisq").alias("_p"))
    ok = F.when(F.col("_p") <= cut, F.col(x))
    return p.groupBy(*keys).agg(F.min(ok).alias("low"), F.max(ok).alias("high"))


REACH = 10  # standard deviations of a prior axis
BLOCK = 64  # cells of one matrix product


def marginalise_4d(surfaces: DataFrame, keys: list[str], model: str, axes: dict[str, tuple[float, float]], priors: dict[str, float], scale: float, delta: float, n: int = 40) -> DataFrame:
    """INF16: two axes with Gaussian priors summed out of a four-axis grid.

    ``surfaces`` has keys and ``coefficients`` of the model; ``axes`` are the two
    that stay (name: range), ``priors`` the two that go (name: deviation). One row
    is made for a cell of the axes that stay. The prior axes are contracted one
    after the other, as logarithms, over blocks of cells: a monomial is a
    product of a part that stays and a part that goes, so a block is one matrix
    product. (i_x1, i_x2, x1, x2, log_p, p, chisq, delta_chisq); chisq is null
    where the density is below the smallest double, log_p is not.
    """
    (one, lim1), (two, lim2) = axes.items()
    (three, s3), (four, s4) = priors.items()
    powers = cf.monomials(model)
    x3, x4 = np.linspace(-REACH * s3, REACH * s3, n), np.linspace(-REACH * s4, REACH * s4, n)
    going = np.stack([np.outer(x3 ** m.get(three, 0), x4 ** m.get(four, 0)).ravel() for m in powers])
    weight = (-0.5 * (x3 / s3)[:, None] ** 2 - 0.5 * (x4 / s4)[None, :] ** 2).ravel()
    constant = -np.log(delta * s3 * s4 * (2 * np.pi) ** 1.5) + np.log((2 * REACH * s3 / n) * (2 * REACH * s4 / n))
    unit = next(k for k, m in enumerate(powers) if not m)

    def contracted(log: np.ndarray) -> np.ndarray:
        top = log.max(-1, keepdims=True)
        return top[..., 0] + np.log(np.exp(log - top).sum(-1))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                c = part.column("coefficients").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                a, b = (part.column(x).to_numpy() for x in ("x1", "x2"))
                stays = np.stack([a ** m.get(one, 0) * b ** m.get(two, 0) for m in powers], axis=1)
                pull = scale * (c[:, unit, None] - (c * stays) @ going) / delta
                log = (weight - 0.5 * pull * pull).reshape(-1, n, n)
                log_p = contracted(contracted(log)) + constant
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in part.schema.names if k != "coefficients"), pa.array(log_p)], names=[*(k for k in part.schema.names if k != "coefficients"), "log_p"])

    cells = mesh_grid(surfaces.select(*keys, "coefficients"), {"x1": (*lim1, n), "x2": (*lim2, n)}).select(*keys, "i_x1", "i_x2", "x1", "x2", "coefficients")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema if f.name != "coefficients")
    m = cells.mapInArrow(run, f"{kind}, log_p double").withColumn("p", F.exp("log_p"))
    # the two-degree chi-square inverse survival function is exactly -2 ln p
    m = m.withColumn("chisq", F.when(F.col("p") > 0, -2 * F.col("log_p")))
    low = m.groupBy(*keys).agg(F.min("chisq").alias("_m"))
    return m.join(low, keys).withColumn("delta_chisq", F.col("chisq") - F.col("_m")).drop("_m")


@F.pandas_udf(T.DoubleType())
def _one_degree(log_p: pd.Series) -> pd.Series:
    """Inverse survival function of chi-square with one degree of freedom, of exp(log_p); null above one."""
    normal = NormalDist()

    def value(x: float) -> float:
        if not x <= 0:
            return float("nan")
        if x > -600:
            return normal.inv_cdf(0.5 * math.exp(x)) ** 2
        z2 = -2 * x
        for _ in range(60):  # p = 2 phi(z) / z (1 - 1/z^2 + 3/z^4 - 15/z^6), far out in the tail
            z2 = -2 * (x - math.log(2)) - math.log(2 * math.pi * z2) + 2 * math.log1p(-1 / z2 + 3 / z2**2 - 15 / z2**3)
        return z2

    return log_p.map(value)


def marginal_1d(marginal: DataFrame, keys: list[str], stays: str, limits: tuple[float, float], n: int = 40) -> DataFrame:
    """INF16: one of the two axes left (``x1`` or ``x2``) summed out as well; ``limits`` are those of the axis that goes.

    (i, x, log_p, chisq, delta_chisq), chi-square of one degree of freedom.
    """
    top = marginal.groupBy(*keys).agg(F.max("log_p").alias("_t"))
    rows = marginal.join(top, keys).groupBy(*keys, F.col(f"i_{stays}").alias("i"), F.col(stays).alias("x"))
    log_p = F.log(F.sum(F.exp(F.col("log_p") - F.col("_t")))) + F.max("_t") + F.lit(math.log((limits[1] - limits[0]) / n))
    out = rows.agg(log_p.alias("log_p")).withColumn("chisq", F.nanvl(_one_degree("log_p"), F.lit(None).cast("double")))
    low = out.groupBy(*keys).agg(F.min("chisq").alias("_m"))
    return out.join(low, keys).withColumn("delta_chisq", F.col("chisq") - F.col("_m")).drop("_m")


def one_d_scan(surfaces: DataFrame, model: str, axes: dict[str, tuple[float, float, int]]) -> DataFrame:
    """INF17: value relative to the origin along each axis, others at zero; null where the origin is zero."""
    zero = {a: F.lit(0.0) for a in axes}
    parts = []
    for a, spec in axes.items():
        g = mesh_grid(surfaces, {"x": spec})
        v = cf.coupling_polynomial(model, {**zero, a: F.col("x")}, F.col("coefficients"))
        parts.append(g.select("surface", F.lit(a).alias("axis"), "x", F.try_divide(v, cf.coupling_polynomial(model, zero, F.col("coefficients"))).alias("ratio")))
    return reduce(lambda p, q: p.unionByName(q), parts)


def correlation_matrix(surfaces: DataFrame, model: str, axes: dict[str, tuple[float, float, int]]) -> DataFrame:
    """INF17: the same ratio on every pair of axes."""
    names = list(axes)
    zero = {a: F.lit(0.0) for a in names}
    base = cf.coupling_polynomial(model, zero, F.col("coefficients"))
    parts = []
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            g = mesh_grid(surfaces, {"x": axes[a], "y": axes[b]})
            v = cf.coupling_polynomial(model, {**zero, a: F.col("x"), b: F.col("y")}, F.col("coefficients"))
            parts.append(g.select("surface", F.lit(f"{a}:{b}").alias("axes"), "x", "y", F.try_divide(v, base).alias("ratio")))
    return reduce(lambda p, q: p.unionByName(q), parts)


# --- persistence ---------------------------------------------------------------------------
def save_fit(fit: DataFrame, path: str) -> None:
    """SNK12: coefficients as an array row."""
    fit.select("surface", "coefficients").write.parquet(path)


def read_fit(spark, path: str, expected: int) -> DataFrame:
    """SNK12: a wrong number of coefficients fails."""
    bad = F.raise_error(F.concat(F.lit(f"expected {expected} coefficients, found "), F.size("coefficients").cast("string"))).cast("array<double>")
    df = spark.read.schema("surface string, coefficients array<double>").parquet(path)
    return df.withColumn("coefficients", F.when(F.size("coefficients") == expected, F.col("coefficients")).otherwise(bad))


def save_grid(grid: DataFrame, path: str, intervals: DataFrame | None = None) -> None:
    """SNK13: contour grid, and the intervals of its axes if there are any."""
    grid.write.parquet(f"{path}/grid")
    if intervals is not None:
        intervals.write.parquet(f"{path}/intervals")


def read_grid(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/grid")


def read_intervals(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/intervals")
