"""Histograms as tables ``(hist, bin, ...)``: every fill is one partial aggregate."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcollide.session import join_null_safe


def bin_left_open(x: Column, lo: float, hi: float, nbins: int) -> Column:
    """Bins ``(lo, hi]`` inside the open range; null outside."""
    idx = (F.ceil((x - F.lit(float(lo))) / F.lit((hi - lo) / nbins)) - 1).cast("int")
    return F.when((x > lo) & (x < hi), idx)


def bin_with_flow(x: Column, lo: float, hi: float, nbins: int, log: bool = False) -> Column:
    """Bins ``[lo, hi)`` numbered from 1; 0 and nbins+1 hold under/overflow."""
    coord = F.log10(x) if log else x
    idx = F.floor((coord - F.lit(float(lo))) / F.lit((hi - lo) / nbins) + 1)
    return F.greatest(F.lit(0), F.least(F.lit(nbins + 1), idx)).cast("int")


def _on_spine(filled: DataFrame, hist: list[str], nbins: int, first: int = 0) -> DataFrame:
    """All bins of every histogram seen; the spine is histograms x bins rows."""
    ids = filled.select(*hist).distinct()
    spine = ids.withColumn("bin", F.explode(F.sequence(F.lit(first), F.lit(first + nbins - 1))))
    return join_null_safe(spine, filled, [*hist, "bin"], "left")


def histogram_1d(df: DataFrame, x: Column, weight: Column, hist: list[str], lo: float, hi: float, nbins: int, unit: bool = False) -> DataFrame:
    """AGG03: weighted contents per bin, empty bins included."""
    filled = df.groupBy(*hist, bin_left_open(x, lo, hi, nbins).alias("bin")).agg(F.sum(weight).alias("content"))
    out = _on_spine(filled, hist, nbins).fillna(0.0, ["content"])
    if unit:
        total = filled.filter(F.col("bin").isNotNull()).groupBy(*hist).agg(F.sum("content").alias("_t"))
        out = join_null_safe(out, total, hist, "left").withColumn(
            "content", F.when(F.col("_t") != 0, F.col("content") / F.col("_t")).otherwise(0.0)
        ).drop("_t")
    return out.withColumn("center", F.lit(float(lo)) + (F.col("bin") + 0.5) * F.lit((hi - lo) / nbins))


def histogram_2d(df: DataFrame, x: Column, y: Column, hist: list[str], xr: tuple, yr: tuple) -> DataFrame:
    """AGG04: counts on two axes with the same edge rule; ranges are (lo, hi, n)."""
    keyed = df.select(*hist, bin_left_open(x, *xr).alias("xbin"), bin_left_open(y, *yr).alias("ybin"))
    return keyed.dropna(subset=["xbin", "ybin"]).groupBy(*hist, "xbin", "ybin").agg(F.count("*").alias("n"))


def profile(df: DataFrame, x: Column, y: Column, hist: list[str], lo: float, hi: float, nbins: int) -> DataFrame:
    """AGG05: mean of y per bin of x."""
    keyed = df.select(*hist, bin_left_open(x, lo, hi, nbins).alias("bin"), y.alias("_y")).dropna(subset=["bin"])
    return keyed.groupBy(*hist, "bin").agg((F.sum("_y") / F.count("*")).alias("mean_y"), F.count("*").alias("n"))


def density_normalise(h: DataFrame, hist: list[str], lo: float, hi: float, nbins: int, factor: float = 1.0, total: DataFrame | None = None) -> DataFrame:
    """AGG06: factor * nbins * content / (total * range).

    ``total`` (hist, total) overrides the in-range content, e.g. with the
    attempted weight.
    """
    if total is None:
        total = h.groupBy(*hist).agg(F.sum("content").alias("total"))
    scaled = F.lit(factor) * nbins * F.col("content") / (F.col("total") * F.lit(float(hi - lo)))
    return h.join(total, hist).withColumn("density", F.when(F.col("total") != 0, scaled).otherwise(0.0))


def histogram_arithmetic(a: DataFrame, b: DataFrame, nbins: int, keep: float = 0.0) -> DataFrame:
    """AGG07: bin-wise sum, difference and ratio of two equal binnings.

    A zero denominator keeps the previous content (``keep``); a bin present
    on only one side means different binnings and is an error.
    """
    both = a.select("bin", F.col("content").alias("a")).join(b.select("bin", F.col("content").alias("b")), "bin", "full")
    ok = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("bin") < nbins)
    a_ok = F.when(ok, F.col("a")).otherwise(F.raise_error(F.lit("histograms have different binnings")).cast("double"))
    return both.withColumn("a", a_ok).select(
        "bin",
        (F.col("a") + F.col("b")).alias("added"),
        (F.col("a") - F.col("b")).alias("subtracted"),
        F.when(F.col("b") != 0, F.col("a") / F.col("b")).otherwise(F.lit(keep)).alias("divided"),
    )


def mode_bin(h: DataFrame, hist: list[str]) -> DataFrame:
    """AGG08: centre of the highest bin, first on ties."""
    return h.groupBy(*hist).agg(F.max_by("center", F.struct("content", -F.col("bin"))).alias("mode_center"))


# --- histograms with statistical errors ----------------------------------------------
def histogram_sumw2(df: DataFrame, x: Column, weight: Column, hist: list[str], lo: float, hi: float, nbins: int,
                    ncount: Column | None = None, log: bool = False) -> DataFrame:
    """AGG09: sums of w and w^2 with under/overflow bins and fill counts.

    Non-finite weights are skipped, zero weights only count as fills, and the
    flow bins keep the largest weight in the w^2 slot.
    """
    finite = df.withColumns({"_w": weight, "_n": ncount if ncount is not None else F.lit(1.0)}).filter(
        ~F.isnan("_w") & (F.abs("_w") < float("inf"))
    )
    fills = finite.groupBy(*hist).agg(F.sum("_n").alias("fills"))
    flow = F.col("bin").isin(0, nbins + 1)
    filled = (
        finite.filter(F.col("_w") != 0)
        .withColumn("bin", bin_with_flow(x, lo, hi, nbins, log))
        .groupBy(*hist, "bin")
        .agg(
            F.sum("_w").alias("y"),
            F.when(flow, F.greatest(F.max("_w"), F.lit(0.0))).otherwise(F.sum(F.col("_w") * F.col("_w"))).alias("y2"),
            F.count("*").alias("n"),
        )
    )
    spine = fills.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(nbins + 1))))
    return join_null_safe(spine, filled, [*hist, "bin"], "left").fillna(0.0, ["y", "y2"]).fillna(0, ["n"])


def finalize(h: DataFrame, width: float) -> DataFrame:
    """AGG10: per-fill, per-width mean and its variance."""
    f, y = F.col("fills"), F.col("y") / (F.col("fills") * width)
    y2 = F.col("y2") / (f * width**2)
    return h.withColumns(
        {
            "y": F.when(f == 0, F.col("y")).otherwise(y),
            "y2": F.when(f == 0, F.col("y2")).when(f > 1, (y2 - y * y) / (f - 1)).otherwise(y2),
        }
    )


def restore(h: DataFrame, width: float) -> DataFrame:
    """AGG10: exact inverse of :func:`finalize`."""
    f = F.col("fills")
    y2 = F.when(f > 1, (f - 1) * F.col("y2") + F.col("y") * F.col("y")).otherwise(F.col("y2"))
    return h.withColumns({"y": F.col("y") * f * width, "y2": y2 * f * width**2})


def histogram_stats(h: DataFrame, hist: list[str], lo: float, hi: float, nbins: int, scale: float = 1.0, log: bool = False) -> DataFrame:
    """AGG11: integral over all bins; average, mean and extrema over inner bins.

    The average advances its bin centre by range/(nbins+2), as the histogram
    class does. The mean weights a bin by its width; on a logarithmic axis
    (``lo`` and ``hi`` are powers of ten) widths grow, with the same steps.
    """
    y = F.col("y") * scale
    inner = F.col("bin").between(1, nbins)
    step = (hi - lo) / (nbins + 2)
    centre = F.lit(float(lo)) + (F.col("bin") - 0.5) * F.lit(step)
    edge = lambda i: F.pow(F.lit(10.0), F.lit(float(lo)) + i * F.lit(step))
    width = edge(F.col("bin")) - edge(F.col("bin") - 1) if log else F.lit(1.0)
    total = F.sum(F.when(inner, y))
    return h.groupBy(*hist).agg(
        (F.sum(y) * F.lit((hi - lo) / nbins)).alias("integral"),
        F.when(total != 0, F.sum(F.when(inner, y * centre)) / total).alias("average"),
        (F.sum(F.when(inner, y * width)) / F.sum(F.when(inner, width))).alias("mean"),
        F.min(F.when(inner & (y != 0), y)).alias("ymin"),
        F.max(F.when(inner, y)).alias("ymax"),
    )


def _fold_opt(keys: list[str]):
    """Pairwise weighting in shard order over sorted rows; a task carries one running value from batch to batch."""

    def run(batches):
        key, acc = None, None
        for batch in batches:
            schema, done = pa.schema([*[batch.schema.field(k) for k in keys], ("y", pa.float64()), ("y2", pa.float64()), ("fills", pa.float64())]), []
            for *here, y, y2, fills in zip(*(batch.column(c).to_pylist() for c in (*keys, "y", "y2", "fills")), strict=True):
                if acc is None or here != key:
                    if acc is not None:
                        done.append((*key, *acc))
                    key, acc = here, (y, y2, fills)
                    continue
                w1, w2 = (v * v / e if e else 0.0 for v, e in (acc[:2], (y, y2)))
                w1, w2 = (w1, w2) if w1 > 0 and w2 > 0 else (1.0, 1.0)
                mean = (acc[0] * w1 + y * w2) / (w1 + w2)
                acc = (mean, mean * mean / (w1 + w2), acc[2] + fills)
            if done:
                yield _columns(done, schema)
        if acc is not None:
            yield _columns([(*key, *acc)], schema)

    return run


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def combine_histograms(shards: DataFrame, hist: list[str], width: float, mode: str = "cmb", factor: float = 1.0) -> DataFrame:
    """AGG12: combine finalized shard histograms (columns shard, bin, y, y2, fills).

    A histogram without fills in any shard is skipped. ``opt`` depends on the
    order of the shards: a bin's rows pass through one task in that order, which
    keeps one running value, so any number of shards fits.
    """
    valid = shards.groupBy(*hist).agg(F.min("fills").alias("_m")).filter(F.col("_m") > 0).drop("_m")
    shards = shards.join(valid, hist, "left_semi")
    key = [*hist, "bin"]
    if mode == "cmb":
        total = restore(shards, width).groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("y", "y2", "fills")])
        return finalize(total, width)
    if mode == "opt":
        rows = shards.select(*key, "shard", F.col("y").cast("double").alias("y"), F.col("y2").cast("double").alias("y2"), F.col("fills").cast("double").alias("fills"))
        kind = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key)
        folded = rows.repartition(*key).sortWithinPartitions(*key, "shard").mapInArrow(_fold_opt(key), f"{kind}, y double, y2 double, fills double")
        return folded.withColumn("fills", F.col("fills").cast(shards.schema["fills"].dataType))
    if mode in ("min", "max"):
        sign = 1 if mode == "min" else -1
        pick = F.min(F.struct((F.col("y") * sign).alias("k"), "shard", "y", "y2"))
        out = shards.groupBy(*key).agg(pick.alias("_p"), F.min_by("fills", "shard").alias("fills"))
        return out.select(*key, F.col("_p.y").alias("y"), F.col("_p.y2").alias("y2"), "fills")
    if mode in ("add", "rescale"):
        k = factor if mode == "rescale" else 1.0
        return shards.groupBy(*key).agg(
            (F.sum("y") * k).alias("y"), (F.sum("y2") * k * k).alias("y2"), F.sum("fills").alias("fills")
        )
    raise ValueError(f"unknown combination mode {mode!r}")


#: Runs on a side of a cell, and histograms in one.
RUNS, HISTS = 256, 32


def _pulls(y: np.ndarray, y2: np.ndarray, ok: np.ndarray, other: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """(bins used, sum, sum of squares of the pulls) of all runs of one side with all of the other; arrays are runs x bins."""
    n, s, s2 = (np.zeros((len(y), len(other[0]))) for _ in range(3))
    for k in range(y.shape[1]):  # one bin of all pairs at a time
        spread = y2[:, k, None] + other[1][None, :, k]
        use = ok[:, k, None] & other[2][None, :, k] & (spread > 0)
        pull = np.where(use, (y[:, k, None] - other[0][None, :, k]) / np.sqrt(np.where(use, spread, 1.0)), 0.0)
        n += use
        s += pull
        s2 += pull * pull
    return n, s, s2


def _cells(shards: DataFrame, hist: list[str], nbins: int) -> DataFrame:
    """Runs as vectors over the inner bins, sent to the cells (i, j) of blocks of runs, i <= j, in which they meet other runs."""
    inner = shards.filter(F.col("bin").between(1, nbins))
    bins = F.sort_array(F.collect_list(F.struct("bin", F.col("y").cast("double").alias("y"), F.col("y2").cast("double").alias("y2"))))
    runs = inner.groupBy(*hist, "shard").agg(bins.alias("bins"))
    blocks = shards.agg(F.greatest(F.lit(1), F.ceil(F.approx_count_distinct("shard") / RUNS)).cast("int").alias("b")).scalar()
    runs = runs.withColumns({"_b": blocks, "_own": F.pmod(F.xxhash64("shard"), F.lit(2**20)).cast("int")}).withColumn("_own", F.col("_own") % F.col("_b"))
    out = runs.withColumn("_to", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    return out.select(*hist, "shard", "bins", F.col("_own").alias("own"), F.least("_own", "_to").alias("i"), F.greatest("_own", "_to").alias("j"))


def _compared(table: pa.Table, i: int, j: int, nbins: int):
    """(left names, right names, n, s, s2, mask of the pairs to report) of one histogram in one cell."""
    own, names = table.column("own").to_numpy(), np.array(table.column("shard").to_pylist(), dtype=object)
    bins = table.column("bins").combine_chunks()
    flat, row = bins.flatten(), np.repeat(np.arange(len(own)), np.asarray(bins.value_lengths()))
    y, y2, there = np.zeros((len(own), nbins)), np.zeros((len(own), nbins)), np.zeros((len(own), nbins), bool)
    at = flat.field("bin").to_numpy(zero_copy_only=False) - 1
    y[row, at], y2[row, at], there[row, at] = (flat.field("y").to_numpy(zero_copy_only=False), flat.field("y2").to_numpy(zero_copy_only=False), True)
    sq = y * y
    ok = there & (np.abs(y2 - sq) > 1e-12 * (np.abs(y2) + np.abs(sq)))
    a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
    n, s, s2 = _pulls(y[a], y2[a], ok[a], (y[b], y2[b], ok[b]))
    shared = (there[a][:, None, :] & there[b][None, :, :]).any(2) if len(a) and len(b) else np.zeros((len(a), len(b)), bool)
    first = names[a][:, None] < names[b][None, :]
    return names[a], names[b], n, s, s2, shared & (first if i == j else True), first


def shard_compatibility(shards: DataFrame, hist: list[str], nbins: int) -> DataFrame:
    """AGG13: rms pull per bin for each pair of runs and histogram.

    Runs meet as vectors in cells of RUNS by RUNS, one histogram a cell; no row
    is made for a bin of a pair. Shards must not be null.
    """
    kind = {f.name: f.dataType.simpleString() for f in shards.schema}
    names = [f"`{h}` {kind[h]}" for h in hist]

    def cell(key, table):
        i, j = key[-2].as_py(), key[-1].as_py()
        left, right, n, s, s2, keep, first = _compared(table, i, j, nbins)
        a, b = np.nonzero(keep)
        low, high = np.where(first[a, b], left[a], right[b]), np.where(first[a, b], right[b], left[a])
        sign = np.where(first[a, b], 1.0, -1.0)  # the pull is earlier less later name
        cols = {h: pa.array([k.as_py()] * len(a), k.type) for h, k in zip(hist, key, strict=False)}
        shard = table.schema.field("shard").type
        return pa.table(cols | {"shard": pa.array(low.tolist(), shard), "shard_b": pa.array(high.tolist(), shard), "n_used": pa.array(n[a, b].astype(np.int64)), "_s": sign * s[a, b], "_s2": s2[a, b]})

    out = _cells(shards, hist, nbins).groupBy(*hist, "i", "j").applyInArrow(cell, ", ".join([*names, f"shard {kind['shard']}", f"shard_b {kind['shard']}", "n_used long, _s double, _s2 double"]))
    n = F.col("n_used")
    out = out.withColumns(
        {"avg_pull": F.when(n > 0, F.col("_s") / n).otherwise(0.0), "rms_pull": F.when(n > 0, F.sqrt(F.col("_s2") / n)).otherwise(0.0)}
    ).drop("_s", "_s2")
    rms = F.col("rms_pull")
    status = (
        F.when(n <= 1, "unchecked").when(rms > INCOMPATIBLE, "incompatible").when(rms == 0, "identical")
        .when(rms < CORRELATED, "correlated").otherwise("compatible")
    )
    return out.withColumn("status", status)


# Rms pulls beyond which runs do not fit or depend on each other.
INCOMPATIBLE, CORRELATED = 1.5, 0.5


def pair_summary(shards: DataFrame, hist: str, nbins: int) -> DataFrame:
    """AGG13: what all histograms together say of each pair of runs.

    (shard, shard_b, n_checked, worst, worst_hist, n_incompatible, least,
    least_hist, n_correlated, status): the largest rms pull above one and the
    smallest below one, with the first histogram in which they occur. A cell
    takes HISTS histograms of two blocks of runs and leaves one row a pair.
    """
    kind = {f.name: f.dataType.simpleString() for f in shards.schema}
    cells = _cells(shards, [hist], nbins)
    groups = cells.agg(F.greatest(F.lit(1), F.ceil(F.approx_count_distinct(hist) / HISTS)).cast("int").alias("g")).scalar()
    cells = cells.withColumn("_g", groups).withColumn("_g", F.pmod(F.xxhash64(hist), F.col("_g")).cast("int"))
    fields = f"shard {kind['shard']}, shard_b {kind['shard']}, n_checked long, worst double, worst_hist {kind[hist]}, n_incompatible long, least double, least_hist {kind[hist]}, n_correlated long"

    def cell(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        own, label = table.column("own").to_numpy(), np.array(table.column(hist).to_pylist(), dtype=object)
        every = np.array(table.column("shard").to_pylist(), dtype=object)
        left, right = np.unique(every[own == i]), np.unique(every[own == j])
        shape = (len(left), len(right))
        count, high, low = (np.zeros(shape, np.int64) for _ in range(3))
        worst, least, worst_at, least_at = np.ones(shape), np.ones(shape), np.full(shape, -1), np.full(shape, -1)
        hists = sorted(set(label.tolist()), key=lambda x: (x is not None, x))
        for k, name in enumerate(hists):
            a_names, b_names, n, _, s2, keep, _ = _compared(table.take(pa.array(np.flatnonzero([x == name for x in label]))), i, j, nbins)
            at = np.ix_(np.searchsorted(left, a_names), np.searchsorted(right, b_names))
            keep &= n > 1
            rms = np.sqrt(np.divide(s2, n, out=np.zeros_like(s2), where=n > 0))
            count[at] += keep
            high[at] += keep & (rms > INCOMPATIBLE)
            low[at] += keep & (rms < CORRELATED)
            for value, where, better in ((worst, worst_at, keep & (rms > worst[at])), (least, least_at, keep & (rms < least[at]))):
                value[at], where[at] = np.where(better, rms, value[at]), np.where(better, k, where[at])
        a, b = np.nonzero(count)
        first = left[a] < right[b] if len(a) else np.zeros(0, bool)
        kind_of = lambda c: table.schema.field(c).type
        named = lambda x: pa.array([hists[k] if k >= 0 else None for k in x[a, b]], kind_of(hist))
        return pa.table({
            "shard": pa.array(np.where(first, left[a], right[b]).tolist(), kind_of("shard")), "shard_b": pa.array(np.where(first, right[b], left[a]).tolist(), kind_of("shard")),
            "n_checked": count[a, b], "worst": worst[a, b], "worst_hist": named(worst_at), "n_incompatible": high[a, b], "least": least[a, b], "least_hist": named(least_at), "n_correlated": low[a, b],
        })

    part = cells.groupBy("_g", "i", "j").applyInArrow(cell, fields)
    at = lambda value, name, sign: F.min_by(name, F.struct((sign * F.col(value)).alias("v"), F.col(name).alias("n"))).alias(name)
    out = part.groupBy("shard", "shard_b").agg(
        F.sum("n_checked").alias("n_checked"), F.max("worst").alias("worst"), at("worst", "worst_hist", -1), F.sum("n_incompatible").alias("n_incompatible"),
        F.min("least").alias("least"), at("least", "least_hist", 1), F.sum("n_correlated").alias("n_correlated"),
    )
    status = F.when(F.col("worst") > INCOMPATIBLE, "incompatible").when(F.col("least") == 0, "identical").when(F.col("least") < CORRELATED, "correlated").otherwise("passed")
    return out.withColumn("status", status)


def ratio_profile(df: DataFrame, x: Column, y: Column, weight: Column, hist: list[str], lo: float, hi: float, nbins: int, density: bool = False, flow: bool = True) -> DataFrame:
    """AGG14: weighted mean of y in bins of x with propagated error; bins 0 and nbins + 1 hold what lies outside, unless ``flow`` is off."""
    df = df.withColumns({"_x": x, "_y": y, "_w": weight})
    fills = df.groupBy(*hist).agg(F.greatest(F.lit(1.0), F.count("*").cast("double")).alias("n"))
    sums = df.withColumn("bin", bin_with_flow(F.col("_x"), lo, hi, nbins)).filter(F.lit(True) if flow else F.col("bin").between(1, nbins)).groupBy(*hist, "bin").agg(
        F.sum(F.col("_y") * F.col("_w")).alias("o"), F.sum(F.pow(F.col("_y") * F.col("_w"), 2)).alias("o2"),
        F.sum("_w").alias("m"), F.sum(F.pow("_w", 2)).alias("m2"),
    )
    n = F.col("n")
    k = F.lit(nbins / (hi - lo) if density else 1.0) / n
    df = sums.join(fills, hist).withColumns({"o": F.col("o") * k, "o2": F.col("o2") * k * k, "m": F.col("m") / n, "m2": F.col("m2") / (n * n)})
    dof = F.greatest(F.lit(1.0), n - 1)
    sig = lambda v, v2: F.sqrt(F.greatest(F.lit(0.0), (n * F.col(v2) - F.col(v) * F.col(v)) / dof))
    val = F.when(F.col("o") == 0, 0.0).otherwise(F.try_divide("o", "m"))
    rel = F.when(F.col("o") == 0, 0.0).otherwise(sig("o", "o2") / F.abs("o") + sig("m", "m2") / F.abs("m"))
    return df.select(*hist, "bin", val.alias("ratio"), F.pow(val * rel, 2).alias("ratio_var"), F.col("m").alias("norm"))


def write_histogram_table(h: DataFrame, path: str) -> None:
    """SNK10: bin centres and contents per title."""
    h.write.option("header", True).csv(path)
