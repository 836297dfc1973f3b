"""Pairing search and event features on bounded candidate arrays."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Mass targets by pair position and the ordered cut chain.
TARGETS = (120.0, 115.0, 110.0, 105.0)
MIN_DR, PT_CUT, MAX_CHI = 0.3, 20.0, 60.0
DELTA_M_CUTS = (40.0, 50.0, 60.0, 70.0)
HIGGS_PT_CUTS = (100.0, 100.0, 20.0, 20.0)
MAX_DR_BB, MAX_DR_HH = 3.5, 3.5


def at(array: Column, i) -> Column:
    """Null-tolerant element access, safe when a filter is evaluated late."""
    return F.get(array, i if isinstance(i, Column) else F.lit(i))


@lru_cache
def pairings(n: int) -> tuple[tuple[tuple[int, int], ...], ...]:
    """ARR01: all perfect matchings of ``range(n)`` in the swap-enumeration order.

    The partner of the first free slot runs over the slots to its right; the
    displaced slot takes the partner's place, which fixes the order of ties.
    """

    def matchings(slots: tuple[int, ...]):
        if not slots:
            yield ()
            return
        first, rest = slots[0], slots[1:]
        for k in range(len(rest)):
            left = rest[:k] + (rest[0],) + rest[k + 1:] if k else rest
            for tail in matchings(left[1:]):
                yield ((first, rest[k]), *tail)

    return tuple(matchings(tuple(range(n))))


def pair_index(n: int) -> dict[tuple[int, int], int]:
    return {p: k for k, p in enumerate(combinations(range(n), 2))}


def pairing_sql(n: int) -> str:
    """Array of pairings; each is an array of pair numbers, one per position."""
    pos = pair_index(n)
    rows = (",".join(str(pos[tuple(sorted(p))]) for p in match) for match in pairings(n))
    return "array(" + ",".join(f"array({r})" for r in rows) + ")"


def pinned(values: list[str]) -> str:
    """An array the optimizer keeps as one computed column.

    A bare array constructor is inlined into every element access, which
    would rebuild it inside the pairing lambda; the slice prevents that.
    """
    return f"slice(array({','.join(values)}),1,{len(values)})"


def bound(value: str, name: str, body: str) -> str:
    """``body`` in which ``name`` stands for ``value``.

    A filter on a result is moved below the projections and takes their
    expressions along; a value that lambdas use would then be computed again
    in each of their steps. A lambda's own variable is computed once.
    """
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _delta_r(y1: str, f1: str, y2: str, f2: str) -> str:
    d = f"abs({f2} - {f1})"
    return f"sqrt(({y1}-{y2})*({y1}-{y2}) + pow(if({d} > pi(), 2*pi()-{d}, {d}), 2))"


def _signed_root(x: str) -> str:
    return f"signum({x})*sqrt(abs({x}))"


def with_pairs(df: DataFrame, n: int) -> DataFrame:
    """JN02: masses and separations of the n(n-1)/2 pairs of a bounded array."""
    f = lambda i, c: f"get(jets,{i}).{c}"
    s = lambda i, j, c: f"({f(i, c)}+{f(j, c)})"
    two = list(combinations(range(n), 2))
    sq = lambda i, j: "-".join(f"{s(i, j, c)}*{s(i, j, c)}" for c in ("e", "px", "py", "pz"))
    m2 = pinned([f"({sq(i, j)})" for i, j in two])
    dr = pinned([_delta_r(f(i, "y"), f(i, "phi"), f(j, "y"), f(j, "phi")) for i, j in two])
    df = df.selectExpr("*", f"{m2} AS _m2", f"{dr} AS pair_dr")
    return df.selectExpr("* EXCEPT (_m2)", f"transform(_m2, x -> {_signed_root('x')}) AS pair_m")


def best_reconstruction(df: DataFrame, n: int, targets: tuple[float, ...] = TARGETS) -> DataFrame:
    """ARR02: pairing with the smallest distance to the mass targets.

    Pair masses are computed once per event; the search then only adds
    tabulated squares. Ties go to the first pairing of the enumeration.
    """
    h, npair = n // 2, n * (n - 1) // 2
    wanted = ",".join(f"{t!r}D" for t in targets[:h])
    squares = bound("pair_m", "ms", f"flatten(transform(array({wanted}), t -> transform(ms, m -> (m-t)*(m-t))))")
    total = "+".join(f"get(sq, get(p,{i})+{i * npair})" for i in range(h))
    search = bound("_sq", "sq", f"array_min(transform({pairing_sql(n)}, (p, idx) -> named_struct('chi', floor(sqrt({total})*1e9D+0.5D)/1e9D, 'idx', idx)))")
    df = df.selectExpr("*", f"{squares} AS _sq").selectExpr("* EXCEPT (_sq)", f"{search} AS best")
    return df.selectExpr("*", f"get({pairing_sql(n)}, best.idx) AS pairs")


def best_reconstruction_arrow(df: DataFrame, n: int, targets: tuple[float, ...] = TARGETS) -> DataFrame:
    """UDF02: the same search as one vectorised Arrow batch per task slice."""
    h, npair = n // 2, n * (n - 1) // 2
    pos = pair_index(n)
    table = [[pos[tuple(sorted(p))] for p in match] for match in pairings(n)]

    @F.pandas_udf("chi double, idx int")
    def search(masses: pd.Series) -> pd.DataFrame:
        import numpy as np

        if not len(masses):
            return pd.DataFrame({"chi": pd.Series(dtype="float64"), "idx": pd.Series(dtype="int32")})
        m = np.stack(masses.to_numpy()).reshape(len(masses), npair)
        lookup = np.asarray(table)
        total = np.zeros((len(m), len(lookup)))
        for i in range(h):
            total += (m[:, lookup[:, i]] - targets[i]) ** 2
        chi = np.floor(np.sqrt(total) * 1e9 + 0.5) / 1e9
        idx = chi.argmin(axis=1)
        return pd.DataFrame({"chi": chi[np.arange(len(m)), idx], "idx": idx.astype("int32")})

    df = df.withColumn("best", search("pair_m"))
    return df.selectExpr("*", f"get({pairing_sql(n)}, best.idx) AS pairs")


def candidate_features(df: DataFrame, n: int, targets: tuple[float, ...] = TARGETS) -> DataFrame:
    """ARR03 + TOP02: features of the best pairing on bounded arrays."""
    h = n // 2
    two = list(combinations(range(n), 2))
    ends = "array(" + ",".join(f"struct({i} AS i,{j} AS j)" for i, j in two) + ")"
    wanted = ",".join(f"{t!r}D" for t in targets[:h])
    both = lambda c: f"get(jets, get({ends}, k).i).{c} + get(jets, get({ends}, k).j).{c} AS {c}"
    sums = f"transform(pairs, k -> struct({','.join(both(c) for c in ('e', 'px', 'py', 'pz'))}))"
    derived = (
        "transform(_sum, (v, h) -> named_struct('o', -floor(sqrt(v.px*v.px+v.py*v.py)*1e9D+0.5D), 'h', h, 'pt', sqrt(v.px*v.px+v.py*v.py), "
        "'y', 0.5D*ln((v.e+v.pz)/(v.e-v.pz)), 'phi', atan2(v.py,v.px)))"
    )
    tot = lambda c: f"aggregate(jets, 0D, (a, j) -> a + j.{c})"
    df = df.selectExpr(
        "*", f"array_sort(zip_with(pairs, array({wanted}), (k, t) -> abs(get(pair_m, k) - t))) AS delta_m",
        "transform(pairs, k -> get(pair_dr, k)) AS dr_bb", f"{sums} AS _sum",
        f"named_struct('e', {tot('e')}, 'x', {tot('px')}, 'y', {tot('py')}, 'z', {tot('pz')}) AS _t",
    )
    df = df.selectExpr("* EXCEPT (_sum)", f"array_sort({derived}) AS higgs")
    g = lambda i, c: f"get(higgs,{i}).{c}"
    dr = [_delta_r(g(i, "y"), g(i, "phi"), g(j, "y"), g(j, "phi")) for i, j in combinations(range(h), 2)]
    m2 = "(_t.e*_t.e-_t.x*_t.x-_t.y*_t.y-_t.z*_t.z)"
    return df.selectExpr(
        "* EXCEPT (_t)", "transform(higgs, v -> v.pt) AS higgs_pt", f"{pinned(dr)} AS dr_hh", f"{_signed_root(m2)} AS m8b"
    )


def all_below(values: Column, cuts: Column) -> Column:
    """FLT04: element-wise strict upper cut (equality fails)."""
    return F.forall(F.zip_with(values, cuts, lambda a, c: a < c), lambda ok: ok)


def all_above(values: Column, cuts: Column) -> Column:
    return F.forall(F.zip_with(values, cuts, lambda a, c: a > c), lambda ok: ok)


def _cuts(values, n: int) -> str:
    return "array(" + ",".join(f"{float(v)!r}D" for v in list(values)[:n]) + ")"


def cutflow_flags(df: DataFrame, n: int) -> DataFrame:
    """FLT05: each flag is the AND of its own cut and every earlier one."""
    h = n // 2
    every = lambda a, cuts, op: f"forall(zip_with({a}, {cuts}, (x, c) -> x {op} c), ok -> ok)"
    own = [
        f"array_min(pair_dr) >= {MIN_DR}D",
        f"array_min(transform(jets, j -> j.pt)) > {PT_CUT}D",
        f"best.chi < {MAX_CHI}D",
        every("delta_m", _cuts(DELTA_M_CUTS, h), "<"),
        every("higgs_pt", _cuts(HIGGS_PT_CUTS, h), ">"),
        f"array_max(dr_bb) < {MAX_DR_BB}D",
        f"array_max(dr_hh) < {MAX_DR_HH}D",
    ]
    df = df.selectExpr("*", *[f"{cut} AS _c{i}" for i, cut in enumerate(own)])
    chained = [" AND ".join(f"_c{j}" for j in range(i + 1)) + f" AS {name}" for i, name in enumerate(FLAGS)]
    return df.selectExpr(f"* EXCEPT ({','.join(f'_c{i}' for i in range(len(own)))})", *chained)


FLAGS = ("pass_drbb", "pass_pt", "pass_chi", "pass_delta_m", "pass_higgs_pt", "pass_dr_bb", "pass_dr_hh")


def feature_names(n: int = 8) -> list[str]:
    h = n // 2
    dm = ["delta_m_min", "delta_m_med1", "delta_m_med2", "delta_m_max"] if h == 4 else [f"delta_m_{i+1}" for i in range(h)]
    return (
        [f"jet{i+1}_pt" for i in range(n)] + ["m8b", "chi8"] + dm + [f"higgs{i+1}_pt" for i in range(h)]
        + [f"dr_hh_{i+1}{j+1}" for i, j in combinations(range(h), 2)] + [f"dr_bb_h{i+1}" for i in range(h)]
    )


def variables_projection(df: DataFrame, n: int = 8) -> DataFrame:
    """PRJ01: flat variable row (28 features for n = 8) plus the weight."""
    h = n // 2
    values = (
        [at(F.col("jets"), i)["pt"] for i in range(n)] + [F.col("m8b"), F.col("best.chi")]
        + [at(F.col("delta_m"), i) for i in range(h)] + [at(F.col("higgs_pt"), i) for i in range(h)]
        + [at(F.col("dr_hh"), i) for i in range(h * (h - 1) // 2)] + [at(F.col("dr_bb"), i) for i in range(h)]
    )
    return df.select(
        "event_id", "sample", "label", F.col("evweight").alias("weight"),
        *[v.alias(name) for v, name in zip(values, feature_names(n))],
    )


def reconstruct(cands: DataFrame, n: int, arrow: bool = False) -> DataFrame:
    """Candidate arrays -> pairing -> features -> flags."""
    search = best_reconstruction_arrow if arrow else best_reconstruction
    return cutflow_flags(candidate_features(search(with_pairs(cands, n), n), n), n)
