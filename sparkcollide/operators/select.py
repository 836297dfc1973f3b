"""Jet acceptance, multiplicities and candidate selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcollide.functions import noise
from sparkcollide.functions.kinematics import Vec, delta_r_rap, snap
from sparkcollide.operators.ranking import leading_n
from sparkcollide.session import cut_lineage
from sparkcollide.sources.fixtures import JET_KEYS

# Acceptance and overlap cuts of the analysis.
PT_MIN, ETA_MAX = 20.0, 2.5
OVERLAP_DR = 0.05


def with_pt_eta(df: DataFrame) -> DataFrame:
    v = Vec.cols()
    return df.withColumns({"pt": snap(v.pt()), "eta": v.eta()})


def jet_acceptance(df: DataFrame, pt_min: float = PT_MIN, eta_max: float = ETA_MAX) -> DataFrame:
    """FLT01: strict pT and |pseudorapidity| cuts on unsmeared jets."""
    return with_pt_eta(df).filter((F.col("pt") > pt_min) & (F.abs("eta") < eta_max))


def smear_energy(df: DataFrame, seed: int = 42, sigma_scale: float = 1.0) -> DataFrame:
    """SCL09: Gaussian energy smearing with massless momentum along (eta, phi)."""
    if sigma_scale == 0:
        return df
    v = Vec.cols()
    e, eta, phi = v.e, v.eta(), v.phi()
    # Stochastic and constant resolution terms by region.
    central = F.sqrt(F.pow(e * 0.05, 2) + e * 1.5**2)
    forward = F.sqrt(F.pow(e * 0.13, 2) + e * 2.7**2)
    sigma = F.when(F.abs(eta) <= 3.0, central).when(F.abs(eta) <= 5.0, forward).otherwise(0.0)
    draw = noise.gaussian(seed, F.col("event_id"), *[F.col(k) for k in JET_KEYS])
    out = df.withColumns({"_es": F.greatest(F.lit(1e-6), e + sigma * sigma_scale * draw), "_eta": eta, "_phi": phi})
    pt = F.col("_es") / F.cosh("_eta")
    out = out.withColumns(
        {"px": pt * F.cos("_phi"), "py": pt * F.sin("_phi"), "pz": pt * F.sinh("_eta"), "e": F.col("_es")}
    ).drop("_es", "_eta", "_phi")
    return with_pt_eta(out)


def efficiency_accept(df: DataFrame, seed: int = 7) -> DataFrame:
    """SCL10: keep a jet when a keyed uniform is below the pT-dependent efficiency."""
    # Efficiency 0.75 rising by 0.2 per 30 GeV, clipped to [0, 1].
    eps = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.75 + F.lit(0.95 - 0.75) * F.col("pt") / (50.0 - 20.0)))
    u = noise.uniform(seed, F.col("event_id"), *[F.col(k) for k in JET_KEYS])
    return df.withColumn("epsilon", eps).filter(u <= eps)


def pt_order() -> list[Column]:
    return [F.col("pt").desc(), *[F.col(k).asc() for k in JET_KEYS]]


def multiplicities(df: DataFrame) -> DataFrame:
    """Accepted jets per event and tag; partial counts before the shuffle."""
    return df.groupBy("event_id").agg(
        *[F.count(F.when(F.col("tag") == t, 1)).alias(f"n_{t}") for t in ("b", "c", "l")]
    )


def require_multiplicity(counts: DataFrame, c: int = 0, l: int = 0, total: int = 8) -> DataFrame:
    """FLT02: enough true b, c-tagged and light candidates."""
    return counts.filter(
        (F.col("n_b") >= total - c - l) & (F.col("n_c") >= c) & (F.col("n_l") >= l)
        & (F.col("n_b") + F.col("n_c") + F.col("n_l") >= total)
    )


def leading_jets(df: DataFrame, n: int) -> DataFrame:
    """WIN02: first n jets by descending pT per event."""
    return leading_n(df, ["event_id"], pt_order(), n)


JET_FIELDS = ("e", "px", "py", "pz", "pt")
DERIVED = ("0.5D*ln((e+pz)/(e-pz)) AS y", "atan2(py,px) AS phi")


def gather(df: DataFrame, n: int, name: str = "jets") -> DataFrame:
    """At most ``n`` ranked rows per event (already limited) into one array."""
    item = F.struct("rn", *JET_FIELDS, "y", "phi")
    return (
        df.selectExpr("event_id", "rn", *JET_FIELDS, *DERIVED)
        .groupBy("event_id")
        .agg(F.sort_array(F.collect_list(item)).alias(name))
        .filter(F.size(name) == n)
    )


def _near_any(sel: Column, v: Vec, dr: float) -> Column:
    y, phi = v.rapidity(), v.phi()
    return F.exists(sel, lambda s: delta_r_rap(y, phi, s["y"], s["phi"]) < dr)


def overlap_removal(df: DataFrame, selected: DataFrame, name: str, dr: float = OVERLAP_DR) -> DataFrame:
    """JN03: drop rows within ``dr`` of any selected jet of the same event.

    ``selected`` holds one bounded array per event, so the row side can be
    split freely when an event is hot.
    """
    joined = df.join(selected, "event_id")
    return joined.filter(~_near_any(F.col(name), Vec.cols(), dr)).drop(name)


def select_candidates(jets: DataFrame, c: int = 0, l: int = 0, total: int = 8, compat_light_zero: bool = False) -> DataFrame:
    """ARR04: leading true b + c + light candidates, merged and cut to ``total``.

    With ``compat_light_zero`` a light limit of zero admits every light jet
    that does not overlap, as the analysis executable does.
    """
    keep = ["event_id", *JET_KEYS, "tag", *JET_FIELDS]
    jets = jets.select(*keep)
    # events with too few jets of a kind drop out before their jets are shuffled; the others are read several times
    counts = multiplicities(jets)
    enough = cut_lineage(counts.filter((F.col("n_b") >= total - c - l) & (F.col("n_c") >= c) & (F.col("n_l") >= l)).select("event_id"), "enough")
    jets = cut_lineage(jets.join(enough, "event_id", "left_semi"), "candidates")
    b = leading_jets(jets.filter(F.col("tag") == "b"), total - c - l)
    b_sel = gather(b, total - c - l, "b_sel")
    out = b.join(b_sel.select("event_id"), "event_id", "left_semi").select(*keep)
    if c == 0 and l == 0 and not compat_light_zero:
        return leading_jets(out, total)
    others = overlap_removal(jets.filter(F.col("tag") != "b"), b_sel, "b_sel")
    required = b_sel.select("event_id")
    light_base = others.filter(F.col("tag") == "l")
    if c:
        cs = leading_jets(others.filter(F.col("tag") == "c"), c)
        c_sel = gather(cs, c, "c_sel")
        required = c_sel.select("event_id")
        out = out.unionByName(cs.select(*keep))
        light_base = overlap_removal(light_base, c_sel, "c_sel")
    if l:
        ls = leading_jets(light_base, l)
        required = gather(ls, l, "l_sel").select("event_id")
        out = out.unionByName(ls.select(*keep))
    elif compat_light_zero:
        # only the leading ``total`` can survive the final cut
        out = out.unionByName(leading_jets(light_base, total).select(*keep))
    return leading_jets(out.join(required, "event_id", "left_semi"), total)
