"""Particle-list operators, one row per particle.

Lists are rows, not arrays: selections are row filters or semi joins on the
event key, sums are partial aggregates, and only a bounded number of leading
particles per event is ever put side by side.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcollide.functions import kinematics as kin
from sparkcollide.functions.kinematics import Vec
from sparkcollide.operators.ranking import TILE, distributed_row_number, leading_n, tiled
from sparkcollide.operators.select import pt_order
from sparkcollide.session import cut_lineage
from sparkcollide.sources.fixtures import JET_KEYS

VARIABLES = {
    "pt": lambda v: v.pt(), "et": lambda v: v.et(), "eta": lambda v: v.eta(), "abs_eta": lambda v: F.abs(v.eta()),
    "y": lambda v: v.rapidity(), "abs_y": lambda v: F.abs(v.rapidity()), "phi": lambda v: v.phi(),
}

# Particle classes by absolute id.
CLASSES = {
    "parton": (1, 2, 3, 4, 5, 6, 21), "strong": (1, 2, 3, 4, 5, 6, 21), "lepton": (11, 12, 13, 14, 15, 16),
    "charged_pion": (211,), "neutral_pion": (111,), "charged_kaon": (321,), "neutral_kaon": (311,), "proton_antiproton": (2212,),
    "charged_kstar": (323,), "neutral_kstar": (313,), "rho0": (113,), "eta": (221,), "eta_prime": (331,), "phi": (333,), "omega": (223,),
    "lambda": (3122,), "charged_sigma": (3112,), "charged_xi": (3312,), "neutral_xi": (3322,),
}
CHARGED_HADRONS = (211, 321, 2212, 323, 213, 3112, 3222, 3312, 411, 431, 521)
NEUTRAL_HADRONS = (111, 113, 221, 331, 333, 223, 311, 310, 130, 313, 2112, 3122, 3212, 3322, 421, 511, 531)
CHARGED_OTHERS = (1, 2, 3, 4, 5, 6, 11, 13, 15, 24)


def with_order_pt(df: DataFrame) -> DataFrame:
    return df.withColumn("pt", kin.snap(Vec.cols().pt()))


def select_particles(df: DataFrame, var: str, lo: float, hi: float) -> DataFrame:
    """FLT09: inclusive range on one variable."""
    return df.filter(VARIABLES[var](Vec.cols()).between(lo, hi))


def select_particles_each(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """FLT09 for several variables in one scan: a row for each variable (``var``) whose range a particle is in."""
    hit = [F.when(VARIABLES[var](Vec.cols()).between(lo, hi), F.lit(var)) for var, (lo, hi) in ranges.items()]
    return df.select(F.explode(F.array_compact(F.array(*hit))).alias("var"), *df.columns)


def nth(df: DataFrame, flavour: int | None, item: int) -> DataFrame:
    """The item-th particle (0-based, by descending pT) of a flavour per event."""
    own = df if flavour is None else df.filter(F.col("pid") == flavour)
    return leading_n(own, ["event_id"], pt_order(), item + 1).filter(F.col("rn") == item + 1).drop("rn")


def select_event_by_nth(df: DataFrame, flavour: int, item: int, var: str, lo: float, hi: float, mode: int = 0) -> DataFrame:
    """FLT10: keep events whose item-th particle is in range.

    Mode 1 keeps that particle and the other flavours only.
    """
    hit = select_particles(nth(df, flavour, item), var, lo, hi)
    if mode == 0:
        return df.join(hit.select("event_id"), "event_id", "left_semi")
    others = df.filter(F.col("pid") != flavour).join(hit.select("event_id"), "event_id", "left_semi")
    return others.unionByName(hit.select(*df.columns))


PAIR_VARIABLES = {
    "dphi_deg": lambda a, b: kin.dphi_acos(a, b) / F.pi() * 180.0,
    "deta": kin.deta,
    "eta_product": lambda a, b: a.eta() * b.eta(),
    "dy": lambda a, b: F.abs(a.rapidity() - b.rapidity()),
    "y_product": lambda a, b: a.rapidity() * b.rapidity(),
    "centrality": lambda a, b: F.abs((a + b).rapidity()),
    "mass": lambda a, b: (a + b).mass(),
    "mt": lambda a, b: (a + b).mt(),
    "mt2": kin.mt2_like,
    "pair_pt": lambda a, b: (a + b).pt(),
    "dr": kin.delta_r_eta,
    "et_fraction": lambda a, b: a.et() / b.et(),
}
PAIR_OBSERVABLES = {
    "mass": lambda a, b: (a + b).mass(), "pt": lambda a, b: (a + b).pt(), "mean_pt": lambda a, b: (a.pt() + b.pt()) / 2,
    "eta": lambda a, b: (a + b).eta(), "y": lambda a, b: (a + b).rapidity(), "deta": kin.deta,
    "dy": lambda a, b: F.abs(a.rapidity() - b.rapidity()), "angle": kin.opening_angle, "phi": lambda a, b: (a + b).phi(),
    "dphi": kin.dphi_acos, "dr": kin.delta_r_eta, "phi_star": lambda a, b: F.when(kin.dphi_acos(a, b) > 1e-6, kin.phi_star(a, b)), "dpt": lambda a, b: a.pt() - b.pt(),
    "rpt": lambda a, b: a.pt() / b.pt(), "et_fraction": lambda a, b: a.et() / b.et(),
}


def item_pair(df: DataFrame, first: tuple[int, int], second: tuple[int, int]) -> DataFrame:
    """Two single-row-per-event picks side by side."""
    side = lambda p, spec: nth(df, *spec).select("event_id", *[F.col(c).alias(p + c) for c in ("e", "px", "py", "pz")])
    return side("a_", first).join(side("b_", second), "event_id")


def pair_in_range(var: str, lo: float, hi: float) -> Column:
    """Both ends count as inside; a value is taken to nine decimals, so that one on an end does not hang on the last bits."""
    return F.round(PAIR_VARIABLES[var](Vec.cols("a_"), Vec.cols("b_")), 9).between(lo, hi)


def select_event_by_pair(df: DataFrame, first: tuple[int, int], second: tuple[int, int], var: str, lo: float, hi: float) -> DataFrame:
    """FLT11: keep events whose chosen pair is in range."""
    hit = item_pair(df, first, second).filter(pair_in_range(var, lo, hi))
    return df.join(hit.select("event_id"), "event_id", "left_semi")


def select_by_ht(df: DataFrame, lo: float, hi: float, use_et: bool = False) -> DataFrame:
    """FLT12: events whose scalar sum of pT or ET is in range."""
    v = Vec.cols()
    return df.groupBy("event_id").agg(F.sum(v.et() if use_et else v.pt()).alias("ht")).filter(F.col("ht").between(lo, hi))


SUBCELLS = 8  # per cell side
LEAF = 64  # different particles of a square that is looked into one by one
DEEPEST = 6  # times a square is halved


def isolation_veto(refs: DataFrame, particles: DataFrame, dr: float, emax: float) -> DataFrame:
    """FLT13: events without any reference whose cone holds more than ``emax``.

    Particles are summed per small (eta, phi) square first. Squares are found
    through (event, eta cell, phi cell) with cells no smaller than the cone:
    a square wholly inside the cone counts as its sum, one outside is skipped.
    A square cut by the cone's edge is looked into one by one if it holds at
    most LEAF particles and split into four otherwise, as far down as the
    fullest square asks for, so a dense event costs the cone's outline and not
    its area. Busy squares and their references meet in tiles.
    """
    n_phi = int(2 * 3.141592653589793 / dr)
    v = Vec.cols()
    mom = ("e", "px", "py", "pz")
    cone = v.eta().alias("a_eta"), v.phi().alias("a_phi")
    r = _numbered(refs, dr, n_phi, 0).select("event_id", *_cell(), *JET_KEYS, *cone, *[F.col(c).alias("a_" + c) for c in mom])
    own = [c for c in r.columns if c not in ("ci", "cj")]
    r = r.dropDuplicates()  # equal references have equal cones
    shift = lambda: F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    r = r.withColumn("_s", shift()).withColumn("_t", shift())
    r = r.withColumns({"ci": F.col("ci") + F.col("_s"), "cj": F.pmod(F.col("cj") + F.col("_t"), F.lit(n_phi))}).drop("_s", "_t")
    if n_phi < 3:
        r = r.dropDuplicates()
    # how far down the fullest square asks to go, and whether any cell has more references than a tile
    most = lambda df, keys: df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("n"))
    in_square = lambda df: most(_numbered(df, dr, n_phi, 0), ["event_id", "si", "sj"])
    fullest, asked = (x["n"] or 0 for x in in_square(particles).union(most(r, ["event_id", "ci", "cj"])).collect())
    alike = particles.select("event_id", *mom, v.et().alias("et"))
    if fullest > LEAF:  # copies of a particle count as one
        alike = particles.groupBy("event_id", *mom).agg(F.count("*").alias("copies")).withColumn("et", v.et() * F.col("copies"))
        fullest = in_square(alike).first()["n"]
    depth = min(DEEPEST, max(0, math.ceil(math.log(max(1, fullest) / LEAF, 4))))

    def meet(left, right, keys):
        if asked <= TILE:
            return left.join(right, keys)
        left, right = tiled(left, right, keys)
        return left.join(right, [*keys, "_i", "_j"]).drop("_i", "_j")

    fine = _numbered(alike, dr, n_phi, depth).select("event_id", "si", "sj", "et", *[F.col(c).alias("b_" + c) for c in mom])
    squares = fine.groupBy("event_id", "si", "sj").agg(F.sum("et").alias("sum_et"), F.count("*").alias("n"))
    shares, front = None, None
    for level in range(depth + 1):
        step, last = 1 << (depth - level), level == depth
        here = squares
        if not last:
            here = here.groupBy("event_id", F.floor(F.col("si") / step).cast("int").alias("si"), F.floor(F.col("sj") / step).cast("int").alias("sj"))
            here = here.agg(F.sum("sum_et").alias("sum_et"), F.sum("n").alias("n"))
        if level == 0:
            left, right, keys = r, here.select("*", *_cell()), ["event_id", "ci", "cj"]
        else:
            left, right, keys = front, here.withColumns({"pi": F.floor(F.col("si") / 2).cast("int"), "pj": F.floor(F.col("sj") / 2).cast("int")}), ["event_id", "pi", "pj"]
        near = _placed(meet(left, right, keys), dr, n_phi, level)
        if not last:  # what is settled here, and what goes down
            near = cut_lineage(near.select(*own, "si", "sj", "sum_et", "n", "inside"), "squares")
            front = near.where(~F.col("inside") & (F.col("n") > LEAF)).select(*own, F.col("si").alias("pi"), F.col("sj").alias("pj"))
            near = near.where(F.col("inside") | (F.col("n") <= LEAF))
        # one-by-one rows only for squares on the edge; the others keep their sum
        at = lambda c: F.col(c) if last else F.floor(F.col(c) / step).cast("int")
        rows = fine.select(F.col("event_id"), at("si").alias("si"), at("sj").alias("sj"), "et", *["b_" + c for c in mom])
        close = kin.delta_r_eta(Vec.cols("a_"), Vec.cols("b_")) < dr
        if asked <= TILE:
            named = rows.withColumnsRenamed({"event_id": "_e", "si": "_x", "sj": "_y"})
            same = (F.col("event_id") == F.col("_e")) & (F.col("si") == F.col("_x")) & (F.col("sj") == F.col("_y"))
            full = near.join(named, same & ~F.col("inside") & close, "left")
            found = full.select(*own, F.when(F.col("inside"), F.col("sum_et")).otherwise(F.coalesce("et", F.lit(0.0))).alias("share"))
        else:
            looked = meet(near.where("not inside").select(*own, "si", "sj"), rows, ["event_id", "si", "sj"]).where(close)
            found = near.where("inside").select(*own, F.col("sum_et").alias("share")).unionByName(looked.select(*own, F.col("et").alias("share")))
        shares = found if shares is None else shares.unionByName(found)
    busy = shares.groupBy(*own).agg(F.sum("share").alias("cone_et")).filter(F.col("cone_et") > emax)
    events = particles.select("event_id").unionByName(refs.select("event_id")).distinct()
    return events.join(busy.select("event_id").distinct(), "event_id", "left_anti")


def _sides(dr: float, n_phi: int, level: int) -> tuple[float, float]:
    """Height in eta and width in phi of a square of a level."""
    return dr / (SUBCELLS << level), 2 * math.pi / (n_phi * SUBCELLS << level)


def _numbered(df: DataFrame, dr: float, n_phi: int, level: int) -> DataFrame:
    """Adds the square (si, sj) of each particle."""
    v, (high, wide) = Vec.cols(), _sides(dr, n_phi, level)
    around = F.lit(n_phi * SUBCELLS << level)
    return df.withColumns({"si": F.floor(v.eta() / high).cast("int"), "sj": F.pmod(F.floor((v.phi() + F.pi()) / wide).cast("int"), around)})


def _cell() -> list[Column]:
    """Cells of squares of level 0."""
    return [F.floor(F.col(c) / SUBCELLS).cast("int").alias(n) for n, c in (("ci", "si"), ("cj", "sj"))]


def _placed(near: DataFrame, dr: float, n_phi: int, level: int) -> DataFrame:
    """Squares that touch the cone of their reference, and whether they lie inside."""
    high, wide = _sides(dr, n_phi, level)
    lo, hi = F.col("si") * high, (F.col("si") + 1) * high
    gap = F.abs(F.lit(-1.0) * F.pi() + (F.col("sj") + 0.5) * wide - F.col("a_phi"))
    near = near.withColumn("_d", F.least(gap, 2 * F.pi() - gap))
    eta_min = F.greatest(F.lit(0.0), lo - F.col("a_eta"), F.col("a_eta") - hi)
    eta_max = F.greatest(F.abs(F.col("a_eta") - lo), F.abs(F.col("a_eta") - hi))
    phi_min, phi_max = F.greatest(F.lit(0.0), F.col("_d") - wide / 2), F.least(F.pi(), F.col("_d") + wide / 2)
    eps = 1e-7  # squares this close to the edge are looked into
    near = near.filter(eta_min * eta_min + phi_min * phi_min < (dr + eps) ** 2)
    return near.withColumn("inside", eta_max * eta_max + phi_max * phi_max < max(dr - eps, 0.0) ** 2)


def extract_nth(df: DataFrame, flavour: int | None, item: int, var: str, lo: float, hi: float) -> DataFrame:
    """FLT14: drop the item-th particle when in range; events without it vanish."""
    pick = nth(df, flavour, item).select("event_id", *[F.col(k).alias("_" + k) for k in JET_KEYS], VARIABLES[var](Vec.cols()).alias("_v"))
    same = F.lit(True)
    for k in JET_KEYS:
        same = same & (F.col(k) == F.col("_" + k))
    out = df.join(pick, "event_id").filter(~(same & F.col("_v").between(lo, hi)))
    return out.select(*df.columns)


def qualify(kind: str, pid: Column) -> Column:
    """FLT15: class predicate by particle id."""
    a = F.abs(pid)
    rules = {
        "charged_hadron": a.isin(*CHARGED_HADRONS), "neutral_hadron": a.isin(*NEUTRAL_HADRONS), "hadron": a.isin(*CHARGED_HADRONS, *NEUTRAL_HADRONS),
        "charged": a.isin(*CHARGED_HADRONS, *CHARGED_OTHERS), "neutral": ~a.isin(*CHARGED_HADRONS, *CHARGED_OTHERS), "not_lepton": ~a.isin(*CLASSES["lepton"]),
    }
    return rules[kind] if kind in rules else a.isin(*CLASSES[kind])


def order_particles(df: DataFrame, key: str, reverse: bool = False) -> DataFrame:
    """TOP01: rank within the event by a descending variable, ties by identity.

    Works on order-key ranges, so a hot event is sorted by many tasks.
    """
    df = df.withColumn("_key", kin.snap(VARIABLES[key](Vec.cols())))
    order = (["_key"] + ["-" + k for k in JET_KEYS]) if reverse else (["-_key"] + list(JET_KEYS))
    return distributed_row_number(df, ["event_id"], order, "rank").drop("_key")


def merge_lists(lists: dict[str, DataFrame]) -> DataFrame:
    """SET02: concatenation of named lists."""
    out = None
    for name, df in lists.items():
        df = df.withColumn("list", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def leading_array(df: DataFrame, n: int) -> DataFrame:
    """First n particles per event as a bounded array ``p``."""
    lead = leading_n(df, ["event_id"], pt_order(), n)
    items = F.sort_array(F.collect_list(F.struct("rn", "e", "px", "py", "pz", "pid")))
    return lead.groupBy("event_id").agg(items.alias("p")).filter(F.size("p") == n)


def item_vec(i: int) -> Vec:
    return Vec.of(F.get(F.col("p"), F.lit(i)))


def cross_angle(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    """Cosine between the planes spanned by (a, b) and (c, d)."""
    cross = lambda u, w: (u.py * w.pz - u.pz * w.py, u.pz * w.px - u.px * w.pz, u.px * w.py - u.py * w.px)
    n1, n2 = cross(a, b), cross(c, d)
    dot = n1[0] * n2[0] + n1[1] * n2[1] + n1[2] * n2[2]
    size = lambda n: F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    return F.try_divide(dot, size(n1) * size(n2))


def multi_observables() -> dict[str, Column]:
    """SCL05: three-, four- and six-particle observables of the leading array."""
    v = [item_vec(i) for i in range(6)]
    s3, s4 = v[0] + v[1] + v[2], v[0] + v[1] + v[2] + v[3]
    s6 = s4 + v[4] + v[5]
    a, b = v[0] + v[1], v[2] + v[3]
    return {
        "three_pt": s3.pt(), "three_y": s3.rapidity(), "three_mass": s3.mass(), "three_mass2": s3.m2(), "three_deta": kin.deta(a, v[2]),
        "three_dphi": kin.dphi_acos(a, v[2]), "three_dr": kin.delta_r_eta(a, v[2]), "four_pt": s4.pt(), "four_mass": s4.mass(),
        "plane_angle": cross_angle(v[0], v[1], v[2], v[3]), "pair_pt_difference": a.pt() - b.pt(), "six_pt": s6.pt(), "six_et": s6.et(), "six_mass": s6.mass(),
    }


def charge_weighted_deta(df: DataFrame, first: tuple[int, ...], second: tuple[int, ...], charge: Column) -> DataFrame:
    """SCL06: charge x (eta2 - eta1) over all cross pairs, as weighted values.

    Equal pseudorapidities are counted before they meet, so an event costs
    distinct values times distinct values instead of particles squared. The
    values of a busy event meet in tiles, spread over many tasks.
    """
    eta = kin.snap(Vec.cols().eta())
    one = df.filter(F.col("pid").isin(*first)).groupBy("event_id", charge.alias("q"), eta.alias("eta1")).agg(F.count("*").alias("n1"))
    two = df.filter(F.col("pid").isin(*second)).groupBy("event_id", eta.alias("eta2")).agg(F.count("*").alias("n2"))
    one, two = tiled(one, two, ["event_id"])
    pairs = one.join(two, ["event_id", "_i", "_j"])
    value = F.round(F.col("q") * (F.col("eta2") - F.col("eta1")), 6)
    return pairs.groupBy("event_id", value.alias("value")).agg(F.sum(F.col("n1") * F.col("n2")).alias("fills"))


def pick_items(df: DataFrame, items: list[tuple[int | None, int]]) -> DataFrame:
    """nth() for several (flavour, item) in one scan; a particle wanted twice comes twice.

    Every flavour is a lane of its own (None: all particles), cut to its
    deepest item by one partial group limit.
    """
    deepest: dict[int | None, int] = {}
    for flavour, item in items:
        deepest[flavour] = max(item, deepest.get(flavour, 0))
    lanes = list(deepest)
    own = [F.when(F.lit(True) if f is None else F.col("pid") == f, F.lit(k)) for k, f in enumerate(lanes)]
    rows = df.withColumn("_lane", F.explode(F.array_compact(F.array(*own))))
    led = leading_n(rows, ["event_id", "_lane"], pt_order(), max(deepest.values()) + 1)
    wanted = F.array(*[F.when((F.col("_lane") == lanes.index(f)) & (F.col("rn") == item + 1), F.lit(1)) for f, item in items])
    return led.withColumn("_want", F.explode(F.array_compact(wanted))).drop("_lane", "rn", "_want")


def reference_sum(df: DataFrame, items: list[tuple[int | None, int]]) -> DataFrame:
    """Sum of chosen particles per event (columns r_e, r_px, r_py, r_pz) and how many of them the event has (r_n)."""
    return pick_items(df, items).groupBy("event_id").agg(F.count("*").alias("r_n"), *[F.sum(c).alias("r_" + c) for c in ("e", "px", "py", "pz")])


def _transformed(df: DataFrame, ref: DataFrame, fn) -> DataFrame:
    out = df.join(ref, "event_id")
    v = fn(Vec.cols(), Vec.cols("r_"))
    return out.select(*[c for c in df.columns if c not in ("e", "px", "py", "pz")], v.e.alias("e"), v.px.alias("px"), v.py.alias("py"), v.pz.alias("pz"))


def boost_to(df: DataFrame, items: list[tuple[int, int]]) -> DataFrame:
    """SCL07: momenta in the rest frame of the summed reference."""
    return _transformed(df, reference_sum(df, items), kin.boost)


def rotate_to(df: DataFrame, items: list[tuple[int, int]]) -> DataFrame:
    """SCL07: momenta rotated so that the reference points along +z."""
    return _transformed(df, reference_sum(df, items), kin.rotate_to_z)


def all_to_reference(df: DataFrame, items: list[tuple[int, int]], fn, least_mass: float | None = None) -> DataFrame:
    """SCL07 for all events: boost_to() or rotate_to() by ``fn``, and a status.

    Events that lack one of the references ('no_reference'), and those whose
    reference is no heavier than ``least_mass`` ('light_like'), keep their
    particles, with null momenta.
    """
    ref = reference_sum(df, items).where(F.col("r_n") == len(items)).drop("r_n")
    out = df.join(ref, "event_id", "left")
    light = F.lit(False) if least_mass is None else ~(Vec.cols("r_").mass() > least_mass)
    status = F.when(F.col("r_e").isNull(), "no_reference").when(light, "light_like").otherwise("ok")
    v = fn(Vec.cols(), Vec.cols("r_"))
    momenta = [F.when(status == "ok", x).alias(c) for c, x in (("e", v.e), ("px", v.px), ("py", v.py), ("pz", v.pz))]
    return out.select(*[c for c in df.columns if c not in ("e", "px", "py", "pz")], *momenta, status.alias("status"))


def missing_momentum(df: DataFrame, flavours: tuple[int, ...]) -> DataFrame:
    """SCL08: listed flavours replaced by one pseudo-particle (id 0) per event."""
    lost = F.abs("pid").isin(*flavours)
    kept = df.filter(~lost).select("event_id", "pid", "e", "px", "py", "pz")
    total = df.groupBy("event_id").agg(*[F.sum(F.when(lost, F.col(c)).otherwise(0.0)).alias(c) for c in ("e", "px", "py", "pz")])
    return kept.unionByName(total.withColumn("pid", F.lit(0)))


def event_observables(df: DataFrame, in_list: Column, in_ref: Column) -> DataFrame:
    """AGG31: HT, multiplicity and mass per event; null without references."""
    v = Vec.cols()
    total = lambda c: F.sum(F.when(in_list, F.col(c)).otherwise(0.0)).alias(c)
    g = df.groupBy("event_id").agg(
        F.sum(F.when(in_list, v.et()).otherwise(0.0)).alias("ht"), F.count(F.when(in_list, 1)).alias("mult"), F.count(F.when(in_ref, 1)).alias("n_ref"),
        *[total(c) for c in ("e", "px", "py", "pz")],
    )
    has = F.col("n_ref") > 0
    return g.select(
        "event_id", F.when(has & (F.col("mult") > 0), F.col("ht")).alias("ht"), F.when(has, F.col("mult")).alias("multiplicity"),
        F.when(F.col("mult") > 0, Vec.cols().mass()).alias("list_mass"),
    )


def inclusive_multiplicity(obs: DataFrame, n_max: int) -> DataFrame:
    """AGG31: events filling each value 0..n; larger values go to overflow n_max + 1.

    Events are counted per multiplicity first, so the expansion is at most
    distinct multiplicities x n_max rows.
    """
    per = obs.filter(F.col("multiplicity").isNotNull()).groupBy("multiplicity").agg(F.count("*").alias("n"))
    filled = per.select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("multiplicity"), F.lit(n_max)))).alias("value"))
    over = per.filter(F.col("multiplicity") > n_max).select(
        (F.col("n") * (F.col("multiplicity") - n_max)).alias("n"), F.lit(n_max + 1).cast("long").alias("value")
    )
    return filled.unionByName(over.select("n", "value")).groupBy("value").agg(F.sum("n").alias("fills"))


def momentum_tensor(df: DataFrame, power: float = 2.0) -> DataFrame:
    """AGG32: event-shape eigenvalues from six sums per event, closed form."""
    v = Vec.cols()
    p = v.p()
    scale = F.lit(1.0) if power == 2.0 else F.pow(p, power - 2.0)
    comp = {"xx": v.px * v.px, "yy": v.py * v.py, "zz": v.pz * v.pz, "xy": v.px * v.py, "xz": v.px * v.pz, "yz": v.py * v.pz}
    g = df.groupBy("event_id").agg(F.sum(F.pow(p, power)).alias("_d"), *[F.sum(scale * c).alias("_" + k) for k, c in comp.items()])
    g = g.withColumns({k: F.col("_" + k) / F.col("_d") for k in comp})
    q = (F.col("xx") + F.col("yy") + F.col("zz")) / 3
    g = g.withColumn("q", q).withColumns({"a": F.col("xx") - F.col("q"), "b": F.col("yy") - F.col("q"), "c": F.col("zz") - F.col("q")})
    a, b, c, d, e, f = (F.col(k) for k in ("a", "b", "c", "xy", "xz", "yz"))
    g = g.withColumn("w", F.sqrt((a * a + b * b + c * c + 2 * (d * d + e * e + f * f)) / 6))
    det = a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)
    angle = F.acos(kin.clip(F.try_divide(det, 2 * F.pow("w", 3)), -1, 1)) / 3
    l1 = F.col("q") + 2 * F.col("w") * F.cos(F.coalesce(angle, F.lit(0.0)))
    l3 = F.col("q") + 2 * F.col("w") * F.cos(F.coalesce(angle, F.lit(0.0)) + 2 * F.pi() / 3)
    g = g.withColumns({"lambda1": l1, "lambda3": l3}).withColumn("lambda2", 3 * F.col("q") - F.col("lambda1") - F.col("lambda3"))
    return g.select(
        "event_id", "lambda1", "lambda2", "lambda3", (1.5 * (F.col("lambda2") + F.col("lambda3"))).alias("sphericity"),
        (1.5 * F.col("lambda3")).alias("aplanarity"), (F.col("lambda2") - F.col("lambda3")).alias("planarity"),
    )


def variable_expression(df: DataFrame, n: int, expression: str, name: str = "value") -> DataFrame:
    """UDF01: a user formula in SQL over the leading particles ``p[0] .. p[n-1]``."""
    return leading_array(df, n).select("event_id", F.expr(expression).alias(name))
