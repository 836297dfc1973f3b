"""Particle-list queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkcollide.functions import kinematics as kin
from sparkcollide.functions.kinematics import Vec
from sparkcollide.operators import particles as ops
from sparkcollide.plans import sqltext as S
from sparkcollide.plans.registry import query
from sparkcollide.sources import fixtures

R = S.rnd
K3 = "l_linenumber, l_partkey, l_suppkey"
P = f"WITH {S.JETS}, {S.PARTICLES}"
ORD = "ORDER BY round(pt,9) DESC, l_linenumber, l_partkey, l_suppkey"


def r(c, n=6):
    return F.round(c, n)


def rows(spark, sf):
    return ops.with_order_pt(fixtures.particles(spark, sf))


def nth_sql(name: str, flavour: int, item: int) -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id {ORD}) AS rk FROM parts WHERE pid={flavour}) WHERE rk={item + 1})"


def lead_sql(n: int) -> str:
    return f"""ld AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id {ORD}) AS rk FROM parts) WHERE rk<={n}), fe AS (SELECT event_id FROM ld GROUP BY event_id HAVING count(*)={n})"""


@query("SCL01_four_vector_basics", f"{P} SELECT event_id, {K3}, {R('pt')} AS pt, {R('p')} AS p, {R('et')} AS et, {R('eta')} AS eta, {R('y')} AS y, {R('phi')} AS phi, {R('sqrt(abs(e*e-pz*pz))')} AS mt, {R('pz/p')} AS cos_theta FROM parts")
def scl01(spark, sf):
    v = Vec.cols()
    obs = {"pt": v.pt(), "p": v.p(), "et": v.et(), "eta": v.eta(), "y": v.rapidity(), "phi": v.phi(), "mt": v.mt(), "cos_theta": v.cos_theta()}
    return fixtures.particles(spark, sf).select("event_id", *fixtures.JET_KEYS, *[r(c).alias(n) for n, c in obs.items()])


RANGES = {"pt": (30, 60), "et": (25, 70), "eta": (-1.3, 1.9), "abs_eta": (0.5, 2.1), "y": (-2.0, 0.7), "abs_y": (0.1, 1.5), "phi": (-1.0, 2.0)}
SQLVAR = {"pt": "pt", "et": "et", "eta": "eta", "abs_eta": "abs(eta)", "y": "y", "abs_y": "abs(y)", "phi": "phi"}


@query("FLT09_select_particles", f"{P} " + " UNION ALL ".join(f"SELECT '{k}' AS var, event_id, {K3} FROM parts WHERE {SQLVAR[k]} BETWEEN {a} AND {b}" for k, (a, b) in RANGES.items()))
def flt09(spark, sf):
    return ops.select_particles_each(fixtures.particles(spark, sf), RANGES).select("var", "event_id", *fixtures.JET_KEYS)


for _mode, _cond in ((0, "true"), (1, "(pid<>5 OR (parts.l_linenumber=h.l_linenumber AND parts.l_partkey=h.l_partkey AND parts.l_suppkey=h.l_suppkey))")):

    @query(f"FLT10_select_event_by_nth_mode{_mode}", f"{P}, {nth_sql('h0', 5, 1)}, h AS (SELECT * FROM h0 WHERE pt BETWEEN 25 AND 50) SELECT parts.event_id, parts.l_linenumber, parts.l_partkey, parts.l_suppkey FROM parts JOIN h ON parts.event_id=h.event_id WHERE {_cond.replace('pid', 'parts.pid')}")
    def flt10(spark, sf, mode=_mode):
        return ops.select_event_by_nth(rows(spark, sf), 5, 1, "pt", 25, 50, mode).select("event_id", *fixtures.JET_KEYS)


AB = f"{nth_sql('a', 5, 0)}, {nth_sql('b', -5, 0)}, ab AS (SELECT a.event_id, {', '.join(f'a.{c} AS {c}1, b.{c} AS {c}2' for c in ('e', 'px', 'py', 'pz', 'pt', 'p', 'eta', 'y', 'et'))} FROM a JOIN b ON a.event_id=b.event_id)"
COS_T = "least(1, greatest(-1, (px1*px2+py1*py2)/(pt1*pt2)))"
SUMV = {"e": "(e1+e2)", "px": "(px1+px2)", "py": "(py1+py2)", "pz": "(pz1+pz2)"}
S_PT = "sqrt(pow(px1+px2,2)+pow(py1+py2,2))"
S_M = "sqrt(abs(pow(e1+e2,2)-pow(px1+px2,2)-pow(py1+py2,2)-pow(pz1+pz2,2)))"
S_Y = "CAST(0.5 AS DOUBLE)*ln((e1+e2+pz1+pz2)/(e1+e2-pz1-pz2))"
PAIR_SQL = {
    "dphi_deg": f"acos({COS_T})/pi()*180", "deta": "abs(eta1-eta2)", "eta_product": "eta1*eta2", "dy": "abs(y1-y2)", "y_product": "y1*y2", "centrality": f"abs({S_Y})",
    "mass": S_M, "mt": "sqrt(abs(pow(e1+e2,2)-pow(pz1+pz2,2)))", "mt2": "sqrt(greatest(CAST(0 AS DOUBLE), 2*(pt1*pt2-px1*px2-py1*py2)))", "pair_pt": S_PT,
    "dr": f"sqrt(pow(eta1-eta2,2)+pow(acos({COS_T}),2))", "et_fraction": "et1/et2",
}
PAIR_RANGE = {"dphi_deg": (30, 150), "deta": (0.3, 2.1), "eta_product": (-1, 1.3), "dy": (0.3, 2.1), "y_product": (-1, 1.3), "centrality": (0.11, 1.03), "mass": (40, 120), "mt": (60, 130), "mt2": (30, 100), "pair_pt": (20, 90), "dr": (0.5, 2.7), "et_fraction": (0.7, 1.6)}
OBS_SQL = {
    "mass": S_M, "pt": S_PT, "mean_pt": "(pt1+pt2)/2", "eta": f"asinh((pz1+pz2)/{S_PT})", "y": S_Y, "deta": "abs(eta1-eta2)", "dy": "abs(y1-y2)",
    "angle": "acos(least(1, greatest(-1, (px1*px2+py1*py2+pz1*pz2)/(p1*p2))))", "phi": "atan2(py1+py2, px1+px2)", "dphi": f"acos({COS_T})",
    "dr": f"sqrt(pow(eta1-eta2,2)+pow(acos({COS_T}),2))", "phi_star": f"CASE WHEN acos({COS_T}) > 0.000001 THEN tan((pi()-acos({COS_T}))/2)*sin(tanh((eta1-eta2)/2)) END", "dpt": "pt1-pt2", "rpt": "pt1/pt2", "et_fraction": "et1/et2",
}


@query("FLT11_select_event_by_pair", f"{P}, {AB} " + " UNION ALL ".join(f"SELECT '{k}' AS var, event_id FROM ab WHERE round({PAIR_SQL[k]}, 9) BETWEEN {a} AND {b}" for k, (a, b) in PAIR_RANGE.items()))
def flt11(spark, sf):
    pair = ops.item_pair(rows(spark, sf), (5, 0), (-5, 0))
    hits = [F.when(ops.pair_in_range(k, lo, hi), F.lit(k)) for k, (lo, hi) in PAIR_RANGE.items()]
    return pair.select(F.explode(F.array_compact(F.array(*hits))).alias("var"), "event_id")


@query("SCL04_pair_observables", f"{P}, {AB} SELECT event_id, {', '.join(f'{R(q, 5)} AS {k}' for k, q in OBS_SQL.items())} FROM ab")
def scl04(spark, sf):
    pair = ops.item_pair(rows(spark, sf), (5, 0), (-5, 0))
    a, b = Vec.cols("a_"), Vec.cols("b_")
    return pair.select("event_id", *[r(fn(a, b), 5).alias(k) for k, fn in ops.PAIR_OBSERVABLES.items()])


@query("SCL03_delta_r_addon", f"{P}, {AB} SELECT event_id, {R(PAIR_SQL['dr'], 5)} AS dr FROM ab")
def scl03(spark, sf):
    pair = ops.item_pair(rows(spark, sf), (5, 0), (-5, 0))
    return pair.select("event_id", r(kin.delta_r_eta(Vec.cols("a_"), Vec.cols("b_")), 5).alias("dr"))


@query("FLT12_select_by_ht", f"{P} SELECT event_id, {R('sum(pt)')} AS ht FROM parts GROUP BY event_id HAVING sum(pt) BETWEEN 100.3 AND 250.3")
def flt12(spark, sf):
    return ops.select_by_ht(fixtures.particles(spark, sf), 100.3, 250.3).select("event_id", r("ht").alias("ht"))


@query(
    "FLT13_isolation_veto",
    f"""{P}, rf AS (SELECT * FROM parts WHERE abs(pid)=11), ls AS (SELECT * FROM parts WHERE abs(pid)<>11),
 cone AS (SELECT rf.event_id, rf.l_linenumber, rf.l_partkey, rf.l_suppkey, sum(ls.et) AS et FROM (SELECT DISTINCT * FROM rf) rf JOIN ls ON rf.event_id=ls.event_id
   WHERE sqrt(pow(rf.eta-ls.eta,2)+pow(acos(least(1,greatest(-1,(rf.px*ls.px+rf.py*ls.py)/(rf.pt*ls.pt)))),2)) < 0.8 GROUP BY rf.event_id, rf.l_linenumber, rf.l_partkey, rf.l_suppkey, rf.pt, rf.phi, rf.eta)
 SELECT DISTINCT event_id FROM parts WHERE event_id NOT IN (SELECT event_id FROM cone WHERE et > 40)""",
)
def flt13(spark, sf):
    p = fixtures.particles(spark, sf)
    return ops.isolation_veto(p.filter("abs(pid) = 11"), p.filter("abs(pid) <> 11"), 0.8, 40.0)


@query("FLT14_extract_nth", f"{P}, {nth_sql('h', 5, 0)} SELECT parts.event_id, parts.l_linenumber, parts.l_partkey, parts.l_suppkey FROM parts JOIN h ON parts.event_id=h.event_id WHERE NOT (parts.l_linenumber=h.l_linenumber AND parts.l_partkey=h.l_partkey AND parts.l_suppkey=h.l_suppkey AND h.pt BETWEEN 40 AND 70)")
def flt14(spark, sf):
    return ops.extract_nth(rows(spark, sf), 5, 0, "pt", 40, 70).select("event_id", *fixtures.JET_KEYS)


KINDS = {"charged": "abs(pid) IN (5,11,211)", "neutral": "abs(pid) NOT IN (5,11,211)", "hadron": "abs(pid)=211", "charged_hadron": "abs(pid)=211", "parton": "abs(pid) IN (5,21)", "strong": "abs(pid) IN (5,21)", "not_lepton": "abs(pid) NOT IN (11,12)", "charged_pion": "abs(pid)=211", "lepton": "abs(pid) IN (11,12)"}


@query("FLT15_qualify_particles", f"{P} " + " UNION ALL ".join(f"SELECT '{k}' AS kind, pid, count(*) AS n FROM parts WHERE {c} GROUP BY pid" for k, c in KINDS.items()))
def flt15(spark, sf):
    p = fixtures.particles(spark, sf)
    hits = F.array_compact(F.array(*[F.when(ops.qualify(k, F.col("pid")), F.lit(k)) for k in KINDS]))
    return p.select(F.explode(hits).alias("kind"), "pid").groupBy("kind", "pid").agg(F.count("*").alias("n"))


for _key, _sql in (("pt", "pt"), ("eta", "eta"), ("phi", "phi")):

    @query(
        f"TOP01_order_particles_{_key}",
        f"{P} SELECT 'forward' AS direction, event_id, {K3}, row_number() OVER (PARTITION BY event_id ORDER BY round({_sql},9) DESC, {K3}) AS rank FROM parts "
        f"UNION ALL SELECT 'reverse', event_id, {K3}, row_number() OVER (PARTITION BY event_id ORDER BY round({_sql},9), l_linenumber DESC, l_partkey DESC, l_suppkey DESC) FROM parts",
    )
    def top01(spark, sf, key=_key):
        p = fixtures.particles(spark, sf)
        both = [ops.order_particles(p, key, reverse=back).select(F.lit(name).alias("direction"), "event_id", *fixtures.JET_KEYS, "rank") for name, back in (("forward", False), ("reverse", True))]
        return both[0].unionByName(both[1])


@query("SET02_merge_particle_lists", f"{P}, m AS (SELECT 'jets' AS list, event_id, pt FROM parts WHERE tag='b' UNION ALL SELECT 'leptons', event_id, pt FROM parts WHERE abs(pid)=11) SELECT list, event_id, count(*) AS n, {R('sum(pt)')} AS sum_pt FROM m GROUP BY list, event_id")
def set02(spark, sf):
    p = rows(spark, sf)
    m = ops.merge_lists({"jets": p.filter("tag = 'b'"), "leptons": p.filter("abs(pid) = 11")})
    return m.groupBy("list", "event_id").agg(F.count("*").alias("n"), r(F.sum("pt")).alias("sum_pt"))


def _sum_sql(k: int) -> str:
    return ", ".join(f"sum(CASE WHEN rk<={k} THEN {c} END) AS {c}{k}" for c in ("e", "px", "py", "pz"))


def _item_sql() -> str:
    return ", ".join(f"max(CASE WHEN rk={i} THEN {c} END) AS i{i}{c}" for i in range(1, 5) for c in ("e", "px", "py", "pz"))


MPT = lambda k: f"sqrt(px{k}*px{k}+py{k}*py{k})"
MM = lambda k: f"e{k}*e{k}-px{k}*px{k}-py{k}*py{k}-pz{k}*pz{k}"
ETA_A = "asinh(pz2/sqrt(px2*px2+py2*py2))"
ETA_3 = "asinh(i3pz/sqrt(i3px*i3px+i3py*i3py))"
DPHI_3 = "acos(least(1,greatest(-1,(px2*i3px+py2*i3py)/(sqrt(px2*px2+py2*py2)*sqrt(i3px*i3px+i3py*i3py)))))"
N1 = ("(i1py*i2pz-i1pz*i2py)", "(i1pz*i2px-i1px*i2pz)", "(i1px*i2py-i1py*i2px)")
N2 = ("(i3py*i4pz-i3pz*i4py)", "(i3pz*i4px-i3px*i4pz)", "(i3px*i4py-i3py*i4px)")
SCL05 = {
    "three_pt": MPT(3), "three_y": "CAST(0.5 AS DOUBLE)*ln((e3+pz3)/(e3-pz3))", "three_mass": f"sqrt(abs({MM(3)}))", "three_mass2": MM(3), "three_deta": f"abs({ETA_A}-{ETA_3})",
    "three_dphi": DPHI_3, "three_dr": f"sqrt(pow({ETA_A}-{ETA_3},2)+pow({DPHI_3},2))", "four_pt": MPT(4), "four_mass": f"sqrt(abs({MM(4)}))",
    "plane_angle": f"({'+'.join(a + '*' + b for a, b in zip(N1, N2))})/(sqrt({'+'.join(f'{a}*{a}' for a in N1)})*sqrt({'+'.join(f'{a}*{a}' for a in N2)}))",
    "pair_pt_difference": "sqrt(px2*px2+py2*py2)-sqrt(pow(px4-px2,2)+pow(py4-py2,2))", "six_pt": MPT(6), "six_et": f"e6*{MPT(6)}/sqrt(px6*px6+py6*py6+pz6*pz6)", "six_mass": f"sqrt(abs({MM(6)}))",
}


@query("SCL05_multi_particle_observables", f"{P}, {lead_sql(6)}, sm AS (SELECT event_id, {_sum_sql(2)}, {_sum_sql(3)}, {_sum_sql(4)}, {_sum_sql(6)}, {_item_sql()} FROM ld JOIN fe USING (event_id) GROUP BY event_id) SELECT event_id, {', '.join(f'{R(q, 4)} AS {k}' for k, q in SCL05.items())} FROM sm")
def scl05(spark, sf):
    lead = ops.leading_array(rows(spark, sf), 6)
    return lead.select("event_id", *[r(c, 4).alias(k) for k, c in ops.multi_observables().items()])


@query("SCL06_charge_weighted_deta", f"{P}, q AS (SELECT a.event_id, {R('CASE WHEN a.pid=11 THEN -1 ELSE 1 END*(round(b.eta,9)-round(a.eta,9))')} AS value FROM parts a JOIN parts b ON a.event_id=b.event_id AND abs(a.pid)=11 AND abs(b.pid)=5) SELECT event_id, value, count(*) AS fills FROM q GROUP BY ALL")
def scl06(spark, sf):
    q = F.when(F.col("pid") == 11, -1).otherwise(1)
    return ops.charge_weighted_deta(fixtures.particles(spark, sf), (11, -11), (5, -5), q).select("event_id", (F.col("value") + 0.0).alias("value"), "fills")


REF = f"{nth_sql('ra', 5, 0)}, {nth_sql('rb', -5, 0)}, rf AS (SELECT event_id, sum(e) AS re, sum(px) AS rx, sum(py) AS ry, sum(pz) AS rz FROM (SELECT event_id,e,px,py,pz FROM ra UNION ALL SELECT event_id,e,px,py,pz FROM rb) GROUP BY event_id HAVING count(*)=2)"


BOOST = f"{P}, {REF}, b AS (SELECT parts.*, re, rx, ry, rz, sqrt(abs(re*re-rx*rx-ry*ry-rz*rz)) AS m, (re*e-px*rx-py*ry-pz*rz)/nullif(sqrt(abs(re*re-rx*rx-ry*ry-rz*rz)),0) AS en FROM parts LEFT JOIN rf USING (event_id))"
BOOST_STATUS = "CASE WHEN re IS NULL THEN 'no_reference' WHEN m > 5 THEN 'ok' ELSE 'light_like' END AS status"
ROTATE = f"{P}, {REF}, n AS (SELECT event_id, rx/sqrt(rx*rx+ry*ry+rz*rz) AS nx, ry/sqrt(rx*rx+ry*ry+rz*rz) AS ny, rz/sqrt(rx*rx+ry*ry+rz*rz) AS nz FROM rf)"
boosted_sql = lambda c: f"CASE WHEN m > 5 THEN {R(f'p{c}-(e+en)/(re+m)*r{c}', 3)} END AS p{c}"
turned_sql = lambda c, o: f"{R(f'nz*p{c}-n{c}*pz+n{o}*(n{o}*p{c}-n{c}*p{o})/(1+nz)', 4)} AS p{c}"
MOMENTUM = ("e", "px", "py", "pz")


def boosted(spark, sf):
    """All events; a nearly light-like reference has no numerically stable rest frame."""
    out = ops.all_to_reference(rows(spark, sf), [(5, 0), (-5, 0)], kin.boost, 5.0)
    return out.select("event_id", *fixtures.JET_KEYS, "status", *[r(c, 3).alias(c) for c in MOMENTUM])


def turned(spark, sf):
    out = ops.all_to_reference(rows(spark, sf), [(5, 0), (-5, 0)], kin.rotate_to_z)
    return out.select("event_id", *fixtures.JET_KEYS, "status", r("e", 5).alias("e"), *[r(c, 4).alias(c) for c in MOMENTUM[1:]])


@query("SCL07_boost_reference", f"{BOOST} SELECT event_id, {K3}, {BOOST_STATUS}, CASE WHEN m > 5 THEN {R('en', 3)} END AS e, {', '.join(map(boosted_sql, 'xyz'))} FROM b")
def scl07b(spark, sf):
    return boosted(spark, sf)


@query(
    "SCL07_rotate_reference",
    f"""{ROTATE} SELECT event_id, {K3}, CASE WHEN nx IS NULL THEN 'no_reference' ELSE 'ok' END AS status, CASE WHEN nx IS NOT NULL THEN {R('e', 5)} END AS e, {turned_sql('x', 'y')}, {turned_sql('y', 'x')}, {R('nx*px+ny*py+nz*pz', 4)} AS pz FROM parts LEFT JOIN n USING (event_id)""",
)
def scl07r(spark, sf):
    return turned(spark, sf)


# without py
@query("SCL07_boost_reference_all", f"{BOOST} SELECT event_id, {K3}, {BOOST_STATUS}, CASE WHEN m > 5 THEN {R('en', 3)} END AS e, {boosted_sql('x')}, {boosted_sql('z')} FROM b")
def scl07ba(spark, sf):
    return boosted(spark, sf).drop("py")


@query(
    "SCL07_rotate_reference_all",
    f"""{ROTATE} SELECT event_id, {K3}, CASE WHEN nx IS NULL THEN 'no_reference' ELSE 'ok' END AS status, CASE WHEN nx IS NOT NULL THEN {R('e', 5)} END AS e, {turned_sql('x', 'y')}, {R('nx*px+ny*py+nz*pz', 4)} AS pz FROM parts LEFT JOIN n USING (event_id)""",
)
def scl07ra(spark, sf):
    return turned(spark, sf).drop("py")


@query("SCL08_missing_momentum", f"{P}, m AS (SELECT event_id, pid, e, px, pz FROM parts WHERE abs(pid)<>12 UNION ALL SELECT event_id, 0, sum(CASE WHEN abs(pid)=12 THEN e ELSE 0 END), sum(CASE WHEN abs(pid)=12 THEN px ELSE 0 END), sum(CASE WHEN abs(pid)=12 THEN pz ELSE 0 END) FROM parts GROUP BY event_id) SELECT event_id, pid, count(*) AS n, {R('sum(e)', 5)} AS e, {R('sum(px)', 5)} AS px, {R('sum(pz)', 5)} AS pz FROM m GROUP BY event_id, pid")
def scl08(spark, sf):
    m = ops.missing_momentum(fixtures.particles(spark, sf), (12,))
    return m.groupBy("event_id", "pid").agg(F.count("*").alias("n"), *[r(F.sum(c), 5).alias(c) for c in ("e", "px", "pz")])


OBS31 = f"""{P}, g AS (SELECT event_id, count(CASE WHEN abs(pid)=11 THEN 1 END) AS nr, count(CASE WHEN abs(pid) IN (5,21) THEN 1 END) AS n, sum(CASE WHEN abs(pid) IN (5,21) THEN et END) AS ht,
 sum(CASE WHEN abs(pid) IN (5,21) THEN e END) AS e, sum(CASE WHEN abs(pid) IN (5,21) THEN px END) AS px, sum(CASE WHEN abs(pid) IN (5,21) THEN py END) AS py, sum(CASE WHEN abs(pid) IN (5,21) THEN pz END) AS pz FROM parts GROUP BY event_id)"""


def observables(spark, sf):
    return ops.event_observables(fixtures.particles(spark, sf), ops.qualify("parton", F.col("pid")), F.abs("pid") == 11)


@query("AGG31_event_observables", f"{OBS31} SELECT event_id, CASE WHEN nr>0 AND n>0 THEN {R('ht')} END AS ht, CASE WHEN nr>0 THEN n END AS multiplicity, CASE WHEN n>1 THEN {R('sqrt(abs(e*e-px*px-py*py-pz*pz))', 4)} END AS list_mass FROM g")
def agg31(spark, sf):
    p = fixtures.particles(spark, sf).groupBy("event_id").agg(F.count(F.when(ops.qualify("parton", F.col("pid")), 1)).alias("k"))
    o = observables(spark, sf).join(p, "event_id")
    # a single massless particle has mass zero up to rounding noise: report from two on
    return o.select("event_id", r("ht").alias("ht"), "multiplicity", F.when(F.col("k") > 1, r("list_mass", 4)).alias("list_mass"))


@query("AGG31_inclusive_multiplicity", f"{OBS31} SELECT CAST(i AS BIGINT) AS value, count(*) AS fills FROM g, range(0,4) t(i) WHERE nr>0 AND i<=n GROUP BY i UNION ALL SELECT CAST(4 AS BIGINT), CAST(sum(n-3) AS BIGINT) FROM g WHERE nr>0 AND n>3")
def agg31i(spark, sf):
    return ops.inclusive_multiplicity(observables(spark, sf), 3)


@query(
    "AGG32_momentum_tensor",
    f"""{P}, s AS (SELECT event_id, sum(p*p) AS d, sum(px*px) AS xx, sum(py*py) AS yy, sum(pz*pz) AS zz, sum(px*py) AS xy, sum(px*pz) AS xz, sum(py*pz) AS yz FROM parts GROUP BY event_id),
 t AS (SELECT event_id, xx/d-1/CAST(3 AS DOUBLE) AS a, yy/d-1/CAST(3 AS DOUBLE) AS b, zz/d-1/CAST(3 AS DOUBLE) AS c, xy/d AS f, xz/d AS g, yz/d AS h FROM s),
 w AS (SELECT *, sqrt((a*a+b*b+c*c+2*(f*f+g*g+h*h))/6) AS w FROM t),
 an AS (SELECT *, acos(least(1,greatest(-1,(a*b*c+2*f*g*h-a*h*h-b*g*g-c*f*f)/(2*w*w*w))))/3 AS th FROM w),
 l AS (SELECT event_id, 1/CAST(3 AS DOUBLE)+2*w*cos(th) AS l1, 1/CAST(3 AS DOUBLE)+2*w*cos(th+2*pi()/3) AS l3 FROM an)
 SELECT event_id, {R('l1', 5)} AS lambda1, {R('1.5*(1-l1)', 5)} AS sphericity, {R('1.5*l3', 5)} AS aplanarity, {R('1-l1-2*l3', 5)} AS planarity FROM l""",
)
def agg32(spark, sf):
    out = ops.momentum_tensor(fixtures.particles(spark, sf))
    return out.select("event_id", *[r(c, 5).alias(c) for c in ("lambda1", "sphericity", "aplanarity", "planarity")])


@query("UDF01_variable_expression", f"{P}, {lead_sql(3)} SELECT event_id, {R('sqrt(pow(max(CASE WHEN rk=1 THEN px END)-max(CASE WHEN rk=3 THEN px END),2)+pow(max(CASE WHEN rk=2 THEN py END),2))')} AS value FROM ld JOIN fe USING (event_id) GROUP BY event_id")
def udf01(spark, sf):
    out = ops.variable_expression(rows(spark, sf), 3, "sqrt(pow(get(p,0).px - get(p,2).px, 2) + pow(get(p,1).py, 2))")
    return out.select("event_id", r("value").alias("value"))
