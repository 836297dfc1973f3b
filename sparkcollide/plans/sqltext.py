"""SQL fragments shared by the oracle texts (written independently of the operators)."""

from __future__ import annotations


def rnd(expr: str, n: int = 6) -> str:
    return f"(round({expr}, {n}) + CAST(0 AS DOUBLE))"


JETS = """jets AS (
 SELECT *, pt0*cos(phi0) AS px, pt0*sin(phi0) AS py,
   pt0*(exp(eta0)-exp(-eta0))/2 AS pz, pt0*(exp(eta0)+exp(-eta0))/2 AS e
 FROM (SELECT l_orderkey AS event_id, l_linenumber, l_partkey, l_suppkey,
   CASE WHEN l_linenumber <= 5 THEN 'b' WHEN l_linenumber = 6 THEN 'c' ELSE 'l' END AS tag,
   15 + CAST(1.2 AS DOUBLE)*l_quantity AS pt0,
   (l_discount - CAST(0.05 AS DOUBLE))*CAST(60 AS DOUBLE) AS eta0,
   2*pi()*((l_partkey*7919 + l_suppkey*104729) % 10007)/CAST(10007 AS DOUBLE) AS phi0
  FROM lineitem) j0)"""

PARTICLES = """parts AS (SELECT *,
  CASE l_partkey % 8 WHEN 0 THEN 21 WHEN 1 THEN 11 WHEN 2 THEN -11 WHEN 3 THEN 22 WHEN 4 THEN 211 WHEN 5 THEN 12
    ELSE CASE WHEN l_linenumber % 2 = 0 THEN -5 ELSE 5 END END AS pid,
  sqrt(px*px+py*py) AS pt, sqrt(px*px+py*py+pz*pz) AS p, asinh(pz/sqrt(px*px+py*py)) AS eta,
  CAST(0.5 AS DOUBLE)*ln((e+pz)/(e-pz)) AS y, atan2(py,px) AS phi,
  e*sqrt(px*px+py*py)/sqrt(px*px+py*py+pz*pz) AS et FROM jets)"""

ACC = """allj AS (SELECT *, round(sqrt(px*px+py*py),9) AS pt, round(asinh(pz/sqrt(px*px+py*py)),9) AS eta FROM jets),
acc AS (SELECT * FROM allj WHERE pt > 20 AND abs(eta) < 2.5)"""

EVENTS_W = """ew AS (SELECT o_orderkey AS event_id, c_mktsegment AS sample,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS label, o_totalprice/CAST(100000 AS DOUBLE) AS evweight
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

SAMPLES = """samples AS (SELECT c_mktsegment AS sample, CAST(count(*) AS DOUBLE) AS generated_events,
  CAST(0.01 AS DOUBLE)*(1 + min(c_custkey)) AS xsec_pb,
  CAST(8 - 2*(length(c_mktsegment) % 3) AS INT) AS b_quarks, CAST(length(c_mktsegment) % 3 AS INT) AS c_quarks,
  CAST(length(c_mktsegment) % 3 AS INT) AS light_jets FROM customer GROUP BY c_mktsegment)"""

POINTS = """points AS (SELECT p_partkey % 63 AS point_id, CAST((p_partkey % 63) % 9 - 4 AS DOUBLE)*7.5 AS c3,
  CAST((p_partkey % 63)//9 - 3 AS DOUBLE)*200 AS d4, sum(p_retailprice)/CAST(1000 AS DOUBLE) AS value,
  CAST(count(*) AS INT) AS n FROM part GROUP BY p_partkey % 63)"""

RUNS = """runs AS (SELECT p_partkey, concat_ws('_','run_gg_4h', CAST(p_size AS VARCHAR),
  CAST(CAST((p_partkey % 63) % 9 - 4 AS DOUBLE)*CAST(7.5 AS DOUBLE) AS VARCHAR),
  CAST(CAST((p_partkey % 63)//9 - 3 AS DOUBLE)*CAST(200 AS DOUBLE) AS VARCHAR)) AS name,
  p_size AS grp, CAST((p_partkey % 63) % 9 - 4 AS DOUBLE)*CAST(7.5 AS DOUBLE) AS c3, CAST((p_partkey % 63)//9 - 3 AS DOUBLE)*CAST(200 AS DOUBLE) AS d4,
  CASE WHEN p_partkey % 4 = 0 THEN 5000 ELSE 10000 END AS generated_events, p_partkey % 5 <> 0 AS has_lhe,
  p_retailprice/CAST(1000 AS DOUBLE) AS xsec_pb FROM part)"""

SCORES = """scores AS (SELECT event_id AS row_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label, user_id AS sample_id,
  CAST(1 AS DOUBLE)/(1 + exp(-(value - 40)/CAST(60 AS DOUBLE))) AS score, CAST(1 + user_id % 7 AS DOUBLE)/10 AS weight FROM events)"""


def uniform(seed: int, *keys: str, draw: int = 0) -> str:
    """Scalar SQL for the keyed uniform draw; keys are integer columns."""
    k = ", ".join(f"CAST(CAST({c} AS BIGINT) AS VARCHAR)" for c in ("event_id", *keys))
    return f"((CAST('0x' || substr(md5(concat_ws('|', '{seed}', '{draw}', {k})), 1, 13) AS BIGINT) + CAST(0.5 AS DOUBLE))/CAST(4503599627370496 AS DOUBLE))"


def smeared(source: str, name: str, seed: int = 42) -> str:
    keys = ("l_linenumber", "l_partkey", "l_suppkey")
    g = f"sqrt(-2*ln({uniform(seed, *keys)}))*cos(2*pi()*{uniform(seed, *keys, draw=1)})"
    return f"""{name}0 AS (SELECT *, greatest(CAST(0.000001 AS DOUBLE), e + CASE
   WHEN abs(asinh(pz/sqrt(px*px+py*py))) <= 3 THEN sqrt((CAST(0.05 AS DOUBLE)*e)*(CAST(0.05 AS DOUBLE)*e) + CAST(2.25 AS DOUBLE)*e)
   WHEN abs(asinh(pz/sqrt(px*px+py*py))) <= 5 THEN sqrt((CAST(0.13 AS DOUBLE)*e)*(CAST(0.13 AS DOUBLE)*e) + CAST(7.29 AS DOUBLE)*e)
   ELSE 0 END * {g}) AS es, asinh(pz/sqrt(px*px+py*py)) AS eta_t, atan2(py,px) AS phi_t FROM {source}),
 {name} AS (SELECT event_id, l_linenumber, l_partkey, l_suppkey, tag, es AS e, es/cosh(eta_t)*cos(phi_t) AS px, es/cosh(eta_t)*sin(phi_t) AS py,
   es/cosh(eta_t)*sinh(eta_t) AS pz, round(es/cosh(eta_t),9) AS pt FROM {name}0)"""


def top_n(source: str, n: int, name: str = "sel", where: str = "1=1") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id
   ORDER BY pt DESC, l_linenumber, l_partkey, l_suppkey) AS rn FROM {source} WHERE {where}) WHERE rn <= {n})"""


def dr_rap(a: str, b: str) -> str:
    y = lambda v: f"CAST(0.5 AS DOUBLE)*ln(({v}.e+{v}.pz)/({v}.e-{v}.pz))"
    d = f"abs(atan2({b}.py,{b}.px)-atan2({a}.py,{a}.px))"
    return f"sqrt(pow({y(a)}-{y(b)},2) + pow(CASE WHEN {d} > pi() THEN 2*pi()-{d} ELSE {d} END,2))"


def reco(n: int, sel: str = "sel") -> str:
    """CTEs from ranked rows to best pairing, features and flags."""
    from sparkcollide.operators.reco import pairings

    h = n // 2
    targets = "(VALUES (0,120.0),(1,115.0),(2,110.0),(3,105.0)) t(h,tm)"
    vals = ",".join(
        f"({k},{i},{min(a, b) + 1},{max(a, b) + 1})" for k, match in enumerate(pairings(n)) for i, (a, b) in enumerate(match)
    )
    cuts_dm, cuts_pt = (40, 50, 60, 70)[:h], (100, 100, 20, 20)[:h]
    return f"""full_ev AS (SELECT event_id FROM {sel} GROUP BY event_id HAVING count(*) = {n}),
 s AS (SELECT x.* FROM {sel} x JOIN full_ev USING (event_id)),
 pr AS (SELECT a.event_id, a.rn AS i, b.rn AS j,
    CASE WHEN pow(a.e+b.e,2)-pow(a.px+b.px,2)-pow(a.py+b.py,2)-pow(a.pz+b.pz,2) < 0 THEN -1 ELSE 1 END *
    sqrt(abs(pow(a.e+b.e,2)-pow(a.px+b.px,2)-pow(a.py+b.py,2)-pow(a.pz+b.pz,2))) AS m,
    {dr_rap('a', 'b')} AS dr, a.e+b.e AS e, a.px+b.px AS px, a.py+b.py AS py, a.pz+b.pz AS pz
    FROM s a JOIN s b ON a.event_id = b.event_id AND a.rn < b.rn),
 pairing(idx,h,i,j) AS (VALUES {vals}),
 chi AS (SELECT event_id, idx, round(sqrt(sum(pow(m - CAST(tm AS DOUBLE),2))),9) AS chi FROM pairing JOIN {targets} USING (h) JOIN pr USING (i,j) GROUP BY event_id, idx),
 best AS (SELECT event_id, idx, chi FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY chi, idx) AS k FROM chi) WHERE k = 1),
 hg0 AS (SELECT event_id, h, abs(m - CAST(tm AS DOUBLE)) AS dm, dr, e, px, py, pz, sqrt(px*px+py*py) AS hpt
    FROM best JOIN pairing USING (idx) JOIN {targets} USING (h) JOIN pr USING (event_id,i,j)),
 hg AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(hpt,9) DESC, h) AS hr, row_number() OVER (PARTITION BY event_id ORDER BY dm) AS dmr FROM hg0),
 hh AS (SELECT a.event_id, a.hr AS i, b.hr AS j, {dr_rap('a', 'b')} AS dr FROM hg a JOIN hg b ON a.event_id=b.event_id AND a.hr<b.hr),
 f_own AS (SELECT event_id, min(pt) AS ptmin, sum(e) AS se, sum(px) AS sx, sum(py) AS sy, sum(pz) AS sz FROM s GROUP BY event_id),
 f_pr AS (SELECT event_id, min(dr) AS drmin FROM pr GROUP BY event_id),
 f_hg AS (SELECT event_id, {', '.join(f'max(CASE WHEN dmr={i+1} THEN dm END) AS dm{i+1}, max(CASE WHEN hr={i+1} THEN hpt END) AS hpt{i+1}, max(CASE WHEN h={i} THEN dr END) AS drbb{i+1}' for i in range(h))},
    bool_and({' AND '.join(f'(dmr<>{i+1} OR dm<{c})' for i, c in enumerate(cuts_dm))}) AS ok_dm,
    bool_and({' AND '.join(f'(hr<>{i+1} OR hpt>{c})' for i, c in enumerate(cuts_pt))}) AS ok_hpt, max(dr) AS drbbmax FROM hg GROUP BY event_id),
 f_hh AS (SELECT event_id, max(dr) AS drhhmax, {', '.join(f'max(CASE WHEN i={i+1} AND j={j+1} THEN dr END) AS drhh{i+1}{j+1}' for i in range(h) for j in range(i + 1, h))} FROM hh GROUP BY event_id),
 feat AS (SELECT *, CASE WHEN se*se-sx*sx-sy*sy-sz*sz < 0 THEN -1 ELSE 1 END*sqrt(abs(se*se-sx*sx-sy*sy-sz*sz)) AS m8b,
    drmin >= 0.3 AS p1, drmin >= 0.3 AND ptmin > 20 AS p2, drmin >= 0.3 AND ptmin > 20 AND chi < 60 AS p3
    FROM best JOIN f_own USING (event_id) JOIN f_pr USING (event_id) JOIN f_hg USING (event_id) JOIN f_hh USING (event_id)),
 flags AS (SELECT *, p3 AND ok_dm AS p4, p3 AND ok_dm AND ok_hpt AS p5, p3 AND ok_dm AND ok_hpt AND drbbmax < 3.5 AS p6,
    p3 AND ok_dm AND ok_hpt AND drbbmax < 3.5 AND drhhmax < 3.5 AS p7 FROM feat)"""
