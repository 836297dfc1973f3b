"""Event reconstruction queries: selection, pairing, features, cut flow, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcollide.functions import noise
from sparkcollide.functions.kinematics import Vec, delta_r_rap
from sparkcollide.operators import cutflow, reco, select
from sparkcollide.plans import sqltext as S
from sparkcollide.plans.registry import query
from sparkcollide.session import scratch_dir
from sparkcollide.sinks import writers
from sparkcollide.sources import detector, fixtures

R = S.rnd
WITH_ACC = f"WITH {S.JETS}, {S.ACC}"
SUM7 = 7  # weights carry seven exact decimals


def r(col, n: int = 6):
    return F.round(col, n)


def accepted(spark: SparkSession, sf: str) -> DataFrame:
    return select.jet_acceptance(fixtures.jets(spark, sf))


def candidates(spark: SparkSession, sf: str, n: int) -> DataFrame:
    return select.gather(select.leading_jets(accepted(spark, sf), n), n)


def reconstructed(spark: SparkSession, sf: str, n: int, arrow: bool = False) -> DataFrame:
    return reco.reconstruct(candidates(spark, sf, n), n, arrow)


def variables(spark: SparkSession, sf: str, n: int = 8) -> DataFrame:
    rows = reconstructed(spark, sf, n).join(fixtures.events_w(spark, sf), "event_id")
    return reco.variables_projection(rows, n)


# --- sources ---------------------------------------------------------------------
@query(
    "SRC07_scan_detector_events",
    f"""WITH {S.JETS} SELECT event_id, count(*) AS n_jets, count(CASE WHEN tag='b' THEN 1 END) AS n_b,
 {R('sum(e)')} AS sum_e, max(CASE WHEN tag='c' THEN 1 ELSE 0 END) AS has_c FROM jets GROUP BY event_id""",
)
def src07(spark, sf):
    path = scratch_dir(spark, "detector")
    detector.write_detector_events(fixtures.jets(spark, sf), path)
    ev = detector.scan_detector_events(spark, [path], nmin=0)
    one = ev.select("event_id", F.explode("jets").alias("j"))
    return one.groupBy("event_id").agg(
        F.count("*").alias("n_jets"),
        F.count(F.when(F.col("j.id") == 5, 1)).alias("n_b"),
        r(F.sum("j.e")).alias("sum_e"),
        F.max(F.when(F.col("j.ctag") > 0, 1).otherwise(0)).alias("has_c"),
    )


# --- filters -----------------------------------------------------------------------
@query(
    "FLT01_jet_acceptance",
    f"{WITH_ACC} SELECT event_id, l_linenumber, l_partkey, l_suppkey, {R('pt')} AS pt, {R('eta')} AS eta FROM acc",
)
def flt01(spark, sf):
    return accepted(spark, sf).select("event_id", *fixtures.JET_KEYS, r("pt").alias("pt"), r("eta").alias("eta"))


MULT_SQL = f"""{WITH_ACC}, m AS (SELECT event_id, count(CASE WHEN tag='b' THEN 1 END) AS n_b, count(CASE WHEN tag='c' THEN 1 END) AS n_c,
 count(CASE WHEN tag='l' THEN 1 END) AS n_l FROM acc GROUP BY event_id)"""


@query("FLT02_require_multiplicity", f"{MULT_SQL} SELECT * FROM m WHERE n_b>=6 AND n_c>=1 AND n_l>=1 AND n_b+n_c+n_l>=8")
def flt02(spark, sf):
    return select.require_multiplicity(select.multiplicities(accepted(spark, sf)), c=1, l=1)


@query(
    "FLT03_split_by_tag",
    f"""{WITH_ACC} SELECT event_id, count(CASE WHEN tag='c' THEN 1 END) AS n_charm, count(CASE WHEN tag='l' THEN 1 END) AS n_light,
 {R("coalesce(sum(CASE WHEN tag='c' THEN pt END),0)")} AS pt_charm, {R("coalesce(sum(CASE WHEN tag='l' THEN pt END),0)")} AS pt_light
 FROM acc WHERE tag <> 'b' GROUP BY event_id""",
)
def flt03(spark, sf):
    rows = accepted(spark, sf).filter(F.col("tag") != "b").withColumn("ctag", F.when(F.col("tag") == "c", 1.0).otherwise(0.0))
    c, light = F.col("ctag") > 0, F.col("ctag") <= 0
    return rows.groupBy("event_id").agg(
        F.count(F.when(c, 1)).alias("n_charm"), F.count(F.when(light, 1)).alias("n_light"),
        r(F.coalesce(F.sum(F.when(c, F.col("pt"))), F.lit(0.0))).alias("pt_charm"),
        r(F.coalesce(F.sum(F.when(light, F.col("pt"))), F.lit(0.0))).alias("pt_light"),
    )


@query(
    "FLT04_all_below_above",
    f"""{WITH_ACC}, {S.top_n('acc', 4)}, c AS (SELECT event_id FROM sel GROUP BY event_id HAVING count(*)=4)
 SELECT event_id, bool_and(pt < CASE rn WHEN 1 THEN 75 WHEN 2 THEN 70 WHEN 3 THEN 63 ELSE 51 END) AS below,
  bool_and(pt > CASE rn WHEN 1 THEN 51 WHEN 2 THEN 39 WHEN 3 THEN 27 ELSE 21 END) AS above FROM sel JOIN c USING (event_id) GROUP BY event_id""",
)
def flt04(spark, sf):
    pts = F.transform("jets", lambda j: j["pt"])
    return candidates(spark, sf, 4).select(
        "event_id",
        reco.all_below(pts, F.array(*[F.lit(float(v)) for v in (75, 70, 63, 51)])).alias("below"),
        reco.all_above(pts, F.array(*[F.lit(float(v)) for v in (51, 39, 27, 21)])).alias("above"),
    )


@query(
    "FLT05_cutflow_flags",
    f"""{WITH_ACC}, {S.top_n('acc', 8)}, {S.reco(8)}
 SELECT event_id, p1 AS pass_drbb, p2 AS pass_pt, p3 AS pass_chi, p4 AS pass_delta_m, p5 AS pass_higgs_pt, p6 AS pass_dr_bb, p7 AS pass_dr_hh FROM flags""",
)
def flt05(spark, sf):
    return reconstructed(spark, sf, 8).select("event_id", *reco.FLAGS)


# --- windows, joins, arrays --------------------------------------------------------
@query(
    "WIN02_leading_n",
    f"{WITH_ACC}, {S.top_n('acc', 8)} SELECT event_id, rn, l_linenumber, l_partkey, l_suppkey, {R('pt')} AS pt FROM sel",
)
def win02(spark, sf):
    return select.leading_jets(accepted(spark, sf), 8).select("event_id", "rn", *fixtures.JET_KEYS, r("pt").alias("pt"))


PAIR_SQL = f"""{WITH_ACC}, {S.top_n('acc', 8)}, f AS (SELECT event_id FROM sel GROUP BY event_id HAVING count(*)=8), s AS (SELECT * FROM sel JOIN f USING (event_id))"""


@query(
    "JN02_pairwise_delta_r",
    f"""{PAIR_SQL} SELECT event_id, i, j, {R('dr')} AS dr FROM (SELECT a.event_id AS event_id, a.rn AS i, b.rn AS j, {S.dr_rap('a', 'b')} AS dr
 FROM s a JOIN s b ON a.event_id=b.event_id AND a.rn<b.rn)""",
)
def jn02(spark, sf):
    n = 8
    rows = reco.with_pairs(candidates(spark, sf, n), n)
    labels = F.expr("array(" + ",".join(f"struct({i + 1} AS i,{j + 1} AS j)" for i, j in reco.pair_index(n)) + ")")
    out = rows.select("event_id", F.explode(F.arrays_zip(labels.alias("ij"), F.col("pair_dr").alias("dr"))).alias("x"))
    return out.select("event_id", F.col("x.ij.i").alias("i"), F.col("x.ij.j").alias("j"), r("x.dr").alias("dr"))


@query(
    "JN03_overlap_removal",
    f"""{WITH_ACC}, {S.top_n('acc', 4, where="tag='b'")}, f AS (SELECT event_id FROM sel GROUP BY event_id HAVING count(*)=4), s AS (SELECT * FROM sel JOIN f USING (event_id)),
 o AS (SELECT acc.* FROM acc JOIN f USING (event_id) WHERE tag <> 'b')
 SELECT event_id, l_linenumber, l_partkey, l_suppkey FROM o WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.event_id=o.event_id AND {S.dr_rap('o', 's')} < 0.4)""",
)
def jn03(spark, sf):
    acc = accepted(spark, sf)
    sel = select.gather(select.leading_jets(acc.filter(F.col("tag") == "b"), 4), 4, "b_sel")
    kept = select.overlap_removal(acc.filter(F.col("tag") != "b"), sel, "b_sel", dr=0.4)
    return kept.select("event_id", *fixtures.JET_KEYS)


@query(
    "JN04_prior_pass_filter",
    f"""{WITH_ACC}, {S.EVENTS_W}, p AS (SELECT event_id FROM acc GROUP BY event_id HAVING count(*)>=6)
 SELECT event_id, sample, evweight FROM ew WHERE event_id IN (SELECT event_id FROM p)""",
)
def jn04(spark, sf):
    acc = select.multiplicities(accepted(spark, sf)).filter(F.col("n_b") + F.col("n_c") + F.col("n_l") >= 6)
    path = scratch_dir(spark, "pass")
    writers.write_pass_list(acc, path)
    return fixtures.events_w(spark, sf).join(spark.read.parquet(path), "event_id", "left_semi").select("event_id", "sample", "evweight")


PAIRING_TEXT = [",".join(f"{a}-{b}" for a, b in match) for match in reco.pairings(8)]


@query(
    "JN06_pairing_cross",
    f"""{WITH_ACC}, {S.top_n('acc', 8)}, f AS (SELECT event_id FROM sel GROUP BY event_id HAVING count(*)=8),
 pairing(idx,p) AS (VALUES {','.join(f"({k},'{t}')" for k, t in enumerate(PAIRING_TEXT))}) SELECT event_id, idx, p AS pairing FROM f, pairing""",
)
def jn06(spark, sf):
    return candidates(spark, sf, 8).select("event_id", F.posexplode(F.array(*[F.lit(t) for t in PAIRING_TEXT])).alias("idx", "pairing"))


@query(
    "ARR01_make_pairings",
    f"""{WITH_ACC}, f AS (SELECT event_id, least(count(*), 8) // 2 * 2 AS n FROM acc GROUP BY event_id)
 SELECT CAST(n AS INT) AS n, count(*) AS n_events, CAST(count(*) * CASE n WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 4 THEN 3 WHEN 6 THEN 15 ELSE 105 END AS BIGINT) AS n_pairings FROM f GROUP BY n""",
)
def arr01(spark, sf):
    m = select.multiplicities(accepted(spark, sf))
    n = F.least(F.col("n_b") + F.col("n_c") + F.col("n_l"), F.lit(8))
    per = m.select((n - n % 2).cast("int").alias("n"))
    count = F.lit(0)
    for k in (2, 4, 6, 8):
        count = F.when(F.col("n") == k, len(reco.pairings(k))).otherwise(count)
    return per.groupBy("n").agg(F.count("*").alias("n_events"), F.sum(count.cast("long")).alias("n_pairings"))


for _n in (4, 8):

    @query(
        f"ARR02_best_reconstruction_n{_n}",
        f"{WITH_ACC}, {S.top_n('acc', _n)}, {S.reco(_n)} SELECT event_id, CAST(idx AS INT) AS idx, {R('chi')} AS chi FROM best",
    )
    def arr02(spark, sf, n=_n):
        rows = reco.best_reconstruction(reco.with_pairs(candidates(spark, sf, n), n), n)
        return rows.select("event_id", F.col("best.idx").alias("idx"), r("best.chi").alias("chi"))

    @query(
        f"UDF02_reconstruct_udf_n{_n}",
        f"{WITH_ACC}, {S.top_n('acc', _n)}, {S.reco(_n)} SELECT event_id, CAST(idx AS INT) AS idx, {R('chi')} AS chi FROM best",
    )
    def udf02(spark, sf, n=_n):
        rows = reco.best_reconstruction_arrow(reco.with_pairs(candidates(spark, sf, n), n), n)
        return rows.select("event_id", F.col("best.idx").alias("idx"), r("best.chi").alias("chi"))


@query(
    "ARR03_candidate_features",
    f"""{WITH_ACC}, {S.top_n('acc', 8)}, {S.reco(8)} SELECT event_id, {R('m8b', 5)} AS m8b, {', '.join(f"{R(f'dm{i}', 5)} AS dm{i}, {R(f'hpt{i}', 5)} AS hpt{i}, {R(f'drbb{i}', 5)} AS drbb{i}" for i in range(1, 5))},
 {', '.join(f"{R(f'drhh{i}{j}', 5)} AS drhh{i}{j}" for i in range(1, 5) for j in range(i + 1, 5))} FROM feat""",
)
def arr03(spark, sf):
    rows = reconstructed(spark, sf, 8)
    ij = [(i, j) for i in range(1, 5) for j in range(i + 1, 5)]
    cols = [r("m8b", 5).alias("m8b")]
    for i in range(4):
        cols += [r(F.col("delta_m")[i], 5).alias(f"dm{i+1}"), r(F.col("higgs_pt")[i], 5).alias(f"hpt{i+1}"), r(F.col("dr_bb")[i], 5).alias(f"drbb{i+1}")]
    cols += [r(F.col("dr_hh")[k], 5).alias(f"drhh{i}{j}") for k, (i, j) in enumerate(ij)]
    return rows.select("event_id", *cols)


ARR04_SQL = f"""{WITH_ACC}, {S.top_n('acc', 6, 'b', "tag='b'")}, bf AS (SELECT event_id FROM b GROUP BY event_id HAVING count(*)=6),
 o AS (SELECT * FROM acc WHERE tag<>'b' AND event_id IN (SELECT event_id FROM bf) AND NOT EXISTS (SELECT 1 FROM b WHERE b.event_id=acc.event_id AND {S.dr_rap('acc', 'b')} < 0.05)),
 {S.top_n('o', 1, 'c', "tag='c'")},
 lb AS (SELECT * FROM o WHERE tag='l' AND event_id IN (SELECT event_id FROM c) AND NOT EXISTS (SELECT 1 FROM c WHERE c.event_id=o.event_id AND {S.dr_rap('o', 'c')} < 0.05)),
 {S.top_n('lb', 1, 'l')},
 u AS (SELECT * EXCLUDE (rn) FROM b UNION ALL SELECT * EXCLUDE (rn) FROM c UNION ALL SELECT * EXCLUDE (rn) FROM l), {S.top_n('u', 8, 'fin', 'event_id IN (SELECT event_id FROM l)')}"""


@query("ARR04_select_candidates", f"{ARR04_SQL} SELECT event_id, rn, tag, {R('pt')} AS pt, l_partkey FROM fin")
def arr04(spark, sf):
    return select.select_candidates(accepted(spark, sf), c=1, l=1).select("event_id", "rn", "tag", r("pt").alias("pt"), "l_partkey")


@query(
    "TOP02_sort_small_arrays",
    f"""{WITH_ACC}, {S.top_n('acc', 4)}, {S.reco(4)} SELECT event_id, {R('dm1', 5)} AS dm1, {R('dm2', 5)} AS dm2, {R('hpt1', 5)} AS hpt1, {R('hpt2', 5)} AS hpt2 FROM feat""",
)
def top02(spark, sf):
    rows = reconstructed(spark, sf, 4)
    return rows.select(
        "event_id", *[r(F.col("delta_m")[i], 5).alias(f"dm{i+1}") for i in range(2)], *[r(F.col("higgs_pt")[i], 5).alias(f"hpt{i+1}") for i in range(2)]
    )


# --- projection, aggregation -------------------------------------------------------
VARS_SQL = f"""{WITH_ACC}, {S.EVENTS_W}, {S.top_n('acc', 8)}, {S.reco(8)},
 jp AS (SELECT event_id, {', '.join(f'max(CASE WHEN rn={i} THEN pt END) AS jet{i}_pt' for i in range(1, 9))} FROM s GROUP BY event_id),
 vars AS (SELECT event_id, sample, label, evweight AS weight, {', '.join(f"{R(f'jet{i}_pt', 5)} AS jet{i}_pt" for i in range(1, 9))}, {R('m8b', 5)} AS m8b, {R('chi', 5)} AS chi8,
 {R('dm1', 5)} AS delta_m_min, {R('dm2', 5)} AS delta_m_med1, {R('dm3', 5)} AS delta_m_med2, {R('dm4', 5)} AS delta_m_max,
 {', '.join(f"{R(f'hpt{i}', 5)} AS higgs{i}_pt, {R(f'drbb{i}', 5)} AS dr_bb_h{i}" for i in range(1, 5))},
 {', '.join(f"{R(f'drhh{i}{j}', 5)} AS dr_hh_{i}{j}" for i in range(1, 5) for j in range(i + 1, 5))} FROM feat JOIN jp USING (event_id) JOIN ew USING (event_id))"""


def rounded_variables(df):
    return df.select("event_id", "sample", "label", "weight", *[r(c, 5).alias(c) for c in reco.feature_names(8)])


@query("PRJ01_variables_projection", f"{VARS_SQL} SELECT * FROM vars")
def prj01(spark, sf):
    return rounded_variables(variables(spark, sf))


def flow_sql(n: int, prefix: str, source: str = "acc") -> str:
    f = lambda p: f"{R(f'sum(CASE WHEN {p} THEN evweight ELSE 0 END)', SUM7)}"
    return f"""{prefix}, {S.EVENTS_W}, {S.top_n(source, n)}, {S.reco(n)}
 SELECT sample, count(*) AS events_in, {R('sum(evweight)', SUM7)} AS w_in, {f('idx IS NOT NULL')} AS w_cands, {f('p1')} AS w_drbb, {f('p2')} AS w_pt, {f('p3')} AS w_chi,
 {f('p4')} AS w_delta_m, {f('p5')} AS w_higgs_pt, {f('p6')} AS w_dr_bb, {f('p7')} AS w_dr_hh, count(CASE WHEN p2 THEN 1 END) AS n_preselection, count(CASE WHEN p7 THEN 1 END) AS n_final
 FROM ew LEFT JOIN flags USING (event_id) GROUP BY sample"""


def round_flow(df):
    keep = {"sample", "events_in", "n_preselection", "n_final"}
    return df.select(*[c if c in keep else r(c, SUM7).alias(c) for c in df.columns])


def flow(spark, sf, n):
    return cutflow.weighted_cutflow(fixtures.events_w(spark, sf), reconstructed(spark, sf, n), ["sample"])


for _n in (4, 8):

    @query(f"AGG01_weighted_cutflow_n{_n}", flow_sql(_n, WITH_ACC))
    def agg01(spark, sf, n=_n):
        return round_flow(flow(spark, sf, n))


@query(
    "AGG01_weighted_cutflow_smeared",
    flow_sql(8, f"WITH {S.JETS}, {S.ACC}, {S.smeared('acc', 'sm')}", "sm"),
)
def agg01s(spark, sf):
    sm = select.smear_energy(accepted(spark, sf))
    rec = reco.reconstruct(select.gather(select.leading_jets(sm, 8), 8), 8)
    return round_flow(cutflow.weighted_cutflow(fixtures.events_w(spark, sf), rec, ["sample"]))


@query(
    "AGG02_efficiencies",
    f"""WITH f AS ({flow_sql(8, WITH_ACC)}) SELECT sample, {R('CASE WHEN w_in<>0 THEN w_pt/w_in ELSE 0 END')} AS eff_preselection,
 {R('CASE WHEN w_in<>0 THEN w_dr_hh/w_in ELSE 0 END')} AS eff_final FROM f""",
)
def agg02(spark, sf):
    out = cutflow.efficiencies(flow(spark, sf, 8))
    return out.select("sample", r("eff_preselection").alias("eff_preselection"), r("eff_final").alias("eff_final"))


# --- kinematic scalars with noise --------------------------------------------------
KEYS = ("l_linenumber", "l_partkey", "l_suppkey")


@query(
    "SCL02_delta_r",
    f"""{WITH_ACC}, {S.top_n('acc', 2)} SELECT event_id, {R('dr')} AS dr FROM (SELECT a.event_id AS event_id, {S.dr_rap('a', 'b')} AS dr
 FROM sel a JOIN sel b ON a.event_id=b.event_id AND a.rn=1 AND b.rn=2)""",
)
def scl02(spark, sf):
    a, b = (Vec.of(reco.at(F.col("jets"), i)) for i in range(2))
    return candidates(spark, sf, 2).select("event_id", r(delta_r_rap(a.rapidity(), a.phi(), b.rapidity(), b.phi())).alias("dr"))


@query(
    "SCL09_smear_energy",
    f"{WITH_ACC}, {S.smeared('acc', 'sm')} SELECT event_id, l_linenumber, l_partkey, l_suppkey, {R('e')} AS e, {R('px')} AS px, {R('pz')} AS pz, {R('sqrt(px*px+py*py)')} AS pt FROM sm",
)
def scl09(spark, sf):
    out = select.smear_energy(accepted(spark, sf))
    return out.select("event_id", *KEYS, *[r(c).alias(c) for c in ("e", "px", "pz")], r(Vec.cols().pt()).alias("pt"))


@query(
    "SCL10_efficiency_accept",
    f"""{WITH_ACC} SELECT event_id, l_linenumber, l_partkey, l_suppkey, {R('eps')} AS epsilon FROM (SELECT *, least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), CAST(0.75 AS DOUBLE)+(CAST(0.95 AS DOUBLE)-CAST(0.75 AS DOUBLE))*pt/30)) AS eps FROM acc)
 WHERE {S.uniform(7, *KEYS)} <= eps""",
)
def scl10(spark, sf):
    return select.efficiency_accept(accepted(spark, sf)).select("event_id", *KEYS, r("epsilon").alias("epsilon"))


@query("NOISE_keyed_uniform", f"WITH {S.JETS} SELECT event_id, l_linenumber, l_partkey, l_suppkey, {R(S.uniform(42, *KEYS), 12)} AS u FROM jets")
def noise_uniform(spark, sf):
    u = noise.uniform(42, F.col("event_id"), *[F.col(k) for k in KEYS])
    return fixtures.jets(spark, sf).select("event_id", *KEYS, r(u, 12).alias("u"))


# --- sinks -------------------------------------------------------------------------
@query("SNK01_write_variables", f"{VARS_SQL} SELECT * FROM vars")
def snk01(spark, sf):
    path = scratch_dir(spark, "variables")
    writers.write_variables(rounded_variables(variables(spark, sf)), path)
    return spark.read.parquet(path)


@query(
    "SNK02_write_cutflow_summary",
    f"""WITH f AS ({flow_sql(8, WITH_ACC)}) SELECT CAST(20 AS DOUBLE) AS pt_cut_gev, CAST(2.5 AS DOUBLE) AS eta_cut, CAST(0.3 AS DOUBLE) AS min_delta_r_jets, CAST(sum(events_in) AS BIGINT) AS mc_events_in,
 {R('sum(w_in)', 5)} AS total_weight_in, CAST(sum(n_preselection) AS BIGINT) AS preselection_mc_events_out, {R('sum(w_pt)/sum(w_in)')} AS preselection_efficiency,
 CAST(sum(n_final) AS BIGINT) AS analysis_mc_events_out, {R('sum(w_dr_hh)/sum(w_in)')} AS analysis_efficiency FROM f""",
)
def snk02(spark, sf):
    path = scratch_dir(spark, "summary")
    writers.write_cutflow_summary(flow(spark, sf, 8), path)
    return writers.read_cutflow_summary(spark, path)


@query("SNK03_write_pass_list", f"{WITH_ACC}, {S.top_n('acc', 8)}, {S.reco(8)} SELECT event_id FROM flags WHERE p3")
def snk03(spark, sf):
    path = scratch_dir(spark, "passlist")
    writers.write_pass_list(reconstructed(spark, sf, 8).filter("pass_chi"), path)
    return spark.read.parquet(path)
