"""Catalogue, sample, yield and run-selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkcollide.functions import text
from sparkcollide.operators import ranking, samples as ops, select
from sparkcollide.plans import sqltext as S
from sparkcollide.plans.event_queries import VARS_SQL, rounded_variables, variables
from sparkcollide.plans.registry import query
from sparkcollide.session import scratch_dir, table
from sparkcollide.sinks import tables as sinks
from sparkcollide.sources import btag, catalogue, fixtures, variables as vsrc

R = S.rnd


def r(c, n=6):
    return F.round(c, n)


# --- variables ------------------------------------------------------------------------------
@query(
    "SRC08_scan_variables",
    f"{VARS_SQL} SELECT event_id, 1 AS label, {R('weight*CAST(2.5 AS DOUBLE)', 8)} AS weight, m8b, chi8, jet1_pt FROM vars WHERE event_id % 7 <> 0 AND event_id % 11 <> 0",
)
def src08(spark, sf):
    v = rounded_variables(variables(spark, sf))
    v = v.withColumns(
        {
            "m8b": F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("m8b")),
            "weight": F.when(F.col("event_id") % 11 == 0, F.lit(float("inf"))).otherwise(F.col("weight")),
        }
    )
    path = scratch_dir(spark, "vars")
    v.write.parquet(path)
    out = vsrc.scan_variables(spark, path, label=1, xsec=2.5)
    return out.select("event_id", "label", r("weight", 8).alias("weight"), "m8b", "chi8", "jet1_pt")


@query("FLT06_finite_rows", "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem WHERE l_discount > 0.005 AND l_tax > 0.005")
def flt06(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_linenumber",
        F.when(F.col("l_discount") > 0.005, F.col("l_quantity") / F.col("l_discount")).otherwise(F.lit(float("nan"))).alias("f1"),
        F.when(F.col("l_tax") > 0.005, F.col("l_quantity") / F.col("l_tax")).otherwise(F.lit(float("inf"))).alias("f2"),
    )
    return vsrc.finite_rows(li, ["f1", "f2"]).agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("s"))


@query("WIN08_first_n_per_file", "SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k <= 5")
def win08(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id")
    return ranking.leading_n(ev, ["user_id"], [F.col("event_id").asc()], 5).select("event_id", "user_id")


@query("FLT07_score_threshold", f"WITH {S.SCORES} SELECT row_id, {R('score')} AS score FROM scores WHERE score >= 0.5")
def flt07(spark, sf):
    return vsrc.score_threshold(fixtures.scores(spark, sf), 0.5).select("row_id", r("score").alias("score"))


NAMES = "WITH nm AS (SELECT p_partkey, concat(CASE p_partkey % 5 WHEN 0 THEN 'DEBUG_' WHEN 1 THEN 'x_Smoke-' ELSE 'HW_' END, p_partkey, '_var.smearCMS.root') AS name FROM part)"


def names(spark, sf):
    k = F.col("p_partkey")
    pre = F.when(k % 5 == 0, "DEBUG_").when(k % 5 == 1, "x_Smoke-").otherwise("HW_")
    return table(spark, sf, "part").select("p_partkey", F.concat(pre, k.cast("string"), F.lit("_var.smearCMS.root")).alias("name"))


@query("FLT08_drop_auxiliary", f"{NAMES} SELECT p_partkey, name FROM nm WHERE lower(name) NOT LIKE '%debug%' AND lower(name) NOT LIKE '%smoke%'")
def flt08(spark, sf):
    return vsrc.drop_auxiliary(names(spark, sf), "name")


@query("PRJ02_sample_metadata_projection", f"WITH {S.SAMPLES} SELECT sample, b_quarks, c_quarks AS c_mistags, light_jets AS light_mistags, {R('xsec_pb*1000')} AS xsec_fb FROM samples")
def prj02(spark, sf):
    s = fixtures.samples(spark, sf)
    return s.select("sample", "b_quarks", F.col("c_quarks").alias("c_mistags"), F.col("light_jets").alias("light_mistags"), r(F.col("xsec_pb") * 1000).alias("xsec_fb"))


# --- catalogue ------------------------------------------------------------------------------
CAT = """WITH cat AS (SELECT p_partkey AS k, concat('proc_', p_partkey) AS process_id, CAST(1000 + p_size*10 AS BIGINT) AS events, p_retailprice/CAST(1000 AS DOUBLE) AS x,
 CASE p_partkey % 4 WHEN 0 THEN 6 WHEN 1 THEN 4 WHEN 2 THEN 4 ELSE 6 END AS b, CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 0 END AS c, 2 AS l FROM part WHERE p_partkey % 9 <> 0)"""


def catalogue_csv(spark, sf):
    k = F.col("p_partkey")
    v = k % 4
    path = scratch_dir(spark, "catalogue")
    table(spark, sf, "part").select(
        F.concat(F.lit("proc_"), k.cast("string")).alias("process_id"),
        F.when(v == 2, "pp to 4b + 2c + 2j").when(v == 3, "only 2b listed").otherwise("text, with comma").alias("description"),
        F.when(v == 1, "21 21 -> 5 -5 5 -5 4 -4 ; 21 21 -> 901 1").otherwise("").alias("process"),
        (1000 + F.col("p_size") * 10).cast("double").cast("string").alias("events"),
        (F.col("p_retailprice") / 1000).cast("string").alias("cross_section_pb"),
        F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("p"), k.cast("string"), F.lit(".lhe"))).alias("local_lhe"),
        F.when(v == 3, "b bbar + 4 b, 2 light jets").otherwise("").alias("notes"),
        F.when(v == 0, "6").otherwise("").alias("b_quarks"), F.when(v == 0, "0").otherwise("").alias("c_quarks"), F.when(v == 0, "2").otherwise("").alias("light_jets"),
    ).write.option("header", True).csv(path)
    return path


CAT_OUT = f"process_id, events, {R('x')} AS xsec_pb, {R('x*1000', 4)} AS xsec_fb, concat('HW-', process_id, '_var.smearCMS.root') AS var_file, b AS b_quarks, c AS c_quarks, l AS light_jets"


def catalogue_rows(spark, sf):
    return catalogue.scan_process_catalogue(spark, catalogue_csv(spark, sf))


@query("SRC09_scan_process_catalogue", f"{CAT} SELECT {CAT_OUT} FROM cat")
def src09(spark, sf):
    c = catalogue_rows(spark, sf)
    return c.select("process_id", "events", r("xsec_pb").alias("xsec_pb"), r("xsec_fb", 4).alias("xsec_fb"), "var_file", "b_quarks", "c_quarks", "light_jets")


@query("STR04_infer_flavours", f"{CAT} SELECT b AS b_quarks, c AS c_quarks, l AS light_jets, count(*) AS n FROM cat GROUP BY ALL")
def str04(spark, sf):
    return catalogue_rows(spark, sf).groupBy("b_quarks", "c_quarks", "light_jets").agg(F.count("*").alias("n"))


@query(
    "STR02_count_flavours_text",
    "SELECT p_partkey, CAST(p_size % 5 + 2 AS INT) AS b, CAST(p_partkey % 3 + CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 0 END AS INT) AS c, CAST(p_size % 4 + p_partkey % 2 AS INT) AS l FROM part",
)
def str02(spark, sf):
    k, z = F.col("p_partkey"), F.col("p_size")
    t = F.concat(
        (z % 5).cast("string"), F.lit("B + B bbar_"), (k % 3).cast("string"), F.lit(" c, "), (z % 4).cast("string"), F.lit(" Light Jets"),
        F.when(k % 2 == 0, " c anti-c x9b1").otherwise(" and 1j 3jx"),
    )
    return table(spark, sf, "part").select("p_partkey", text.count_flavours_text(t).alias("f")).select("p_partkey", "f.*")


@query(
    "STR03_count_flavours_pdg",
    "SELECT p_partkey, CAST(2 + 2*(p_size % 3) AS INT) AS b, CAST(2*(p_partkey % 2) AS INT) AS c, CAST(CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS INT) AS l FROM part",
)
def str03(spark, sf):
    k, z = F.col("p_partkey"), F.col("p_size")
    more_b = F.repeat(F.lit(" 5 -5"), (z % 3).cast("int"))
    t = F.concat(F.lit("21 21 -> 5 -5"), more_b, F.when(k % 2 == 1, " 4 -4").otherwise(""), F.when(k % 3 == 0, " 901 ; 1 2 -> 21 22").otherwise(" -3 11 ; no arrow 5 5"))
    return table(spark, sf, "part").select("p_partkey", text.count_flavours_pdg(t).alias("f")).select("p_partkey", "f.*")


# --- logs -----------------------------------------------------------------------------------
@query(
    "SRC10_extract_run_metadata",
    f"""WITH o AS (SELECT o_custkey AS f, o_orderkey AS k, o_totalprice/CAST(1000 AS DOUBLE) AS x FROM orders)
 SELECT concat('run_', f) AS file, {R('arg_max(x, k) FILTER (k % 4 IN (0,1))')} AS xsec_pb, arg_max(k, k) FILTER (k % 4 IN (1,2)) AS generated_events, {R('(arg_min(x, k) FILTER (k % 4 = 3))*1000', 4)} AS total_fb, arg_min(k, k) FILTER (k % 4 = 3) AS total_events FROM o GROUP BY f""",
)
def src10(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 1000).alias("x"))
    k, v = F.col("k").cast("string"), F.col("k") % 4
    exact = F.format_string("%.8f", F.col("x"))
    line = (
        F.when(v == 0, F.concat(F.lit("#  Integrated weight (pb)  :   "), exact))
        .when(v == 1, F.concat(F.lit("cross-section = "), exact, F.lit(" pb, Number of Events : "), k))
        .when(v == 2, F.concat(F.lit("  "), k, F.lit(" = nevents ! requested")))
        .otherwise(F.concat(F.lit("Total:   "), k, F.lit("   99  "), exact, F.lit("(12)e-3")))
    )
    lines = o.select(F.concat(F.lit("run_"), F.col("o_custkey").cast("string")).alias("file"), F.col("k").alias("line_no"), line.alias("line"))
    m = catalogue.extract_run_metadata(lines)
    return m.select("file", r("xsec_pb").alias("xsec_pb"), "generated_events", r("total_fb", 4).alias("total_fb"), "total_events")


SUM_SQL = f"""WITH s AS (SELECT s_suppkey AS k, concat('s', s_suppkey) AS sample, 1000 + abs(s_acctbal) AS w FROM supplier),
 sm AS (SELECT k, sample, CASE WHEN k%4=0 THEN NULL WHEN k%4=3 THEN w ELSE w END AS w, CASE k%4 WHEN 1 THEN CAST(0.25 AS DOUBLE) WHEN 2 THEN CAST(0.5 AS DOUBLE) WHEN 3 THEN CAST(0.5 AS DOUBLE) END AS preselection_efficiency,
  CASE k%4 WHEN 1 THEN CAST(0.125 AS DOUBLE) WHEN 2 THEN CAST(0.0625 AS DOUBLE) END AS analysis_efficiency, CASE k%4 WHEN 1 THEN 'json' WHEN 0 THEN 'missing' ELSE 'log' END AS summary_source,
  CASE WHEN k%4 IN (1,2) THEN 'ok' ELSE 'missing_analysis_summary' END AS status FROM s)"""


def cut_summaries(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("sample"), (1000 + F.abs("s_acctbal")).alias("w"))
    v = F.col("k") % 4
    js = s.filter(v == 1).select("sample", F.to_json(F.struct(F.col("w").alias("total_weight_in"), F.lit(0.25).alias("preselection_efficiency"), F.lit(0.125).alias("analysis_efficiency"))).alias("json"))
    num = lambda x: F.format_string("%.8f", x)
    w = F.col("w")
    common = [F.concat(F.lit("total weight in =\t\t"), num(w)), F.concat(F.lit("8bs with pT > 20 =\t"), num(w / 2))]
    extra = F.when(v == 2, F.array(F.concat(F.lit(" total weight out =\t"), num(w / 16)), F.lit("actual MC events = 12"))).otherwise(F.array().cast("array<string>"))
    logs = s.filter(v.isin(2, 3)).select("sample", F.posexplode(F.concat(F.array(*common), extra)).alias("line_no", "line"))
    return catalogue.scan_cutflow_summary(s.select("sample"), js, logs)


@query("SRC11_scan_cutflow_summary", f"{SUM_SQL} SELECT sample, {R('w', 4)} AS total_weight_in, {R('preselection_efficiency')} AS preselection_efficiency, {R('analysis_efficiency')} AS analysis_efficiency, summary_source, status FROM sm")
def src11(spark, sf):
    c = cut_summaries(spark, sf)
    return c.select("sample", r("total_weight_in", 4).alias("total_weight_in"), r("preselection_efficiency").alias("preselection_efficiency"), r("analysis_efficiency").alias("analysis_efficiency"), "summary_source", "status")


# --- runs -----------------------------------------------------------------------------------
RUN2 = f"WITH {S.RUNS}, r2 AS (SELECT p_partkey AS run_id, CASE WHEN p_partkey % 97 = 0 THEN 'run_gg_4h_bad' ELSE name END AS run_name, CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE grp END AS g, CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE c3 END AS c3, CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE d4 END AS d4, generated_events, has_lhe, p_partkey % 3 = 0 AS has_var, xsec_pb FROM runs)"


def run_rows(spark, sf):
    d = fixtures.runs(spark, sf)
    name = F.when(F.col("p_partkey") % 97 == 0, "run_gg_4h_bad").otherwise(F.col("name"))
    return d.select(F.col("p_partkey").alias("run_id"), name.alias("run_name"), "generated_events", "has_lhe", (F.col("p_partkey") % 3 == 0).alias("has_var"), "xsec_pb")


def run_catalogue(spark, sf):
    d = run_rows(spark, sf).withColumn("run_dir", F.concat(F.lit("/data/Events/"), F.col("run_name"), F.lit("/unweighted.lhe")))
    return catalogue.scan_run_catalogue(d)


STATUS = "CASE WHEN has_var THEN 'ready_to_score' WHEN has_lhe THEN 'lhe_ready_needs_var_root' ELSE 'waiting_for_lhe' END"


@query("SRC12_scan_run_catalogue", f"{RUN2} SELECT run_id, CAST(g AS VARCHAR) AS run_group, c3, d4, generated_events, {R('xsec_pb*1000', 4)} AS xsec_fb, {STATUS} AS status FROM r2")
def src12(spark, sf):
    return run_catalogue(spark, sf).select("run_id", F.when(F.col("run_group") != "", F.col("run_group")).alias("run_group"), "c3", "d4", "generated_events", r("xsec_fb", 4).alias("xsec_fb"), "status")


XP = f"""{RUN2}, xp AS (SELECT run_id, CAST(g AS VARCHAR) AS runnum, c3, d4, xsec_pb, CASE WHEN run_id % 2 = 0 THEN xsec_pb/CAST(32 AS DOUBLE) ELSE greatest(abs(xsec_pb)*CAST(0.01 AS DOUBLE), CAST(1e-30 AS DOUBLE)) END AS err, count(*) OVER (PARTITION BY g) AS runs_in_group FROM r2 WHERE has_lhe AND c3 IS NOT NULL)"""


def xsec_points(spark, sf):
    d = run_rows(spark, sf)
    page = F.concat(F.lit("<p><b>s= "), F.format_string("%.10e", "xsec_pb"), F.lit(" &plusmn; "), F.format_string("%.10e", F.col("xsec_pb") / 32), F.lit(" (pb)</b>"))
    html = d.filter(F.col("run_id") % 2 == 0).select("run_id", page.alias("html"))
    return catalogue.scan_xsec_points(d, html)


@query("SRC13_scan_xsec_points", f"{XP} SELECT run_id, runnum, c3, d4, {R('xsec_pb')} AS xsec_pb, {R('err', 9)} AS xsec_error_pb, runs_in_group FROM xp")
def src13(spark, sf):
    return xsec_points(spark, sf).select("run_id", "runnum", "c3", "d4", r("xsec_pb").alias("xsec_pb"), r("xsec_error_pb", 9).alias("xsec_error_pb"), "runs_in_group")


@query("TOP04_ordered_points", f"{XP} SELECT c3, d4, runnum, run_id FROM xp ORDER BY c3, d4, runnum, run_id")
def top04(spark, sf):
    return xsec_points(spark, sf).select("c3", "d4", "runnum", "run_id").orderBy("c3", "d4", "runnum", "run_id")


@query("AGG24_status_counts", f"{RUN2} SELECT {STATUS} AS status, count(*) AS n FROM r2 GROUP BY 1")
def agg24(spark, sf):
    return run_catalogue(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query("AGG25_average_duplicates", f"{RUN2} SELECT c3, d4, {R('avg(xsec_pb)')} AS value, count(*) AS n FROM r2 WHERE c3 IS NOT NULL GROUP BY c3, d4")
def agg25(spark, sf):
    c = run_catalogue(spark, sf).filter("c3 IS NOT NULL")
    return c.groupBy("c3", "d4").agg(r(F.avg("xsec_pb")).alias("value"), F.count("*").alias("n"))


WIN01_SQL = f"""{RUN2}, e AS (SELECT *, row_number() OVER (PARTITION BY c3, d4, generated_events = 10000 ORDER BY has_lhe DESC, coalesce(g,-1) DESC, run_name DESC, run_id DESC) AS k FROM r2),
 sel AS (SELECT run_id, c3, d4, CASE WHEN c3 IS NULL THEN 'selected' WHEN generated_events <> 10000 THEN 'nonmatching_events' WHEN k=1 THEN 'selected' ELSE 'duplicate' END AS selection FROM e)"""


def selection(spark, sf):
    return ops.best_run_per_point(run_catalogue(spark, sf))


@query("WIN01_best_run_per_point", f"{WIN01_SQL} SELECT run_id, c3, d4, selection FROM sel")
def win01(spark, sf):
    return selection(spark, sf).select("run_id", "c3", "d4", "selection")


@query("SET04_set_difference", f"{WIN01_SQL} SELECT run_id FROM sel WHERE selection <> 'selected'")
def set04(spark, sf):
    c = run_catalogue(spark, sf).select("run_id")
    return c.exceptAll(selection(spark, sf).filter("selection = 'selected'").select("run_id"))


@query("SNK07_write_manifest", f"{WIN01_SQL} SELECT run_id, selection AS status FROM sel")
def snk07(spark, sf):
    path = scratch_dir(spark, "manifest")
    sinks.write_manifest(selection(spark, sf).select("run_id", F.col("selection").alias("status")), path)
    return spark.read.schema("run_id long, status string").option("header", True).csv(path)


# --- joins ----------------------------------------------------------------------------------
FACT = f"WITH {S.EVENTS_W}, {S.SAMPLES}, f AS (SELECT sample, count(*) AS entries, sum(evweight) AS w FROM ew GROUP BY sample), sm AS (SELECT * FROM samples WHERE sample <> 'BUILDING')"


def facts(spark, sf):
    return fixtures.events_w(spark, sf).groupBy("sample").agg(F.count("*").alias("entries"), F.sum("evweight").alias("w"))


for _how in ("left", "inner"):

    @query(f"JN01_attach_sample_metadata_{_how}", f"{FACT} SELECT f.sample, entries, {R('w', 7)} AS w, {R('xsec_pb')} AS xsec_pb, b_quarks FROM f {_how.upper()} JOIN sm ON f.sample = sm.sample")
    def jn01(spark, sf, how=_how):
        sm = fixtures.samples(spark, sf).filter("sample <> 'BUILDING'")
        return ops.attach_sample_metadata(facts(spark, sf), sm, how).select("sample", "entries", r("w", 7).alias("w"), r("xsec_pb").alias("xsec_pb"), "b_quarks")


@query("JN05_not_yet_processed", f"{NAMES} SELECT name, CASE WHEN p_partkey % 3 = 0 THEN 'existing' ELSE 'new' END AS state FROM nm")
def jn05(spark, sf):
    n = names(spark, sf)
    done = n.filter(F.col("p_partkey") % 3 == 0)
    new = ops.not_yet_processed(n, done, "name").select("name", F.lit("new").alias("state"))
    return done.select("name", F.lit("existing").alias("state")).unionByName(new).dropDuplicates(["name"])


@query("JN10_broadcast_or_zip_params", f"{FACT} SELECT f.sample, CAST(3000 AS DOUBLE) AS luminosity, {R('xsec_pb')} AS xsec_pb FROM f JOIN samples USING (sample)")
def jn10(spark, sf):
    f = ops.attach_params(facts(spark, sf).select("sample"), "sample", [3000.0], "luminosity")
    return ops.attach_params(f, "sample", fixtures.samples(spark, sf), "xsec_pb").select("sample", "luminosity", r("xsec_pb").alias("xsec_pb"))


@query(
    "JN13_resolve_sample_rates",
    f"""WITH c AS (SELECT c_custkey AS k, concat('f', c_custkey) AS file FROM customer)
 SELECT file, {R('CASE WHEN k%5=0 THEN k+1 WHEN k%3=0 THEN 2*k WHEN k%2=0 THEN 1000*(k%10)+1000 ELSE 1 END', 4)} AS xsec_fb, CASE WHEN k%5=0 THEN 'explicit' WHEN k%3=0 THEN 'total' WHEN k%2=0 THEN 'banner' ELSE 'default' END AS xsec_source,
 CAST(CASE WHEN k%3=0 THEN 100+k WHEN k%2=0 THEN 7000 ELSE 10000 END AS BIGINT) AS generated_events, CASE WHEN k%7=0 THEN CAST(k AS DOUBLE) END AS normalisation_weight, NOT (k%5=0 OR k%3=0 OR k%2=0) AS warning FROM c""",
)
def jn13(spark, sf):
    k = F.col("k")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("file"), F.concat(F.lit("run"), (F.col("c_custkey") % 10).cast("string")).alias("run_dir"))
    banners = c.filter(k % 2 == 0).groupBy("run_dir").agg(F.max(((k % 10) + 1).cast("double")).alias("xsec_pb"), F.lit(7000).cast("long").alias("generated_events"))
    out = ops.resolve_sample_rates(
        c, c.filter(k % 5 == 0).select("file", (k + 1).cast("double").alias("xsec_fb")), c.filter(k % 3 == 0).select("file", (2 * k).cast("double").alias("total_fb"), (100 + k).alias("total_events")),
        banners, c.filter(k % 7 == 0).select("file", k.cast("double").alias("total_weight_in")), 10000,
    )
    return out.withColumn("xsec_fb", r("xsec_fb", 4))


@query("SET03_unique_paths", "SELECT concat('/data/', c_nationkey, '/', c_mktsegment) AS path, min(c_custkey) AS ord FROM customer GROUP BY 1")
def set03(spark, sf):
    c = table(spark, sf, "customer").select(F.concat(F.lit("/data/"), F.col("c_nationkey").cast("string"), F.lit("/"), F.col("c_mktsegment")).alias("path"), F.col("c_custkey").alias("ord"))
    return ops.unique_paths(c)


@query("SET05_concat_samples", f"WITH {S.EVENTS_W} SELECT sample, CASE WHEN label=1 THEN 1 ELSE 0 END AS label, count(*) AS n, {R('sum(evweight)', 7)} AS w FROM ew GROUP BY ALL")
def set05(spark, sf):
    e = fixtures.events_w(spark, sf)
    sig = e.filter("label = 1").select("event_id", "sample", "evweight")
    bkg = e.filter("label = 0").select("event_id", "sample", "evweight")
    both = vsrc.concat_samples({1: [sig], 0: [bkg]})
    return both.groupBy("sample", "label").agg(F.count("*").alias("n"), r(F.sum("evweight"), 7).alias("w"))


# --- strings --------------------------------------------------------------------------------
@query("STR01_parse_point_from_path", f"{RUN2} SELECT run_id, CAST(g AS VARCHAR) AS run_group, c3, d4 FROM r2")
def str01(spark, sf):
    d = run_rows(spark, sf)
    path = F.when(F.col("run_id") % 2 == 0, F.concat(F.lit("/x/"), F.col("run_name"), F.lit("/sub/events.root"))).otherwise(F.concat(F.lit("/x/y/HW-"), F.col("run_name"), F.lit("_var.root")))
    g, c3, d4 = text.parse_point(path)
    return d.select("run_id", F.when(g != "", g).alias("run_group"), c3.alias("c3"), d4.alias("d4"))


@query("STR05_stable_seed", "SELECT p_partkey, 12345 + CAST(concat('0x', substr(sha256(p_name || p_partkey), 1, 8)) AS BIGINT) % 100000000 AS seed FROM part")
def str05(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.stable_seed(F.concat("p_name", F.col("p_partkey").cast("string")), 12345).alias("seed"))


@query("STR07_replace_suffix", f"{NAMES} SELECT p_partkey, replace(name, '.root', '.dat') AS dat, concat(split_part(name, '_var.smear', 1), '.analysis.log') AS log FROM nm")
def str07(spark, sf):
    return names(spark, sf).select("p_partkey", text.replace_suffix(F.col("name"), ".dat").alias("dat"), text.sibling_name(F.col("name"), ".analysis.log").alias("log"))


@query(
    "STR08_format_helpers",
    f"""WITH b AS (SELECT p_partkey AS k, p_retailprice AS x, CASE p_partkey % 4 WHEN 0 THEN p_retailprice*10 WHEN 1 THEN p_retailprice/CAST(20 AS DOUBLE) WHEN 2 THEN p_retailprice/CAST(3000 AS DOUBLE) ELSE p_retailprice/CAST(1000000 AS DOUBLE) END AS lv FROM part)
 SELECT k, concat('eff = ', k) AS plain, CAST(k AS DOUBLE) AS last_num, {R('round(x*pow(CAST(10 AS DOUBLE),3-floor(log10(abs(x)))))/pow(CAST(10 AS DOUBLE),3-floor(log10(abs(x))))')} AS sig4,
 CASE WHEN lv>=1000 OR lv<0.01 THEN printf('%.0e', lv) WHEN lv>=10 THEN printf('%.0f', lv) ELSE printf('%.2g', lv) END AS level FROM b""",
)
def str08(spark, sf):
    k, x = F.col("p_partkey"), F.col("p_retailprice")
    lv = F.when(k % 4 == 0, x * 10).when(k % 4 == 1, x / 20).when(k % 4 == 2, x / 3000).otherwise(x / 1000000)
    colour = F.concat(F.lit("\u001b[31meff = "), k.cast("string"), F.lit("\u001b[0m"))
    return table(spark, sf, "part").select(
        k.alias("k"), text.strip_ansi(colour).alias("plain"), text.last_number(F.concat(F.lit("a 1.5e3 b = "), k.cast("string"))).alias("last_num"),
        r(text.round_sig(x, 4)).alias("sig4"), text.format_level(lv).alias("level"),
    )


# --- rates and yields -----------------------------------------------------------------------
LUMI = 3000.0
META = """mt AS (SELECT user_id AS sample_id, CAST(0.01 AS DOUBLE)*(1 + user_id % 17) AS xsec_fb, CASE WHEN user_id % 5 <> 0 THEN 1000 + user_id END AS generated_events,
 CASE WHEN user_id % 3 = 0 THEN 500 + CAST(user_id AS DOUBLE) END AS input_weight_sum, CAST(0.5 AS DOUBLE) + (user_id % 4)/CAST(8 AS DOUBLE) AS rate_factor, CASE WHEN user_id % 6 = 0 THEN 1 ELSE 0 END AS sig FROM events GROUP BY user_id)"""


def meta(spark, sf):
    u = F.col("user_id")
    return table(spark, sf, "events").select("user_id").distinct().select(
        u.alias("sample_id"), (F.lit(0.01) * (1 + u % 17)).alias("xsec_fb"), F.when(u % 5 != 0, 1000 + u).alias("generated_events"),
        F.when(u % 3 == 0, 500 + u.cast("double")).alias("input_weight_sum"), (F.lit(0.5) + (u % 4) / F.lit(8.0)).alias("rate_factor"), F.when(u % 6 == 0, 1).otherwise(0).alias("sig"),
    )


DEN = "CASE WHEN input_weight_sum>0 THEN input_weight_sum WHEN generated_events>0 THEN CAST(generated_events AS DOUBLE) WHEN sa>0 THEN sa ELSE CAST(entries AS DOUBLE) END"
SRC = "CASE WHEN input_weight_sum>0 THEN 'input_weight_sum' WHEN generated_events>0 THEN 'generated_events' ELSE 'loaded_weight_sum' END"
SP = f"""WITH {S.SCORES}, {META}, a AS (SELECT sample_id, count(*) AS entries, count(CASE WHEN score>=0.5 THEN 1 END) AS selected_entries, sum(weight) AS sw, sum(CASE WHEN score>=0.5 THEN weight ELSE 0 END) AS sws,
  sum(CASE WHEN score>=0.5 THEN weight*weight ELSE 0 END) AS sws2, sum(abs(weight)) AS sa, sum(abs(weight)*score) AS sas FROM scores GROUP BY sample_id),
 b AS (SELECT *, xsec_fb*rate_factor AS ex, {DEN} AS den, {SRC} AS normalisation_source FROM a JOIN mt USING (sample_id)),
 sp AS (SELECT *, 3000*ex*sw/den AS pre, 3000*ex*sws/den AS sel, 3000*ex/den*sqrt(sws2) AS err, CASE WHEN sw<>0 THEN sws/sw ELSE 0 END AS ce FROM b)"""


def scored(spark, sf):
    return ops.score_points(fixtures.scores(spark, sf), meta(spark, sf), 0.5, LUMI)


@query("AGG15_sample_summary", f"{SP} SELECT sample_id, entries, {R('sw')} AS sum_weight, {R('den')} AS normalisation, normalisation_source, {R('ex')} AS effective_xsec_fb, {R('pre')} AS expected_preselected, {R('pre/(3000*ex)')} AS analysis_efficiency FROM sp")
def agg15(spark, sf):
    s = ops.sample_summary(fixtures.scores(spark, sf), meta(spark, sf), LUMI)
    return s.select("sample_id", "entries", r("sum_weight").alias("sum_weight"), r("normalisation").alias("normalisation"), "normalisation_source", *[r(c).alias(c) for c in ("effective_xsec_fb", "expected_preselected", "analysis_efficiency")])


@query("AGG16_mc_event_counts", f"{SP} SELECT sig AS label, count(*) AS files, CAST(sum(entries) AS BIGINT) AS entries_read, CAST(CASE WHEN count(generated_events)=count(*) THEN sum(generated_events) END AS BIGINT) AS generated_events, CAST(coalesce(sum(generated_events),0) AS BIGINT) AS known_generated_events FROM sp GROUP BY sig")
def agg16(spark, sf):
    s = ops.sample_summary(fixtures.scores(spark, sf), meta(spark, sf), LUMI)
    return ops.mc_event_counts(s.withColumn("label", F.col("sig")))


@query(
    "AGG17_score_points",
    f"{SP} SELECT sample_id, entries, selected_entries, {R('pre')} AS expected_preselected, {R('sel')} AS expected_selected, {R('err')} AS expected_selected_error, {R('pre/(3000*ex)')} AS analysis_efficiency, {R('ce')} AS classifier_efficiency, {R('sel/(3000*ex)')} AS final_efficiency, {R('ce')} AS raw_efficiency, {R('sas/sa')} AS mean_score, {R('xsec_fb*ce', 7)} AS raw_sigma_eff_fb, {R('ex*ce', 7)} AS effective_sigma_eff_fb FROM sp",
)
def agg17(spark, sf):
    s = scored(spark, sf)
    six = ("expected_preselected", "expected_selected", "expected_selected_error", "analysis_efficiency", "classifier_efficiency", "final_efficiency", "raw_efficiency", "mean_score")
    return s.select("sample_id", "entries", "selected_entries", *[r(c).alias(c) for c in six], r("raw_sigma_eff_fb", 7).alias("raw_sigma_eff_fb"), r("effective_sigma_eff_fb", 7).alias("effective_sigma_eff_fb"))


@query("AGG18_background_totals", f"{SP} SELECT count(*) AS files, CAST(sum(entries) AS BIGINT) AS entries, CAST(sum(selected_entries) AS BIGINT) AS selected_entries, {R('sum(pre)', 5)} AS expected_preselected, {R('sum(sel)', 5)} AS expected_selected, {R('sum(ex*ce)')} AS effective_sigma_eff_fb FROM sp WHERE sig=0")
def agg18(spark, sf):
    t = ops.background_totals(scored(spark, sf).filter("sig = 0"))
    return t.select("files", "entries", "selected_entries", r("expected_preselected", 5).alias("expected_preselected"), r("expected_selected", 5).alias("expected_selected"), r("effective_sigma_eff_fb").alias("effective_sigma_eff_fb"))


@query("AGG19_rollup_score_rows", f"{SP} SELECT CAST(sum(entries) AS BIGINT) AS entries, {R('sqrt(sum(err*err))')} AS sel_error, {R('sum(pre)/(3000*sum(ex))')} AS analysis_efficiency, {R('sum(sel)/sum(pre)')} AS classifier_efficiency, {R('sum(sel)/(3000*sum(ex))')} AS final_efficiency FROM sp")
def agg19(spark, sf):
    t = ops.rollup_score_rows(scored(spark, sf), LUMI)
    return t.select("entries", *[r(c).alias(c) for c in ("sel_error", "analysis_efficiency", "classifier_efficiency", "final_efficiency")])


BX = f"""{SUM_SQL}, cat AS (SELECT sample, CAST(10 AS DOUBLE)*(1+k%13) AS xsec_fb, CAST(8-2*(k%3) AS INT) AS b, CAST(k%3 AS INT) AS c, preselection_efficiency AS pe, analysis_efficiency AS ae FROM sm),
 bx AS (SELECT *, xsec_fb*2*pow(CAST(0.85 AS DOUBLE),b)*pow(CAST(0.1 AS DOUBLE),c)*pow(CAST(0.01 AS DOUBLE),c) AS ex FROM cat)"""


def bkg_summary(spark, sf):
    k = F.col("s_suppkey")
    cat = table(spark, sf, "supplier").select(
        F.concat(F.lit("s"), k.cast("string")).alias("sample"), (F.lit(10.0) * (1 + k % 13)).alias("xsec_fb"),
        (8 - 2 * (k % 3)).cast("int").alias("b_quarks"), (k % 3).cast("int").alias("c_quarks"), (k % 3).cast("int").alias("light_jets"),
    )
    return ops.background_xsec_summary(cat, cut_summaries(spark, sf))


@query("AGG20_background_xsec_summary", f"{BX} SELECT sample, {R('ex', 8)} AS effective_xsec_fb, {R('ex*pe', 8)} AS preselection_xsec_fb, {R('ex*ae', 8)} AS output_xsec_fb FROM bx")
def agg20(spark, sf):
    return bkg_summary(spark, sf).select("sample", *[r(c, 8).alias(c) for c in ("effective_xsec_fb", "preselection_xsec_fb", "output_xsec_fb")])


@query("AGG20_background_xsec_totals", f"{BX} SELECT {R('sum(ex)')} AS effective_xsec_fb, {R('sum(coalesce(ex*pe,0))')} AS preselection_xsec_fb, {R('sum(coalesce(ex*ae,0))')} AS output_xsec_fb, count(*) AS processes FROM bx")
def agg20t(spark, sf):
    t = ops.background_xsec_totals(bkg_summary(spark, sf))
    return t.select(*[r(c).alias(c) for c in ("effective_xsec_fb", "preselection_xsec_fb", "output_xsec_fb")], "processes")


@query("AGG33_expected_significance", f"{BX}, t AS (SELECT 3000*sum(ae*xsec_fb*CAST(0.5 AS DOUBLE)) AS b, CAST(sum(b) AS DOUBLE) AS s FROM bx) SELECT {R('b', 4)} AS background_events, s AS signal_events, {R('s/sqrt(b+pow(CAST(0.1 AS DOUBLE)*b,2))', 8)} AS significance FROM t")
def agg33(spark, sf):
    rows = bkg_summary(spark, sf).withColumns({"efficiency": F.col("analysis_efficiency"), "factor": F.lit(0.5)})
    out = ops.expected_significance(rows, F.sum("b_quarks").cast("double"), 0.1, LUMI)
    return out.select(r("background_events", 4).alias("background_events"), "signal_events", r("significance", 8).alias("significance"))


@query("SCL11_rate_factors", f"WITH {S.SAMPLES} SELECT sample, {R('2*pow(CAST(0.85 AS DOUBLE),b_quarks)*pow(CAST(0.1 AS DOUBLE),c_quarks)*pow(CAST(0.01 AS DOUBLE),light_jets)', 10)} AS background_rate, {R('2*pow(CAST(0.5824 AS DOUBLE),4)*pow(CAST(0.85 AS DOUBLE),8)', 10)} AS signal_rate FROM samples")
def scl11(spark, sf):
    return fixtures.samples(spark, sf).select("sample", r(ops.background_rate(), 10).alias("background_rate"), r(F.lit(ops.signal_rate()), 10).alias("signal_rate"))


@query("SCL12_normalisation_weight", f"{SP} SELECT s.row_id, {R('3000*ex*s.weight/den', 8)} AS yield_w, normalisation_source FROM scores s JOIN sp USING (sample_id)")
def scl12(spark, sf):
    rows = fixtures.scores(spark, sf)
    s = ops.sample_summary(rows, meta(spark, sf), LUMI).select("sample_id", "effective_xsec_fb", "normalisation", "normalisation_source")
    out = rows.join(s, "sample_id")
    return out.select("row_id", r(LUMI * F.col("effective_xsec_fb") * F.col("weight") / F.col("normalisation"), 8).alias("yield_w"), "normalisation_source")


# --- sinks ----------------------------------------------------------------------------------
@query("SNK04_write_scores", f"WITH {S.SCORES} SELECT row_id AS entry, label, {R('score')} AS score, {R('weight')} AS physical_weight, score >= 0.5 AS selected FROM scores")
def snk04(spark, sf):
    path = scratch_dir(spark, "scores")
    s = fixtures.scores(spark, sf).select(F.col("row_id").alias("entry"), "label", r("score").alias("score"), r("weight").alias("physical_weight"), (F.col("score") >= 0.5).alias("selected"))
    sinks.write_scores(s, path)
    return spark.read.parquet(path)


@query("SNK05_write_points", f"{SP} SELECT sample_id, entries, {R('sel')} AS expected_selected, CAST(3000 AS DOUBLE) AS luminosity FROM sp")
def snk05(spark, sf):
    path = scratch_dir(spark, "points")
    sinks.write_points(scored(spark, sf).select("sample_id", "entries", r("expected_selected").alias("expected_selected")), path, {"luminosity": LUMI})
    back = spark.read.schema("metadata struct<luminosity:double>, point struct<sample_id:bigint,entries:bigint,expected_selected:double>").json(path + "/json")
    return back.select("point.*", "metadata.luminosity")


@query("SNK05_write_backgrounds", f"""{SP}, k AS (SELECT * FROM sp WHERE sig=0) SELECT sample_id AS process_id, entries, selected_entries, {R('sel', 5)} AS expected_selected_events, normalisation_source, {R('(SELECT sum(sel) FROM k)', 4)} AS total FROM k""")
def snk05b(spark, sf):
    path = scratch_dir(spark, "backgrounds")
    named = {"sample_id": "process_id", "expected_preselected": "expected_preselected_events", "expected_selected": "expected_selected_events", "normalisation": "normalisation_weight", "classifier_efficiency": "xgboost_efficiency", "raw_efficiency": "raw_weight_efficiency"}
    sinks.write_backgrounds(scored(spark, sf).filter("sig = 0").withColumnsRenamed(named).withColumn("threshold", F.lit(0.5)), path, "model", 0.5, LUMI)
    back = spark.read.schema("metadata struct<expected_selected_events_total:double>, background struct<process_id:bigint,entries:bigint,selected_entries:bigint,expected_selected_events:double,normalisation_source:string>").json(path + "/json")
    b = back.select("background.*", "metadata.expected_selected_events_total")
    return b.select("process_id", "entries", "selected_entries", r("expected_selected_events", 5).alias("expected_selected_events"), "normalisation_source", r("expected_selected_events_total", 4).alias("total"))


@query(
    "SRC08_scan_variables_limited",
    f"{VARS_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY event_id) AS k FROM vars) SELECT event_id, sample, 1 AS label, {R('weight*CAST(2.5 AS DOUBLE)', 8)} AS weight, {R('weight', 8)} AS weight_feature FROM l WHERE k <= 40 AND event_id % 7 <> 0",
)
def src08l(spark, sf):
    """The first events of each sample, of which unusable ones then go; the weight is a feature as well."""
    v = rounded_variables(variables(spark, sf)).withColumn("m8b", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("m8b")))
    path = scratch_dir(spark, "vars")
    v.write.parquet(path)
    out = vsrc.scan_variables(spark, path, label=1, xsec=2.5, max_events=40, include_weight=True)
    return out.select("event_id", "sample", "label", r("weight", 8).alias("weight"), r("weight_feature", 8).alias("weight_feature"))


# --- b-tag cells ----------------------------------------------------------------------------
PT_CASE = "CASE " + " ".join(f"WHEN pt>={a} AND pt<{b} THEN {i}" for i, (a, b) in enumerate(zip(btag.PT_EDGES, btag.PT_EDGES[1:]))) + " END"
ETA_CASE = "CASE " + " ".join(f"WHEN abs(eta)>={a} AND abs(eta)<{b} THEN {i}" for i, (a, b) in enumerate(zip(btag.ETA_EDGES, btag.ETA_EDGES[1:]))) + " END"
CELL = f"WITH {S.JETS}, {S.ACC}, cl AS (SELECT *, {PT_CASE} AS pt_bin, {ETA_CASE} AS eta_bin FROM acc), dist AS (SELECT eta_bin, pt_bin, CAST((l_partkey % 10)/CAST(10 AS DOUBLE) AS DOUBLE) AS bin_lo, CAST(count(*) AS DOUBLE) AS content FROM cl GROUP BY ALL)"


def cells(spark, sf):
    return btag.lookup_cell(select.jet_acceptance(fixtures.jets(spark, sf)))


def distributions(spark, sf):
    path = scratch_dir(spark, "btag")
    cells(spark, sf).groupBy("eta_bin", "pt_bin", ((F.col("l_partkey") % 10) / F.lit(10.0)).alias("bin_lo")).agg(F.count("*").cast("double").alias("content")).write.parquet(path)
    return btag.scan_btag_distributions(spark, path)


@query("SRC14_scan_btag_distributions", f"{CELL} SELECT * FROM dist")
def src14(spark, sf):
    return distributions(spark, sf)


@query("JN12_lookup_btag_cell", f"{CELL} SELECT event_id, l_linenumber, l_partkey, l_suppkey, pt_bin, eta_bin FROM cl")
def jn12(spark, sf):
    return cells(spark, sf).select("event_id", *fixtures.JET_KEYS, "pt_bin", "eta_bin")


@query(
    "SCL14_sample_btag_score",
    f"""{CELL}, cum AS (SELECT *, sum(content) OVER (PARTITION BY eta_bin, pt_bin ORDER BY bin_lo) AS c, sum(content) OVER (PARTITION BY eta_bin, pt_bin) AS t FROM dist),
 u AS (SELECT row_number() OVER () AS rid, event_id, l_linenumber, l_partkey, l_suppkey, eta_bin, pt_bin, {S.uniform(11, *fixtures.JET_KEYS)} AS u FROM cl)
 SELECT event_id, l_linenumber, l_partkey, l_suppkey, min(bin_lo) AS score FROM u JOIN cum USING (eta_bin, pt_bin) WHERE u*t <= c GROUP BY rid, event_id, l_linenumber, l_partkey, l_suppkey""",
)
def scl14(spark, sf):
    out = btag.sample_score(cells(spark, sf), distributions(spark, sf), seed=11)
    return out.select("event_id", *fixtures.JET_KEYS, "score")
