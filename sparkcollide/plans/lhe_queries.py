"""Event text queries; the files are written from ``orders`` and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkcollide.operators import lhe as ops
from sparkcollide.plans import sqltext as S
from sparkcollide.plans.registry import query
from sparkcollide.session import scratch_dir, table
from sparkcollide.sinks import lhe_writer
from sparkcollide.sources import lhe
from sparkcollide.sources.lhe_fixture import lhe_files

R = S.rnd


def source_col():
    return F.regexp_extract("path", r"source=([^/]+)", 1)


def shard_col():
    return F.regexp_extract("path", r"shard=(\d+)", 1).cast("int")


def r(c, n=6):
    return F.round(c, n)


def headers(spark, sf):
    ev = lhe.parse_event_header(lhe.scan_lhe_events(spark, lhe_files(spark, sf)))
    return ev.withColumns({"source": source_col(), "shard": shard_col()})


E0 = """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 10 AS v, o_totalprice/CAST(100000 AS DOUBLE) AS w, CAST(o_orderkey % 4 AS INT) AS shard,
 CASE WHEN o_orderkey % 4 < 2 THEN 'a' ELSE 'b' END AS source FROM orders)"""
P0 = f"""{E0}, li AS (SELECT o.*, CAST(i AS INT) AS idx FROM o, range(1,7) t(i)),
 mom AS (SELECT *, CASE WHEN idx>2 THEN ((k*(37*idx+11))%401-200)/CAST(4 AS DOUBLE) ELSE 0 END AS px, CASE WHEN idx>2 THEN ((k*(53*idx+7))%397-198)/CAST(4 AS DOUBLE) ELSE 0 END AS py,
   CASE WHEN idx>2 THEN ((k*(71*idx+3))%599-299)/CAST(4 AS DOUBLE) ELSE 0 END AS pz0 FROM li),
 en AS (SELECT *, CASE WHEN idx>2 THEN sqrt(px*px+py*py+pz0*pz0+CAST(22.5625 AS DOUBLE)) ELSE 0 END AS e0 FROM mom),
 tot AS (SELECT *, sum(e0) OVER (PARTITION BY k)/2 AS half FROM en),
 p AS (SELECT k, v, w, shard, source, idx,
   CASE WHEN idx<3 THEN 21 WHEN v=2 AND idx=3 THEN 4 WHEN idx%2=1 THEN 5 ELSE -5 END AS pid, CASE WHEN idx<3 THEN -1 ELSE 1 END AS status,
   CASE WHEN idx=1 THEN 503 WHEN idx=2 THEN 504 WHEN idx=3 THEN 501 WHEN idx=5 THEN 502 ELSE 0 END AS c1,
   CASE WHEN idx=1 THEN CASE WHEN v=1 THEN 503 ELSE 504 END WHEN idx=2 THEN 503 WHEN idx=4 THEN CASE WHEN v=0 THEN 0 ELSE 501 END WHEN idx=6 THEN CASE WHEN v=4 THEN 501 ELSE 502 END ELSE 0 END AS c2,
   px, py, CASE WHEN idx=1 THEN half*CASE WHEN v=5 THEN -1 ELSE 1 END WHEN idx=2 THEN -half*CASE WHEN v=5 THEN -1 ELSE 1 END ELSE pz0 END AS pz,
   CASE WHEN idx<3 THEN half ELSE e0 END AS e, CASE WHEN idx<3 THEN 0 WHEN v=3 AND idx=5 THEN 5.75 ELSE 4.75 END AS m, NOT (v=6 AND idx=6) AS ok FROM tot)"""


@query("SRC01_scan_lhe_events", f"{E0} SELECT source, shard, count(*) AS complete, CAST(CASE WHEN shard=2 THEN max(k)//50000+1 ELSE 0 END AS BIGINT) AS incomplete FROM o GROUP BY source, shard")
def src01(spark, sf):
    c = lhe.incomplete_counts(spark, lhe_files(spark, sf))
    return c.groupBy(source_col().alias("source"), shard_col().alias("shard")).agg(F.sum("complete").alias("complete"), F.sum("incomplete").alias("incomplete"))


@query("SRC02_parse_event_header", f"{E0} SELECT source, shard, CASE WHEN v=7 THEN 7 ELSE 6 END AS nup, 1 AS idprup, count(*) AS n, {R('sum(w)', 7)} AS sum_w, {R('max(w)', 7)} AS max_w FROM o GROUP BY ALL")
def src02(spark, sf):
    return headers(spark, sf).groupBy("source", "shard", "nup", "idprup").agg(
        F.count("*").alias("n"), r(F.sum("xwgtup"), 7).alias("sum_w"), r(F.max("xwgtup"), 7).alias("max_w")
    )


@query(
    "SRC03_explode_particles",
    f"{P0} SELECT shard, idx, pid, status, c1, c2, ok, count(*) AS n, {R('sum(px)', 3)} AS sum_px, {R('sum(e)', 3)} AS sum_e, {R('sum(m)', 3)} AS sum_m, count(CASE WHEN NOT ok THEN 1 END) AS n_error, CAST(sum(CASE WHEN v=7 THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM p GROUP BY ALL",
)
def src03(spark, sf):
    p = lhe.explode_particles(lhe.scan_lhe_events(spark, lhe_files(spark, sf))).withColumn("shard", shard_col())
    return p.groupBy("shard", "idx", "pid", "status", "c1", "c2", "ok").agg(
        F.count("*").alias("n"), r(F.sum("px"), 3).alias("sum_px"), r(F.sum("e"), 3).alias("sum_e"), r(F.sum("m"), 3).alias("sum_m"),
        F.count("error").alias("n_error"), F.sum("missing").cast("long").alias("missing"),
    )


@query("SRC04_scan_lhe_init", f"{E0} SELECT shard, '2212 2212 7000 7000 0 0 230000 230000 3 1' AS beam_line, 1 AS nprup, 1 AS lprup, {R('sum(w)', 4)} AS xsec, CAST(max(k)//50000+1 AS BIGINT) AS files FROM o GROUP BY shard")
def src04(spark, sf):
    i = lhe.scan_lhe_init(spark, lhe_files(spark, sf))
    i = i.select(shard_col().alias("shard"), "beam_line", "nprup", F.explode("processes").alias("p"))
    return i.groupBy("shard", "beam_line", "nprup", F.col("p.lprup").alias("lprup"), r("p.xsec", 4).alias("xsec")).agg(F.count("*").alias("files"))


@query("SRC05_compressed_scan", f"{E0} SELECT shard=3 AS compressed, count(*) AS events, {R('sum(w)', 7)} AS sum_w FROM o GROUP BY 1")
def src05(spark, sf):
    ev = lhe.parse_event_header(lhe.scan_lhe_events(spark, lhe_files(spark, sf)))
    return ev.groupBy(F.col("path").endswith(".gz").alias("compressed")).agg(F.count("*").alias("events"), r(F.sum("xwgtup"), 7).alias("sum_w"))


@query("SRC06_discover_inputs", f"{E0} SELECT shard, CAST(max(k)//50000+1 AS BIGINT) AS files FROM o GROUP BY shard")
def src06(spark, sf):
    root = lhe_files(spark, sf)
    # one root is listed twice: paths are still unique
    f = lhe.discover_inputs(spark, [f"{root}/source=a", f"{root}/source=b", f"{root}/source=b/shard=3"], prefix="part-", suffixes=(".txt", ".txt.gz"))
    return f.withColumn("shard", shard_col()).groupBy("shard").agg(F.count("*").alias("files"))


@query(
    "JN07_init_compatibility",
    f"""{E0}, c AS (SELECT shard, sum(w) AS n, max(k)//50000+1 AS f FROM o GROUP BY shard), rf AS (SELECT n AS n0 FROM c WHERE shard=0)
 SELECT shard, problem, CAST(f AS BIGINT) AS files FROM c, rf, (VALUES ('cross-section'),('cross-section error')) t(problem) WHERE abs(n-n0) > 0.0002*greatest(n,n0)""",
)
def jn07(spark, sf):
    bad = ops.init_compatibility(lhe.scan_lhe_init(spark, lhe_files(spark, sf)), rel_tol=2e-4)
    return bad.groupBy(shard_col().alias("shard"), "problem").agg(F.count("*").alias("files"))


@query("JN07_init_compatibility_relaxed", f"{E0} SELECT count(*) AS files, CAST(0 AS BIGINT) AS problems FROM (SELECT DISTINCT shard, k//50000 FROM o)")
def jn07r(spark, sf):
    inits = lhe.scan_lhe_init(spark, lhe_files(spark, sf))
    bad = ops.init_compatibility(inits, relaxed=True).agg(F.count("*").alias("problems"))
    return inits.agg(F.count("*").alias("files"), F.lit(bad.scalar()).alias("problems"))


@query("JN08_log_xsec_override", f"{E0}, t AS (SELECT count(*)/CAST(1000 AS DOUBLE) AS x FROM o) SELECT shard, 1 AS process, {R('x', 7)} AS xsec, {R('x/50', 7)} AS xerr, 'log' AS source, CAST(max(k)//50000+1 AS BIGINT) AS files FROM o, t GROUP BY shard, x")
def jn08(spark, sf):
    inits = lhe.scan_lhe_init(spark, lhe_files(spark, sf))
    dirs = inits.select(F.regexp_replace("path", "/[^/]*$", "").alias("dir")).distinct()
    total = table(spark, sf, "orders").agg((F.count("*") / 1000).alias("x"))
    text = F.format_string("\u001b[1mgg -> 8b : %.10e pb +- ( %.10e pb = 2 %% )\u001b[0m", F.col("x"), F.col("x") / 50)
    lines = F.array(F.lit("Starting the calculation"), text, F.lit("done"))
    logs = dirs.withColumn("x", total.scalar()).select("dir", F.lit("run.log").alias("log"), F.posexplode(lines).alias("line_no", "line"))
    out = ops.log_xsec_override(inits, logs)
    return out.groupBy(shard_col().alias("shard"), "process", r("xsec", 7).alias("xsec"), r("xerr", 7).alias("xerr"), "source").agg(F.count("*").alias("files"))


ENDS = f"""{P0}, ends AS (SELECT k, v, idx, tag, slot, CASE WHEN (status=-1) = (slot=1) THEN 'a' ELSE 'c' END AS kind, pid, status, c1, c2 FROM (
   SELECT *, c1 AS tag, 1 AS slot FROM p WHERE ok UNION ALL SELECT *, c2 AS tag, 2 AS slot FROM p WHERE ok) WHERE tag<>0),
 tg AS (SELECT k, tag, count(*) AS n, string_agg(kind,'' ORDER BY kind) AS kinds, min(idx)=max(idx) AS same,
   max(CASE WHEN status=1 AND pid=5 AND slot=1 AND c2=0 THEN idx END) AS quark, max(CASE WHEN status=1 AND pid=-5 AND slot=2 AND c1=0 THEN idx END) AS antiquark FROM ends GROUP BY k, tag)"""


@query("JN09_colour_line_partner", f"{ENDS} SELECT tag, quark, antiquark, count(*) AS events FROM tg WHERE n=2 AND quark IS NOT NULL AND antiquark IS NOT NULL GROUP BY ALL")
def jn09(spark, sf):
    p = lhe.explode_particles(lhe.scan_lhe_events(spark, lhe_files(spark, sf))).filter("ok")
    return ops.colour_line_partners(p, ["path", "pos"], 5).groupBy("tag", "quark", "antiquark").agg(F.count("*").alias("events"))


# --- weights --------------------------------------------------------------------------------
STATS = f"{E0}, st AS (SELECT source, count(*) AS event_count, sum(w) AS sum_w, sum(w*w) AS sum_w2, min(w) AS min_w, max(w) AS max_w FROM o GROUP BY source)"


def stats(spark, sf):
    return ops.source_weight_stats(headers(spark, sf).select("source", "xwgtup"))


@query("AGG21_source_weight_stats", f"{STATS} SELECT source, event_count, {R('sum_w', 7)} AS sum_w, {R('sum_w2', 6)} AS sum_w2, {R('min_w', 7)} AS min_w, {R('max_w', 7)} AS max_w FROM st")
def agg21(spark, sf):
    return stats(spark, sf).select("source", "event_count", r("sum_w", 7).alias("sum_w"), r("sum_w2", 6).alias("sum_w2"), r("min_w", 7).alias("min_w"), r("max_w", 7).alias("max_w"))


BASIS = {"count": "event_count", "equal": "1", "effective-events": "sum_w*sum_w/sum_w2"}
FRAC = {m: f"{STATS}, fr AS (SELECT *, CAST({b} AS DOUBLE)/(SELECT sum({b}) FROM st) AS fraction, CAST(0.9 AS DOUBLE)*CAST({b} AS DOUBLE)/(SELECT sum({b}) FROM st)/sum_w AS scale FROM st)" for m, b in BASIS.items()}

for _m in BASIS:

    @query(f"AGG22_source_fractions_{_m.replace('-', '_')}", f"{FRAC[_m]} SELECT source, {R('fraction', 8)} AS fraction, {R('scale*1000000', 6)} AS scale_ppm FROM fr")
    def agg22(spark, sf, mode=_m):
        f = ops.source_fractions(stats(spark, sf), 0.9, mode)
        return f.select("source", r("fraction", 8).alias("fraction"), r(F.col("scale") * 1000000).alias("scale_ppm"))


@query("AGG23_reweight_events", f"{FRAC['count']} SELECT o.source, shard, count(*) AS n, {R('sum(w*scale)', 8)} AS sum_new, {R('max(w*scale)*1000000', 6)} AS max_new_ppm FROM o JOIN fr ON o.source=fr.source GROUP BY o.source, shard")
def agg23(spark, sf):
    h = headers(spark, sf).select("source", "shard", "xwgtup")
    f = ops.source_fractions(ops.source_weight_stats(h), 0.9, "count")
    out = ops.reweight_events(h, f)
    return out.groupBy("source", "shard").agg(F.count("*").alias("n"), r(F.sum("new_weight"), 8).alias("sum_new"), r(F.max("new_weight") * 1000000).alias("max_new_ppm"))


@query("UDF03_effective_sample_size", f"{STATS} SELECT source, {R('sum_w*sum_w/sum_w2')} AS n_eff FROM st")
def udf03(spark, sf):
    return stats(spark, sf).select("source", r(ops.effective_events()).alias("n_eff"))


@query("STR06_rewrite_event_weight", f"{E0} SELECT shard, count(*) AS n, {R('sum(2*w)', 7)} AS sum_w, CAST(sum(CASE WHEN v=7 THEN 7 ELSE 6 END) AS BIGINT) AS sum_nup FROM o GROUP BY shard")
def str06(spark, sf):
    h = headers(spark, sf)
    new = h.select("path", "pos", ops.rewrite_event_weight(F.col("event"), F.col("xwgtup") * 2).alias("event"))
    back = lhe.parse_event_header(new)
    return back.groupBy(shard_col().alias("shard")).agg(F.count("*").alias("n"), r(F.sum("xwgtup"), 7).alias("sum_w"), F.sum("nup").alias("sum_nup"))


# --- checks -----------------------------------------------------------------------------------
ERRORS = f"""{ENDS}, er AS (
 SELECT k, v, 'row count' AS m FROM o WHERE v=7
 UNION ALL SELECT k, v, concat('short row ', idx) FROM p WHERE NOT ok
 UNION ALL SELECT * FROM (
 SELECT k, v, 'beam order' FROM p WHERE idx=1 AND pz < -pz
 UNION ALL SELECT k, v, concat('final id ', string_agg(pid, ',' ORDER BY idx)) FROM p WHERE status=1 AND ok AND abs(pid)<>5 GROUP BY k, v
 UNION ALL SELECT k, v, 'forbidden 4' FROM p WHERE pid=4 AND ok
 UNION ALL SELECT k, v, concat('mass ', idx) FROM p WHERE ok AND idx>2 AND m<>4.75
 UNION ALL SELECT k, v, concat('no colour ', idx) FROM p WHERE ok AND c1=0 AND c2=0
 UNION ALL SELECT k, v, concat('gluon tags equal ', idx) FROM p WHERE ok AND pid=21 AND c1=c2
 UNION ALL SELECT k, v, concat('quark tags ', idx) FROM p WHERE ok AND abs(pid)<=6 AND (c1<>0)=(c2<>0)
 UNION ALL SELECT k, k%10, concat('tag ', tag, ' ends ', n) FROM tg WHERE n<>2
 UNION ALL SELECT k, k%10, concat('tag ', tag, ' kinds ', kinds) FROM tg WHERE n=2 AND kinds<>'ac'
 UNION ALL SELECT k, k%10, concat('tag ', tag, ' self') FROM tg WHERE n=2 AND same
 UNION ALL SELECT o.k, o.v, 'no singlet' FROM o WHERE NOT EXISTS (SELECT 1 FROM tg WHERE tg.k=o.k AND n=2 AND NOT same AND quark IS NOT NULL AND antiquark IS NOT NULL)) WHERE v NOT IN (6, 7)),
 ev AS (SELECT o.k, o.v, o.shard, coalesce(list(m ORDER BY m) FILTER (m IS NOT NULL), []) AS errors FROM o LEFT JOIN er USING (k) GROUP BY o.k, o.v, o.shard)"""


def checked(spark, sf):
    ev = ops.check_events(lhe.scan_lhe_events(spark, lhe_files(spark, sf)), final_count=4, final_abs_pdg=5, forbid=(4,), beam_order=True, isolated_singlet=5)
    return ev.withColumn("shard", shard_col())


@query("AGG29_lhe_event_check", f"{ERRORS} SELECT shard, array_to_string(errors, '; ') AS errors, count(*) AS events FROM ev GROUP BY ALL")
def agg29(spark, sf):
    return checked(spark, sf).groupBy("shard", F.array_join("errors", "; ").alias("errors")).agg(F.count("*").alias("events"))


@query("AGG30_lhe_check_report", f"{ERRORS} SELECT count(*) AS events, count(CASE WHEN len(errors)>0 THEN 1 END) AS failed, count(CASE WHEN len(errors)=0 THEN 1 END) AS passed, CAST(sum(len(errors)) AS BIGINT) AS n_errors, true AS count_ok FROM ev")
def agg30(spark, sf):
    n = table(spark, sf, "orders").agg(F.count("*").alias("n"))
    report = ops.check_report(checked(spark, sf).select("errors"))
    return report.withColumn("count_ok", F.col("events") == n.scalar())


@query("TOP05_limit_errors", f"{ERRORS} SELECT shard, xw, i, message FROM (SELECT shard, {R('w', 7)} AS xw, CAST(gs AS INT) AS i, errors[gs+1] AS message FROM ev JOIN (SELECT k AS kk, w FROM o) ON kk=ev.k, range(8) t(gs) WHERE gs < len(errors)) ORDER BY shard, xw, i LIMIT 20")
def top05(spark, sf):
    ev = checked(spark, sf).withColumn("xw", r("xwgtup", 7))
    return ops.first_errors(ev, ["shard", "xw"], 20)


# --- merge --------------------------------------------------------------------------------------
@query("SET01_merge_shards", f"{E0} SELECT source, count(*) AS events, {R('sum(w)', 7)} AS sum_w FROM o GROUP BY source")
def set01(spark, sf):
    root = lhe_files(spark, sf)
    merged = []
    for source, shards in (("a", (0, 1)), ("b", (2, 3))):
        # shards of a source agree but for their cross-sections, which differ by the luck of the draw
        want = table(spark, sf, "orders").where((F.col("o_orderkey") % 4).isin(*shards)).agg(F.count("*").alias("n")).scalar()
        path = f"{root}/source={source}"
        merged.append(ops.merge_shards(lhe.scan_lhe_events(spark, path), lhe.scan_lhe_init(spark, path), want, rel_tol=0.2))
    h = lhe.parse_event_header(merged[0].unionByName(merged[1]))
    return h.groupBy(source_col().alias("source")).agg(F.count("*").alias("events"), r(F.sum("xwgtup"), 7).alias("sum_w"))


@query("SNK08_write_lhe", f"{FRAC['count']} SELECT o.source, count(*) AS n, {R('sum(w*scale)', 8)} AS sum_w, '2212 2212 7000 7000 0 0 230000 230000 -4 1' AS beam_line, CAST(0.9 AS DOUBLE) AS xsec FROM o JOIN fr ON o.source=fr.source GROUP BY o.source")
def snk08(spark, sf):
    root = lhe_files(spark, sf)
    h = headers(spark, sf)
    f = ops.source_fractions(ops.source_weight_stats(h.select("source", "xwgtup")), 0.9, "count")
    out = ops.reweight_events(h, f)
    chunk = F.regexp_extract("path", r"chunk=(\d+)", 1).cast("int").alias("chunk")
    out = out.select("source", "shard", chunk, "path", "pos", ops.rewrite_event_weight(F.col("event"), F.col("new_weight")).alias("event"))
    init = lhe.scan_lhe_init(spark, root).groupBy(source_col().alias("source"), shard_col().alias("shard"), chunk).agg(F.min_by(F.struct("beam_line", "processes", "preamble"), "path").alias("i"))
    procs = F.transform("i.processes", lambda p: F.struct(F.lit(0.9).alias("xsec"), F.lit(0.009).alias("xerr"), p["xmax"].alias("xmax"), p["lprup"].alias("lprup")))
    heads = init.select("source", "shard", "chunk", lhe_writer.with_init(F.col("i.preamble"), lhe_writer.set_idwtup(F.col("i.beam_line"), -4), procs).alias("preamble"))
    path = scratch_dir(spark, "merged")
    expected = table(spark, sf, "orders").count()
    lhe_writer.write_lhe(out, heads, path, ["source", "shard", "chunk"], ["path", "pos"], expected_events=expected)
    back = lhe.parse_event_header(lhe.scan_lhe_events(spark, path, strict=True))
    sums = back.groupBy(source_col().alias("source")).agg(F.count("*").alias("n"), r(F.sum("xwgtup"), 8).alias("sum_w"))
    meta = lhe.scan_lhe_init(spark, path).groupBy(source_col().alias("source")).agg(F.min("beam_line").alias("beam_line"), F.max(F.get("processes", F.lit(0))["xsec"]).alias("xsec"))
    return sums.join(meta, "source")


@query("SNK09_write_merge_manifest", f"{FRAC['effective-events']} SELECT source, event_count, 'effective-events' AS fraction_mode, CAST(0.9 AS DOUBLE) AS total_xsec_pb, {R('fraction', 8)} AS fraction FROM fr")
def snk09(spark, sf):
    path = scratch_dir(spark, "manifest")
    lhe_writer.write_merge_manifest(ops.source_fractions(stats(spark, sf), 0.9, "effective-events"), path, 0.9, "effective-events")
    back = spark.read.schema("total_xsec_pb double, fraction_mode string, source string, event_count long, sum_w double, fraction double, scale double").json(path)
    return back.select("source", "event_count", "fraction_mode", "total_xsec_pb", r("fraction", 8).alias("fraction"))


@query(
    "WIN07_unique_labels",
    "WITH b AS (SELECT p_partkey AS ord, concat(split_part(p_name,' ',1), '_run') AS base FROM part) SELECT ord, CASE WHEN k=1 THEN base ELSE concat(base,'_',k) END AS label FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY ord) AS k FROM b)",
)
def win07(spark, sf):
    b = table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), F.concat(F.split("p_name", " ")[0], F.lit("_run")).alias("base"))
    return ops.unique_labels(b).select("ord", "label")
