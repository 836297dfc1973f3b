"""Histogram queries over all jets."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkcollide.operators import hist
from sparkcollide.plans import sqltext as S
from sparkcollide.plans.registry import query
from sparkcollide.session import scratch_dir, table
from sparkcollide.sources import fixtures

R = S.rnd
LO, HI, N = 0.0, 300.0, 60
W5 = (HI - LO) / N


def r(c, n=6):
    return F.round(c, n)


def weighted_jets(spark, sf):
    """Jets with their event weight."""
    j = fixtures.jets(spark, sf).select("event_id", "tag", "pt0", "eta0", "e")
    return j.join(fixtures.events_w(spark, sf).select("event_id", "evweight", "sample"), "event_id")


WJ = f"WITH {S.JETS}, {S.EVENTS_W}, wj AS (SELECT jets.event_id, tag, pt0, eta0, e, evweight, sample FROM jets JOIN ew USING (event_id))"
H1 = f"""{WJ}, f AS (SELECT tag, CAST(ceil(pt0/5)-1 AS INT) AS bin, sum(evweight) AS c FROM wj WHERE pt0>0 AND pt0<300 GROUP BY ALL),
 sp AS (SELECT tag, CAST(b AS INT) AS bin FROM (SELECT DISTINCT tag FROM wj), range(60) t(b)),
 h AS (SELECT tag, bin, coalesce(c,0) AS content, (bin+CAST(0.5 AS DOUBLE))*5 AS center FROM sp LEFT JOIN f USING (tag,bin))"""


def h1(spark, sf):
    return hist.histogram_1d(weighted_jets(spark, sf), F.col("pt0"), F.col("evweight"), ["tag"], LO, HI, N)


@query("AGG03_histogram_1d", f"{H1} SELECT tag, bin, center, {R('content', 7)} AS content FROM h")
def agg03(spark, sf):
    return h1(spark, sf).select("tag", "bin", "center", r("content", 7).alias("content"))


@query("AGG03_histogram_1d_unit", f"{H1} SELECT tag, bin, {R('content/sum(content) OVER (PARTITION BY tag)')} AS content FROM h")
def agg03u(spark, sf):
    h = hist.histogram_1d(weighted_jets(spark, sf), F.col("pt0"), F.col("evweight"), ["tag"], LO, HI, N, unit=True)
    return h.select("tag", "bin", r("content").alias("content"))


@query(
    "AGG04_histogram_2d",
    f"""WITH {S.JETS} SELECT tag, CAST(ceil(pt0/5)-1 AS INT) AS xbin, CAST(ceil((eta0+CAST(2.7 AS DOUBLE))/CAST(0.9 AS DOUBLE))-1 AS INT) AS ybin, count(*) AS n FROM jets
 WHERE pt0>0 AND pt0<300 AND eta0>-2.7 AND eta0<2.7 GROUP BY ALL""",
)
def agg04(spark, sf):
    return hist.histogram_2d(fixtures.jets(spark, sf), F.col("pt0"), F.col("eta0"), ["tag"], (LO, HI, N), (-2.7, 2.7, 6))


@query("AGG05_profile", f"WITH {S.JETS} SELECT tag, CAST(ceil(pt0/5)-1 AS INT) AS bin, {R('sum(e)/count(*)')} AS mean_y, count(*) AS n FROM jets WHERE pt0>0 AND pt0<300 GROUP BY ALL")
def agg05(spark, sf):
    return hist.profile(fixtures.jets(spark, sf), F.col("pt0"), F.col("e"), ["tag"], LO, HI, N).select("tag", "bin", r("mean_y").alias("mean_y"), "n")


@query("AGG06_density_normalise", f"{H1} SELECT tag, bin, {R('2*60*content/(sum(content) OVER (PARTITION BY tag)*300)')} AS density FROM h")
def agg06(spark, sf):
    return hist.density_normalise(h1(spark, sf), ["tag"], LO, HI, N, factor=2.0).select("tag", "bin", r("density").alias("density"))


@query(
    "AGG06_density_attempted_weight",
    f"{H1}, t AS (SELECT tag, sum(evweight) AS total FROM wj GROUP BY tag) SELECT tag, bin, {R('60*content/(total*300)')} AS density FROM h JOIN t USING (tag)",
)
def agg06b(spark, sf):
    attempted = weighted_jets(spark, sf).groupBy("tag").agg(F.sum("evweight").alias("total"))
    return hist.density_normalise(h1(spark, sf), ["tag"], LO, HI, N, total=attempted).select("tag", "bin", r("density").alias("density"))


@query(
    "AGG07_histogram_arithmetic",
    f"""{H1}, a AS (SELECT bin, content AS x FROM h WHERE tag='b'), b AS (SELECT bin, content AS z FROM h WHERE tag='c')
 SELECT bin, {R('x+z', 7)} AS added, {R('x-z', 7)} AS subtracted, {R('CASE WHEN z<>0 THEN x/z ELSE 0 END')} AS divided FROM a JOIN b USING (bin)""",
)
def agg07(spark, sf):
    h = h1(spark, sf)
    out = hist.histogram_arithmetic(h.filter("tag = 'b'"), h.filter("tag = 'c'"), N)
    return out.select("bin", r("added", 7).alias("added"), r("subtracted", 7).alias("subtracted"), r("divided").alias("divided"))


@query("AGG08_mode_bin", f"{H1} SELECT tag, center AS mode_center FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY content DESC, bin) AS k FROM h) WHERE k=1")
def agg08(spark, sf):
    return hist.mode_bin(h1(spark, sf), ["tag"])


# shard-level histograms: shard = order key modulo 4, weight from the price
def shard_rows(spark, sf):
    j = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return j.select(
        F.concat(F.lit("run"), (F.col("l_orderkey") % 4).cast("string")).alias("shard"),
        F.when(F.col("l_linenumber") <= 5, "b").when(F.col("l_linenumber") == 6, "c").otherwise("l").alias("hist"),
        (15 + F.lit(1.2) * F.col("l_quantity")).alias("x"),
        (F.col("l_extendedprice") / F.lit(100000.0)).alias("w"),
    )


NB = 12  # 20..68 in 12 bins leaves entries in both flow bins
SR = """WITH sr AS (SELECT concat('run', CAST(l_orderkey % 4 AS VARCHAR)) AS shard, CASE WHEN l_linenumber <= 5 THEN 'b' WHEN l_linenumber = 6 THEN 'c' ELSE 'l' END AS hist,
 15 + CAST(1.2 AS DOUBLE)*l_quantity AS x, l_extendedprice/CAST(100000 AS DOUBLE) AS w FROM lineitem)"""


def sumw2_sql(binexpr: str, n: int) -> str:
    return f"""fl AS (SELECT shard, hist, CAST(count(*) AS DOUBLE) AS fills FROM sr GROUP BY ALL),
 bb AS (SELECT *, CAST(greatest(0, least({n + 1}, floor({binexpr}))) AS INT) AS bin FROM sr WHERE w<>0),
 fb AS (SELECT shard, hist, bin, sum(w) AS y, CASE WHEN bin IN (0,{n + 1}) THEN max(w) ELSE sum(w*w) END AS y2, count(*) AS n FROM bb GROUP BY shard, hist, bin),
 h9 AS (SELECT shard, hist, bin, fills, coalesce(y,0) AS y, coalesce(y2,0) AS y2, coalesce(n,0) AS n FROM (SELECT shard, hist, fills, CAST(b AS INT) AS bin FROM fl, range({n + 2}) t(b)) LEFT JOIN fb USING (shard,hist,bin))"""


H9 = f"{SR}, {sumw2_sql('(x-20)/CAST(4 AS DOUBLE)+1', NB)}"
FIN = f"""{H9}, h10 AS (SELECT shard, hist, bin, fills, y/(fills*4) AS y, CASE WHEN fills>1 THEN (y2/(fills*16) - pow(y/(fills*4),2))/(fills-1) ELSE y2/(fills*16) END AS y2 FROM h9)"""


def h9(spark, sf):
    return hist.histogram_sumw2(shard_rows(spark, sf), F.col("x"), F.col("w"), ["shard", "hist"], 20.0, 68.0, NB)


def final(spark, sf):
    return hist.finalize(h9(spark, sf), 4.0)


@query("AGG09_histogram_sumw2", f"{H9} SELECT shard, hist, bin, fills, n, {R('y', 7)} AS y, {R('y2', 7)} AS y2 FROM h9")
def agg09(spark, sf):
    return h9(spark, sf).select("shard", "hist", "bin", "fills", "n", r("y", 7).alias("y"), r("y2", 7).alias("y2"))


@query("AGG09_histogram_sumw2_log", f"{SR}, {sumw2_sql('(log10(x)-CAST(1.3 AS DOUBLE))/CAST(0.05 AS DOUBLE)+1', 10)} SELECT shard, hist, bin, fills, n, {R('y', 7)} AS y, {R('y2', 7)} AS y2 FROM h9")
def agg09log(spark, sf):
    h = hist.histogram_sumw2(shard_rows(spark, sf), F.col("x"), F.col("w"), ["shard", "hist"], 1.3, 1.8, 10, log=True)
    return h.select("shard", "hist", "bin", "fills", "n", r("y", 7).alias("y"), r("y2", 7).alias("y2"))


@query(
    "AGG10_finalize_restore",
    f"{FIN} SELECT h10.shard, h10.hist, h10.bin, {R('h10.y*1000', 6)} AS y_final, {R('h10.y2*1000000', 4)} AS y2_final, {R("h9.y", 7)} AS y_back, {R("h9.y2", 7)} AS y2_back FROM h10 JOIN h9 ON h10.shard=h9.shard AND h10.hist=h9.hist AND h10.bin=h9.bin",
)
def agg10(spark, sf):
    f = final(spark, sf).withColumns({"yf": F.col("y"), "y2f": F.col("y2")})
    return hist.restore(f, 4.0).select(
        "shard", "hist", "bin", r(F.col("yf") * 1000, 6).alias("y_final"), r(F.col("y2f") * 1000000, 4).alias("y2_final"), r("y", 7).alias("y_back"), r("y2", 7).alias("y2_back")
    )


@query(
    "AGG11_histogram_stats",
    f"""{FIN} SELECT shard, hist, {R('2*sum(y)*4')} AS integral, {R(f'sum(CASE WHEN bin BETWEEN 1 AND {NB} THEN y*(20+(bin-CAST(0.5 AS DOUBLE))*48/CAST({NB + 2} AS DOUBLE)) END)/sum(CASE WHEN bin BETWEEN 1 AND {NB} THEN y END)')} AS average,
 {R(f'2*avg(CASE WHEN bin BETWEEN 1 AND {NB} THEN y END)')} AS mean, {R(f'2*min(CASE WHEN bin BETWEEN 1 AND {NB} AND y<>0 THEN y END)')} AS ymin, {R(f'2*max(CASE WHEN bin BETWEEN 1 AND {NB} THEN y END)')} AS ymax FROM h10 GROUP BY ALL""",
)
def agg11(spark, sf):
    s = hist.histogram_stats(final(spark, sf), ["shard", "hist"], 20.0, 68.0, NB, scale=2.0)
    return s.select("shard", "hist", *[r(c).alias(c) for c in ("integral", "average", "mean", "ymin", "ymax")])


LOG_WIDTH = f"(pow(10, 1.3+bin*CAST({0.5 / 12!r} AS DOUBLE)) - pow(10, 1.3+(bin-1)*CAST({0.5 / 12!r} AS DOUBLE)))"


@query(
    "AGG11_histogram_stats_log",
    f"{SR}, {sumw2_sql('(log10(x)-CAST(1.3 AS DOUBLE))/CAST(0.05 AS DOUBLE)+1', 10)} SELECT shard, hist, {R(f'sum(CASE WHEN bin BETWEEN 1 AND 10 THEN y*{LOG_WIDTH} END)/sum(CASE WHEN bin BETWEEN 1 AND 10 THEN {LOG_WIDTH} END)', 4)} AS mean, {R('max(CASE WHEN bin BETWEEN 1 AND 10 THEN y END)', 5)} AS ymax FROM h9 GROUP BY ALL",
)
def agg11log(spark, sf):
    h = hist.histogram_sumw2(shard_rows(spark, sf), F.col("x"), F.col("w"), ["shard", "hist"], 1.3, 1.8, 10, log=True)
    return hist.histogram_stats(h, ["shard", "hist"], 1.3, 1.8, 10, log=True).select("shard", "hist", r("mean", 4).alias("mean"), r("ymax", 5).alias("ymax"))


OPT_STEP = "CASE WHEN y2{i}<>0 AND z2<>0 AND y{i}*y{i}/y2{i}>0 AND z*z/z2>0 THEN {a} ELSE {b} END"
COMBINE_SQL = {
    "cmb": f"""SELECT hist, bin, fills, sy/(fills*4) AS y, (sy2/(fills*16)-pow(sy/(fills*4),2))/(fills-1) AS y2 FROM (SELECT hist, bin, sum(fills) AS fills, sum(y) AS sy, sum(y2) AS sy2 FROM h9 GROUP BY ALL)""",
    "add": "SELECT hist, bin, sum(fills) AS fills, sum(y) AS y, sum(y2) AS y2 FROM h10 GROUP BY ALL",
    "rescale": "SELECT hist, bin, sum(fills) AS fills, 3*sum(y) AS y, 9*sum(y2) AS y2 FROM h10 GROUP BY ALL",
    "min": "SELECT hist, bin, fills0 AS fills, y, y2 FROM (SELECT *, row_number() OVER (PARTITION BY hist,bin ORDER BY y, shard) AS k, first_value(fills) OVER (PARTITION BY hist,bin ORDER BY shard) AS fills0 FROM h10) WHERE k=1",
    "max": "SELECT hist, bin, fills0 AS fills, y, y2 FROM (SELECT *, row_number() OVER (PARTITION BY hist,bin ORDER BY y DESC, shard) AS k, first_value(fills) OVER (PARTITION BY hist,bin ORDER BY shard) AS fills0 FROM h10) WHERE k=1",
}


def _opt_sql() -> str:
    steps = ["o0 AS (SELECT hist, bin, y, y2, fills FROM h10 WHERE shard='run0')"]
    for i in (1, 2, 3):
        ok = "(a.y2<>0 AND b.y2<>0 AND a.y*a.y>0 AND b.y*b.y>0 AND a.y*a.y/a.y2>0 AND b.y*b.y/b.y2>0)"
        wa = f"CASE WHEN {ok} THEN a.y*a.y/a.y2 ELSE 1 END"
        wb = f"CASE WHEN {ok} THEN b.y*b.y/b.y2 ELSE 1 END"
        steps.append(
            f"o{i} AS (SELECT hist, bin, (y1*w1+z1*w2)/(w1+w2) AS y, pow((y1*w1+z1*w2)/(w1+w2),2)/(w1+w2) AS y2, fills FROM "
            f"(SELECT a.hist, a.bin, a.y AS y1, b.y AS z1, {wa} AS w1, {wb} AS w2, a.fills+b.fills AS fills FROM o{i-1} a JOIN h10 b ON a.hist=b.hist AND a.bin=b.bin AND b.shard='run{i}'))"
        )
    return ", ".join(steps)


for _mode, _sql in COMBINE_SQL.items():

    @query(f"AGG12_combine_histograms_{_mode}", f"{FIN} SELECT hist, bin, fills, {R('y*1000')} AS y, {R('y2*1000000', 4)} AS y2 FROM ({_sql})")
    def agg12(spark, sf, mode=_mode):
        h = hist.combine_histograms(final(spark, sf), ["hist"], 4.0, mode, factor=3.0)
        return h.select("hist", "bin", "fills", r(F.col("y") * 1000).alias("y"), r(F.col("y2") * 1000000, 4).alias("y2"))


@query("AGG12_combine_histograms_opt", f"{FIN}, {_opt_sql()} SELECT hist, bin, fills, {R('y*1000')} AS y, {R('y2*1000000', 4)} AS y2 FROM o3")
def agg12opt(spark, sf):
    h = hist.combine_histograms(final(spark, sf), ["hist"], 4.0, "opt")
    return h.select("hist", "bin", "fills", r(F.col("y") * 1000).alias("y"), r(F.col("y2") * 1000000, 4).alias("y2"))


@query(
    "AGG13_shard_compatibility",
    f"""{FIN}, q AS (SELECT *, abs(y2-y*y) > CAST(1e-12 AS DOUBLE)*(abs(y2)+y*y) AS ok FROM h10 WHERE bin BETWEEN 1 AND {NB}),
 p AS (SELECT a.hist, a.shard, b.shard AS shard_b, a.ok AND b.ok AND a.y2+b.y2>0 AS u, CASE WHEN a.ok AND b.ok AND a.y2+b.y2>0 THEN (a.y-b.y)/sqrt(a.y2+b.y2) ELSE 0 END AS d FROM q a JOIN q b ON a.hist=b.hist AND a.bin=b.bin AND a.shard<b.shard),
 g AS (SELECT hist, shard, shard_b, count(CASE WHEN u THEN 1 END) AS n_used, sum(d) AS s, sum(d*d) AS s2 FROM p GROUP BY ALL)
 SELECT hist, shard, shard_b, n_used, {R('CASE WHEN n_used>0 THEN s/n_used ELSE 0 END')} AS avg_pull, {R('CASE WHEN n_used>0 THEN sqrt(s2/n_used) ELSE 0 END')} AS rms_pull,
 CASE WHEN n_used<=1 THEN 'unchecked' WHEN sqrt(s2/n_used)>1.5 THEN 'incompatible' WHEN s2=0 THEN 'identical' WHEN sqrt(s2/n_used)<0.5 THEN 'correlated' ELSE 'compatible' END AS status FROM g""",
)
def agg13(spark, sf):
    out = hist.shard_compatibility(final(spark, sf), ["hist"], NB)
    return out.select("hist", "shard", "shard_b", "n_used", r("avg_pull").alias("avg_pull"), r("rms_pull").alias("rms_pull"), "status")


@query(
    "AGG13_pair_summary",
    f"""{FIN}, q AS (SELECT *, abs(y2-y*y) > CAST(1e-12 AS DOUBLE)*(abs(y2)+y*y) AS ok FROM h10 WHERE bin BETWEEN 1 AND {NB}),
 p AS (SELECT a.hist, a.shard, b.shard AS shard_b, a.ok AND b.ok AND a.y2+b.y2>0 AS u, CASE WHEN a.ok AND b.ok AND a.y2+b.y2>0 THEN (a.y-b.y)/sqrt(a.y2+b.y2) ELSE 0 END AS d FROM q a JOIN q b ON a.hist=b.hist AND a.bin=b.bin AND a.shard<b.shard),
 g AS (SELECT hist, shard, shard_b, round(sqrt(sum(d*d)/count(CASE WHEN u THEN 1 END)),9) AS rms FROM p GROUP BY ALL HAVING count(CASE WHEN u THEN 1 END) > 1)
 SELECT shard, shard_b, count(*) AS n_checked, {R('greatest(max(rms),1)')} AS worst, min_by(hist, hist) FILTER (rms > 1 AND rms = mx) AS worst_hist, count(CASE WHEN rms>1.5 THEN 1 END) AS n_incompatible,
 {R('least(min(rms),1)')} AS least, min_by(hist, hist) FILTER (rms < 1 AND rms = mn) AS least_hist, count(CASE WHEN rms<0.5 THEN 1 END) AS n_correlated,
 CASE WHEN max(rms)>1.5 THEN 'incompatible' WHEN min(rms)=0 THEN 'identical' WHEN min(rms)<0.5 THEN 'correlated' ELSE 'passed' END AS status
 FROM (SELECT *, max(rms) OVER (PARTITION BY shard, shard_b) AS mx, min(rms) OVER (PARTITION BY shard, shard_b) AS mn FROM g) GROUP BY shard, shard_b""",
)
def agg13s(spark, sf):
    out = hist.pair_summary(final(spark, sf), "hist", NB)
    return out.withColumns({"worst": r("worst"), "least": r("least")})


@query(
    "AGG14_ratio_profile",
    f"""WITH {S.JETS}, b AS (SELECT tag, CAST(greatest(0, least({NB + 1}, floor((pt0-20)/CAST(4 AS DOUBLE)+1))) AS INT) AS bin, e, 1+l_linenumber/CAST(8 AS DOUBLE) AS w FROM jets),
 nn AS (SELECT tag, CAST(count(*) AS DOUBLE) AS n FROM b GROUP BY tag),
 s AS (SELECT tag, bin, sum(e*w)/any_value(n) AS o, sum(pow(e*w,2))/pow(any_value(n),2) AS o2, sum(w)/any_value(n) AS m, sum(w*w)/pow(any_value(n),2) AS m2, any_value(n) AS n FROM b JOIN nn USING (tag) GROUP BY tag, bin)
 SELECT tag, bin, {R('o/m')} AS ratio, {R('pow(o/m*(sqrt((n*o2-o*o)/(n-1))/abs(o)+sqrt((n*m2-m*m)/(n-1))/abs(m)),2)', 4)} AS ratio_var, {R('m', 8)} AS norm FROM s""",
)
def agg14(spark, sf):
    j = fixtures.jets(spark, sf)
    out = hist.ratio_profile(j, F.col("pt0"), F.col("e"), 1 + F.col("l_linenumber") / F.lit(8.0), ["tag"], 20.0, 68.0, NB)
    return out.select("tag", "bin", r("ratio").alias("ratio"), r("ratio_var", 4).alias("ratio_var"), r("norm", 8).alias("norm"))


@query("SNK10_export_histograms", f"{H1} SELECT tag AS title, center, {R('content/sum(content) OVER (PARTITION BY tag)')} AS content FROM h")
def snk10(spark, sf):
    path = scratch_dir(spark, "hist")
    h = hist.histogram_1d(weighted_jets(spark, sf), F.col("pt0"), F.col("evweight"), ["tag"], LO, HI, N, unit=True)
    hist.write_histogram_table(h.select(F.col("tag").alias("title"), "center", r("content").alias("content")), path)
    return spark.read.schema("title string, center double, content double").option("header", True).csv(path)
