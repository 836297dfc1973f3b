"""Limits, fits and coupling grids; coefficients are derived from ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkcollide.functions import couplings as cf
from sparkcollide.functions import noise, text
from sparkcollide.operators import grid as gr
from sparkcollide.operators import inference as inf
from sparkcollide.plans import sqltext as S
from sparkcollide.plans.registry import query
from sparkcollide.plans.sample_queries import LUMI, SP, scored
from sparkcollide.session import scratch_dir, table
from sparkcollide.sources import fixtures

R = S.rnd


def r(c, n=6):
    return F.round(c, n)


# --- Poisson ------------------------------------------------------------------------------
HYP = "WITH hyp AS (SELECT p_partkey AS k, CAST(p_size AS INT) AS n, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice/CAST(8 AS DOUBLE) ELSE p_retailprice/CAST(64 AS DOUBLE) END AS mean FROM part)"


def hypotheses(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("n"), (F.col("p_retailprice") / F.when(F.col("p_partkey") % 3 == 0, 8.0).otherwise(64.0)).alias("mean"))


@query("INF01_poisson_cdf", f"{HYP} SELECT k, {R('sum(exp(-mean + i*ln(mean) - lgamma(CAST(i+1 AS DOUBLE))))', 9)} AS cdf FROM hyp, range(60) x(i) WHERE i <= n GROUP BY k")
def inf01(spark, sf):
    return hypotheses(spark, sf).select("k", r(inf.poisson_cdf(F.col("n"), F.col("mean")), 9).alias("cdf"))


@query(
    "INF01_poisson_median",
    f"""{HYP}, c AS (SELECT k, i, mean, sum(exp(-mean + i*ln(mean) - lgamma(CAST(i+1 AS DOUBLE)))) OVER (PARTITION BY k ORDER BY i) AS c FROM hyp, range(110) x(i) WHERE mean <= 100)
 SELECT k, CAST(min(i) AS INT) AS median FROM c WHERE c >= 0.5 GROUP BY k UNION ALL SELECT k, CAST(floor(mean + 1/CAST(3 AS DOUBLE) - 0.02/mean) AS INT) FROM hyp WHERE mean > 100""",
)
def inf01m(spark, sf):
    return hypotheses(spark, sf).select("k", inf.poisson_median(F.col("mean")).alias("median"))


for _m in ("cls", "classical"):

    @query(f"INF02_poisson_upper_limit_{_m}")
    def inf02(spark, sf, method=_m):
        h = hypotheses(spark, sf).withColumn("observed", inf.poisson_median(F.col("mean")))
        return h.select("k", r(inf.upper_limit(method)(F.col("mean"), F.col("observed")), 6).alias("s95"))


@query("INF02_upper_limit_zero_observed", f"{HYP} SELECT k, {R('-ln(CAST(0.05 AS DOUBLE))')} AS s95 FROM hyp")
def inf02z(spark, sf):
    return hypotheses(spark, sf).select("k", r(inf.upper_limit("cls")(F.col("mean"), F.lit(0)), 6).alias("s95"))


@query("INF02_tail_at_limit", f"{HYP} SELECT k, CAST(0.05 AS DOUBLE) AS cls_tail, CAST(0.05 AS DOUBLE) AS classical_tail FROM hyp")
def inf02t(spark, sf):
    """The series of INF01 evaluated at the bisection limits gives back 1 - CL."""
    h = hypotheses(spark, sf).withColumn("obs", inf.poisson_median(F.col("mean")))
    h = h.withColumns({"cls": inf.upper_limit("cls")(F.col("mean"), F.col("obs")), "cla": inf.upper_limit("classical")(F.col("mean"), F.col("obs"))})
    tail = lambda s: inf.poisson_cdf(F.col("obs"), F.col("mean") + F.col(s))
    return h.select("k", r(tail("cls") / inf.poisson_cdf(F.col("obs"), F.col("mean"))).alias("cls_tail"), r(tail("cla")).alias("classical_tail"))


LS = f"""{SP}, bt AS (SELECT sum(sel) AS b FROM sp WHERE sig=0), ls AS (SELECT sp.*, b, -ln(CAST(0.05 AS DOUBLE)) AS need FROM sp, bt WHERE sig=1)"""


def scan_rows(spark, sf, need=2.995732273553991):
    s = scored(spark, sf)
    b = s.filter("sig = 0").agg(F.sum("expected_selected").alias("b"))
    return inf.limit_scan(s.filter("sig = 1"), b.scalar(), F.lit(need), LUMI, alpha=0.1)


@query(
    "INF03_limit_scan",
    f"""{LS} SELECT sample_id, {R('b', 4)} AS background_events, {R('sel/sqrt(b)')} AS s_over_sqrt_b, {R('sel/sqrt(b+CAST(0.01 AS DOUBLE)*b*b)', 8)} AS significance_with_systematics, {R('CASE WHEN sel>0 THEN need/sel END', 5)} AS signal_scale_to_95cl,
 {R('CASE WHEN sel>0 THEN xsec_fb*need/sel END')} AS xsec_95cl_fb, sel >= need AS excluded_95cl, {R('CASE WHEN sel>0 THEN 2*sqrt(b)/sel END', 4)} AS gaussian_signal_scale_to_target, sel/sqrt(b) >= 2 AS gaussian_excluded, {R('err/3000', 9)} AS sigma_eff_error_fb FROM ls""",
)
def inf03(spark, sf):
    d = scan_rows(spark, sf)
    return d.select(
        "sample_id", r("background_events", 4).alias("background_events"), r("s_over_sqrt_b").alias("s_over_sqrt_b"), r("significance_with_systematics", 8).alias("significance_with_systematics"),
        r("signal_scale_to_95cl", 5).alias("signal_scale_to_95cl"), r("xsec_95cl_fb").alias("xsec_95cl_fb"), "excluded_95cl", r("gaussian_signal_scale_to_target", 4).alias("gaussian_signal_scale_to_target"),
        "gaussian_excluded", r("sigma_eff_error_fb", 9).alias("sigma_eff_error_fb"),
    )


@query(
    "SCL13_gaussian_significance",
    f"""WITH g AS (SELECT p_partkey AS k, p_retailprice/CAST(500 AS DOUBLE) AS z FROM part) SELECT k, {R('exp(-(z-1)*(z-1)/(2*0.25))/(sqrt(2*pi())*0.5)')} AS density,
 {R('2/sqrt(pi())*list_sum(list_transform(range(0,60), lambda i: CASE WHEN i%2=0 THEN 1 ELSE -1 END*exp((2*i+1)*ln(z/sqrt(2)) - lgamma(CAST(i+1 AS DOUBLE)))/(2*i+1)))')} AS p, {R('z*10/sqrt(50+CAST(0.01 AS DOUBLE)*2500)')} AS signif FROM g""",
)
def scl13(spark, sf):
    z = F.col("p_retailprice") / 500
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("k"), r(cf.gaussian(z, 1.0, 0.5)).alias("density"), r(cf.central_probability(z)).alias("p"), r(cf.significance(z * 10, F.lit(50.0), 0.1)).alias("signif"),
    )


# --- points and surfaces --------------------------------------------------------------------
PT = "pc AS (SELECT p_partkey AS k, p_brand AS surface, 30*sin(CAST(p_partkey*37 AS DOUBLE)) AS c3, 600*sin(CAST(p_partkey*53+1 AS DOUBLE)) AS d4, p_retailprice/CAST(1000 AS DOUBLE) AS value FROM part)"


def points(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        k.alias("k"), F.col("p_brand").alias("surface"), (30 * F.sin((k * 37).cast("double"))).alias("c3"), (600 * F.sin((k * 53 + 1).cast("double"))).alias("d4"),
        (F.col("p_retailprice") / 1000).alias("value"),
    )


def surf_sql(n: int, name: str = "sf") -> str:
    return f"{name} AS (SELECT p_brand AS surface, {', '.join(f'coalesce(avg(CASE WHEN p_partkey % {n} = {i} THEN p_retailprice END),0)/CAST({1000 * (i + 1)} AS DOUBLE) AS q{i}' for i in range(n))} FROM part GROUP BY p_brand)"


def surfaces(spark, sf, n):
    k = F.col("p_partkey")
    coef = [F.coalesce(F.avg(F.when(k % n == i, F.col("p_retailprice"))), F.lit(0.0)) / float(1000 * (i + 1)) for i in range(n)]
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("surface")).agg(F.array(*coef).alias("coefficients"))


def cheb_sql(c3: str = "c3", d4: str = "d4") -> list[str]:
    x = {"3": f"((2*(1+{c3})+29-31)/CAST(60 AS DOUBLE))", "4": f"((2*(1+{d4})+599-601)/CAST(1200 AS DOUBLE))"}
    t = lambda i, v: f"cos({i}*acos(least(CAST(1 AS DOUBLE),greatest(CAST(-1 AS DOUBLE),{x[v]}))))" if i else "1"
    return [f"{t(i, '3')}*{t(j, '4')}" for i, j in cf.CHEB_TERMS]


SURF_VAL = "(" + "+".join(f"q{k}*{b}" for k, b in enumerate(cheb_sql())) + ")"


@query("SCL15_chebyshev_basis", f"WITH {PT} SELECT k, {', '.join(f'{R(b, 6)} AS t{i}' for i, b in enumerate(cheb_sql()))} FROM pc")
def scl15(spark, sf):
    return points(spark, sf).select("k", *[r(b).alias(f"t{i}") for i, b in enumerate(cf.chebyshev_basis(F.col("c3"), F.col("d4")))])


WAVE = lambda s: f"""CASE WHEN {s} > 62500 THEN abs(3*15625*sqrt({s}*{s}-62500*{s})/(32*pi()*{s}*({s}-15625)*60516) * (-(1+d4)*({s}-15625) - 3*(1+c3)*(1+c3)*15625 + 6*(1+c3)*(1+c3)*15625*({s}-15625)/({s}-62500)*ln({s}/CAST(15625 AS DOUBLE)-3))) ELSE 0 END"""


@query("SCL16_partial_wave", f"WITH {PT}, e AS (SELECT *, CAST(200 + 10*(k % 480) AS DOUBLE)*(200 + 10*(k % 480)) AS s FROM pc) SELECT k, {R(WAVE('s'), 6)} AS a0 FROM e")
def scl16(spark, sf):
    e = (200 + 10 * (F.col("k") % 480)).cast("double")
    return points(spark, sf).select("k", r(cf.partial_wave(e * e, F.col("c3"), F.col("d4"))).alias("a0"))


def poly_sql(model: str, sub: dict[str, str], coef=lambda i: f"q{i}") -> str:
    terms = []
    for i, powers in enumerate(cf.monomials(model)):
        terms.append("*".join([coef(i)] + [f"pow(CAST({sub.get(v, '0')} AS DOUBLE),{p})" for v, p in powers.items()]))
    return "(" + "+".join(terms) + ")"


CP = {"c3": "c3/10", "d4": "d4/100", "ct1": "value", "ct2": "(value-1)", "ct3": "(c3/30)"}
for _model in cf.MODELS:

    @query(f"SCL17_coupling_polynomial_{_model}", f"WITH {PT} SELECT k, {R(poly_sql(_model, CP, lambda i: f'CAST({(i % 7 - 3) / 10} AS DOUBLE)'), 5)} AS xsec FROM pc")
    def scl17(spark, sf, model=_model):
        c = {"c3": F.col("c3") / 10, "d4": F.col("d4") / 100, "ct1": F.col("value"), "ct2": F.col("value") - 1, "ct3": F.col("c3") / 30}
        coef = F.array(*[F.lit((i % 7 - 3) / 10) for i in range(len(cf.monomials(model)))])
        return points(spark, sf).select("k", r(cf.coupling_polynomial(model, c, coef), 5).alias("xsec"))


@query("INF04_fit_surface")
def inf04(spark, sf):
    p = points(spark, sf).withColumn("error", F.col("value") * 0.1)
    f = inf.fit_surface(p)
    return f.select("status", "n_points", "n_terms", "rank", r("condition", 3).alias("condition"), r("chi2_dof", 4).alias("chi2_dof"), r("residual_rms", 5).alias("residual_rms"), F.transform("coefficients", lambda c: F.round(c, 5)).alias("coefficients"))


@query("INF04_fit_recovers_surface", f"WITH {PT}, {surf_sql(15)} SELECT surface, {R('sum(abs(v))', 3)} AS sum_abs, 'ok' AS status, true AS recovered, CAST(0 AS DOUBLE) AS gap FROM (SELECT surface, unnest([{', '.join(f'q{i}' for i in range(15))}]) AS v FROM sf) GROUP BY surface")
def inf04r(spark, sf):
    """Each surface is fitted on its own; its gap is what the fit misses of its coefficients."""
    found = inf.surface_recovery(surfaces(spark, sf, 15), points(spark, sf))
    total = F.aggregate("coefficients", F.lit(0.0), lambda a, c: a + F.abs(c))
    return found.select("surface", r(total, 3).alias("sum_abs"), "status", F.coalesce(F.col("gap") < 1e-6, F.lit(False)).alias("recovered"), r("gap", 6).alias("gap"))


@query("INF05_fitted_points", f"WITH {PT}, {surf_sql(15)}, f AS (SELECT k, 3000*greatest(CAST(0 AS DOUBLE), {SURF_VAL}) AS s FROM pc JOIN sf USING (surface)) SELECT k, {R('s', 4)} AS fitted_events, {R('s/sqrt(CAST(50 AS DOUBLE))', 4)} AS fitted_s_over_sqrt_b, s >= 2500 AS fitted_excluded FROM f")
def inf05(spark, sf):
    j = points(spark, sf).join(surfaces(spark, sf, 15), "surface")
    f = inf.fitted_points(j, F.col("coefficients"), 3000.0, F.lit(50.0), F.lit(2500.0))
    return f.select("k", r("fitted_events", 4).alias("fitted_events"), r("fitted_s_over_sqrt_b", 4).alias("fitted_s_over_sqrt_b"), "fitted_excluded")


def g2_sql(n: int) -> str:
    return f"WITH {surf_sql(15)}, g AS (SELECT *, -30 + ix*CAST({60 / (n - 1)!r} AS DOUBLE) AS c3, -600 + iy*CAST({1200 / (n - 1)!r} AS DOUBLE) AS d4 FROM sf, range({n}) a(ix), range({n}) b(iy)), gv AS (SELECT surface, ix, iy, c3, d4, {SURF_VAL} AS value FROM g)"


# Fixed value: points an axis of the production grid; the grid of 21 shows every cell
GRID = 301
G2, G2_FULL = g2_sql(21), g2_sql(GRID)
SUMMARY_SQL = lambda v: f"count(*) AS cells, count({v}) AS filled, {R(f'sum({v})/count({v})', 3)} AS mean, {R(f'min({v})', 3)} AS low, {R(f'max({v})', 3)} AS high"


def grid2(spark, sf, n=21):
    return gr.evaluate_grid(surfaces(spark, sf, 15), (-30.0, 30.0, n), (-600.0, 600.0, n), 3000.0)


def grid_summary(g, v):
    return g.groupBy("surface").agg(F.count("*").alias("cells"), F.count(v).alias("filled"), r(F.sum(v) / F.count(v), 3).alias("mean"), r(F.min(v), 3).alias("low"), r(F.max(v), 3).alias("high"))


@query("INF06_evaluate_grid_full", f"{G2_FULL}, e AS (SELECT surface, 3000*greatest(CAST(0 AS DOUBLE), value) AS v FROM gv) SELECT surface, {SUMMARY_SQL('v')} FROM e GROUP BY surface")
def inf06f(spark, sf):
    return grid_summary(grid2(spark, sf, GRID), "events")


@query("INF06_evaluate_grid", f"{G2} SELECT surface, CAST(ix AS INT) AS ix, CAST(iy AS INT) AS iy, {R('3000*greatest(CAST(0 AS DOUBLE), value)', 6)} AS events FROM gv")
def inf06(spark, sf):
    return grid2(spark, sf).select("surface", F.col("i_c3").alias("ix"), F.col("i_d4").alias("iy"), r("events", 6).alias("events"))


@query("INF07_perturbativity_grid", f"WITH {PT}, e AS (SELECT pc.*, CAST(200+10*i AS DOUBLE)*(200+10*i) AS s FROM pc, range(480) x(i)) SELECT k, {R(f'max({WAVE(chr(115))})', 6)} AS max_wave FROM e GROUP BY k")
def inf07(spark, sf):
    return gr.perturbativity(points(spark, sf).select("k", "c3", "d4"), ["k", "c3", "d4"]).select("k", r("max_wave").alias("max_wave"))


ZERO = f"zz AS (SELECT surface, {SURF_VAL} AS z FROM (SELECT sf.*, CAST(0 AS DOUBLE) AS c3, CAST(0 AS DOUBLE) AS d4 FROM sf))"


def ratios(spark, sf, n):
    base = surfaces(spark, sf, 15).withColumn("z", cf.evaluate_surface(F.lit(0.0), F.lit(0.0), F.col("coefficients")))
    g = gr.evaluate_grid(base, (-30.0, 30.0, n), (-600.0, 600.0, n), 1.0)
    return gr.ratio_grid(g, F.col("z"))


@query("INF08_ratio_grid", f"{G2}, {ZERO} SELECT surface, CAST(ix AS INT) AS ix, CAST(iy AS INT) AS iy, z > 0 AS reference_ok, CASE WHEN z > 0 AND value > 0 THEN {R('value/z', 5)} END AS ratio FROM gv JOIN zz USING (surface)")
def inf08(spark, sf):
    return ratios(spark, sf, 21).select("surface", F.col("i_c3").alias("ix"), F.col("i_d4").alias("iy"), "reference_ok", r("ratio", 5).alias("ratio"))


@query("INF08_ratio_grid_full", f"{G2_FULL}, {ZERO}, q AS (SELECT surface, CASE WHEN z > 0 AND value > 0 THEN value/z END AS v FROM gv JOIN zz USING (surface)) SELECT surface, {SUMMARY_SQL('v')} FROM q GROUP BY surface")
def inf08f(spark, sf):
    return grid_summary(ratios(spark, sf, GRID), "ratio")


@query(
    "INF08_log_levels",
    f"""{G2_FULL}, {ZERO}, q AS (SELECT surface, floor(log10(min(v))) AS lo, ceil(log10(max(v))) AS hi FROM (SELECT surface, CASE WHEN z > 0 AND value > 0 THEN value/z END AS v FROM gv JOIN zz USING (surface)) WHERE v IS NOT NULL GROUP BY surface)
 SELECT surface, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, CAST(least(80, greatest(12, (hi-lo)*4+1)) AS INT) AS n_levels FROM q""",
)
def inf08l(spark, sf):
    return gr.log_levels(ratios(spark, sf, GRID), ["surface"]).select("surface", "lo", "hi", "n_levels")


@query(
    "INF09_contour_cells",
    f"""{G2_FULL}, e AS (SELECT *, 3000*greatest(CAST(0 AS DOUBLE), value) AS v FROM gv),
 x AS (SELECT surface, 'c3' AS direction, c3 + (2000-v)/(v2-v)*CAST({60 / (GRID - 1)!r} AS DOUBLE) AS c3, d4 FROM (SELECT *, lead(v) OVER (PARTITION BY surface, iy ORDER BY ix) AS v2 FROM e) WHERE (v<2000) <> (v2<2000)),
 y AS (SELECT surface, 'd4' AS direction, c3, d4 + (2000-v)/(v2-v)*CAST({1200 / (GRID - 1)!r} AS DOUBLE) AS d4 FROM (SELECT *, lead(v) OVER (PARTITION BY surface, ix ORDER BY iy) AS v2 FROM e) WHERE (v<2000) <> (v2<2000))
 SELECT surface, direction, {R('c3', 4)} AS c3, {R('d4', 3)} AS d4 FROM (SELECT * FROM x UNION ALL SELECT * FROM y)""",
)
def inf09(spark, sf):
    c = gr.contour_cells(grid2(spark, sf, GRID), ["surface"], 2000.0)
    return c.select("surface", "direction", r("c3", 4).alias("c3"), r("d4", 3).alias("d4"))


CURVE = [(round(20 + (i * 7) % 11, 1) * (1 if i in (0, 1, 2, 9, 10, 11) else -1 if i in (4, 5, 6, 7) else 0.3), 100.0 * (6 - abs(6 - i)) * (1 if i < 6 else -1) + 13.7) for i in range(12)]
EDGES = ",".join(f"({x1}::DOUBLE,{y1}::DOUBLE,{x2}::DOUBLE,{y2}::DOUBLE)" for (x1, y1), (x2, y2) in zip(CURVE, CURVE[1:] + CURVE[:1]))


@query("INF10_reference_curve", f"WITH {PT}, ed(x1,y1,x2,y2) AS (VALUES {EDGES}) SELECT k, count(CASE WHEN y1<>y2 AND (y1>d4)<>(y2>d4) AND c3 < x1+(d4-y1)*((x2-x1)/(CASE WHEN y1=y2 THEN 1 ELSE y2-y1 END)) THEN 1 END) % 2 = 1 AS inside FROM pc, ed GROUP BY k")
def inf10(spark, sf):
    return inf.inside_polygon(points(spark, sf), "c3", "d4", CURVE).select("k", "inside")


@query("INF11_random_couplings", f"""WITH d AS (SELECT p_partkey AS event_id, CAST(b AS INT) AS box, -1-b + 2*(1+b)*{S.uniform(5, 'b')} AS x, -10*(1+b) + 20*(1+b)*{S.uniform(6, 'b')} AS y FROM (SELECT p_partkey AS event_id, p_partkey, b FROM part, range(9) t(b)))
 SELECT event_id AS k, box, {R('round(x*pow(CAST(10 AS DOUBLE),3-floor(log10(abs(x)))))/pow(CAST(10 AS DOUBLE),3-floor(log10(abs(x))))', 9)} AS c3, {R('round(y*pow(CAST(10 AS DOUBLE),3-floor(log10(abs(y)))))/pow(CAST(10 AS DOUBLE),3-floor(log10(abs(y))))', 9)} AS d4 FROM d""")
def inf11(spark, sf):
    k, b = F.col("k"), F.col("box")
    d = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("box"))
    x = -1 - b + 2 * (1 + b) * noise.uniform(5, k, b)
    y = -10 * (1 + b) + 20 * (1 + b) * noise.uniform(6, k, b)
    return d.select("k", "box", r(text.round_sig(x, 4), 9).alias("c3"), r(text.round_sig(y, 4), 9).alias("d4"))


@query("INF12_fit_coupling_polynomial")
def inf12(spark, sf):
    p = points(spark, sf).select((F.col("c3") / 10).alias("c3"), (F.col("d4") / 100).alias("d4"), "value", (F.col("value") * 0.05).alias("error"))
    return inf.fit_coupling_polynomial(p, "c3d4").select("model", "i", "term", r("coefficient", 6).alias("coefficient"))


@query("AGG34_fit_residual_report", f"WITH {PT}, {surf_sql(15)}, f AS (SELECT value, {SURF_VAL} AS fit FROM pc JOIN sf USING (surface) WHERE value <> 0) SELECT count(*) AS n, {R('avg(abs(value-fit)/value)', 5)} AS mean_rel, count(CASE WHEN abs(value-fit)/value > 0.2 THEN 1 END) AS n_flagged FROM f")
def agg34(spark, sf):
    j = points(spark, sf).join(surfaces(spark, sf, 15), "surface")
    out = inf.fit_residual_report(j, cf.evaluate_surface(F.col("c3"), F.col("d4"), F.col("coefficients")))
    return out.select("n", r("mean_rel", 5).alias("mean_rel"), "n_flagged")


# --- chi-square grids -------------------------------------------------------------------------
NB = 101
AX = {"x": (-3.0, 3.0, NB), "y": (-2.0, 4.0, NB)}
DX, DY = 6.0 / (NB - 1), 6.0 / (NB - 1)
C2 = f"""WITH {surf_sql(9)}, g AS (SELECT sf.*, ix, iy, -3 + ix*CAST({DX!r} AS DOUBLE) AS x, -2 + iy*CAST({DY!r} AS DOUBLE) AS y FROM sf, range({NB}) a(ix), range({NB}) b(iy)),
 ch AS (SELECT surface, ix, iy, x, y, pow((10*q0 - 10*{poly_sql('c3d4', {'c3': 'x', 'd4': 'y'})})/sqrt(10*q0+20),2) + pow(x/CAST(2 AS DOUBLE),2) AS chisq FROM g),
 dc AS (SELECT *, chisq - min(chisq) OVER (PARTITION BY surface) AS d FROM ch)"""


def chi_grid(spark, sf):
    g = gr.mesh_grid(surfaces(spark, sf, 9), AX)
    q0 = F.get("coefficients", F.lit(0))
    s = 10 * cf.coupling_polynomial("c3d4", {"c3": F.col("x"), "d4": F.col("y")}, F.col("coefficients"))
    return gr.chisq_grid(g, ["surface"], s, 10 * q0, F.sqrt(10 * q0 + 20), prior=("x", 2.0)).drop("coefficients")


@query("JN11_mesh_grid", f"WITH {surf_sql(9)} SELECT surface, CAST(ix AS INT) AS i_x, CAST(iy AS INT) AS i_y, {R(f'-3 + ix*CAST({DX!r} AS DOUBLE)', 9)} AS x, {R(f'-2 + iy*CAST({DY!r} AS DOUBLE)', 9)} AS y FROM sf, range({NB}) a(ix), range({NB}) b(iy)")
def jn11(spark, sf):
    return gr.mesh_grid(surfaces(spark, sf, 9).select("surface"), AX).select("surface", "i_x", "i_y", r("x", 9).alias("x"), r("y", 9).alias("y"))


@query("JN11_mesh_grid_4d", f"WITH {surf_sql(9)} SELECT surface, CAST(count(*) AS BIGINT) AS cells, {R('sum(a*0.5+b+c*2+d)', 6)} AS checksum FROM sf, range(6) p(a), range(6) q(b), range(6) r(c), range(6) s(d) GROUP BY surface")
def jn11b(spark, sf):
    g = gr.mesh_grid(surfaces(spark, sf, 9).select("surface"), {"a": (0.0, 2.5, 6), "b": (0.0, 5.0, 6), "c": (0.0, 10.0, 6), "d": (0.0, 5.0, 6)})
    return g.groupBy("surface").agg(F.count("*").alias("cells"), r(F.sum(F.col("a") + F.col("b") + F.col("c") + F.col("d"))).alias("checksum"))


@query("INF13_chisq_grid", f"{C2} SELECT surface, CAST(ix AS INT) AS ix, CAST(iy AS INT) AS iy, {R('d', 2)} AS delta_chisq FROM dc")
def inf13(spark, sf):
    return chi_grid(spark, sf).select("surface", F.col("i_x").alias("ix"), F.col("i_y").alias("iy"), r("delta_chisq", 2).alias("delta_chisq"))


MARG = f"""{C2}, m0 AS (SELECT surface, ix, x, sum(exp(-d/2)) AS p FROM dc GROUP BY surface, ix, x), m AS (SELECT *, p/(sum(p) OVER (PARTITION BY surface)*CAST({DX!r} AS DOUBLE)) AS density FROM m0),
 c AS (SELECT *, sum(density) OVER (PARTITION BY surface ORDER BY ix)/sum(density) OVER (PARTITION BY surface) AS cdf FROM m)"""


def cdf(spark, sf):
    m = gr.marginal(chi_grid(spark, sf), ["surface"], "x", DX, DY)
    return gr.posterior_cdf(m, ["surface"], "x", DX)


@query("WIN05_posterior_cdf", f"{MARG} SELECT surface, CAST(ix AS INT) AS ix, {R('density')} AS density, {R('cdf')} AS cdf FROM c")
def win05(spark, sf):
    return cdf(spark, sf).select("surface", F.col("i_x").alias("ix"), r("density").alias("density"), r("cdf").alias("cdf"))


QS = f"{MARG}, n AS (SELECT *, lead(cdf) OVER (PARTITION BY surface ORDER BY ix) AS c2 FROM c)"


def q_expr(q: float) -> str:
    return f"CASE WHEN min(CASE WHEN ix=0 THEN cdf END) >= {q} THEN CAST(-3 AS DOUBLE) ELSE min(CASE WHEN cdf < {q} AND c2 >= {q} THEN x + ({q}-cdf)/(c2-cdf)*CAST({DX!r} AS DOUBLE) END) END"


@query("INF14_posterior_intervals", f"{QS} SELECT surface, {R(q_expr(0.025), 5)} AS low95, {R(q_expr(0.975), 5)} AS high95 FROM n GROUP BY surface")
def inf14(spark, sf):
    c = cdf(spark, sf)
    lo = gr.quantile(c, ["surface"], "x", 0.025).select("surface", r("quantile", 5).alias("low95"))
    return lo.join(gr.quantile(c, ["surface"], "x", 0.975).select("surface", r("quantile", 5).alias("high95")), "surface")


@query("WIN06_interpolate_crossing", f"{QS} SELECT surface, {R('x + (0.5-cdf)/(c2-cdf)*CAST(' + repr(DX) + ' AS DOUBLE)', 5)} AS crossing FROM n WHERE (cdf<0.5) <> (c2<0.5)")
def win06(spark, sf):
    return gr.crossings(cdf(spark, sf), ["surface"], "x", "cdf", 0.5).select("surface", r("crossing", 5).alias("crossing"))


@query("INF15_profile_intervals", f"{C2}, p AS (SELECT surface, x, min(d) AS p FROM dc GROUP BY surface, x) SELECT surface, {R('min(CASE WHEN p<=3.84 THEN x END)')} AS low, {R('max(CASE WHEN p<=3.84 THEN x END)')} AS high FROM p GROUP BY surface")
def inf15(spark, sf):
    return gr.profile_intervals(chi_grid(spark, sf), ["surface"], "x").select("surface", r("low").alias("low"), r("high").alias("high"))


N4 = 40
AXN = lambda i, lo, hi: f"({lo} + {i}*CAST({(hi - lo) / (N4 - 1)!r} AS DOUBLE))"
P4 = poly_sql("ct2ct3", {"ct3": "x1", "d4": "x2", "c3": "x3", "ct2": "x4"})


# the cells' exponent is written once; chi-square differences and densities follow from it
P16 = f"""WITH {surf_sql(25)}, a AS (SELECT sf.*, i1, i2, {AXN('i1', -1.0, 1.0)} AS x1, {AXN('i2', -2.0, 2.0)} AS x2 FROM sf, range({N4}) a(i1), range({N4}) b(i2)),
 b AS (SELECT {AXN('i3', -2.0, 2.0)} AS x3, {AXN('i4', -1.0, 1.0)} AS x4 FROM range({N4}) c(i3), range({N4}) d(i4)),
 p AS (SELECT surface, i1, i2, x1, x2, sum(exp(-pow((100*q24 - 100*{P4})/10,2)/2 - pow(x3/CAST(0.2 AS DOUBLE),2)/2 - pow(x4/CAST(0.1 AS DOUBLE),2)/2))*{(4.0 / N4) * (2.0 / N4)!r}/(pow(2*pi(),CAST(1.5 AS DOUBLE))*10*CAST(0.2 AS DOUBLE)*CAST(0.1 AS DOUBLE)) AS p FROM a, b GROUP BY ALL)"""


def marginal_2d(spark, sf):
    return gr.marginalise_4d(surfaces(spark, sf, 25), ["surface"], "ct2ct3", {"ct3": (-1.0, 1.0), "d4": (-2.0, 2.0)}, {"c3": 0.2, "ct2": 0.1}, 100.0, 10.0, N4)


@query("INF16_marginalise_4d", f"{P16}, c AS (SELECT *, CASE WHEN p>0 THEN -2*ln(p) END AS ch FROM p) SELECT surface, CAST(i1 AS INT) AS i1, CAST(i2 AS INT) AS i2, {R('ch - min(ch) OVER (PARTITION BY surface)', 4)} AS delta_chisq FROM c")
def inf16(spark, sf):
    return marginal_2d(spark, sf).select("surface", F.col("i_x1").alias("i1"), F.col("i_x2").alias("i2"), r("delta_chisq", 4).alias("delta_chisq"))


@query(
    "INF16_marginals_1d",
    f"""{P16} SELECT surface, 'ct3' AS axis, CAST(i1 AS INT) AS i, {R('x1', 9)} AS x, {R(f'ln(sum(p)*{4.0 / N4!r})', 5)} AS log_p FROM p GROUP BY surface, i1, x1
 UNION ALL SELECT surface, 'd4', CAST(i2 AS INT), {R('x2', 9)}, {R(f'ln(sum(p)*{2.0 / N4!r})', 5)} FROM p GROUP BY surface, i2, x2""",
)
def inf16m(spark, sf):
    two = marginal_2d(spark, sf)
    parts = [gr.marginal_1d(two, ["surface"], x, lim, N4).withColumn("axis", F.lit(name)) for name, x, lim in (("ct3", "x1", (-2.0, 2.0)), ("d4", "x2", (-1.0, 1.0)))]
    return parts[0].unionByName(parts[1]).select("surface", "axis", "i", r("x", 9).alias("x"), r("log_p", 5).alias("log_p"))


POINTS = 41
SCAN_AXES = {"c3": (-2.0, 2.0, POINTS), "d4": (-3.0, 3.0, POINTS), "ct2": (-1.0, 1.0, POINTS), "ct3": (-1.0, 1.0, POINTS)}
_step = lambda a, i: f"({a[0]} + {i}*CAST({(a[1] - a[0]) / (POINTS - 1)!r} AS DOUBLE))"


@query("INF17_one_d_scan", f"WITH {surf_sql(25)} " + " UNION ALL ".join(f"SELECT surface, '{a}' AS axis, {R('x', 9)} AS x, {R(poly_sql('ct2ct3', {a: 'x'}) + '/nullif(q24, 0)', 5)} AS ratio FROM (SELECT sf.*, {_step(v, 'i')} AS x FROM sf, range({POINTS}) t(i))" for a, v in SCAN_AXES.items()))
def inf17(spark, sf):
    s = surfaces(spark, sf, 25)
    return gr.one_d_scan(s, "ct2ct3", SCAN_AXES).select("surface", "axis", r("x", 9).alias("x"), r("ratio", 5).alias("ratio"))


_pairs = [(a, b) for i, a in enumerate(SCAN_AXES) for b in list(SCAN_AXES)[i + 1:]]


@query("INF17_correlation_matrix", f"WITH {surf_sql(25)} " + " UNION ALL ".join(f"SELECT surface, '{a}:{b}' AS axes, {R('x', 9)} AS x, {R('y', 9)} AS y, {R(poly_sql('ct2ct3', {a: 'x', b: 'y'}) + '/nullif(q24, 0)', 5)} AS ratio FROM (SELECT sf.*, {_step(SCAN_AXES[a], 'i')} AS x, {_step(SCAN_AXES[b], 'j')} AS y FROM sf, range({POINTS}) t(i), range({POINTS}) u(j))" for a, b in _pairs))
def inf17c(spark, sf):
    s = surfaces(spark, sf, 25)
    return gr.correlation_matrix(s, "ct2ct3", SCAN_AXES).select("surface", "axes", r("x", 9).alias("x"), r("y", 9).alias("y"), r("ratio", 5).alias("ratio"))


# --- sinks ------------------------------------------------------------------------------------
@query("SNK12_save_fit", f"WITH {surf_sql(15)} SELECT surface, CAST(15 AS INT) AS n, {R('q0+q1+q2')} AS head FROM sf")
def snk12(spark, sf):
    path = scratch_dir(spark, "fit")
    gr.save_fit(surfaces(spark, sf, 15), path)
    back = gr.read_fit(spark, path, 15)
    g = lambda i: F.get("coefficients", F.lit(i))
    return back.select("surface", F.size("coefficients").alias("n"), r(g(0) + g(1) + g(2)).alias("head"))


@query("SNK13_save_grid", f"{C2} SELECT surface, {R('x', 9)} AS x, {R('y', 9)} AS y, {R('d', 2)} AS chisq FROM dc")
def snk13(spark, sf):
    path, g = scratch_dir(spark, "grid"), chi_grid(spark, sf)
    gr.save_grid(g.select("surface", r("x", 9).alias("x"), r("y", 9).alias("y"), r("delta_chisq", 2).alias("chisq")), path)
    return gr.read_grid(spark, path)


@query("SNK13_save_intervals", f"{C2}, p AS (SELECT surface, 'x' AS axis, x AS v, min(d) AS p FROM dc GROUP BY surface, x UNION ALL SELECT surface, 'y', y, min(d) FROM dc GROUP BY surface, y) SELECT surface, axis, {R('min(CASE WHEN p<=3.84 THEN v END)')} AS low, {R('max(CASE WHEN p<=3.84 THEN v END)')} AS high FROM p GROUP BY surface, axis")
def snk13i(spark, sf):
    path, g = scratch_dir(spark, "grid"), chi_grid(spark, sf)
    both = [gr.profile_intervals(g, ["surface"], a).select("surface", F.lit(a).alias("axis"), "low", "high") for a in ("x", "y")]
    gr.save_grid(g, path, both[0].unionByName(both[1]))
    return gr.read_intervals(spark, path).select("surface", "axis", r("low").alias("low"), r("high").alias("high"))
