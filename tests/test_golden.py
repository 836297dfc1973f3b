"""Published or independently computed values."""

import math

import pytest
from pyspark.sql import functions as F

from sparkcollide.functions import couplings as cf
from sparkcollide.operators import hist, inference, lhe, ml, reco, samples, select
from sparkcollide.plans import inference_queries, load_all
from sparkcollide.plans.event_queries import accepted, reconstructed
from sparkcollide.plans.registry import QUERIES
from sparkcollide.sources import fixtures


def test_jet_and_event_counts(spark, sf):
    acc = accepted(spark, sf)
    assert acc.count() == 4946
    n = acc.groupBy("event_id").count()
    assert (n.filter("count >= 4").count(), n.filter("count >= 8").count()) == (628, 28)


@pytest.mark.parametrize("n,want", [(4, (628, 591, 374, 356)), (8, (28, 21, 20, 16))])
def test_pairing_counts(spark, sf, n, want):
    r = reconstructed(spark, sf, n)
    got = r.agg(
        F.count("*"), F.count(F.when(F.col("pass_drbb"), 1)), F.count(F.when(F.col("best.chi") < 60, 1)), F.count(F.when(F.col("pass_drbb") & (F.col("best.chi") < 60), 1))
    ).first()
    assert tuple(got) == want


def test_pairings_are_all_distinct_matchings():
    for n, want in ((2, 1), (4, 3), (6, 15), (8, 105)):
        p = reco.pairings(n)
        assert len({frozenset(frozenset(x) for x in m) for m in p}) == len(p) == want
        assert all(sorted(i for pair in m for i in pair) == list(range(n)) for m in p)


def test_rate_factors(spark):
    assert samples.signal_rate() == pytest.approx(0.06269990265972783)
    row = spark.sql("select 8 b_quarks, 0 c_quarks, 0 light_jets").select(samples.background_rate().alias("r")).first()
    assert row["r"] == pytest.approx(0.5449810500781249)


def test_source_weights(spark):
    rows = spark.createDataFrame([("a", 2.0), ("a", 4.0), ("b", 10.0)], "source string, xwgtup double")
    out = lhe.reweight_events(rows, lhe.source_fractions(lhe.source_weight_stats(rows), 0.9))
    assert sorted(round(r["new_weight"], 12) for r in out.collect()) == [0.2, 0.3, 0.4]


def test_zero_weight_source_fails(spark):
    rows = spark.createDataFrame([("a", 0.0)], "source string, xwgtup double")
    with pytest.raises(Exception, match="raw weight sum is zero"):
        lhe.source_weight_stats(rows).collect()


@pytest.mark.parametrize("b,n,method,want", [(0.0, 0, "cls", 2.995732), (5.05, 5, "cls", 6.301307), (22.155, 22, "cls", 10.934995)])
def test_upper_limits(spark, b, n, method, want):
    df = spark.createDataFrame([(b, n)], "b double, n int")
    assert df.select(inference.upper_limit(method)("b", "n")).first()[0] == pytest.approx(want, abs=5e-4)


def test_median_and_cdf(spark):
    df = spark.createDataFrame([(0.0,), (5.05,), (22.155,), (150.0,)], "m double")
    assert [r[0] for r in df.select(inference.poisson_median(F.col("m"))).collect()] == [0, 5, 22, 150]
    one = spark.range(1).select(inference.poisson_cdf(F.lit(3), F.lit(2.0))).first()[0]
    assert one == pytest.approx(sum(math.exp(-2) * 2**k / math.factorial(k) for k in range(4)))


def test_central_probability(spark):
    zs = [-1.5, 0.1, 1.0, 2.0, 5.0]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(cf.central_probability(F.col("z"))).collect()]
    assert got == pytest.approx([math.erf(z / math.sqrt(2)) for z in zs], abs=1e-12)


def test_fit_recovers_known_surface(spark):
    coef = [0.5 - 0.07 * k for k in range(15)]
    pts = spark.range(63).select((((F.col("id") % 9) - 4) * 7.0).alias("c3"), ((F.floor(F.col("id") / 9) - 3) * 180.0).alias("d4"))
    pts = pts.withColumn("value", cf.evaluate_surface(F.col("c3"), F.col("d4"), F.array(*[F.lit(c) for c in coef]))).withColumn("error", F.lit(0.1))
    fit = inference.fit_surface(pts).first()
    assert fit["coefficients"] == pytest.approx(coef, abs=1e-8)
    assert fit["rank"] == 15 and fit["max_abs_residual"] < 1e-8
    assert inference.fit_surface(pts.limit(10)).first()["status"] == "skipped"


def test_each_surface_is_fitted(spark, sf, monkeypatch):
    two = spark.createDataFrame([("a", [0.5] * 15), ("b", [0.5] * 14 + [None])], "surface string, coefficients array<double>")
    assert {r["surface"]: r["status"] for r in inference.surface_recovery(two, inference_queries.points(spark, sf)).collect()} == {"a": "ok", "b": "skipped"}
    monkeypatch.setattr(inference_queries, "surfaces", lambda *_: two)
    got = inference_queries.inf04r(spark, sf).collect()
    assert {r["surface"]: r["recovered"] for r in got} == {"a": True, "b": False}


@pytest.mark.parametrize("name", ["boost", "rotate"])
def test_events_without_references_stay(spark, sf, name):
    load_all()
    got = QUERIES[f"SCL07_{name}_reference"](spark, sf)
    assert got.count() == fixtures.particles(spark, sf).count() == QUERIES[f"SCL07_{name}_reference_all"](spark, sf).count()
    assert got.where("status = 'ok' and (px is null or py is null or pz is null)").count() == 0
    assert got.where("status = 'no_reference' and e is null").count() == got.where("status = 'no_reference'").count() > 0


def test_finalize_and_restore_are_inverse(spark):
    h = spark.createDataFrame([("h", 1, 3.0, 5.0, 7.0), ("h", 2, 1.0, 1.0, 7.0)], "hist string, bin int, y double, y2 double, fills double")
    back = hist.restore(hist.finalize(h, 0.5), 0.5).orderBy("bin").collect()
    assert [(pytest.approx(r["y"]), pytest.approx(r["y2"])) for r in back] == [(3.0, 5.0), (1.0, 1.0)]


def test_identical_shards_are_reported(spark):
    rows = [(s, "h", b, 1.0 + b, 0.1, 10.0) for s in ("r0", "r1") for b in range(1, 5)]
    h = spark.createDataFrame(rows, "shard string, hist string, bin int, y double, y2 double, fills double")
    assert [r["status"] for r in hist.shard_compatibility(h, ["hist"], 4).collect()] == ["identical"]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (2.0,), (10.0,)], "x double")
    assert [r[0] for r in df.select(hist.bin_left_open(F.col("x"), 0.0, 10.0, 10)).collect()] == [None, 0, 1, 1, None]
    assert [r[0] for r in df.select(hist.bin_with_flow(F.col("x"), 1.0, 2.0, 2)).collect()] == [0, 1, 2, 3, 3]


def test_best_threshold_default_without_background(spark):
    df = spark.createDataFrame([(1, 0.7, 1.0)], "label int, score double, weight double")
    row = ml.best_threshold(ml.threshold_scan(df)).first()
    assert (row["threshold"], row["significance"]) == (0.5, 0.0)


def test_threshold_scan_edges_are_inclusive(spark):
    df = spark.createDataFrame([(1, i * 0.002, 1.0) for i in range(501)] + [(0, 1.0, 1.0)], "label int, score double, weight double")
    s = {r["i"]: r["signal"] for r in ml.threshold_scan(df).collect()}
    assert all(s[i] == 501 - i for i in range(501))


def test_cutflow_is_monotone(spark, sf):
    from sparkcollide.plans.event_queries import flow

    cols = ["w_in", "w_cands", "w_drbb", "w_pt", "w_chi", "w_delta_m", "w_higgs_pt", "w_dr_bb", "w_dr_hh"]
    for r in flow(spark, sf, 4).collect():
        assert all(r[a] >= r[b] for a, b in zip(cols, cols[1:]))


def test_both_pairing_searches_agree_and_partitions_do_not_matter(spark, sf):
    jets = select.with_pt_eta(fixtures.jets(spark, sf))
    key = lambda df: sorted((r["event_id"], r["best"]["idx"], r["best"]["chi"]) for r in df.select("event_id", "best").collect())
    make = lambda src: reco.with_pairs(select.gather(select.leading_jets(src, 6), 6), 6)
    hof = key(reco.best_reconstruction(make(jets), 6))
    assert hof == key(reco.best_reconstruction_arrow(make(jets.repartition(13, "l_partkey")), 6))


def test_relations_of_one_pass_queries(spark, sf):
    """Scans of the fact table in the plans: one for FLT09, two for SCL07, and none beyond the sums' own for ML05."""
    load_all()
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert scans(QUERIES["FLT09_select_particles"](spark, sf)) == 1
    for name in ("boost", "rotate"):
        assert scans(QUERIES[f"SCL07_{name}_reference"](spark, sf)) == 2
    plan = QUERIES["ML05_evaluate"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("user_id") and plan.count("Relation [event_id") + plan.count("Relation [event_type") <= 2
