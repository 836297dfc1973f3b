"""Hot groups: a third or more of the rows in one key, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from sparkcollide.operators import particles, ranking, samples
from sparkcollide.operators import lhe as lhe_ops
from sparkcollide.operators.select import gather, leading_jets, select_candidates, with_pt_eta

rng = random.Random(3)
ROWS = []
for i in range(3000):
    event = 0 if i % 3 == 0 else 1 + i % 400
    ROWS.append((event, 1 + i % 7, i, i % 11, "b" if i % 7 < 4 else ("c" if i % 7 == 4 else "l"), rng.choice([20.5, 30.5, 40.5]) + (i % 5), rng.uniform(-2.4, 2.4), rng.uniform(-3, 3)))


@pytest.fixture(scope="module")
def jets(spark):
    df = spark.createDataFrame(ROWS, "event_id long, l_linenumber int, l_partkey long, l_suppkey long, tag string, pt0 double, eta0 double, phi0 double").repartition(16)
    df = df.withColumns({"px": F.col("pt0") * F.cos("phi0"), "py": F.col("pt0") * F.sin("phi0"), "pz": F.col("pt0") * F.sinh("eta0"), "e": F.col("pt0") * F.cosh("eta0")})
    pid = F.when(F.col("l_partkey") % 4 == 0, 11).when(F.col("l_partkey") % 4 == 1, -5).otherwise(5)
    return with_pt_eta(df).withColumn("pid", pid.cast("int"))


def brute_order(rows):
    return sorted(rows, key=lambda r: (-round(r[5], 9), r[1], r[2], r[3]))


def by_event():
    out = {}
    for r in ROWS:
        out.setdefault(r[0], []).append(r)
    return out


def test_leading_jets(jets):
    got = {(r["event_id"], r["rn"]): r["l_partkey"] for r in leading_jets(jets, 8).collect()}
    want = {(e, k + 1): r[2] for e, rows in by_event().items() for k, r in enumerate(brute_order(rows)[:8])}
    assert got == want


def test_group_limit_runs_before_the_shuffle(jets):
    plan = leading_jets(jets, 8)._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan


@pytest.mark.parametrize("whole", [ranking.WHOLE, 100, 0])  # all events by a window, the hot one by ranges, all by ranges
def test_distributed_row_number(jets, monkeypatch, whole):
    monkeypatch.setattr(ranking, "WHOLE", whole)
    out = particles.order_particles(jets, "pt").select("event_id", "l_partkey", "rank").collect()
    want = {(e, r[2]): k + 1 for e, rows in by_event().items() for k, r in enumerate(brute_order(rows))}
    assert {(r["event_id"], r["l_partkey"]): r["rank"] for r in out} == want


def test_hot_rank_is_split_over_buckets(jets):
    codes = [ranking.sort_code(jets, F.col("l_partkey"))]
    points = ranking.split_points(jets, codes, 16)
    sizes = [r["count"] for r in jets.groupBy(ranking.bucket_of(codes, points)).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3000 / 4


def test_running_sums(jets):
    out = ranking.running_sums(jets, "pt", {"n": "l_linenumber"}, group=["event_id"], descending=True, buckets=8).collect()
    groups = by_event()
    for r in out:
        assert r["n"] == sum(x[1] for x in groups[r["event_id"]] if round(x[5], 9) >= r["pt"])


def test_candidates_with_hot_event(jets):
    got = {}
    for r in select_candidates(jets, c=1, l=1, total=6).collect():
        got.setdefault(r["event_id"], []).append(r)
    assert 0 in got and all(len(v) == 6 for v in got.values())
    assert all(sorted(x["tag"] for x in v) == ["b"] * 4 + ["c", "l"] for v in got.values())


def test_isolation_against_all_pairs(jets):
    import math

    refs, rest = jets.filter("pid = 11"), jets.filter("pid <> 11")
    got = {r["event_id"] for r in particles.isolation_veto(refs, rest, 0.5, 60.0).collect()}
    want = set()
    for e, rows in by_event().items():
        busy = False
        for a in (r for r in rows if r[2] % 4 == 0):
            cone = 0.0
            for b in (r for r in rows if r[2] % 4 != 0):
                d = abs(a[7] - b[7])
                d = min(d, 2 * math.pi - d)
                if math.hypot(a[6] - b[6], d) < 0.5:
                    cone += b[5]
            busy = busy or cone > 60.0
        if not busy:
            want.add(e)
    assert got == want


def dense(spark, n):
    """Event 0 has half of the rows, most of them close together; copies of particles included."""
    r = random.Random(5)
    rows = []
    for i in range(n):
        hot = i % 2 == 0
        eta, phi = (r.gauss(0.3, 0.15), r.gauss(3.1, 0.15)) if hot else (r.uniform(-2, 2), r.uniform(-3.1, 3.1))
        rows.append((0 if hot else 1 + i % 40, 1, i, i, "b", r.choice([1.0, 2.5]), eta, phi))
    rows += rows[:50]
    df = spark.createDataFrame(rows, "event_id long, l_linenumber int, l_partkey long, l_suppkey long, tag string, pt0 double, eta0 double, phi0 double")
    df = df.withColumns({"px": F.col("pt0") * F.cos("phi0"), "py": F.col("pt0") * F.sin("phi0"), "pz": F.col("pt0") * F.sinh("eta0"), "e": F.col("pt0") * F.cosh("eta0")})
    return rows, df


@pytest.mark.parametrize("tile", [100_000, 40])
def test_isolation_in_a_dense_event(spark, monkeypatch, tile):
    import numpy as np

    monkeypatch.setattr(particles, "TILE", tile)
    monkeypatch.setattr(particles, "LEAF", 4)
    monkeypatch.setattr(ranking.tiled, "__defaults__", (min(tile, 2048),))
    rows, df = dense(spark, 3000)
    refs, rest = df.where("l_partkey % 5 = 0"), df.where("l_partkey % 5 <> 0")
    by = {}
    for r in rows:
        by.setdefault(r[0], ([], []))[r[2] % 5 != 0].append(r)
    for dr, emax in ((0.4, 150.0), (0.15, 220.0)):
        want = set()
        for e, (a, b) in by.items():
            x, y = np.array([r[5:8] for r in a]).reshape(-1, 3), np.array([r[5:8] for r in b]).reshape(-1, 3)
            d = np.abs(x[:, None, 2] - y[None, :, 2]) % (2 * np.pi)
            d = np.minimum(d, 2 * np.pi - d)
            cone = ((np.hypot(x[:, None, 1] - y[None, :, 1], d) < dr) * y[None, :, 0]).sum(1)
            if not (cone > emax).any():
                want.add(e)
        assert {r["event_id"] for r in particles.isolation_veto(refs, rest, dr, emax).collect()} == want
    assert want and 0 not in want


def test_tiles_are_bounded_and_all_pairs_meet(spark):
    left = spark.range(6000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("a"))
    right = left.select("k", F.col("a").alias("b"))
    one, two = ranking.tiled(left, right, ["k"], 100)
    for side in (one, two):
        sizes = sorted(r["count"] for r in side.groupBy("k", "_i", "_j").count().collect())
        assert max(sizes) < 200
    met = one.join(two, ["k", "_i", "_j"]).agg(F.count("*").alias("n"), F.count_distinct("a", "b").alias("d")).first()
    want = sum(r["count"] ** 2 for r in left.groupBy("k").count().collect())
    assert met["n"] == met["d"] == want


def test_charge_weighted_deta_counts_every_pair(jets):
    q = F.when(F.col("pid") == 11, -1).otherwise(1)
    fills = particles.charge_weighted_deta(jets, (11,), (5, -5), q).groupBy("event_id").agg(F.sum("fills").alias("n"))
    for r in fills.collect():
        rows = by_event()[r["event_id"]]
        a = sum(1 for x in rows if x[2] % 4 == 0)
        assert r["n"] == a * (len(rows) - a)


def test_best_run_per_point_with_hot_point(spark):
    rows = [(i, f"run_{i % 9}", str(i % 5), 0.0 if i % 2 else float(i % 7), 1.0, 10000 if i % 3 else 5000, i % 4 == 0) for i in range(600)]
    df = spark.createDataFrame(rows, "run_id long, run_name string, run_group string, c3 double, d4 double, generated_events int, has_lhe boolean")
    got = {r["run_id"]: r["selection"] for r in samples.best_run_per_point(df).collect()}
    best = {}
    for r in rows:
        if r[5] == 10000:
            best[r[3]] = max(best.get(r[3], ()), (r[6], int(r[2]), r[1], r[0]))
    for r in rows:
        want = "nonmatching_events" if r[5] != 10000 else ("selected" if best[r[3]][3] == r[0] else "duplicate")
        assert got[r[0]] == want


def test_unique_labels_follow_input_order(spark):
    names = ["a", "a", "a_2", "a", "b", "b", "a_2", "c"] + ["hot"] * 40
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "ord long, base string")
    used, want = set(), []
    for n in names:
        label, k = n, 2
        while label in used:
            label, k = f"{n}_{k}", k + 1
        used.add(label)
        want.append(label)
    got = [r["label"] for r in lhe_ops.unique_labels(df).orderBy("ord").collect()]
    assert got == want


def test_gather_is_bounded(jets):
    assert gather(leading_jets(jets, 8), 8).agg(F.max(F.size("jets"))).first()[0] == 8
