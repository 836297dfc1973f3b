"""Runs compared with each other, and the ordered fold, against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sparkcollide.operators import hist


def shards(spark, runs, hists=3, bins=6, seed=2):
    r = random.Random(seed)
    rows = []
    for s in range(runs):
        for h in range(hists):
            for b in range(0, bins + 2):
                y = 1.0 + b + r.gauss(0, 0.3)
                rows.append((f"run{s:04d}", f"h{h}", b, y, 0.09 if b != 2 else y * y, 10))
    rows += [("same", f"h{h}", b, y, e, 10) for _, hh, b, y, e, _ in [x for x in rows if x[0] == "run0000"] for h in [int(hh[1])]]
    return rows, spark.createDataFrame(rows, "shard string, hist string, bin int, y double, y2 double, fills long")


def plain(rows, bins):
    by = {}
    for s, h, b, y, y2, _ in rows:
        if 1 <= b <= bins:
            by.setdefault(h, {}).setdefault(s, {})[b] = (y, y2)
    out = {}
    for h, runs in by.items():
        names = sorted(runs)
        for i, a in enumerate(names):
            for c in names[i + 1 :]:
                n = s = s2 = 0
                for b, (y, y2) in runs[a].items():
                    z, z2 = runs[c][b]
                    if abs(y2 - y * y) > 1e-12 * (y2 + y * y) and abs(z2 - z * z) > 1e-12 * (z2 + z * z):
                        d = (y - z) / math.sqrt(y2 + z2)
                        n, s, s2 = n + 1, s + d, s2 + d * d
                out[h, a, c] = (n, s / n if n else 0.0, math.sqrt(s2 / n) if n else 0.0)
    return out


def test_pairs_of_runs_in_several_cells(spark, monkeypatch):
    monkeypatch.setattr(hist, "RUNS", 8)
    monkeypatch.setattr(hist, "HISTS", 2)
    rows, df = shards(spark, 30)
    want = plain(rows, 6)
    got = {(r["hist"], r["shard"], r["shard_b"]): r for r in hist.shard_compatibility(df, ["hist"], 6).collect()}
    assert set(got) == set(want)
    for k, (n, avg, rms) in want.items():
        assert got[k]["n_used"] == n and got[k]["avg_pull"] == pytest.approx(avg, abs=1e-12) and got[k]["rms_pull"] == pytest.approx(rms, abs=1e-12)
    summary = {(r["shard"], r["shard_b"]): r for r in hist.pair_summary(df, "hist", 6).collect()}
    pairs = {}
    for (h, a, b), (n, _, rms) in want.items():
        if n > 1:
            pairs.setdefault((a, b), []).append((rms, h))
    assert set(summary) == set(pairs)
    for p, seen in pairs.items():
        top, low = max(seen), min(seen)
        r = summary[p]
        assert r["n_checked"] == len(seen) and r["worst"] == pytest.approx(max(1.0, top[0])) and r["least"] == pytest.approx(min(1.0, low[0]))
        assert r["worst_hist"] == (top[1] if top[0] > 1 else None) and r["n_incompatible"] == sum(x > 1.5 for x, _ in seen) and r["n_correlated"] == sum(x < 0.5 for x, _ in seen)
    assert summary["run0000", "same"]["status"] == "identical" and summary["run0000", "same"]["least_hist"] == "h0"


def test_two_thousand_runs_without_joined_pairs(spark):
    bins = F.explode(F.sequence(F.lit(0), F.lit(4)))
    df = spark.range(2000).select(F.format_string("run%05d", "id").alias("shard"), F.lit("h").alias("hist"), bins.alias("bin"))
    df = df.select("*", (F.col("bin") + F.pmod(F.xxhash64("shard", "bin"), F.lit(1000)) / 1000.0).alias("y"), F.lit(0.1).alias("y2"), F.lit(5).alias("fills"))
    out = hist.pair_summary(df, "hist", 3)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 2000 * 1999 // 2
    cells = hist._cells(df, ["hist"], 3)
    assert cells.count() <= 2000 * (2000 // hist.RUNS + 2)


def test_ordered_fold_of_many_shards(spark):
    n = 200_000
    df = spark.range(n).select(F.format_string("run%07d", "id").alias("shard"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("h"), (F.col("id") % 7).cast("string"))).alias("hist"), F.lit(1).alias("bin"),
                               (1 + F.pmod(F.xxhash64("id"), F.lit(1000)) / 500.0).alias("y"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10)) / 10.0).alias("y2"), F.lit(2).cast("long").alias("fills"))
    rows = df.orderBy("shard").collect()
    want = {}
    for r in rows:
        if r["hist"] not in want:
            want[r["hist"]] = (r["y"], r["y2"], r["fills"])
            continue
        y, y2, f = want[r["hist"]]
        w1, w2 = (y * y / y2 if y2 else 0.0), (r["y"] ** 2 / r["y2"] if r["y2"] else 0.0)
        if not (w1 > 0 and w2 > 0):
            w1 = w2 = 1.0
        m = (y * w1 + r["y"] * w2) / (w1 + w2)
        want[r["hist"]] = (m, m * m / (w1 + w2), f + r["fills"])
    out = hist.combine_histograms(df, ["hist"], 1.0, "opt")
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["hist"]: (r["y"], r["y2"], r["fills"]) for r in out.collect()}
    assert set(got) == set(want)
    for h in want:
        assert got[h] == pytest.approx(want[h], rel=1e-9)
