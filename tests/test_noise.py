"""Keyed draws: moments, independence of seeds, any key; ranks and spines with NULL groups."""

import pytest
from pyspark.sql import functions as F

from sparkcollide.functions import noise
from sparkcollide.operators.hist import histogram_1d
from sparkcollide.operators import ranking
from sparkcollide.operators.ranking import bucket_of, distributed_row_number, running_sums, sort_code, split_points
from sparkcollide.session import lookup


def test_gaussian_moments_and_tails(spark):
    df = spark.range(100_000).select(noise.gaussian(42, F.col("id"), F.lit(3)).alias("g"), noise.gaussian(43, F.col("id"), F.lit(3)).alias("h"))
    r = df.agg(F.avg("g").alias("m"), F.stddev("g").alias("s"), F.skewness("g").alias("k"), F.avg((F.abs("g") > 2).cast("double")).alias("t"), F.max("g").alias("top"), F.corr("g", "h").alias("c")).first()
    assert abs(r["m"]) < 0.02 and abs(r["s"] - 1) < 0.02 and abs(r["k"]) < 0.05
    assert abs(r["t"] - 0.0455) < 0.004 and r["top"] > 3.5 and abs(r["c"]) < 0.02


def test_uniform_seeds_are_unrelated_and_keys_are_free(spark):
    df = spark.range(20_000).select(noise.uniform(5, F.col("id")).alias("u"), noise.uniform(6, F.col("id")).alias("v"))
    r = df.agg(F.corr("u", "v").alias("c"), F.countDistinct(F.round(F.pmod(F.col("u") - F.col("v"), F.lit(1.0)), 3)).alias("n")).first()
    assert abs(r["c"]) < 0.02 and r["n"] > 900
    keys = spark.createDataFrame([(-5,), (10**13,), (-(2**62),), (None,)], "id long")
    assert all(0 < x["u"] < 1 and x["g"] is not None for x in keys.select(noise.uniform(1, F.col("id")).alias("u"), noise.gaussian(1, F.col("id")).alias("g")).collect())


@pytest.mark.parametrize("whole", [ranking.WHOLE, 0])
def test_null_groups_and_keys_keep_their_rows(spark, monkeypatch, whole):
    monkeypatch.setattr(ranking, "WHOLE", whole)
    df = spark.createDataFrame([(None, 1, 2.0), (None, 3, 1.0), ("a", 2, 5.0), ("a", None, 7.0)], "g string, k int, w double")
    assert {(r["g"], r["k"]): r["rn"] for r in distributed_row_number(df, ["g"], ["k"]).collect()} == {(None, 1): 1, (None, 3): 2, ("a", None): 1, ("a", 2): 2}
    assert {(r["g"], r["k"]): r["s"] for r in running_sums(df, "k", {"s": "w"}, ["g"]).select("g", "k", "s").collect()} == {(None, 1): 2.0, (None, 3): 3.0, ("a", None): 7.0, ("a", 2): 12.0}
    filled = histogram_1d(df.where("k is not null"), F.col("k"), F.col("w"), ["g"], 0, 4, 2)
    assert filled.where("g is null").agg(F.sum("content")).first()[0] == pytest.approx(3.0)


def bucket_sizes(df, columns, buckets):
    codes = [sort_code(df, c) for c in columns]
    points = split_points(df, codes, buckets)
    sizes = df.withColumn("b", bucket_of(codes, points)).groupBy("b").agg(F.count("*").alias("n")).orderBy("b").collect()
    return points, [r["n"] for r in sizes]


def test_split_points_with_one_key_in_half_the_rows(spark):
    key = F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id"))
    points, sizes = bucket_sizes(spark.range(40_000), [key], 16)
    assert 15 <= len(points) <= 17
    assert max(sizes) == 20_001  # the key alone, id 7 included
    rest = [n for n in sizes if n not in (max(sizes), min(sizes))]  # what is below the key is nearly nothing
    assert min(sizes) <= 4 and len(rest) >= 14 and 0.8 * max(rest) <= min(rest)


def test_split_points_go_on_to_the_next_field(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, F.lit(-3.0)).otherwise(F.col("id") * 1.0).alias("a"), F.concat(F.lit("k"), F.lpad((F.col("id") * 7919 % 40_000).cast("string"), 5, "0")).alias("s"))
    points, sizes = bucket_sizes(rows, [F.col("a"), F.col("s")], 16)
    assert max(sizes) < 1.25 * 40_000 / 16 and len(sizes) >= 15
    spread = rows.select("a", "s", bucket_of([sort_code(rows, F.col("a")), sort_code(rows, F.col("s"))], points).alias("b")).orderBy("a", "s").collect()
    order = [r["b"] for r in spread]
    assert order == sorted(order)


def test_split_points_read_once_and_bucket_text_is_short(spark, tmp_path):
    spark.range(50_000).select((F.rand(3) * 100).alias("x")).write.parquet(f"{tmp_path}/x")
    df = spark.read.parquet(f"{tmp_path}/x")
    codes = [sort_code(df, F.col("x"))]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("split", "split points")
    points = split_points(df, codes, 2000)
    jobs = tracker.getJobIdsForGroup("split")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = {i for j in jobs for i in tracker.getJobInfo(j).stageIds}
    assert len(points) == 1999 and len(stages) <= 3  # one scan and its merge, no distinct, no sort
    plan = running_sums(df, "x", {"s": "x"}, buckets=2000)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN") < 12  # one search, however many boundaries
    sizes = [r["n"] for r in df.withColumn("b", bucket_of(codes, points)).groupBy("b").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 2000


def test_sort_code_follows_the_order(spark):
    for values, kind in (([None, float("-inf"), -2.5, 0.0, 3.0, float("inf"), float("nan")], "double"), ([None, "", "a", "ab", "b", "é"], "string"), ([None, False, True], "boolean"), ([None, -(2**62), 5, 2**62], "long")):
        df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
        codes = [r["c"] for r in df.select("v", sort_code(df, F.col("v")).alias("c")).orderBy("v").collect()]
        assert codes == sorted(codes) and None not in codes


def test_lookup_has_no_bound_on_keys(spark):
    keys = spark.range(1500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert lookup(keys.select("k"), "k", keys, ["v"]).where("v = 2 * k").count() == 1500
