"""Faults that only larger tables or rare values show."""

import duckdb
import __spark_entry__ as entry
from pyspark.sql import functions as F

from sparkcollide.operators import lhe as ops
from sparkcollide.operators import ml, ranking, reco
from sparkcollide.plans import event_queries as eq
from sparkcollide.session import lookup
from sparkcollide.sinks.lhe_writer import write_lhe
from sparkcollide.sources import lhe, lhe_fixture
from sparkcollide.streaming import assembly as asm


def test_a_filter_does_not_bring_pair_masses_into_the_pairing_lambda(spark, sf):
    kept = eq.reconstructed(spark, sf, 8).filter("pass_chi").select("event_id")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda sq" in plan and "get(flatten(" not in plan
    assert reco.bound("a", "x", "x + 1") == "get(transform(array(a), x -> x + 1), 0)"


def test_pairs_on_the_ends_of_a_range_are_inside(spark, tmp_path):
    # both jets in one direction: pair pt is 30 + 1.2 (a + b), and so is mt at equal discounts
    events = [(a, total - a, 8 * k + 6, d / 100) for total in (50, 25) for a in range(1, total) for k in (3, 57, 400, 1211) for d in (2, 5, 7)]
    rows = [(e, line, part, part % 91, float(q), d) for e, (a, b, part, d) in enumerate(events) for line, q in ((1, a), (2, b))]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    name = "FLT11_select_event_by_pair"
    got = sorted(tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).select("var", "event_id").collect())
    for var, total in (("pair_pt", 50), ("mt", 25)):
        assert {e for e, (a, b, *_) in enumerate(events) if a + b == total} <= {e for v, e in got if v == var}
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == sorted(con.execute(f"SELECT var, event_id FROM ({entry.oracle_sql()[name]})").fetchall())


def test_event_text_is_made_after_the_shuffle(spark, tmp_path):
    rows = spark.range(40).select((F.col("id") % 3).alias("part"), F.col("id").alias("k"), (F.col("id") * 7).alias("w"))
    text = F.format_string("<event>\n 1 1 %d\n</event>", "w")
    tops = rows.select("part", F.lit("<LesHouchesEvents>\n<init>\n</init>").alias("preamble")).distinct()
    write_lhe(rows.select("part", "k", text.alias("event")), tops, f"{tmp_path}/whole", ["part"], ["k"], expected_events=40)
    write_lhe(rows, tops, f"{tmp_path}/late", ["part"], ["k"], expected_events=40, text=text)
    read = lambda p: sorted(tuple(r) for r in spark.read.text(f"{tmp_path}/{p}", wholetext=True).collect())
    assert read("late") == read("whole") and len(read("late")) == 3


def test_events_are_scaled_without_a_shuffle_by_source(spark):
    events = spark.range(100).select(F.when(F.col("id") < 90, "a").otherwise("b").alias("source"), F.col("id").cast("double").alias("xwgtup"), F.lit("text").alias("event"))
    out = ops.reweight_events(events, ops.source_fractions(ops.source_weight_stats(events), 0.9))
    assert "hashpartitioning(source" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 100


def test_a_batch_is_merged_into_the_incomplete_events_by_aggregates(spark):
    at = F.timestamp_seconds(F.lit(1000))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("sample", "string"), ("evweight", "double"), ("n_jets", "int"))]
    jet = lambda k: F.from_json(F.to_json(F.struct((-k).alias("o"), k.alias("l_linenumber"))), asm.JET)
    records = spark.range(20).select((F.col("id") % 2).alias("event_id"), at.alias("ts"), *none, F.lit(1).alias("counted"), jet(F.col("id")).alias("jet"))
    empty = spark.createDataFrame([], f"{asm.PENDING}, jets array<{asm.JET}>")
    first = asm.merged(records, empty, 3, 50)
    heads = asm.header_rows(spark.range(1).select(F.col("id").alias("event_id"), at.alias("ts"), F.lit("s").alias("sample"), F.lit(2.0).alias("evweight"), F.lit(10).alias("n_jets")))
    second = asm.merged(heads.unionByName(records), first, 3, 9999)
    assert "PySpark" not in second._jdf.queryExecution().executedPlan().toString()
    got = {r["event_id"]: (r["sample"], r["n_jets"], r["seen"], r["deadline"], [j["o"] for j in r["jets"]]) for r in second.collect()}
    assert got == {0: ("s", 10, 20, 1000050, [-18.0, -18.0, -16.0]), 1: (None, None, 20, 1000050, [-19.0, -19.0, -17.0])}


def test_candidates_come_from_events_with_enough_jets_only(spark, sf):
    out = eq.select.select_candidates(eq.accepted(spark, sf), c=1, l=1)
    assert all("/candidates-" in f for f in out.inputFiles())


def test_the_draw_of_a_score_is_made_once_a_jet(spark, sf):
    plan = entry.queries()["SCL14_sample_btag_score"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" in plan and "filter(bins" in plan.replace("#", " ")
    assert "md5" not in plan.split("filter(bins")[1].split("lambda b")[0]


def test_training_rows_are_bounded_by_bins_not_by_rows(spark):
    value = (F.col("id") * 37 % 1009).cast("double")
    rows = spark.range(40000).select("id", value.alias("x"), (F.col("id") % 5).cast("double").alias("y"), (value > 500).cast("int").alias("label"), (1.0 + F.col("id") % 3).alias("train_weight"))
    bins = ml.feature_bins(rows, ["x", "y"])
    assert [len(e) - 1 for e in bins.getSplitsArray()] == [ml.BINS, 5]
    cells = ml.binned_rows(rows, bins, "id", 1).cache()
    assert cells.count() <= ml.BINS * 5 * 2 * ml.PARTS < 40000 and cells.select("part").distinct().count() == ml.PARTS
    assert cells.agg(F.sum("train_weight")).first()[0] == rows.agg(F.sum("train_weight")).first()[0]


def test_scores_come_from_a_table_of_bins_and_equal_the_trees(spark, monkeypatch):
    value = (F.col("id") * 37 % 1009).cast("double")
    rows = spark.range(3000).select("id", value.alias("x"), (F.col("id") % 5).cast("double").alias("y"), (value > 500).cast("int").alias("label"), F.lit(1.0).alias("train_weight"))
    model = ml.train_classifier(rows, ["x", "y"], "id", rounds=3)
    looked_up = {tuple(r) for r in ml.score(model, rows).select("id", "score").collect()}
    assert "Range (0, 160" in ml.score(model, rows)._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(ml, "CELLS", 0)
    assert looked_up == {tuple(r) for r in ml.score(model, rows).select("id", "score").collect()} and len(looked_up) == 3000


def test_few_keys_are_looked_up_without_a_shuffle_of_the_rows(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(1000).select("id", (F.col("id") % 2).alias("label"))
        out = lookup(rows, "label", rows.groupBy("label").agg(F.count("*").alias("n")), ["n"])
        assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert out.where("n = 500").count() == 1000 and out.columns == ["id", "label", "n"]


def test_rows_of_large_groups_are_told_without_a_shuffle_by_group(spark, monkeypatch):
    monkeypatch.setattr(ranking, "WHOLE", 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(2000).select("id", (F.col("id") % 2).alias("g"))
        out = ranking.distributed_row_number(rows, ["g"], ["id"])
        assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
        assert out.where("rn = floor(id / 2) + 1").count() == 2000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_event_headers_are_read_without_splitting_the_rest(spark):
    odd = [
        "<event>\n 6 1 1.0 2 3 4\n 9 9\n</event>", "<event></event>", "<event>6 1 1 1 1 1</event>", "<event>\n# a\n  # b\n\n   \n 7 8 9 </event>", "<event>\n#only\n</event>", "", "\n\n x y",
        "<event>\n \t6 1 2\r\n 5\n</event>", "<event\n b='2'>\n 1 2 3\n</event> \n", "<event> # x\n y",
    ]
    rows = spark.createDataFrame([(e,) for e in odd], "event string").select(F.get(lhe.payload_lines(F.col("event")), F.lit(0)).alias("a"), lhe.header_line(F.col("event")).alias("b"))
    assert rows.where("not a <=> b").count() == 0 and rows.where("b is not null").count() == 7
    parsed = lhe.parse_event_header(spark.createDataFrame([(odd[0],)], "event string")).select("xwgtup")
    assert "split(" in (plan := parsed._jdf.queryExecution().optimizedPlan().toString()) and "lambda" not in plan


def test_constants_of_an_event_are_not_formatted(spark, sf):
    rows = lhe_fixture.event_rows(spark, sf)
    plan = rows.select(lhe_fixture.event_text().alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "0.0000000000e+00 0.0000000000e+00" in plan
