"""Streaming queries: files arrive in two steps, results equal the batch runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkcollide.operators import hist
from sparkcollide.plans import event_queries as eq
from sparkcollide.plans import hist_queries as hq
from sparkcollide.plans import sqltext as S
from sparkcollide.plans.registry import query
from sparkcollide.session import scratch_dir, table
from sparkcollide.sources import fixtures
from sparkcollide.sources.lhe_fixture import lhe_files
from sparkcollide.streaming import assembly as asm
from sparkcollide.streaming import incremental as inc

R = S.rnd


def r(c, n=6):
    return F.round(c, n)


def arrivals(df, key):
    """Two halves of a table, written one after the other into one folder."""
    path = scratch_dir(df.sparkSession, "arrivals")
    for half in (0, 1):
        yield path, lambda h=half: df.filter(F.pmod(F.col(key), F.lit(2)) == h).write.mode("append").parquet(path)


def run_in_two_steps(df, key, run):
    out, ckpt = scratch_dir(df.sparkSession, "out"), scratch_dir(df.sparkSession, "ckpt")
    for path, arrive in arrivals(df, key):
        arrive()
        run(path, out, ckpt)
    return out


@query("STM01_incremental_scoring", f"WITH {S.SCORES} SELECT row_id, label, {R('score')} AS score, score >= 0.5 AS selected FROM scores")
def stm01(spark, sf):
    raw = table(spark, sf, "events").select("event_id", "event_type", "user_id", "value")

    def score(df):
        s = F.lit(1.0) / (1 + F.exp(-(F.col("value") - 40) / F.lit(60.0)))
        return df.select(F.col("event_id").alias("row_id"), F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("label"), r(s).alias("score"), (s >= 0.5).alias("selected"))

    out = run_in_two_steps(raw, "event_id", lambda path, out, ckpt: inc.incremental_append(spark, path, raw.schema, score, out, ckpt))
    return spark.read.parquet(out)


@query("STM02_shard_progress", "SELECT CAST(o_orderkey % 4 AS INT) AS shard, count(*) AS events FROM orders GROUP BY 1")
def stm02(spark, sf):
    out, ckpt = scratch_dir(spark, "out"), scratch_dir(spark, "ckpt")
    stream = inc.lhe_stream(spark, lhe_files(spark, sf)).withColumn("shard", F.regexp_extract("path", r"shard=(\d+)", 1).cast("int"))
    inc.running_aggregate(stream, ["shard"], [F.count("*").alias("events")], out, ckpt)
    return inc.latest(spark, out, ["shard"])


@query(
    "STM03_streaming_cutflow",
    f"""{eq.WITH_ACC}, {S.EVENTS_W}, {S.top_n('acc', 8)}, {S.reco(8)} SELECT sample, count(*) AS events_in, CAST(0 AS BIGINT) AS late, {R('sum(evweight)', 7)} AS w_in, {R('sum(CASE WHEN p1 THEN evweight ELSE 0 END)', 7)} AS w_drbb,
 {R('sum(CASE WHEN p2 THEN evweight ELSE 0 END)', 7)} AS w_pt, {R('sum(CASE WHEN p3 THEN evweight ELSE 0 END)', 7)} AS w_chi FROM ew LEFT JOIN flags USING (event_id) GROUP BY sample""",
)
def stm03(spark, sf):
    """Headers and jets come in three files in any order; an event's jets are spread over all of them."""
    jets, out, ckpt, path = fixtures.jets(spark, sf), scratch_dir(spark, "out"), scratch_dir(spark, "ckpt"), scratch_dir(spark, "arrivals")
    # the header of an order that has no jets announces none
    counts = jets.groupBy("event_id").agg(F.count("*").alias("n_jets"))
    heads = fixtures.events_w(spark, sf).join(counts, "event_id", "left").fillna(0, ["n_jets"])
    jets = jets.join(heads.select("event_id"), "event_id", "left_semi")
    step = F.pmod(F.xxhash64("event_id", *fixtures.JET_KEYS), F.lit(3))
    at = lambda k: F.timestamp_seconds(F.lit(1_700_000_000 + 3600 * k))
    for k in range(3):
        asm.jet_rows(jets.where(step == k).withColumn("ts", at(k))).write.mode("append").parquet(path)
        asm.header_rows(heads.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k).withColumn("ts", at(k))).write.mode("append").parquet(path)
        asm.streaming_cutflow(spark.readStream.schema(asm.INPUT).parquet(path), 8, out, ckpt)
    got = asm.totals(spark, out, ["sample"])
    return got.select("sample", "events_in", "late", *[r(c, 7).alias(n) for c, n in (("w_in", "w_in"), ("w_pass_drbb", "w_drbb"), ("w_pass_pt", "w_pt"), ("w_pass_chi", "w_chi"))])


@query("STM04_streaming_histogram", f"{hq.WJ} SELECT tag, CAST(ceil(pt0/5)-1 AS INT) AS bin, {R('sum(evweight)', 7)} AS content FROM wj WHERE pt0>0 AND pt0<300 GROUP BY ALL")
def stm04(spark, sf):
    rows = hq.weighted_jets(spark, sf).select("event_id", "tag", "pt0", "evweight")

    def run(path, out, ckpt):
        stream = spark.readStream.schema(rows.schema).parquet(path)
        keyed = stream.withColumn("bin", hist.bin_left_open(F.col("pt0"), hq.LO, hq.HI, hq.N)).filter(F.col("bin").isNotNull())
        inc.running_aggregate(keyed, ["tag", "bin"], [F.sum("evweight").alias("content")], out, ckpt)

    out = inc.latest(spark, run_in_two_steps(rows, "event_id", run), ["tag", "bin"])
    return out.select("tag", "bin", r("content", 7).alias("content"))
