"""Events assembled in the stream: order of arrival, late events, reconstruction."""

import random

from pyspark.sql import functions as F

from sparkcollide.operators import reco, select
from sparkcollide.streaming import assembly as asm

DAY = 86400


def rows(spark, events, per=5, seed=1):
    r = random.Random(seed)
    jets = [(e, k, 10 + k, 20, 25.0 + r.random() * 60, r.uniform(-2, 2), r.uniform(-3, 3)) for e in range(events) for k in range(per)]
    df = spark.createDataFrame(jets, "event_id long, l_linenumber int, l_partkey long, l_suppkey long, pt0 double, eta0 double, phi0 double")
    df = df.withColumns({"px": F.col("pt0") * F.cos("phi0"), "py": F.col("pt0") * F.sin("phi0"), "pz": F.col("pt0") * F.sinh("eta0"), "e": F.col("pt0") * F.cosh("eta0") + 5})
    heads = spark.range(events).select(F.col("id").alias("event_id"), F.lit("s").alias("sample"), (F.col("id") + 1.0).alias("evweight"), F.lit(per).alias("n_jets"))
    return df, heads


def at(days):
    return F.timestamp_seconds(F.lit(1_700_000_000 + DAY * days))


def arrive(path, *parts):
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(path)


def test_any_order_gives_the_batch_result_and_late_events_leave(spark, tmp_path):
    path, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    jets, heads = rows(spark, 60)
    held = (F.col("event_id") == 7) & (F.col("l_linenumber") == 2)  # event 7 never gets this jet
    stepped = F.pmod(F.xxhash64("event_id", "l_linenumber"), F.lit(3))
    for k in range(3):
        arrive(path, asm.jet_rows(jets.where((stepped == k) & ~held).withColumn("ts", at(0))))
        if k == 1:  # headers come in the middle
            arrive(path, asm.header_rows(heads.withColumn("ts", at(0))))
        asm.streaming_cutflow(spark.readStream.schema(asm.INPUT).parquet(path), 4, out, ckpt)
    n = 4
    batch = select.gather(select.leading_jets(select.with_pt_eta(jets.where("event_id <> 7")), n), n)
    flags = reco.reconstruct(batch, n).select("event_id", *reco.FLAGS)
    want = heads.where("event_id <> 7").join(flags, "event_id", "left").agg(F.count("*").alias("n"), F.sum("evweight").alias("w"), *[F.sum(F.when(F.col(f), F.col("evweight")).otherwise(0.0)).alias(f"w_{f}") for f in reco.FLAGS]).first()
    got = asm.totals(spark, out, ["sample"]).first()
    assert (got["events_in"], got["w_in"], got["late"]) == (want["n"], want["w"], 0)
    assert [round(got[f"w_{f}"], 9) for f in reco.FLAGS] == [round(want[f"w_{f}"], 9) for f in reco.FLAGS]

    # three days later the watermark passes the patience of event 7, once
    for days in (3, 6):
        more = heads.where("event_id = 0").withColumns({"event_id": F.lit(1000 + days).cast("long"), "n_jets": F.lit(0), "ts": at(days)})
        arrive(path, asm.header_rows(more))
        asm.streaming_cutflow(spark.readStream.schema(asm.INPUT).parquet(path), 4, out, ckpt)
    got = asm.totals(spark, out, ["sample"]).first()
    assert (got["events_in"], got["late"]) == (62, 1)


def test_the_setting_of_the_session_is_put_back(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    with asm.rocksdb_state(spark):
        assert spark.conf.get(key) == asm.ROCKSDB
    assert spark.conf.get(key, None) == before
