"""Events assembled in the stream from records of several files.

An event's header and its jets arrive in any order and any number of files.
Keyed state holds what is needed of an event, its header, the number of jets seen
and the leading accepted jets, until all jets that the header announces are
there; then the event leaves the stream.  A timer on event time gives up events
that stay incomplete.  Reconstruction is the batch code on the assembled rows,
within the stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sparkcollide.operators import reco, select
from sparkcollide.operators.ranking import leading_n
from sparkcollide.sources.fixtures import JET_KEYS

JET = f"struct<o:double,{','.join(f'{k}:bigint' for k in JET_KEYS)},e:double,px:double,py:double,pz:double,pt:double,y:double,phi:double>"
HEADER = "event_id long, ts timestamp, sample string, evweight double, n_jets int"
INPUT = f"{HEADER}, counted int, jet {JET}"
STATE = f"sample string, evweight double, n_jets int, seen int, deadline long, jets array<{JET}>"
OUTPUT = f"event_id long, status string, sample string, evweight double, n_jets int, seen int, jets array<{JET}>"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def jet_rows(jets: DataFrame) -> DataFrame:
    """Jets (event_id, ts, identity, momenta) as stream records; a jet outside the acceptance is counted and not kept."""
    df = select.with_pt_eta(jets)
    inside = (F.col("pt") > select.PT_MIN) & (F.abs("eta") < select.ETA_MAX)
    fields = [(-F.col("pt")).alias("o"), *[F.col(k).cast("long").alias(k) for k in JET_KEYS], *[F.col(c) for c in ("e", "px", "py", "pz", "pt", "y", "phi")]]
    df = df.selectExpr("*", *select.DERIVED)
    none = [F.lit(None).cast(t).alias(n) for n, t in (("sample", "string"), ("evweight", "double"), ("n_jets", "int"))]
    return df.select("event_id", "ts", *none, F.lit(1).alias("counted"), F.when(inside, F.struct(*fields)).alias("jet"))


def header_rows(events: DataFrame) -> DataFrame:
    """Headers (event_id, ts, sample, evweight, n_jets) as stream records."""
    return events.select("event_id", "ts", "sample", "evweight", F.col("n_jets").cast("int").alias("n_jets"), F.lit(0).alias("counted"), F.lit(None).cast(JET).alias("jet"))


def _values(record) -> tuple:
    """A struct's values; Spark hands nested ones over as rows or as dictionaries."""
    return tuple(record.values()) if isinstance(record, dict) else tuple(record)


class Assembler(StatefulProcessor):
    """State of one event; at most ``n`` jets of it are kept."""

    def __init__(self, n: int, patience_ms: int):
        self.n, self.patience = n, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.event = handle.getValueState("event", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.event.get()
        sample, weight, expected, seen, deadline, jets = _values(known) if known is not None else (None, None, None, 0, None, [])
        jets, latest = [_values(j) for j in jets], 0
        for r in rows:
            latest = max(latest, int(r["ts"].timestamp() * 1000))
            if r["n_jets"] is not None:
                sample, weight, expected = r["sample"], r["evweight"], r["n_jets"]
            seen += r["counted"]
            if r["jet"] is not None:
                jets.append(_values(r["jet"]))
        jets = sorted(jets)[: self.n]
        if expected is not None and seen >= expected:
            if known is not None:
                self.event.clear()  # its timer finds nothing and is harmless
            yield Row(event_id=key[0], status="complete", sample=sample, evweight=weight, n_jets=expected, seen=seen, jets=jets)
            return
        if known is None:
            deadline = latest + self.patience
            self.handle.registerTimer(deadline)
        self.event.update((sample, weight, expected, seen, deadline, jets))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.event.get()
        if known is None:
            return
        sample, weight, expected, seen, deadline, jets = _values(known)
        if deadline <= expiredTimerInfo.getExpiryTimeInMs():  # not the timer of an earlier event of this number
            self.event.clear()
            yield Row(event_id=key[0], status="late", sample=sample, evweight=weight, n_jets=expected, seen=seen, jets=[_values(j) for j in jets])

    def close(self) -> None:
        pass


def assemble(records: DataFrame, n: int, delay: str = "1 day", patience_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """Events (event_id, status, sample, evweight, n_jets, seen, jets) from a stream of jet_rows() and header_rows().

    ``complete`` events leave with the batch that brings their last record.  An
    event that is incomplete ``patience_ms`` of event time after its first
    records leaves as ``late``; records behind the watermark are dropped, and
    records that come after their event has left wait for a header of their own.
    """
    stream = records.withWatermark("ts", delay)
    return stream.groupBy("event_id").transformWithState(Assembler(n, patience_ms), OUTPUT, "Append", "EventTime")


def reconstructed(events: DataFrame, n: int) -> DataFrame:
    """The batch reconstruction on assembled events; flags are null without n jets."""
    numbered = F.transform("jets", lambda j, i: F.struct((i + 1).alias("rn"), *[j[c].alias(c) for c in (*select.JET_FIELDS, "y", "phi")]))
    full = events.withColumn("jets", F.when((F.col("status") == "complete") & (F.size("jets") == n), numbered))
    return reco.reconstruct(full, n)


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Timers and typed state need the RocksDB store; the session's setting is put back afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


PENDING = "event_id long, sample string, evweight double, n_jets int, seen long, latest long, deadline long"


def merged(records: DataFrame, known: DataFrame, n: int, patience_ms: int) -> DataFrame:
    """Incomplete events (PENDING, jets) brought up to date by a batch of records; at most ``n`` jets of an event are kept.

    Records are counted and cut to the leading jets before they meet their event.
    """
    ms = F.unix_millis("ts")
    header = F.struct("sample", "evweight", "n_jets")
    nothing = lambda like: F.lit(None).cast(like)
    kind, jets = known.select(header.alias("h")).schema["h"].dataType, known.schema["jets"].dataType
    counts = records.groupBy("event_id").agg(
        F.sum(F.col("counted").cast("long")).alias("seen"), F.max(ms).alias("latest"), F.max_by(header, F.when(F.col("n_jets").isNotNull(), F.col("ts"))).alias("header"),
    )
    lead = leading_n(records.where("jet is not null").select("event_id", "jet"), ["event_id"], [F.col("jet").asc()], n)
    rows = counts.select("event_id", F.lit(1).alias("fresh"), "header", "seen", "latest", nothing("long").alias("deadline"), nothing(jets).alias("jets"))
    rows = rows.unionByName(lead.select("event_id", F.lit(1).alias("fresh"), nothing(kind).alias("header"), F.lit(0).cast("long").alias("seen"), nothing("long").alias("latest"), nothing("long").alias("deadline"), F.array("jet").alias("jets")))
    rows = rows.unionByName(known.select("event_id", F.lit(0).alias("fresh"), header.alias("header"), "seen", "latest", "deadline", "jets"))
    out = rows.groupBy("event_id").agg(
        F.max_by("header", F.when(F.col("header.n_jets").isNotNull(), F.col("fresh"))).alias("h"), F.sum("seen").alias("seen"), F.max("latest").alias("latest"),
        F.max("deadline").alias("deadline"), F.slice(F.array_sort(F.flatten(F.collect_list("jets"))), 1, n).alias("jets"),
    )
    return out.select("event_id", "h.*", "seen", "latest", F.coalesce("deadline", F.col("latest") + patience_ms).alias("deadline"), "jets")


def streaming_cutflow(records: DataFrame, n: int, out: str, checkpoint: str, delay_ms: int = 24 * 3600 * 1000, patience_ms: int = 24 * 3600 * 1000) -> None:
    """STM03: weighted cut flow with assembly and reconstruction in the stream; every batch leaves its sums in a folder of its own.

    The events of a batch and the incomplete ones before it are merged by Spark
    aggregates, with the rules of assemble(). They are written below the
    checkpoint, to one of two folders in turn: a batch that is repeated finds
    the state before it untouched.
    """
    w = lambda c: F.sum(F.when(F.col(c), F.col("evweight")).otherwise(0.0)).alias(f"w_{c}")
    sums = [F.count("*").alias("events_in"), F.sum("evweight").alias("w_in"), F.count(F.when(F.col("status") == "late", 1)).alias("late"), *[w(c) for c in reco.FLAGS]]
    kind = f"{PENDING}, jets array<{JET}>"

    def state(spark: SparkSession, batch_id: int) -> tuple[DataFrame, int | None]:
        """Events as a batch left them, with their status, and the largest time until then."""
        if batch_id < 0:
            return spark.createDataFrame([], f"{kind}, status string"), None
        path = f"{checkpoint}/events/{batch_id % 2}"
        clock = spark.read.schema("clock long").parquet(f"{path}/clock").first()["clock"]
        complete, late = F.col("n_jets").isNotNull() & (F.col("seen") >= F.col("n_jets")), F.col("deadline") <= F.lit(clock) - delay_ms
        status = F.when(complete, "complete").when(late, "late").otherwise("pending")
        return spark.read.schema(kind).parquet(f"{path}/merged").withColumn("status", status), clock

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, path = batch.sparkSession, f"{checkpoint}/events/{batch_id % 2}"
        before, clock = state(spark, batch_id - 1)
        fresh = batch if clock is None else batch.where(F.unix_millis("ts") > clock - delay_ms)
        merged(fresh, before.where("status = 'pending'").drop("status"), n, patience_ms).write.mode("overwrite").parquet(f"{path}/merged")
        seen = spark.read.schema(kind).parquet(f"{path}/merged").agg(F.max("latest").alias("t")).first()["t"]
        times = [t for t in (clock, seen) if t is not None]
        spark.createDataFrame([(max(times, default=0),)], "clock long").coalesce(1).write.mode("overwrite").parquet(f"{path}/clock")
        left = state(spark, batch_id)[0].where("status <> 'pending' and sample is not null")
        reconstructed(left, n).groupBy("sample").agg(*sums).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def totals(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Sums over the folders of all batches."""
    df = spark.read.parquet(out)
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in df.columns if c not in (*keys, "batch")])
