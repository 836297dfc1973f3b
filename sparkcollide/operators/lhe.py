"""Validation, merging and re-weighting of event text files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcollide.functions.text import strip_ansi
from sparkcollide.operators import event_check
from sparkcollide.operators.labels import unique_labels  # noqa: F401  (WIN07)
from sparkcollide.session import cut_lineage

def is_close(a: Column, b: Column, abs_tol: float, rel_tol: float) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(abs_tol), rel_tol * F.greatest(F.abs(a), F.abs(b)))


# --- run headers ------------------------------------------------------------------
def init_compatibility(inits: DataFrame, abs_tol: float = 0.0, rel_tol: float = 1e-9, relaxed: bool = False) -> DataFrame:
    """JN07: every file against the first path; one row per disagreement.

    The reference header is a one-row scalar, so no join is planned. The
    relaxed form ignores the weight-strategy token and wants one process.
    """
    beam = F.col("beam_line")
    if relaxed:  # drop the token before the process count
        beam = F.regexp_replace(beam, r"\s\S+(\s\S+)$", "$1")
    rows = inits.select("path", beam.alias("beam_line"), "nprup", "processes")
    first = rows.agg(F.min_by(F.struct("beam_line", "nprup", "processes"), "path").alias("ref"), F.min("path").alias("ref_path"))
    rows = rows.withColumn("_r", first.select(F.struct("ref", "ref_path")).scalar())
    ref = F.col("_r.ref")
    pair = F.zip_with("processes", ref["processes"], lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = rows.withColumn("_pairs", F.slice(pair, F.lit(1), F.least(F.col("nprup"), ref["nprup"])))
    checks = [
        ("beam line", F.col("beam_line") != ref["beam_line"]),
        ("process count", F.col("nprup") != (F.lit(1) if relaxed else ref["nprup"])),
        ("process id", F.exists("_pairs", lambda p: p["a"]["lprup"] != p["b"]["lprup"])),
    ]
    if not relaxed:
        def apart(f):
            return lambda p: ~is_close(p["a"][f], p["b"][f], abs_tol, rel_tol)

        checks.append(("cross-section", F.exists("_pairs", apart("xsec"))))
        checks.append(("cross-section error", F.exists("_pairs", apart("xerr"))))
    problems = F.array_compact(F.array(*[F.when(bad, label) for label, bad in checks]))
    return rows.withColumn("problem", F.explode(problems)).select("path", F.col("_r.ref_path").alias("reference"), "problem")


def guard(like: DataFrame, error: Column) -> DataFrame:
    """No rows of the columns of ``like``, but a failure where ``error`` (a message from scalars) is not null.

    Union it to a result: it costs nothing per row and also looks at an empty one.
    """
    wrong = F.when(error.isNull(), F.lit(False)).otherwise(F.raise_error(error).cast("boolean"))
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema]
    return like.sparkSession.range(1).where(wrong).select(*nulls)


def merge_shards(
    events: DataFrame, inits: DataFrame, expected_events: int | Column | None = None, abs_tol: float = 0.0, rel_tol: float = 1e-9, relaxed: bool = False
) -> DataFrame:
    """SET01: the events of all shards; headers that disagree, or another number of events than expected, raise.

    ``inits`` are the headers of the same files. Counting the events needs a scan
    of its own only if a number is expected.
    """
    odd = init_compatibility(inits, abs_tol, rel_tol, relaxed)
    odd = odd.agg(F.min(F.concat("path", F.lit(": "), "problem", F.lit(" differs from "), "reference")).alias("m")).scalar()
    none = F.when(inits.agg(F.count("*").alias("n")).scalar() == 0, "no run headers found")
    checks = [odd, none]
    if expected_events is not None:
        want = expected_events if isinstance(expected_events, Column) else F.lit(expected_events)
        have = events.agg(F.count("*").alias("n")).scalar()
        checks.append(F.when(have != want, F.concat(F.lit("expected "), want.cast("string"), F.lit(" events, found "), have.cast("string"))))
    return events.union(guard(events, F.coalesce(*checks)))


# Fixed value: the cross-section line printed by the generator.
XSEC_LINE = r":\s*([+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)\s*pb\s*\+-\s*\(\s*([+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)\s*pb"


def log_cross_sections(logs: DataFrame) -> DataFrame:
    """(dir, log, line_no, line) -> numbered cross-section values per log."""
    line = strip_ansi(F.col("line"))
    hits = logs.select(
        "dir", "log", "line_no",
        F.regexp_extract(line, XSEC_LINE, 1).try_cast("double").alias("xsec"),
        F.regexp_extract(line, XSEC_LINE, 2).try_cast("double").alias("xerr"),
    ).filter(F.col("xsec").isNotNull())
    values = F.sort_array(F.collect_list(F.struct("line_no", "xsec", "xerr")))
    return hits.groupBy("dir", "log").agg(values.alias("values"))


def log_xsec_override(inits: DataFrame, logs: DataFrame, abs_tol: float = 0.0, rel_tol: float = 1e-6) -> DataFrame:
    """JN08: values of agreeing sibling logs replace the header values.

    Logs hold one matching line per process, so the per-log array is bounded
    by the process count. Disagreement raises, and so does a number of values
    other than the declared processes, unless one process is declared. Files
    without a log keep their header values.
    """
    vals = log_cross_sections(logs)
    first = vals.agg(F.min_by("values", F.struct("dir", "log")).alias("ref")).select("ref")
    vals = vals.withColumn("_ref", first.scalar())
    differ = (F.size("values") != F.size("_ref")) | F.exists(
        F.zip_with("values", "_ref", lambda a, b: is_close(a["xsec"], b["xsec"], abs_tol, rel_tol) & is_close(a["xerr"], b["xerr"], abs_tol, rel_tol)),
        lambda ok: ~F.coalesce(ok, F.lit(False)),
    )
    fail = F.raise_error(F.concat(F.col("log"), F.lit(": cross-section differs between logs"))).cast("string")
    good = vals.withColumn("log", F.when(~differ, F.col("log")).otherwise(fail))
    by_dir = good.groupBy("dir").agg(F.min_by("values", "log").alias("values"), F.min("log").alias("log"))
    out = inits.withColumn("dir", F.regexp_replace("path", "/[^/]*$", "")).join(by_dir, "dir", "left")
    # a header with one process takes the first value; otherwise there is one value per process
    wrong = F.col("values").isNotNull() & (F.size("values") != F.col("nprup")) & (F.col("nprup") != 1)
    fail = F.raise_error(F.concat(F.col("log"), F.lit(": values differ in number from the declared processes"))).cast("string")
    out = out.withColumn("path", F.when(wrong, fail).otherwise(F.col("path")))
    ex = out.select("path", "log", "values", F.posexplode("processes").alias("i", "p"))
    v = F.get("values", F.col("i"))
    return ex.select(
        "path", (F.col("i") + 1).alias("process"), F.col("p.lprup").alias("lprup"),
        F.coalesce(v["xsec"], F.col("p.xsec")).alias("xsec"), F.coalesce(v["xerr"], F.col("p.xerr")).alias("xerr"),
        F.when(v["xsec"].isNotNull(), "log").otherwise("init").alias("source"),
    )


# --- weights ------------------------------------------------------------------------
def source_weight_stats(weights: DataFrame) -> DataFrame:
    """AGG21: (source, xwgtup) -> count, sums and range; a zero sum raises."""
    s = weights.groupBy("source").agg(
        F.count("*").alias("event_count"), F.sum("xwgtup").alias("sum_w"), F.sum(F.col("xwgtup") * F.col("xwgtup")).alias("sum_w2"),
        F.min("xwgtup").alias("min_w"), F.max("xwgtup").alias("max_w"),
    )
    fail = F.raise_error(F.concat(F.col("source"), F.lit(": raw weight sum is zero"))).cast("double")
    return s.withColumn("sum_w", F.when(F.coalesce(F.col("sum_w"), F.lit(0.0)) != 0, F.col("sum_w")).otherwise(fail))


def effective_events(sum_w: str = "sum_w", sum_w2: str = "sum_w2") -> Column:
    """UDF03: (sum w)^2 / sum w^2."""
    return F.when(F.col(sum_w2) != 0, F.col(sum_w) * F.col(sum_w) / F.col(sum_w2)).otherwise(0.0)


def source_fractions(stats: DataFrame, total_xsec: float, mode: str = "count") -> DataFrame:
    """AGG22: share of each source and the scale that makes the weights sum to it."""
    basis = {"count": F.col("event_count").cast("double"), "equal": F.lit(1.0), "effective-events": effective_events()}[mode]
    stats = stats.withColumn("basis", basis)
    total = stats.agg(F.sum("basis").alias("b"))
    fraction = F.col("basis") / total.scalar()
    return stats.withColumn("fraction", fraction).withColumn("scale", F.lit(total_xsec) * F.col("fraction") / F.col("sum_w"))


def reweight_events(events: DataFrame, fractions: DataFrame) -> DataFrame:
    """AGG23: multiply every weight by the scale of its source.

    A plain join with scales of known size: where they are small they go to
    every task before any event text is shuffled, and adaptive execution splits
    hot sources where they are not.
    """
    scales = cut_lineage(fractions.select("source", F.col("scale").alias("source_scale")), "scales")
    return events.join(scales, "source").withColumn("new_weight", F.col("xwgtup") * F.col("source_scale"))


def rewrite_event_weight(event: Column, weight: Column) -> Column:
    """STR06: replace the third token of the header line, keeping its indent."""
    pattern = r"(?s)^(<event[^>]*>(?:\s*\n|\s*#[^\n]*\n)*[ \t]*)(\S+)[ \t]+(\S+)[ \t]+\S+[ \t]*([^\n]*)"
    fail = F.raise_error(F.concat(F.lit("no event header to rewrite: "), F.substring(event, 1, 80))).cast("string")
    new = F.regexp_replace(event, F.lit(pattern), F.concat(F.lit("$1$2 $3 "), weight.cast("string"), F.lit(" $4")))
    return F.when(event.rlike(pattern) & weight.isNotNull(), new).otherwise(fail)


# --- event checks ----------------------------------------------------------------------
def check_events(events: DataFrame, **rules) -> DataFrame:
    """AGG29: sorted list of rule violations per event; ``rules`` are those of :class:`event_check.Rules`.

    An event that cannot be read (bad header, a bad particle row, rows other
    than declared) has that one error; no other rule looks at it.

    ``events`` has either the text of each event (``event``), which then gains
    ``nup`` and ``xwgtup`` as well, or ``nup`` and the parsed ``particles``.
    Rules look inside one event only: one narrow Arrow pass, no shuffle.
    """
    rule = event_check.Rules(**rules)
    parsed = "particles" in events.columns
    source = ["nup", "particles"] if parsed else ["event"]
    carry = [c for c in events.columns if parsed or c != "event"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                if parsed:
                    found, more = event_check.from_arrays(part.column("nup"), part.column("particles")), []
                else:
                    found, weight = event_check.read_text(part.column("event"))
                    more = [pa.array(found.nup, pa.int32(), mask=found.nup < 0), pa.array(weight, mask=np.isnan(weight))]
                kept = [part.column("carry")]
                yield pa.RecordBatch.from_arrays([*kept, *more, event_check.error_lists(found, rule)], names=["carry", *(() if parsed else ("nup", "xwgtup")), "errors"])

    rows = events.select(F.struct(*carry).alias("carry") if carry else F.lit(0).alias("carry"), *source)
    kind = rows.schema["carry"].dataType.simpleString()
    out = rows.mapInArrow(run, f"carry {kind}, {'' if parsed else 'nup int, xwgtup double, '}errors array<string>")
    return out.select(*[f"carry.{c}" for c in carry], *(() if parsed else ("nup", "xwgtup")), "errors")


def colour_line_partners(particles: DataFrame, event: list[str], flavour: int) -> DataFrame:
    """JN09: final quark and antiquark joined by a tag with no other ends.

    The partner is found by aggregation on (event, tag), never by listing
    pairs: only tags with exactly two ends survive.
    """
    act = particles.filter(F.col("status").isin(-1, 1))
    end = lambda c: F.struct(F.col(c).alias("tag"), F.lit(c).alias("slot"))
    ends = act.withColumn("_e", F.explode(F.array(end("c1"), end("c2")))).filter(F.col("_e.tag") != 0)
    fin = F.col("status") == 1
    q = fin & (F.col("pid") == flavour) & (F.col("_e.slot") == "c1") & (F.col("c2") == 0)
    aq = fin & (F.col("pid") == -flavour) & (F.col("_e.slot") == "c2") & (F.col("c1") == 0)
    g = ends.groupBy(*event, F.col("_e.tag").alias("tag")).agg(
        F.count("*").alias("_n"), F.count(F.when(q, 1)).alias("_nq"), F.count(F.when(aq, 1)).alias("_na"),
        F.max(F.when(q, F.col("idx"))).alias("quark"), F.max(F.when(aq, F.col("idx"))).alias("antiquark"),
    )
    return g.filter("_n = 2 AND _nq = 1 AND _na = 1").select(*event, "tag", "quark", "antiquark")


def check_report(checked: DataFrame, expected: int | None = None) -> DataFrame:
    """AGG30: totals, failures and whether the expected count was met."""
    bad = F.size("errors") > 0
    out = checked.agg(
        F.count("*").alias("events"), F.count(F.when(bad, 1)).alias("failed"), F.count(F.when(~bad, 1)).alias("passed"),
        F.coalesce(F.sum(F.size("errors")), F.lit(0)).cast("long").alias("n_errors"),
    )
    ok = F.lit(True) if expected is None else F.col("events") == expected
    return out.withColumn("count_ok", ok)


def first_errors(checked: DataFrame, keys: list[str], max_errors: int = 20) -> DataFrame:
    """TOP05: first messages in event order (bounded top-k per partition)."""
    # the outer form keeps the optimizer from copying the check into an inferred filter
    rows = checked.select(*keys, F.posexplode_outer("errors").alias("i", "message"))
    return rows.filter(F.col("message").isNotNull()).orderBy(*keys, "i").limit(max_errors)
