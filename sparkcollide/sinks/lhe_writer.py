"""Event text sinks: sorted part files, each a complete document on its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

FOOTER = "</LesHouchesEvents>"
MOST_TASKS = 4096


def with_init(preamble: Column, beam: Column, processes: Column) -> Column:
    """Replace the payload of the init block."""
    line = lambda p: F.format_string("%.16e %.16e %.16e %d", p["xsec"], p["xerr"], p["xmax"], p["lprup"])
    body = F.concat(F.lit("<init>\n"), beam, F.lit("\n"), F.array_join(F.transform(processes, line), "\n"), F.lit("\n</init>"))
    return F.regexp_replace(preamble, F.lit(r"(?s)<init\b.*?</init>"), body)


def set_idwtup(beam: Column, idwtup: int) -> Column:
    """Second-last token of the beam line is the weight strategy."""
    return F.regexp_replace(beam, r"\S+(\s+\S+)$", f"{idwtup}$1")


def write_lhe(events: DataFrame, preambles: DataFrame, path: str, parts: list[str], order: list[str],
              footer: bool = True, compression: str = "none", mode: str = "append", single_file: bool = False, expected_events: int | None = None, text: Column | None = None) -> int:
    """SNK08: preamble, events in order, footer - one document per part.

    ``events`` has (parts, order, event); ``preambles`` (parts, preamble).
    Header and footer travel as rows, so the write is one shuffle by part, into
    as many tasks as there are parts (4096 at most), and one in-task sort. With
    ``text``, an expression of other columns of ``events``, those are shuffled
    and sorted in place of the text, which is made as it is written.
    Choose parts to hold a bounded number of events; a single
    file is only produced on request. Returns the number of events, which is
    observed while they are written; another number than expected raises.
    """
    seen = Observation("events")
    events = events.observe(seen, F.count("*").alias("n"))
    lead, tail = F.lit(0), F.lit(2)
    null_order = [F.lit(None).cast(events.schema[c].dataType).alias(c) for c in order]
    of_text = [c for c in events.columns if text is not None and c not in (*parts, *order)]
    line = F.col("event") if text is None else F.lit(None).cast("string")
    rows = events.select(*parts, F.lit(1).alias("_k"), *order, *of_text, line.alias("value"))
    head = preambles.select(*parts, lead.alias("_k"), *null_order, F.rtrim(F.col("preamble")).alias("value"))
    rows = rows.unionByName(head, allowMissingColumns=True)
    if footer:
        rows = rows.unionByName(preambles.select(*parts, tail.alias("_k"), *null_order, F.lit(FOOTER).alias("value")), allowMissingColumns=True)
    rows = rows.coalesce(1) if single_file else rows.repartition(max(1, min(MOST_TASKS, preambles.count())), *parts)
    rows = rows.sortWithinPartitions(*parts, "_k", *order)
    value = F.col("value") if text is None else F.when(F.col("_k") == 1, text).otherwise(F.col("value"))
    rows.select(*parts, value.alias("value")).write.mode(mode).option("compression", compression).partitionBy(*parts).text(path)
    if expected_events is not None and seen.get["n"] != expected_events:
        raise ValueError(f"{path}: expected {expected_events} events, wrote {seen.get['n']}")
    return seen.get["n"]


def write_merge_manifest(fractions: DataFrame, path: str, total_xsec: float, mode: str) -> None:
    """SNK09: one JSON document per source plus the totals on every line."""
    fractions.select(
        F.lit(total_xsec).alias("total_xsec_pb"), F.lit(mode).alias("fraction_mode"), "source", "event_count", "sum_w", "fraction", "scale"
    ).write.json(path)
