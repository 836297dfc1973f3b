"""Unique labels in input order, for families of any size.

A name that is taken gets the next free number: ``run``, ``run_2``, ``run_3``.
Ranks of equal names are distributed.  Only names that already carry a number of
a repeated family depend on the order in which names come: such a name keeps its
label if it comes before the family's counter reaches its number, and is counted
as a repeat itself otherwise.  That is decided from the few places of the family
at which the counter meets such names.  The numbers that were kept are then
left out by a distributed running count, so no family is gathered.
"""

from __future__ import annotations

from collections import deque
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcollide.operators.ranking import distributed_row_number, running_sums
from sparkcollide.session import cut_lineage

NUMBERED = r"^(?s)(.*)_([1-9][0-9]{0,16})$"
DEPTH = r"((?:_[1-9][0-9]{0,16})*)$"


def _decided(batches):
    """Sorted (fam, pos, kind, at, num): kind 0 is the family's repeat number ``pos`` at time ``at``, kind 1 a name with number ``num``."""
    fam, repeats, kept = None, deque(), 0
    for batch in batches:
        out = []
        for here, pos, kind, at, num in zip(*(batch.column(c).to_pylist() for c in ("fam", "pos", "kind", "at", "num")), strict=True):
            if here != fam:
                fam, kept = here, 0
                repeats.clear()
            if kind == 0:
                repeats.append((pos, at))
                continue
            wanted = num - 1 - kept  # the repeat that the counter would give this number
            while repeats and repeats[0][0] < wanted:
                repeats.popleft()
            first = not (repeats and repeats[0][0] == wanted) or at < repeats[0][1]
            kept += first
            out.append((here, num, first))
        if out:
            f, n, k = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(n, pa.int64()), pa.array(k, pa.bool_())], names=["fam", "num", "kept"])


def unique_labels(inputs: DataFrame, order: str = "ord", base: str = "base") -> DataFrame:
    """WIN07: base name, then ``_2``, ``_3``... in input order, skipping names in use; a null name has no label.

    ``order`` must tell the rows apart.
    """
    ranked = cut_lineage(distributed_row_number(inputs, [base], [order], "_k"), "labels")
    names = ranked.where(F.col(base).isNotNull()).groupBy(F.col(base).alias("name")).agg(F.count("*").alias("n"), F.min(order).alias("at"))
    suffix = F.regexp_extract("name", DEPTH, 1)
    names = names.select("name", "n", "at", F.regexp_extract("name", NUMBERED, 1).alias("parent"), F.regexp_extract("name", NUMBERED, 2).try_cast("long").alias("num"), (F.size(F.split(suffix, "_")) - 1).alias("depth"))
    names = cut_lineage(names, "names")
    # numbered names whose family has rows of its own
    family = names.select(F.col("name").alias("fam"), F.col("n").alias("fam_n"))
    numbered = names.where("num >= 2").join(family, F.col("parent") == F.col("fam"))
    levels = sorted(r["depth"] for r in numbered.select("depth").distinct().collect())
    moved = names.select("name").limit(0)
    kept = []
    for depth in levels:  # a family is settled before the names below it
        lost = moved.withColumnRenamed("name", "lost")
        mine = numbered.where(F.col("depth") == depth).join(lost, F.col("fam") == F.col("lost"), "left")
        mine = mine.select("name", "fam", "num", "at", (F.col("fam_n") - 1 + F.col("lost").isNotNull().cast("int")).alias("repeats"), F.col("lost").isNotNull().cast("int").alias("shift")).where("repeats >= 1")
        mine = cut_lineage(distributed_row_number(mine, ["fam"], ["num"], "i").where("num - i <= repeats"), "numbered")
        # with up to i - 1 numbers left out before, the counter meets number num at one of these repeats
        before = mine.select(F.col("fam").alias("f"), (F.col("i") + 1).alias("j"), F.col("num").alias("last"))
        met = mine.join(before, (F.col("fam") == F.col("f")) & (F.col("i") == F.col("j")), "left")
        low, high = F.greatest(F.col("num") - F.col("i"), F.coalesce("last", F.lit(1)), F.lit(1)), F.least(F.col("num") - 1, "repeats")
        met = met.where(low <= high).select(F.col("fam").alias("f"), "shift", F.explode(F.sequence(low, high)).alias("pos"))
        times = ranked.join(met, (F.col(base) == F.col("f")) & (F.col("_k") == F.col("pos") + 1 - F.col("shift")))
        times = times.select(F.col("f").alias("fam"), "pos", F.lit(0).alias("kind"), F.col(order).alias("at"), F.lit(None).cast("long").alias("num"))
        stream = times.union(mine.select("fam", F.col("num") - 1, F.lit(1), "at", "num"))
        decided = stream.repartition("fam").sortWithinPartitions("fam", "pos", "kind").mapInArrow(_decided, "fam string, num long, kept boolean")
        decided = cut_lineage(decided, "decided")
        kept.append(decided.where("kept").select("fam", "num"))
        lost = decided.where("not kept").select(F.concat_ws("_", "fam", F.col("num").cast("string")).alias("name"))
        moved = cut_lineage(moved.union(lost), "moved")
    lost = moved.withColumnRenamed("name", "_lost")
    rows = ranked.join(lost, F.col(base) == F.col("_lost"), "left").withColumn("_j", F.col("_k") - 1 + F.col("_lost").isNotNull().cast("int")).drop("_lost")
    if kept:
        left_out = distributed_row_number(reduce(DataFrame.union, kept), ["fam"], ["num"], "m")
        # of the numbers from 2 on, num - m - 1 free ones come before this one
        marks = left_out.select("fam", (F.col("num") - F.col("m") - 0.5).cast("double").alias("pos"), F.lit(1).alias("w"))
        marks = marks.union(rows.join(left_out.select(F.col("fam").alias("f")).distinct(), F.col(base) == F.col("f"), "left_semi").where("_j >= 1").select(F.col(base), F.col("_j").cast("double"), F.lit(0)))
        skipped = running_sums(marks, "pos", {"skipped": "w"}, ["fam"]).select(F.col("fam").alias("_f"), F.col("pos").alias("_p"), "skipped")
        rows = rows.join(skipped, (F.col(base) == F.col("_f")) & (F.col("_j").cast("double") == F.col("_p")), "left").drop("_f", "_p")
    else:
        rows = rows.withColumn("skipped", F.lit(0))
    number = F.col("_j") + 1 + F.coalesce("skipped", F.lit(0))
    label = F.when(F.col(base).isNull() | (F.col("_j") == 0), F.col(base)).otherwise(F.concat_ws("_", base, number.cast("string")))
    return rows.select(*inputs.columns, label.alias("label"))
