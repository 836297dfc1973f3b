"""Tagger score distributions per (eta, pT) cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkcollide.functions import noise
from sparkcollide.sources.fixtures import JET_KEYS

# Cell edges, lower edge inclusive.
PT_EDGES = (20, 30, 40, 50, 60, 70, 80, 90, 100, 120, 140, 160, 180, 200, 250, 300, 400, 600, 1000)
ETA_EDGES = (0.0, 0.5, 1.0, 1.5, 2.0, 2.5)
MAX_BINS = 10_000


def scan_btag_distributions(spark: SparkSession, path: str) -> DataFrame:
    """SRC14: (eta_bin, pt_bin, bin_lo, content)."""
    schema = "eta_bin int, pt_bin int, bin_lo double, content double"
    return spark.read.schema(schema).parquet(path)


def _edge_bin(x: str, edges: tuple, label: str) -> str:
    """Binary search over fixed edges; a value outside raises."""

    def search(lo: int, hi: int) -> str:
        if hi - lo == 1:
            return str(lo)
        mid = (lo + hi) // 2
        return f"IF({x} < {edges[mid]!r}, {search(lo, mid)}, {search(mid, hi)})"

    bad = f"CAST(raise_error('{label} outside the defined bins') AS INT)"
    return f"CASE WHEN {x} >= {edges[0]!r} AND {x} < {edges[-1]!r} THEN {search(0, len(edges) - 1)} ELSE {bad} END"


def lookup_cell(jets: DataFrame) -> DataFrame:
    """JN12: cell numbers from fixed edges; out of range is an error."""
    return jets.selectExpr("*", f"{_edge_bin('pt', PT_EDGES, 'pT')} AS pt_bin", f"{_edge_bin('abs(eta)', ETA_EDGES, 'eta')} AS eta_bin")


def sample_score(jets: DataFrame, dist: DataFrame, seed: int) -> DataFrame:
    """SCL14: inverse-cdf draw; returns the lower edge of the chosen bin.

    A cell outside the fixed edges or of more than MAX_BINS bins raises, so the
    table is bounded (90 rows) and broadcast.
    """
    w = Window.partitionBy("eta_bin", "pt_bin").orderBy("bin_lo")
    cum = dist.withColumn("cum", F.sum("content").over(w))
    cell = cum.groupBy("eta_bin", "pt_bin").agg(F.sort_array(F.collect_list(F.struct("bin_lo", "cum"))).alias("bins"), F.sum("content").alias("total"))
    bounded = (F.size("bins") <= MAX_BINS) & F.col("eta_bin").between(0, len(ETA_EDGES) - 2) & F.col("pt_bin").between(0, len(PT_EDGES) - 2)
    fail = F.raise_error(F.lit(f"a cell outside the edges or of more than {MAX_BINS} bins")).cast("double")
    cell = cell.withColumn("total", F.when(bounded, F.col("total")).otherwise(fail))
    u = noise.uniform(seed, F.col("event_id"), *[F.col(k) for k in JET_KEYS])
    out = jets.join(F.broadcast(cell), ["eta_bin", "pt_bin"])
    # the draw is a lambda's own variable: as a column it would be computed again for each bin
    hit = F.get(F.transform(F.array(u * F.col("total")), lambda x: F.get(F.filter("bins", lambda b: x <= b["cum"]), F.lit(0))), F.lit(0))
    return out.withColumn("score", hit["bin_lo"]).drop("bins", "total")
