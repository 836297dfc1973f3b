"""Adapters that turn the generic test tables into collider-shaped inputs.

Each adapter is a narrow projection of one table (or one equi-join), so its
size grows with the table and no group is ever gathered here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcollide.session import table

JET_KEYS = ("l_linenumber", "l_partkey", "l_suppkey")


def jets(spark: SparkSession, sf: str) -> DataFrame:
    """One row per jet candidate; identity is (event_id,) + JET_KEYS."""
    base = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS event_id",
        *JET_KEYS,
        "CASE WHEN l_linenumber <= 5 THEN 'b' WHEN l_linenumber = 6 THEN 'c' ELSE 'l' END AS tag",
        "15 + 1.2D*l_quantity AS pt0",
        "(l_discount - 0.05D)*60D AS eta0",
        "2*pi()*((l_partkey*7919 + l_suppkey*104729) % 10007)/10007D AS phi0",
    )
    return base.selectExpr(
        "*",
        "pt0*cos(phi0) AS px",
        "pt0*sin(phi0) AS py",
        "pt0*(exp(eta0)-exp(-eta0))/2 AS pz",
        "pt0*(exp(eta0)+exp(-eta0))/2 AS e",
    )


def particles(spark: SparkSession, sf: str) -> DataFrame:
    """Jets with PDG-like ids, one row per particle."""
    return jets(spark, sf).selectExpr(
        "*",
        "CASE l_partkey % 8 WHEN 0 THEN 21 WHEN 1 THEN 11 WHEN 2 THEN -11 WHEN 3 THEN 22 WHEN 4 THEN 211 WHEN 5 THEN 12 "
        "ELSE IF(l_linenumber % 2 = 0, -5, 5) END AS pid",
    )


def events_w(spark: SparkSession, sf: str) -> DataFrame:
    """Event weight, class label and sample name."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("event_id"),
        F.col("c_mktsegment").alias("sample"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("label"),
        (F.col("o_totalprice") / F.lit(100000.0)).alias("evweight"),
    )


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Physics metadata per sample (one row per market segment)."""
    n = F.length("c_mktsegment") % 3
    return (
        table(spark, sf, "customer")
        .groupBy(F.col("c_mktsegment").alias("sample"))
        .agg(
            F.count("*").cast("double").alias("generated_events"),
            (F.lit(0.01) * (1 + F.min("c_custkey"))).alias("xsec_pb"),
        )
        .select(
            "sample",
            "generated_events",
            "xsec_pb",
            (8 - 2 * (F.length("sample") % 3)).cast("int").alias("b_quarks"),
            (F.length("sample") % 3).cast("int").alias("c_quarks"),
            (F.length("sample") % 3).cast("int").alias("light_jets"),
        )
    )


def points(spark: SparkSession, sf: str) -> DataFrame:
    """9 x 7 coupling grid with a measured value per point."""
    p = F.col("p_partkey") % 63
    return (
        table(spark, sf, "part")
        .groupBy(p.alias("point_id"))
        .agg((F.sum("p_retailprice") / F.lit(1000.0)).alias("value"), F.count("*").cast("int").alias("n"))
        .select(
            "point_id",
            ((F.col("point_id") % 9 - 4).cast("double") * F.lit(7.5)).alias("c3"),
            ((F.floor(F.col("point_id") / 9) - 3).cast("double") * F.lit(200.0)).alias("d4"),
            "value",
            "n",
        )
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Several generator runs per coupling point, one row per part."""
    c3 = ((F.col("p_partkey") % 63) % 9 - 4).cast("double") * F.lit(7.5)
    d4 = (F.floor((F.col("p_partkey") % 63) / 9) - 3).cast("double") * F.lit(200.0)
    return table(spark, sf, "part").select(
        "p_partkey",
        F.concat_ws("_", F.lit("run_gg_4h"), F.col("p_size").cast("string"), c3.cast("string"), d4.cast("string")).alias("name"),
        F.when(F.col("p_partkey") % 4 == 0, 5000).otherwise(10000).alias("generated_events"),
        (F.col("p_partkey") % 5 != 0).alias("has_lhe"),
        (F.col("p_retailprice") / 1000).alias("xsec_pb"),
    )


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Deterministic classifier score per row (logistic of fixed coefficients)."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("row_id"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("label"),
        F.col("user_id").alias("sample_id"),
        (F.lit(1.0) / (1 + F.exp(-(F.col("value") - 40) / F.lit(60.0)))).alias("score"),
        ((1 + F.col("user_id") % 7).cast("double") / 10).alias("weight"),
    )
