"""Classifier training, scoring and evaluation."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkcollide.functions import noise
from sparkcollide.functions.couplings import significance
from sparkcollide.operators.ranking import distributed_row_number, running_sums
from sparkcollide.session import cut_lineage, lookup


def balance_class_weights(df: DataFrame, label: str = "label", weight: str = "weight") -> DataFrame:
    """WIN09: |w| (zero counts as one) scaled so each class sums to its count.

    Class totals are one partial aggregate looked up as a scalar map, not a
    window or join that would put half the data into one task.
    """
    base = F.when(F.col(weight) == 0, 1.0).otherwise(F.abs(F.col(weight)))
    df = df.withColumn("_base", base)
    sums = df.groupBy(label).agg(F.count("*").alias("_n"), F.sum("_base").alias("_s"))
    return lookup(df, label, sums, ["_n", "_s"]).withColumn("train_weight", F.col("_base") * F.col("_n") / F.col("_s")).drop("_base", "_n", "_s")


def stratified_split(df: DataFrame, key: str, test: float = 0.35, seed: int = 12345, label: str = "label") -> DataFrame:
    """ML01: exact per-class share, chosen by a keyed hash order.

    Ranks come from hash ranges, so a class of any size is split over tasks.
    """
    df = df.withColumn("_u", noise.uniform(seed, F.col(key)))
    ranked = distributed_row_number(df, [label], ["_u", key], "_rank")
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    out = lookup(ranked, label, sizes, ["_n"])
    return out.withColumn("is_test", F.col("_rank") <= F.round(F.lit(test) * F.col("_n"))).drop("_u", "_rank", "_n")


BINS = 32  # bins of a feature, as many as the trees would make
PARTS = 16
TASK_ROWS = 50_000  # binned rows a task of the training holds
CELLS = 1 << 16  # combinations of bins whose scores are tabulated


def feature_bins(df: DataFrame, features: list[str]) -> Bucketizer:
    """Bins of each feature: one a value where there are at most BINS values, else from quantiles of all rows."""
    values = [sorted(v for (v,) in df.select(f).where(F.col(f).isNotNull() & ~F.isnan(f)).distinct().limit(BINS + 1).collect()) for f in features]
    many = [f for f, v in zip(features, values) if len(v) > BINS]
    cuts = dict(zip(many, df.approxQuantile(many, [i / BINS for i in range(1, BINS)], 0.001))) if many else {}
    edges = []
    for f, v in zip(features, values):
        inner = cuts.get(f) or [(x + y) / 2 for x, y in zip(v, v[1:])] or v or [0.0]
        edges.append([float("-inf"), *sorted(set(inner)), float("inf")])
    return Bucketizer(splitsArray=edges, inputCols=features, outputCols=[f"{f}_bin" for f in features])


def binned_rows(df: DataFrame, bins: Bucketizer, key: str, seed: int) -> DataFrame:
    """Training rows of the same bins and label as at most PARTS rows, which hold their weights' sums.

    Trees see no more of a row than that. A row's part follows from its key, so
    a draw of rows takes or leaves sixteenths of a cell, and single rows where
    a cell has few. There are at most BINS ** features * labels * PARTS rows,
    whatever the number of rows before.
    """
    part = F.floor(noise.uniform(seed, F.col(key), draw=1) * PARTS).cast("int")
    cells = [*bins.getOutputCols(), "label", "part"]
    return bins.transform(df).withColumn("part", part).groupBy(*cells).agg(F.sum("train_weight").alias("train_weight"))


def train_classifier(df: DataFrame, features: list[str], key: str, rounds: int = 300, depth: int = 3, rate: float = 0.05, seed: int = 12345) -> PipelineModel:
    """ML02: boosted trees with logistic loss and balanced weights, grown on sums of weights by bin."""
    bins = feature_bins(df, features)
    rows = cut_lineage(binned_rows(df, bins, key, seed), "cells")
    rows = rows.repartition(max(4, rows.count() // TASK_ROWS))
    assembler = VectorAssembler(inputCols=bins.getOutputCols(), outputCol="features")
    gbt = GBTClassifier(
        labelCol="label", featuresCol="features", weightCol="train_weight", maxIter=rounds, maxDepth=depth, stepSize=rate, maxBins=BINS,
        subsamplingRate=0.9, featureSubsetStrategy="0.9", seed=seed,
    )
    return PipelineModel(stages=[bins, *Pipeline(stages=[assembler, gbt]).fit(rows).stages])


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """ML03: probability of the signal class per row.

    A score follows from the bins alone. Where all combinations of bins are
    CELLS or fewer, the trees are walked once for each and rows look theirs up.
    """
    bins, steps, cells = model.stages[0], [], 1
    for edges in bins.getSplitsArray():
        steps.append((cells, len(edges) - 1))
        cells *= len(edges) - 1
    p = F.get(vector_to_array("probability"), F.lit(1)).alias("score")
    if cells > CELLS:
        return model.transform(df).select(*df.columns, p)
    names = bins.getOutputCols()
    grid = df.sparkSession.range(cells).select("id", *[(F.floor(F.col("id") / step) % n).cast("double").alias(c) for c, (step, n) in zip(names, steps)])
    table = PipelineModel(stages=model.stages[1:]).transform(grid).select(F.col("id").alias("_cell"), p)
    cell = sum((F.col(c) * step for c, (step, _) in zip(names, steps)), F.lit(0)).cast("long")
    fail = F.raise_error(F.lit("a feature is null")).cast("long")
    return bins.transform(df).withColumn("_cell", F.coalesce(cell, fail)).join(F.broadcast(table), "_cell").select(*df.columns, "score")


def feature_importance(model: PipelineModel, features: list[str], n: int = 10) -> DataFrame:
    """ML06 / TOP03: largest importances; the vector has one entry per feature."""
    spark = SparkSession.active()
    values = [(f, float(v)) for f, v in zip(features, model.stages[-1].featureImportances.toArray())]
    return spark.createDataFrame(values, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(n)


def save_model(model: PipelineModel, path: str) -> None:
    """SNK11."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def train_multiclass(df: DataFrame, features: list[str], trees: int = 20, depth: int = 5, seed: int = 1) -> PipelineModel:
    """ML07: label 0 is signal, 1..K the backgrounds."""
    rf = RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="train_weight", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), rf]).fit(df)


# --- evaluation -------------------------------------------------------------------------
def running_efficiency(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """WIN03: ROC points over descending score, ties collapsed."""
    w = weight if weight is not None else F.lit(1.0)
    sides = df.select("score", F.when(F.col("label") == 1, w).otherwise(0.0).alias("_p"), F.when(F.col("label") != 1, w).otherwise(0.0).alias("_n"))
    run = running_sums(sides, "score", {"tp": "_p", "fp": "_n"}, descending=True)
    total = sides.agg(F.struct(F.sum("_p").alias("p"), F.sum("_n").alias("n")).alias("t"))
    run = run.withColumn("_t", total.scalar())
    return run.withColumns({"tpr": F.try_divide("tp", F.col("_t.p")), "fpr": F.try_divide("fp", F.col("_t.n"))})


def auc(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """WIN04: trapezoids; each point knows its own step, so no lag is needed."""
    roc = running_efficiency(df, weight)
    step = F.try_divide("fp_here", F.col("_t.n"))
    before = F.try_divide(F.col("tp") - F.col("tp_here"), F.col("_t.p"))
    return roc.agg(F.sum(step * (F.col("tpr") + before) / 2).alias("auc"))


THRESHOLDS = 501


def score_buckets(df: DataFrame, weight: str = "weight") -> DataFrame:
    """Totals of signal (s, n1) and background (b, n0) per bucket between two thresholds, at most THRESHOLDS + 2 rows.

    Bucket ``i`` holds scores from threshold i up to the next; -1 those below
    zero, null those without a score.
    """
    step = 1.0 / (THRESHOLDS - 1)
    b = F.floor(F.col("score") / step)
    b = F.when((b + 1) * step <= F.col("score"), b + 1).when(b * step > F.col("score"), b - 1).otherwise(b)
    b = F.greatest(F.lit(-1), F.least(F.lit(THRESHOLDS - 1), b)).cast("int")
    b = F.when(F.col("score").isNotNull(), F.when(F.col("score") >= 0, b).otherwise(-1))
    own = lambda label, v: F.sum(F.when(F.col("label") == label, v).otherwise(0.0))
    count = lambda label: F.count(F.when(F.col("label") == label, 1))
    return df.groupBy(b.alias("i")).agg(own(1, F.col(weight)).alias("s"), own(0, F.col(weight)).alias("b"), count(1).alias("n1"), count(0).alias("n0"), F.count("*").alias("n"))


def threshold_scan(df: DataFrame, systematics: float = 0.0, weight: str = "weight") -> DataFrame:
    """ML04: all 501 cuts from one aggregation into 501 buckets.

    A row counts for every threshold up to its bucket, so suffix sums over
    the 501 bucket totals give S and B at each cut.
    """
    return scan_buckets(df.sparkSession, score_buckets(df, weight), systematics)


def scan_buckets(spark: SparkSession, buckets: DataFrame, systematics: float) -> DataFrame:
    spine = spark.range(THRESHOLDS).select(F.col("id").cast("int").alias("i"))
    suffix = Window.orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    full = spine.join(buckets.where("i >= 0").select("i", "s", "b"), "i", "left").fillna(0.0, ["s", "b"])
    out = full.select("i", (F.col("i") * (1.0 / (THRESHOLDS - 1))).alias("threshold"), F.sum("s").over(suffix).alias("signal"), F.sum("b").over(suffix).alias("background"))
    return out.withColumn("significance", significance(F.col("signal"), F.col("background"), systematics))


def best_threshold(scan: DataFrame) -> DataFrame:
    """ML04: lowest threshold of the largest significance, else 0.5 and zeros."""
    at0 = scan.agg(F.max(F.when(F.col("i") == 0, F.struct("signal", "background"))).alias("t"))
    ok = F.col("significance") > 0
    best = scan.agg(F.max_by(F.struct("threshold", "signal", "background", "significance"), F.when(ok, F.struct("significance", -F.col("i")))).alias("m"))
    best = best.withColumn("_t", at0.scalar())
    z = lambda f: F.coalesce(F.col("m")[f], F.lit(0.0)).alias(f)
    eff = lambda f: F.when(F.col("_t")[f] > 0, F.coalesce(F.col("m")[f], F.lit(0.0)) / F.col("_t")[f]).otherwise(0.0)
    return best.select(
        F.coalesce(F.col("m.threshold"), F.lit(0.5)).alias("threshold"), z("signal"), z("background"), z("significance"),
        eff("signal").alias("signal_efficiency"), eff("background").alias("background_efficiency"),
    )


def confusion_matrix(df: DataFrame, classes: int, label: str = "label", pred: str = "pred") -> DataFrame:
    """AGG26: counts on a dense classes x classes spine."""
    counts = df.groupBy(F.col(label).cast("int").alias("label"), F.col(pred).cast("int").alias("pred")).agg(F.count("*").alias("n"))
    spine = df.sparkSession.range(classes * classes).select(
        F.floor(F.col("id") / classes).cast("int").alias("label"), (F.col("id") % classes).cast("int").alias("pred")
    )
    return spine.join(counts, ["label", "pred"], "left").fillna(0, ["n"])


def class_efficiencies(confusion: DataFrame) -> DataFrame:
    """AGG27: share assigned to the signal column, per true class."""
    hit = F.sum(F.when(F.col("pred") == 0, F.col("n")).otherwise(0))
    return confusion.groupBy("label").agg(F.sum("n").alias("total"), F.when(F.sum("n") > 0, hit / F.sum("n")).otherwise(0.0).alias("efficiency"))


def class_significance(eff: DataFrame, yields: DataFrame, luminosity: float) -> DataFrame:
    """AGG27: initial and final S, B, S/sqrt(B) and the two-sigma limits."""
    j = eff.join(yields, "label")
    sig, final = F.col("label") == 0, F.col("yield") * F.col("efficiency")
    out = j.agg(
        F.sum(F.when(sig, F.col("yield"))).alias("s_initial"), F.sum(F.when(~sig, F.col("yield"))).alias("b_initial"),
        F.sum(F.when(sig, final)).alias("s_final"), F.sum(F.when(~sig, final)).alias("b_final"),
    )
    return out.withColumns(
        {
            "significance_initial": significance(F.col("s_initial"), F.col("b_initial")), "significance_final": significance(F.col("s_final"), F.col("b_final")),
            "limit_events": 2 * F.sqrt("b_final"), "limit_fb": 2 * F.sqrt("b_final") / luminosity,
        }
    )


def accuracy(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """AGG28."""
    hit = (F.col("score") >= threshold).cast("int") == F.col("label")
    return df.agg((F.count(F.when(hit, 1)) / F.count("*")).alias("accuracy"))


def evaluate(df: DataFrame, systematics: float = 0.0) -> DataFrame:
    """ML05: one row of metrics.

    Two passes: bucket totals, from which cuts, counts, accuracy and class
    totals follow, and one set of running sums for both areas under the curve.
    """
    spark = df.sparkSession
    buckets = cut_lineage(score_buckets(df), "buckets")
    best = best_threshold(scan_buckets(spark, buckets, systematics))
    at = F.round(F.col("_b.threshold") * (THRESHOLDS - 1)).cast("int")
    half = (THRESHOLDS - 1) // 2
    passed = F.col("i") >= at
    n = lambda label, ok: F.coalesce(F.sum(F.when(ok, F.col(f"n{label}"))), F.lit(0))
    rows = buckets.withColumn("_b", best.select(F.struct("*")).scalar())
    counts = rows.agg(
        *[n(a, passed if b else ~passed).alias(f"n_{a}{b}") for a in (0, 1) for b in (0, 1)],
        F.sum("s").alias("preselected_signal"), F.sum("b").alias("preselected_background"),
        (n(1, F.col("i") >= half) + n(0, F.col("i") < half)).alias("_hit"), F.sum("n").alias("_n"), F.sum("n1").alias("_n1"), F.sum("n0").alias("_n0"), F.first("_b").alias("_b"),
    )
    signal, other = F.col("label") == 1, F.col("label") == 0
    sides = df.select("score", *[F.when(c, w).otherwise(0.0).alias(k) for k, c, w in (("p", signal, F.lit(1.0)), ("q", other, F.lit(1.0)), ("pw", signal, F.col("weight")), ("qw", other, F.col("weight")))])
    run = running_sums(sides, "score", {"tp": "p", "fp": "q", "tw": "pw", "fw": "qw"}, descending=True)
    area = lambda t, f: F.sum(F.col(f"{f}_here") * (2 * F.col(t) - F.col(f"{t}_here")) / 2)
    areas = run.agg(area("tp", "fp").alias("a"), area("tw", "fw").alias("w"))
    out = counts.withColumn("_a", areas.select(F.struct("*")).scalar())
    return out.select(
        *[f"n_{a}{b}" for a in (0, 1) for b in (0, 1)], "preselected_signal", "preselected_background", (F.col("_hit") / F.col("_n")).alias("accuracy"),
        F.try_divide(F.col("_a.a"), F.col("_n1") * F.col("_n0").cast("double")).alias("auc"), F.try_divide(F.col("_a.w"), F.col("preselected_signal") * F.col("preselected_background")).alias("auc_weighted"), "_b.*",
    )
