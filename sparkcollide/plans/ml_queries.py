"""Classifier queries. Evaluation uses a deterministic score so SQL can check it."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkcollide.operators import ml
from sparkcollide.plans import sqltext as S
from sparkcollide.plans.registry import query
from sparkcollide.session import cut_lineage, scratch_dir, table
from sparkcollide.sinks import tables as sinks
from sparkcollide.sources import fixtures

R = S.rnd
SC = f"WITH {S.SCORES}"
FEATURES = ["value", "hour", "bucket"]


def r(c, n=6):
    return F.round(c, n)


def train_rows(spark, sf):
    """Features whose relation to the label is real: value drives purchase here."""
    e = table(spark, sf, "events").select("event_id", "event_type", "user_id", "value", F.hour("ts").cast("double").alias("hour"))
    rows = e.select(
        "event_id", "value", "hour", (F.col("user_id") % 11).cast("double").alias("bucket"), "event_type",
        F.when(F.col("value") + 3 * (F.col("user_id") % 11) > 60, 1).otherwise(0).alias("label"), ((1 + F.col("user_id") % 7).cast("double") / 10).alias("weight"),
    )
    return ml.balance_class_weights(rows)


_models: dict = {}


def model(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _models:
        rows = ml.stratified_split(train_rows(spark, sf), "event_id")
        _models[key] = ml.train_classifier(cut_lineage(rows.filter("NOT is_test"), "training"), FEATURES, "event_id")
    return _models[key]


@query("WIN09_balance_class_weights", f"{SC} SELECT row_id, {R('weight*count(*) OVER (PARTITION BY label)/sum(weight) OVER (PARTITION BY label)')} AS train_weight FROM scores")
def win09(spark, sf):
    return ml.balance_class_weights(fixtures.scores(spark, sf)).select("row_id", r("train_weight").alias("train_weight"))


@query("ML01_stratified_split", f"{SC}, u AS (SELECT row_id AS event_id, label FROM scores), k AS (SELECT event_id, label, row_number() OVER (PARTITION BY label ORDER BY {S.uniform(12345)}, event_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM u) SELECT event_id AS row_id, label, k <= round(CAST(0.35 AS DOUBLE)*n) AS is_test FROM k")
def ml01(spark, sf):
    return ml.stratified_split(fixtures.scores(spark, sf), "row_id").select("row_id", "label", "is_test")


ROC = f"""{SC}, d AS (SELECT score, sum(CASE WHEN label=1 THEN weight ELSE 0 END) AS p, sum(CASE WHEN label=0 THEN weight ELSE 0 END) AS n FROM scores GROUP BY score),
 c AS (SELECT score, p, n, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS tot_p, sum(n) OVER () AS tot_n FROM d)"""


@query("WIN03_running_efficiency", f"{ROC} SELECT {R('score', 9)} AS score, {R('tp/tot_p')} AS tpr, {R('fp/tot_n')} AS fpr FROM c")
def win03(spark, sf):
    return ml.running_efficiency(fixtures.scores(spark, sf), F.col("weight")).select(r("score", 9).alias("score"), r("tpr").alias("tpr"), r("fpr").alias("fpr"))


def auc_sql(w: str) -> str:
    return f"""{SC}, d AS (SELECT score, sum(CASE WHEN label=1 THEN {w} ELSE 0 END) AS p, sum(CASE WHEN label=0 THEN {w} ELSE 0 END) AS n FROM scores GROUP BY score),
 c AS (SELECT score, p, n, sum(p) OVER (ORDER BY score DESC) AS tp, sum(p) OVER () AS tot_p, sum(n) OVER () AS tot_n FROM d) SELECT {R('sum(n/tot_n*(tp/tot_p+(tp-p)/tot_p)/2)')} AS auc FROM c"""


@query("WIN04_auc", auc_sql("CAST(1 AS DOUBLE)"))
def win04(spark, sf):
    return ml.auc(fixtures.scores(spark, sf)).select(r("auc").alias("auc"))


@query("WIN04_auc_weighted", auc_sql("weight"))
def win04w(spark, sf):
    return ml.auc(fixtures.scores(spark, sf), F.col("weight")).select(r("auc").alias("auc"))


SCAN = f"""{SC}, t AS (SELECT i, i*CAST(0.002 AS DOUBLE) AS threshold FROM range(501) x(i)),
 sc AS (SELECT i, threshold, coalesce(sum(CASE WHEN label=1 THEN weight END),0) AS s, coalesce(sum(CASE WHEN label=0 THEN weight END),0) AS b FROM t LEFT JOIN scores ON score >= threshold GROUP BY i, threshold),
 sg AS (SELECT *, CASE WHEN b>0 THEN round(s/sqrt(b+CAST(0.01 AS DOUBLE)*b*b),10) END AS z FROM sc)"""


@query("ML04_threshold_scan", f"{SCAN} SELECT i, {R('threshold')} AS threshold, {R('s')} AS signal, {R('b')} AS background, {R('z')} AS significance FROM sg")
def ml04(spark, sf):
    s = ml.threshold_scan(fixtures.scores(spark, sf), 0.1)
    return s.select(F.col("i").cast("long").alias("i"), *[r(c).alias(c) for c in ("threshold", "signal", "background", "significance")])


@query("ML04_best_threshold", f"{SCAN} SELECT {R('threshold')} AS threshold, {R('s')} AS signal, {R('b')} AS background, {R('z')} AS significance, {R('s/(SELECT sum(weight) FROM scores WHERE label=1)')} AS signal_efficiency, {R('b/(SELECT sum(weight) FROM scores WHERE label=0)')} AS background_efficiency FROM (SELECT *, row_number() OVER (ORDER BY z DESC NULLS LAST, i) AS k FROM sg) WHERE k=1")
def ml04b(spark, sf):
    scan = ml.threshold_scan(fixtures.scores(spark, sf), 0.1).withColumn("significance", F.round("significance", 10))
    return ml.best_threshold(scan).select(*[r(c).alias(c) for c in ("threshold", "signal", "background", "significance", "signal_efficiency", "background_efficiency")])


@query(
    "ML05_evaluate",
    f"""{SCAN}, bt AS (SELECT threshold AS cut FROM (SELECT *, row_number() OVER (ORDER BY z DESC NULLS LAST, i) AS k FROM sg) WHERE k=1)
 SELECT count(CASE WHEN label=0 AND score<cut THEN 1 END) AS n_00, count(CASE WHEN label=0 AND score>=cut THEN 1 END) AS n_01, count(CASE WHEN label=1 AND score<cut THEN 1 END) AS n_10, count(CASE WHEN label=1 AND score>=cut THEN 1 END) AS n_11,
 {R('avg(CASE WHEN (score>=0.5)=(label=1) THEN 1.0 ELSE 0.0 END)')} AS accuracy, {R('any_value(cut)')} AS threshold, {R('sum(CASE WHEN label=1 THEN weight END)')} AS preselected_signal, {R(f"({auc_sql('weight').replace(SC + ',', 'WITH').replace('SELECT ' + R('sum', 6), 'SELECT sum')})")} AS auc_weighted FROM scores, bt""",
)
def ml05(spark, sf):
    m = ml.evaluate(fixtures.scores(spark, sf), 0.1)
    return m.select("n_00", "n_01", "n_10", "n_11", *[r(c).alias(c) for c in ("accuracy", "threshold", "preselected_signal", "auc_weighted")])


@query("AGG26_confusion_matrix", f"{SC}, s AS (SELECT CAST(a AS INT) AS label, CAST(b AS INT) AS pred FROM range(2) x(a), range(2) y(b)), c AS (SELECT label, CASE WHEN score>=0.5 THEN 1 ELSE 0 END AS pred, count(*) AS n FROM scores GROUP BY ALL) SELECT s.label, s.pred, coalesce(n,0) AS n FROM s LEFT JOIN c ON s.label=c.label AND s.pred=c.pred")
def agg26(spark, sf):
    return ml.confusion_matrix(fixtures.scores(spark, sf).withColumn("pred", (F.col("score") >= 0.5).cast("int")), 2)


MC = """WITH mc AS (SELECT CAST(user_id % 4 AS INT) AS label, CAST((user_id + CASE WHEN value > 40 THEN 1 ELSE 0 END) % 4 AS INT) AS pred, value FROM events),
 cm AS (SELECT a AS label, b AS pred, count(label) AS n FROM (SELECT CAST(x.i AS INT) AS a, CAST(y.j AS INT) AS b FROM range(4) x(i), range(4) y(j)) LEFT JOIN mc ON label=a AND pred=b GROUP BY a, b)"""


def multiclass(spark, sf):
    e = table(spark, sf, "events").select("user_id", "value")
    return e.select((F.col("user_id") % 4).cast("int").alias("label"), ((F.col("user_id") + F.when(F.col("value") > 40, 1).otherwise(0)) % 4).cast("int").alias("pred"), "value")


@query("AGG26_confusion_matrix_multiclass", f"{MC} SELECT label, pred, n FROM cm")
def agg26m(spark, sf):
    return ml.confusion_matrix(multiclass(spark, sf), 4)


@query(
    "AGG27_class_efficiencies",
    f"""{MC}, ef AS (SELECT label, sum(n) AS t, sum(CASE WHEN pred=0 THEN n ELSE 0 END)/CAST(sum(n) AS DOUBLE) AS e FROM cm GROUP BY label), y AS (SELECT label, sum(value)/100 AS y FROM mc GROUP BY label),
 a AS (SELECT sum(CASE WHEN ef.label=0 THEN y END) AS si, sum(CASE WHEN ef.label<>0 THEN y END) AS bi, sum(CASE WHEN ef.label=0 THEN y*e END) AS sf, sum(CASE WHEN ef.label<>0 THEN y*e END) AS bf FROM ef JOIN y ON ef.label=y.label)
 SELECT {R('si/sqrt(bi)')} AS significance_initial, {R('sf/sqrt(bf)')} AS significance_final, {R('2*sqrt(bf)')} AS limit_events, {R('2*sqrt(bf)/3000', 9)} AS limit_fb FROM a""",
)
def agg27(spark, sf):
    rows = multiclass(spark, sf)
    eff = ml.class_efficiencies(ml.confusion_matrix(rows, 4))
    out = ml.class_significance(eff, rows.groupBy("label").agg((F.sum("value") / 100).alias("yield")), 3000.0)
    return out.select(*[r(c).alias(c) for c in ("significance_initial", "significance_final", "limit_events")], r("limit_fb", 9).alias("limit_fb"))


@query("AGG28_accuracy", f"{SC} SELECT {R('count(CASE WHEN (score>=0.5)=(label=1) THEN 1 END)/CAST(count(*) AS DOUBLE)')} AS accuracy FROM scores")
def agg28(spark, sf):
    return ml.accuracy(fixtures.scores(spark, sf)).select(r("accuracy").alias("accuracy"))


# --- trained models: rows-only checks ------------------------------------------------------------
@query("ML02_train_classifier")
def ml02(spark, sf):
    rows = ml.stratified_split(train_rows(spark, sf), "event_id").filter("is_test")
    return ml.auc(ml.score(model(spark, sf), rows)).select((F.col("auc") > 0.9).alias("auc_in_band"))


@query("ML03_score")
def ml03(spark, sf):
    return ml.score(model(spark, sf), train_rows(spark, sf)).select("event_id", "label", "score")


@query("ML06_feature_importance")
def ml06(spark, sf):
    return ml.feature_importance(model(spark, sf), FEATURES, 20)


@query("TOP03_top_features")
def top03(spark, sf):
    return ml.feature_importance(model(spark, sf), FEATURES, 2)


@query("SNK06_write_metrics")
def snk06(spark, sf):
    path = scratch_dir(spark, "metrics")
    sinks.write_metrics(ml.evaluate(ml.score(model(spark, sf), train_rows(spark, sf))), path)
    return spark.read.json(path)


@query("SNK11_save_load_model")
def snk11(spark, sf):
    path = scratch_dir(spark, "model")
    ml.save_model(model(spark, sf), path)
    rows = train_rows(spark, sf)
    a = ml.score(model(spark, sf), rows).select("event_id", F.col("score").alias("before"))
    b = ml.score(ml.load_model(path), rows).select("event_id", F.col("score").alias("after"))
    return a.join(b, "event_id").groupBy((F.col("before") == F.col("after")).alias("same")).agg(F.count("*").alias("n"))


@query("ML07_multiclass")
def ml07(spark, sf):
    rows = train_rows(spark, sf).withColumn("label", F.when(F.col("value") > 60, 0).when(F.col("bucket") > 5, 1).otherwise(2))
    rows = ml.balance_class_weights(rows.drop("train_weight"))
    split = ml.stratified_split(rows, "event_id", test=0.5)
    fitted = ml.train_multiclass(split.filter("NOT is_test"), FEATURES)
    pred = fitted.transform(split.filter("is_test")).withColumn("pred", F.col("prediction").cast("int"))
    return ml.class_efficiencies(ml.confusion_matrix(pred, 3))
