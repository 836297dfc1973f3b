"""Unique labels against the plain loop over the input."""

import random

import pytest
from pyspark.sql import functions as F

from sparkcollide.operators import ranking
from sparkcollide.operators.lhe import unique_labels


def plain(names):
    used, out = set(), []
    for n in names:
        label, k = n, 2
        while label in used:
            label, k = f"{n}_{k}", k + 1
        used.add(label)
        out.append(label)
    return out


def labels(spark, names):
    df = spark.createDataFrame(list(enumerate(names)), "ord long, base string")
    return [r["label"] for r in unique_labels(df).orderBy("ord").collect()]


@pytest.mark.parametrize("seed", range(4))
def test_random_families(spark, seed):
    r = random.Random(seed)
    pool = ["a", "a_2", "a_3", "a_4", "a_5", "a_2_2", "a_2_3", "a_02", "a_1", "a_2_2_2", "b", "b_", "_2", "", "c_7"]
    weights = [r.random() ** 2 + 0.02 for _ in pool]
    names = r.choices(pool, weights, k=r.choice([8, 40, 150]))
    assert labels(spark, names) == plain(names)


def test_family_with_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(ranking, "WHOLE", 500)  # the family is ranked by ranges
    r = random.Random(7)
    names = ["hot"] * 3000 + [f"hot_{r.randrange(2, 4000)}" for _ in range(300)] + [f"x{r.randrange(4000)}" for _ in range(5700)]
    r.shuffle(names)
    assert labels(spark, names) == plain(names)


def test_no_group_is_gathered_and_nulls_have_no_label(spark):
    df = spark.createDataFrame([(0, None), (1, "a"), (2, None), (3, "a")], "ord long, base string")
    out = unique_labels(df.withColumn("extra", F.lit(1)))
    assert out.columns == ["ord", "base", "extra", "label"]
    assert [r["label"] for r in out.orderBy("ord").collect()] == [None, "a", None, "a_2"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapGroups" not in plan and "collect_list" not in plan
