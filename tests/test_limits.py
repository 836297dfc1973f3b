"""Poisson probabilities and limits by the incomplete gamma function."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkcollide.functions import poisson
from sparkcollide.operators import inference


def plain_log_cdf(n, mean):
    logs = [-mean + k * math.log(mean) - math.lgamma(k + 1) for k in range(n + 1)]
    top = max(logs)
    return top + math.log(math.fsum(math.exp(x - top) for x in logs))


def test_log_cdf_against_the_sum():
    for n in (0, 1, 2, 5, 15, 16, 17, 50, 300):
        for mean in (1e-6, 0.1, 1.0, 2.0, n + 0.5, n + 1.0, n + 1.5, 2.0 * n + 3, 700.0):
            assert poisson.log_cdf(np.array([n]), np.array([mean]))[0] == pytest.approx(plain_log_cdf(n, mean), rel=1e-12, abs=1e-14)
    got = poisson.log_cdf(np.array([-1, 0, 3, 2]), np.array([2.0, 0.0, np.nan, -1.0]))
    assert got[0] == -math.inf and got[1] == 0 and np.isnan(got[2:]).all()


def test_tail_far_below_the_smallest_double():
    assert poisson.log_cdf(np.array([3]), np.array([5000.0]))[0] == pytest.approx(plain_log_cdf(3, 5000.0), rel=1e-13)


def test_golden_limits_and_ten_million_counts():
    b, n = np.array([0.0, 5.05, 22.155]), np.array([0, 5, 22])
    assert poisson.signal_limit(b, n, 0.05, True) == pytest.approx([2.995732, 6.301307, 10.934995], abs=1e-6)
    big = poisson.signal_limit(np.array([1e7]), np.array([1e7]), 0.05, True)
    assert 1.9 < big[0] / math.sqrt(1e7) < 2.0  # the normal limit: 1.96 deviations
    ratio = poisson.log_cdf(np.array([1e7]), 1e7 + big) - poisson.log_cdf(np.array([1e7]), np.array([1e7]))
    assert math.exp(ratio[0]) == pytest.approx(0.05, rel=1e-9)


def test_limits_solve_their_equation():
    r = np.random.default_rng(1)
    b, n = r.uniform(0, 200, 5000), np.floor(r.uniform(0, 250, 5000))
    ok = poisson.log_cdf(n, b) > -700
    b, n = b[ok], n[ok]
    for cl in (0.5, 0.9, 0.95, 0.999):
        for relative in (True, False):
            s = poisson.signal_limit(b, n, 1 - cl, relative)
            tail = poisson.log_cdf(n, b + s) - (poisson.log_cdf(n, b) if relative else 0)
            assert np.allclose(np.exp(tail[s > 0]), 1 - cl, rtol=1e-9)
            assert (np.exp(tail[s == 0]) <= 1 - cl + 1e-12).all()


def test_columns_with_nulls_and_errors(spark):
    df = spark.createDataFrame([(1, 5.05, 5), (2, None, 5), (3, 5.05, None)], "k int, b double, n int")
    got = {r["k"]: r["s"] for r in df.select("k", inference.upper_limit()("b", "n").alias("s")).collect()}
    assert got[1] == pytest.approx(6.301307, abs=1e-6) and all(got[k] is None or math.isnan(got[k]) for k in (2, 3))
    assert df.select(inference.poisson_cdf(F.lit(10_000_000), F.lit(1e7))).first()[0] == pytest.approx(0.50008, abs=1e-4)
    for bad, message in (((0.0, 3_000_000_000), "no limit up to"), ((1e4, 0), "probability zero"), ((-1.0, 1), "below zero")):
        row = spark.createDataFrame([bad], "b double, n long")
        with pytest.raises(Exception, match=message):
            row.select(inference.upper_limit()("b", "n")).collect()
    with pytest.raises(ValueError, match="unknown limit method"):
        inference.upper_limit("other")
    with pytest.raises(ValueError, match="confidence level"):
        inference.upper_limit("cls", 1.0)


def test_one_degree_chi_square_of_a_log_probability(spark):
    from sparkcollide.operators import grid

    df = spark.createDataFrame([(math.log(0.05),), (math.log(0.31731),), (math.log(2.0),), (-800.0,), (-600.5,), (-599.5,)], "x double")
    got = [r[0] for r in df.select(grid._one_degree("x")).collect()]
    assert got[0] == pytest.approx(3.841459, abs=1e-6) and got[1] == pytest.approx(1.0, abs=1e-4) and (got[2] is None or math.isnan(got[2]))
    tail = lambda z2: math.log(2) - z2 / 2 - 0.5 * math.log(2 * math.pi * z2) + math.log1p(-1 / z2 + 3 / z2**2)
    assert tail(got[3]) == pytest.approx(-800, abs=1e-6) and 0 < got[4] - got[5] < 2.1


def test_marginals_against_the_whole_grid(spark):
    from sparkcollide.functions import couplings as cf
    from sparkcollide.operators import grid

    n, r = 7, np.random.default_rng(5)
    c = r.normal(0, 1, 25)
    surfaces = spark.createDataFrame([("s", c.tolist())], "surface string, coefficients array<double>")
    two = grid.marginalise_4d(surfaces, ["surface"], "ct2ct3", {"ct3": (-1.0, 1.0), "d4": (-2.0, 2.0)}, {"c3": 0.2, "ct2": 0.1}, 2.0, 3.0, n)
    x = {"ct3": np.linspace(-1, 1, n), "d4": np.linspace(-2, 2, n), "c3": np.linspace(-2, 2, n), "ct2": np.linspace(-1, 1, n)}
    mesh = dict(zip(x, np.meshgrid(*x.values(), indexing="ij"), strict=True))
    s = 0
    for k, m in zip(c, cf.monomials("ct2ct3"), strict=True):
        term = np.full((n,) * 4, k)
        for v, p in m.items():
            term = term * mesh[v] ** p
        s = s + term
    gauss = lambda d, w: np.exp(-0.5 * (d / w) ** 2) / (math.sqrt(2 * math.pi) * w)
    unit = cf.monomials("ct2ct3").index({})
    p = gauss(2.0 * (c[unit] - s), 3.0) * gauss(mesh["c3"], 0.2) * gauss(mesh["ct2"], 0.1)
    p2 = p.sum((2, 3)) * (4.0 / n) * (2.0 / n)
    got = {(r["i_x1"], r["i_x2"]): r["p"] for r in two.collect()}
    assert all(got[i, j] == pytest.approx(p2[i, j], rel=1e-9) for i in range(n) for j in range(n))
    d4 = {r["i"]: math.exp(r["log_p"]) for r in grid.marginal_1d(two, ["surface"], "x2", (-1.0, 1.0), n).collect()}
    assert all(d4[j] == pytest.approx(p2[:, j].sum() * 2.0 / n, rel=1e-9) for j in range(n))
