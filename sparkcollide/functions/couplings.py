"""Coupling-space functions: bases, polynomials, partial waves, normal tail."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values: (i, j) orders of the 15-term surface and the default ranges.
CHEB_TERMS = tuple([(i, 0) for i in range(7)] + [(i, 1) for i in range(5)] + [(i, 2) for i in range(3)])
K3_RANGE, K4_RANGE = (-29.0, 31.0), (-599.0, 601.0)

# Higgs mass and vacuum expectation value (GeV), perturbativity level.
M_H, VEV, PERT_LEVEL = 125.0, 246.0, 0.5
# Fixed value: centre-of-mass energies scanned, 200 to 4990 in steps of 10.
SQRT_S = range(200, 5000, 10)

# Monomials of the linear cross-section models, in coefficient order.
MODELS = {
    "cubic8": "1 c3^3 c3^2*d4 c3^2 d4^2 c3*d4 d4 c3",
    "c3d4": "1 c3^4 c3^3 c3^2*d4 c3^2 d4^2 c3*d4 d4 c3",
    "ct2ct3": "c3^2*d4 c3^2*ct2^2 c3^2*ct2 c3^2*ct3 c3^2 c3^4 c3^3*ct2 c3^3 c3*ct2*d4 c3*d4 c3*ct2*ct3 c3*ct2 c3*ct2^2 c3*ct3 c3 "
    "d4^2 ct2*d4 ct3*d4 d4 ct2^2 ct2*ct3 ct2 ct3^2 ct3 1",
    "full80": "c3^2*ct1*d4 c3^2*ct1^2*d4 c3^2*d4 c3^2*ct1^4 c3^2*ct1^2*ct2 c3^2*ct1^2 c3^2*ct1*ct2 c3^2*ct1*ct3 c3^2*ct1 c3^2*ct1^3 "
    "c3^2*ct2^2 c3^2*ct2 c3^2*ct3 c3^2 c3^4*ct1^2 c3^4*ct1 c3^4 c3^3*ct1*ct2 c3^3*ct1 c3^3*ct1^2 c3^3*ct1^3 c3^3*ct2 c3^3 "
    "c3*ct1*ct2*d4 c3*ct1*d4 c3*ct1^2*d4 c3*ct1^3*d4 c3*ct2*d4 c3*d4 c3*ct1*ct2 c3*ct1*ct2^2 c3*ct1*ct3 c3*ct1 c3*ct1^2*ct2 "
    "c3*ct1^2*ct3 c3*ct1^2 c3*ct1^3*ct2 c3*ct1^3 c3*ct1^4 c3*ct1^5 c3*ct2*ct3 c3*ct2 c3*ct2^2 c3*ct3 c3 ct1^2*d4^2 ct1*d4^2 d4^2 "
    "ct1*ct2*d4 ct1*ct3*d4 ct1*d4 ct1^2*ct2*d4 ct1^2*d4 ct1^3*d4 ct1^4*d4 ct2*d4 ct3*d4 d4 ct1^2*ct2^2 ct1^2*ct2 ct1^2*ct3 ct1^2 "
    "ct1^4*ct2 ct1^4 ct1^6 ct1^3*ct2 ct1^3*ct3 ct1^3 ct1*ct2*ct3 ct1*ct2 ct1*ct2^2 ct1*ct3 ct1 ct1^5 ct2^2 ct2*ct3 ct2 ct3^2 ct3 1",
}


def monomials(model: str) -> list[dict[str, int]]:
    """Exponents per term."""
    out = []
    for term in MODELS[model].split():
        powers = re.findall(r"(c3|d4|ct1|ct2|ct3)(?:\^(\d+))?", term)
        out.append({v: int(p or 1) for v, p in powers})
    return out


def ipow(x: Column, n: int) -> Column:
    """Integer power by multiplication (stays exact and codegen-friendly)."""
    out = F.lit(1.0)
    for _ in range(n):
        out = out * x
    return out


def basis(model: str, couplings: dict[str, Column]) -> list[Column]:
    rows = []
    for powers in monomials(model):
        value = F.lit(1.0)
        for v, p in powers.items():
            value = value * ipow(couplings.get(v, F.lit(0.0)), p)
        rows.append(value)
    return rows


def coupling_polynomial(model: str, couplings: dict[str, Column], coefficients: Column) -> Column:
    """SCL17: sum of coefficient x monomial."""
    total = F.lit(0.0)
    for k, m in enumerate(basis(model, couplings)):
        total = total + F.get(coefficients, F.lit(k)) * m
    return total


def chebyshev_t(order: int, x: Column) -> Column:
    closed = {
        0: lambda: F.lit(1.0), 1: lambda: x, 2: lambda: 2 * x * x - 1, 3: lambda: x * (4 * x * x - 3), 4: lambda: 8 * ipow(x, 4) - 8 * x * x + 1,
        5: lambda: x * (16 * ipow(x, 4) - 20 * x * x + 5), 6: lambda: 32 * ipow(x, 6) - 48 * ipow(x, 4) + 18 * x * x - 1,
    }
    if order in closed:
        return closed[order]()
    return 2 * x * chebyshev_t(order - 1, x) - chebyshev_t(order - 2, x)


def chebyshev_basis(c3: Column, d4: Column, terms=CHEB_TERMS, k3=K3_RANGE, k4=K4_RANGE) -> list[Column]:
    """SCL15: products of Chebyshev polynomials of the rescaled couplings."""
    scale = lambda v, r: (2 * (1 + v) - r[0] - r[1]) / F.lit(r[1] - r[0])
    x3, x4 = scale(c3, k3), scale(d4, k4)
    return [chebyshev_t(i, x3) * chebyshev_t(j, x4) for i, j in terms]


def evaluate_surface(c3: Column, d4: Column, coefficients: Column, terms=CHEB_TERMS, k3=K3_RANGE, k4=K4_RANGE) -> Column:
    total = F.lit(0.0)
    for k, b in enumerate(chebyshev_basis(c3, d4, terms, k3, k4)):
        total = total + F.get(coefficients, F.lit(k)) * b
    return total


def partial_wave(s: Column, c3: Column, d4: Column) -> Column:
    """SCL16: |a0|; zero where it is not finite (at or below threshold)."""
    mh2 = M_H**2
    k3sq, k4 = (1 + c3) * (1 + c3), 1 + d4
    above = s > 4 * mh2
    safe = F.when(above, s)
    pre = 3 * mh2 * F.sqrt(safe * safe - 4 * mh2 * safe) / (32 * F.pi() * safe * (safe - mh2) * VEV**2)
    loop = 6 * k3sq * mh2 * (safe - mh2) / (safe - 4 * mh2) * F.log(safe / mh2 - 3)
    return F.coalesce(F.abs(pre * (-k4 * (safe - mh2) - 3 * k3sq * mh2 + loop)), F.lit(0.0))


@F.pandas_udf(T.DoubleType())
def largest_wave(c3: pd.Series, d4: pd.Series) -> pd.Series:
    """Largest partial wave of SCL16 over SQRT_S, a block of cells by energies at a time."""
    mh2, s = M_H**2, np.array(SQRT_S, float) ** 2
    s = s[s > 4 * mh2]
    pre = 3 * mh2 * np.sqrt(s * s - 4 * mh2 * s) / (32 * np.pi * s * (s - mh2) * VEV**2)
    loop = 6 * mh2 * (s - mh2) / (s - 4 * mh2) * np.log(s / mh2 - 3) - 3 * mh2
    out = np.zeros(len(c3))
    for at in range(0, len(c3), 1024):
        k3, k4 = 1 + c3.to_numpy(float)[at : at + 1024, None], 1 + d4.to_numpy(float)[at : at + 1024, None]
        out[at : at + 1024] = np.abs(pre * (k3 * k3 * loop - k4 * (s - mh2))).max(1, initial=0.0)
    return pd.Series(out)


def gaussian(x: Column, mu: float, delta) -> Column:
    """SCL13: normal density."""
    d = delta if isinstance(delta, Column) else F.lit(float(delta))
    z = (x - mu) / d
    return F.exp(-z * z / 2) / (F.sqrt(2 * F.pi()) * d)


def central_probability(z: Column) -> Column:
    """SCL13: 1 - 2 Phi(-z) by its convergent odd series (Horner, unrolled)."""
    x = F.least(F.abs(z), F.lit(8.0))
    series = F.aggregate(F.sequence(F.lit(140), F.lit(1), F.lit(-1)), F.lit(1.0), lambda acc, k: 1 + acc * x * x / (2 * k + 1))
    p = 2 * F.exp(-x * x / 2) / F.sqrt(2 * F.pi()) * x * series
    return F.when(z < 0, -p).otherwise(p)


def significance(s: Column, b: Column, alpha: float = 0.0) -> Column:
    """SCL13: S / sqrt(B + alpha^2 B^2); null without background."""
    return F.when(b > 0, s / F.sqrt(b + F.lit(alpha * alpha) * b * b))
