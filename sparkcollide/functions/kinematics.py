"""Four-vector algebra as column expressions (no UDFs).

A four-vector is anything with ``e, px, py, pz`` fields; ``Vec`` bundles the
four columns so that sums and observables read like the physics.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = F.pi


@dataclass(frozen=True)
class Vec:
    e: Column
    px: Column
    py: Column
    pz: Column

    @staticmethod
    def of(struct: Column) -> "Vec":
        return Vec(struct["e"], struct["px"], struct["py"], struct["pz"])

    @staticmethod
    def cols(prefix: str = "") -> "Vec":
        return Vec(*(F.col(prefix + c) for c in ("e", "px", "py", "pz")))

    def __add__(self, o: "Vec") -> "Vec":
        return Vec(self.e + o.e, self.px + o.px, self.py + o.py, self.pz + o.pz)

    def struct(self) -> Column:
        return F.struct(self.e.alias("e"), self.px.alias("px"), self.py.alias("py"), self.pz.alias("pz"))

    # -- one-vector observables -------------------------------------------------
    def pt2(self) -> Column:
        return self.px * self.px + self.py * self.py

    def pt(self) -> Column:
        return F.sqrt(self.pt2())

    def p(self) -> Column:
        return F.sqrt(self.pt2() + self.pz * self.pz)

    def m2(self) -> Column:
        return self.e * self.e - self.pt2() - self.pz * self.pz

    def mass_signed(self) -> Column:
        """Negative for space-like vectors (clustering-library convention)."""
        m2 = self.m2()
        return F.when(m2 < 0, -F.sqrt(-m2)).otherwise(F.sqrt(F.abs(m2)))

    def mass(self) -> Column:
        """Root of the absolute invariant (add-on convention)."""
        return F.sqrt(F.abs(self.m2()))

    def et(self) -> Column:
        return self.e * self.pt() / self.p()

    def eta(self) -> Column:
        return F.asinh(self.pz / self.pt())

    def rapidity(self) -> Column:
        return F.lit(0.5) * F.log((self.e + self.pz) / (self.e - self.pz))

    def phi(self) -> Column:
        return F.atan2(self.py, self.px)

    def mt(self) -> Column:
        """Transverse mass sqrt(|e^2 - pz^2|)."""
        return F.sqrt(F.abs(self.e * self.e - self.pz * self.pz))

    def cos_theta(self) -> Column:
        return self.pz / self.p()


def snap(x: Column) -> Column:
    """Round to nine decimals with plain double arithmetic.

    Orders and ties must not depend on the last bits of a square root; this
    stays inside generated code, unlike decimal rounding.
    """
    return F.floor(x * 1e9 + 0.5) / 1e9


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), x))


def dphi_wrapped(phi1: Column, phi2: Column) -> Column:
    d = phi2 - phi1
    return F.when(d > PI(), 2 * PI() - d).when(d < -PI(), 2 * PI() + d).otherwise(d)


def delta_r_rap(y1: Column, phi1: Column, y2: Column, phi2: Column) -> Column:
    """Event-analysis separation: rapidity difference and wrapped azimuth."""
    dy, dphi = y1 - y2, dphi_wrapped(phi1, phi2)
    return F.sqrt(dy * dy + dphi * dphi)


def dphi_acos(a: Vec, b: Vec) -> Column:
    return F.acos(clip((a.px * b.px + a.py * b.py) / (a.pt() * b.pt()), -1, 1))


def deta(a: Vec, b: Vec) -> Column:
    return F.abs(a.eta() - b.eta())


def delta_r_eta(a: Vec, b: Vec) -> Column:
    """Add-on separation: pseudorapidity difference and acos azimuth."""
    return F.sqrt(F.pow(a.eta() - b.eta(), 2) + F.pow(dphi_acos(a, b), 2))


def opening_angle(a: Vec, b: Vec) -> Column:
    dot = a.px * b.px + a.py * b.py + a.pz * b.pz
    return F.acos(clip(dot / (a.p() * b.p()), -1, 1))


def phi_star(a: Vec, b: Vec) -> Column:
    th = F.tanh((a.eta() - b.eta()) / 2)
    return F.tan((PI() - dphi_acos(a, b)) / 2) * F.sin(th)


def mt2_like(a: Vec, b: Vec) -> Column:
    arg = 2 * (a.pt() * b.pt() - a.px * b.px - a.py * b.py)
    return F.sqrt(F.greatest(arg, F.lit(0.0)))


def boost(v: Vec, ref: Vec) -> Vec:
    """``v`` in the rest frame of ``ref``; null for a light-like reference."""
    m = F.nullif(ref.mass(), F.lit(0.0))
    dot = v.px * ref.px + v.py * ref.py + v.pz * ref.pz
    e = (ref.e * v.e - dot) / m
    k = (v.e + e) / (ref.e + m)
    return Vec(e, v.px - k * ref.px, v.py - k * ref.py, v.pz - k * ref.pz)


def rotate_to_z(v: Vec, axis: Vec) -> Vec:
    """Rotate in the plane of ``axis`` and +z so that ``axis`` lies along +z."""
    p = axis.p()
    nx, ny, nz = axis.px / p, axis.py / p, axis.pz / p
    # Rodrigues rotation about n x z with cos = nz; the cross axis has no z part.
    dot = v.px * nx + v.py * ny
    along = F.when(1 + nz > 0, dot / (1 + nz)).otherwise(0.0)
    return Vec(v.e, v.px - nx * (v.pz + along), v.py - ny * (v.pz + along), nz * v.pz + dot)
