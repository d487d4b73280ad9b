"""Directions, frames and angles as Column expressions. Angles are in radians unless a name says otherwise; a null in an input
gives a null."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import COS_OBLIQUITY, SIN_OBLIQUITY


@dataclass(frozen=True)
class Vec:
    """Three Columns."""

    x: Column
    y: Column
    z: Column

    @classmethod
    def of(cls, prefix: str) -> Vec:
        return cls(F.col(f"{prefix}_x"), F.col(f"{prefix}_y"), F.col(f"{prefix}_z"))

    def dot(self, o: Vec) -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def norm(self) -> Column:
        return F.sqrt(self.dot(self))

    def scaled(self, k: Column) -> Vec:
        return Vec(self.x * k, self.y * k, self.z * k)

    def plus(self, o: Vec) -> Vec:
        return Vec(self.x + o.x, self.y + o.y, self.z + o.z)

    def named(self, prefix: str) -> list[Column]:
        return [self.x.alias(f"{prefix}_x"), self.y.alias(f"{prefix}_y"), self.z.alias(f"{prefix}_z")]


def unit_vector(lon: Column, lat: Column) -> Vec:
    return Vec(F.cos(lon) * F.cos(lat), F.sin(lon) * F.cos(lat), F.sin(lat))


def pointing(ra_deg: Column, dec_deg: Column) -> Vec:
    return unit_vector(F.radians(ra_deg), F.radians(dec_deg))


def to_ecliptic(v: Vec, cos_e: float = COS_OBLIQUITY, sin_e: float = SIN_OBLIQUITY) -> Vec:
    """Equatorial to ecliptic: a rotation about the x axis."""
    return Vec(v.x, cos_e * v.y + sin_e * v.z, cos_e * v.z - sin_e * v.y)


def to_equatorial(v: Vec, cos_e: float = COS_OBLIQUITY, sin_e: float = SIN_OBLIQUITY) -> Vec:
    return Vec(v.x, cos_e * v.y - sin_e * v.z, sin_e * v.y + cos_e * v.z)


def in_plane(v: Vec, plane: Column, wanted: str) -> Vec:
    """v in the wanted plane ('ECLIPJ2000' or 'J2000'); unchanged where it is in it already."""
    turned = to_ecliptic(v) if wanted == "ECLIPJ2000" else to_equatorial(v)
    here = plane == wanted
    return Vec(*[F.when(here, a).otherwise(b) for a, b in ((v.x, turned.x), (v.y, turned.y), (v.z, turned.z))])


def lonlat(v: Vec) -> tuple[Column, Column]:
    """Longitude in (-pi, pi] and latitude; the sine is clamped, since moved points are not exactly of unit length."""
    return F.atan2(v.y, v.x), F.asin(F.least(F.greatest(v.z, F.lit(-1.0)), F.lit(1.0)))


def radec(v: Vec) -> tuple[Column, Column]:
    """Right ascension in [0, 2 pi) and declination, for vectors of any length."""
    return wrap_2pi(F.atan2(v.y, v.x)), F.atan2(v.z, F.hypot(v.x, v.y))


def wrap_2pi(a: Column) -> Column:
    """Into [0, 2 pi)."""
    return F.pmod(a, F.lit(2 * math.pi))


def wrap_pi(a: Column) -> Column:
    """Into (-pi, pi]."""
    b = wrap_2pi(a)
    return F.when(b > math.pi, b - 2 * math.pi).otherwise(b)


def principal_0(a: Column) -> Column:
    """Into [-pi, pi)."""
    return a - 2 * math.pi * F.floor(a / (2 * math.pi) + 0.5)


def principal(a: Column) -> Column:
    """Into [0, 2 pi), by floor."""
    return a - 2 * math.pi * F.floor(a / (2 * math.pi))


def safe_acos(x: Column) -> Column:
    return F.acos(F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0)))


def chord2_to_angle(d2: Column) -> Column:
    """Angle between unit vectors from their squared distance."""
    return safe_acos(1.0 - d2 / 2.0)


def chord2_of(angle: float) -> float:
    return 4.0 * math.sin(angle / 2.0) ** 2


def ecliptic_lonlat(ra: Column, dec: Column, eps: float) -> tuple[Column, Column]:
    """Ecliptic longitude (not unwrapped) and latitude."""
    v = to_ecliptic(unit_vector(ra, dec), math.cos(eps), math.sin(eps))
    return F.atan2(v.y, v.x), F.asin(F.least(F.greatest(v.z, F.lit(-1.0)), F.lit(1.0)))


def equatorial_radec(lam: Column, beta: Column, eps: float) -> tuple[Column, Column]:
    """Right ascension in [0, 2 pi) and declination."""
    v = to_equatorial(unit_vector(lam, beta), math.cos(eps), math.sin(eps))
    return wrap_2pi(F.atan2(v.y, v.x)), F.asin(F.least(F.greatest(v.z, F.lit(-1.0)), F.lit(1.0)))


def local_axes(r: Vec) -> tuple[Vec, Vec, Vec]:
    """East, north and radial unit vectors at a direction (any length): rows of the projection matrix, columns of its
    inverse. At a pole east is the y axis."""
    n, xy = r.norm(), F.hypot(r.x, r.y)
    up = Vec(r.x / n, r.y / n, r.z / n)
    pole = xy == 0
    ex = F.when(pole, F.lit(0.0)).otherwise(-r.y / F.nullif(xy, F.lit(0.0)))
    ey = F.when(pole, F.lit(1.0)).otherwise(r.x / F.nullif(xy, F.lit(0.0)))
    east = Vec(ex, ey, F.lit(0.0))
    north = Vec(-up.z * ey, up.z * ex, up.x * ey - up.y * ex)
    return east, north, up


def project(v: Vec, axes: tuple[Vec, Vec, Vec]) -> Vec:
    """v in local coordinates (east, north, radial)."""
    return Vec(*[a.dot(v) for a in axes])


def unproject(v: Vec, axes: tuple[Vec, Vec, Vec]) -> Vec:
    e, n, u = axes
    return Vec(e.x * v.x + n.x * v.y + u.x * v.z, e.y * v.x + n.y * v.y + u.y * v.z, e.z * v.x + n.z * v.y + u.z * v.z)


def proper_motion(ra_rate: Column, dec_rate: Column, dec: Column) -> Column:
    """Total rate on the sky; null where a rate is."""
    return F.sqrt(ra_rate * ra_rate * F.pow(F.cos(dec), 2) + dec_rate * dec_rate)


def night(dt: Column) -> Column:
    """Whole days from the reference epoch, halves away from zero."""
    return (F.floor(F.abs(dt) + 0.5) * F.signum(dt)).cast("int")


def chebyshev(c: Column, x: Column) -> Column:
    """Value of a degree-3 Chebyshev series held in an array of four."""
    c0, c1, c2, c3 = (F.get(c, F.lit(i)) for i in range(4))
    return c0 + c1 * x + c2 * (2.0 * x * x - 1.0) + c3 * (4.0 * x * x * x - 3.0 * x)
