"""Geometry as Column expressions: all of it stays inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

S3 = math.sqrt(3.0)
# GRS80 and the transverse Mercator parameters of EPSG:3765 (public registry).
GRS80_A, GRS80_F = 6378137.0, 1 / 298.257222101
LON0, SCALE, FALSE_EAST = 16.5, 0.9999, 500000.0
# Centre and metres per degree of the local projection.
LOCAL_LAT, LOCAL_LON, M_PER_LON, M_PER_LAT = 45.8150, 15.9819, 111320.0, 111132.9

_N = GRS80_F / (2 - GRS80_F)
_RADIUS = GRS80_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
#: Krueger series to the fourth order in n, forward and inverse.
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_ECC = math.sqrt(GRS80_F * (2 - GRS80_F))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def project_tm(lon, lat) -> tuple[Column, Column]:
    """WGS84 degrees to (x, y) metres in EPSG:3765."""
    phi, lam = F.radians(_c(lat)), F.radians(_c(lon)) - F.radians(F.lit(LON0))
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(_ECC) * F.atanh(F.lit(_ECC) * F.sin(phi)))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(F.lit(1.0) + t * t))
    x, y = eta, xi
    for k, a in enumerate(_ALPHA, 1):
        x = x + F.lit(a) * F.cos(xi * (2.0 * k)) * F.sinh(eta * (2.0 * k))
        y = y + F.lit(a) * F.sin(xi * (2.0 * k)) * F.cosh(eta * (2.0 * k))
    return F.lit(FALSE_EAST) + F.lit(SCALE * _RADIUS) * x, F.lit(SCALE * _RADIUS) * y


def unproject_tm(x, y) -> tuple[Column, Column]:
    """(x, y) in EPSG:3765 to (lon, lat) in WGS84 degrees."""
    xi0, eta0 = _c(y) / F.lit(SCALE * _RADIUS), (_c(x) - F.lit(FALSE_EAST)) / F.lit(SCALE * _RADIUS)
    xi, eta = xi0, eta0
    for k, b in enumerate(_BETA, 1):
        xi = xi - F.lit(b) * F.sin(xi0 * (2.0 * k)) * F.cosh(eta0 * (2.0 * k))
        eta = eta - F.lit(b) * F.cos(xi0 * (2.0 * k)) * F.sinh(eta0 * (2.0 * k))
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lon = F.lit(LON0) + F.degrees(F.atan2(F.sinh(eta), F.cos(xi)))
    phi = chi
    for _ in range(5):  # fixed point of the conformal latitude
        phi = F.asin(F.tanh(F.atanh(F.sin(chi)) + F.lit(_ECC) * F.atanh(F.lit(_ECC) * F.sin(phi))))
    return lon, F.degrees(phi)


def local_xy(lon, lat) -> tuple[Column, Column]:
    """Equirectangular metres around the local centre."""
    return (
        (_c(lon) - F.lit(LOCAL_LON)) * F.lit(M_PER_LON * math.cos(math.radians(LOCAL_LAT))),
        (_c(lat) - F.lit(LOCAL_LAT)) * F.lit(M_PER_LAT),
    )


def hex_axial(x, y, side: float) -> tuple[Column, Column]:
    """Axial (q, r) of the pointy-top cell a point lies in, by cube rounding, half to even."""
    cx = (F.lit(S3 / 3) * _c(x) - _c(y) / F.lit(3.0)) / F.lit(float(side))
    cz = (F.lit(2.0 / 3.0) * _c(y)) / F.lit(float(side))
    cy = -cx - cz
    rx, ry, rz = F.rint(cx), F.rint(cy), F.rint(cz)
    dx, dy, dz = F.abs(rx - cx), F.abs(ry - cy), F.abs(rz - cz)
    fix_x = (dx > dy) & (dx > dz)
    q = F.when(fix_x, -ry - rz).otherwise(rx)
    r = F.when(~fix_x & (dy <= dz), -rx - ry).otherwise(rz)
    return q.cast("int"), r.cast("int")


def hex_center(q, r, side: float) -> tuple[Column, Column]:
    s = float(side)
    return F.lit(s) * F.lit(S3) * (_c(q) + _c(r) / F.lit(2.0)), F.lit(s * 1.5) * _c(r)


def hex_places(q, r, side: float) -> tuple:
    """:func:`hex_center` of arrays, equal to the last bit."""
    return side * S3 * (q + r / 2.0), side * 1.5 * r


def bu_key(q, r) -> Column:
    return F.concat_ws("_", _c(q).cast("string"), _c(r).cast("string"))


def bu_parse(bu) -> tuple[Column, Column]:
    part = F.split(_c(bu), "_")
    return part[0].cast("int"), part[1].cast("int")


def hex_snap(x, y, side: float = 1000.0) -> tuple[Column, Column]:
    """Centre of the cell that a point lies in."""
    return hex_center(*hex_axial(x, y, side), side)


def hex_norm(x, y, cx, cy) -> Column:
    """Side of the smallest hexagon around (cx, cy) that holds the point."""
    dx, dy = _c(x) - _c(cx), _c(y) - _c(cy)
    far = F.greatest(F.abs(dx), F.abs(dx * 0.5 + dy * (S3 / 2)), F.abs(dx * -0.5 + dy * (S3 / 2)))
    return far / F.lit(S3 / 2)


def inside_hex(x, y, cx, cy, side) -> Column:
    return hex_norm(x, y, cx, cy) <= _c(side) + F.lit(1e-9)


def distance(x1, y1, x2, y2) -> Column:
    return F.hypot(_c(x1) - _c(x2), _c(y1) - _c(y2))


def roster(mean_volume, target: float | Column) -> Column:
    """Districts for a mean volume: half-even rounding, at least two."""
    return F.greatest(F.lit(2), F.rint(_c(mean_volume) / (target if isinstance(target, Column) else F.lit(float(target)))).cast("int"))
