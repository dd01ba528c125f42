"""Column expressions of localization microscopy; coordinates in camera pixels, z in nm."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b as floating point has it: infinite or NaN where b is 0, which Spark's own division refuses."""
    return F.when(b == 0, a * F.lit(math.inf)).otherwise(a / b)


def localization_precision(photons: Column, s: Column, s_orth: Column, bg: Column, em: bool = False) -> Column:
    """Cramer-Rao bound of a least-squares position; doubled variance for an electron-multiplying camera."""
    sa2, sb2 = s * s + F.lit(1 / 12), s_orth * s_orth + F.lit(1 / 12)
    v = ratio(sa2 * (F.lit(16 / 9) + ratio(F.lit(8 * math.pi) * F.sqrt(sa2 * sb2) * bg, photons)), photons)
    return F.sqrt(v * F.lit(2.0 if em else 1.0))


def sigma_uncertainty(sigma: Column, sigma_orth: Column, photons: Column, bg: Column) -> Column:
    """Standard error of a fitted spot width."""
    sa2, sb2 = sigma * sigma + F.lit(1 / 12), sigma_orth * sigma_orth + F.lit(1 / 12)
    v = ratio(sa2 * sa2, photons) * (F.lit(512 / 81) + ratio(F.lit(64 * math.pi / 3) * F.sqrt(sa2 * sb2) * bg, photons))
    return F.sqrt(ratio(v, F.lit(4.0) * sigma * sigma))


def polynomial(coefficients: list[float], x: Column) -> Column:
    """Horner form, highest power first."""
    return reduce(lambda acc, c: acc * x + F.lit(float(c)), coefficients[1:], F.lit(float(coefficients[0])))


def derivative(coefficients: list[float], x: Column) -> Column:
    n = len(coefficients) - 1
    return polynomial([c * (n - i) for i, c in enumerate(coefficients[:-1])], x)


def axial_precision(z: Column, dsx: Column, dsy: Column, sx: Column, sy: Column, cx: list[float], cy: list[float], magnification: float) -> Column:
    """Axial precision by error propagation through the astigmatism curves (widths and their errors in one unit)."""
    wx, wy = polynomial(cx, z), polynomial(cy, z)
    a, b = derivative(cx, z) / (2 * F.sqrt(wx)), derivative(cy, z) / (2 * F.sqrt(wy))
    ea, eb = dsx / (2 * F.sqrt(sx)), dsy / (2 * F.sqrt(sy))
    return F.sqrt((a * a * ea * ea + b * b * eb * eb) / F.pow(a * a + b * b, 2)) * magnification


def in_disc(x: Column, y: Column, cx, cy, r) -> Column:
    return (x - cx) * (x - cx) + (y - cy) * (y - cy) < F.lit(r) * F.lit(r)


def in_polygon(x: Column, y: Column, xs: list[float], ys: list[float]) -> Column:
    """Even-odd ray casting against a closed polygon given by its vertices."""
    crossings = F.lit(0)
    for (xa, ya), (xb, yb) in zip(zip(xs, ys, strict=True), zip(xs[1:], ys[1:], strict=False), strict=False):
        if ya != yb:
            cuts = (F.lit(ya) > y) != (F.lit(yb) > y)
            crossings = crossings + F.when(cuts & (x < F.lit(xb - xa) * (y - ya) / F.lit(yb - ya) + xa), 1).otherwise(0)
    return crossings % 2 == 1


def in_rectangle(x: Column, y: Column, xs: float, ys: float, xe: float, ye: float, width: float) -> tuple[Column, Column, Column]:
    """(inside, along, across) for a rectangle given by its axis; bounds are open."""
    length = math.hypot(xe - xs, ye - ys)
    ux, uy = (xe - xs) / length, (ye - ys) / length
    along = (x - xs) * ux + (y - ys) * uy
    across = (y - ys) * ux - (x - xs) * uy
    return (along > 0) & (along < length) & (F.abs(across) < width / 2), along, across


def polygon_area(xs: Column, ys: Column) -> Column:
    """Shoelace area of a polygon whose vertices are two arrays; it is closed if it is not."""
    n = F.size(xs)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0.0),
        lambda acc, i: acc + F.element_at(xs, i) * F.element_at(ys, (i % n) + 1) - F.element_at(xs, (i % n) + 1) * F.element_at(ys, i),
    )
    return F.abs(total) / 2


def morton(x: Column, y: Column, bits: int = 16) -> Column:
    """Interleaved bits of two cell numbers, for a Z-ordered layout."""
    code = F.lit(0).cast("long")
    for b in range(bits):
        for shift, c in ((2 * b, x), (2 * b + 1, y)):
            code = code.bitwiseOR(F.shiftleft(F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1).cast("long")), shift))
    return code


def rotate(x: Column, y: Column, z: Column, ax: float, ay: float, az: float) -> tuple[Column, Column, Column]:
    """Rotation about z, then y, then x; positive angles turn x to y, z to x and z to y."""
    sx, cx, sy, cy, sz, cz = math.sin(ax), math.cos(ax), math.sin(ay), math.cos(ay), math.sin(az), math.cos(az)
    x, y = x * cz - y * sz, x * sz + y * cz
    x, z = x * cy + z * sy, z * cy - x * sy
    return x, y * cx + z * sx, z * cx - y * sx
