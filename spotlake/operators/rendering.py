"""Views of localizations as sparse images (iy, ix, value): blurred, rotated, with voxels of their own sides, in several channels.

A view is x0, y0, x1, y1 in pixels of the camera, open at its edges.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from .tables import render_histogram

View = tuple[float, float, float, float]
REACH = 3  # deviations from the centre that are drawn
METHODS = ("gaussian", "gaussian_iso", "convolve", "smooth", "none")


def turned(locs: DataFrame, view: View, angles: tuple[float, float, float], pixelsize: float) -> DataFrame:
    """Rows with x, y, z rotated about the view's middle, z in nm being 0 there."""
    cx, cy = (view[0] + view[2]) / 2, (view[1] + view[3]) / 2
    x, y, z = X.rotate(F.col("x") - cx, F.col("y") - cy, F.col("z") / pixelsize, *angles)
    return locs.withColumns({"x": x + cx, "y": y + cy, "z": z * pixelsize})


def _inside(view: View) -> Column:
    return (F.col("x") > view[0]) & (F.col("x") < view[2]) & (F.col("y") > view[1]) & (F.col("y") < view[3])


def pixels_of(view: View, oversampling: float) -> tuple[int, int]:
    """(height, width) of the image of a view."""
    return math.ceil(oversampling * (view[3] - view[1])), math.ceil(oversampling * (view[2] - view[0]))


def render_gaussian(locs: DataFrame, view: View, oversampling: float = 1.0, min_blur: float = 0.0, iso: bool = False, angles: tuple[float, float, float] | None = None, pixelsize: float = 1.0) -> DataFrame:
    """Each row as a Gaussian of its precisions (at least min_blur), summed over the pixels within three deviations.

    iso: one deviation in the plane, the mean of both. angles: rows and their Gaussians are turned about x, y, z and seen along
    z; the precision in z is lpz in pixels or, without that column, twice the mean of the others. Gaussians seen edge on, and
    rows with a null among their numbers, are left out.
    """
    ny, nx = pixels_of(view, oversampling)
    px, py = F.col("lpx"), F.col("lpy")
    pz = F.col("lpz") if "lpz" in locs.columns else px + py
    if angles is not None:
        locs = turned(locs, view, angles, pixelsize)
    wide = lambda p: oversampling * F.greatest(p, F.lit(min_blur))
    sx, sy, sz = wide(px), wide(py), wide(pz)
    if iso:
        sx = sy = (sx + sy) / 2
    rows = locs.where(_inside(view) & px.isNotNull() & py.isNotNull() & pz.isNotNull())
    at = [((F.col(c) - start) * oversampling).alias(c) for c, start in (("x", view[0]), ("y", view[1]))]
    if angles is None:
        rows = rows.select(*at, (sx * sx).alias("xx"), (sy * sy).alias("yy"), F.lit(0.0).alias("xy"))
    else:
        unit = _matrix(angles)
        total = lambda i, j: sum((float(unit[i, k] * unit[j, k]) * s * s for k, s in ((1, sy), (2, sz))), float(unit[i, 0] * unit[j, 0]) * sx * sx)
        rows = rows.select(*at, total(0, 0).alias("xx"), total(1, 1).alias("yy"), total(0, 1).alias("xy"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    rows = rows.withColumn("det", det).where("det >= 1e-10")
    off = lambda c: REACH * F.sqrt(F.col(c * 2))
    span = lambda c, n: F.explode(F.when(F.col(c) - off(c) < n, F.sequence(F.greatest((F.col(c) - off(c)).cast("int"), F.lit(0)), F.least((F.col(c) + off(c) + 1).cast("int"), F.lit(n)) - 1)))
    drawn = rows.withColumn("iy", span("y", ny)).withColumn("ix", span("x", nx))
    a, b = F.col("ix") + 0.5 - F.col("x"), F.col("iy") + 0.5 - F.col("y")
    power = (a * a * F.col("yy") - 2 * a * b * F.col("xy") + b * b * F.col("xx")) / F.col("det")
    value = F.exp(-power / 2) / (2 * F.lit(math.pi) * F.sqrt("det"))
    return drawn.groupBy(F.col("iy").cast("long").alias("iy"), F.col("ix").cast("long").alias("ix")).agg(F.sum(value).alias("value"))


def _matrix(angles: tuple[float, float, float]) -> np.ndarray:
    """Rotation of X.rotate as a matrix."""
    sx, sy, sz = map(math.sin, angles)
    cx, cy, cz = map(math.cos, angles)
    about_x, about_y, about_z = [[1, 0, 0], [0, cx, sx], [0, -sx, cx]], [[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]], [[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]]
    return np.array(about_x) @ np.array(about_y) @ np.array(about_z)


def convolved(image: DataFrame, sy: float, sx: float, ny: int, nx: int, reach: float = 5.0) -> DataFrame:
    """A Gaussian blur with a deviation for each axis; what falls outside ny x nx is lost."""
    for axis, other, n, sigma in (("iy", "ix", ny, sy), ("ix", "iy", nx, sx)):
        k = int(reach * sigma + 0.5)
        w = [math.exp(-i * i / (2 * sigma * sigma)) if sigma else 1.0 for i in range(-k, k + 1)]
        taps = F.array(*[F.struct(F.lit(i - k).alias("i"), F.lit(v / sum(w)).alias("w")) for i, v in enumerate(w)])
        spread = image.select(axis, other, "value", F.explode(taps).alias("t")).withColumn(axis, F.col(axis) + F.col("t.i"))
        image = spread.where(F.col(axis).between(0, n - 1)).groupBy(axis, other).agg(F.sum(F.col("value") * F.col("t.w")).alias("value"))
    return image.select("iy", "ix", "value")


def render_convolved(locs: DataFrame, view: View, oversampling: float = 1.0, min_blur: float = 0.0) -> DataFrame:
    """Counts blurred by the median precisions of the rows in view, which are found to within 1 part in 10,000 of their ranks."""
    ny, nx = pixels_of(view, oversampling)
    middle = locs.where(_inside(view)).agg(*[F.percentile_approx(c, 0.5, 10_000) for c in ("lpx", "lpy")]).first()
    counts = render_histogram(locs, oversampling, *view)
    if middle[0] is None:
        return counts
    sx, sy = (oversampling * max(m, min_blur) for m in middle)
    return convolved(counts, sy, sx, ny, nx)


def render_voxels(locs: DataFrame, view: View, z0: float, z1: float, oversampling: tuple[float, float, float], pixelsize: float) -> DataFrame:
    """(iy, ix, iz, value): rows per voxel, with an oversampling for each of x, y, z; z0, z1 in nm."""
    seen = locs.where(_inside(view) & (F.col("z") > z0) & (F.col("z") < z1))
    at = lambda c, start, f: F.floor((c - start) * f).cast("long")
    place = [at(F.col("y"), view[1], oversampling[1]).alias("iy"), at(F.col("x"), view[0], oversampling[0]).alias("ix"), at(F.col("z") / pixelsize, z0 / pixelsize, oversampling[2]).alias("iz")]
    return seen.groupBy(*place).agg(F.count("*").alias("value"))


def render(locs: DataFrame, view: View, oversampling: float = 1.0, method: str = "none", min_blur: float = 0.0, angles: tuple[float, float, float] | None = None, pixelsize: float = 1.0) -> DataFrame:
    """A view by one of METHODS: Gaussians, round Gaussians, counts blurred by the median precision, counts blurred by one pixel,
    or counts."""
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    if method.startswith("gaussian"):
        return render_gaussian(locs, view, oversampling, min_blur, method == "gaussian_iso", angles, pixelsize)
    rows = locs if angles is None else turned(locs, view, angles, pixelsize)
    if method == "convolve":
        return render_convolved(rows, view, oversampling, min_blur)
    counts = render_histogram(rows, oversampling, *view)
    return convolved(counts, 1.0, 1.0, *pixels_of(view, oversampling), reach=4.0) if method == "smooth" else counts


def render_channels(locs: DataFrame, colors: dict[str, tuple[float, float, float]], view: View, oversampling: float = 1.0, channel: str = "channel", intensities: dict[str, float] | None = None, **how) -> DataFrame:
    """(iy, ix, red, green, blue): the images of several channels, each divided by its maximum and times its relative intensity
    (1 by default), in their colours, summed and clipped at 1."""
    parts = None
    for name, color in colors.items():
        image = render(locs.where(F.col(channel) == name), view, oversampling, **how)
        image = image.join(F.broadcast(image.agg(F.max("value").alias("_top"))))  # one row
        share = F.try_divide("value", "_top") * (intensities or {}).get(name, 1.0)
        image = image.select("iy", "ix", *[(share * float(v)).alias(c) for c, v in zip(("red", "green", "blue"), color, strict=True)])
        parts = image if parts is None else parts.unionAll(image)
    return parts.groupBy("iy", "ix").agg(*[F.least(F.sum(c), F.lit(1.0)).alias(c) for c in ("red", "green", "blue")])
