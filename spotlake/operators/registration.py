"""Drift and channel alignment from cross-correlations of sparse images.

Segments are rendered to sparse counts; two images are correlated by a join of their pixels that lie near each other, so no image is
held whole. The driver sees one small patch around each pair's peak, and one shift a pair.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .detection import fit_least_squares
from .shared import checkpointed


def cross_correlation(images: DataFrame, reach: int, pairs: list[tuple] | None = None) -> DataFrame:
    """(a, b, sy, sx, value): for images (image, iy, ix, value), the sum over pixels of a's value times b's at the place
    shifted by sy, sx, for shifts of up to `reach` pixels. pairs: those wanted; by default all with a < b."""
    cell = lambda c: F.floor(F.col(c) / reach)
    first = images.select(F.col("image").alias("a"), F.col("iy").alias("ya"), F.col("ix").alias("xa"), F.col("value").alias("va"), cell("iy").alias("cy"), cell("ix").alias("cx"))
    second = images.select(F.col("image").alias("b"), F.col("iy").alias("yb"), F.col("ix").alias("xb"), F.col("value").alias("vb"), F.explode(F.array(*[cell("iy") + i for i in (-1, 0, 1)])).alias("cy"), cell("ix").alias("_x"))
    second = second.select("*", F.explode(F.array(*[F.col("_x") + i for i in (-1, 0, 1)])).alias("cx")).drop("_x")
    sy, sx = F.col("yb") - F.col("ya"), F.col("xb") - F.col("xa")
    met = first.join(second, ["cy", "cx"]).where((F.abs(sy) <= reach) & (F.abs(sx) <= reach))
    met = met.where(F.col("a") < F.col("b")) if pairs is None else met.where(F.struct("a", "b").isin([F.struct(F.lit(a), F.lit(b)) for a, b in pairs]))
    return met.groupBy("a", "b", sy.alias("sy"), sx.alias("sx")).agg(F.sum(F.col("va") * F.col("vb")).alias("value"))


def image_shifts(correlation: DataFrame, roi: int = 5) -> dict[tuple, tuple[float, float]]:
    """(a, b): (dy, dx) of the peak of each correlation, the centre of a Gaussian fitted to roi x roi values around the largest
    one (ties to the least shift). Pairs without a value have none."""
    half = roi // 2
    top = Window.partitionBy("a", "b")
    order = top.orderBy(F.desc("value"), F.col("sy") * F.col("sy") + F.col("sx") * F.col("sx"), "sy", "sx")
    rows = correlation.withColumn("py", F.first("sy").over(order)).withColumn("px", F.first("sx").over(order))
    rows = rows.where((F.abs(F.col("sy") - F.col("py")) <= half) & (F.abs(F.col("sx") - F.col("px")) <= half)).collect()
    patches: dict[tuple, np.ndarray] = {}
    peaks = {}
    for r in rows:
        key = (r["a"], r["b"])
        peaks[key] = (r["py"], r["px"])
        patches.setdefault(key, np.zeros((roi, roi)))[r["sy"] - r["py"] + half, r["sx"] - r["px"] + half] = r["value"]
    keys = sorted(patches)
    if not keys:
        return {}
    fits = fit_least_squares(np.stack([patches[k] for k in keys]))
    out = {}
    for key, fit in zip(keys, fits, strict=True):
        dx, dy = fit[:2] if np.abs(fit[:2]).max() <= half else (0.0, 0.0)
        out[key] = (peaks[key][0] + float(dy), peaks[key][1] + float(dx))
    return out


def minimize_shifts(shifts: dict[tuple, tuple[float, float]], names: list) -> dict:
    """name: (dy, dx): places of all images relative to the first that fit the pairwise shifts best (least squares)."""
    at, pairs = {n: i for i, n in enumerate(names)}, list(shifts)
    a = np.zeros((len(pairs), len(names)))
    for row, (i, j) in enumerate(pairs):
        a[row, at[i]], a[row, at[j]] = -1.0, 1.0
    found = np.zeros((len(names), 2))
    if pairs and len(names) > 1:
        found[1:] = np.linalg.lstsq(a[:, 1:], np.array([shifts[p] for p in pairs], float), rcond=None)[0]
    return {n: tuple(found[i].tolist()) for n, i in at.items()}


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline through (x, y), one cubic at each end over two intervals; a polynomial through fewer than four points."""
    n = len(x)
    if n < 4:
        return np.polyval(np.polyfit(x, y, n - 1), at)
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    m, r = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        m[i, i - 1 : i + 2], r[i] = (h[i - 1], 2 * (h[i - 1] + h[i]), h[i]), 6 * (slope[i] - slope[i - 1])
    m[0, :3], m[-1, -3:] = (h[1], -(h[0] + h[1]), h[0]), (h[-1], -(h[-2] + h[-1]), h[-2])
    bend = np.linalg.solve(m, r)
    i = np.clip(np.searchsorted(x, at) - 1, 0, n - 2)
    a, b = x[i + 1] - at, at - x[i]
    return (bend[i] * a**3 + bend[i + 1] * b**3) / (6 * h[i]) + (y[i] / h[i] - bend[i] * h[i] / 6) * a + (y[i + 1] / h[i] - bend[i + 1] * h[i] / 6) * b


def counted(locs: DataFrame, by: str, oversampling: float = 1.0) -> DataFrame:
    """(image, iy, ix, value): rows per pixel and image."""
    pixel = lambda c: F.floor(F.col(c) * oversampling).cast("long")
    return locs.groupBy(F.col(by).alias("image"), pixel("y").alias("iy"), pixel("x").alias("ix")).agg(F.count("*").alias("value"))


def drift_curve(shifts: dict[tuple, tuple[float, float]], edges: np.ndarray, frames: int, oversampling: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(dx, dy) of every frame: a spline through the places of the segments between the edges that fit their shifts best."""
    names = list(range(len(edges) - 1))
    place = minimize_shifts(shifts, names)
    middle, every = (edges[:-1] + edges[1:]) / 2, np.arange(frames)
    dy, dx = (spline(middle, np.array([place[n][k] for n in names]) / oversampling, every) if len(names) > 1 else np.zeros(frames) for k in (0, 1))
    return dx, dy


def correlation_drift(locs: DataFrame, frames: int, per_segment: int, reach: int = 8, oversampling: float = 1.0) -> DataFrame:
    """(frame, dx, dy): drift from the redundant cross-correlations of all pairs of segments of `per_segment` frames, as a
    spline over the segments' middles. The number of segments is bounded by the movie, not by its rows."""
    segments = max(1, round(frames / per_segment))
    edges = np.linspace(0, frames - 1, segments + 1)
    rows = locs.withColumn("_segment", F.least(F.floor(F.col("frame") / (edges[1] - edges[0])), F.lit(segments - 1)).cast("long"))
    images = checkpointed(counted(rows, "_segment", oversampling))
    dx, dy = drift_curve(image_shifts(cross_correlation(images, reach)), edges, frames, oversampling)
    return locs.sparkSession.createDataFrame([(f, float(a), float(b)) for f, (a, b) in enumerate(zip(dx, dy, strict=True))], "frame long, dx double, dy double")


def align_channels(locs: DataFrame, channel: str = "channel", reach: int = 8, oversampling: float = 1.0) -> DataFrame:
    """Rows moved so that all channels lie on the first (in order of name), by the cross-correlations of all pairs."""
    names = sorted(r[0] for r in locs.select(channel).distinct().collect())
    images = checkpointed(counted(locs, channel, oversampling))
    place = minimize_shifts(image_shifts(cross_correlation(images, reach)), names)
    moved = lambda k: F.coalesce(*[F.when(F.col(channel) == n, F.lit(place[n][k] / oversampling)) for n in names], F.lit(0.0))
    return locs.withColumn("x", F.col("x") - moved(1)).withColumn("y", F.col("y") - moved(0))


def all_pairs(names: list) -> list[tuple]:
    return list(itertools.combinations(names, 2))
