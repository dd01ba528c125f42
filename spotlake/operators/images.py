"""Sparse images (iy, ix, value): blur, contrast, rings and thresholds. Pixels without a row are 0."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed


def blur(image: DataFrame, sigma: float, ny: int, nx: int, reach: float = 4.0) -> DataFrame:
    """Gaussian blur, one axis after the other; the kernel sums to 1 and what falls outside ny x nx is lost."""
    k = int(reach * sigma + 0.5)
    w = [math.exp(-i * i / (2 * sigma * sigma)) for i in range(-k, k + 1)]
    taps = F.array(*[F.struct(F.lit(i - k).alias("i"), F.lit(v / sum(w)).alias("w")) for i, v in enumerate(w)])
    for axis, other, n in (("iy", "ix", ny), ("ix", "iy", nx)):
        spread = image.select(axis, other, "value", F.explode(taps).alias("t")).withColumn(axis, F.col(axis) + F.col("t.i"))
        image = spread.where(F.col(axis).between(0, n - 1)).groupBy(axis, other).agg(F.sum(F.col("value") * F.col("t.w")).alias("value"))
    return image.select("iy", "ix", "value")


def radial_sum(image: DataFrame, cy: float, cx: float) -> DataFrame:
    """(ring, value): sums of pixels whose distance to the centre is in [ring, ring + 1)."""
    d = F.sqrt((F.col("iy") - cy) * (F.col("iy") - cy) + (F.col("ix") - cx) * (F.col("ix") - cx))
    return image.groupBy(F.floor(d).cast("long").alias("ring")).agg(F.sum("value").alias("value"))


def scale_contrast(image: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Values mapped from low..high to 0..1 and clipped; by default from 0 to half of the maximum."""
    if high is None:
        image = image.join(F.broadcast(image.agg((F.max("value") / 2).alias("_high"))))  # one row
        low, top = 0.0, F.col("_high")
    else:
        top = F.lit(high)
    scaled = F.least(F.greatest(F.try_divide(F.col("value") - low, top - low), F.lit(0.0)), F.lit(1.0))
    return image.select("iy", "ix", scaled.alias("value"))


def to_8bit(image: DataFrame) -> DataFrame:
    image = image.join(F.broadcast(image.agg(F.max("value").alias("_max"))))  # one row
    return image.select("iy", "ix", F.floor(F.coalesce(F.try_divide("value", "_max"), F.lit(0.0)) * 255 + 0.5).cast("long").alias("value"))


def grey_histogram(image: DataFrame, pixels: int, bins: int = 256) -> DataFrame:
    """(bin, n, center): counts of all pixels in equal bins from the least to the greatest value; absent ones are 0."""
    rest = pixels - F.count("*")
    span = image.agg(F.max("value").cast("double").alias("_max"), rest.alias("_rest"), F.when(rest > 0, F.least(F.lit(0.0), F.min("value"))).otherwise(F.min("value")).cast("double").alias("_min"))
    width = (F.col("_max") - F.col("_min")) / bins
    at = lambda v: F.least(F.floor(F.coalesce(F.try_divide(v - F.col("_min"), width), F.lit(0.0))), F.lit(bins - 1)).cast("long")
    counts = image.join(F.broadcast(span)).groupBy(at(F.col("value")).alias("bin")).agg(F.count("*").alias("n"))
    absent = span.where("_rest > 0").select(at(F.lit(0.0)).alias("bin"), F.col("_rest").alias("n"))
    counts = counts.unionAll(absent).groupBy("bin").agg(F.sum("n").alias("n"))
    return counts.join(F.broadcast(span)).select("bin", "n", (F.col("_min") + (F.col("bin") + 0.5) * width).alias("center"))


def threshold_otsu(image: DataFrame, pixels: int, bins: int = 256) -> DataFrame:
    """(threshold,): the bin centre with the largest variance between the two classes, the lowest of equals; null if the
    pixels are alike. Windows go over `bins` rows."""
    below, above = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("bin").rowsBetween(1, Window.unboundedFollowing)
    n, m = F.col("n"), F.col("n") * F.col("center")
    mean = lambda w: F.try_divide(F.sum(m).over(w), F.sum(n).over(w))
    between = F.sum(n).over(below) * F.sum(n).over(above) * F.pow(mean(below) - mean(above), 2)
    best = grey_histogram(image, pixels, bins).select("center", between.alias("v")).where("v is not null")
    return best.agg((-F.max(F.struct("v", (-F.col("center")).alias("c")))["c"]).alias("threshold"))


def mask_above(image: DataFrame, threshold: DataFrame) -> DataFrame:
    """Pixels whose value exceeds the one row of `threshold`."""
    return image.join(F.broadcast(threshold)).where(F.col("value") > F.col("threshold")).select("iy", "ix")


def threshold_mean(image: DataFrame, pixels: int) -> DataFrame:
    return image.agg((F.sum("value") / pixels).alias("threshold"))


def _counted(image: DataFrame, pixels: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, centres) of the grey histogram, of which the driver sees `bins` rows."""
    rows = grey_histogram(image, pixels, bins).collect()
    counts, centers = np.zeros(bins), np.full(bins, np.nan)
    for r in rows:
        counts[r["bin"]], centers[r["bin"]] = r["n"], r["center"]
    there = np.flatnonzero(~np.isnan(centers))
    if len(there) > 1:
        centers = np.interp(np.arange(bins), there, centers[there])
        width = (centers[there[-1]] - centers[there[0]]) / (there[-1] - there[0])
        centers = centers[there[0]] + (np.arange(bins) - there[0]) * width
    return counts, centers


def threshold_isodata(image: DataFrame, pixels: int, bins: int = 256) -> float | None:
    """The first bin centre that lies half way between the means below and above it, to within a bin."""
    counts, centers = _counted(image, pixels, bins)
    below, mass = np.cumsum(counts)[:-1], np.cumsum(counts * np.nan_to_num(centers))
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = (mass[:-1] / below + (mass[-1] - mass[:-1]) / (counts.sum() - below)) / 2 - centers[:-1]
        hit = np.flatnonzero((gap >= 0) & (gap < centers[1] - centers[0]))
    return float(centers[hit[0]]) if len(hit) else None


def threshold_minimum(image: DataFrame, pixels: int, bins: int = 256, rounds: int = 10_000) -> float | None:
    """The lowest bin between two peaks of the histogram, which is smoothed over three bins until two are left; null if that fails."""
    counts, centers = _counted(image, pixels, bins)

    def peaks(h: np.ndarray) -> np.ndarray:
        """Where steps that go up, or the start, are followed by steps that go down, level ones between them aside."""
        way = np.sign(np.diff(h))
        steps = np.flatnonzero(way)
        return steps[(way[steps] < 0) & (np.r_[1, way[steps]][:-1] > 0)]

    for _ in range(rounds):
        counts = np.convolve(np.pad(counts, 1, "edge"), np.ones(3) / 3, "valid").astype(np.float32).astype(float)
        tops = peaks(counts)
        if len(tops) < 3:
            break
    return float(centers[tops[0] + counts[tops[0] : tops[1] + 1].argmin()]) if len(tops) == 2 else None


def threshold_triangle(image: DataFrame, pixels: int, bins: int = 256) -> float | None:
    """The bin farthest below the line from the histogram's peak to the end of its longer side."""
    counts, centers = _counted(image, pixels, bins)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        return float(centers[used[0]]) if len(used) else None
    peak, right = int(counts.argmax()), int(counts.argmax()) - used[0] < used[-1] - int(counts.argmax())
    side = np.arange(used[-1], peak, -1) if right else np.arange(used[0], peak)
    far = counts[peak] * np.arange(len(side)) - len(side) * counts[side]
    return float(centers[side[far.argmax()]])


def threshold_yen(image: DataFrame, pixels: int, bins: int = 256) -> float | None:
    """The bin that maximises the correlation criterion of the two classes' entropies."""
    counts, centers = _counted(image, pixels, bins)
    share = counts / counts.sum()
    low, low2, high2 = np.cumsum(share), np.cumsum(share**2), np.cumsum(share[::-1] ** 2)[::-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.log((low[:-1] * (1 - low[:-1])) ** 2 / (low2[:-1] * high2[1:]))
    return float(centers[:-1][np.nanargmax(np.where(np.isfinite(score), score, -np.inf))])


def threshold_li(image: DataFrame, pixels: int) -> float | None:
    """Li's least cross-entropy threshold: the logarithmic mean of the two classes' means, repeated to half the least
    difference of values. Each round sums the table of distinct values once."""
    values = checkpointed(image.groupBy(F.col("value").cast("double").alias("v")).agg(F.count("*").alias("n")))
    seen = values.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("s")).first()
    rest = pixels - (seen["n"] or 0)
    if rest:
        values = values.unionAll(values.sparkSession.range(1).select(F.lit(0.0).alias("v"), F.lit(rest).alias("n"))).groupBy("v").agg(F.sum("n").alias("n"))
    # neighbours within ranges of values and across their ends, without sorting all of them in one task
    ranged = values.repartitionByRange("v").sortWithinPartitions("v").withColumn("p", F.spark_partition_id())
    ranged = checkpointed(ranged)
    inner = ranged.withColumn("gap", F.col("v") - F.lag("v").over(Window.partitionBy("p").orderBy("v"))).agg(F.min("gap")).first()[0]
    ends = sorted(ranged.groupBy("p").agg(F.min("v").alias("a"), F.max("v").alias("b")).select("a", "b").collect())
    gaps = [g for g in [inner, *(y[0] - x[1] for x, y in zip(ends, ends[1:], strict=False))] if g]
    if not gaps:
        return float(ends[0][0]) if ends else None
    tolerance, now, after = min(gaps) / 2, -math.inf, (seen["s"] or 0.0) / pixels
    while abs(after - now) > tolerance:
        now = after
        part = lambda w: F.sum(F.when(w, F.col("n") * F.col("v"))) / F.sum(F.when(w, F.col("n")))
        fore, back = values.agg(part(F.col("v") > now), part(F.col("v") <= now)).first()
        if not back or not fore:
            break
        after = (back - fore) / (math.log(back) - math.log(fore))
    return after


def local_mask(image: DataFrame, ny: int, nx: int, method: str = "mean") -> DataFrame:
    """Pixels above the mean, Gaussian mean (deviation 1/3) or median of the 3 x 3 pixels around them, edges mirrored.

    A pixel that is 0 is never above it where no value is negative, so only pixels with a row are tested. What exceeds the
    level by less than a billionth of it is equal, whatever the order of the sum.
    """
    tap = {0: 1.0, 1: math.exp(-4.5), -1: math.exp(-4.5)}
    total = sum(tap.values())
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(tap[i] * tap[j] / total**2).alias("w")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    mirror = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1))
    asked = image.select("iy", "ix", F.col("value").alias("own"), F.explode(steps).alias("s"))
    asked = asked.select(F.col("iy").alias("y"), F.col("ix").alias("x"), "own", "s.w", mirror(F.col("iy") + F.col("s.i"), ny).alias("iy"), mirror(F.col("ix") + F.col("s.j"), nx).alias("ix"))
    near = asked.join(image.select("iy", "ix", F.col("value").cast("double").alias("v")), ["iy", "ix"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    level = {"mean": F.sum("v") / 9, "gaussian": F.sum(F.col("v") * F.col("w")), "median": F.sort_array(F.collect_list("v"))[4]}[method]
    return near.groupBy(F.col("y").alias("iy"), F.col("x").alias("ix")).agg(F.first("own").alias("own"), level.alias("level")).where("own - level > 1e-9 * abs(level)").select("iy", "ix")


def tukey_window(image: DataFrame, n: int) -> DataFrame:
    """A square image of n x n pixels, faded out over an eighth of its width at each edge."""
    place = lambda c: (c - n / 2) / n
    fade = lambda u: F.when(F.abs(u) < 6 / 16, F.lit(1.0)).otherwise(0.5 - 0.5 * F.cos(F.lit(math.pi * 8) * u))
    return image.select("iy", "ix", (F.col("value") * fade(place(F.col("ix"))) * fade(place(n - 1 - F.col("iy")))).alias("value"))


def shifted_overlap(first: DataFrame, second: DataFrame, reach: int) -> DataFrame:
    """(sy, sx, n): for each shift of up to `reach` cells, the sum over cells of the smaller of two counts."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    moved = second.select(F.col("iy").alias("y"), F.col("ix").alias("x"), F.col("value").alias("b"), F.explode(steps).alias("sy")).select("*", F.explode(steps).alias("sx"))
    moved = moved.select((F.col("y") + F.col("sy")).alias("iy"), (F.col("x") + F.col("sx")).alias("ix"), "sy", "sx", "b")
    return first.join(moved, ["iy", "ix"]).groupBy("sy", "sx").agg(F.sum(F.least("value", "b")).alias("n"))


def hash_half(key: Column, seed: int = 42) -> Column:
    """0 or 1 for each key: a split into halves that a recomputed task repeats."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(2)).cast("int")
