"""Filters, set operations, drift and rendering over localization tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed, running_sums

NON_NEGATIVE = ("x", "y", "lpx", "lpy", "lpz", "photons", "ellipticity", "sx", "sy")


def ensure_sanity(locs: DataFrame, width: float, height: float) -> DataFrame:
    """Drops rows with a missing or infinite number, outside the field of view, or with a negative measure."""
    good = F.lit(True)
    for name, kind in locs.dtypes:
        good &= F.col(name).isNotNull()
        if kind in ("double", "float"):
            good &= ~F.isnan(name) & (F.abs(name) != float("inf"))
        if name in NON_NEGATIVE:
            good &= F.col(name) >= 0
    return locs.where(good & (F.col("x") < width) & (F.col("y") < height))


def in_range(locs: DataFrame, column: str, low: float, high: float, inclusive: bool = False) -> DataFrame:
    c = F.col(column)
    return locs.where((c >= low) & (c <= high) if inclusive else (c > low) & (c < high))


def sync_groups(tables: list[DataFrame]) -> list[DataFrame]:
    """Only rows of groups that are in all tables."""
    common = reduce(lambda a, b: a.intersect(b), [t.select("group").distinct() for t in tables])
    return [t.join(common, "group", "left_semi") for t in tables]


def merge_locs(tables: list[DataFrame], increment_frames: bool = True, increment_groups: bool = True) -> DataFrame:
    """Union in which each table's frames and groups follow the largest of those before it (cumulative maxima)."""
    frame = group = 0
    out = []
    for t in tables:
        out.append(t.withColumn("frame", F.col("frame") + frame).withColumn("group", F.col("group") + group))
        top = t.agg(F.max("frame"), F.max("group")).first()
        frame += (top[0] or 0) if increment_frames else 0
        group += (top[1] or 0) if increment_groups else 0
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def apply_drift(locs: DataFrame, drift: DataFrame, frames: int, broadcast_frames: int = 1_000_000) -> DataFrame:
    """Subtracts the drift (frame, dx, dy and perhaps dz) of each row's frame, dz where rows have z; a frame without drift is an
    error when its rows are read. The table has one row a frame and is broadcast while the movie has at most broadcast_frames."""
    side = F.broadcast(drift) if frames <= broadcast_frames else drift
    shift = lambda c: F.coalesce(c, F.raise_error(F.format_string("frame %d has no drift", "frame")).cast("double"))
    axes = [a for a in "xyz" if a in locs.columns and f"d{a}" in drift.columns]
    moved = {a: F.col(a) - shift(f"d{a}") for a in axes}
    return locs.join(side, "frame", "left").withColumns(moved).drop(*[c for c in drift.columns if c != "frame"])


def fiducial_drift(picked: DataFrame) -> DataFrame:
    """(frame, dx, dy): mean displacement of fiducials in each frame, weighted by the inverse of each one's variance. Fiducials
    that do not vary have no weight."""
    known = picked.groupBy("pick_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy")).where("vx > 0 and vy > 0")
    rows = picked.select("pick_id", "frame", "x", "y").join(known, "pick_id")
    mean = lambda c: F.sum((F.col(c) - F.col(f"m{c}")) / F.col(f"v{c}")) / F.sum(1 / F.col(f"v{c}"))
    return rows.groupBy("frame").agg(mean("x").alias("dx"), mean("y").alias("dy"))


def picked_drift(picked: DataFrame, frames: int) -> DataFrame:
    """(frame, dx, dy, and dz where the picked rows have z) of every frame of the movie, from rows (pick_id, loc_id, frame, x, y).

    A pick's displacement in a frame is that of its row of largest loc_id from the mean of all its rows. Picks are weighted by
    the inverse mean square of what they differ from the plain mean of each frame; those that never differ weigh most. Frames
    without rows lie on a line between their neighbours, those before the first or after the last take its value. No rows at
    all give no drift. The driver sees one row a frame.
    """
    axes = [a for a in "xyz" if a in picked.columns]
    rows = picked.where(F.col("frame").between(0, frames - 1)).select("pick_id", "loc_id", "frame", *axes)
    means = rows.groupBy("pick_id").agg(*[F.avg(a).alias(f"m{a}") for a in axes])
    latest = rows.groupBy("pick_id", "frame").agg(*[F.max_by(a, "loc_id").alias(a) for a in axes])
    own = checkpointed(latest.join(means, "pick_id").select("pick_id", "frame", *[(F.col(a) - F.col(f"m{a}")).alias(a) for a in axes]))
    plain = own.groupBy("frame").agg(*[F.avg(a).alias(f"p{a}") for a in axes])
    square = lambda a: F.avg(F.pow(F.col(a) - F.col(f"p{a}"), F.lit(2.0)))
    weights = own.join(plain, "frame").groupBy("pick_id").agg(*[(1 / F.greatest(square(a), F.lit(1e-30))).alias(f"w{a}") for a in axes])
    drift = own.join(weights, "pick_id").groupBy("frame").agg(*[(F.sum(F.col(a) * F.col(f"w{a}")) / F.sum(F.when(F.col(a).isNotNull(), F.col(f"w{a}")))).alias(f"d{a}") for a in axes])
    known, shape = drift.orderBy("frame").toPandas(), ", ".join(["frame long", *[f"d{a} double" for a in axes]])
    seen = {a: known[["frame", f"d{a}"]].dropna().to_numpy(float).T for a in axes}
    if not all(v.shape[1] for v in seen.values()):
        return picked.sparkSession.createDataFrame([], shape)
    values = [np.interp(np.arange(frames), *seen[a]).tolist() for a in axes]
    return picked.sparkSession.createDataFrame(list(zip(range(frames), *values, strict=True)), shape)


def undrift_from_picked(locs: DataFrame, picked: DataFrame, frames: int) -> tuple[DataFrame, DataFrame]:
    """(rows set right, drift): see `picked_drift`."""
    drift = picked_drift(picked, frames)
    return apply_drift(locs, drift, frames), drift


def channel_shifts(picked: DataFrame) -> DataFrame:
    """(a, b, dx, dy): mean difference of pick centres for each pair of channels."""
    centers = picked.groupBy("channel", "pick_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    a = centers.select(F.col("channel").alias("a"), "pick_id", F.col("x").alias("xa"), F.col("y").alias("ya"))
    b = centers.select(F.col("channel").alias("b"), "pick_id", F.col("x").alias("xb"), F.col("y").alias("yb"))
    return a.join(b, "pick_id").where("a < b").groupBy("a", "b").agg(F.avg(F.col("xb") - F.col("xa")).alias("dx"), F.avg(F.col("yb") - F.col("ya")).alias("dy"))


def center_groups(locs: DataFrame) -> DataFrame:
    """Each group about its own mean; rows of a null group are one group."""
    means = locs.groupBy(F.col("group").alias("_group")).agg(F.avg("x").alias("_x"), F.avg("y").alias("_y"))
    return locs.join(means, F.col("group").eqNullSafe(F.col("_group"))).withColumns({c: F.col(c) - F.col(f"_{c}") for c in "xy"}).drop("_group", "_x", "_y")


def unfold_square(locs: DataFrame, n_square: int = 10, spacing: float = 1.0) -> DataFrame:
    """Groups side by side, n_square in a row: each about its own mean, in order of group, the least x and y being 0. `group`
    becomes the number of the place; rows without a group are left out."""
    means = locs.where(F.col("group").isNotNull()).groupBy("group").agg(F.avg("x").alias("_x"), F.avg("y").alias("_y"), F.lit(1).cast("long").alias("_nth"))
    placed = running_sums(means, "group", ["_nth"]).drop("total__nth").withColumn("_nth", F.col("_nth") - 1)
    rows = locs.join(placed, "group").withColumns({"x": F.col("x") - F.col("_x") + F.col("_nth") % n_square * spacing, "y": F.col("y") - F.col("_y") + F.floor(F.col("_nth") / n_square) * spacing})
    least = rows.agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"))
    out = rows.join(F.broadcast(least)).withColumns({"x": F.col("x") - F.col("_x0"), "y": F.col("y") - F.col("_y0"), "group": F.col("_nth")})  # one row
    return out.select(*locs.columns)


def segment(locs: DataFrame, frames: int, segments: int) -> DataFrame:
    """Adds `segment`: equal spans of 0..frames-1 with open ends, so the last frame is in none."""
    step = (frames - 1) / segments
    return locs.withColumn("segment", F.floor(F.col("frame") / step).cast("long")).where(F.col("segment") < segments)


def render_histogram(locs: DataFrame, oversampling: float, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """(iy, ix, value): rows per pixel of an open viewport."""
    seen = locs.where((F.col("x") > x0) & (F.col("x") < x1) & (F.col("y") > y0) & (F.col("y") < y1))
    pixel = lambda c, start: F.floor((F.col(c) - start) * oversampling).cast("long")
    return seen.groupBy(pixel("y", y0).alias("iy"), pixel("x", x0).alias("ix")).agg(F.count("*").alias("value"))


def render_histogram3d(locs: DataFrame, oversampling: float, x0: float, y0: float, x1: float, y1: float, z0: float, z1: float, pixelsize: float) -> DataFrame:
    seen = locs.where((F.col("x") > x0) & (F.col("x") < x1) & (F.col("y") > y0) & (F.col("y") < y1) & (F.col("z") > z0) & (F.col("z") < z1))
    pixel = lambda c, start: F.floor((c - start) * oversampling).cast("long")
    return seen.groupBy(pixel(F.col("y"), y0).alias("iy"), pixel(F.col("x"), x0).alias("ix"), pixel(F.col("z") / pixelsize, z0 / pixelsize).alias("iz")).agg(F.count("*").alias("value"))


def render_gaussian(locs: DataFrame, oversampling: float, width: float, height: float, min_blur: float = 0.0, reach: float = 3.0) -> DataFrame:
    """(iy, ix, value): each row as a Gaussian of its own precision over the pixels within `reach` deviations."""
    nx, ny = int(-(-width * oversampling // 1)), int(-(-height * oversampling // 1))
    rows = locs.where((F.col("x") > 0) & (F.col("y") > 0) & (F.col("x") < width) & (F.col("y") < height))
    rows = rows.select(*[(F.col(a) * oversampling).alias(a) for a in "xy"], *[(F.greatest(F.col(f"lp{a}"), F.lit(min_blur)) * oversampling).alias(f"s{a}") for a in "xy"])
    first = lambda a: F.greatest((F.col(a) - reach * F.col(f"s{a}")).cast("int"), F.lit(0))
    last = lambda a, n: F.least((F.col(a) + reach * F.col(f"s{a}") + 1).cast("int"), F.lit(n)) - 1
    pixels = rows.withColumn("iy", F.explode(F.sequence(first("y"), last("y", ny)))).withColumn("ix", F.explode(F.sequence(first("x"), last("x", nx))))
    part = lambda a: F.pow(F.col(f"i{a}") + 0.5 - F.col(a), 2) / (2 * F.col(f"s{a}") * F.col(f"s{a}"))
    value = F.exp(-part("x") - part("y")) / (2 * F.lit(3.141592653589793) * F.col("sx") * F.col("sy"))
    return pixels.groupBy(F.col("iy").cast("long").alias("iy"), F.col("ix").cast("long").alias("ix")).agg(F.sum(value).alias("value"))


def mask_locs(locs: DataFrame, mask: DataFrame, width: float, height: float, nx: int, ny: int) -> tuple[DataFrame, DataFrame]:
    """Rows inside and outside a sparse mask (iy, ix)."""
    keyed = locs.withColumn("iy", F.floor(F.col("y") / height * ny).cast("long")).withColumn("ix", F.floor(F.col("x") / width * nx).cast("long"))
    return tuple(keyed.join(mask.select("iy", "ix"), ["iy", "ix"], how).drop("iy", "ix") for how in ("left_semi", "left_anti"))


def split_by_property(locs: DataFrame, column: str, colors: int, low: float, high: float) -> DataFrame:
    step = (high - low) / colors
    return locs.withColumn("color", F.least(F.greatest(F.floor((F.col(column) - low) / step), F.lit(0)), F.lit(colors - 1)).cast("long"))


def locs_per_frame(locs: DataFrame, window: int) -> DataFrame:
    """(channel, frame, n, rolling): rows per present frame and their trailing mean, null until the window is full."""
    counts = locs.groupBy("channel", "frame").agg(F.count("*").alias("n"))
    trail = Window.partitionBy("channel").orderBy("frame").rowsBetween(1 - window, 0)
    return counts.withColumn("rolling", F.when(F.count("*").over(trail) == window, F.avg("n").over(trail)))


def ks_statistic(rows: DataFrame, label: str, value: str, a, b) -> DataFrame:
    """(ks,): largest distance between the empirical distributions of two labels; null if one has no rows. Values are counted
    first; their running sums are formed by ranges."""
    counts = rows.where(F.col(label).isin(a, b)).groupBy(F.col(value).alias("value")).agg(F.sum((F.col(label) == a).cast("long")).alias("na"), F.sum((F.col(label) == b).cast("long")).alias("nb"))
    share = lambda c: F.try_divide(F.col(c), F.col(f"total_{c}"))
    return running_sums(counts, "value", ["na", "nb"]).agg(F.max(F.abs(share("na") - share("nb"))).alias("ks"))
