"""Picks of four shapes as tables, the rows inside them, and what is measured in each pick.

A pick table has pick_id and, by shape, x, y (circle, square), x0, y0, x1, y1 (the axis of a rectangle) or xs, ys (the corners of a
polygon). Rows and picks meet in cells of a grid, by an equality join; a pick is put into each cell that its bounding box touches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import detection as D
from . import events as E
from .images import blur
from .shared import checkpointed
from .statistics import kinetic_rates
from .tables import apply_drift, picked_drift, render_histogram

SHAPES = ("circle", "square", "rectangle", "polygon")


def _box(shape: str, size: float | None) -> tuple[Column, Column, Column, Column]:
    """Least and greatest x and y of a pick."""
    c = F.col
    if shape in ("circle", "square"):
        return c("x") - size / 2, c("x") + size / 2, c("y") - size / 2, c("y") + size / 2
    if shape == "rectangle":
        reach = size / 2
        return F.least("x0", "x1") - reach, F.greatest("x0", "x1") + reach, F.least("y0", "y1") - reach, F.greatest("y0", "y1") + reach
    return F.array_min("xs"), F.array_max("xs"), F.array_min("ys"), F.array_max("ys")


def _axis() -> tuple[Column, Column, Column]:
    """Length of a rectangle's axis, and the row's distances along and across it."""
    dx, dy = F.col("p.x1") - F.col("p.x0"), F.col("p.y1") - F.col("p.y0")
    length = F.sqrt(dx * dx + dy * dy)
    x, y = F.col("l.x") - F.col("p.x0"), F.col("l.y") - F.col("p.y0")
    return length, F.try_divide(x * dx + y * dy, length), F.try_divide(y * dx - x * dy, length)


def _inside(shape: str, size: float | None) -> Column:
    dx, dy = F.col("l.x") - F.col("p.x") if shape in SHAPES[:2] else None, F.col("l.y") - F.col("p.y") if shape in SHAPES[:2] else None
    if shape == "circle":
        return dx * dx + dy * dy < size * size / 4
    if shape == "square":
        return (F.abs(dx) < size / 2) & (F.abs(dy) < size / 2)
    if shape == "rectangle":
        length, along, across = _axis()
        return (along > 0) & (along < length) & (F.abs(across) < size / 2)
    # even-odd rule: how many edges a ray to the right crosses
    nxt = lambda c, i: F.element_at(c, F.when(i + 1 < F.size(c), i + 2).otherwise(1))
    edge = lambda x, i: F.struct(x.alias("xa"), F.element_at("p.ys", i + 1).alias("ya"), nxt(F.col("p.xs"), i).alias("xb"), nxt(F.col("p.ys"), i).alias("yb"))
    crossed = lambda e: ((e["ya"] > F.col("l.y")) != (e["yb"] > F.col("l.y"))) & (F.col("l.x") < e["xa"] + (e["xb"] - e["xa"]) * F.try_divide(F.col("l.y") - e["ya"], e["yb"] - e["ya"]))
    return F.size(F.filter(F.transform("p.xs", edge), crossed)) % 2 == 1


def picked_locs(locs: DataFrame, picks: DataFrame, shape: str, size: float | None = None, cell: float | None = None) -> DataFrame:
    """Rows inside each pick, with pick_id; a row in several picks comes several times. Circles: size is the diameter; squares:
    the side; rectangles: the width, and rows also get x_pick_rot along and y_pick_rot across the axis. Edges are outside; of a polygon, by the even-odd
    rule, those to the left and at the least y are inside.

    cell: side of the grid's cells; by default the size, and 8 for polygons. Picks without an area hold nothing.
    """
    if shape not in SHAPES:
        raise ValueError(f"unknown pick shape: {shape}")
    side = cell or size or 8.0
    low_x, high_x, low_y, high_y = _box(shape, size)
    spread = lambda a, b: F.explode(F.sequence(F.floor(a / side), F.floor(b / side)))
    dealt = picks.where(low_x.isNotNull() & low_y.isNotNull()).withColumn("_cx", spread(low_x, high_x)).withColumn("_cy", spread(low_y, high_y))
    dealt = dealt.select("_cx", "_cy", F.struct(*picks.columns).alias("p"))
    rows = locs.select(F.struct(*locs.columns).alias("l"), F.floor(F.col("x") / side).alias("_cx"), F.floor(F.col("y") / side).alias("_cy"))
    inside = rows.join(dealt, ["_cx", "_cy"]).where(_inside(shape, size))
    more = []
    if shape == "rectangle":
        _, along, across = _axis()
        more = [along.alias("x_pick_rot"), across.alias("y_pick_rot")]
    return inside.select("l.*", F.col("p.pick_id").alias("pick_id"), *more)


def remove_in_picks(locs: DataFrame, picks: DataFrame, shape: str, size: float | None = None) -> DataFrame:
    """Rows outside all picks."""
    return locs.join(picked_locs(locs.select("loc_id", "x", "y"), picks, shape, size).select("loc_id").distinct(), "loc_id", "left_anti")


def pick_areas(picks: DataFrame, shape: str, size: float | None = None) -> DataFrame:
    """(pick_id, area)."""
    if shape == "circle":
        area = F.lit(math.pi * size * size / 4)
    elif shape == "square":
        area = F.lit(float(size * size))
    elif shape == "rectangle":
        area = F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2)) * size
    else:
        after = lambda c: F.concat(F.slice(c, 2, F.size(c)), F.slice(c, 1, 1))
        cross = F.zip_with(F.zip_with("xs", after("ys"), lambda a, b: a * b), F.zip_with("ys", after("xs"), lambda a, b: a * b), lambda a, b: a - b)
        area = F.abs(F.aggregate(cross, F.lit(0.0), lambda a, x: a + x)) / 2
    return picks.select("pick_id", area.alias("area"))


def combine_in_picks(picked: DataFrame) -> DataFrame:
    """Each pick's rows merged into as few rows as can be: the n-th row of every frame goes to the n-th of them, as
    linking without limits of distance and time does."""
    nth = F.row_number().over(Window.partitionBy("pick_id", "frame").orderBy("loc_id"))
    return E.merge_rows(picked.withColumn("nth", nth.cast("long")), ["pick_id", "nth"])


def evaluate_picks(picked: DataFrame, pixelsize: float = 1.0, max_dark_time: int = 3) -> DataFrame:
    """(pick_id, n, n_events, rmsd, rmsd_z): rows, linked events and spreads of each pick; rmsd in nm."""
    has_z = "z" in picked.columns
    spread = [(F.sqrt(F.var_pop("x") + F.var_pop("y")) * pixelsize).alias("rmsd")] + ([F.stddev_pop("z").alias("rmsd_z")] if has_z else [])
    counts = picked.groupBy("pick_id").agg(F.count("*").alias("n"), *spread)
    linked = E.link_events(picked.drop("group").withColumnRenamed("pick_id", "group"), max_dark_time).groupBy(F.col("group").alias("pick_id")).agg(F.count("*").alias("n_events"))
    return counts.join(linked, "pick_id")


def pick_kinetics(picked: DataFrame, max_dark_time: int = 3) -> DataFrame:
    """(pick_id, locs, length_cdf, dark_cdf): events of each pick, and the time constants of their bright and dark times; picks
    without a dark time are left out."""
    steps = E.dark_times(E.link_events(picked.drop("group").withColumnRenamed("pick_id", "group"), max_dark_time)).select("group", "len", "dark")
    rates = [kinetic_rates(steps, "group", c).withColumnRenamed("rate", name) for c, name in (("len", "length_cdf"), ("dark", "dark_cdf"))]
    counts = steps.groupBy("group").agg(F.count("*").alias("locs"))
    return counts.join(rates[0], "group").join(rates[1], "group").withColumnRenamed("group", "pick_id")


def pick_properties(picked: DataFrame, max_dark_time: int = 3, influx_rate: float = 0.03, areas: DataFrame | None = None) -> DataFrame:
    """Kinetics of each pick, the number of binding units n_units = 1 / (influx_rate dark), the qPAINT index, mean and deviation
    of bright and dark times, and the area if there is a table of areas."""
    steps = E.dark_times(E.link_events(picked.drop("group").withColumnRenamed("pick_id", "group"), max_dark_time)).select("group", "len", "dark")
    means = E.group_properties(steps).withColumnRenamed("group", "pick_id").drop("qpaint_idx")
    out = means.join(pick_kinetics(picked, max_dark_time), "pick_id").withColumn("n_units", 1 / (influx_rate * F.col("dark_cdf"))).withColumn("qpaint_idx_cdf", 1 / F.col("dark_cdf"))
    return out if areas is None else out.join(areas.select("pick_id", F.col("area").alias("pick_area_um2")), "pick_id", "left")


def filter_picks(picks: DataFrame, picked: DataFrame, least: int, most: int) -> DataFrame:
    """Picks with between least and most rows (inclusive); picks without rows have 0."""
    counts = picked.groupBy("pick_id").agg(F.count("*").alias("_n"))
    return picks.join(counts, "pick_id", "left").where(F.coalesce("_n", F.lit(0)).between(least, most)).drop("_n")


def pick_trace(picked: DataFrame, pick_id: int, frames: int) -> DataFrame:
    """(frame, n, photons) of one pick for every frame of the movie, 0 where it has no row."""
    own = picked.where(F.col("pick_id") == pick_id).groupBy("frame").agg(F.count("*").alias("n"), F.sum("photons").alias("photons"))
    every = picked.sparkSession.range(frames).select(F.col("id").alias("frame"))
    return every.join(own, "frame", "left").select("frame", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("photons", F.lit(0.0)).alias("photons"))


def profile(picked: DataFrame, bins: int, length: float) -> DataFrame:
    """(pick_id, bin, n): rows of rectangular picks by their place along the axis."""
    at = F.least(F.floor(F.col("x_pick_rot") / (length / bins)), F.lit(bins - 1)).cast("long")
    return picked.groupBy("pick_id", at.alias("bin")).agg(F.count("*").alias("n"))


def find_fiducials(locs: DataFrame, width: int, height: int, frames: int, pixelsize: float = 130.0) -> tuple[DataFrame, int]:
    """((pick_id, x, y), box): bright spots of the image at one pixel a pixel, blurred by one pixel, around which more than 0.8 of
    the frames have rows. box: about 900 nm in pixels, odd.

    The spots are local maxima over a box whose net gradient is above the 99th percentile of the pixels. The image is as large
    as a frame of the camera, whatever the rows, and is searched like one.
    """
    box = round(900 / pixelsize)
    box += 1 - box % 2
    image = checkpointed(blur(render_histogram(locs, 1.0, 0.0, 0.0, width, height), 1.0, height, width))
    rank = 0.99 * (width * height - 1) - (width * height - image.count())  # among pixels with a value, all others being 0
    q, share = max(rank, 0.0) / max(image.count() - 1, 1), min(max(rank + 1, 0.0), 1.0)
    level = image.agg(F.percentile("value", min(q, 1.0))).first()[0] or 0.0
    spots = D.identify(D.movie_of(image.withColumn("frame", F.lit(0).cast("long")), height, width, "float64"), level * share, box)
    at = spots.select((F.col("y") * width + F.col("x")).alias("pick_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    counts = picked_locs(locs, at, "circle", box / 2).groupBy("pick_id").agg(F.count("*").alias("_n"))
    return at.join(counts.where(F.col("_n") > 0.8 * frames).select("pick_id"), "pick_id", "left_semi"), box


def undrift_from_fiducials(locs: DataFrame, width: int, height: int, frames: int, pixelsize: float = 130.0, at: tuple[DataFrame, float] | None = None, z: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows set right, drift) from the fiducials that are found, or from circular picks (pick_id, x, y) and a radius as `at`;
    z: also along z where rows have it. Without picks, or rows in them, a ValueError."""
    if at is None:
        found, box = find_fiducials(locs, width, height, frames, pixelsize)
        at = checkpointed(found), box / 2
    picked = picked_locs(locs, at[0], "circle", at[1])
    drift = checkpointed(picked_drift(picked if z else picked.drop("z"), frames))
    if drift.isEmpty():
        raise ValueError("no rows in picks to take a drift from")
    return apply_drift(locs, drift, frames), drift
