"""Particle averaging: groups are turned and moved, round after round, to where they fit the sum of all groups best."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, small

#: Rows of a group that one task turns, and pixels along a side of the image, which every task holds.
ROWS, SIDE = 200_000, 2048


#: Cells of images that are correlated at once.
CELLS = 1 << 21


def _peaks(images: np.ndarray, template: np.ndarray) -> list[tuple[float, int, int]]:
    """Of each image the greatest value of the correlation with the conjugate transform of the template, and its place. Counts have
    whole correlations, so these are rounded, and equal ones stay equal."""
    side = images.shape[1]
    found = np.rint(np.fft.fftshift(np.fft.irfft2(np.fft.rfft2(images) * template, s=(side, side)), axes=(1, 2))).reshape(len(images), -1)
    at = found.argmax(axis=1)
    return [(float(f[k]), *divmod(int(k), side)) for f, k in zip(found, at)]


def best_fit(x: np.ndarray, y: np.ndarray, angles: np.ndarray, template: np.ndarray, scale: float, reach: float, n: np.ndarray | None = None) -> tuple[float, float, float]:
    """(angle, dx, dy): of the angles the first whose turned rows correlate best with the template, and how far they then lie off.
    n: the number of rows at each place, else one."""
    side, best = len(template), (0.0, 0.0, 0.0, 0.0)
    some = max(1, min(CELLS // (side * side), CELLS // max(len(x), 1)))
    for first in range(0, len(angles), some):
        part = angles[first : first + some]
        c, s = np.cos(part)[:, None], np.sin(part)[:, None]
        px, py = c * x - s * y, s * x + c * y
        inside = (np.abs(px) < reach) & (np.abs(py) < reach)
        row, column = ((scale * (p + reach)).astype(np.int64) for p in (py, px))
        cell = (np.arange(len(part))[:, None] * side + row) * side + column
        rows = None if n is None else np.broadcast_to(n, cell.shape)[inside]
        images = np.bincount(cell[inside], rows, minlength=len(part) * side * side).reshape(-1, side, side)
        for angle, (value, i, j) in zip(part, _peaks(images, template)):
            if value > best[0]:
                best = (value, float(angle), math.ceil(j - side / 2) / scale, math.ceil(i - side / 2) / scale)
    return best[1:]


FIT = "group long, angle double, dx double, dy double"


def average_particles(locs: DataFrame, pixelsize: float, display: float = 5.0, rounds: int = 3, limit: int = ROWS) -> DataFrame:
    """Rows (any columns) with x, y so that the groups lie over each other about 0, 0.

    Groups are centred on their means. In each round an image of all rows is drawn, with pixels of `display` nm, up to twice the
    root mean square distance from the middle; each group is turned by every angle that moves its edge by a pixel and goes to the
    angle and shift whose correlation with that image is greatest. Then all rows are centred again. The image is the sum of counts of
    rows by pixel; it and the groups' angles and shifts are all that is collected or sent, and at most SIDE pixels wide. A group of more
    than `limit` places is drawn by Spark, angle by angle. Rows with null x, y or group go; groups of one row stay where they are.
    Equal values go to the first angle. An empty table gives none. Rows of a group at one place stay together, so the rounds turn
    and move places with the number of their rows; the rows, with their other columns, get their place's x, y at the end.
    """
    others = [c for c in locs.columns if c not in ("x", "y")]
    rows = locs.select(*others, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna(subset=["x", "y", "group"])
    rows = checkpointed(rows)
    sums = [(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(f"_m{c}") for c in ("x", "y")]
    places = checkpointed(rows.groupBy("group", "x", "y").agg(F.count("*").alias("n")))
    means = checkpointed(places.groupBy("group").agg(*sums))
    spots = places.withColumnsRenamed({"x": "_x", "y": "_y"}).join(small(means), "group").withColumns({"x": F.col("_x") - F.col("_mx"), "y": F.col("_y") - F.col("_my")})
    spots = checkpointed(spots.drop("_mx", "_my"))
    square = spots.agg(F.sum((F.col("x") * F.col("x") + F.col("y") * F.col("y")) * F.col("n")) / F.sum("n")).first()[0]
    if not square:
        return _placed(rows, spots).select(*locs.columns)
    reach, scale = 2 * math.sqrt(square), pixelsize / display
    side = math.ceil(scale * 2 * reach)
    if side > SIDE:
        raise ValueError(f"the image would be {side} pixels wide; take larger display pixels")
    angles = np.arange(0, 2 * math.pi, math.asin(min(1.0, 1 / (scale * reach))))
    large = checkpointed(spots.groupBy("group").count().where(F.col("count") > limit).select("group"))
    for _ in range(rounds):
        pixel = lambda c: F.floor(F.lit(scale) * (F.col(c) + reach)).cast("int")
        inside = (F.abs(F.col("x")) < reach) & (F.abs(F.col("y")) < reach)
        image = np.zeros((side, side))
        for r in spots.where(inside).groupBy(pixel("y").alias("i"), pixel("x").alias("j")).agg(F.sum("n").alias("n")).collect():
            image[r["i"], r["j"]] = r["n"]
        template = np.conj(np.fft.rfft2(image))

        def fit(own: pd.DataFrame) -> pd.DataFrame:
            found = best_fit(own["x"].to_numpy(), own["y"].to_numpy(), angles, template, scale, reach, own["n"].to_numpy())  # noqa: B023
            return pd.DataFrame([[own["group"].iloc[0], *found]], columns=["group", "angle", "dx", "dy"])

        fits = spots.join(F.broadcast(large), "group", "left_anti").select(F.col("group").cast("long").alias("group"), "x", "y", "n").groupBy("group").applyInPandas(fit, FIT)
        if not large.isEmpty():
            fits = fits.unionByName(_fit_large(spots.join(F.broadcast(large), "group", "left_semi"), angles, template, scale, reach))
        fits = checkpointed(fits.select("group", *[F.col(c).alias(f"_{c}") for c in ("angle", "dx", "dy")]))
        x = F.cos("_angle") * F.col("x") - F.sin("_angle") * F.col("y") - F.col("_dx")
        y = F.sin("_angle") * F.col("x") + F.cos("_angle") * F.col("y") - F.col("_dy")
        moved = checkpointed(spots.join(small(fits), "group").withColumns({"x": x, "y": y}).drop("_angle", "_dx", "_dy"))
        mx, my = moved.agg(*sums).first()
        spots = moved.withColumns({"x": F.col("x") - mx, "y": F.col("y") - my})
    return _placed(rows, spots).select(*locs.columns)


def _placed(rows: DataFrame, spots: DataFrame) -> DataFrame:
    """rows with the x, y that their place (group, _x, _y) has come to."""
    came = spots.select("group", "_x", "_y", F.col("x").alias("_nx"), F.col("y").alias("_ny"))
    return rows.withColumnsRenamed({"x": "_x", "y": "_y"}).join(came.hint("merge"), ["group", "_x", "_y"]).withColumnsRenamed({"_nx": "x", "_ny": "y"})


def _fit_large(rows: DataFrame, angles: np.ndarray, template: np.ndarray, scale: float, reach: float) -> DataFrame:
    """best_fit for groups whose images Spark counts, a task for each group and angle."""
    side = len(template)
    turns = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(math.cos(a))).alias("c"), F.lit(float(math.sin(a))).alias("s")) for k, a in enumerate(angles)]))
    turned = rows.select(F.col("group").cast("long").alias("group"), "x", "y", "n", turns.alias("t"))
    turned = turned.select("group", "t.k", "n", (F.col("t.c") * F.col("x") - F.col("t.s") * F.col("y")).alias("x"), (F.col("t.s") * F.col("x") + F.col("t.c") * F.col("y")).alias("y"))
    pixel = lambda c: F.floor(F.lit(scale) * (F.col(c) + reach)).cast("int")
    counts = turned.where((F.abs(F.col("x")) < reach) & (F.abs(F.col("y")) < reach)).groupBy("group", "k", pixel("y").alias("i"), pixel("x").alias("j")).agg(F.sum("n").alias("count"))

    def peak(own: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((side, side))
        image[own["i"], own["j"]] = own["count"]
        ((value, row, column),) = _peaks(image[None], template)
        k = int(own["k"].iloc[0])
        return pd.DataFrame([[own["group"].iloc[0], value, -k, float(angles[k]), math.ceil(column - side / 2) / scale, math.ceil(row - side / 2) / scale]], columns=["group", "value", "k", "angle", "dx", "dy"])

    each = counts.groupBy("group", "k").applyInPandas(peak, "group long, value double, k int, angle double, dx double, dy double")
    best = each.where("value > 0").groupBy("group").agg(F.max(F.struct("value", "k", "angle", "dx", "dy")).alias("b"))
    ones = rows.select(F.col("group").cast("long").alias("group")).distinct().join(best, "group", "left")
    return ones.select("group", *[F.coalesce(f"b.{c}", F.lit(0.0)).alias(c) for c in ("angle", "dx", "dy")])
