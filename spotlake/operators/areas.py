"""Areas and volumes of clusters from their own small images."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def smooth(image: np.ndarray, sigma: float = 2.0, reach: float = 4.0) -> np.ndarray:
    """Gaussian blur along all axes, edges mirrored."""
    k = int(reach * sigma + 0.5)
    w = np.exp(-(np.arange(-k, k + 1) ** 2) / (2 * sigma * sigma))
    for axis in range(image.ndim):
        padded = np.pad(image, [(k, k) if i == axis else (0, 0) for i in range(image.ndim)], "symmetric")
        image = np.apply_along_axis(np.convolve, axis, padded, w / w.sum(), "valid")
    return image


def otsu(values: np.ndarray, bins: int = 256) -> float:
    """The centre of the bin that parts the values into classes of the largest variance between; of equal values, that value."""
    if values.min() == values.max():
        return float(values.min())
    counts, edges = np.histogram(values, bins)
    centers = (edges[1:] + edges[:-1]) / 2
    below, mass = np.cumsum(counts), np.cumsum(counts * centers)
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return float(centers[np.nanargmax(np.where(above > 0, between, -1))])


def cluster_areas(locs: DataFrame, pixelsize: float | None = None) -> DataFrame:
    """(group, area): of each group, in squares of the median precision; with a pixelsize and z in nm, the volume in its cubes.

    Rows are counted in cells of half the median (1.25 of it along z) from the group's least place on; the image of a group,
    blurred by two cells, is parted by Otsu's threshold. A task holds the image of one group, as large as the group is wide,
    however many rows it has. Rows without a group or place are left out; the median is that of the precisions' means, to 1 part
    in 10,000 of the ranks.
    """
    axes = ["x", "y"] + (["z"] if pixelsize else [])
    rows = locs.where(F.col("group").isNotNull())
    for c in axes:
        rows = rows.where(F.col(c).isNotNull())
    middle = rows.agg(F.percentile_approx((F.col("lpx") + F.col("lpy")) / 2, 0.5, 10_000)).first()[0]
    side = {c: (middle or 1.0) / 2 * (2.5 * pixelsize if c == "z" else 1.0) for c in axes}
    ends = rows.groupBy("group").agg(*[f(c).alias(f"_{n}{c}") for c in axes for n, f in (("low", F.min), ("high", F.max))])
    wide = lambda c: F.greatest(F.ceil((F.col(f"_high{c}") - F.col(f"_low{c}")) / side[c]), F.lit(1)).cast("long")
    at = lambda c: F.least(F.floor((F.col(c) - F.col(f"_low{c}")) / side[c]), wide(c) - 1).cast("long")
    cells = rows.select("group", *axes).join(ends, "group").groupBy("group", *[wide(c).alias(f"n_{c}") for c in axes], *[at(c).alias(f"c_{c}") for c in axes]).agg(F.count("*").alias("n"))

    def measure(own: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros([int(own[f"n_{c}"].iloc[0]) for c in axes])
        image[tuple(own[f"c_{c}"].to_numpy() for c in axes)] = own["n"]
        image = smooth(image)
        cell = 1 / 4 if len(axes) == 2 else math.prod((0.5, 0.5, 1.25))
        return pd.DataFrame({"group": [own["group"].iloc[0]], "area": [float((image >= otsu(image)).sum() * cell)]})

    kind = dict(locs.dtypes)["group"]
    return cells.groupBy("group").applyInPandas(measure, f"`group` {kind}, area double")
