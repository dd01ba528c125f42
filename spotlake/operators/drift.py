"""Drift by intersections: each segment of a movie is moved to where most of its occupied cells meet those of a reference.

A segment starts from where the one before it was found, so segments follow one another; the counting within each is one join.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registration import spline
from .shared import stored


def counted_cells(rows: DataFrame, sides: dict[str, float], moved: dict[str, float] | None = None) -> DataFrame:
    """(c_<axis>..., n): rows per cell of the given sides, after moving them; cells are centred on the multiples of a side."""
    at = lambda c: F.rint((F.col(c) + (moved or {}).get(c, 0.0)) / sides[c]).cast("long").alias(f"c_{c}")
    return rows.groupBy(*[at(c) for c in sides]).agg(F.count("*").alias("n"))


def overlaps(reference: DataFrame, cells: DataFrame, axes: list[str], moving: list[str], reach: int) -> np.ndarray:
    """Sum over cells of the smaller count for every shift of `cells` by up to `reach` cells along the moving axes, of which the
    driver sees (2 reach + 1) ** len(moving) values."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    for c in moving:
        cells = cells.withColumn(f"s_{c}", F.explode(steps)).withColumn(f"c_{c}", F.col(f"c_{c}") + F.col(f"s_{c}"))
    met = reference.join(cells.withColumnRenamed("n", "m"), [f"c_{c}" for c in axes])
    found = met.groupBy(*[f"s_{c}" for c in moving]).agg(F.sum(F.least("n", "m")).alias("n")).collect()
    counts = np.zeros((2 * reach + 1,) * len(moving))
    for r in found:
        counts[tuple(r[f"s_{c}"] + reach for c in moving)] = r["n"]
    return counts


def harmonic_peak(counts: np.ndarray, span: float) -> float:
    """Place of the peak, from the middle, of counts over a window `span` wide: the phase of their first harmonic. Without counts 0."""
    n = len(counts)
    if not counts.any():
        return 0.0
    angle = np.angle((counts * np.exp(-2j * np.pi * np.arange(n) / n)).sum())
    return float(((-angle) % (2 * np.pi) * n / (2 * np.pi) - (n - 1) / 2) * span / n)


def _track(segments: DataFrame, reference: DataFrame, count: int, start: int, sides: dict[str, float], moving: list[str], radius: float) -> np.ndarray:
    """Drift of each segment along the moving axes, one row a segment; one without rows repeats that before it."""
    reach = math.ceil(radius)
    place, found = dict.fromkeys(moving, 0.0), np.zeros((count, len(moving)))
    for s in range(start, count):
        cells = counted_cells(segments.where(F.col("_segment") == s), sides, place)
        counts = overlaps(reference, cells, list(sides), moving, reach)
        for i, c in enumerate(moving):
            others = tuple(j for j in range(len(moving)) if j != i)
            place[c] += harmonic_peak(counts.sum(axis=others), 2 * radius * sides[c])
            found[s, i] = -place[c]
    return found


def _moved(rows: DataFrame, drift: dict[str, np.ndarray], first: int, broadcast_frames: int = 1_000_000) -> DataFrame:
    """Rows less the drift of their frames; the table of one row a frame is broadcast for up to broadcast_frames."""
    side = drift_table(rows, drift, first)
    side = F.broadcast(side) if side.count() <= broadcast_frames else side
    return rows.join(side, "frame").withColumns({c: F.col(c) - F.col(f"d{c}") for c in drift}).drop(*[f"d{c}" for c in drift])


def drift_table(rows: DataFrame, drift: dict[str, np.ndarray], first: int) -> DataFrame:
    """(frame, d<axis>...): one row a frame, which the movie bounds."""
    names = list(drift)
    values = [(first + i, *map(float, v)) for i, v in enumerate(zip(*drift.values(), strict=True))]
    return rows.sparkSession.createDataFrame(values, ", ".join(["frame long", *[f"d{c} double" for c in names]]))


def intersection_drift(locs: DataFrame, frames: int, per_segment: int = 100, side: float = 20 / 130, radius: float = 60 / 130, pixelsize: float | None = None) -> DataFrame:
    """(frame, dx, dy): drift of each frame in two rounds, against the first segment and against all rows; its mean is 0.

    Segments hold per_segment frames from the first frame on. side: that of a cell, radius: of the search, both in pixels. With a
    pixelsize there is dz too, from z in nm in the same way once x and y are set right. Without rows the drift is 0. Each step
    reads its own segment and joins it with the counted cells of the reference, so the work is that of the reference's cells
    times the segments; rows of each round are written once, by segment.
    """
    first = locs.agg(F.min("frame")).first()[0] or 0
    axes = ["x", "y"] + (["z"] if pixelsize else [])
    if frames < 1:
        return locs.sparkSession.createDataFrame([], ", ".join(["frame long", *[f"d{c} double" for c in axes]]))
    count = math.ceil(frames / per_segment)
    edges = np.minimum(np.arange(count + 1) * per_segment, frames)
    middle, every = (edges[1:] + edges[:-1]) / 2, np.arange(1, frames + 1)
    number: Column = F.floor((F.col("frame") - first) / per_segment).cast("long")
    rows = locs.select("frame", *axes, number.alias("_segment")).where(F.col("_segment").between(0, count - 1))

    def search(rows: DataFrame, sides: dict[str, float], moving: list[str]) -> tuple[DataFrame, dict[str, np.ndarray]]:
        total = {c: np.zeros(frames) for c in moving}
        for turn in (0, 1):
            dealt = stored(rows, "_segment")
            reference = stored(counted_cells(dealt if turn else dealt.where("_segment = 0"), sides))
            found = _track(dealt, reference, count, 1 - turn, sides, moving, radius / side)
            part = {c: spline(middle, found[:, i], every) for i, c in enumerate(moving)}
            rows = _moved(dealt, part, first)
            total = {c: total[c] + part[c] for c in moving}
        return rows, {c: v - v.mean() for c, v in total.items()}

    flat = {"x": side, "y": side}
    rows, drift = search(rows, flat, ["x", "y"])
    if pixelsize:
        drift |= search(rows, flat | {"z": side * pixelsize}, ["z"])[1]
    return drift_table(locs, drift, first)
