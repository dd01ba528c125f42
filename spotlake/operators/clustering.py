"""Clusters about local maxima of neighbour counts, and what is built on them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import events as E
from . import graphs as G
from . import spatial as S
from .blocks import place_counts, places, surpassed
from .columns import sums_around, surpassed_around
from .shared import checkpointed

NENA = ("delta_a", "s", "ac", "dc", "sc")


def cluster(locs: DataFrame, r: float, min_locs: int, r_z: float | None = None, frame_analysis: bool = False) -> DataFrame:
    """Adds `cluster` (the loc_id of a local maximum); rows outside clusters go.

    A row is a local maximum if it has more than min_locs rows within r, itself included, and no row within r has more. In
    order of loc_id, a maximum that is in no cluster takes all rows within r, those of earlier clusters included; one that
    is in a cluster gives that to the rows within r that are in none. Clusters of fewer than min_locs rows go; frame_analysis: also
    those that the movie's time does not spread over. r_z: radius along z, else z is ignored. Rows without coordinates are in none.

    So a maximum opens a cluster unless an earlier one lies within r. One that does not is in the cluster of the last earlier
    opener within r or, without any, in that of the first earlier maximum there; following these leads to an opener. Of
    maxima at one place only the first has a say, as the others reach the same rows. So all is done by places, of which rows
    get their cluster at the end.
    """
    stretch = None if r_z is None else r / r_z
    space = ["x", "y"] if r_z is None else ["x", "y", "z"]
    spots = checkpointed(places(locs, stretch))
    counts = place_counts(spots, r, True) if stretch is None else sums_around(spots, r, stretch)
    dense = checkpointed(counts.where(F.col("others") + 1 > min_locs).select("loc_id", *space, F.col("others").alias("n")))
    lower = surpassed(dense, "n", r) if stretch is None else surpassed_around(dense, "n", r, stretch)
    maxima = checkpointed(dense.join(lower.hint("merge"), "loc_id", "left_anti").select("loc_id", *space))
    ties = checkpointed(S.ball_join(maxima, maxima, r, stretch).select(F.col("l.loc_id").alias("u"), F.col("r.loc_id").alias("v")).where("v < u"))
    late = ties.select(F.col("u").alias("v")).distinct().withColumn("late", F.lit(True))
    led = checkpointed(ties.join(late, "v", "left").groupBy("u").agg(F.coalesce(F.max(F.when(F.col("late").isNull(), F.col("v"))), F.min("v")).alias("v")))
    while True:  # each round halves the way to the opener
        onward = led.join(led.select(F.col("u").alias("v"), F.col("v").alias("w")), "v", "left")
        if onward.where("w is not null").isEmpty():
            break
        led = checkpointed(onward.select("u", F.coalesce("w", "v").alias("v")))
    given = maxima.join(led.select(F.col("u").alias("loc_id"), F.col("v").alias("cluster")), "loc_id", "left")
    given = given.select("loc_id", *space, F.coalesce("cluster", "loc_id").alias("cluster"), F.col("cluster").isNull().alias("opens"))
    reached = S.ball_join(spots, checkpointed(given), r, stretch).groupBy(F.col("l.loc_id").alias("loc_id")).agg(
        F.max(F.when(F.col("r.opens"), F.struct("r.loc_id", "r.cluster")))["cluster"].alias("last"), F.min(F.when(~F.col("r.opens"), F.struct("r.loc_id", "r.cluster")))["cluster"].alias("first")
    )
    labels = checkpointed(reached.select("loc_id", F.coalesce("last", "first").alias("cluster")))
    labels = labels.join(spots.hint("merge"), "loc_id")
    large = labels.groupBy("cluster").agg(F.sum("n").alias("n")).where(F.col("n") >= min_locs).select("cluster")
    kept = labels.join(large.hint("merge"), "cluster", "left_semi").select(*space, "cluster")
    out = locs.join(kept.hint("merge"), space).select("loc_id", *[c for c in locs.columns if c != "loc_id"], "cluster")
    if not frame_analysis:
        return out
    rows = out.withColumnRenamed("group", "_group") if "group" in out.columns else out
    kept = E.drop_uneven_clusters(rows.withColumnRenamed("cluster", "group")).withColumnRenamed("group", "cluster")
    return kept.withColumnRenamed("_group", "group") if "group" in out.columns else kept


def resi(channels: dict[str, tuple[DataFrame, float, int]], pixelsize: float | None = None) -> DataFrame:
    """Cluster centres of each channel (rows, radius, least rows), as one table with `resi_channel`."""
    out = None
    for name, (rows, r, least) in channels.items():
        found = cluster(rows, r, least, frame_analysis=True)
        centers = E.cluster_centers(found.drop("group").withColumnRenamed("cluster", "group"), pixelsize).withColumn("resi_channel", F.lit(name))
        out = centers if out is None else out.unionByName(centers, allowMissingColumns=True)
    return out


def link(locs: DataFrame, r: float, max_dark_time: int, frames: int | None = None) -> DataFrame:
    """Rows of chains in time and space merged into events; frames: the movie's length, whose first and last frame events must
    then not touch. An empty table gives none."""
    chains = E.merge_rows(G.link_near(locs, r, max_dark_time), ["group", "event"])
    return chains if frames is None else chains.where((F.col("frame") > 0) & (F.col("frame") + F.col("len") - 1 < frames))


def subclustering(molecules: DataFrame, near: float, far: float) -> DataFrame:
    """(loc_id, n_events, kind): molecules whose nearest neighbour is closer than `near` (clustered) or at least `far` away
    (sparse); the others are left out."""
    if far <= near:
        raise ValueError("the sparse distance must exceed the clustering distance")
    first = S.nearest_neighbours(molecules, molecules, 1, near, same=True).select("loc_id", "d")
    kind = F.when(F.col("d") < near, "clustered").when(F.col("d") >= far, "sparse")
    return molecules.select("loc_id", "n_events").join(first, "loc_id").select("loc_id", "n_events", kind.alias("kind")).where("kind is not null")


def hull_areas(rows: DataFrame, key: str) -> DataFrame:
    """(key, area, corners): area of the convex hull of each key's rows. Each key first keeps the extreme rows of 16
    directions, and those beyond the lines between neighbouring extremes, so that a key's task holds few of its rows."""
    ways = [(math.cos(math.pi * i / 8), math.sin(math.pi * i / 8)) for i in range(16)]
    top = lambda c, s: F.max(F.struct((F.col("x") * c + F.col("y") * s).alias("h"), "x", "y"))
    frame = rows.where("x is not null and y is not null").groupBy(key).agg(F.array(*[top(c, s) for c, s in ways]).alias("_e"))
    edge = lambda i: (F.col("_e")[(i + 1) % 16]["x"] - F.col("_e")[i]["x"]) * (F.col("y") - F.col("_e")[i]["y"]) - (F.col("_e")[(i + 1) % 16]["y"] - F.col("_e")[i]["y"]) * (F.col("x") - F.col("_e")[i]["x"])
    outside = F.lit(False)
    for i in range(16):
        outside |= edge(i) < 0
    corners = frame.select(key, F.explode("_e").alias("e")).select(key, "e.x", "e.y").unionAll(rows.select(key, "x", "y").join(frame, key).where(outside).select(key, "x", "y")).distinct()

    def area(points: pd.DataFrame) -> pd.DataFrame:
        order = sorted(zip(points["x"], points["y"], strict=True))
        hull: list[tuple[float, float]] = []
        for side in (order, order[::-1]):
            chain: list[tuple[float, float]] = []
            for p in side:
                while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]):
                    chain.pop()
                chain.append(p)
            hull += chain[:-1]
        x, y = (np.array(c) for c in zip(*(hull or order[:1]), strict=True))
        return pd.DataFrame({key: [points[key].iloc[0]], "area": abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2, "corners": len(hull)})

    kind = dict(rows.dtypes)[key]
    return corners.groupBy(key).applyInPandas(area, f"`{key}` {kind}, area double, corners long")


def nena(locs: DataFrame, bin_size: float = 0.001, d_max: float = 1.0) -> dict[str, float]:
    """Localization precision from distances of rows in consecutive frames: parameters of the fitted curve, of which s is the
    precision. All pairs count; the driver sees a histogram of d_max / bin_size rows. Without pairs, s is NaN.

    The curve: one emitter seen twice (Rayleigh, of width s, and share a = ac + delta_a) and a Gaussian of others (ac, dc, sc).
    """
    counts = np.zeros(int(math.ceil(d_max / bin_size - 1e-9)))
    for r in S.next_frame_distances(locs, bin_size, d_max).collect():
        if r["bin"] < len(counts):
            counts[r["bin"]] = r["n"]
    lp = float(np.mean(locs.agg(F.median("lpx"), F.median("lpy")).first())) if counts.any() else math.nan
    return fit_nena(counts, bin_size, lp)


def fit_nena(counts: np.ndarray, bin_size: float, lp: float) -> dict[str, float]:
    """The curve's parameters for a histogram of distances, from lp as a first precision; all NaN for an empty one."""
    if not counts.any():
        return dict.fromkeys(NENA, math.nan)
    d = (np.arange(len(counts)) + 0.5) * bin_size
    area = float(((counts[1:] + counts[:-1]) / 2).sum() * bin_size)

    def curve(p: np.ndarray) -> np.ndarray:
        delta, s, ac, dc, sc = p
        return (ac + delta) * d / (2 * s * s) * np.exp(-(d**2) / (4 * s * s)) + ac / (sc * math.sqrt(2 * math.pi)) * np.exp(-0.5 * ((d - dc) / sc) ** 2)

    p, damping = np.array([0.8 * area, lp, 0.1 * area, 2 * lp, lp]), 1e-3
    loss = ((counts - curve(p)) ** 2).sum()
    for _ in range(400):
        steps = np.maximum(np.abs(p), 1e-6) * 1e-6
        slope = np.stack([(curve(p + e) - curve(p - e)) / (2 * e.sum()) for e in np.diag(steps)], axis=1)
        square = slope.T @ slope
        new = np.maximum(p + np.linalg.solve(square + damping * np.diag(np.diag(square) + 1e-12), slope.T @ (counts - curve(p))), [0, 1e-6, 0, 0, 1e-6])
        after = ((counts - curve(new)) ** 2).sum()
        if after < loss:
            done = loss - after < 1e-10 * loss
            p, loss, damping = new, after, max(damping / 5, 1e-12)
            if done:
                break
        else:
            damping *= 5
            if damping > 1e12:
                break
    return dict(zip(NENA, p.tolist(), strict=True))


def filter_steps(info: list[dict], columns: list[str]) -> tuple[dict[str, tuple[float, float]], list[str], list[str]]:
    """(ranges, columns to drop, missing columns) of the filters that descriptions record: of several ranges of a column the
    intersection holds."""
    lists = [(name, v) for step in info if "Filter" in str(step.get("Generated by", "")) for name, v in step.items() if isinstance(v, (list, tuple))]
    gone = pd.Series([c for name, v in lists if name == "Removed columns" for c in v], dtype=object)
    numbers = [(name, *v) for name, v in lists if name != "Removed columns" and len(v) == 2 and all(isinstance(x, (int, float)) for x in v)]
    ranges = pd.DataFrame(numbers, columns=["column", "low", "high"]).groupby("column", sort=False).agg({"low": "max", "high": "min"}).astype(float)
    here = ranges[ranges.index.isin(columns)]
    absent = pd.Index([*ranges.index.difference(here.index, sort=False), *gone[~gone.isin(columns)]], dtype=object).unique()
    return {c: (low, high) for c, low, high in here.itertuples()}, gone[gone.isin(columns)].tolist(), absent.tolist()


def apply_filter_steps(locs: DataFrame, info: list[dict]) -> DataFrame:
    """Rows strictly inside the recorded ranges, without the removed columns; columns that are missing are passed over."""
    ranges, dropped, _ = filter_steps(info, locs.columns)
    for name, (low, high) in ranges.items():
        locs = locs.where((F.col(name) > low) & (F.col(name) < high))
    return locs.drop(*dropped)


def range_2d(locs: DataFrame, a: str, b: str, a_range: tuple[float, float], b_range: tuple[float, float]) -> DataFrame:
    """Rows strictly inside a rectangle of two columns."""
    return locs.where((F.col(a) > a_range[0]) & (F.col(a) < a_range[1]) & (F.col(b) > b_range[0]) & (F.col(b) < b_range[1]))


def valid_labels(locs: DataFrame, labels: DataFrame, column: str = "group") -> DataFrame:
    """Rows with a label (loc_id, label) other than -1, which becomes `column`."""
    return locs.drop(column).join(labels.where("label is not null and label <> -1").select("loc_id", F.col("label").alias(column)), "loc_id")


def filter_clusters(locs: DataFrame, clusters: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows of the groups whose value in a table of clusters is strictly inside a range."""
    return locs.join(clusters.where((F.col(column) > low) & (F.col(column) < high)).select("group").distinct(), "group", "left_semi")


def binned_times(locs: DataFrame, width: int) -> DataFrame:
    """(group, slice, n): rows of each group in slices of `width` frames, with the share of the group's rows up to the slice."""
    counts = locs.groupBy("group", F.floor(F.col("frame") / width).alias("slice")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("group").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select("group", "slice", "n", (F.sum("n").over(upto) / F.sum("n").over(Window.partitionBy("group"))).alias("share"))
