"""k-means inside picks: seeds far from each other, then rounds of assignment and means, all picks at once by grouped sums."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, small

#: Rows of a pick that one task holds; rounds of assignment and means, and the greatest move of a centre at which they end.
ROWS, ROUNDS, STILL = 200_000, 300, 1e-9


def _squared(space: list[str], a: Column, b: Column) -> Column:
    return reduce(lambda s, c: s + (a[c] - b[c]) * (a[c] - b[c]), space, F.lit(0.0))


def far_seeds(rows: DataFrame, k: int, space: list[str], seed: int = 1) -> DataFrame:
    """(pick_id, centers): up to k rows of each pick, each drawn with a chance in proportion to its squared distance from the nearest
    seed before. A row's draw is a race whose time is -log(u) over that, u coming from its loc_id, so a draw is a grouped
    minimum. Picks with fewer different rows have fewer."""
    place = F.struct(*space)
    uniform = lambda step: (F.pmod(F.xxhash64("loc_id", F.lit(seed), F.lit(step)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    first = rows.groupBy("pick_id").agg(F.min(F.struct(uniform(0).alias("t"), "loc_id", place.alias("at"))).alias("s"))
    centers = checkpointed(first.select("pick_id", F.array("s.at").alias("centers")))
    for step in range(1, k):
        near = F.array_min(F.transform("centers", lambda c: _squared(space, place, c)))
        raced = rows.join(small(centers), "pick_id").withColumn("_near", near).where(F.col("_near") > 0)
        won = raced.groupBy("pick_id").agg(F.min(F.struct((-F.log(uniform(step)) / F.col("_near")).alias("t"), "loc_id", place.alias("at"))).alias("s"))
        grown = F.when(F.col("s").isNotNull(), F.concat("centers", F.array("s.at"))).otherwise(F.col("centers"))
        centers = checkpointed(centers.join(won, "pick_id", "left").select("pick_id", grown.alias("centers")))
    return centers


def assigned(rows: DataFrame, centers: DataFrame, space: list[str]) -> DataFrame:
    """rows with `cluster`, the number of the nearest of their pick's centres; ties to the smaller."""
    ranked = F.transform("centers", lambda c, i: F.struct(_squared(space, F.struct(*space), c).alias("d"), i.alias("i")))
    return rows.join(small(centers), "pick_id").withColumn("cluster", F.array_min(ranked)["i"]).drop("centers")


def _settled(own: pd.DataFrame, start: pd.DataFrame, axes: list[str]) -> pd.DataFrame:
    """The centres of one pick after its rounds."""
    x = own[axes].to_numpy(float)
    centers = np.array([[c[a] for a in axes] for c in start["centers"].iloc[0]], float)
    for _ in range(ROUNDS):
        near = ((x[:, None, :] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        n = np.bincount(near, minlength=len(centers))[:, None]
        total = np.stack([np.bincount(near, x[:, j], minlength=len(centers)) for j in range(len(axes))], axis=1)
        new = np.where(n > 0, total / np.maximum(n, 1), centers)
        gone, centers = ((new - centers) ** 2).sum(axis=1).max(), new
        if gone <= STILL * STILL:
            break
    return pd.DataFrame({"pick_id": [start["pick_id"].iloc[0]], "centers": [[dict(zip(axes, c)) for c in centers.tolist()]]})


def kmeans_in_picks(rows: DataFrame, k: int, space: tuple[str, ...] = ("x", "y"), seeds: DataFrame | None = None, seed: int = 1, limit: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """rows (loc_id, pick_id, ...) with `cluster` from 0, and (pick_id, cluster, place, n): the centres and how many rows each has.

    Rounds go on until no centre moves. seeds: (pick_id, centers) to start from, else far_seeds(). A pick with fewer different
    places than k has a cluster for each; a centre that loses all its rows stays where it is. Rows with a null coordinate or pick
    go. A pick of up to `limit` rows has its rounds in one task; larger ones share rounds of sums, in which no task holds a pick.
    """
    axes = list(space)
    rows = rows.dropna(subset=["pick_id", *axes]).withColumns({c: F.col(c).cast("double") for c in axes})
    centers = checkpointed(seeds if seeds is not None else far_seeds(rows, k, axes, seed))
    narrow = rows.select("pick_id", *axes)
    large = checkpointed(narrow.groupBy("pick_id").count().where(F.col("count") > limit).select("pick_id"))
    kind = f"pick_id {rows.schema['pick_id'].dataType.simpleString()}, centers array<struct<{','.join(f'{c}:double' for c in axes)}>>"
    ordinary = narrow.join(small(large), "pick_id", "left_anti").groupBy("pick_id")
    starts = centers.join(small(large), "pick_id", "left_anti").select(F.col("pick_id").alias("_pick"), "centers").withColumnRenamed("_pick", "pick_id")
    settled = ordinary.cogroup(starts.groupBy("pick_id")).applyInPandas(lambda own, start: _settled(own, start, axes), kind)
    settled = checkpointed(settled)
    centers = checkpointed(centers.join(small(large), "pick_id", "left_semi"))
    narrow = narrow.join(small(large), "pick_id", "left_semi")
    for _ in range(0 if large.isEmpty() else ROUNDS):
        means = assigned(narrow, centers, axes).groupBy("pick_id", "cluster").agg(*[F.avg(c).alias(c) for c in axes])
        old = centers.select("pick_id", F.posexplode("centers").alias("cluster", "_old"))
        both = old.join(means, ["pick_id", "cluster"], "left")
        moved = both.withColumn("_new", F.when(F.col(axes[0]).isNotNull(), F.struct(*axes)).otherwise(F.struct(*[F.col(f"_old.{c}").alias(c) for c in axes])))
        moved = checkpointed(moved.select("pick_id", "cluster", "_new", _squared(axes, F.col("_new"), F.col("_old")).alias("_gone")))
        centers = checkpointed(moved.groupBy("pick_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("cluster", "_new"))), lambda s: s["_new"]).alias("centers")))
        if (moved.agg(F.max("_gone")).first()[0] or 0.0) <= STILL * STILL:
            break
    centers = settled.unionByName(centers)
    found = assigned(rows, centers, axes)
    counts = found.groupBy("pick_id", "cluster").agg(F.count("*").alias("n"))
    places = centers.select("pick_id", F.posexplode("centers").alias("cluster", "place")).join(counts, ["pick_id", "cluster"], "left").na.fill(0, ["n"])
    return found, places
