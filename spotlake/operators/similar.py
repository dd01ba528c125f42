"""Picks like given ones: seeds of a hexagonal grid climb to centres of mass; those with a like number and spread of rows stay."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, running_sums, small
from .spatial import picked_circles, spatial_join

#: Rows about a cell that one task holds, steps of a seed, and the distance below which it stands still.
ROWS, STEPS, STILL = 200_000, 500, 1e-3
NINE = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def pick_ranges(locs: DataFrame, picks: DataFrame, d: float, deviations: float) -> tuple[float, float, float, float]:
    """Least and greatest number of rows and spread (root mean square distance from their centre) of picks of diameter d: mean less
    and plus so many deviations. Picks without rows have none of either."""
    inside = picked_circles(locs.select("loc_id", "x", "y"), picks.select("pick_id", "x", "y"), d / 2)
    each = inside.groupBy("pick_id").agg(F.count("*").alias("n"), F.sqrt(F.var_pop("x") + F.var_pop("y")).alias("spread"))
    each = picks.select("pick_id").join(each, "pick_id", "left").na.fill(0, ["n"])
    n, n_dev, spread, spread_dev = each.agg(F.avg("n"), F.stddev_pop("n"), F.avg("spread"), F.stddev_pop("spread")).first()
    if n is None or spread is None:
        return math.inf, -math.inf, math.inf, -math.inf
    return max(2.0, n - deviations * n_dev), n + deviations * n_dev, spread - deviations * spread_dev, spread + deviations * spread_dev


def hexagonal_seeds(locs: DataFrame, d: float, width: float, height: float) -> DataFrame:
    """(seed, x, y): centres of circles of diameter d that cover the view, column after column; every other column is half a
    circle higher."""
    step = math.sqrt(3) * d / 2
    columns, lines = max(0, math.ceil((width - d / 2) / step)), max(0, math.ceil((height - d) / d))
    i, j = F.floor(F.col("id") / max(lines, 1)), F.col("id") % max(lines, 1)
    y = F.lit(d / 2) + j * d + F.when(i % 2 == 1, d / 2).otherwise(0.0)
    return locs.sparkSession.range(columns * lines).select(F.col("id").alias("seed"), (F.lit(d / 2) + i * step).alias("x"), y.alias("y"))


def _cells(df: DataFrame, r: float) -> DataFrame:
    return df.withColumn("cx", F.floor(F.col("x") / r).cast("long")).withColumn("cy", F.floor(F.col("y") / r).cast("long"))


def _about(df: DataFrame) -> DataFrame:
    """Rows in each of the nine cells about their own."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in NINE])
    return df.withColumn("s", F.explode(steps)).withColumn("cx", F.col("cx") + F.col("s.i")).withColumn("cy", F.col("cy") + F.col("s.j")).drop("s")


def _climb(seeds: pd.DataFrame, rows: pd.DataFrame, r: float) -> pd.DataFrame:
    """Where the seeds of a cell end, with the number and spread of the rows inside there."""
    x, y = rows["x"].to_numpy(float), rows["y"].to_numpy(float)
    out = []
    for seed, px, py in zip(seeds["seed"].tolist(), seeds["x"].tolist(), seeds["y"].tolist()):
        inside = (x - px) ** 2 + (y - py) ** 2 < r * r
        if inside.sum() < 2:
            continue
        for _ in range(STEPS + 1):
            nx, ny = x[inside].mean(), y[inside].mean()
            still = abs(nx - px) <= STILL and abs(ny - py) <= STILL
            px, py = nx, ny
            if still:
                break
            inside = (x - px) ** 2 + (y - py) ** 2 < r * r
            if inside.sum() < 2:
                break
        spread = math.sqrt(x[inside].var() + y[inside].var()) if inside.any() else None
        out.append((seed, px, py, int(inside.sum()), spread))
    return pd.DataFrame(out, columns=["seed", "x", "y", "n", "spread"])


CLIMBED = "seed long, x double, y double, n long, spread double"


def _climb_in_rounds(seeds: DataFrame, rows: DataFrame, r: float) -> DataFrame:
    """The same for cells with too many rows for one task: every round sums the rows inside each seed's circle."""
    going = checkpointed(seeds.select("seed", "cx", "cy", F.col("x").alias("px"), F.col("y").alias("py")))
    done = None
    for turn in range(STEPS + 2):
        inside = going.join(rows, ["cx", "cy"]).where((F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py")) < r * r)
        sums = inside.groupBy("seed", "cx", "cy", "px", "py").agg(F.count("*").alias("n"), F.avg("x").alias("nx"), F.avg("y").alias("ny"), F.sqrt(F.var_pop("x") + F.var_pop("y")).alias("spread"))
        few = going.join(sums.select("seed"), "seed", "left_anti").select("seed", "px", "py", F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("spread"))
        sums = checkpointed(sums)
        still = (F.abs(F.col("nx") - F.col("px")) <= STILL) & (F.abs(F.col("ny") - F.col("py")) <= STILL)
        # a seed that stands still ends at the mean of the rows that it had there
        ended = sums.where((F.col("n") >= 2) & still).select("seed", F.col("nx").alias("x"), F.col("ny").alias("y"), "n", "spread")
        lost = sums.where(F.col("n") < 2).select("seed", F.col("px").alias("x"), F.col("py").alias("y"), "n", "spread")
        out = ended if turn == 0 else ended.unionByName(lost).unionByName(few.select("seed", F.col("px").alias("x"), F.col("py").alias("y"), "n", "spread"))
        done = checkpointed(out) if done is None else done.unionByName(checkpointed(out))
        going = checkpointed(sums.where((F.col("n") >= 2) & ~still).select("seed", "cx", "cy", F.col("nx").alias("px"), F.col("ny").alias("py")))
        if going.isEmpty():
            break
    return done


def first_apart(candidates: DataFrame, order: str, d: float) -> DataFrame:
    """Of candidates (order, x, y), in that order, those more than d from all kept before. Rounds: whoever has no earlier rival is
    kept, and those near it go."""
    open_ones, kept = checkpointed(candidates), None
    while True:
        rivals = spatial_join(open_ones.select(order, "x", "y"), open_ones.select(order, "x", "y"), d, inclusive=True).where(f"r.{order} < l.{order}")
        now = checkpointed(open_ones.join(rivals.select(F.col(f"l.{order}").alias(order)).distinct(), order, "left_anti"))
        kept = now if kept is None else kept.unionByName(now)
        near = spatial_join(open_ones.select(order, "x", "y"), now.select("x", "y"), d, inclusive=True).select(F.col(f"l.{order}").alias(order)).distinct()
        open_ones = checkpointed(open_ones.join(near, order, "left_anti"))
        if open_ones.isEmpty():
            return kept


def pick_similar(locs: DataFrame, picks: DataFrame, d: float, width: float, height: float, deviations: float = 2.0, limit: int = ROWS) -> DataFrame:
    """(pick_id, x, y): circular picks of diameter d like the given ones (pick_id, x, y), which come first with their ids.

    Numbers of rows and spreads may differ from the mean of the given picks' by so many of their deviations. Seeds cover the view; each
    moves to the centre of mass of the rows within d / 2 until it stands still, among rows of the nine cells of side d / 2 about its
    first place. In order of their grid, those with a fitting number and spread that are more than d from all picks before are new
    picks; pick_id goes on from the largest. A cell with over `limit` rows about it is climbed in rounds of sums instead of in
    one task. Without given picks, or with rows in none of them, none are found. Rows need loc_id; those without x or y are nowhere.
    """
    r = d / 2
    given = checkpointed(picks.select("pick_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    rows = _about(_cells(locs.select("x", "y").dropna(), r))
    low, high, narrow, wide = pick_ranges(locs, given, d, deviations)
    if low > high:
        return given
    seeds = _cells(hexagonal_seeds(locs, d, width, height), r)
    weight = rows.groupBy("cx", "cy").agg(F.count("*").alias("_n")).where(F.col("_n") >= low)
    seeds = checkpointed(seeds.join(weight, ["cx", "cy"]))
    plain, crowded = seeds.where(F.col("_n") <= limit), seeds.where(F.col("_n") > limit)
    own = rows.join(small(checkpointed(plain.select("cx", "cy").distinct())), ["cx", "cy"], "left_semi")
    found = plain.groupBy("cx", "cy").cogroup(own.groupBy("cx", "cy")).applyInPandas(lambda a, b: _climb(a, b, r), CLIMBED)
    if not crowded.isEmpty():
        found = found.unionByName(_climb_in_rounds(crowded, rows.select("cx", "cy", "x", "y"), r))
    fit = checkpointed(found.where(F.col("n").between(low, high) & F.col("spread").between(narrow, wide)).select("seed", "x", "y"))
    near = spatial_join(fit, given.select("x", "y"), d, inclusive=True).select(F.col("l.seed").alias("seed")).distinct()
    new = first_apart(fit.join(near, "seed", "left_anti"), "seed", d)
    top = given.agg(F.max("pick_id")).first()[0]
    numbered = running_sums(new.withColumn("one", F.lit(1)), "seed", ["one"]).select((F.col("one") + top).alias("pick_id"), "x", "y")
    return given.select(F.col("pick_id").cast("long").alias("pick_id"), "x", "y").unionByName(numbered)
