"""Binding events: linking in time, dark times, group properties, cluster centres."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MEANS = ("sx", "sy", "ellipticity", "net_gradient", "likelihood", "log_likelihood", "iterations", "d_zcalib")


def _ordered(*keys: str):
    return Window.partitionBy(*keys).orderBy("frame", "loc_id")


def event_numbers(locs: DataFrame, max_gap: int, out: str = "event") -> DataFrame:
    """Numbers the runs of each group in which consecutive frames differ by at most max_gap (gaps and islands)."""
    gap = F.col("frame") - F.lag("frame").over(_ordered("group"))
    fresh = F.when(gap.isNull() | (gap > max_gap), 1).otherwise(0)
    return locs.withColumn("_fresh", fresh).withColumn(out, F.sum("_fresh").over(_ordered("group").rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def merge_rows(locs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: first frame, positions weighted by precision, summed photons, plain means of fitted values."""
    has = set(locs.columns)
    aggs = [F.min("frame").alias("frame"), (F.max("frame") - F.min("frame") + 1).alias("len"), F.count("*").alias("n")]
    for axis in [a for a in ("x", "y", "z") if a in has]:
        lp = f"lp{axis}"
        if lp in has:
            w = 1 / (F.col(lp) * F.col(lp))
            aggs += [(F.sum(F.col(axis) * w) / F.sum(w)).alias(axis), F.sqrt(1 / F.sum(w)).alias(lp)]
        else:
            aggs.append(F.avg(axis).alias(axis))
    aggs += [F.sum(c).alias(c) for c in ("photons", "bg") if c in has]
    aggs += [F.avg(c).alias(c) for c in MEANS if c in has]
    out = locs.groupBy(*keys).agg(*aggs)
    return out.withColumn("photon_rate", F.col("photons") / F.col("n")) if "photons" in has else out


def link_events(locs: DataFrame, max_dark_time: int = 3, frames: int | None = None) -> DataFrame:
    """Binding events of each group without a spatial limit: frames at most max_dark_time dark frames apart are one event.

    frames: length of the movie; events that touch its first frame are then dropped, as their start is not known.
    """
    out = merge_rows(event_numbers(locs, max_dark_time + 1), ["group", "event"])
    return out if frames is None else out.where((F.col("frame") > 0) & (F.col("frame") + F.col("len") - 1 < frames))


def dark_times(events: DataFrame) -> DataFrame:
    """Adds `dark`, the frames since the latest end of an earlier event in the group; events without one are dropped."""
    ended = Window.partitionBy("group").orderBy("frame", "event").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("dark", F.col("frame") - F.max(F.col("frame") + F.col("len") - 1).over(ended)).where("dark > 0")


def group_properties(rows: DataFrame) -> DataFrame:
    """Per group: n_events, mean and sample deviation of every numeric column, and the rate of binding."""
    values = [c for c, kind in rows.dtypes if c != "group" and kind in ("bigint", "int", "double", "float")]
    rows = rows.where("dark <> -1") if "dark" in values else rows
    aggs = [f(c).alias(f"{c}_{name}") for c in values for f, name in ((F.avg, "mean"), (F.stddev_samp, "std"))]
    out = rows.groupBy("group").agg(F.count("*").alias("n_events"), *aggs)
    return out.withColumn("qpaint_idx", 1 / F.col("dark_mean")) if "dark" in values else out


def cluster_centers(locs: DataFrame, pixelsize: float | None = None) -> DataFrame:
    """One row per group: means, sample deviations, precisions, counts, events, area or volume."""
    has, runs = set(locs.columns), event_numbers(locs, 3)
    n = F.count("*")
    aggs = [F.avg(c).alias(c) for c in ("frame", "x", "y", "photons", "sx", "sy", "bg", "net_gradient") if c in has]
    aggs += [F.stddev_samp(c).alias(f"std_{c}") for c in ("frame", "x", "y")]
    aggs += [(F.stddev_samp("x") / F.sqrt(n)).alias("lpx"), (F.stddev_samp("y") / F.sqrt(n)).alias("lpy"), n.alias("n_locs"), F.max("event").alias("n_events")]
    if "z" in has:
        w = 1 / F.pow(F.col("lpx") + F.col("lpy"), 2)
        aggs += [(F.sum(F.col("z") * w) / F.sum(w)).alias("z"), F.stddev_samp("z").alias("std_z")]
    out = runs.groupBy("group").agg(*aggs).withColumn("ellipticity", F.col("sx") / F.col("sy"))
    spread = F.col("std_x") + F.col("std_y")
    if "z" in has and pixelsize:
        return out.withColumn("volume", F.lit(4.18879) * F.pow(F.lit(2 / 3) * (spread + F.col("std_z") / pixelsize), 3))
    return out.withColumn("area", F.lit(math.pi) * spread * spread)


def pick_statistics(picked: DataFrame, pixelsize: float) -> DataFrame:
    """Per pick: number of rows and the root mean square distance from their centre in nm."""
    rmsd = F.sqrt(F.var_pop("x") + F.var_pop("y")) * pixelsize
    return picked.groupBy("pick_id").agg(F.count("*").alias("n"), rmsd.alias("rmsd"))


def drop_uneven_clusters(locs: DataFrame, bins: int = 20, low: float = 0.2, high: float = 0.8, most: float = 0.8) -> DataFrame:
    """Keeps groups whose mean frame lies in the middle of the movie and of which no time bin holds most rows."""
    last = locs.agg((F.max("frame") + 1).alias("_frames"))
    rows = locs.join(F.broadcast(last)).withColumn("_bin", F.least(F.floor(F.col("frame") * bins / F.col("_frames")), F.lit(bins - 1)))
    counts = rows.groupBy("group", "_bin").agg(F.count("*").alias("_n"), F.sum("frame").alias("_sum"), F.first("_frames").alias("_frames"))
    per = counts.groupBy("group").agg(F.sum("_n").alias("_all"), F.max("_n").alias("_most"), (F.sum("_sum") / F.sum("_n")).alias("_mean"), F.first("_frames").alias("_frames"))
    good = per.where((F.col("_mean") >= low * F.col("_frames")) & (F.col("_mean") <= high * F.col("_frames")) & (F.col("_most") <= most * F.col("_all")))
    return locs.join(good.select("group"), "group", "left_semi")


def fret(acceptor: DataFrame, donor: DataFrame) -> DataFrame:
    """(frame, fret): efficiency per frame of summed traces, the last row of a frame counting; only values within 0..1."""
    trace = lambda df, name: df.groupBy("frame").agg(F.max_by(F.col("photons") - F.col("bg"), F.col("loc_id")).alias(name))
    both = trace(acceptor, "a").join(trace(donor, "d"), "frame", "full_outer")
    a, d = F.coalesce("a", F.lit(0.0)), F.coalesce("d", F.lit(0.0))
    return both.select("frame", F.when(a + d != 0, a / (a + d)).alias("fret")).where("fret > 0 and fret < 1")
