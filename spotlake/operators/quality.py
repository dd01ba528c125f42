"""Quality of localization files: a row a file with means, event length, precision from neighbours in time and drift."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import events as E
from . import graphs as G
from . import registration as R
from . import spatial as S
from .clustering import fit_nena
from .shared import checkpointed

MEANS = ("frame", "x", "y", "photons", "sx", "sy", "bg", "lpx", "lpy", "ellipticity", "net_gradient", "z", "d_zcalib")
#: Images of a file start this many rows of pixels after those of the one before, so those of different files never meet.
APART = 1 << 32
SEGMENTS = 1000


def file_means(locs: DataFrame) -> DataFrame:
    """Per file: n_locs, last_frame, and mean and sample deviation of the columns MEANS (null where a file has none)."""
    has = set(locs.columns)
    value = lambda c: F.col(c).cast("double") if c in has else F.lit(None).cast("double")
    aggs = [f(value(c)).alias(f"{c}_{name}") for c in MEANS for f, name in ((F.avg, "mean"), (F.stddev_samp, "std"))]
    return locs.where(F.col("file").isNotNull()).groupBy("file").agg(F.count("*").alias("n_locs"), F.max("frame").cast("long").alias("last_frame"), *aggs)


def _precisions(rows: DataFrame, bin_size: float, d_max: float) -> DataFrame:
    """(group, nena_px): a fit to each file's histogram, of d_max / bin_size bins at most."""
    start = rows.groupBy("group").agg(*[F.percentile_approx(c, 0.5, 10_000).alias(c) for c in ("lpx", "lpy")]).select("group", ((F.col("lpx") + F.col("lpy")) / 2).alias("lp"))
    counts = S.next_frame_distances(rows, bin_size, d_max, by=["group"]).join(F.broadcast(start), "group")
    bins = int(math.ceil(d_max / bin_size - 1e-9))

    def fit(own: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(bins)
        inside = own[own["bin"] < bins]
        n[inside["bin"]] = inside["n"]
        lp = own["lp"].iloc[0]
        return pd.DataFrame({"group": own["group"].iloc[:1], "nena_px": fit_nena(n, bin_size, float(lp))["s"] if lp is not None and lp > 0 else math.nan})

    return counts.groupBy("group").applyInPandas(fit, "group long, nena_px double")


def _drifts(rows: DataFrame, lengths: dict[int, int], reach: int) -> DataFrame:
    """(group, drift_x, drift_y): the mean of each file's drift from about ten segments, all files correlated in one job."""
    edges = {}
    for group, frames in lengths.items():
        segments = max(1, round(frames / max(1, frames // 10)))
        edges[group] = np.linspace(0, frames - 1, segments + 1)
    # (frames - 1) / segments, as above: the width of a segment
    per = F.greatest(F.floor(F.col("frames") / 10), F.lit(1))
    segments = F.greatest(F.rint(F.col("frames") / per), F.lit(1.0))
    number = F.coalesce(F.least(F.floor(F.col("frame") / F.nullif((F.col("frames") - 1) / segments, F.lit(0.0))), segments - 1), F.lit(0)).cast("long")
    images = R.counted(rows.withColumn("_image", F.col("group") * SEGMENTS + number), "_image")
    images = images.withColumn("iy", F.col("iy") + F.floor(F.col("image") / SEGMENTS) * APART)
    shifts: dict[int, dict] = {}
    for (a, b), shift in R.image_shifts(R.cross_correlation(checkpointed(images), reach)).items():
        shifts.setdefault(a // SEGMENTS, {})[a % SEGMENTS, b % SEGMENTS] = shift
    found = []
    for group, frames in lengths.items():
        dx, dy = R.drift_curve(shifts.get(group, {}), edges[group], frames)
        found.append((group, float(dx.mean()), float(dy.mean())))
    return rows.sparkSession.createDataFrame(found, "group long, drift_x double, drift_y double")


def file_summaries(locs: DataFrame, movies: DataFrame, r: float = 0.05, max_dark_time: int = 3, bin_size: float = 0.001, d_max: float = 1.0, reach: int = 8) -> DataFrame:
    """One row per file of locs (file, loc_id, frame, x, y, lpx, lpy, ...; loc_id unique over all files).

    movies: (file, frames, pixelsize) of each; a file that is not described ends with its last frame and has no pixelsize,
    and of several descriptions that with the most frames counts. Columns: those of `file_means`, frames, pixelsize,
    locs_frame (rows a frame), len_mean (frames of the events that chains of rows at most r and max_dark_time apart make,
    without those that touch the movie's ends), nena_px and nena_nm, drift_x and drift_y (means over the movie, in pixels;
    shifts up to `reach` pixels between segments). What a file has no rows or events for is null. Rows without a file are left
    out; rows without frame, x or y count in n_locs and the means only. An empty table gives none. The driver sees a
    row for each file and a patch for each pair of its segments, so one call should get a bounded number of files, such as
    those of one micro-batch; their rows are not bounded.
    """
    described = movies.groupBy("file").agg(F.max(F.struct(F.col("frames").cast("long").alias("frames"), F.col("pixelsize").cast("double").alias("pixelsize"))).alias("_m")).select("file", "_m.frames", "_m.pixelsize")
    per = file_means(locs).join(F.broadcast(described), "file", "left").withColumn("frames", F.coalesce("frames", F.col("last_frame") + 1))
    per = checkpointed(per.withColumn("group", F.row_number().over(Window.orderBy("file")).cast("long")))
    lengths = {row["group"]: row["frames"] for row in per.where("frames > 0").select("group", "frames").collect()}
    known = F.broadcast(per.select("file", "group", "frames"))
    precise = [F.col(c).cast("double").alias(c) if c in locs.columns else F.lit(None).cast("double").alias(c) for c in ("lpx", "lpy")]
    rows = locs.where("frame is not null and x is not null and y is not null").select("file", "loc_id", "frame", "x", "y", *precise).join(known, "file").drop("file")
    rows = checkpointed(rows)
    chains = E.merge_rows(G.link_near(rows.select("loc_id", "group", "frame", "x", "y"), r, max_dark_time), ["group", "event"])
    whole = chains.join(known.select("group", "frames"), "group").where((F.col("frame") > 0) & (F.col("frame") + F.col("len") - 1 < F.col("frames")))
    out = per
    for part in (whole.groupBy("group").agg(F.avg("len").alias("len_mean")), _precisions(rows, bin_size, d_max), _drifts(rows, lengths, reach)):
        out = out.join(F.broadcast(part), "group", "left")
    out = out.withColumn("nena_px", F.when(~F.isnan("nena_px"), F.col("nena_px")))
    return out.withColumns({"locs_frame": F.col("n_locs") / F.col("frames"), "nena_nm": F.col("nena_px") * F.col("pixelsize")}).drop("group", "last_frame")
