"""Layouts of other programs, as projections, and how tables with their description are kept."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def to_thunderstorm(locs: DataFrame, pixelsize: float) -> DataFrame:
    nm = lambda c: F.col(c) * pixelsize
    out = [F.col("loc_id").alias("id"), F.col("frame"), nm("x").alias("x [nm]"), nm("y").alias("y [nm]"), nm("sx").alias("sigma1 [nm]"), nm("sy").alias("sigma2 [nm]")]
    out += [F.col("photons").alias("intensity [photon]"), F.col("bg").alias("offset [photon]"), ((F.col("lpx") + F.col("lpy")) / 2 * pixelsize).alias("uncertainty_xy [nm]")]
    return locs.select(*out, *([F.col("z").alias("z [nm]")] if "z" in locs.columns else []))


def from_thunderstorm(rows: DataFrame, pixelsize: float) -> DataFrame:
    """Nanometres to pixels; frames start at 0; both lateral precisions are the given uncertainty."""
    first = rows.agg(F.min("frame").alias("_first"))
    px = lambda c: F.col(f"`{c}`") / pixelsize
    out = [(F.col("frame") - F.col("_first")).cast("long").alias("frame"), px("x [nm]").alias("x"), px("y [nm]").alias("y"), F.col("`intensity [photon]`").alias("photons")]
    out += [px("sigma1 [nm]").alias("sx"), px("sigma2 [nm]").alias("sy"), F.col("`offset [photon]`").alias("bg"), px("uncertainty_xy [nm]").alias("lpx"), px("uncertainty_xy [nm]").alias("lpy")]
    return rows.join(F.broadcast(first)).select("id", *out)


def to_nis(locs: DataFrame, pixelsize: float) -> DataFrame:
    """Frames from 1, coordinates in nm, background and photons rounded."""
    return locs.select(
        F.lit(1).cast("long").alias("Channel"), (F.col("x") * pixelsize).alias("X"), (F.col("y") * pixelsize).alias("Y"), F.lit(1).cast("long").alias("Length"),
        F.bround("bg").cast("long").alias("BG"), F.bround("photons").cast("long").alias("Area"), (F.col("frame") + 1).alias("Frame"),
    )


def to_visp(locs: DataFrame, pixelsize: float) -> DataFrame:
    return locs.select((F.col("x") * pixelsize).alias("x"), (F.col("y") * pixelsize).alias("y"), "z", "photons", "frame")


def save_locs(locs: DataFrame, path: str, info: list[dict]) -> None:
    """Parquet with the description in a folder of its own beside it, written through Spark to any file system."""
    locs.write.parquet(f"{path}/locs")
    spark = locs.sparkSession
    spark.createDataFrame([(i, json.dumps(entry)) for i, entry in enumerate(info)], "step int, entry string").coalesce(1).write.json(f"{path}/info")


def load_locs(spark: SparkSession, path: str) -> tuple[DataFrame, list[dict]]:
    info = spark.read.schema("step int, entry string").json(f"{path}/info").orderBy("step").collect()
    return spark.read.parquet(f"{path}/locs"), [json.loads(row.entry) for row in info]


def described(info: list[dict], key: str, default=None):
    """The latest entry of a description that has the key with a value that is not empty."""
    return next((entry[key] for entry in reversed(info) if entry.get(key)), default)
