"""Localization files that arrive in a folder, followed by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from ..operators.quality import file_summaries
from ..operators.shared import stored


def watch(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the rows of Parquet files as they appear in a folder, each file once, with `file`, its path."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("file", F.col("_metadata.file_path"))


def quality_by_time(locs: DataFrame, exposure: float, seconds: int, late: int) -> DataFrame:
    """(start, n, photons, lpx, lpy): rows and means in windows of so many seconds of the movie, start being that of the window in
    seconds from its first frame. exposure: seconds a frame. Rows that come more than `late` seconds of the movie after newer
    ones are left out, so the state holds open windows only; rows without a frame count nowhere."""
    timed = locs.where(F.col("frame").isNotNull()).withColumn("_at", F.timestamp_micros((F.col("frame") * F.lit(exposure) * 1_000_000).cast("long")))
    windows = timed.withWatermark("_at", f"{late} seconds").groupBy(F.window("_at", f"{seconds} seconds").alias("_w"))
    return windows.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("photons", "lpx", "lpy")]).select(F.unix_timestamp("_w.start").alias("start"), "n", "photons", "lpx", "lpy")


def record_quality(batch: DataFrame, number: int, path: str, movies: DataFrame, **options) -> None:
    """Writes the summaries of one batch of whole files (see `file_summaries`) to the table at path, as its part `number`.

    A part that is there already is replaced, so a batch that is replayed after a failure changes nothing. Rows are numbered
    as they are stored once; batches without rows write nothing.
    """
    rows = stored(batch.drop("loc_id").withColumn("loc_id", F.monotonically_increasing_id()))
    if not rows.isEmpty():
        file_summaries(rows, movies, **options).write.mode("overwrite").parquet(f"{path}/batch={number}")


def follow_quality(rows: DataFrame, describe: Callable[[SparkSession], DataFrame], path: str, **options) -> DataStreamWriter:
    """A stream (as of `watch`) that keeps the quality table at path; the caller names checkpoint and trigger and starts it.

    describe: gives the descriptions (file, frames, pixelsize) known at a batch. A batch holds whole files, at most
    files_per_trigger of them, which bounds what the driver sees.
    """
    return rows.writeStream.foreachBatch(lambda batch, number: record_quality(batch, number, path, describe(batch.sparkSession), **options))


def quality_table(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: of a file that came more than once, its latest summary."""
    rows = spark.read.parquet(path)
    latest = rows.groupBy("file").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("file", "batch")]), "batch").alias("_s"))
    return latest.select("file", "_s.*")
