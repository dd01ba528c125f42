"""Localization tables derived from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, HEIGHT, FRAMES, PIXELSIZE = 512.0, 128.0, 4320, 130.0

#: The same view in SQL.
LOCS_SQL = """
SELECT event_id AS loc_id, user_id AS "group", event_type AS channel,
  CAST((epoch_us(ts) - 1704067200000000) // 600000000 AS BIGINT) AS frame,
  value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y,
  0.1::DOUBLE + 0.05::DOUBLE * (event_id % 7) AS lpx, 0.1::DOUBLE + 0.05::DOUBLE * (event_id % 5) AS lpy,
  value * 10 AS photons, 1::DOUBLE + 0.01::DOUBLE * (event_id % 11) AS sx, 1::DOUBLE + 0.01::DOUBLE * (event_id % 13) AS sy,
  CAST(5 + event_id % 17 AS DOUBLE) AS bg, CAST(1000 + event_id % 1000 AS DOUBLE) AS net_gradient,
  CAST(event_id % 401 - 200 AS DOUBLE) AS z FROM events"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def locs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        i.alias("loc_id"), F.col("user_id").alias("group"), F.col("event_type").alias("channel"),
        F.floor((micros - F.lit(1704067200000000)) / F.lit(600000000)).cast("long").alias("frame"),
        F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"),
        (F.lit(0.1) + F.lit(0.05) * (i % 7)).alias("lpx"), (F.lit(0.1) + F.lit(0.05) * (i % 5)).alias("lpy"),
        (F.col("value") * 10).alias("photons"), (F.lit(1.0) + F.lit(0.01) * (i % 11)).alias("sx"), (F.lit(1.0) + F.lit(0.01) * (i % 13)).alias("sy"),
        (F.lit(5) + i % 17).cast("double").alias("bg"), (F.lit(1000) + i % 1000).cast("double").alias("net_gradient"), (i % 401 - 200).cast("double").alias("z"),
    )


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.cast("long").alias("pick_id"), (k * 20.0).alias("x"), (k * 4.0).alias("y"))


def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("frame")
    return locs(spark, sf_dir).select("frame").distinct().select("frame", (f * F.lit(0.001)).alias("dx"), (f * F.lit(-0.0005)).alias("dy"))


PICKS_SQL = "SELECT CAST(n_nationkey AS BIGINT) AS pick_id, n_nationkey * 20::DOUBLE AS x, n_nationkey * 4::DOUBLE AS y FROM nation"
