"""What several operators need."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a temporary folder in local mode; on a cluster, whose executors do not share
    one, that is an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-shared-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """df written to the shared folder as Parquet and read again; with `by`, parted by that column, so that a filter on it reads
    only what it needs. Ranges of that column, and of hashed rows within it, make a file for each task and value at most."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    if by is None:
        df.write.parquet(path)
    else:
        df.repartitionByRange(by, F.xxhash64(*df.columns)).write.partitionBy(by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df, marked for broadcasting if it has at most `rows` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def running_sums(df: DataFrame, order: str, columns: list[str], parts: int = 0) -> DataFrame:
    """df with each of columns replaced by its sum over all rows up to this one in `order`, whose values are distinct, and with
    `total_<column>`. Ranges of the order are summed first; each adds what lies before it, so that no task holds all rows."""
    parts = parts or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = checkpointed(df.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sums = dealt.groupBy("_part").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    offsets = [F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}") for c in columns]
    totals = [F.sum(f"_{c}").over(Window.partitionBy()).alias(f"total_{c}") for c in columns]
    within = Window.partitionBy("_part").orderBy(order)
    out = dealt.join(F.broadcast(sums.select("_part", *offsets, *totals)), "_part")
    return out.withColumns({c: F.sum(c).over(within) + F.col(f"_before_{c}") for c in columns}).drop("_part", *[f"_before_{c}" for c in columns])
