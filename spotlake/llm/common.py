"""Helpers shared by the training-data operators."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letters outside ASCII that Spark's lower() would change.
FOREIGN_UPPER = r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^\x00-\x7F]]"


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-shared-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary folder in local
    mode, in which all tasks are on this machine; on a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or _own_dir()).rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back. The table survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() is faster and gives the same unless a letter outside ASCII would change."""
    return F.when(text.rlike(FOREIGN_UPPER), F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df, marked for broadcasting if it has at most `rows` rows. It is counted, so it should be a written table of narrow rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hashed_sample(df: DataFrame, key: str, limit: int) -> DataFrame:
    """The `limit` rows of the smallest hash of `key`. Rows of larger hashes are left out before they are sorted, so that a
    task sends the driver its share of the sample and not `limit` rows."""
    n, order = df.count(), F.xxhash64(key)
    if n > 4 * limit:
        df = df.where(F.pmod(order, F.lit(1 << 30)) < int((1 << 30) * 2 * limit / n))
    return df.orderBy(F.pmod(order, F.lit(1 << 30)), order, key).limit(limit)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2000, size: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """Smaller batches of at most `rows` rows and `size` bytes of text, or of one row, so that a worker holds little at a time."""
    for batch in batches:
        texts = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
        ends = np.cumsum(sum((pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts), np.zeros(len(batch), np.int64)))
        at = 0
        while at < len(batch):
            stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
            stop = min(max(stop, at + 1), at + rows, len(batch))
            yield batch if stop - at == len(batch) else batch.take(pa.array(range(at, stop)))
            at = stop


def lower_words(texts: pa.Array) -> pa.Array:
    """Lists of a text's words: A-Z in lower case, parted by ASCII white space; a null text is empty. Empty words may be
    at the ends."""
    if texts.offset:  # ascii_lower reads the wrong bytes of a sliced array
        texts = texts.take(pa.array(range(len(texts))))
    return pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))


def number_rows(df: DataFrame, group: str, order: list[str], out: str, cells: int = 256) -> DataFrame:
    """Adds a gapless number from 0 within each group, without a task for a whole group.

    Rows are dealt to `cells` cells a group by the hash of the order columns; a running sum of the cells' counts
    gives each cell its first number. The table of cells has at most groups * cells rows, so `group` must be a column
    of few values (shards, length buckets). df is evaluated twice: pass a materialized one. Rows equal in all order
    columns get different numbers.
    """
    dealt = df.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int"))
    before = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy(group, "_cell").agg(F.count("*").alias("_rows"))
    first = first.select(group, "_cell", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy(group, "_cell").orderBy(*order)
    return (
        dealt.join(F.broadcast(first), [group, "_cell"])
        .withColumn(out, F.col("_first") + F.row_number().over(within) - 1)
        .drop("_cell", "_first")
    )


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of a link table by alternating large-star and small-star steps.

    Returns (node, root): every node that has a link, with the smallest node it reaches. Each step is a grouped
    minimum and a join; the number of steps grows with the logarithm of the longest chain. Rows with a null end and
    links of a node with itself are ignored. Each step's table is written to the shared folder, so that a plan holds
    one step and a table is read by few stages of it.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    was, small = None, materialize(edges, "links")
    while True:
        both = small.select(ends(("u", "v"), ("v", "u"))).select("e.*")
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large-star")
        small = materialize(small_star(large), "links")
        now = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == was:
            break
        was = now
    return small.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        small.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def ends(*pairs: tuple[str, str]) -> Column:
    """`e`: a row (u, v) for each of the pairs of columns."""
    return F.explode(F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in pairs])).alias("e")


def small_star(large: DataFrame) -> DataFrame:
    """Links (u, v), u > v, after each u and its smaller neighbours are linked to the smallest of these."""
    step = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
    return step.select(ends(("u", "m"), ("v", "m"))).select("e.*").where("u <> v").distinct()
