"""A training corpus from raw documents: rank, deduplicate, decontaminate, redact, pack."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlake.llm import decontaminate, jaccard, packing, quality, secrets
from spotlake.llm.common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rank_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the quantile of preference scores go. Empty texts rank low; labels are read from sf_dir."""
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_quality(docs.withColumn("_body", F.col("text")), model, text_col="_body", keep=COLUMNS).where("_predicted = 1").select(*COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """Adds `_row`, the place at which a row is written: (none, id, file, row), of which file and row are never null. In
    its order null ids come last. A table that is no plain Parquet one is written first."""
    place = [F.unhex(F.md5(F.col("_metadata.file_path").cast("binary"))).alias("file"), F.col("_metadata.row_index").alias("row")]
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), *place).alias("_row")
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        try:
            return docs.select(*COLUMNS, own)
        except AnalysisException:  # files without row numbers
            pass
    return materialize(docs.select(*COLUMNS), "pipeline-rows").select(*COLUMNS, own)


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of keyed() but for those whose key is the column doc_id of gone. That table is written first, so that Spark knows
    its size and shuffles the texts only if it is too large to be broadcast."""
    at = lambda c: [F.col(f"{c}.{x}").alias(f"_{x}") for x in ("file", "row")]
    gone = materialize(gone.select(*at("doc_id")), "gone")
    return rows.select(*COLUMNS, *at("_row")).join(gone, ["_file", "_row"], "left_anti").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with five-word shingles of similarity 0.8 or more, one row stays: that of smallest id, nulls
    being last, and of those the first written. Texts without words are in no group."""
    rows = keyed(docs)
    found = jaccard.near_duplicates(rows, shingle=5, threshold="0.8", id_col="_row")
    return without(rows, found.where("component_id.file <> doc_id.file or component_id.row <> doc_id.row"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text holds ten consecutive words of a benchmark item go, whatever their id."""
    rows = keyed(docs)
    found = decontaminate.contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_row")
    return without(rows, found.where("n_hit > 0"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; spans of secrets in its text are replaced by a mark, and n_chars follows."""
    found = secrets.scan_secrets(docs, keep=COLUMNS)
    text = secrets.redact(F.col("text"), F.col("spans"))
    return found.withColumn("text", text).withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte tokens of all documents in padded batches; a row for each piece."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", rank_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("packing", pack_batches),
]

#: The stages learn weights and join by similarity, which SQL cannot express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over sf_dir's documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
