"""Packing into token-budget batches of optimal length buckets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, number_rows


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` length buckets with the least padding, by dynamic programming.

    lengths ascend; cost of a bucket i..j is counts[i..j] . (lengths[j] - lengths[i..j]). The padded total decides,
    as the sum of the lengths themselves is fixed. Time is buckets * distinct lengths squared in vector steps.
    """
    n = len(lengths)
    if not n:
        return []
    docs = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    best = lengths * docs[1:]  # one bucket for the first j + 1 lengths
    cuts = []
    for _ in range(min(buckets, n) - 1):
        at, new = np.zeros(n, np.int64), best.copy()
        for j in range(1, n):
            cost = best[:j] + lengths[j] * (docs[j + 1] - docs[1 : j + 1])
            k = int(cost.argmin())
            if cost[k] < new[j]:
                new[j], at[j] = cost[k], k + 1
        cuts.append(at)
        best = new
    bounds, j = [], n - 1
    for at in reversed(cuts):
        bounds.append(int(lengths[j]))
        if not at[j]:
            return bounds[::-1]
        j = at[j] - 1
    return bounds[::-1] if j < 0 else sorted({*bounds, int(lengths[j])})


def pack(docs: DataFrame, length: Column | None = None, id_col: str = "doc_id", text_col: str = "text", max_len: int = 8192, buckets: int = 16, budget: int = 131_072) -> DataFrame:
    """Deal documents into padded batches of at most `budget` tokens.

    A document longer than max_len tokens is cut into pieces of max_len, so the histogram has at most max_len rows,
    which are all that the driver sees. Bucket bounds minimise padding over all pieces. In a bucket of bound b each
    batch holds budget // b pieces; only a bucket's last batch can be short.

    length: tokens of a row; by default a byte vocabulary's (UTF-8 bytes and one end token). A null or negative length
    counts as 0, a null text as empty; a piece of 0 tokens is still one piece. Repeated rows are packed as often as
    they come; an empty table gives no rows. Returns doc_id, piece, start (token offset), length, bucket,
    padded_length, batch (number within the bucket), position (place within the batch).
    """
    if budget < max_len:
        raise ValueError("the budget must hold one piece of max_len tokens")
    own = F.octet_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) + 1 if length is None else length
    rows = docs.select(F.col(id_col).alias("doc_id"), F.greatest(F.coalesce(own.cast("long"), F.lit(0)), F.lit(0)).alias("_all"))
    last = F.greatest(F.ceil(F.col("_all") / max_len), F.lit(1)) - 1
    pieces = rows.select("doc_id", "_all", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    start = F.col("piece") * max_len
    pieces = pieces.select("doc_id", F.col("piece").cast("int").alias("piece"), start.alias("start"), F.least(F.col("_all") - start, F.lit(max_len)).alias("length"))
    pieces = materialize(pieces, "pieces")
    found = np.array(sorted(pieces.groupBy("length").count().collect()), np.int64).reshape(-1, 2)
    bounds = optimal_bounds(found[:, 0], found[:, 1], buckets) or [max_len]
    bucket = sum((F.when(F.col("length") > b, 1).otherwise(0) for b in bounds[:-1]), F.lit(0))
    padded = F.element_at(F.array(*[F.lit(b) for b in bounds]), F.col("bucket") + 1).cast("long")
    dealt = pieces.withColumn("bucket", bucket.cast("int")).withColumn("padded_length", padded)
    dealt = number_rows(dealt, "bucket", ["doc_id", "piece", "length"], "_slot")
    room = F.expr(f"{budget} div greatest(padded_length, 1)")
    return dealt.select("doc_id", "piece", "start", "length", "bucket", "padded_length", F.expr(f"_slot div ({budget} div greatest(padded_length, 1))").alias("batch"), F.pmod(F.col("_slot"), room).cast("int").alias("position"))
