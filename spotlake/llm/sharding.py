"""Sharding by minimax contiguous partition."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, number_rows


def minimax_cuts(sizes: list[int], shards: int) -> list[int]:
    """Cut points of ordered atomic sizes into at most `shards` runs whose largest sum is as small as can be.

    Binary search over the capacity; a capacity is feasible if greedy filling needs no more than `shards` runs.
    Between the leftmost and the rightmost cuts that the least capacity allows, each cut is put nearest to an equal
    share of what remains. Returns shards - 1 indexes; run j is sizes[cut[j-1]:cut[j]].
    """
    n, total = len(sizes), [0, *accumulate(sizes)]

    def reach(start: int, cap: int) -> int:
        return bisect_right(total, total[start] + cap) - 1

    def feasible(cap: int) -> bool:
        at = 0
        for _ in range(shards):
            at = reach(at, cap)
        return at == n

    low, high = max([0, *sizes, -(-total[-1] // shards)]), total[-1]
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if feasible(mid) else (mid + 1, high)
    least, at = [n], n  # from the back: the first start from which the rest still fits
    for _ in range(shards - 1):
        at = bisect_left(total, total[at] - low)
        least.insert(0, at)
    cuts, at = [], 0
    for j in range(shards - 1):
        want = total[at] + (total[-1] - total[at]) / (shards - j)
        k = bisect_left(total, want)
        k = k if k == 0 or total[min(k, n)] - want <= want - total[k - 1] else k - 1
        at = max(least[j], min(k, reach(at, low)))
        cuts.append(at)
    return cuts


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", buckets: int = 65_536) -> DataFrame:
    """Deal all documents to shards of nearly equal bytes, equal texts together.

    The ordered atomic groups are `buckets` ranges of the text's hash: equal texts are always in one of them, and
    their number is bounded, so the sizes (at most `buckets` longs) are the only thing the driver sees. Slots come
    from a distributed numbering, so a text that fills a third of the rows is one group but not one task.

    Returns doc_id, size (UTF-8 bytes + 1), text_crc32, shard, slot (gapless from 0 in each shard). A null text counts
    as empty; null ids and repeated rows are rows like any other; an empty table gives no rows. Other columns are
    ignored. Law "bytes": sums of sizes are as equal as the largest atomic group lets them be.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(buckets)).cast("int").alias("_bucket"),
    )
    narrow = materialize(narrow, "shard-sizes")
    found = dict(narrow.groupBy("_bucket").agg(F.sum("size")).collect())
    order = sorted(found)
    cuts = minimax_cuts([found[b] for b in order], shards)
    starts = [order[c] if c < len(order) else buckets for c in cuts]
    shard = sum((F.when(F.col("_bucket") >= s, 1).otherwise(0) for s in starts), F.lit(0))
    dealt = narrow.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"))
    return number_rows(dealt, "shard", ["doc_id", "size", "text_crc32"], "slot")
