"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hashed_sample, materialize


def learn_rotation(sample: np.ndarray, bits: int, steps: int = 20, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Mean and rotations (dimensions x bits) by iterative quantisation: each block of as many bits as there are
    dimensions starts from a random rotation of its own and is turned to lose least by taking signs."""
    rng, d = np.random.default_rng(seed), sample.shape[1]
    mean = sample.mean(0) if len(sample) else np.zeros(d)
    x, blocks = sample - mean, []
    for _ in range(-(-bits // d)):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(steps if len(x) else 0):
            u, _, v = np.linalg.svd(x.T @ np.sign(x @ r))
            r = u @ v
        blocks.append(r)
    return mean, np.hstack(blocks)[:, :bits]


def length_groups(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, lifted rows) from the longest on: a group's rows are more than half as long as its longest, by which they are
    divided and then given a last number that makes them unit vectors. The angle of a lifted row to a query with a 0
    there falls as the inner product grows."""
    scale = np.abs(x).max(axis=1, initial=0.0, keepdims=True)
    length = (scale * np.sqrt(((x / scale) ** 2).sum(axis=1, keepdims=True))).ravel()
    left, groups = np.argsort(-length, kind="stable"), []
    while len(left):
        n = max(1, int(np.searchsorted(-length[left], -length[left[0]] / 2)))
        own, left = np.sort(left[:n]), left[n:]
        unit = x[own] / length[own].max()
        groups.append((own, np.column_stack([unit, np.sqrt(np.maximum(0.0, 1 - (unit * unit).sum(axis=1)))])))
    return groups


def codes(x: np.ndarray, mean: np.ndarray, rotation: np.ndarray, part_bits: int) -> np.ndarray:
    """rows x parts: the substrings of each row's binary code as integers."""
    signs = ((x - mean) @ rotation > 0).reshape(len(x), -1, part_bits)
    return signs.astype(np.int64) @ (1 << np.arange(part_bits, dtype=np.int64))


def probes(part_bits: int, radius: int) -> np.ndarray:
    """All substrings with at most `radius` bits set, to be xor-ed with a query's."""
    sets = itertools.chain.from_iterable(itertools.combinations(range(part_bits), r) for r in range(radius + 1))
    return np.array([sum(1 << b for b in s) for s in sets], np.int64)


class MultiIndex:
    """Substring tables over one block of codes. floor: how many rows any query must get."""

    def __init__(self, code: np.ndarray, part_bits: int, floor: int = 0):
        self.code, self.bits, self.n, self.floor = code, part_bits, len(code), floor
        self.order = [np.argsort(c, kind="stable") for c in code.T]
        self.start = [np.concatenate([[0], np.cumsum(np.bincount(c, minlength=1 << part_bits))]) for c in code.T]
        self.packed = self.pack(code)

    def pack(self, code: np.ndarray) -> np.ndarray:
        """The same codes as rows of 64-bit words."""
        bits = ((code[:, :, None] >> np.arange(self.bits)) & 1).astype(np.uint8).reshape(len(code), -1)
        return np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64))), axis=1).view(np.uint64)

    def probed(self, query: np.ndarray, each: int) -> np.ndarray:
        """Rows of which some part is within `each` flips of the query's."""
        flips = probes(self.bits, each)
        seen = np.zeros(self.n, bool)
        for j in range(self.code.shape[1]):
            start = self.start[j]
            for value in flips ^ query[j]:
                seen[self.order[j][start[value] : start[value + 1]]] = True
        return np.flatnonzero(seen)

    def nearby(self, query: np.ndarray, radius: int, enough: int) -> np.ndarray:
        """All rows within a Hamming radius of the query's code.

        A code within a radius has a part within radius // parts (pigeonhole), so the rows under the probes of every
        part hold all of them. The radius is the least of those that allow one more flip in each part that holds
        `enough` rows, or `radius` if none does, or a wider one that holds `floor` rows. Once the probes of a radius are
        more than an eighth of the rows, the codes are compared instead, which is less work.
        """
        parts, reach, word = self.code.shape[1], self.code.shape[1] - 1, self.pack(query[None])
        distances = lambda rows: np.bitwise_count(self.packed[rows] ^ word).sum(axis=1, dtype=np.int64)
        while reach < radius and parts * sum(math.comb(self.bits, r) for r in range(reach // parts + 1)) <= self.n / 8:
            rows = self.probed(query, reach // parts)
            rows = rows[distances(rows) <= reach]
            if len(rows) >= enough:
                return rows
            reach += parts
        far = distances(slice(None))
        held = np.cumsum(np.bincount(far, minlength=radius + 1))
        while reach < radius and held[reach] < enough:
            reach += parts
        reach = min(reach, radius)
        if held[reach] < self.floor:
            reach = int(np.searchsorted(held, min(self.floor, self.n)))
        return np.flatnonzero(far <= reach)


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = 128, part_bits: int = 16, radius: int = 56, enough: int = 400, sample: int = 20_000, block: int = 8192, query_block: int = 4096) -> DataFrame:
    """The k nearest rows of each query by inner product; queries are the rows whose id is divisible by `every`.

    Codes are made of lifted rows in groups of like length, each giving candidates of its own, so that they tell inner
    products and not angles; the floats are the rows' own.
    The rotation is learned on at most `sample` rows (those of the smallest hash of the id); all rows are indexed.
    Rows and queries are dealt into blocks of bounded size by the hash of their ids; each pair of blocks is one
    task, which probes the row block's substring tables and reranks the floats in double precision. The Hamming
    radius of a query grows by one flip a part until it holds `enough` codes; where `radius` holds fewer, it grows bit
    by bit until it does, or until the block ends. Block winners (k a query and block) are merged by rank.

    Null vectors and ids, vectors with null or non-finite components, zero vectors and those of another length than
    most take no part. Ties go to the smaller id. Equal rows are equal candidates; rows with the query's own id are
    left out. Returns query_id, rank (from 1), vec_id, score. An empty table gives no rows.
    """
    value = F.col("v")
    usable = F.size(value) > 0
    usable &= ~F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(value, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & value.isNotNull()).where(usable)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").collect()
    out = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return vectors.sparkSession.createDataFrame([], out)
    dims = sizes[0]["d"]
    rows = rows.where(F.size("v") == dims)
    total = sizes[0]["count"]
    asked = rows.where(F.col("id") % every == 0)
    fitted = hashed_sample(rows, "id", sample).select("v").toPandas()["v"]
    mean, rotation = learn_rotation(np.vstack([x for _, x in length_groups(np.array(fitted.to_list(), float).reshape(-1, dims))]), bits)

    n_blocks, q_blocks = -(-total // block), max(1, -(-asked.count() // query_block))
    # equal vectors differ in id, so no block is much larger than the mean
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q"), "id", "v")
    queries = asked.distinct().select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("b"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(q_blocks)).cast("int").alias("q"), "id", "v")

    def nearest(data: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(ask):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        data = data.sort_values("id", kind="stable")
        x, q = np.array(data["v"].to_list(), float), np.array(ask["v"].to_list(), float)
        ids = data["id"].to_numpy()
        asks = codes(np.vstack([np.append(v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()), 0.0) for v in q]), mean, rotation, part_bits)
        floor, found = enough + int(np.unique(ids, return_counts=True)[1].max()), []
        groups = [(rows, MultiIndex(codes(lifted, mean, rotation, part_bits), part_bits, floor)) for rows, lifted in length_groups(x)]
        for one, vector, own in zip(asks, q, ask["id"], strict=True):
            near = np.concatenate([rows[index.nearby(one, radius, enough)] for rows, index in groups])
            near = near[ids[near] != own]
            rough = x[near] @ vector
            if len(near) > k:  # the rest cannot win, whatever the last digits
                near = near[rough >= np.partition(rough, -k)[-k] - 1e-9 * np.abs(rough).max()]
            score = (x[near] * vector).sum(axis=1)
            best = np.lexsort((ids[near], -score))[:k]
            found.append(pd.DataFrame({"query_id": own, "vec_id": ids[near][best], "score": score[best]}))
        return pd.concat(found)

    pairs = n_blocks * q_blocks
    dealt, queries = dealt.repartition(pairs, "b", "q"), queries.repartition(pairs, "b", "q")
    winners = dealt.groupBy("b", "q").cogroup(queries.groupBy("b", "q")).applyInPandas(nearest, "query_id long, vec_id long, score double")
    winners = materialize(winners, "winners")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return winners.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
