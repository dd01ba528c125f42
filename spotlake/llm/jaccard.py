"""N-gram Jaccard join in the metric space of sets: pivots, Voronoi regions, triangle-inequality windows.

The distance 1 - |x & y| / |x | y| is a metric, so with e = 1 - threshold two sets that link differ by at most e in
their distance to any pivot. That alone does not part a corpus: most texts are at distance 1 from nearly every
pivot, and would be replicated to every region. So pivots are drawn within strata: under a common order of
shingles, linked sets have one of their first (1 - threshold) n + 1 shingles in common, and the sets that are connected by such
shingles form a stratum. Strata that one task can hold are joined there, pivot after pivot; larger ones go through
rounds of Spark jobs that measure every set against the stratum's pivots, deal it to Voronoi regions and replicate it where the
windows ask for it, until regions fit.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, lower_words, materialize, slices, small

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * M1
    h = (h ^ (h >> np.uint64(29))) * M2
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles of `size` words; A-Z count as a-z, words end at ASCII white
    space, a text of fewer words is one shingle, and one without words has none."""
    lists = lower_words(texts)
    coded = lists.flatten().dictionary_encode()
    value = pd.util.hash_array(np.array(coded.dictionary.to_pylist(), object), categorize=False) if len(coded.dictionary) else np.zeros(0, np.uint64)
    value = np.append(value, np.uint64(0))  # of the empty word
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py() if len(coded.dictionary) else -1
    ids, offsets, out = coded.indices.to_numpy(zero_copy_only=False), lists.offsets.to_numpy(), []
    offsets = offsets - offsets[0]
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        own = ids[a:b]
        own = own[own != empty] if empty >= 0 else own
        n = len(own)
        if not n:
            out.append(np.zeros(0, np.uint64))
            continue
        words, width = value[own], min(size, n)
        h = np.full(n - width + 1, np.uint64(width))
        for i in range(width):
            h = _mix(h * M2 + words[i : n - width + 1 + i])
        out.append(np.unique(h))
    return out


def node_of(shingles: np.ndarray) -> bytes | None:
    """A 128-bit key of a set: equal sets are one node of the join."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def linked(x: np.ndarray, y: np.ndarray, t: Fraction) -> bool:
    if len(x) * t > len(y) or len(y) * t > len(x):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * t.denominator >= (len(x) + len(y) - both) * t.numerator


class Sets:
    """Sets as codes of a common dictionary, with the list of sets that have each code: a set meets only those that it
    shares something with."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        self.stop = np.cumsum(self.size)
        self.code = np.unique(np.concatenate(sets), return_inverse=True)[1]
        self.owner = np.repeat(np.arange(len(sets)), self.size)[np.argsort(self.code, kind="stable")]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(self.code))])

    def against(self, p: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of the intersections and of the unions of set p with each of `rows`."""
        own = self.code[self.stop[p] - self.size[p] : self.stop[p]]
        n = self.start[own + 1] - self.start[own]
        at = np.repeat(self.start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(self.owner[at], minlength=len(self.size))[rows]
        return both, self.size[p] + self.size[rows] - both


def windows(distance: np.ndarray, e: float, slack: float = 1e-9) -> np.ndarray:
    """pivots x sets: in which Voronoi regions a set lies, given its distances to the pivots.

    It lies in that of its nearest pivot, and in those of pivots at most 2e farther: if x and y link and p is nearest
    to x, then d(y, p) <= e + d(x, p) <= e + d(x, q) <= 2e + d(y, q) for the pivot q nearest to y.
    """
    return distance <= distance.min(axis=0) + 2 * e + slack


def region_links(keys: list[bytes], sets: list[np.ndarray], t: Fraction, leaf: int = 256, pivots: int = 16, labels: list[int | None] | None = None) -> set[tuple[bytes, bytes]]:
    """Links that connect exactly those sets of a region that are connected by all its links.

    Sets of more than `leaf` are dealt to the Voronoi regions of some pivots and joined there, unless the windows make
    them no smaller. Otherwise one pivot follows another: sets within e of it are linked to it; a link between one of those
    and another set is possible if that one is within 2e of the pivot and their distances to the pivot differ by at most e;
    a set that is already connected is not compared. Sets of equal label are connected from the start.
    """
    e, slack, links, table = float(1 - t), 1e-9, set(), Sets(sets)
    parent = list(range(len(keys)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def connect(i: int, j: int, link: bool = True) -> None:
        if (a := find(i)) != (b := find(j)):
            parent[max(a, b)] = min(a, b)
            if link:
                links.add((keys[i], keys[j]))

    first: dict[int, int] = {}
    for i, label in enumerate(labels or []):
        if label is not None:
            connect(i, first.setdefault(label, i), link=False)

    def balls(members: np.ndarray) -> None:
        while len({find(i) for i in members}) > 1:
            p, rest = members[0], members[1:]
            both, union = table.against(p, rest)
            d, inside = 1 - both / union, both * t.denominator >= union * t.numerator
            core, far = rest[inside], d[inside]
            for i in core:
                connect(p, i)
            for z, dz in zip(rest[~inside], d[~inside], strict=True):
                if dz <= 2 * e + slack and len(core) and find(z) != find(p):
                    near = core[far >= dz - e - slack]
                    if len(near):
                        both, union = table.against(z, near)
                        hit = np.flatnonzero(both * t.denominator >= union * t.numerator)
                        if len(hit):
                            connect(near[hit[0]], z)
            members = rest[~inside]

    free = [i for i in range(len(keys)) if not labels or labels[i] is None]
    taken = set(free)
    stack = [np.array(free + [i for i in range(len(keys)) if i not in taken], np.int64)]
    while stack:
        members = stack.pop()
        if len(members) <= leaf:
            balls(members)
            continue
        chosen = members[np.linspace(0, len(members) - 1, pivots).astype(int)]
        regions = windows(np.array([1 - np.divide(*table.against(p, members)) for p in chosen]), e)
        if regions.sum() > 1.5 * len(members) or regions.sum(axis=1).max() > 0.7 * len(members):
            balls(members)
        else:
            stack += [members[row] for row in regions if row.sum() > 1]
    return links


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def shared_firsts(sets: DataFrame, key: str, t: Fraction) -> DataFrame:
    """Edges (key, least) that connect the sets (key, size, first) that have one of their first shingles (n, shingle) in common. n: how
    many sets have it."""
    # sets link only if the smaller has at least threshold times the larger's size: they share a band of sizes or have
    # neighbouring ones. A shingle of n sets is dealt to a cell for each thousand, which are then connected by their least sets.
    width = -math.log(t) * (1 + 1e-9) if t < 1 else 1e-9
    band = F.floor(F.log(F.col("size").cast("double")) / width)
    members = sets.select(key, F.explode(F.array(band, band + 1)).alias("band"), "first").select(key, "band", F.explode("first").alias("x"))
    members = members.select(key, "band", "x.shingle", F.coalesce(F.ceil(F.col("x.n") / 1000), F.lit(16)).alias("cells"))
    members = members.withColumn("cell", F.pmod(F.xxhash64(key, F.lit(5)), F.col("cells")))
    members = members.withColumn("least", F.min(key).over(Window.partitionBy("shingle", "band", "cell")))
    tops = members.where("cells > 1").select("shingle", "band", F.col("least").alias(key)).distinct()
    tops = tops.withColumn("least", F.min(key).over(Window.partitionBy("shingle", "band")))
    return members.select(key, "least").unionAll(tops.select(key, "least")).where(F.col(key) != F.col("least")).distinct()


def finer_strata(parts: DataFrame, t: Fraction, leaf: int, largest: int) -> DataFrame:
    """parts, those of over `leaf` sets or `largest` bytes parted anew: by an order of all their shingles, the rarest in the part
    first, instead of a hash class of them. Sets that share none of their first ones with another set go."""
    sized = parts.groupBy("part").agg(F.count("*").alias("rows"), F.sum(F.octet_length("members")).alias("bytes"))
    big = materialize(sized.where((F.col("rows") > leaf) | (F.col("bytes") > largest)).select("part", F.lit(True).alias("big")), "large-strata")
    if big.isEmpty():
        return parts
    marked = parts.join(small(big), "part", "left")

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=4_000_000):
            sets = _sets(batch.column(2))
            size = np.array([len(s) for s in sets], np.int64)
            at = np.repeat(np.arange(len(sets)), size)
            flat = np.concatenate(sets).view(np.int64) if len(sets) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(size[at]), pa.array(flat)], ["part", "node", "size", "shingle"])

    wide = marked.where("big").select("part", "node", "members")
    each = materialize(wide.mapInArrow(exploded, "part long, node binary, size long, shingle long"), "shingles-of-strata")
    several = each.groupBy("part", "shingle").agg(F.count("*").alias("n")).where("n > 1")
    held = each.join(several, ["part", "shingle"]).groupBy("part", "node", "size").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("held"))
    # of the first size - ceil(t size) + 1 shingles, those that no other set has come before the held ones
    keep = F.floor(F.col("size") * F.lit(t.denominator - t.numerator) / F.lit(t.denominator)) + 1
    room = (keep - F.col("size") + F.size("held")).cast("int")
    first = F.transform(F.slice("held", F.lit(1), F.greatest(room, F.lit(0))), lambda x: F.struct(x.n.alias("n"), F.xxhash64("part", x.shingle).alias("shingle")))
    named = components(shared_firsts(held.where(room > 0).select("node", "size", first.alias("first")), "node", t), "node", "least")
    again = wide.join(named, "node").select(F.xxhash64("part", "root").alias("part"), "node", "members")
    return materialize(marked.where("big is null").select("part", "node", "members").unionAll(again), "finer-strata")


def metric_join(parts: DataFrame, t: Fraction, leaf: int = 1000, largest: int = 32_000_000, pivots: int = 16) -> DataFrame:
    """(node, root): rows that connect the sets of each part as all links between them do.

    parts: part long, node binary, members binary (sorted 64-bit shingles), each node once in a part. Parts of at most
    `leaf` sets and `largest` bytes are a task each. Of larger ones, each round draws `pivots` pivots, measures every set
    against them in slices of that size, and links it to those within reach. A part whose sets are all linked to pivots
    that are connected is done. Otherwise it goes on as its Voronoi regions if the windows replicate it at most 1.5-fold and no
    region has more than 0.7 of it; or else in pairs of blocks, of which at least one is of sets that are not yet
    connected with most others.
    """
    e, found, depth = float(1 - t), [], 0

    def join(table: pa.Table) -> pa.Table:
        node, sets = table.column("node").to_pylist(), _sets(table.column("members"))
        order = sorted(range(len(node)), key=lambda i: (len(sets[i]), node[i]))
        labels = [table.column("label").to_pylist()[i] for i in order] if table.column("label").null_count < len(table) else None
        links = region_links([node[i] for i in order], [sets[i] for i in order], t, labels=labels) if len(node) > 1 else set()
        ends = list(zip(*links, strict=True)) or [[], []]
        return pa.table({"node": pa.array(ends[0], pa.binary()), "root": pa.array(ends[1], pa.binary())})

    def measure(own: pa.Table, chosen: pa.Table) -> pa.Table:
        chosen = chosen.sort_by("i")
        sets, names = _sets(own.column("members")) + _sets(chosen.column("members")), ["part", "node", "members", "label"]
        if not len(own) or not len(chosen):
            return pa.table({**{c: own.column(c) for c in names}, "links": pa.array([[]] * len(own), pa.list_(pa.int32())), "cells": pa.array([[]] * len(own), pa.list_(pa.int32()))})
        table, rows, index = Sets(sets), np.arange(len(own)), np.array(chosen.column("i").to_pylist(), np.int32)
        both, union = (np.array(x) for x in zip(*(table.against(len(own) + k, rows) for k in range(len(chosen))), strict=True))
        hit, cell = both * t.denominator >= union * t.numerator, windows(1 - both / union, e)
        listed = lambda m: pa.array([index[m[:, j]].tolist() for j in rows], pa.list_(pa.int32()))
        return pa.table({**{c: own.column(c) for c in names}, "links": listed(hit), "cells": listed(cell)})

    def groups(pairs: pd.DataFrame) -> pd.DataFrame:
        """Pivots of a part that are connected by sets within reach of both: at most pivots squared rows."""
        low = {i: i for i in {*pairs["a"], *pairs["b"]}}
        for _ in range(len(low)):
            for a, b in zip(pairs["a"], pairs["b"], strict=True):
                low[a] = low[b] = min(low[a], low[b])
        return pd.DataFrame({"part": pairs["part"].iloc[0], "i": list(low), "g": list(low.values())})

    def joined(rows: DataFrame) -> DataFrame:
        return rows.select("part", "node", "members", "label").groupBy("part").applyInArrow(join, "node binary, root binary")

    parts = parts.select("part", "node", "members", F.lit(None).cast("long").alias("label"))
    while True:
        sized = parts.groupBy("part").agg(F.count("*").alias("rows"), F.sum(F.octet_length("members")).alias("bytes"))
        big = materialize(sized.where((F.col("rows") > leaf) | (F.col("bytes") > largest)), "large-parts")
        if big.isEmpty():
            found.append(joined(parts))
            break
        marked = parts.join(small(big), "part", "left")
        found.append(joined(marked.where("rows is null")))
        wide = marked.where("rows is not null").withColumn("slices", F.ceil(F.greatest(F.col("rows") / leaf, F.col("bytes") / largest)).cast("int"))
        drawn = F.xxhash64("node", F.lit(depth))
        chosen = wide.where(F.pmod(drawn, F.lit(1 << 30)) < F.lit(3.0 * pivots * (1 << 30)) / F.col("rows"))
        chosen = chosen.withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy(drawn, "node")) - 1).where(F.col("i") < pivots)
        chosen = materialize(chosen.select("part", "i", "node", "members", "slices"), "pivots")
        dealt = wide.withColumn("slice", F.pmod(F.xxhash64("node", F.lit(-1 - depth)), F.col("slices")).cast("int"))
        asked = chosen.select("part", "i", "members", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
        keys = ["part", "slice"]
        measured = dealt.select(*keys, "node", "members", "label").groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(measure, "part long, node binary, members binary, label long, links array<int>, cells array<int>")
        measured = materialize(measured, "measured")

        ends = chosen.select("part", "i", F.col("node").alias("root"))
        pairs = materialize(measured.where("size(links) > 0").select("part", F.col("links")[0].alias("a"), F.explode("links").alias("b")).distinct(), "linked-pivots")
        reached = measured.where("size(links) > 0").select("part", "node", F.col("links")[0].alias("i"))
        found.append(reached.join(small(ends), ["part", "i"]).select("node", "root"))
        other = ends.select("part", F.col("i").alias("b"), F.col("root").alias("node"))
        found.append(pairs.where("a <> b").join(small(other), ["part", "b"]).join(small(ends.withColumnRenamed("i", "a")), ["part", "a"]).select("node", "root"))
        group = materialize(pairs.groupBy("part").applyInPandas(groups, "part long, i int, g int"), "pivot-groups")
        label = F.coalesce(F.when(F.col("g").isNotNull(), F.xxhash64("part", F.lit(depth), "g")), F.col("label"))
        labelled = measured.withColumn("i", F.try_element_at("links", F.lit(1))).join(small(group), ["part", "i"], "left")
        labelled = labelled.select("part", "node", "members", label.alias("label"), "cells")

        by_label = labelled.groupBy("part", "label").agg(F.count("*").alias("n"), F.sum(F.octet_length("members")).alias("bytes"))
        shape = by_label.groupBy("part").agg(F.sum("n").alias("rows"), F.sum("bytes").alias("bytes"), F.max(F.when(F.col("label").isNotNull(), F.struct("n", "bytes", "label"))).alias("top"))
        spread = measured.select("part", F.explode("cells").alias("cell")).groupBy("part", "cell").count().groupBy("part").agg(F.sum("count").alias("copies"), F.max("count").alias("widest"))
        shape = shape.join(spread, "part", "left").withColumn("split", F.coalesce((F.col("copies") <= 1.5 * F.col("rows")) & (F.col("widest") <= 0.7 * F.col("rows")), F.lit(False)))
        shape = shape.where("top is null or top.n < rows")
        open_rows, open_bytes = F.col("rows") - F.coalesce("top.n", F.lit(0)), F.col("bytes") - F.coalesce("top.bytes", F.lit(0))
        blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(F.greatest(2 * n / leaf, 2 * size / largest))).cast("int")
        shape = shape.select("part", "split", F.col("top.label").alias("top"), blocks(open_rows, open_bytes).alias("n_open"), F.when(F.col("top").isNotNull(), blocks(F.col("top.n"), F.col("top.bytes"))).otherwise(0).alias("n_top"))
        shape = materialize(shape, "part-shapes")
        going = labelled.join(small(shape), "part")
        in_blocks = going.where("not split").withColumn("key", F.explode(block_keys()))
        found.append(joined(in_blocks.select(F.xxhash64("part", F.lit(depth), "key").alias("part"), "node", "members", "label")))
        cells = going.where("split").withColumn("cell", F.explode("cells"))
        parts = materialize(cells.select(F.xxhash64("part", F.lit(depth), "cell").alias("part"), "node", "members", "label"), "regions-of-parts")
        depth += 1
    links = materialize(_union(found), "links-of-parts")
    return components(links, "node", "root")


def block_keys() -> Column:
    """The pairs of blocks that a set takes part in: of open sets (not connected with the part's most frequent label) every
    two blocks meet, and each meets the blocks of the others; those are not joined among themselves."""
    at = lambda n: F.pmod(F.xxhash64("node", F.lit(7)), F.greatest(F.col(n), F.lit(1))).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    is_open = F.col("label").isNull() | F.col("top").isNull() | (F.col("label") != F.col("top"))
    both = F.transform(upto("n_open"), lambda i: F.concat_ws("-", F.least(i, at("n_open")), F.greatest(i, at("n_open"))))
    across = F.when(F.col("n_top") > 0, F.transform(upto("n_top"), lambda j: F.concat_ws("-", at("n_open"), F.lit("top"), j))).otherwise(F.array().cast("array<string>"))
    met = F.transform(upto("n_open"), lambda i: F.concat_ws("-", i, F.lit("top"), at("n_top")))
    return F.when(is_open, F.concat(both, across)).otherwise(met)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for x in tables[1:]:
        out = out.unionAll(x)
    return out


def membership(heads: DataFrame, limit: int = 1 << 27) -> np.ndarray:
    """A bitmap of the column `head`, of 16 bits a row up to `limit` bits: what is not in it is not in the table. Past that
    size it lets more and more pass, which a join then removes."""
    bits = min(limit, max(64, 1 << (16 * heads.count() - 1).bit_length()))
    place = F.pmod("head", F.lit(bits))
    words = heads.groupBy(F.floor(place / 64).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(pmod(head, {bits}), 64) as int))")).alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.view(np.uint64)


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: float | str | Fraction = "0.8", id_col: str = "doc_id", text_col: str = "text", largest: int = 32_000_000, leaf: int = 1000) -> DataFrame:
    """Connected components of the documents under Jaccard similarity of word shingles.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable by links, its own included). Null and
    empty texts have no shingles and link with nothing; texts of any length are taken whole; repeated rows and ids each
    give a row; an empty table gives none. Null ids are never a component's smallest id, unless it has no other. Other
    columns are ignored, whatever their names.

    The order of shingles is by the number of sets that have them, so that passages that many documents share seldom
    bring documents together. Counting is left to a hash class of shingles, which come first in the order and are more
    than a set's prefix; where a small set has too few of them, others follow by hash. Whole sets leave the task that made
    them only if they are in a stratum. `largest` and `leaf`: bytes and sets that one task joins; see metric_join.
    """
    t = Fraction(str(threshold))
    classes = np.uint64(max(1, int(1 / (1.6 * (1 - t))))) if t < 1 else np.uint64(1)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = named.schema["doc_id"].dataType.simpleString()

    def census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in slices(batches):
            keys, rows = [], []
            for s in shingle_sets(batch.column(1), shingle):
                node = node_of(s)
                keys.append(node)
                if node is None or node in seen:
                    rows.append((len(s), None, None, None, None))
                    continue
                seen.add(node)
                keep = len(s) - -(-len(s) * t.numerator // t.denominator) + 1
                ranked = s % classes == 0
                n = int(ranked.sum())
                rows.append((len(s), keep, n, s[ranked].view(np.int64), s[~ranked][: max(0, keep - n)].view(np.int64)))
            if rows:
                n, keep, ranked, own, extra = zip(*rows, strict=True)
                longs = pa.list_(pa.int64())
                heads = pa.array([k and int.from_bytes(k[:8], "little", signed=True) for k in keys], pa.int64())
                columns = [batch.column(0), pa.array(keys, pa.binary()), heads, pa.array(n, pa.int64()), pa.array(keep, pa.int32()), pa.array(ranked, pa.int32()), pa.array(own, longs), pa.array(extra, longs)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "head", "n_shingles", "keep", "ranked", "own", "extra"])

    shape = f"doc_id {id_type}, node binary, head long, n_shingles long, keep int, ranked int, own array<long>, extra array<long>"
    found = materialize(named.mapInArrow(census, shape), "shingle-census")
    rows = found.select("doc_id", "node", "n_shingles")

    counted = found.where("own is not null")
    own = counted.select("head", F.explode("own").alias("shingle"))
    several = own.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    common = own.join(several, "shingle").groupBy("head").agg(F.array_sort(F.collect_set(F.struct("n", "shingle"))).alias("common"))
    # two sets whose keys agree in `head` only, if there are any, keep all their shingles
    each = counted.groupBy("head").agg(F.max("n_shingles").alias("size"), F.max("keep").alias("keep"), F.max("ranked").alias("ranked"), F.flatten(F.collect_set("extra")).alias("extra"), (F.min("node") != F.max("node")).alias("mixed"))
    each = each.join(common, "head", "left")
    # the order: ranked shingles by count, then the others; those that no other set has need not be looked up
    none = F.array().cast("array<struct<n:long,shingle:long>>")
    held, more = F.coalesce("common", none), F.transform("extra", lambda x: F.struct(F.lit(None).cast("long").alias("n"), x.alias("shingle")))
    room = F.col("keep") - F.col("ranked") + F.size(held)
    first = F.when(F.col("mixed") | (F.col("keep") > F.col("ranked")), F.concat(held, more)).when(room > 0, F.slice(held, F.lit(1), F.greatest(room, F.lit(0)))).otherwise(none)
    strata = components(shared_firsts(each.select("head", "size", first.alias("first")), "head", t), "head", "least")
    strata = materialize(strata.select(F.col("node").alias("head"), F.col("root").alias("part")), "strata")
    bitmap = docs.sparkSession.sparkContext.broadcast(membership(strata))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = bitmap.value, set()
        for batch in slices(batches):
            out = []
            for s in shingle_sets(batch.column(0), shingle):
                node = node_of(s)
                if node is None or node in seen:
                    continue
                head = int.from_bytes(node[:8], "little", signed=True)
                at = head % (64 * len(bits))
                if int(bits[at // 64]) >> (at % 64) & 1:
                    seen.add(node)
                    out.append((head, node, s.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["head", "node", "members"])

    sets = named.select("text").mapInArrow(full, "head long, node binary, members binary")
    sets = sets.join(strata, "head").groupBy("head", "node").agg(F.first("part").alias("part"), F.first("members").alias("members")).drop("head")
    joined = metric_join(finer_strata(materialize(sets, "sets-of-strata"), t, leaf, largest), t, leaf, largest)
    least = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("_min"))
    least = least.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = materialize(least, "classes")
    classes = classes.join(classes.groupBy("root").agg(F.min("_min").alias("component_id")), "root").select("node", "component_id")
    return rows.join(classes, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
