"""Localizations laid out for viewports: rows in Z-order of blocks, in a folder for each tile, and tables of counts at several levels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import morton

#: About so many blocks at the finest level; sides of blocks grow by FACTOR from level to level.
BLOCKS, FACTOR = 256_000, 4
#: Blocks along a viewport's longer edge at its level; share of the view from which on all rows are read; ranges of codes in a filter.
EDGE, MOST, RANGES = 64, 0.1, 64
ABOUT = "width double, height double, base double, levels int"


def _blocks(size: float, width: float, height: float) -> tuple[int, int]:
    return max(1, math.ceil(width / size)), max(1, math.ceil(height / size))


def _block(size: float, width: float, height: float) -> tuple[Column, Column]:
    """A row's block; rows outside the view are in the blocks at its edge."""
    across, down = _blocks(size, width, height)
    at = lambda c, n: F.greatest(F.lit(0), F.least(F.floor(F.col(c) / size), F.lit(n - 1))).cast("long")
    return at("x", across), at("y", down)


def write_pyramid(locs: DataFrame, path: str, width: float, height: float, levels: int = 3) -> None:
    """Writes rows (loc_id, x, y, ...) to path: `rows`, in folders by tile (block of the coarsest level) and in order of the code of the
    finest block within; `levels`, counts of blocks by level; `about`, the description. Rows of one block are dealt by hashes
    of their ids, so that no task has to hold a block. Rows without x or y are left out."""
    base = max(1.0, math.ceil(math.sqrt(width * height / BLOCKS)))
    rows = locs.where("x is not null and y is not null")
    tile = morton(*_block(base * FACTOR ** (levels - 1), width, height))
    placed = rows.withColumn("_tile", tile).withColumn("_code", morton(*_block(base, width, height)))
    dealt = placed.repartitionByRange("_tile", "_code", F.xxhash64("loc_id")).sortWithinPartitions("_tile", "_code")
    dealt.write.partitionBy("_tile").parquet(f"{path}/rows")
    counts = None
    finest = placed.groupBy(*[b.alias(n) for n, b in zip(("bx", "by"), _block(base, width, height))]).agg(F.count("*").alias("n"))
    for level in range(levels):
        # the blocks of a level are made of those of the finest one
        wide = FACTOR**level
        one = finest.groupBy(F.lit(level).alias("level"), F.floor(F.col("bx") / wide).alias("bx"), F.floor(F.col("by") / wide).alias("by")).agg(F.sum("n").alias("n"))
        counts = one if counts is None else counts.unionByName(one)
    counts.write.partitionBy("level").parquet(f"{path}/levels")
    spark = locs.sparkSession
    spark.createDataFrame([(float(width), float(height), float(base), levels)], ABOUT).write.parquet(f"{path}/about")


def level_of(viewport: tuple[float, float, float, float], base: float, levels: int) -> int:
    """The finest level of which at most EDGE blocks lie along the viewport's longer edge, or else the coarsest."""
    x0, y0, x1, y1 = viewport
    wide = max(x1 - x0, y1 - y0)
    return next((level for level in range(levels) if wide / (base * FACTOR**level) <= EDGE), levels - 1)


def code_ranges(x0: int, y0: int, x1: int, y1: int, bits: int) -> list[tuple[int, int]]:
    """Ranges (first, last) of Z-order codes of `bits` bits an axis that make up a rectangle of blocks, edges included: a square
    inside is one range, one that crosses the edge is parted in four. The narrowest gaps are closed until RANGES are left."""
    found: list[list[int]] = []
    todo = [(0, 0, bits)]
    while todo:
        x, y, b = todo.pop()
        last = (1 << b) - 1
        if x > x1 or y > y1 or x + last < x0 or y + last < y0:
            continue
        if b == 0 or (x >= x0 and y >= y0 and x + last <= x1 and y + last <= y1):
            code = sum(((x >> k & 1) << 2 * k) | ((y >> k & 1) << 2 * k + 1) for k in range(bits))
            found.append([code, code + (1 << 2 * b) - 1])
        else:
            half = 1 << b - 1
            todo += [(x + dx, y + dy, b - 1) for dy in (half, 0) for dx in (half, 0)]
    found.sort()
    gaps = sorted(b[0] - a[1] for a, b in zip(found, found[1:]))
    close = max(1, gaps[-RANGES] if len(gaps) >= RANGES else 1)
    out = found[:1]
    for first, last in found[1:]:
        if first - out[-1][1] <= close:
            out[-1][1] = last
        else:
            out.append([first, last])
    return [tuple(r) for r in out]


def read_viewport(spark: SparkSession, path: str, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Rows of the blocks that a viewport touches, at the level that suits its size: all rows inside, and those of blocks at its
    edge. Only folders of its tiles are listed, and inside them only row groups with codes in its ranges are read. A viewport
    with a tenth of the view or more gives all rows, one without a block none."""
    width, height, base, levels = spark.read.schema(ABOUT).parquet(f"{path}/about").first()
    rows = spark.read.parquet(f"{path}/rows")
    clipped = max(0.0, min(width, x1) - max(0.0, x0)) * max(0.0, min(height, y1) - max(0.0, y0))
    if clipped >= MOST * width * height:
        return rows.drop("_tile", "_code")
    level = level_of((x0, y0, x1, y1), base, levels)

    def touched(size: float) -> tuple[int, int, int, int]:
        across, down = _blocks(size, width, height)
        low = [max(0, math.floor(v / size)) for v in (x0, y0)]
        return *low, *[min(n - 1, math.ceil(v / size) - 1) for v, n in ((x1, across), (y1, down))]

    size = base * FACTOR**level
    bx0, by0, bx1, by1 = touched(size)
    if bx0 > bx1 or by0 > by1:
        return rows.where("false").drop("_tile", "_code")
    bits = max(1, math.ceil(math.log2(max(_blocks(base, width, height)))))
    wide = FACTOR**level
    ranges = code_ranges(bx0 * wide, by0 * wide, (bx1 + 1) * wide - 1, (by1 + 1) * wide - 1, bits)
    shift = 2 * int(math.log2(FACTOR)) * (levels - 1)
    tiles = sorted({t for a, b in ranges for t in range(a >> shift, (b >> shift) + 1)})
    inside = F.lit(False)
    for a, b in ranges:
        inside = inside | F.col("_code").between(a, b)
    bx, by = _block(size, width, height)
    return rows.where(F.col("_tile").isin(tiles)).where(inside).where(bx.between(bx0, bx1) & by.between(by0, by1)).drop("_tile", "_code")


def read_level(spark: SparkSession, path: str, level: int) -> DataFrame:
    """(bx, by, n): the counts of a level's blocks, of which rows need not be read."""
    return spark.read.parquet(f"{path}/levels").where(F.col("level") == level).select("bx", "by", "n")
