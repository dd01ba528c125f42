"""Text files of other programs, written and read through Spark.

A written file is a folder of parts, whose concatenation in order of name is the file; lines end in CR LF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the ThunderSTORM format: the columns that a file must have.
COLUMNS_2D = ["frame", "x [nm]", "y [nm]", "intensity [photon]", "offset [photon]", "uncertainty_xy [nm]", "sigma [nm]"]
COLUMNS_3D = ["frame", "x [nm]", "y [nm]", "z [nm]", "intensity [photon]", "offset [photon]", "uncertainty_xy [nm]", "sigma1 [nm]", "sigma2 [nm]"]


def imagej_line() -> Column:
    return F.format_string("%d   %.5f   %.5f", "frame", "x", "y")


def chimera_line(pixelsize: float) -> Column:
    """Needs z. The file starts with the line CHIMERA_HEADER."""
    return F.format_string("1\t%.5f\t%.5f\t%.5f", F.col("x") * pixelsize, F.col("y") * pixelsize, F.col("z"))


CHIMERA_HEADER = "Molecule export"


def visp_line(pixelsize: float) -> Column:
    """Needs z."""
    return F.format_string("%.1f %.1f %.1f %.1f %d", F.col("x") * pixelsize, F.col("y") * pixelsize, F.col("z"), F.col("photons"), F.col("frame").cast("long"))


def write_lines(rows: DataFrame, line: Column, path: str, header: str | None = None) -> None:
    """One line a row, in the rows' order; a header is the first line of the first part. An empty table gives the header only."""
    lines = rows.select(line.alias("value"))
    if header is not None:
        lines = rows.sparkSession.range(0, 1, 1, 1).select(F.lit(header).alias("value")).unionAll(lines)
    lines.write.text(path, lineSep="\r\n")


def read_thunderstorm(spark: SparkSession, path: str, pixelsize: float) -> DataFrame:
    """Localizations of a CSV file: nanometres to pixels, frames from 0, photons and background cut to whole numbers.

    A file with a column `z [nm]` is three-dimensional. Missing columns are an error, others are left out. Rows are in no
    order: sort by frame where that matters.
    """
    rows = spark.read.csv(path, header=True)
    wanted = COLUMNS_3D if "z [nm]" in rows.columns else COLUMNS_2D
    if missing := [c for c in wanted if c not in rows.columns]:
        raise ValueError(f"columns missing: {missing}")
    number = lambda c: F.col(f"`{c}`").cast("double")
    whole = lambda c: number(c).cast("long").cast("double")
    widths = ("sigma1 [nm]", "sigma2 [nm]") if wanted is COLUMNS_3D else ("sigma [nm]", "sigma [nm]")
    frame = number("frame").cast("long")
    first = rows.agg(F.min(frame).alias("_first"))
    out = [(frame - F.col("_first")).alias("frame"), (number("x [nm]") / pixelsize).alias("x"), (number("y [nm]") / pixelsize).alias("y")]
    out += [number("z [nm]").alias("z")] if wanted is COLUMNS_3D else []
    out += [whole("intensity [photon]").alias("photons"), (number(widths[0]) / pixelsize).alias("sx"), (number(widths[1]) / pixelsize).alias("sy"), whole("offset [photon]").alias("bg")]
    out += [(number("uncertainty_xy [nm]") / pixelsize).alias(c) for c in ("lpx", "lpy")]
    return rows.join(F.broadcast(first)).select(*out)  # one row


def write_thunderstorm(locs: DataFrame, path: str, pixelsize: float) -> None:
    """The layout that read_thunderstorm reads, each part with its header; the id is the row's loc_id."""
    nm = lambda c: F.col(c) * pixelsize
    out = [F.col("loc_id").alias("id"), F.col("frame"), nm("x").alias("x [nm]"), nm("y").alias("y [nm]")]
    solid = "z" in locs.columns
    out += [F.col("z").alias("z [nm]"), nm("sx").alias("sigma1 [nm]"), nm("sy").alias("sigma2 [nm]")] if solid else [nm("sx").alias("sigma [nm]")]
    out += [F.col("photons").cast("long").alias("intensity [photon]"), F.col("bg").cast("long").alias("offset [photon]"), F.lit(0).alias("bkgstd [photon]")]
    out += [((F.col("lpx") + F.col("lpy")) / 2 * pixelsize).alias("uncertainty_xy [nm]")]
    out += [F.col("len").alias("detections")] if "len" in locs.columns else []
    locs.select(*out).write.csv(path, header=True)


def write_drift(drift: DataFrame, path: str) -> None:
    """dx and dy (and dz, if there) of each frame in a line, in order of frame. A drift is as long as its movie and is one part."""
    columns = ["dx", "dy"] + (["dz"] if "dz" in drift.columns else [])
    line = F.format_string(" ".join(["%.18e"] * len(columns)), *columns)
    write_lines(drift.repartition(1).sortWithinPartitions("frame"), line, path)


def read_drift(spark: SparkSession, path: str) -> DataFrame:
    """(frame, dx, dy and, with three columns, dz): the line number is the frame. Other numbers of columns are an error."""
    text = F.regexp_replace("value", r"\s+$", "")
    lines = spark.read.text(path, wholetext=True).where(F.length(text) > 0).select(F.posexplode(F.split(text, r"\r?\n")).alias("frame", "line"))
    lines = lines.select(F.col("frame").cast("long").alias("frame"), F.split(F.trim("line"), " +").alias("n"))
    sizes = [r[0] for r in lines.select(F.size("n")).distinct().collect()]
    if sizes and (len(sizes) > 1 or sizes[0] not in (2, 3)):
        raise ValueError(f"a drift has 2 or 3 columns, not {sorted(sizes)}")
    names = ["dx", "dy", "dz"][: sizes[0] if sizes else 2]
    return lines.select("frame", *[F.col("n")[i].cast("double").alias(c) for i, c in enumerate(names)])


def picks_table(spark: SparkSession, regions: dict, pixelsize: float = 1.0) -> tuple[DataFrame, str, float | None]:
    """(table, shape, size) of a picks description: pick_id and x, y of circles and squares, x0, y0, x1, y1 of rectangles,
    lists xs, ys of polygons. The shape is in small letters, the size (diameter, side, width; none for polygons) is in pixels."""
    shape = regions.get("Shape") or ("Circle" if {"Centers", "Diameter"} <= set(regions) else None)
    kinds = {"Circle": ("Centers", "Diameter"), "Square": ("Centers", "Side Length"), "Rectangle": ("Center-Axis-Points", "Width"), "Polygon": ("Vertices", None)}
    if shape not in kinds:
        raise ValueError("no description of picks")
    places, measure = kinds[shape]
    in_nm = regions.get(f"{measure} (nm)")
    size = in_nm / pixelsize if in_nm is not None else regions.get(measure)
    if shape == "Polygon":
        rows, schema = [(i, [float(x) for x, _ in p], [float(y) for _, y in p]) for i, p in enumerate(regions[places])], "xs array<double>, ys array<double>"
    elif shape == "Rectangle":
        rows, schema = [(i, *map(float, [*a, *b])) for i, (a, b) in enumerate(regions[places])], "x0 double, y0 double, x1 double, y1 double"
    else:
        rows, schema = [(i, float(x), float(y)) for i, (x, y) in enumerate(regions[places])], "x double, y double"
    return spark.createDataFrame(rows, f"pick_id long, {schema}"), shape.lower(), size
