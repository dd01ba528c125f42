"""TIFF movies: classic and large files of either byte order, several files of one movie, frames read by their own bytes."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detection import MOVIE
from .movies import _opened

#: Bytes and struct codes of the types of a directory's entries, by number.
KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, PACKING, TEXT, STRIPS, SAMPLES, SIZES, TILES, FORMAT = 256, 257, 258, 259, 270, 273, 277, 279, 324, 339
PLAIN, DEFLATE, RUNS = (1,), (8, 32946), (32773,)
PLACES = "file string, number long, height int, width int, dtype string, big boolean, packing int, offsets array<long>, sizes array<long>"


class Directories:
    """The image directories of a file, one after the other."""

    def __init__(self, file: pyarrow.NativeFile):
        self.file = file
        head = file.read_at(16, 0)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2])
        kind = struct.unpack(f"{self.order}H", head[2:4])[0] if self.order else None
        if kind not in (42, 43):
            raise ValueError("not a TIFF file")
        self.large = kind == 43
        self.first = struct.unpack(f"{self.order}Q", head[8:16])[0] if self.large else struct.unpack(f"{self.order}I", head[4:8])[0]

    def _values(self, kind: int, count: int, place: int, room: int) -> tuple | bytes:
        code = KINDS.get(kind)
        if code is None:
            return ()
        size = struct.calcsize(code) * count
        at = place if size <= room else struct.unpack(f"{self.order}{'Q' if self.large else 'I'}", self.file.read_at(room, place))[0]
        data = self.file.read_at(size, at)
        return data if code == "s" else struct.unpack(f"{self.order}{count}{code}", data)

    def __iter__(self) -> Iterator[dict]:
        at, seen = self.first, set()
        length, entry, room = (8, 20, 8) if self.large else (2, 12, 4)
        while at:
            if at in seen:
                raise ValueError("the directories of the file run in a circle")
            seen.add(at)
            n = struct.unpack(f"{self.order}{'Q' if self.large else 'H'}", self.file.read_at(length, at))[0]
            table = self.file.read_at(n * entry + room, at + length)
            tags = {}
            for k in range(n):
                tag, kind = struct.unpack(f"{self.order}HH", table[k * entry : k * entry + 4])
                count = struct.unpack(f"{self.order}{'Q' if self.large else 'I'}", table[k * entry + 4 : k * entry + 4 + room])[0]
                if tag in (WIDTH, HEIGHT, BITS, PACKING, TEXT, STRIPS, SAMPLES, SIZES, TILES, FORMAT):
                    tags[tag] = self._values(kind, count, at + length + k * entry + 4 + room, room)
            yield tags
            at = struct.unpack(f"{self.order}{'Q' if self.large else 'I'}", table[n * entry :])[0]


def _kind(tags: dict) -> str:
    bits, form = tags.get(BITS, (1,))[0], tags.get(FORMAT, (1,))[0]
    name = {1: "uint", 2: "int", 3: "float"}.get(form, "") + str(bits)
    if name not in ("uint8", "uint16", "uint32", "int8", "int16", "int32", "float32", "float64") or tags.get(SAMPLES, (1,))[0] != 1:
        raise ValueError("only grey images of whole bytes are movies")
    if TILES in tags:
        raise ValueError("images in tiles are no movie of this reader")
    if tags.get(PACKING, (1,))[0] not in PLAIN + DEFLATE + RUNS:
        raise ValueError(f"packing {tags[PACKING][0]} is unknown")
    return name


def _places(file: str) -> Iterator[dict]:
    """A row for each frame of a file. A file with one directory whose text names several images has them one after the other."""
    fs, name = _opened(file)
    with fs.open_input_file(name) as opened:
        directories, number = Directories(opened), 0
        for tags in directories:
            kind = _kind(tags)
            row = {"file": file, "height": tags[HEIGHT][0], "width": tags[WIDTH][0], "dtype": kind, "big": directories.order == ">", "packing": tags.get(PACKING, (1,))[0]}
            size = row["height"] * row["width"] * np.dtype(kind).itemsize
            sizes = list(tags.get(SIZES, (size,)))
            yield row | {"number": number, "offsets": list(tags[STRIPS]), "sizes": sizes}
            number += 1
            if number == 1:
                only = row | {"start": tags[STRIPS][0], "size": size}
                named = re.search(rb"ImageJ[^\x00]*?images=(\d+)", bytes(tags.get(TEXT, b"")), re.S)
        if number == 1 and named and only["packing"] in PLAIN:
            start, size = only.pop("start"), only.pop("size")
            for k in range(1, int(named[1])):
                yield only | {"number": k, "offsets": [start + k * size], "sizes": [size]}


def siblings(path: str) -> list[str]:
    """Files of one movie: name.ome.tif, name_1.ome.tif, name_2.ome.tif, ... as far as they are there; else the file alone."""
    stem = re.fullmatch(r"(.*?)(\.ome\.tiff?)", path)
    files = [path]
    fs, _ = _opened(path)
    while stem and fs.get_file_info(_opened(more := f"{stem[1]}_{len(files)}{stem[2]}")[1]).type == pyarrow.fs.FileType.File:
        files.append(more)
    return files


def _unpacked(data: bytes, packing: int) -> bytes:
    if packing in DEFLATE:
        return zlib.decompress(data)
    if packing not in RUNS:
        return data
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += 2 if n > 128 else 1
    return bytes(out)


def frame_places(spark: SparkSession, files: list[str]) -> DataFrame:
    """PLACES with `frame`: where each frame's bytes lie. The directories of a file are a chain, which one task follows, a row at a
    time; frames of the files are numbered one after the other."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in PLACES.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        schema = pa.schema([*zip(names, kinds), ("part", pa.int64())])
        for batch in batches:
            for file, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for row in _places(file):
                    rows.append(row | {"part": part})
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    asked = spark.createDataFrame(list(zip(files, range(len(files)))), "file string, part long").repartition(len(files), "part")
    found = asked.mapInArrow(walk, PLACES + ", part long")
    if len(files) == 1:
        return found.withColumn("frame", F.col("number"))
    counts = {r["part"]: r["count"] for r in found.groupBy("part").count().collect()}
    starts = [sum(counts.get(k, 0) for k in range(part)) for part in range(len(files))]
    return found.withColumn("frame", F.col("number") + F.array(*map(F.lit, starts))[F.col("part").cast("int")])


def read_tiff(spark: SparkSession, path: str, frames: tuple[int, int] | None = None, tasks: int | None = None) -> DataFrame:
    """A movie (frame, height, width, dtype, pixels) from a TIFF file that all executors can open, with its sibling files.

    Classic and large files, either byte order (pixels come out little-endian), plain, deflated or run-length strips. frames: first
    and one after the last; only their bytes are read. Tasks read the bytes of their own frames, a frame at a time. Images that
    are not grey, in tiles or packed otherwise, and frames with fewer bytes than their size, are errors.
    """
    places = frame_places(spark, siblings(path))
    if frames is not None:
        places = places.where((F.col("frame") >= frames[0]) & (F.col("frame") < frames[1]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("frame", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("dtype", pa.string()), ("pixels", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                fs, name = _opened(row["file"])
                dtype = np.dtype(row["dtype"])
                size = row["height"] * row["width"] * dtype.itemsize
                with fs.open_input_file(name) as file:
                    pixels = b"".join(_unpacked(file.read_at(n, at), row["packing"]) for at, n in zip(row["offsets"], row["sizes"]))[:size]
                if len(pixels) < size:
                    raise ValueError(f"{row['file']}: frame {row['number']} is too short")
                if row["big"]:
                    pixels = np.frombuffer(pixels, dtype.newbyteorder(">")).astype(dtype.newbyteorder("<")).tobytes()
                yield pa.RecordBatch.from_pylist([{"frame": row["frame"], "height": row["height"], "width": row["width"], "dtype": dtype.name, "pixels": pixels}], schema)

    spread = places.repartition(tasks or max(spark.sparkContext.defaultParallelism, 1), "frame")
    return spread.mapInArrow(read, MOVIE)
