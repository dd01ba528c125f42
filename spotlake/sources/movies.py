"""Raw movies: files of nothing but pixels, frame after frame, read by ranges of frames and written in parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detection import MOVIE


def _opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path.removeprefix("file:"))


def read_raw(spark: SparkSession, path: str, info: dict, frames_per_task: int = 64) -> DataFrame:
    """A movie (frame, height, width, dtype, pixels) from a raw file that all executors can open.

    info: the description's Frames, Height, Width, Data Type and Byte Order ("<" or ">"); pixels come out little-endian. Each
    task reads its own range of bytes, a frame at a time. A file shorter than described is an error.
    """
    frames, height, width, dtype = info["Frames"], info["Height"], info["Width"], np.dtype(info["Data Type"])
    size, order = height * width * dtype.itemsize, info.get("Byte Order", "<")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, name = _opened(path)
        for batch in batches:
            for first in batch.column(0).to_pylist():
                with fs.open_input_file(name) as file:
                    for frame in range(first, min(first + frames_per_task, frames)):
                        pixels = file.read_at(size, frame * size)
                        if len(pixels) < size:
                            raise ValueError(f"{path} ends before frame {frame}")
                        if order == ">":
                            pixels = np.frombuffer(pixels, dtype.newbyteorder(">")).astype(dtype.newbyteorder("<")).tobytes()
                        row = {"frame": frame, "height": height, "width": width, "dtype": dtype.name, "pixels": pixels}
                        yield pa.RecordBatch.from_pylist([row], pa.schema([("frame", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("dtype", pa.string()), ("pixels", pa.binary())]))

    tasks = max(-(-frames // frames_per_task), 1)
    return spark.range(0, frames, frames_per_task, tasks).mapInArrow(read, MOVIE)


def write_raw(movie: DataFrame, path: str, frames_per_part: int = 64) -> DataFrame:
    """(part, file, first, frames): a folder of raw files, each of up to frames_per_part consecutive frames, whose concatenation in
    order of part is the movie. A repeated task writes the same file again. The result is written when it is read."""

    def write(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("frame")
        part = rows["part"][0].as_py()
        fs, folder = _opened(path)
        fs.create_dir(folder, recursive=True)
        file = f"{folder}/part-{part:08d}.raw"
        with fs.open_output_stream(file) as out:
            for pixels in rows["pixels"].to_pylist():
                out.write(pixels)
        return pa.table({"part": [part], "file": [file], "first": [rows["frame"][0].as_py()], "frames": [len(rows)]})

    parted = movie.select(F.floor(F.col("frame") / frames_per_part).alias("part"), "frame", "pixels")
    return parted.groupBy("part").applyInArrow(write, "part long, file string, first long, frames long")
