"""Tables in HDF5 files: groups and headers are followed by reads of a few bytes; rows are read by the tasks, each its own bytes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

from ..operators.tables import ensure_sanity
from .exports import described
from .movies import _opened

SIGNATURE = b"\x89HDF\r\n\x1a\n"
#: Fixed values of the format: kinds of header messages, and filters by number.
SPACE, LINK_TABLE, DATATYPE, LINK, LAYOUT, FILTERS, MORE, SYMBOLS = 0x1, 0x2, 0x3, 0x6, 0x8, 0xB, 0x10, 0x11
DEFLATE, SHUFFLE, CHECKSUM = 1, 2, 3
NOWHERE = 0xFFFFFFFFFFFFFFFF
#: Rows of a contiguous table that a task reads at a time.
ROWS = 100_000


class Dataset(NamedTuple):
    """shape, element type, where its bytes are (one run, or the root of a tree of chunks), the chunks' shape and their filters."""

    shape: tuple[int, ...]
    dtype: np.dtype
    address: int
    chunk: tuple[int, ...] | None
    filters: tuple[int, ...]
    inside: bytes | None


class Hdf5:
    """Objects of a file with superblock 0 to 3, groups as symbol tables or as links in their headers."""

    def __init__(self, file: pyarrow.NativeFile):
        self.file = file
        head = file.read_at(96, 0)
        if head[:8] != SIGNATURE:
            raise ValueError("not an HDF5 file")
        version = head[8]
        if version > 3:
            raise ValueError(f"superblock {version} is unknown")
        if (head[13:15] if version < 2 else head[9:11]) != b"\x08\x08":
            raise ValueError("only addresses of eight bytes are read")
        at = {0: 24, 1: 28}.get(version, 12)
        (base,) = struct.unpack("<Q", head[at : at + 8])
        if base:
            raise ValueError("a block before the file is not read")
        place = at + 32 + 8 if version < 2 else at + 24
        (self.root,) = struct.unpack("<Q", head[place : place + 8])

    def _messages(self, address: int) -> Iterator[tuple[int, bytes]]:
        """Kind and bytes of the messages of an object's header, continuations included."""
        head = self.file.read_at(64, address)
        if head[:4] == b"OHDR":
            flags, at = head[5], 6 + (16 if head[5] & 0x20 else 0) + (4 if head[5] & 0x10 else 0)
            width = 1 << (flags & 3)
            size = int.from_bytes(head[at : at + width], "little")
            todo, tracked, new = [(address + at + width, size)], bool(flags & 4), True
        else:
            if head[0] != 1:
                raise ValueError("the object has no header that is known")
            todo, tracked, new = [(address + 16, struct.unpack("<I", head[8:12])[0])], False, False
        while todo:
            start, size = todo.pop(0)
            data, at = self.file.read_at(size, start), 0
            room = (6 if tracked else 4) if new else 8
            while at + room <= len(data):
                kind, length = (data[at], *struct.unpack("<H", data[at + 1 : at + 3])) if new else struct.unpack("<HH", data[at : at + 4])
                body = data[at + room : at + room + length]
                at += room + length
                if kind == MORE:
                    where, long = struct.unpack("<QQ", body[:16])
                    todo.append((where + 4, long - 8) if new else (where, long))
                else:
                    yield kind, body

    def members(self, address: int) -> dict[str, int]:
        """Names and addresses of what a group holds."""
        found: dict[str, int] = {}
        for kind, body in self._messages(address):
            if kind == SYMBOLS:
                tree, heap = struct.unpack("<QQ", body[:16])
                (names,) = struct.unpack("<Q", self.file.read_at(8, heap + 24))
                for node in self._leaves(tree, 0, 0):
                    (n,) = struct.unpack("<H", self.file.read_at(2, node + 6))
                    for entry in struct.iter_unpack("<QQ24x", self.file.read_at(40 * n, node + 8)):
                        found[self._name(names + entry[0])] = entry[1]
            elif kind == LINK:
                flags, at = body[1], 2 + (1 if body[1] & 8 else 0) + (8 if body[1] & 4 else 0) + (1 if body[1] & 16 else 0)
                width = 1 << (flags & 3)
                length = int.from_bytes(body[at : at + width], "little")
                name = body[at + width : at + width + length].decode()
                if not (flags & 8 and body[2]):  # hard links only
                    (found[name],) = struct.unpack("<Q", body[at + width + length : at + width + length + 8])
            elif kind == LINK_TABLE and struct.unpack("<Q", body[2 + (8 if body[1] & 1 else 0) :][:8])[0] != NOWHERE:
                raise ValueError("groups whose links are in a heap are not read")
        return found

    def _name(self, at: int) -> str:
        data = b""
        while b"\0" not in data:
            more = self.file.read_at(64, at + len(data))
            if not more:
                break
            data += more
        return data.split(b"\0")[0].decode()

    def _leaves(self, address: int, kind: int, axes: int) -> Iterator:
        """Children of the lowest nodes of a tree: of groups (kind 0) their addresses, of chunks (kind 1) (size, skipped filters,
        first element on each axis, address)."""
        if address == NOWHERE:
            return
        head = self.file.read_at(24, address)
        if head[:4] != b"TREE" or head[4] != kind:
            raise ValueError("a tree of the file is broken")
        level, n = head[5], struct.unpack("<H", head[6:8])[0]
        key = 8 if kind == 0 else 8 + 8 * (axes + 1)
        data = self.file.read_at(n * (key + 8), address + 24)
        for k in range(n):
            one = data[k * (key + 8) : (k + 1) * (key + 8)]
            (child,) = struct.unpack("<Q", one[key:])
            if level:
                yield from self._leaves(child, kind, axes)
            elif kind == 0:
                yield child
            else:
                yield (*struct.unpack("<II", one[:8]), struct.unpack(f"<{axes}Q", one[8 : 8 + 8 * axes]), child)

    def find(self, path: str) -> int | None:
        at = self.root
        for name in filter(None, path.split("/")):
            if (at := self.members(at).get(name)) is None:
                return None
        return at

    def dataset(self, address: int) -> Dataset | None:
        """What the object's header tells of it; None if it is a group."""
        shape = dtype = layout = None
        filters: tuple[int, ...] = ()
        for kind, body in self._messages(address):
            if kind == SPACE:
                rank, at = body[1], 8 if body[0] == 1 else 4
                shape = struct.unpack(f"<{rank}Q", body[at : at + 8 * rank])
            elif kind == DATATYPE:
                dtype, _ = element_type(body)
            elif kind == LAYOUT:
                layout = body
            elif kind == FILTERS:
                filters = tuple(_filters(body))
        if layout is None or dtype is None or shape is None:
            return None
        if layout[0] != 3:
            raise ValueError(f"layout {layout[0]} of datasets is not read")
        if layout[1] == 0:
            return Dataset(shape, dtype, 0, None, filters, layout[4 : 4 + struct.unpack("<H", layout[2:4])[0]])
        if layout[1] == 1:
            return Dataset(shape, dtype, struct.unpack("<Q", layout[2:10])[0], None, filters, None)
        axes = layout[2] - 1
        return Dataset(shape, dtype, struct.unpack("<Q", layout[3:11])[0], struct.unpack(f"<{axes}I", layout[11 : 11 + 4 * axes]), filters, None)

    def chunks(self, data: Dataset) -> Iterator[tuple[int, int, tuple[int, ...], int]]:
        yield from self._leaves(data.address, 1, len(data.shape))


def _filters(body: bytes) -> Iterator[int]:
    at = 8 if body[0] == 1 else 2
    for _ in range(body[1]):
        (number,) = struct.unpack("<H", body[at : at + 2])
        named = body[0] == 1 or number >= 256
        length = struct.unpack("<H", body[at + 2 : at + 4])[0] if named else 0
        at += 4 if named else 2
        (values,) = struct.unpack("<H", body[at + 2 : at + 4])
        if body[0] == 1:
            length, values = -(-length // 8) * 8, values + values % 2
        at += 4 + length + 4 * values
        if number not in (DEFLATE, SHUFFLE, CHECKSUM):
            raise ValueError(f"filter {number} is unknown")
        yield number


def element_type(body: bytes) -> tuple[np.dtype, int]:
    """The type that a message describes, and how many of its bytes do so: whole and real numbers, truth values, texts of fixed
    length, and records of them."""
    kind, version, bits = body[0] & 15, body[0] >> 4, body[1]
    (size,) = struct.unpack("<I", body[4:8])
    order = ">" if bits & 1 else "<"
    if kind == 0:
        return np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}"), 12
    if kind == 1:
        return np.dtype(f"{order}f{size}"), 20
    if kind == 3:
        return np.dtype(f"S{size}"), 8
    if kind == 8:
        base, used = element_type(body[8:])
        at, members = 8 + used, struct.unpack("<H", body[1:3])[0]
        for _ in range(members):
            length = body.index(b"\0", at) + 1 - at
            at += length if version == 3 else -(-length // 8) * 8
        return base, at + members * base.itemsize
    if kind != 6:
        raise ValueError(f"elements of class {kind} are not read")
    at, names, kinds, offsets = 8, [], [], []
    for _ in range(struct.unpack("<H", body[1:3])[0]):
        end = body.index(b"\0", at)
        names.append(body[at:end].decode())
        at += end + 1 - at if version == 3 else -(-(end + 1 - at) // 8) * 8
        width = 4 if version < 3 else max(1, (size.bit_length() + 7) // 8)
        offsets.append(int.from_bytes(body[at : at + width], "little"))
        at += width + (28 if version == 1 else 0)
        one, used = element_type(body[at:])
        kinds.append(one)
        at += used
    return np.dtype({"names": names, "formats": kinds, "offsets": offsets, "itemsize": size}), at


def unfiltered(data: bytes, filters: tuple[int, ...], skipped: int, width: int) -> bytes:
    """A chunk's bytes as they were; bits of `skipped` name filters that were left out."""
    for k in reversed(range(len(filters))):
        if skipped >> k & 1:
            continue
        if filters[k] == DEFLATE:
            data = zlib.decompress(data)
        elif filters[k] == CHECKSUM:
            data = data[:-4]
        else:
            whole = len(data) // width * width
            data = np.frombuffer(data[:whole], np.uint8).reshape(width, -1).T.tobytes() + data[whole:]
    return data


def _spark_type(dtype: np.dtype) -> str:
    if dtype.kind == "S":
        return "string"
    return {"f2": "float", "f4": "float", "f8": "double", "u1": "int", "u2": "int", "u4": "long", "u8": "decimal(20,0)", "i1": "int", "i2": "int", "i4": "int", "i8": "long"}[dtype.kind + str(dtype.itemsize)]


def _arrow(values: np.ndarray) -> pa.Array:
    kind = _spark_type(values.dtype)
    if kind == "string":
        return pa.array([v.decode() for v in values.tolist()], pa.string())
    if kind.startswith("decimal"):
        return pa.array(values.astype(object), pa.uint64()).cast(pa.decimal128(20, 0))
    return pa.array(np.ascontiguousarray(values).astype({"float": "f4", "double": "f8", "int": "i4", "long": "i8"}[kind]))


def find_table(path: str, keys: list[str]) -> tuple[str, Dataset]:
    """The first of keys that the file has as a table of records, as itself or as `table` inside it."""
    fs, name = _opened(path)
    with fs.open_input_file(name) as file:
        h = Hdf5(file)
        for key in keys:
            for place in (key, f"{key}/table"):
                at = h.find(place)
                data = h.dataset(at) if at is not None else None
                if data is not None and data.dtype.names and len(data.shape) == 1:
                    return key, data
    raise KeyError(f"{path} has no table of {', '.join(keys)}")


def read_table(spark: SparkSession, path: str, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """Rows of the first table of keys, with `loc_id`, the number of the row, unless the table has such a column.

    columns: only these are made into columns; records lie whole in the file, so their bytes are read all the same. Contiguous tables
    are dealt by ranges of rows. Of chunked ones a task follows the tree, a row at a time, and others read the chunks; rows
    of chunks that were never written are 0. No key is a KeyError, an unknown form of a file a ValueError.
    """
    _, data = find_table(path, keys)
    names = [n for n in data.dtype.names if columns is None or n in columns]
    numbered = "loc_id" not in data.dtype.names
    schema = ", ".join((["loc_id long"] if numbered else []) + [f"`{n}` {_spark_type(data.dtype[n])}" for n in names])
    total, width = data.shape[0], data.dtype.itemsize

    def batch(rows: np.ndarray, first: int) -> pa.RecordBatch:
        arrays = ([pa.array(np.arange(first, first + len(rows)))] if numbered else []) + [_arrow(rows[n]) for n in names]
        return pa.RecordBatch.from_arrays(arrays, (["loc_id"] if numbered else []) + names)

    if data.chunk is None:

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, name = _opened(path)
            for asked in batches:
                for first in asked.column(0).to_pylist():
                    n = min(ROWS, total - first)
                    if data.inside is not None or data.address == NOWHERE:
                        found = (data.inside or bytes(total * width))[first * width : (first + n) * width]
                    else:
                        with fs.open_input_file(name) as file:
                            found = file.read_at(n * width, data.address + first * width)
                    if len(found) < n * width:
                        raise ValueError(f"{path} ends inside its table")
                    yield batch(np.frombuffer(found, data.dtype), first)

        return spark.range(0, total, ROWS, max(1, -(-total // ROWS))).mapInArrow(read, schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, name = _opened(path)
        for _ in batches:
            with fs.open_input_file(name) as file:
                given = {first: (size, skipped, at) for size, skipped, (first,), at in Hdf5(file).chunks(data)}
            rows = [(first, *given.get(first, (0, 0, -1))) for first in range(0, total, data.chunk[0])]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["first", "size", "skipped", "at"])

    def read_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, name = _opened(path)
        for asked in batches:
            for row in asked.to_pylist():
                n = min(data.chunk[0], total - row["first"])
                found = bytes(n * width)
                if row["at"] >= 0:
                    with fs.open_input_file(name) as file:
                        found = unfiltered(file.read_at(row["size"], row["at"]), data.filters, row["skipped"], width)
                yield batch(np.frombuffer(found[: n * width], data.dtype), row["first"])

    places = spark.range(0, 1 if total else 0, 1, 1).mapInArrow(walk, "first long, size long, skipped long, at long")
    return places.repartition(max(spark.sparkContext.defaultParallelism, 1), "first").mapInArrow(read_chunks, schema)


def load_info(path: str) -> list[dict]:
    """The documents of the .yaml file beside a movie or table."""
    try:
        import yaml
    except ImportError as absent:
        raise RuntimeError("descriptions in YAML need the yaml package") from absent
    fs, name = _opened(path.rsplit(".", 1)[0] + ".yaml")
    with fs.open_input_file(name) as file:
        return [entry for entry in yaml.safe_load_all(file.read().decode()) if entry is not None]


def load_locs(spark: SparkSession, path: str) -> tuple[DataFrame, list[dict]]:
    """Table `locs` with its description; rows with missing numbers, outside the view or with negative measures go."""
    info = load_info(path)
    rows = read_table(spark, path, ["locs"])
    return ensure_sanity(rows, described(info, "Width"), described(info, "Height")), info


def load_filter(spark: SparkSession, path: str) -> tuple[DataFrame, list[dict]]:
    """The first of the tables `locs`, `groups` (with the description) and `clusters` (without)."""
    key, _ = find_table(path, ["locs", "groups", "clusters"])
    return read_table(spark, path, [key]), load_info(path) if key != "clusters" else []


def load_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Table `clusters`, or else `locs`."""
    return read_table(spark, path, ["clusters", "locs"])


def load_identifications(spark: SparkSession, path: str) -> tuple[DataFrame, list[dict]]:
    return read_table(spark, path, ["identifications"]), load_info(path)
