"""Viewports of a pyramid and TIFF movies written byte by byte."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotlake.sources import pyramid, tiff


def test_code_ranges_make_up_rectangles():
    code = lambda x, y: sum(((x >> k & 1) << 2 * k) | ((y >> k & 1) << 2 * k + 1) for k in range(4))
    rng = random.Random(1)
    for _ in range(60):
        x0, x1 = sorted(rng.choices(range(16), k=2))
        y0, y1 = sorted(rng.choices(range(16), k=2))
        got = {c for a, b in pyramid.code_ranges(x0, y0, x1, y1, 4) for c in range(a, b + 1)}
        assert got == {code(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)}
    many = pyramid.code_ranges(0, 5, 1023, 5, 10)
    assert len(many) <= pyramid.RANGES
    assert all(any(a <= sum(((x >> k & 1) << 2 * k) | ((5 >> k & 1) << 2 * k + 1) for k in range(10)) <= b for a, b in many) for x in range(1024))


@pytest.fixture(scope="module")
def laid_out(spark, tmp_path_factory):
    rng = np.random.default_rng(0)
    rows = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-2, 130, (4000, 2)))] + [(9000 + k, 40.25, 40.25) for k in range(500)] + [(1, None, 2.0)]
    path = f"{tmp_path_factory.mktemp('pyramid')}/p"
    pyramid.write_pyramid(spark.createDataFrame(rows, "loc_id long, x double, y double"), path, 128.0, 128.0)
    return path, [r for r in rows if r[1] is not None]


def test_viewports_hold_all_rows_inside(spark, laid_out):
    path, rows = laid_out
    rng = random.Random(3)
    views = [(x, y, x + w, y + h) for x, y, w, h in ((rng.uniform(0, 110), rng.uniform(0, 110), rng.uniform(0.5, 30), rng.uniform(0.5, 30)) for _ in range(5))]
    for x0, y0, x1, y1 in [*views, (40.0, 40.0, 41.0, 41.0), (120.0, 120.0, 140.0, 140.0)]:
        got = {r.loc_id for r in pyramid.read_viewport(spark, path, x0, y0, x1, y1).collect()}
        inside = {k for k, x, y in rows if x0 < x < x1 and y0 < y < y1}
        near = {k for k, x, y in rows if x0 - 16 <= min(x, 128) and max(0, x) < x1 + 16 and y0 - 16 <= min(y, 128) and max(0, y) < y1 + 16}
        assert inside <= got <= near
    assert pyramid.read_viewport(spark, path, 0.0, 0.0, 128.0, 128.0).count() == len(rows)
    assert pyramid.read_viewport(spark, path, 300.0, 0.0, 310.0, 10.0).count() == 0


def test_a_viewport_reads_its_own_files(spark, laid_out):
    path, rows = laid_out
    files = spark.read.parquet(f"{path}/rows").select(F.input_file_name().alias("f")).distinct().count()
    view = pyramid.read_viewport(spark, path, 40.0, 40.0, 44.0, 44.0)
    view.collect()
    plan = view._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().apply(0)
    read = plan.metrics().apply("numFiles").value()
    assert 0 < read <= 4 < files
    assert "_code" in view._jdf.queryExecution().toString().split("PushedFilters")[1][:200]


def test_levels_count_rows(spark, laid_out):
    path, rows = laid_out
    for level, size in enumerate((1.0, 4.0, 16.0)):
        want = {}
        for _, x, y in rows:
            at = tuple(min(max(int(np.floor(v / size)), 0), int(128 / size) - 1) for v in (x, y))
            want[at] = want.get(at, 0) + 1
        assert {(r.bx, r.by): r.n for r in pyramid.read_level(spark, path, level).collect()} == want
    assert pyramid.level_of((0, 0, 64, 10), 1.0, 3) == 0 and pyramid.level_of((0, 0, 65, 10), 1.0, 3) == 1 and pyramid.level_of((0, 0, 9e9, 1), 1.0, 3) == 2


def test_an_empty_pyramid(spark, tmp_path):
    pyramid.write_pyramid(spark.createDataFrame([(0, 1.0, 1.0)], "loc_id long, x double, y double"), f"{tmp_path}/one", 32.0, 32.0)
    assert pyramid.read_viewport(spark, f"{tmp_path}/one", 20.0, 20.0, 21.0, 21.0).count() == 0


def runs(data):
    """Run-length packing of pieces of up to 128 bytes, some of them repeats."""
    out, at = b"", 0
    while at < len(data):
        same = 1
        while same < 128 and at + same < len(data) and data[at + same] == data[at]:
            same += 1
        if same > 1:
            out, at = out + bytes([257 - same, data[at]]), at + same
        else:
            out, at = out + bytes([0, data[at]]), at + 1
    return out


def write_tiff(path, images, order="<", large=False, packing=1, strips=1, text=b""):
    """A file of directories, each after its image; strips of rows."""
    size, entry = ("Q", 20) if large else ("I", 12)
    room = struct.calcsize(size)
    head = struct.pack(f"{order}2sHHHQ", b"II" if order == "<" else b"MM", 43, 8, 0, 0) if large else struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, 0)
    out, link = bytearray(head), 8 if large else 4
    for image in images:
        kind = image.dtype
        parts = [image[k : k + -(-len(image) // strips)].astype(kind.newbyteorder(order)).tobytes() for k in range(0, len(image), -(-len(image) // strips))]
        parts = [{1: lambda p: p, 8: zlib.compress, 32773: runs}[packing](p) for p in parts]
        offsets = []
        for p in parts:
            offsets.append(len(out))
            out += p
        tags = {256: [image.shape[1]], 257: [image.shape[0]], 258: [kind.itemsize * 8], 259: [packing], 273: offsets, 277: [1], 279: [len(p) for p in parts], 339: [{"u": 1, "i": 2, "f": 3}[kind.kind]]}
        blocks = {}
        for tag, values in tags.items():
            data = struct.pack(f"{order}{len(values)}I", *values)
            if len(data) > room:
                blocks[tag] = len(out)
                out += data
        if text:
            blocks[270] = len(out)
            out += text
            tags[270] = text
        at = len(out)
        out[link : link + room] = struct.pack(f"{order}{size}", at)
        out += struct.pack(f"{order}{'Q' if large else 'H'}", len(tags))
        for tag in sorted(tags):
            values = tags[tag]
            data = struct.pack(f"{order}{size}", blocks[tag]) if tag in blocks else struct.pack(f"{order}{len(values)}I", *values).ljust(room, b"\0")
            out += struct.pack(f"{order}HH{size}", tag, 2 if tag == 270 else 4, len(values)) + data
        link = len(out)
        out += struct.pack(f"{order}{size}", 0)
    path.write_bytes(bytes(out))


def movie(n, dtype="uint16", seed=0):
    return [np.random.default_rng([seed, k]).integers(0, 200, (6, 9)).astype(dtype) for k in range(n)]


def read(spark, path, frames=None):
    rows = sorted(tiff.read_tiff(spark, str(path), frames).collect())
    return {r.frame: np.frombuffer(r.pixels, np.dtype(r.dtype).newbyteorder("<")).reshape(r.height, r.width) for r in rows}


@pytest.mark.parametrize(("order", "large", "dtype", "packing", "strips"), [("<", False, "uint16", 1, 1), (">", False, "uint16", 1, 4), ("<", True, "float32", 8, 2), (">", True, "int32", 32773, 3), ("<", False, "uint8", 32773, 1)])
def test_movies_come_back(spark, tmp_path, order, large, dtype, packing, strips):
    images = movie(7, dtype)
    write_tiff(tmp_path / "m.tif", images, order, large, packing, strips)
    got = read(spark, tmp_path / "m.tif")
    assert list(got) == list(range(7)) and all(np.array_equal(got[k], images[k]) and got[k].dtype == np.dtype(dtype) for k in got)
    assert list(read(spark, tmp_path / "m.tif", (2, 5))) == [2, 3, 4]


def test_sibling_files_are_one_movie(spark, tmp_path):
    images = movie(9)
    for name, part in (("m.ome.tif", images[:4]), ("m_1.ome.tif", images[4:6]), ("m_2.ome.tif", images[6:])):
        write_tiff(tmp_path / name, part)
    got = read(spark, tmp_path / "m.ome.tif")
    assert list(got) == list(range(9)) and all(np.array_equal(got[k], images[k]) for k in got)


def test_images_behind_one_directory(spark, tmp_path):
    images = movie(5)
    write_tiff(tmp_path / "m.tif", images[:1], text=b"ImageJ=1.53\nimages=5\nslices=5\n\0")
    raw = bytearray((tmp_path / "m.tif").read_bytes())
    first = raw[8 : 8 + images[0].nbytes]
    assert first == images[0].tobytes()
    # the directory goes behind the pixels of all frames
    body = b"".join(i.tobytes() for i in images[1:])
    write_tiff(tmp_path / "m.tif", [np.concatenate(images)], text=b"ImageJ=1.53\nimages=5\nslices=5\n\0")
    raw = (tmp_path / "m.tif").read_bytes()
    at = raw.index(struct.pack("<HHII", 257, 4, 1, 30))
    (tmp_path / "m.tif").write_bytes(raw[:at] + struct.pack("<HHII", 257, 4, 1, 6) + raw[at + 12 :])
    got = read(spark, tmp_path / "m.tif")
    assert len(body) and len(got) == 5 and all(np.array_equal(got[k], images[k]) for k in got)


def test_files_that_are_no_movie(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(b"nothing of that kind")
    with pytest.raises(Exception, match="not a TIFF file"):
        read(spark, tmp_path / "a.tif")
    write_tiff(tmp_path / "b.tif", movie(2))
    (tmp_path / "b.tif").write_bytes((tmp_path / "b.tif").read_bytes().replace(struct.pack("<HHII", 259, 4, 1, 1), struct.pack("<HHII", 259, 4, 1, 5)))
    with pytest.raises(Exception, match="packing 5 is unknown"):
        read(spark, tmp_path / "b.tif")
