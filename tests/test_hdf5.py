"""HDF5 files written byte by byte from the format's description, and read back."""

import struct
import zlib

import numpy as np
import pytest

from spotlake.sources import hdf5

KIND = np.dtype([("frame", "<u4"), ("x", "<f4"), ("y", "<f8"), ("photons", ">f4"), ("ok", "<i1"), ("name", "S5"), ("n", "<i8")])


def table(n, seed=0):
    rng = np.random.default_rng(seed)
    out = np.zeros(n, KIND)
    out["frame"], out["x"], out["y"], out["photons"], out["n"] = np.arange(n), rng.uniform(0, 40, n), rng.uniform(0, 40, n), rng.uniform(1, 9, n), rng.integers(-5, 5, n) * 10**12
    out["ok"], out["name"] = np.arange(n) % 2, np.array([f"r{k}" for k in range(n)], "S5")
    return out


def number_type(kind):
    order = 1 if kind.byteorder == ">" else 0
    if kind.kind == "S":
        return struct.pack("<BBBBI", 0x13, 0, 0, 0, kind.itemsize)
    if kind.kind == "f":
        props = struct.pack("<HHBBBBI", 0, kind.itemsize * 8, *((23, 8, 0, 23, 127) if kind.itemsize == 4 else (52, 11, 0, 52, 1023)))
        return struct.pack("<BBBBI", 0x11, order | 0x20, kind.itemsize * 8 - 1, 0, kind.itemsize) + props
    return struct.pack("<BBBBIHH", 0x10, order | (8 if kind.kind == "i" else 0), 0, 0, kind.itemsize, 0, kind.itemsize * 8)


def record_type(dtype, version):
    out = struct.pack("<BHBI", version << 4 | 6, len(dtype.names), 0, dtype.itemsize)
    for name in dtype.names:
        kind, offset = dtype.fields[name][:2]
        text = name.encode() + b"\0"
        out += text if version == 3 else text.ljust(-(-len(text) // 8) * 8, b"\0")
        out += bytes([offset]) if version == 3 else struct.pack("<I", offset)
        out += struct.pack("<B3xI4x16x", 0, 0) if version == 1 else b""
        one = number_type(kind)
        if name == "ok":  # a truth value: whole numbers with names
            names = b"FALSE\0TRUE\0" if version == 3 else b"FALSE\0\0\0TRUE\0\0\0\0"
            one = struct.pack("<BHBI", version << 4 | 8, 2, 0, 1) + one + names + b"\0\1"
        out += one
    return out


class Writer:
    def __init__(self, new):
        self.new, self.out = new, bytearray(96 if not new else 48)

    def put(self, data):
        self.out += b"\0" * (-len(self.out) % 8)
        at = len(self.out)
        self.out += data
        return at

    def header(self, messages):
        """An object's header; the last message lies in a continuation."""
        if self.new:
            pack = lambda ms: b"".join(struct.pack("<BHB", kind, len(body), 0) + body for kind, body in ms)
            more = pack(messages[-1:])
            rest = self.put(b"OCHK" + more + b"\0" * 4)
            data = pack(messages[:-1] + [(0x10, struct.pack("<QQ", rest, len(more) + 8))])
            return self.put(b"OHDR" + bytes([2, 2]) + struct.pack("<I", len(data)) + data + b"\0" * 4)
        pad = lambda b: b.ljust(-(-len(b) // 8) * 8, b"\0")
        pack = lambda ms: b"".join(struct.pack("<HHB3x", kind, len(pad(body)), 0) + pad(body) for kind, body in ms)
        more = pack(messages[-1:])
        rest = self.put(more)
        data = pack(messages[:-1] + [(0x10, struct.pack("<QQ", rest, len(more)))])
        return self.put(struct.pack("<BxHII4x", 1, len(messages) + 1, 1, len(data)) + data)

    def group(self, members):
        if self.new:
            links = [(6, bytes([1, 0, len(name)]) + name.encode() + struct.pack("<Q", at)) for name, at in members.items()]
            return self.header([(2, struct.pack("<BBQQ", 0, 0, hdf5.NOWHERE, hdf5.NOWHERE)), *links])
        names, offsets = b"\0" * 8, {}
        for name in sorted(members):
            offsets[name] = len(names)
            names += (name.encode() + b"\0").ljust(-(-(len(name) + 1) // 8) * 8, b"\0")
        heap = self.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), 1, self.put(names)))
        node = self.put(b"SNOD" + struct.pack("<BBH", 1, 0, len(members)) + b"".join(struct.pack("<QQ24x", offsets[n], members[n]) for n in sorted(members)))
        tree = self.put(b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, hdf5.NOWHERE, hdf5.NOWHERE) + struct.pack("<QQQ", 0, node, offsets[max(members)]))
        return self.header([(0x11, struct.pack("<QQ", tree, heap)), (0, b"")])

    def dataset(self, rows, version=1, chunk=None, filters=(), compact=False):
        messages = [(1, struct.pack("<BBB5xQ", 1, 1, 0, len(rows)) if not self.new else struct.pack("<BBBBQ", 2, 1, 0, 1, len(rows))), (3, record_type(rows.dtype, version))]
        if chunk is None and compact:
            return self.header([*messages, (8, struct.pack("<BBH", 3, 0, rows.nbytes) + rows.tobytes())])
        if chunk is None:
            return self.header([*messages, (8, struct.pack("<BBQQ", 3, 1, self.put(rows.tobytes()), rows.nbytes))])
        width, nodes = rows.dtype.itemsize, []
        for first in range(0, len(rows), chunk):
            if first == 2 * chunk:
                continue  # a chunk that was never written
            part = np.zeros(chunk, rows.dtype)
            part[: len(rows[first : first + chunk])] = rows[first : first + chunk]
            data = part.tobytes()
            for f in filters:
                data = {1: zlib.compress, 2: lambda d: np.frombuffer(d, np.uint8).reshape(-1, width).T.tobytes(), 3: lambda d: d + b"sums"}[f](data)
            nodes.append(struct.pack("<IIQQQ", len(data), 0, first, 0, self.put(data)))
        half = len(nodes) // 2
        leaves = [self.put(b"TREE" + struct.pack("<BBHQQ", 1, 0, len(part), hdf5.NOWHERE, hdf5.NOWHERE) + b"".join(part) + bytes(24)) for part in (nodes[:half], nodes[half:])]
        root = self.put(b"TREE" + struct.pack("<BBHQQ", 1, 1, 2, hdf5.NOWHERE, hdf5.NOWHERE) + b"".join(struct.pack("<IIQQQ", 0, 0, 0, 0, at) for at in leaves) + bytes(24))
        pipe = struct.pack("<BB6x", 1, len(filters)) + b"".join(struct.pack("<HHHH8sII", f, 8, 0, 1, b"name", 0, 0) for f in filters)
        if self.new:
            pipe = struct.pack("<BB", 2, len(filters)) + b"".join(struct.pack("<HHHI", f, 0, 1, 0) for f in filters)
        return self.header([*messages, (0xB, pipe), (8, struct.pack("<BBBQII", 3, 2, 2, root, chunk, width))])

    def save(self, path, root):
        if self.new:
            self.out[:48] = hdf5.SIGNATURE + bytes([2, 8, 8, 0]) + struct.pack("<QQQQI", 0, hdf5.NOWHERE, len(self.out), root, 0)
        else:
            self.out[:96] = hdf5.SIGNATURE + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + struct.pack("<HHI", 4, 16, 0) + struct.pack("<QQQQ", 0, hdf5.NOWHERE, len(self.out), hdf5.NOWHERE) + struct.pack("<QQII16x", 0, root, 0, 0)
        path.write_bytes(bytes(self.out))


def same(frame, rows, zero=()):
    got = frame.sort_values("loc_id").reset_index(drop=True)
    assert len(got) == len(rows)
    for name in rows.dtype.names:
        want = [v.decode() for v in rows[name].tolist()] if rows.dtype[name].kind == "S" else rows[name].astype(float)
        for k, (a, b) in enumerate(zip(got[name], want)):
            assert a == ("" if isinstance(b, str) else 0) if k in zero else a == b


@pytest.mark.parametrize(("new", "version", "compact"), [(False, 1, False), (True, 3, False), (False, 2, True)])
def test_contiguous_tables(spark, tmp_path, monkeypatch, new, version, compact):
    rows, w = table(60), Writer(new)
    w.save(tmp_path / "a.hdf5", w.group({"other": w.group({"deep": w.dataset(table(3))}), "locs": w.dataset(rows, version, compact=compact)}))
    same(hdf5.read_table(spark, str(tmp_path / "a.hdf5"), ["locs"]).toPandas(), rows)
    monkeypatch.setattr(hdf5, "ROWS", 7)
    part = hdf5.read_table(spark, str(tmp_path / "a.hdf5"), ["none", "locs"], ["x", "frame"])
    assert part.columns == ["loc_id", "frame", "x"] and part.rdd.getNumPartitions() == 9
    assert [r.x for r in part.orderBy("loc_id").collect()] == rows["x"].tolist()
    same(hdf5.read_table(spark, str(tmp_path / "a.hdf5"), ["other/deep"]).toPandas(), table(3))


@pytest.mark.parametrize("new", [False, True])
@pytest.mark.parametrize("filters", [(), (1,), (2, 1), (2, 1, 3)])
def test_chunked_tables(spark, tmp_path, new, filters):
    rows, w = table(53), Writer(new)
    w.save(tmp_path / "a.hdf5", w.group({"locs": w.group({"table": w.dataset(rows, 3 if new else 1, 10, filters)})}))
    same(hdf5.read_table(spark, str(tmp_path / "a.hdf5"), ["locs"]).toPandas(), rows, zero=range(20, 30))


def test_locs_with_their_description(spark, tmp_path):
    pytest.importorskip("yaml")
    rows, w = table(20), Writer(False)
    rows["x"][3], rows["y"][4], rows["photons"][5] = np.nan, 99.0, -1.0
    w.save(tmp_path / "a.hdf5", w.group({"locs": w.dataset(rows)}))
    (tmp_path / "a.yaml").write_text("Width: 64\nHeight: 50\nFrames: 20\n---\nGenerated by: Link\n")
    locs, info = hdf5.load_locs(spark, str(tmp_path / "a.hdf5"))
    assert sorted(r.loc_id for r in locs.collect()) == [k for k in range(20) if k not in (3, 4, 5)]
    assert [e.get("Width") for e in info] == [64, None]
    w = Writer(False)
    w.save(tmp_path / "b.hdf5", w.group({"clusters": w.dataset(table(4))}))
    found, info = hdf5.load_filter(spark, str(tmp_path / "b.hdf5"))
    assert found.count() == 4 and info == [] and hdf5.load_clusters(spark, str(tmp_path / "b.hdf5")).count() == 4
    assert hdf5.load_clusters(spark, str(tmp_path / "a.hdf5")).count() == 20
    with pytest.raises(KeyError):
        hdf5.read_table(spark, str(tmp_path / "b.hdf5"), ["locs"])


def test_files_of_other_kinds(spark, tmp_path):
    (tmp_path / "a.hdf5").write_bytes(b"nothing" * 30)
    with pytest.raises(ValueError, match="not an HDF5 file"):
        hdf5.read_table(spark, str(tmp_path / "a.hdf5"), ["locs"])
    w = Writer(False)
    w.save(tmp_path / "b.hdf5", w.group({"locs": w.dataset(table(0))}))
    assert hdf5.read_table(spark, str(tmp_path / "b.hdf5"), ["locs"]).count() == 0
    broken = (tmp_path / "b.hdf5").read_bytes()
    (tmp_path / "c.hdf5").write_bytes(broken[:8] + b"\x09" + broken[9:])
    with pytest.raises(ValueError, match="superblock 9"):
        hdf5.find_table(str(tmp_path / "c.hdf5"), ["locs"])
