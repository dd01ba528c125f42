import numpy as np
import pytest
from pyspark.sql import functions as F

from spotlake.functions import expressions as X
from spotlake.operators import drift, picks, rendering, resolution, tables
from spotlake.sources import movies


def beads(spark, shift, frames=400, with_z=False):
    rng = np.random.default_rng(3)
    places, rows = rng.uniform(10, 50, (80, 3)), []
    for f in range(frames):
        for k in rng.permutation(80)[:25]:
            x, y, z = places[k] + rng.normal(0, 0.03, 3)
            dx, dy, dz = shift(f)
            rows.append((len(rows), f + 7, float(x + dx), float(y + dy), float(100 * (z + dz))))
    return spark.createDataFrame(rows, "loc_id long, frame long, x double, y double, z double")


def test_drift_by_intersections(spark):
    rows = beads(spark, lambda f: (0.8 * f / 400, -0.5 * f / 400, 0.6 * f / 400))
    found = drift.intersection_drift(rows, 400, 50, 0.15, 0.45, pixelsize=100.0).toPandas().sort_values("frame")
    assert found["frame"].tolist() == list(range(7, 407))
    for c, total in (("dx", 0.8), ("dy", -0.5), ("dz", 60.0)):
        off = found[c].to_numpy() - total * (np.arange(400) / 400 - 0.5)
        assert abs(found[c].mean()) < 1e-9 and np.abs(off).max() < abs(total) * 0.25 + 0.02
    assert drift.intersection_drift(rows.where("false"), 5).agg(F.sum(F.abs("dx"))).first()[0] == 0
    counts = np.zeros(7)
    counts[5] = 9
    assert drift.harmonic_peak(counts, 7.0) == pytest.approx(2.0)
    assert drift.harmonic_peak(np.zeros(7), 7.0) == 0


def test_rings_and_resolution(spark):
    rng = np.random.default_rng(4)
    n = 21
    a, b = rng.random((2, n, n))
    rows = spark.createDataFrame([(i, j, float(a[i, j]), float(b[i, j])) for i in range(n) for j in range(n)], "iy long, ix long, a double, b double")
    got = {r.ring: r for r in resolution.ring_sums(rows.where("iy <> 3 or ix <> 5"), n).collect()}
    a[3, 5] = b[3, 5] = 0
    fa, fb = (np.fft.fftshift(np.fft.fft2(v)) for v in (a, b))
    y, x = np.mgrid[:n, :n] - n // 2
    for ring in range(n // 2 + 1):
        on = np.floor(np.sqrt(x * x + y * y)) == ring
        assert got[ring].cross == pytest.approx((fa * fb.conj()).real[on].sum())
        assert got[ring].power_a == pytest.approx((np.abs(fa) ** 2)[on].sum())
    assert len(got) == n // 2 + 1
    line = np.arange(30.0) * 2 + 1
    assert resolution.loess(line, 5) == pytest.approx(line)

    spots = rng.uniform(0, 20, (300, 2))
    made = lambda s: spark.createDataFrame([(i, *map(float, spots[i % 300] + rng.normal(0, s, 2))) for i in range(9000)], "loc_id long, x double, y double")
    fine, coarse = (resolution.ring_correlation(made(s), (0, 0, 20, 20), 0.2, 100.0)[1] for s in (0.1, 0.3))
    assert 10 < fine < coarse < 200
    curve, none = resolution.ring_correlation(made(0.1).where("false"), (0, 0, 4, 4), 0.5, 100.0)
    assert none is None and curve.agg(F.max("frc")).first()[0] == 0


def test_permutations(spark):
    rng = np.random.default_rng(5)
    values = [("a", float(v)) for v in rng.normal(0, 1, 60).round(1)] + [("b", float(v)) for v in rng.normal(0.3, 1, 80).round(1)]
    rows = spark.createDataFrame(values, "kind string, v double")
    got = resolution.permutation_test(rows, "kind", "v", "a", "b", 2000).first()
    assert got.ks == pytest.approx(tables.ks_statistic(rows, "kind", "v", "a", "b").first()[0])
    every = np.array([v for _, v in values])
    grid = np.unique(every)
    far = lambda s: np.abs((s[:60, None] <= grid).mean(0) - (s[60:, None] <= grid).mean(0)).max()
    want = np.mean([far(rng.permutation(every)) >= got.ks - 1e-12 for _ in range(2000)])
    assert got.p_permutation == pytest.approx(want, abs=0.05) and 0 < got.p_asymptotic <= 1
    assert resolution.permutation_test(rows.where("kind = 'a'"), "kind", "v", "a", "b", 10).first().ks is None


def test_rotation_is_that_of_the_matrix(spark):
    angles = (0.3, -0.7, 1.1)
    got = spark.range(1).select(*X.rotate(F.lit(1.0), F.lit(2.0), F.lit(3.0), *angles)).first()
    assert list(got) == pytest.approx((rendering._matrix(angles) @ [1.0, 2.0, 3.0]).tolist())
    with pytest.raises(ValueError):
        rendering.render(spark.range(1), (0, 0, 1, 1), method="other")


def test_fiducials_are_found(spark):
    rng = np.random.default_rng(6)
    rows = [(f, x + float(rng.normal(0, 0.1)), y + float(rng.normal(0, 0.1))) for f in range(100) for x, y in ((20.5, 30.5), (50.5, 12.5))]
    rows += [(f, float(rng.uniform(0, 64)), float(rng.uniform(0, 48))) for f in range(100) for _ in range(20)]
    locs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "loc_id long, frame long, x double, y double")
    found, box = picks.find_fiducials(locs, 64, 48, 100)
    assert box == 7 and sorted((r.x, r.y) for r in found.collect()) == [(20.0, 30.0), (50.0, 12.0)]
    assert picks.find_fiducials(locs.where("false"), 64, 48, 100)[0].count() == 0


def test_raw_movies_round_trip(spark, tmp_path):
    frames = np.random.default_rng(7).integers(0, 60000, (11, 6, 5)).astype(">u2")
    (tmp_path / "m.raw").write_bytes(frames.tobytes())
    info = {"Frames": 11, "Height": 6, "Width": 5, "Data Type": "uint16", "Byte Order": ">"}
    movie = movies.read_raw(spark, str(tmp_path / "m.raw"), info, 4)
    got = {r.frame: np.frombuffer(r.pixels, "<u2").reshape(6, 5) for r in movie.collect()}
    assert sorted(got) == list(range(11)) and all((got[f] == frames[f]).all() for f in got)
    parts = movies.write_raw(movie, str(tmp_path / "out"), 4).orderBy("part").collect()
    whole = b"".join(open(p.file, "rb").read() for p in parts)
    assert whole == frames.astype("<u2").tobytes() and [p.frames for p in parts] == [4, 4, 3]
    with pytest.raises(Exception, match="ends before"):
        movies.read_raw(spark, str(tmp_path / "m.raw"), info | {"Frames": 12}).count()
