import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotlake.operators import detection as D


def planted(n, seed, box=7):
    rng = np.random.default_rng(seed)
    truth = np.column_stack([rng.uniform(-0.5, 0.5, (n, 2)), rng.uniform(5000, 12000, n), rng.uniform(5, 20, n), rng.uniform(0.9, 1.4, (n, 2))])
    grid = np.arange(box) - box // 2
    return rng, truth, grid


def test_least_squares_recovers_noiseless_spots():
    _, truth, grid = planted(64, 42)
    g = lambda c, s: np.exp(-0.5 * ((grid - c[:, None]) / s[:, None]) ** 2) / (math.sqrt(2 * math.pi) * s[:, None])
    spots = truth[:, 2, None, None] * g(truth[:, 1], truth[:, 5])[:, :, None] * g(truth[:, 0], truth[:, 4])[:, None, :] + truth[:, 3, None, None]
    assert D.fit_least_squares(spots) == pytest.approx(truth, rel=1e-3, abs=1e-3)
    assert np.isfinite(D.fit_least_squares(np.full((2, 7, 7), 3.0))).all()


@pytest.mark.parametrize("round_spot", [False, True])
def test_likelihood_is_near_its_bound(round_spot):
    rng, truth, grid = planted(300, 7)
    truth[:, 2] /= 4
    if round_spot:
        truth[:, 5] = truth[:, 4]
    share = lambda c, s: D._pixel_shares(c, s, grid)[0]
    mean = truth[:, 2, None, None] * share(truth[:, 1], truth[:, 5])[:, :, None] * share(truth[:, 0], truth[:, 4])[:, None, :] + truth[:, 3, None, None]
    theta, bounds, likelihood, took = D.fit_likelihood(rng.poisson(mean).astype(float), round_spot)
    z = (theta - truth) / np.sqrt(bounds)
    assert (np.abs(z.mean(axis=0)) < 0.3).all() and (z.std(axis=0) > 0.7).all() and (z.std(axis=0) < 1.3).all()
    assert (likelihood < 0).all() and took.max() <= 100


def brute_identify(image, minimum, box):
    half, out = box // 2, []
    for i in range(half, image.shape[0] - half - 1):
        for j in range(half, image.shape[1] - half - 1):
            if image[i - half : i + half + 1, j - half : j + half + 1].argmax() == half * box + half:
                total = 0.0
                for k in range(i - half, i + half + 1):
                    for m in range(j - half, j + half + 1):
                        if (k, m) != (i, j):
                            n = math.hypot(k - i, m - j)
                            total += ((image[k + 1, m] - image[k - 1, m]) * (i - k) + (image[k, m + 1] - image[k, m - 1]) * (j - m)) / n
                if total > minimum:
                    out.append((j, i, round(total, 6)))
    return sorted(out)


def test_identify_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    images = rng.integers(0, 9, (4, 24, 30)) + 40 * (rng.random((4, 24, 30)) < 0.03)
    rows = [(f, y, x, int(v)) for f, image in enumerate(images) for (y, x), v in np.ndenumerate(image)]
    movie = D.movie_of(spark.createDataFrame(rows, "frame long, iy long, ix long, value long"), 24, 30)
    for box in (5, 7):
        got = D.identify(movie, 30.0, box).collect()
        want = [(f, *spot) for f, image in enumerate(images) for spot in brute_identify(image.astype(float), 30.0, box)]
        assert sorted((r.frame, r.x, r.y, round(r.net_gradient, 6)) for r in got) == sorted(want) and want
    part = D.identify(movie, 30.0, 5, roi=((4, 6), (20, 28)), frame_bounds=(1, 2)).collect()
    want = [(f, x + 6, y + 4) for f in (1, 2) for x, y, _ in brute_identify(images[f][4:20, 6:28].astype(float), 30.0, 5)]
    assert sorted((r.frame, r.x, r.y) for r in part) == sorted(want)
    ids = D.identify(movie, 30.0, 5)
    for r in D.get_spots(movie, ids, 5, baseline=1.0, sensitivity=2.0, gain=4.0).collect():
        assert r.spot == pytest.approx(((images[r.frame, r.y - 2 : r.y + 3, r.x - 2 : r.x + 3] - 1.0) / 2).ravel())
    assert D.localize(movie.where("frame < 0"), 30.0, 5).count() == 0


def test_localize_is_one_pass_and_equals_its_steps(spark):
    rng = np.random.default_rng(11)
    images = rng.integers(0, 9, (6, 32, 40)) + 60 * (rng.random((6, 32, 40)) < 0.02)
    images[4] = 0  # a frame without spots
    rows = [(f, y, x, int(v)) for f, image in enumerate(images) for (y, x), v in np.ndenumerate(image)]
    movie = D.movie_of(spark.createDataFrame(rows, "frame long, iy long, ix long, value long"), 32, 40)
    stored = spark.createDataFrame(movie.toPandas(), D.MOVIE).withColumn("net_gradient", F.lit("another column"))
    for method in ("lq", "mle", "mle_round", "average"):
        camera = {"baseline": 1.0, "sensitivity": 2.0, "gain": 4.0}
        got = D.localize(stored, 30.0, 5, method, frame_bounds=(1, None), **camera)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        ids = D.identify(stored, 30.0, 5, frame_bounds=(1, None))
        want = D.fit_spots(D.get_spots(stored, ids, 5, **camera), method)
        assert got.columns == want.columns
        a, b = ([str([round(v, 6) for v in r]) for r in df.orderBy("frame", "x", "y").collect()] for df in (got, want))
        assert a == b and len(a) > 20 and not {r.frame for r in got.select("frame").collect()} & {0, 4}


def test_erf_table():
    x = np.concatenate([np.linspace(-7, 7, 30_011), [0.0, -0.0, 6.0, -6.0, 1e9, -1e9, np.inf, 1e-300]])
    assert np.abs(D._erf(x) - np.array([math.erf(v) for v in x])).max() < 1e-12


def test_calibration_and_z(spark):
    cx, cy = [0, 0, 0, 0, 3e-6, 1e-3, 1.05], [0, 0, 0, 0, 3e-6, -1e-3, 1.05]
    z = 500 - 10 * np.arange(101)
    rows = [(int(f), float(np.polyval(cx, z[f]) + e), float(np.polyval(cy, z[f]) + e)) for f in range(101) if f != 40 for e in (-0.01, -0.001, 0.0, 0.001, 0.01)]
    found = D.calibrate_z(spark.createDataFrame(rows, "frame long, sx double, sy double"), 101, 10.0)
    grid = np.linspace(-450, 450, 50)
    assert np.polyval(found["cx"], grid) == pytest.approx(np.polyval(cx, grid), abs=2e-3)
    assert np.polyval(found["cy"], grid) == pytest.approx(np.polyval(cy, grid), abs=2e-3)
    spots = spark.createDataFrame([(float(v), float(np.polyval(cx, v)), float(np.polyval(cy, v))) for v in grid], "at double, sx double, sy double")
    for r in D.fit_z(spots, cx, cy, 0.5).collect():
        assert r.z == pytest.approx(r["at"] * 0.5, abs=0.1) and r.d_zcalib < 1e-3
