import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotlake.operators import graphs, images, picks, registration, spatial


def test_neighbours_are_complete_however_small_the_first_radius(spark):
    r = random.Random(2)
    rows = [(i, r.gauss(0, 1) * (1 if i % 10 else 80), r.gauss(0, 1)) for i in range(120)]
    df = spark.createDataFrame(rows, "loc_id long, x double, y double")
    got = {(x.loc_id, x.rank): x.neighbour for x in spatial.nearest_neighbours(df, df, 4, 0.3, same=True).collect()}
    for i, x, y in rows:
        near = sorted((math.dist((x, y), b[1:]), b[0]) for b in rows if b[0] != i)[:4]
        assert [got[(i, k + 1)] for k in range(4)] == [n for _, n in near]
    few = spatial.nearest_neighbours(df.where("loc_id < 3"), df.where("loc_id < 3"), 9, 0.1, same=True)
    assert few.count() == 6 and spatial.nearest_neighbours(df.where("false"), df, 2, 1.0).count() == 0
    groups = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 90.0, 0.0), (2, 1, 0.0, 0.0)], "`group` long, cluster long, x double, y double")
    assert {(x.group, x.cluster): x.d for x in graphs.min_distance(groups, 1.0).collect()} == {(1, 1): 90.0, (1, 2): 90.0, (2, 1): None}


def brute_image(spark, values):
    rows = [(i, j, float(v)) for (i, j), v in np.ndenumerate(values) if v]
    return spark.createDataFrame(rows, "iy long, ix long, value double")


def test_thresholds_part_two_levels(spark):
    rng = np.random.default_rng(5)
    values = np.where(rng.random((40, 40)) < 0.3, rng.normal(60, 4, (40, 40)), rng.normal(20, 4, (40, 40))).clip(1).round()
    image, n = brute_image(spark, values), values.size
    for found in (images.threshold_isodata(image, n), images.threshold_li(image, n), images.threshold_minimum(image, n), images.threshold_yen(image, n)):
        assert 25 < found < 55
    counts, edges = np.histogram(values, 256)
    found = images.threshold_triangle(image, n)
    peak, used = int(counts.argmax()), np.flatnonzero(counts)
    assert min(used[0], peak) <= np.searchsorted(edges, found) <= used[-1]
    flat = brute_image(spark, np.full((3, 3), 4.0))
    assert images.threshold_li(flat, 9) == 4.0 and images.threshold_minimum(flat, 9) is None

    # Li's rule, step by step
    tolerance, now, after = np.diff(np.unique(values)).min() / 2, -9e9, values.mean()
    while abs(after - now) > tolerance:
        now = after
        back, fore = values[values <= now].mean(), values[values > now].mean()
        after = (back - fore) / (math.log(back) - math.log(fore))
    assert images.threshold_li(image, n) == pytest.approx(after)


def test_drift_and_channels_from_correlations(spark):
    rng = np.random.default_rng(1)
    beads = rng.uniform(10, 90, (60, 2))
    rows = []
    for f in range(400):
        dx, dy = 2.0 * f / 400, -1.5 * f / 400
        for k in rng.permutation(60)[:30]:
            x, y = beads[k] + rng.normal(0, 0.4, 2)
            rows.append((len(rows), f, float(x + dx), float(y + dy), "a" if f % 2 else "b"))
    locs = spark.createDataFrame(rows, "loc_id long, frame long, x double, y double, channel string")
    drift = registration.correlation_drift(locs, 400, 80, reach=6, oversampling=2.0).toPandas()
    middle = drift[(drift["frame"] > 40) & (drift["frame"] < 360)]
    off = middle["dx"] - 2.0 * middle["frame"] / 400
    assert off.max() - off.min() < 0.4 and len(drift) == 400
    moved = locs.withColumn("x", F.when(F.col("channel") == "b", F.col("x") + 1.5).otherwise(F.col("x")))
    found = registration.align_channels(moved, reach=6, oversampling=2.0).groupBy("channel").agg(F.avg("x").alias("x")).collect()
    assert abs(found[0].x - found[1].x) < abs(1.5) / 2
    x = np.arange(6.0)
    assert registration.spline(x, x**3, np.array([0.5, 2.2, 4.9])) == pytest.approx(np.array([0.5, 2.2, 4.9]) ** 3)
    place = registration.minimize_shifts({(0, 1): (1.0, 2.0), (1, 2): (1.0, -1.0), (0, 2): (2.0, 1.0)}, [0, 1, 2])
    assert place[2] == pytest.approx((2.0, 1.0))


def test_properties_of_a_pick(spark):
    frames = [0, 1, 2, 10, 11, 30, 31, 32, 33, 50]
    rows = [(i, f, 5.0, 5.0, 0.1, 0.1, 100.0, 7) for i, f in enumerate(frames)]
    picked = spark.createDataFrame(rows, "loc_id long, frame long, x double, y double, lpx double, lpy double, photons double, pick_id long")
    got = picks.pick_properties(picked, max_dark_time=1, influx_rate=0.1).first()
    assert got.pick_id == 7 and got.locs == 3 and got.n_units == pytest.approx(10 / got.dark_cdf) and got.qpaint_idx_cdf == pytest.approx(1 / got.dark_cdf)
    assert picks.pick_properties(picked.where("false")).count() == 0
    assert picks.combine_in_picks(picked).first().n == 10
