"""k-means in picks against a plain Lloyd, and typed steps."""

import math
import random

import pytest
from pyspark.sql import functions as F

from spotlake.functions.steps import apply_step
from spotlake.operators import kmeans


def lloyd(points, centers):
    while True:
        near = {i: min(range(len(centers)), key=lambda c: (sum((a - b) ** 2 for a, b in zip(p, centers[c])), c)) for i, p in points.items()}
        new = []
        for c, old in enumerate(centers):
            own = [points[i] for i in points if near[i] == c]
            new.append([sum(v) / len(own) for v in zip(*own)] if own else old)
        if max(math.dist(a, b) for a, b in zip(new, centers)) <= kmeans.STILL:
            return near, new
        centers = new


@pytest.mark.parametrize(("space", "limit"), [(("x", "y"), 10_000), (("x", "y", "z"), 10)])
def test_kmeans_equals_plain_lloyd(spark, space, limit):
    rng = random.Random(6)
    rows = [(k, k % 2, *(rng.gauss(5 * (k % 3), 1.0 + k % 2) for _ in range(3)), 7) for k in range(120)]
    rows += [(500, 4, 1.0, 1.0, 1.0, 7), (501, 4, 1.0, 1.0, 1.0, 7), (502, 4, 2.0, 1.0, 1.0, 7), (503, None, 1.0, 1.0, 1.0, 7), (504, 0, None, 1.0, 1.0, 7), (505, 6, 3.0, 3.0, 3.0, 7)]
    table = spark.createDataFrame(rows, "loc_id long, pick_id long, x double, y double, z double, centers int").drop("centers")
    clean = table.dropna(subset=["pick_id", "x"])
    start = {r.pick_id: [list(c) for c in r.centers] for r in kmeans.far_seeds(clean, 3, list(space)).collect()}
    assert {p: len(c) for p, c in start.items()} == {0: 3, 1: 3, 4: 2, 6: 1}
    found, places = kmeans.kmeans_in_picks(table, 3, space, limit=limit)
    got = {r.loc_id: r.cluster for r in found.collect()}
    for pick, centers in start.items():
        points = {r[0]: r[2 : 2 + len(space)] for r in rows if r[1] == pick and r[2] is not None}
        near, final = lloyd(points, centers)
        assert {i: got[i] for i in points} == near
        for r in places.where(F.col("pick_id") == pick).collect():
            assert math.dist(list(r.place), final[r.cluster]) < 1e-9 and r.n == sum(c == r.cluster for c in near.values())
    assert len(got) == 124 and kmeans.kmeans_in_picks(table.where("false"), 3)[0].count() == 0


@pytest.fixture(scope="module")
def locs(spark):
    return spark.createDataFrame([(0, 2, 1.0, 5.0, 130.0), (1, 10, 4.0, None, 0.0)], "loc_id long, frame long, x double, y double, z double")


def values(df, *names):
    return [tuple(r) for r in df.orderBy("loc_id").select(*names).collect()]


def test_assignments(locs):
    assert values(apply_step(locs, "x += 10"), "x") == [(11.0,), (14.0,)]
    assert values(apply_step(locs, "y -= 3"), "y") == [(2.0,), (None,)]
    assert values(apply_step(locs, "r = sqrt(x) * 2 - -frame % 4"), "r") == [(4.0,), (6.0,)]
    assert values(apply_step(locs, "x = 2 ** x / (1 + 1)"), "x") == [(1.0,), (8.0,)]
    assert values(apply_step(locs, "x = cos(pi * 0)"), "x") == [(1.0,), (1.0,)]


@pytest.mark.parametrize("text", ["", "x", "x +", "q += 1", "x = q", "x = __import__('os')", "x = open('f')", "x = y.real", "x = [1]", "x = True", "x = 'a'", "flip x q", "spiral 2", "x, y = y, x", "x = 1; y = 2", "import os", "x = sqrt(x, y)"])
def test_other_texts_are_errors(locs, text):
    with pytest.raises(ValueError):
        apply_step(locs, text, frames=10)


def test_flips_and_spirals(locs):
    assert values(apply_step(locs, "flip x y"), "x", "y") == [(5.0, 1.0), (None, 4.0)]
    assert values(apply_step(locs, "flip z x", 130.0, 32.0, 64.0), "x", "z") == [(17.0, 130.0), (16.0, 520.0)]
    with pytest.raises(ValueError):
        apply_step(locs, "flip x z")
    turned = apply_step(locs, "spiral 2 3", frames=10)
    angle = 2 / (10 / (3 * 2 * math.pi))
    assert values(turned, "x")[0][0] == pytest.approx(1 + angle * math.cos(angle) / (6 * math.pi) * 2)
    assert values(turned, "x")[1][0] == pytest.approx(4 + 2 * math.cos(6 * math.pi))
    assert values(apply_step(turned, "uspiral"), *locs.columns) == values(locs, *locs.columns)
    for text in ("uspiral", "spiral 1 1"):
        with pytest.raises(ValueError):
            apply_step(locs, text)
