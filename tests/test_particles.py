"""Picks like given ones and averaged particles: plain implementations and planted truth."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotlake.operators import averaging, similar


def plain_similar(rows, picks, d, width, height, deviations):
    r = d / 2
    inside = lambda px, py, among: [(x, y) for x, y in among if (x - px) ** 2 + (y - py) ** 2 < r * r]
    mean = lambda v: sum(v) / len(v)
    dev = lambda v: math.sqrt(mean([(x - mean(v)) ** 2 for x in v]))
    spread = lambda ps: math.sqrt(mean([(x - mean([p[0] for p in ps])) ** 2 + (y - mean([p[1] for p in ps])) ** 2 for x, y in ps]))
    own = [inside(x, y, rows) for x, y in picks]
    n, s = [len(o) for o in own], [spread(o) for o in own]
    out = list(picks)
    i, x = 0, d / 2
    while x < width:
        y = d / 2
        while y < height - d / 2:
            sx, sy = x, y + (d / 2 if i % 2 else 0)
            cell = (math.floor(sx / r), math.floor(sy / r))
            near = [p for p in rows if abs(math.floor(p[0] / r) - cell[0]) <= 1 and abs(math.floor(p[1] / r) - cell[1]) <= 1]
            ps = inside(sx, sy, near)
            if len(ps) > 1:
                for _ in range(600):
                    tx, ty = mean([p[0] for p in ps]), mean([p[1] for p in ps])
                    done = abs(tx - sx) <= 1e-3 and abs(ty - sy) <= 1e-3
                    sx, sy = tx, ty
                    if done:
                        break
                    ps = inside(sx, sy, near)
                    if len(ps) < 2:
                        break
                ok = ps and max(2, mean(n) - deviations * dev(n)) <= len(ps) <= mean(n) + deviations * dev(n)
                if ok and mean(s) - deviations * dev(s) <= spread(ps) <= mean(s) + deviations * dev(s) and all((a - sx) ** 2 + (b - sy) ** 2 > d * d for a, b in out):
                    out.append((sx, sy))
            y += d
        i += 1
        x = d / 2 + i * (math.sqrt(3) * d / 2)
    return out


@pytest.mark.parametrize("limit", [10_000, 25])
def test_similar_picks_equal_plain_search(spark, limit):
    rng = random.Random(4)
    centers = [(5.5 + 10 * i, 5.5 + 10 * j) for i in range(3) for j in range(3)]
    rows = [(cx + rng.gauss(0, 0.3), cy + rng.gauss(0, 0.3)) for cx, cy in centers for _ in range(rng.choice([28, 30, 32]))]
    rows += [(rng.uniform(0, 32), rng.uniform(0, 32)) for _ in range(60)] + [(20.5 + rng.gauss(0, 0.05), 10.2) for _ in range(80)]
    picks = [(5.5, 5.5), (5.5, 15.5), (15.5, 5.5)]
    locs = spark.createDataFrame([(k, *p, 0) for k, p in enumerate([*rows, (None, 1.0)])], "loc_id long, x double, y double, seed int")
    given = spark.createDataFrame([(k + 3, *p) for k, p in enumerate(picks)], "pick_id long, x double, y double")
    want = plain_similar(rows, picks, 3.0, 32.0, 32.0, 6.0)
    got = sorted(similar.pick_similar(locs, given, 3.0, 32.0, 32.0, 6.0, limit).collect())
    assert [r.pick_id for r in got] == list(range(3, 3 + len(want)))
    assert [(round(r.x, 6), round(r.y, 6)) for r in got] == [(round(x, 6), round(y, 6)) for x, y in want]
    assert len(want) >= len(centers) - 1


def test_similar_picks_of_odd_tables(spark):
    locs = spark.createDataFrame([(1, 1.0, 1.0)], "loc_id long, x double, y double")
    given = spark.createDataFrame([(1, 20.0, 20.0)], "pick_id long, x double, y double")
    assert similar.pick_similar(locs, given, 3.0, 32.0, 32.0).count() == 1
    assert similar.pick_similar(locs.where("false"), given.where("false"), 3.0, 32.0, 32.0).count() == 0


def particles(seed, groups=12, n=60):
    """Turned and moved copies of a figure without symmetry."""
    rng = np.random.default_rng(seed)
    figure = np.array([(-0.3, -0.2), (0.3, -0.2), (-0.3, 0.3), (0.05, 0.1)])
    rows = []
    for g in range(groups):
        angle, shift = rng.uniform(0, 2 * math.pi), rng.uniform(5, 100, 2)
        turn = np.array([[math.cos(angle), -math.sin(angle)], [math.sin(angle), math.cos(angle)]])
        for k in range(n):
            which = k % 4
            rows.append((len(rows), g, *(turn @ figure[which] + shift + rng.normal(size=2) * 0.01).tolist(), which))
    return rows


@pytest.mark.parametrize("limit", [100_000, 10])
def test_planted_particles_come_back_to_one_figure(spark, limit):
    rows = particles(2)
    locs = spark.createDataFrame(rows, "loc_id long, group long, x double, y double, angle int")
    got = averaging.average_particles(locs, 130.0, 5.0, 4, limit).toPandas()
    assert len(got) == len(rows) and list(got.columns) == locs.columns
    corners = got.groupby(["angle", "group"])[["x", "y"]].mean()
    apart = corners.groupby("angle").std().to_numpy().max()
    before = locs.toPandas()
    before[["x", "y"]] -= before.groupby("group")[["x", "y"]].transform("mean")
    start = before.groupby(["angle", "group"])[["x", "y"]].mean().groupby("angle").std().to_numpy().max()
    assert apart < 0.06 < start
    assert abs(got["x"].mean()) < 1e-9


def test_average_equals_plain_rounds(spark):
    rows = particles(5, groups=4, n=24)
    locs = spark.createDataFrame(rows, "loc_id long, group long, x double, y double, k int")
    points = {r[0]: np.array(r[2:4]) for r in rows}
    groups = {g: [r[0] for r in rows if r[1] == g] for g in range(4)}
    for ids in groups.values():
        middle = np.mean([points[i] for i in ids], axis=0)
        points |= {i: points[i] - middle for i in ids}
    reach, scale = 2 * math.sqrt(np.mean([p @ p for p in points.values()])), 130.0 / 10.0
    side = math.ceil(2 * reach * scale)

    def image(ps):
        out = np.zeros((side, side))
        for x, y in ps:
            if abs(x) < reach and abs(y) < reach:
                out[int(scale * (y + reach)), int(scale * (x + reach))] += 1
        return out

    for _ in range(2):
        whole = np.fft.fft2(image(points.values()))
        new = {}
        for ids in groups.values():
            best = (0.0,)
            for angle in np.arange(0, 2 * math.pi, math.asin(1 / (scale * reach))):
                turn = np.array([[math.cos(angle), -math.sin(angle)], [math.sin(angle), math.cos(angle)]])
                found = np.rint(np.fft.fftshift(np.fft.ifft2(np.fft.fft2(image([turn @ points[i] for i in ids])) * whole.conj()).real))
                if found.max() > best[0]:
                    row, column = np.unravel_index(found.argmax(), found.shape)
                    best = (found.max(), turn, np.array([math.ceil(column - side / 2), math.ceil(row - side / 2)]) / scale)
            new |= {i: best[1] @ points[i] - best[2] for i in ids}
        middle = np.mean(list(new.values()), axis=0)
        points = {i: p - middle for i, p in new.items()}
    for limit in (1000, 5):
        got = {r.loc_id: (r.x, r.y) for r in averaging.average_particles(locs, 130.0, 10.0, 2, limit).collect()}
        assert all(math.dist(got[i], p) < 1e-6 for i, p in points.items())


def test_average_of_odd_tables(spark):
    locs = spark.createDataFrame([(1, 1, 5.0, 5.0), (2, None, 1.0, 1.0), (3, 1, None, 1.0)], "loc_id long, group long, x double, y double")
    assert [(r.loc_id, r.x, r.y) for r in averaging.average_particles(locs, 130.0).collect()] == [(1, 0.0, 0.0)]
    assert averaging.average_particles(locs.where("false"), 130.0).count() == 0


def test_copies_are_averaged_as_one_place(spark, monkeypatch):
    rows = particles(3, groups=4, n=24)
    locs = spark.createDataFrame(rows, "loc_id long, group long, x double, y double, k int")
    copies = locs.crossJoin(spark.range(7)).withColumn("loc_id", locs.loc_id * 7 + F.col("id")).drop("id")
    alone = {r.loc_id: (r.x, r.y) for r in averaging.average_particles(locs, 130.0, 10.0, 2).collect()}
    sizes, kept = [], averaging.checkpointed
    monkeypatch.setattr(averaging, "checkpointed", lambda df: (out := kept(df), sizes.append(out.count()))[0])
    for limit in (1000, 5):
        got = averaging.average_particles(copies, 130.0, 10.0, 2, limit).collect()
        assert len(got) == 7 * len(rows)
        assert all(math.dist((r.x, r.y), alone[r.loc_id // 7]) < 1e-9 for r in got)
    assert sorted(sizes)[-2:] == [7 * len(rows)] * 2 and sorted(sizes)[-3] == len(rows)  # only once are all rows written
