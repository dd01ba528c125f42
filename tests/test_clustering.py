import math
import random

import numpy as np
import pytest

from spotlake.operators import clustering as C
from spotlake.operators import columns as K
from spotlake.operators import graphs as G


def plain_cluster(rows, r, least):
    near = [[j for j, b in enumerate(rows) if math.dist(a[1:], b[1:]) <= r] for a in rows]
    tops = [i for i, n in enumerate(near) if len(n) > least and len(n) == max(len(near[j]) for j in n)]
    label = {}
    for i in tops:
        opens = i not in label
        own = i if opens else label[i]
        for j in near[i]:
            if opens or j not in label:
                label[j] = own
    sizes = [list(label.values()).count(c) for c in label.values()]
    return {rows[i][0]: rows[c][0] for (i, c), n in zip(label.items(), sizes, strict=True) if n >= least}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clusters_equal_a_scan(spark, seed):
    r = random.Random(seed)
    rows = [(i, float(r.randrange(14)), float(r.randrange(14)), 0.0) for i in range(160)]  # many equal counts
    df = spark.createDataFrame(rows, "loc_id long, x double, y double, z double")
    want = plain_cluster([x[:3] for x in rows], 1.0, 2)
    assert {x.loc_id: x.cluster for x in C.cluster(df, 1.0, 2).collect()} == want and len(set(want.values())) > 5
    deep = [(i, x, y, float(r.randrange(6))) for i, x, y, _ in rows]
    df = spark.createDataFrame(deep, "loc_id long, x double, y double, z double")
    want = plain_cluster([(i, x, y, z / 2) for i, x, y, z in deep], 1.0, 2)
    assert {x.loc_id: x.cluster for x in C.cluster(df, 1.0, 2, r_z=2.0).collect()} == want
    assert C.cluster(df.where("false"), 1.0, 2).count() == 0


def test_links_merge_chains(spark):
    r = random.Random(4)
    rows = [(i, i % 2, r.randrange(30), r.random() * 4, r.random() * 4, 0.1 + r.random(), 0.2, float(r.randrange(100))) for i in range(120)]
    df = spark.createDataFrame(rows, "loc_id long, `group` long, frame long, x double, y double, lpx double, lpy double, photons double")
    chain = {x.loc_id: x.event for x in G.link_near(df, 0.8, 3).collect()}
    got = {(x.group, x.event): x for x in C.link(df, 0.8, 3).collect()}
    assert {e for _, e in got} == set(chain.values())
    for (_, event), x in got.items():
        own = [row for row in rows if chain[row[0]] == event]
        w = [1 / row[5] ** 2 for row in own]
        assert x.n == len(own) and x.photons == pytest.approx(sum(row[7] for row in own)) and x.x == pytest.approx(sum(a * row[3] for a, row in zip(w, own, strict=True)) / sum(w))
    assert C.link(df, 0.8, 3, frames=30).count() < len(got) and C.link(df.where("false"), 0.8, 3).count() == 0


def test_hulls_and_precision(spark):
    rng = np.random.default_rng(2)
    square = [(1, float(x), float(y)) for x, y in rng.uniform(0, 4, (400, 2))] + [(1, 0.0, 0.0), (1, 4.0, 0.0), (1, 0.0, 4.0), (1, 4.0, 4.0)]
    disc = [(2, 3 * math.cos(a), 3 * math.sin(a)) for a in np.linspace(0, 2 * math.pi, 500, endpoint=False)]
    df = spark.createDataFrame([*square, *disc, (3, 1.0, 1.0), (4, 0.0, 0.0), (4, 1.0, 1.0)], "k long, x double, y double")
    got = {x.k: x for x in C.hull_areas(df, "k").collect()}
    assert got[1].area == pytest.approx(16.0) and got[2].area == pytest.approx(250 * 9 * math.sin(2 * math.pi / 500)) and got[3].area == 0 and got[4].area == 0
    rows, s = [], 0.05
    for k in range(150):
        x, y = rng.uniform(0, 60, 2)
        rows += [(0, f, float(x + rng.normal(0, s)), float(y + rng.normal(0, s)), s, s) for f in range(8)]
    locs = spark.createDataFrame(rows, "`group` long, frame long, x double, y double, lpx double, lpy double")
    assert C.nena(locs, 0.005, 1.0)["s"] == pytest.approx(s, rel=0.1)
    assert math.isnan(C.nena(locs.where("false"))["s"])


def test_recorded_filters(spark):
    ranges, dropped, missing = C.filter_steps([{"Generated by": "X Filter", "a": [0, 5], "b": [1, 2]}, {"Generated by": "X Filter", "a": [2, 9], "Removed columns": ["c", "d"]}, {"a": [8, 9]}], ["a", "c"])
    assert ranges == {"a": (2.0, 5.0)} and dropped == ["c"] and missing == ["b", "d"]


@pytest.mark.parametrize("cells, part", [(1 << 22, 500_000), (0, 500_000), (1 << 22, 40)])
def test_neighbours_by_columns_equal_a_scan(spark, cells, part, monkeypatch):
    rng = np.random.default_rng(7)
    xy = np.round(rng.exponential(4.0, (60, 2)), 1) - 3
    rows = [(k, *map(float, xy[k % 60]), float(rng.integers(-9, 9) if k % 10 else rng.normal()), int(rng.integers(1, 5))) for k in range(900)]
    points = spark.createDataFrame(rows, "loc_id long, x double, y double, z double, n long")
    t = np.array(rows)
    near = ((t[:, None, 1] - t[:, 1]) ** 2 + (t[:, None, 2] - t[:, 2]) ** 2 + ((t[:, None, 3] - t[:, 3]) * 0.5) ** 2) <= 4.0
    own = {c: t[:, k].astype(np.int64 if c == "v" else float) for k, c in ((1, "x"), (2, "y"), (3, "z"), (4, "v"))}
    assert (K.around_rows(own, own, 2.0, 0.5, False, cells) == near @ t[:, 4]).all()
    assert (K.around_rows(own, own, 2.0, 0.5, True, cells) == np.where(near, t[:, 4], -1).max(axis=1)).all()
    if cells:
        assert {r.loc_id: r.others for r in K.sums_around(points, 2.0, 0.5, part).collect()} == dict(enumerate((near @ t[:, 4] - 1).tolist()))
        most = np.where(near, t[:, 4], -1).max(axis=1)
        assert {r.loc_id for r in K.surpassed_around(points, "n", 2.0, 0.5, part).collect()} == set(np.flatnonzero(most > t[:, 4]).tolist())


def test_rows_dealt_in_space_grow_with_the_rows(spark, monkeypatch):
    met, deal = [], K._tiles
    monkeypatch.setattr(K, "_tiles", lambda *a: (out := deal(*a), met.append(out.count()))[0])
    rows = [(i, float(i % 7), float(i % 5), float(i)) for i in range(3500)]  # 100 depths a place of the plane
    C.cluster(spark.createDataFrame(rows, "loc_id long, x double, y double, z double"), 3.0, 4, r_z=150.0).count()
    assert met and all(n <= 4 * len(rows) for n in met)


def test_columns_are_dealt_whole(spark, monkeypatch):
    """Every row went to its tiles by itself; rows of one place in the plane go together, in pieces if they are many."""
    rows = [(i, float(i % 7), float(i % 5), float(i), 1) for i in range(3500)]  # 35 columns
    points = spark.createDataFrame(rows, "loc_id long, x double, y double, z double, n long")
    want = {i: sum(1 for j in range(i % 35, 3500, 35) if abs(i - j) <= 100) - 1 for i in range(3500)}
    for column, most in ((K.COLUMN, 4 * 35), (30, 4 * 35 * 4)):
        monkeypatch.setattr(K, "COLUMN", column)
        assert K._tiles(points, 0.5, "n", 10_000).count() <= most
        assert {r.loc_id: r.others for r in K.sums_around(points, 0.5, 0.005).collect()} == want
