import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotlake.operators import graphs, images, spatial, statistics
from spotlake.plans import catalogue
from spotlake.sources import exports

SHAPE = "loc_id long, `group` long, frame long, x double, y double"


def points(n, seed, size=10.0):
    r = random.Random(seed)
    return [(i, r.randrange(2), r.randrange(40), r.random() * size, r.random() * size) for i in range(n)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 101 + i) for i in range(5)] + [(7, 7)]
    found = dict(graphs.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert found == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 106)}}
    assert graphs.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("least", [0, 6])
def test_dbscan_equals_brute_force(spark, least):
    rows, r, m = points(150, 5), 0.9, 4
    near = {a[0]: [b[0] for b in rows if math.dist(a[3:], b[3:]) <= r] for a in rows}
    core, label = {i for i in near if len(near[i]) >= m}, {}
    for i in sorted(core):
        if i not in label:
            stack = [i]
            while stack:
                j = stack.pop()
                if j in core and j not in label:
                    label[j] = i
                    stack += near[j]
    border = {i: min(label[j] for j in near[i] if j in core) for i in near if i not in core and set(near[i]) & core}
    want = label | border
    want = {i: c for i, c in want.items() if list(want.values()).count(c) >= least}
    assert 0 < len(want) < 150 and border
    df = spark.createDataFrame(rows, SHAPE)
    assert {x.loc_id: x.cluster for x in graphs.dbscan(df, r, m, least).collect()} == want
    assert graphs.dbscan(df.where("false"), r, m).count() == 0


def test_greedy_links_equal_a_scan_of_whole_groups(spark):
    rows, r, span = points(200, 8, 6.0), 0.8, 4
    want = {}
    order = sorted(rows, key=lambda x: (x[2], x[0]))
    for first in order:
        if first[0] in want:
            continue
        chain, tail = [first], first
        want[first[0]] = None
        for b in order:
            if b[0] not in want and b[1] == tail[1] and 0 < b[2] - tail[2] <= span and math.dist(b[3:], tail[3:]) <= r:
                chain.append(b)
                want[b[0]], tail = None, b
        for c in chain:
            want[c[0]] = min(x[0] for x in chain)
    assert len(set(want.values())) < 150
    got = graphs.link_near(spark.createDataFrame(rows, SHAPE), r, span - 1)
    assert {x.loc_id: x.event for x in got.collect()} == want


def test_space_has_its_own_radius(spark):
    r = random.Random(5)
    rows = [(i, r.randrange(20) / 2, r.randrange(20) / 2, float(r.randrange(12) * 50)) for i in range(220)] + [(300 + i, 1.0, 1.0, 100.0) for i in range(3)]
    df = spark.createDataFrame([*rows, (400, 1.0, 1.0, None), (401, None, 1.0, 5.0)], "loc_id long, x double, y double, z double")
    space = lambda a, b: (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 + ((a[3] - b[3]) / 100) ** 2
    near = {a[0]: [b[0] for b in rows if space(a, b) <= 1.0] for a in rows}
    cores = {i for i, n in near.items() if len(n) >= 4}
    label = {i: i for i in cores}
    for _ in range(len(cores)):
        label = {i: min(label[j] for j in near[i] if j in cores) for i in cores}
    want = label | {i: min(label[j] for j in near[i] if j in cores) for i in near if i not in cores and cores & set(near[i])}
    assert {x.loc_id: x.cluster for x in graphs.dbscan(df, 1.0, 4, r_z=100.0).collect()} == want and len(set(want.values())) > 3
    got = {}
    for x in spatial.nearest_neighbours(df, df, 3, 0.4, same=True, stretch=0.01).orderBy("rank").collect():
        got.setdefault(x.loc_id, []).append((x.neighbour, round(x.d, 9)))
    assert got == {a[0]: [(i, round(d**0.5, 9)) for d, i in sorted((round(space(a, b), 9), b[0]) for b in rows if b[0] != a[0])[:3]] for a in rows}


@pytest.mark.parametrize("task_rows, round_rows", [(200_000, 5_000_000), (40, 100), (1, 120)])
def test_links_by_ranges_of_frames(spark, task_rows, round_rows):
    """A group with a third of all rows and ties in place and time, whole, in ranges and frame span by frame span."""
    r = random.Random(8)
    rows = [(1000 - i, r.randrange(2, 6) if i % 3 else 1, r.randrange(60), r.randrange(24) / 4, r.randrange(24) / 4) for i in range(600)]
    rows += [(i, 1, 7 + i % 3, 2.0, 2.0) for i in range(2000, 2030)]
    want = {}
    order = sorted(rows, key=lambda x: (x[2], x[0]))
    for first in order:
        if first[0] in want:
            continue
        chain, tail = [first], first
        want[first[0]] = None
        for b in order:
            if b[0] not in want and b[1] == tail[1] and 0 < b[2] - tail[2] <= 3 and math.dist(b[3:], tail[3:]) <= 0.75:
                chain.append(b)
                want[b[0]], tail = None, b
        for c in chain:
            want[c[0]] = min(x[0] for x in chain)
    odd = [(5000, None, 3, 1.0, 1.0), (5001, 1, None, 1.0, 1.0), (5002, 1, 3, None, 1.0), (5003, 1, 3, float("nan"), 1.0), (5004, 1, 3, 1.0, float("inf"))]
    want |= {x[0]: x[0] for x in odd}
    got = graphs.link_near(spark.createDataFrame(rows + odd, SHAPE), 0.75, 2, task_rows, round_rows)
    assert {x.loc_id: x.event for x in got.collect()} == want and max(list(want.values()).count(e) for e in set(want.values())) >= 5
    assert graphs.frame_ranges([(0, 5), (1, 5), (4, 9), (5, 1), (6, 30)], 10) == [(0, 1), (4, 5), (6, 6)]


def test_fit_recovers_time_constant(spark):
    n, t = 400, 25.0
    values = [-t * math.log(1 - (i + 0.5) / n) for i in range(n)]
    df = spark.createDataFrame([(1, v) for v in values] + [(2, 3.0)] * 9 + [(3, 2.0), (3, 6.0)] + [(4, None)], "`group` long, v double")
    got = {x.group: x.rate for x in statistics.kinetic_rates(df, "group", "v").collect()}
    assert got[1] == pytest.approx(t, rel=0.03) and got[2] == 3.0 and got[3] == 4.0 and 4 not in got
    thin = statistics.kinetic_rates(df, "group", "v", folds=100).where("`group` = 1").first().rate
    assert thin == pytest.approx(t, rel=0.05)


def plain_fit(values):
    """The same least squares from every rank, by numpy."""
    x = np.sort(np.array(values, float))
    y = np.arange(1, len(x) + 1, dtype=float)
    if len(x) <= 2 or x[0] == x[-1]:
        return float(x.mean())

    def loss(t):
        g = 1 - np.exp(-x / t)
        centred = g - g.mean()
        a = max(0.0, centred @ y / max(centred @ centred, 1e-300))
        c = y.mean() - a * g.mean()
        if c < 0:
            a, c = max(0.0, g @ y / max(g @ g, 1e-300)), 0.0
        return float(((y - a * g - c) ** 2).sum())

    low, high = max(x[0], 1e-9), x[-1]
    for _ in range(8):
        grid = np.geomspace(low, high, 33)
        best = int(np.argmin([loss(t) for t in grid]))
        low, high = grid[max(0, best - 1)], grid[min(32, best + 1)]
    return (low + high) / 2


def test_fit_takes_every_rank_of_large_keys(spark):
    rng = random.Random(4)
    large = [rng.expovariate(1 / 20) if i % 9 else rng.uniform(0, 300) for i in range(20_000)]
    sets = {1: large, 2: [float(rng.randint(1, 60)) for _ in range(9000)], 3: [1.0, 1.0, 4.0], None: [2.0, 3.0, 7.0, 7.5], 5: [0.0, 1.0, 1.5, 9.0]}
    df = spark.createDataFrame([(k, v) for k, values in sets.items() for v in values] + [(1, None), (3, math.nan)], "`group` long, v double")
    got = {x.group: x.rate for x in statistics.kinetic_rates(df, "group", "v").collect()}
    # many t fit the two values of key 3 alike; their mean is taken
    assert got == {k: pytest.approx(2.0 if k == 3 else plain_fit(v), rel=1e-5) for k, v in sets.items()}
    few = {x.group: x.rate for x in statistics.kinetic_rates(df, "group", "v", folds=2).collect()}
    assert few == {k: pytest.approx(v, rel=1e-5) for k, v in got.items()}


def test_kinetic_query_fits_bright_and_dark_times(spark):
    d = "/root/testdata/sf0.001"
    events = catalogue.QUERIES["dark_times"](spark, d).toPandas()
    got = {x.group: x for x in catalogue.QUERIES["kinetic_rates"](spark, d).collect()}
    assert set(got) == set(events["group"])
    for key, own in events.groupby("group"):
        for name in ("len", "dark"):
            if own[name].nunique() != 2:
                assert got[key][f"{name}_cdf"] == pytest.approx(plain_fit(own[name]), rel=1e-4)


def test_blur_keeps_mass_and_otsu_parts_two_levels(spark):
    one = spark.createDataFrame([(16, 16, 8.0)], "iy long, ix long, value double")
    got = images.blur(one, 1.0, 33, 33).collect()
    assert sum(x.value for x in got) == pytest.approx(8.0) and max(got, key=lambda x: x.value)[:2] == (16, 16)
    two = spark.createDataFrame([(i, j, 2.0 if i < 5 else 20.0) for i in range(10) for j in range(10)], "iy long, ix long, value double")
    level = images.threshold_otsu(two, 100)
    assert images.mask_above(two, level).count() == 50


def test_halves_repeat_and_tables_round_trip(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("loc_id"), images.hash_half(F.col("id")).alias("h"))
    assert abs(np.mean([x.h for x in df.collect()]) - 0.5) < 0.1
    exports.save_locs(df, str(tmp_path / "t"), [{"Width": 8, "Pixelsize": 0}, {"Pixelsize": 130}, {"Pixelsize": 0}])
    back, info = exports.load_locs(spark, str(tmp_path / "t"))
    assert back.count() == 1000 and exports.described(info, "Pixelsize") == 130 and exports.described(info, "Frames", 5) == 5
