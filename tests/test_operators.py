import math

import pytest
from pyspark.sql import functions as F

from spotlake.functions import expressions as X
from spotlake.operators import events, spatial, tables


def test_spatial_join_is_an_equality_join_and_exact(spark):
    pts = [(i, (i * 37 % 101) / 10, (i * 53 % 97) / 10) for i in range(200)]
    df = spark.createDataFrame(pts, "loc_id long, x double, y double")
    joined = spatial.spatial_join(df, df, 1.5)
    got = {(r.l.loc_id, r.r.loc_id) for r in joined.collect()}
    assert got == {(a[0], b[0]) for a in pts for b in pts if math.dist(a[1:], b[1:]) < 1.5}
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_negative_coordinates_and_empty_tables(spark):
    df = spark.createDataFrame([(1, -0.1, -0.1), (2, 0.1, 0.1)], "loc_id long, x double, y double")
    assert {r.density for r in spatial.local_density(df, 1.0).collect()} == {2}
    assert spatial.local_density(df.where("false"), 1.0).count() == 0


def test_linking_bridges_dark_frames_only_up_to_the_limit(spark):
    frames = [(i, 1, f, 1.0, 2.0, 0.1, 0.1, 10.0) for i, f in enumerate([5, 6, 10, 15])]
    locs = spark.createDataFrame(frames, "loc_id long, group long, frame long, x double, y double, lpx double, lpy double, photons double")
    linked = events.link_events(locs, max_dark_time=3).orderBy("frame").collect()
    assert [(r.frame, r.len, r.n) for r in linked] == [(5, 6, 3), (15, 1, 1)]
    assert [r.dark for r in events.dark_times(events.link_events(locs, 3)).collect()] == [5]


def test_sanity_drops_missing_infinite_and_outside(spark):
    locs = spark.createDataFrame([(1.0, 1.0), (float("nan"), 1.0), (None, 1.0), (float("inf"), 1.0), (-1.0, 1.0), (600.0, 1.0)], "x double, y double")
    assert tables.ensure_sanity(locs, 512, 512).count() == 1


def test_polygon_morton_and_rotation(spark):
    one = spark.range(1)
    row = one.select(
        X.polygon_area(F.array(*[F.lit(v) for v in (0.0, 2.0, 2.0, 0.0)]), F.array(*[F.lit(v) for v in (0.0, 0.0, 3.0, 3.0)])).alias("area"),
        X.morton(F.lit(3), F.lit(5)).alias("m"), X.rotate(F.lit(1.0), F.lit(0.0), F.lit(0.0), 0, 0, math.pi / 2)[1].alias("y"),
        X.polynomial([1.0, 2.0, 3.0], F.lit(2.0)).alias("p"), X.derivative([1.0, 2.0, 3.0], F.lit(2.0)).alias("q"),
    ).first()
    assert (row.area, row.m, row.p, row.q) == (6.0, 39, 11.0, 6.0)
    assert row.y == pytest.approx(1.0)


def test_merge_keeps_boundary_frame_overlap(spark):
    t = spark.createDataFrame([(0, 1), (4, 2)], "frame long, group long")
    got = sorted((r.frame, r.group) for r in tables.merge_locs([t, t]).collect())
    assert got == [(0, 1), (4, 2), (4, 3), (8, 4)]


def test_running_sums_by_ranges(spark):
    from spotlake.operators import shared

    values = [(float(v), v % 5, v % 3) for v in range(200)]
    df = spark.createDataFrame(values, "v double, a long, b long").repartition(3)
    got = sorted(map(tuple, shared.running_sums(df, "v", ["a", "b"], 7).select("v", "a", "b", "total_a").collect()))
    assert got == [(v, sum(x[1] for x in values[: i + 1]), sum(x[2] for x in values[: i + 1]), sum(x[1] for x in values)) for i, (v, _, _) in enumerate(values)]
    assert shared.running_sums(df.where("false"), "v", ["a"], 7).count() == 0


def test_frames_without_drift_are_an_error(spark):
    locs = spark.createDataFrame([(1, 0, 1.0, 1.0), (2, 9, 1.0, 1.0)], "loc_id long, frame long, x double, y double")
    drift = spark.createDataFrame([(0, 0.5, 0.25)], "frame long, dx double, dy double")
    first = tables.apply_drift(locs.where("frame = 0"), drift, 10).first()
    assert (first.x, first.y) == (0.5, 0.75)
    with pytest.raises(Exception, match="no drift"):
        tables.apply_drift(locs, drift, 10).collect()


def test_drift_from_picks_fills_gaps_in_three_dimensions(spark):
    import numpy as np

    from spotlake.operators import picks

    rng, frames = np.random.default_rng(8), 60
    true = np.cumsum(rng.normal(0, 0.05, (frames, 3)), axis=0) * [1, 1, 100]
    seen = [f for f in range(frames) if f not in (0, 20, 21, 59)]
    rows, disp = [], np.full((3, 3, frames), np.nan)
    for k, (x, y, z) in enumerate([(10, 10, 0), (30, 20, 50), (20, 40, -80)]):
        at = np.array([(x, y, z) + true[f] + rng.normal(0, 0.01 * (k + 1), 3) * [1, 1, 100] for f in seen])
        rows += [(1000 * k + f, f, *map(float, p)) for f, p in zip(seen, at, strict=True)]
        disp[k][:, seen] = (at - at.mean(axis=0)).T
    locs = spark.createDataFrame(rows, "loc_id long, frame long, x double, y double, z double")
    at = spark.createDataFrame([(0, 10.0, 10.0), (1, 30.0, 20.0), (2, 20.0, 40.0)], "pick_id long, x double, y double")
    moved, drift = picks.undrift_from_fiducials(locs, 64, 64, frames, at=(at, 5.0))
    with np.errstate(all="ignore"):
        inner = disp[:, :, seen]
        weight = 1 / ((inner - inner.mean(axis=0)) ** 2).mean(axis=2)
    mean = (inner * weight[:, :, None]).sum(axis=0) / weight.sum(axis=0)[:, None]
    want = np.array([np.interp(range(frames), seen, m) for m in mean]).T
    assert np.array([r[1:] for r in drift.orderBy("frame").collect()]) == pytest.approx(want, abs=1e-9)
    assert moved.columns == ["frame", "loc_id", "x", "y", "z"]
    after = {r.loc_id: (r.x, r.y, r.z) for r in moved.collect()}
    assert all(after[i] == pytest.approx(tuple(np.array(p) - want[f]), abs=1e-9) for i, f, *p in rows)
    flat, one = picks.undrift_from_fiducials(locs.where("loc_id < 1000"), 64, 64, frames, at=(at, 5.0), z=False)
    assert one.columns == ["frame", "dx", "dy"] and flat.agg({"x": "stddev"}).first()[0] < 1e-9
    with pytest.raises(ValueError, match="no rows"):
        picks.undrift_from_fiducials(locs.where("false"), 64, 64, frames, at=(at, 5.0))


def test_blocks_part_crowded_cells(spark, monkeypatch):
    import numpy as np

    from spotlake.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK", 20)
    monkeypatch.setattr(blocks, "COMBINATIONS", 500)
    at = np.round(np.random.default_rng(5).normal(0, 0.4, (300, 2)), 1)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)] + [(900, None, 1.0)], "loc_id long, x double, y double")
    d2 = ((at[:, None] - at[None]) ** 2).sum(-1)
    got = {r.loc_id: r.density for r in spatial.local_density(df, 0.5).collect()}
    assert blocks.blocks(df, 0.5).where("block > 0").count() > 0
    assert got == {i: int(n) for i, n in enumerate((d2 < 0.25).sum(1))} | {900: 1}
    near = {(r.loc_id, r.rank): (r.neighbour, r.d) for r in spatial.nearest_neighbours(df.where("x is not null"), df.where("x is not null"), 3, 0.05, same=True).collect()}
    for i in range(300):
        order = sorted((math.sqrt(d2[i, j]), j) for j in range(300) if j != i)[:3]
        assert [near[i, k + 1] for k in range(3)] == [(j, d) for d, j in order]


def test_copies_in_consecutive_frames_are_met_as_one(spark, monkeypatch):
    rows = [(k, 1, k % 2, float(k % 4), 0.0) for k in range(4000)] + [(4000, None, 0, 0.0, 0.0), (4001, 1, 0, None, 0.0)]
    locs = spark.createDataFrame(rows, "loc_id long, group long, frame long, x double, y double")
    met, join = [], spatial.spatial_join
    monkeypatch.setattr(spatial, "spatial_join", lambda left, right, *a, **b: (met.append(left.count()), join(left, right, *a, **b))[1])
    found = {r.bin: r.n for r in spatial.next_frame_distances(locs, 1.0, 2.0).collect()}
    assert found == {1: 3_000_000} and met[0] <= 6  # x 0, 2 in frame 0 and 1, 3 in frame 1
