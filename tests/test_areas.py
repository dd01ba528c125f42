import numpy as np
import pytest

from spotlake.operators import areas


def test_areas_of_clusters(spark):
    rng = np.random.default_rng(8)
    rows = [(g, *map(float, rng.normal(5 * g, 0.2 * g, 2)), float(rng.normal(0, 30.0 * g)), 0.1, 0.1) for g in (1, 2) for _ in range(800)]
    rows += [(3, 1.0, 1.0, 0.0, 0.1, 0.1), (None, 2.0, 2.0, 0.0, 0.1, 0.1)]
    locs = spark.createDataFrame(rows, "`group` long, x double, y double, z double, lpx double, lpy double")
    got = {r.group: r.area for r in areas.cluster_areas(locs).collect()}
    for g in (1, 2):
        own = np.array([r[1:3] for r in rows if r[0] == g])
        edges = [np.arange(own[:, i].min(), own[:, i].max() + 0.05, 0.05) for i in (0, 1)]
        image = areas.smooth(np.histogramdd(own, edges)[0])
        assert got[g] == pytest.approx((image >= areas.otsu(image)).sum() / 4, rel=0.03)
    assert 2 < got[2] / got[1] < 8 and got[3] == 0.25 and len(got) == 3
    volumes = {r.group: r.area for r in areas.cluster_areas(locs, 100.0).collect()}
    assert volumes[2] > 3 * volumes[1] and volumes[3] == 0.3125
    assert areas.cluster_areas(locs.where("false")).count() == 0
    flat = areas.smooth(np.full((5, 4), 3.0))
    assert flat == pytest.approx(np.full((5, 4), 3.0)) and areas.otsu(np.array([1.0, 1.0, 9.0, 9.0])) < 9
