"""Bounded mixtures: planted molecules, the fit by sums over Spark, and odd clusters."""

import math

import numpy as np
import pytest

from spotlake.operators import mixtures as M

SCHEMA = "loc_id long, group long, frame long, x double, y double, z double, lpx double, lpy double, lpz double"


def planted(space=2, n=60, clusters=3, seed=1):
    """Two or three molecules a cluster, 12 precisions apart; frames in bursts."""
    rng, rows, truth = np.random.default_rng(seed), [], []
    for g in range(clusters):
        for m in range(2 + g % 2):
            place = np.array([5.0 * g + 0.6 * m, 3.0 + 0.1 * m, 200.0 * m])
            truth.append((g, place[:space]))
            for k in range(n):
                rows.append((len(rows), g, (k // 5) * 40 + k % 5 + 1000 * m, *(place + rng.normal(size=3) * [0.05, 0.05, 10.0]).tolist(), 0.05, 0.05, 10.0))
    return rows, truth


@pytest.mark.parametrize("space", [2, 3])
def test_planted_molecules_come_back(spark, space):
    rows, truth = planted(space)
    rules = M.Rules() if space == 2 else M.Rules(pixelsize=130.0, x_poly=(0.0, 1.0), y_poly=(0.0, 1.0))
    extra = [(9_000, 77, 1, 0.0, 0.0, 0.0, 0.1, 0.1, 1.0), (9_001, None, 1, 0.0, 0.0, 0.0, 0.1, 0.1, 1.0), (9_002, 0, 1, None, 0.0, 0.0, 0.1, 0.1, 1.0)]
    got = M.molecules(spark.createDataFrame(rows + extra, SCHEMA), rules).collect()
    assert len(got) == len(truth)
    for g, place in truth:
        near = min((r for r in got if r.group_input == g), key=lambda r: math.dist((r.x, r.y), place[:2]))
        assert math.dist((near.x, near.y), place[:2]) < 0.03 and near.n_locs == 60 and near.n_events == 12
        assert 0 <= near.p_val <= 1 and 0.8 <= near.rel_sigma_x <= 1.5 and near.lpx == pytest.approx(near.sigma_x / math.sqrt(60), rel=1e-3)
        if space == 3:
            assert abs(near.z - place[2]) < 6 and near.lpz > 0
    assert all((r.z is None) == (space == 2) for r in got)


@pytest.mark.parametrize("space", [2, 3])
def test_large_clusters_are_fitted_by_sums_over_all_rows(spark, space):
    rows, truth = planted(space, n=150, clusters=2)
    rules = M.Rules(pixelsize=None if space == 2 else 130.0)
    table = spark.createDataFrame(rows, SCHEMA)
    whole, parted = (sorted(M.molecules(table, rules, limit).collect(), key=lambda r: (r.group_input, r.x)) for limit in (10_000, 100))
    assert len(whole) == len(parted) == len(truth)
    for a, b in zip(whole, parted):
        for name in ("x", "y", "frame", "sigma_x", "p_val", "mol_log_likelihood", "group_log_likelihood", "lpx", "std_frame"):
            assert a[name] == pytest.approx(b[name], rel=2e-2, abs=2e-3), name
        assert (a.n_locs, a.n_events, a.group_input) == (b.n_locs, b.n_events, b.group_input)


def test_sums_equal_plain_expectation():
    rng = np.random.default_rng(0)
    x, lp = rng.normal(size=(50, 2)), rng.uniform(0.1, 0.2, size=(50, 2))
    model = M.Model(np.array([0.3, 0.7]), np.array([[0.0, 0.0], [1.0, 0.5]]), np.array([[0.5, 0.5], [0.2, 0.2]]))
    s = M.sums(x, lp, model)
    log = 0.0
    share = np.zeros((50, 2))
    for i in range(50):
        each = [w * math.exp(-((x[i] - m) ** 2 / v / 2).sum()) / (2 * math.pi * math.sqrt(v[0] * v[1])) for w, m, v in zip(*model)]
        share[i], log = np.array(each) / sum(each), log + math.log(sum(each))
    assert s.log == pytest.approx(log) and np.allclose(s.share, share.sum(axis=0)) and np.allclose(s.x, share.T @ x)
    new = M.updated(s, M.Rules(low=0.0, high=1e9))
    spread = [(share[:, c, None] * (x - new.mean[c]) ** 2).sum() / share[:, c].sum() / 2 for c in range(2)]
    assert np.allclose(new.variance[:, 0], np.array(spread) + M.FLOOR)
    bounded = M.updated(s, M.Rules(low=0.8, high=1.5))
    assert np.all(np.sqrt(bounded.variance) <= 1.5 * 0.2 + 1e-9)


def test_components_that_are_not_apart_are_one():
    model = lambda gap: M.Model(np.array([0.5, 0.5]), np.array([[0.0, 0.0], [gap, 0.0]]), np.full((2, 2), 1.0))
    assert not M.well_apart(model(1.9)) and M.well_apart(model(2.5))


def test_bootstrap_and_absolute_bounds(spark):
    rows, truth = planted(2, clusters=1)
    table = spark.createDataFrame(rows, SCHEMA)
    got = M.molecules(table, M.Rules(local=False, low=0.03, high=0.08, bootstraps=20)).collect()
    assert len(got) == len(truth) and all(0.3 < r.lpx / (r.sigma_x / math.sqrt(60)) < 3 for r in got)
    mixed = M.sum_mixtures(M.molecules(table)).collect()
    assert sum(r.weight for r in mixed) == pytest.approx(1.0)
    assert M.molecules(table.where("false")).count() == 0
    same = spark.createDataFrame([(k, 1, k, 2.0, 2.0, 0.0, 0.1, 0.1, 1.0) for k in range(30)], SCHEMA)
    assert [(r.n_locs, round(r.x, 9)) for r in M.molecules(same).collect()] == [(30, 2.0)]


def test_no_number_of_components_is_too_large(monkeypatch):
    """A fit that finds every further molecule is asked on until each has but the rows that it needs."""

    def better(total, model, rules):
        return model, float(len(model.weight))

    monkeypatch.setattr(M, "fitted", better)
    monkeypatch.setattr(M, "well_apart", lambda model: True)
    monkeypatch.setattr(M, "seeds", lambda x, k, rng: x[:k])
    x = np.c_[np.arange(260) // 2, np.arange(260) % 2 * 1e-3].astype(float)
    found = M.candidates(x, np.full((260, 2), 0.01), M.Rules(least=2))
    assert len(found[-1][1].weight) == 130 and min(found, key=lambda f: f[0])[0] == found[-1][0]


def test_rare_molecules_of_a_large_cluster_are_found(spark):
    """One row in a hundred is the third molecule's, of which a sample of the cluster would hold hardly any."""
    rng, rows = np.random.default_rng(3), []
    for place, n in (((5.0, 3.0), 600), ((5.6, 3.0), 588), ((5.3, 3.8), 12)):
        rows += [(len(rows) + k, 1, 10 * k, *(place + rng.normal(size=2) * 0.05).tolist(), 0.0, 0.05, 0.05, 10.0) for k in range(n)]
    got = M.molecules(spark.createDataFrame(rows, SCHEMA), limit=100).collect()
    assert sorted(r.n_locs for r in got) == [12, 588, 600]
