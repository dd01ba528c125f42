"""Molecules inside clusters: mixtures of Gaussians whose widths are bounded by the localization precision.

What a step of the fit needs of the rows are sums for each component. A cluster of up to ROWS rows is one task, which sums over its
arrays. Of larger ones, rows to start from are drawn and sums taken over all rows by Spark, for all such clusters and models at once.
The number of components has no bound but that each needs enough rows, and only models and drawn rows reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed

#: Rows of a cluster that one task fits; densities (rows by components) that are held at once.
ROWS, CELLS = 100_000, 1 << 22
#: Added to variances, steps of a fit, the change of the mean log likelihood at which it stands still, frames without a row in an event.
FLOOR, STEPS, STILL, GAP = 1e-6, 100, 1e-3, 3


class Rules(NamedTuple):
    """least: rows of a molecule. low, high: bounds of a width, as multiples of the rows' precision if `local`, else as they are.
    x_poly, y_poly: widths of a spot by z in nm, highest power first, and magnification; only with z. rounds: larger numbers of
    components that are tried without a better model. bootstraps: samples for the errors of positions, 0 for width / sqrt(n)."""

    least: int = 10
    low: float = 0.8
    high: float = 1.5
    local: bool = True
    pixelsize: float | None = None
    x_poly: tuple[float, ...] = ()
    y_poly: tuple[float, ...] = ()
    magnification: float = 0.79
    rounds: int = 3
    bootstraps: int = 0


class Model(NamedTuple):
    weight: np.ndarray  # components
    mean: np.ndarray  # components x axes
    variance: np.ndarray  # components x axes, equal along x and y in two dimensions


class Sums(NamedTuple):
    """Over rows: their number and log likelihood; for each component the sums of its shares r, of r x, r x^2 and r precision."""

    n: float
    log: float
    share: np.ndarray
    x: np.ndarray
    xx: np.ndarray
    precision: np.ndarray


def log_density(x: np.ndarray, model: Model) -> np.ndarray:
    """Log of weight times density, rows x components."""
    far = np.zeros((len(x), len(model.weight)))
    for k in range(x.shape[1]):
        gap = x[:, k, None] - model.mean[:, k]
        gap *= gap
        gap /= model.variance[:, k]
        far += gap
    return np.log(model.weight) - 0.5 * (np.log(2 * math.pi * model.variance).sum(axis=1) + far)


def shares(x: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood of each row, and the components' shares in it."""
    each = log_density(x, model)
    top = each.max(axis=1, keepdims=True)
    whole = top[:, 0] + np.log(np.exp(each - top).sum(axis=1))
    return whole, np.exp(each - whole[:, None])


def _blocks(n: int, components: int) -> Iterator[slice]:
    size = max(1, CELLS // components)
    return (slice(k, k + size) for k in range(0, n, size))


def sums(x: np.ndarray, precision: np.ndarray, model: Model) -> Sums:
    total = None
    for some in _blocks(len(x), len(model.weight)):
        own, (whole, share) = x[some], shares(x[some], model)
        s = Sums(len(own), whole.sum(), share.sum(axis=0), share.T @ own, share.T @ (own * own), share.T @ precision[some])
        total = s if total is None else Sums(*[a + b for a, b in zip(total, s)])
    return total


def updated(s: Sums, rules: Rules) -> Model:
    """The model that the sums lead to, widths within bounds. In space the widths along x and y keep the ratio that the calibration
    gives at the component's height."""
    n = s.share + 10 * np.finfo(float).eps
    mean = s.x / n[:, None]
    variance = np.maximum(s.xx / n[:, None] - mean * mean, 0) + FLOOR
    flat = mean.shape[1] == 2
    if flat:
        variance = np.repeat(variance.mean(axis=1, keepdims=True), 2, axis=1)
    unit = s.precision / n[:, None] if rules.local else np.ones_like(s.precision)
    low, high = np.full(mean.shape[1], rules.low), np.full(mean.shape[1], rules.high)
    if not flat:  # precision along z is high already; without it, z is about twice as wide
        low[2], high[2] = (rules.low, (rules.high - 1) / 2 + 1) if rules.local else (2 * rules.low, 2.5 * rules.high)
    variance = np.clip(variance, (low * unit) ** 2, (high * unit) ** 2)
    if not flat and rules.x_poly:
        height = mean[:, 2] * rules.pixelsize / rules.magnification
        ratio = np.polyval(rules.x_poly, height) / np.polyval(rules.y_poly, height)
        middle = variance[:, :2].mean(axis=1)
        variance[:, 0], variance[:, 1] = middle * ratio, middle / ratio
    return Model(n / n.sum(), mean, variance)


def well_apart(model: Model) -> bool:
    """Whether along the line between any two components the density of both has a dip: then they are two to the eye."""
    t = np.linspace(0, 1, 40)[:, None, None]
    scale = np.log(model.weight) - 0.5 * np.log(2 * math.pi * model.variance).sum(axis=1)
    for i in range(len(model.weight) - 1):
        step = model.mean[i + 1 :] - model.mean[i]
        one = scale[i] - 0.5 * ((t * step) ** 2 / model.variance[i]).sum(axis=2)
        other = scale[i + 1 :] - 0.5 * (((1 - t) * step) ** 2 / model.variance[i + 1 :]).sum(axis=2)
        density = np.exp(one) + np.exp(other)
        if not ((density[1:-1] < density[:-2]) & (density[1:-1] < density[2:])).any(axis=0).all():
            return False
    return len(model.weight) > 0


def valid(model: Model, n: float, rules: Rules) -> np.ndarray:
    """Which components have enough rows."""
    return np.flatnonzero(np.round(model.weight * n) >= rules.least)


def fitted(total: Callable[[Model], Sums], model: Model, rules: Rules) -> tuple[Model, float]:
    """The model after steps until the mean log likelihood stands still, and the sum of that."""
    last = -math.inf
    for _ in range(STEPS):
        s = total(model)
        model = updated(s, rules)
        if abs(s.log / s.n - last) < STILL:
            break
        last = s.log / s.n
    return model, s.log / s.n


def seeds(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows far from each other: each is drawn in proportion to the squared distance from those before, the best of some draws."""
    chosen = [int(rng.integers(len(x)))]
    near = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        total = near.sum()
        drawn = rng.choice(len(x), 2 + int(math.log(k)), p=near / total if total > 0 else None)
        gaps = [np.minimum(near, ((x - x[i]) ** 2).sum(axis=1)) for i in drawn]
        best = int(np.argmin([g.sum() for g in gaps]))
        chosen.append(int(drawn[best]))
        near = gaps[best]
    return x[chosen]


def criterion(log: float, n: float, model: Model) -> float:
    """Bayesian information criterion; a component has a weight, a place and a width (in space, one in the plane and one along z)."""
    k, d = model.mean.shape
    return -2 * log + (k * (d + d - 1) + k - 1) * math.log(n)


def best_start(tries: list[tuple[Model, float]], n: int, rules: Rules) -> tuple[float, Model] | None:
    """Of models from several starts, with their mean log likelihoods, the likeliest whose components are apart, and its criterion."""
    for model, log in sorted(tries, key=lambda t: -t[1]):
        if well_apart(Model(*[a[valid(model, n, rules)] for a in model])):
            return criterion(log * n, n, model), model
    return None


def candidates(x: np.ndarray, precision: np.ndarray, rules: Rules) -> list[tuple[float, Model]]:
    """Models of 1, 2, ... components with their criteria, as long as these fall; those whose components lie too close are left out."""
    found, best, idle, k = [], math.inf, 0, 1
    total = lambda model: sums(x, precision, model)
    while k <= len(x) // rules.least and idle < rules.rounds:
        tries = []
        for start in range(max(k, 3)):
            mean = seeds(x, k, np.random.default_rng([42, k, start]))
            width = np.full((k, x.shape[1]), np.clip(precision.mean(axis=0) if rules.local else rules.high, FLOOR, None) ** 2)
            tries.append(fitted(total, Model(np.full(k, 1 / k), mean, width), rules))
        one = best_start(tries, len(x), rules)
        if one:
            found.append(one)
        idle = 0 if one and one[0] < best else idle + 1
        best = min(best, one[0]) if one else best
        k += 1
    return found


def arrays(rows: pd.DataFrame, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and precisions in pixels."""
    if rules.pixelsize is None:
        one = rows[["lpx", "lpy"]].mean(axis=1).to_numpy(float)
        return rows[["x", "y"]].to_numpy(float), np.stack([one, one], axis=1)
    scale = np.array([1, 1, 1 / rules.pixelsize])
    return rows[["x", "y", "z"]].to_numpy(float) * scale, rows[["lpx", "lpy", "lpz"]].to_numpy(float) * scale


def bootstrapped(model: Model, precision: np.ndarray, rules: Rules, n: int) -> np.ndarray:
    """Deviations of the places when the model is fitted to samples of itself, of at most ROWS rows, scaled to n."""
    rng, means, size = np.random.default_rng(42), [], min(n, ROWS)
    for _ in range(rules.bootstraps):
        which = rng.choice(len(model.weight), size, p=model.weight / model.weight.sum())
        x = model.mean[which] + rng.normal(size=(size, model.mean.shape[1])) * np.sqrt(model.variance[which])
        again, _ = fitted(lambda m, x=x: sums(x, np.broadcast_to(precision[which], x.shape), m), model, rules)
        means.append(again.mean)
    return np.std(means, axis=0) * math.sqrt(size / n)


MOLECULE = "group_input long, molecule int, frame double, std_frame double, x double, y double, z double, lpx double, lpy double, lpz double, sigma_x double, sigma_y double, sigma_z double, rel_sigma_x double, rel_sigma_y double, rel_sigma_z double, p_val double, mol_log_likelihood double, group_log_likelihood double, n_locs long, n_events long"


def row_sums(rows: pd.DataFrame, model: Model, keep: np.ndarray, rules: Rules) -> np.ndarray:
    """For each kept component: shares, and their sums with frame, its square, the log density and precisions; last, log likelihoods."""
    all_x, all_precision = arrays(rows, rules)
    frames, table = rows["frame"].to_numpy(float), 0.0
    for some in _blocks(len(all_x), len(model.weight)):
        x, precision, frame = all_x[some], all_precision[some], frames[some]
        share = shares(x, model)[1][:, keep]
        inside = log_density(x, Model(model.weight[keep] / model.weight[keep].sum(), model.mean[keep], model.variance[keep]))
        top = inside.max(axis=1)
        log = (top + np.log(np.exp(inside - top[:, None]).sum(axis=1))).sum()
        columns = [share.sum(axis=0), share.T @ frame, share.T @ (frame * frame), (share * inside).sum(axis=0), *(share.T @ precision).T, np.full(len(keep), log)]
        table = table + np.stack(columns, axis=1)
    return table


def nearest_component(x: np.ndarray, model: Model, keep: np.ndarray) -> np.ndarray:
    kept = Model(*[a[keep] for a in model])
    return np.concatenate([log_density(x[some], kept).argmax(axis=1) for some in _blocks(len(x), len(keep))])


def molecules_of(group: int, n: int, model: Model, keep: np.ndarray, s: np.ndarray, events: np.ndarray, rules: Rules) -> pd.DataFrame:
    """Rows of MOLECULE from a model and the sums of its rows."""
    d, pixel = model.mean.shape[1], rules.pixelsize
    weight = model.weight[keep] / model.weight[keep].sum()
    mean, variance = model.mean[keep], model.variance[keep]
    total, frame = s[:, 0], s[:, 1] / s[:, 0]
    spread = np.maximum(s[:, 2] / total - frame * frame, 0) * total / ((n - 1) * total / n) if n > 1 else np.zeros(len(keep))
    log = s[:, 3] / total
    expected = np.log(weight / np.sqrt(2 * math.pi * variance).prod(axis=1)) - d / 2
    deviation = np.sqrt(d / 2 / (n * weight))
    p = [0.5 * (1 + math.erf(v)) for v in (log - expected) / (deviation * math.sqrt(2))]
    error = bootstrapped(Model(weight, mean, variance), s[:, 4 : 4 + d] / total[:, None], rules, n) if rules.bootstraps else np.sqrt(variance / (n * weight)[:, None])
    relative = np.sqrt(variance) / (s[:, 4 : 4 + d] / total[:, None])
    out = {"group_input": group, "molecule": np.arange(len(keep)), "frame": frame, "std_frame": np.sqrt(spread), "x": mean[:, 0], "y": mean[:, 1], "z": mean[:, 2] * pixel if d == 3 else None}
    for k, axis in enumerate("xyz"):
        unit = pixel if axis == "z" else 1.0
        out |= {f"lp{axis}": error[:, k] * unit, f"sigma_{axis}": np.sqrt(variance[:, k]), f"rel_sigma_{axis}": relative[:, k]} if k < d else {f"lp{axis}": None, f"sigma_{axis}": None, f"rel_sigma_{axis}": None}
    out |= {"p_val": p, "mol_log_likelihood": log, "group_log_likelihood": s[:, -1] / n, "n_locs": np.round(model.weight[keep] * n).astype(int), "n_events": events}
    return pd.DataFrame(out)[[c.split()[0] for c in MOLECULE.split(", ")]]


def event_means(locs: DataFrame, space: list[str]) -> DataFrame:
    """Means of each group's rows without more than GAP frames between them, in order of frame and loc_id."""
    order = Window.partitionBy("group").orderBy("frame", "loc_id")
    new = F.coalesce((F.col("frame") - F.lag("frame").over(order) > GAP).cast("int"), F.lit(0))
    rows = locs.withColumn("_new", new).withColumn("_event", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("group", "_event").agg(*[F.avg(c).alias(c) for c in space])


def _uniform(ids: np.ndarray, *salt: int) -> np.ndarray:
    """A number between 0 and 1 for each id, the same in every task."""
    z = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.random.SeedSequence(salt).generate_state(1, np.uint64)[0]
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53) + 2.0**-54


def _near(x: np.ndarray, chosen: list[np.ndarray]) -> np.ndarray:
    """Squared distances to the nearest of the chosen places; 1 without any."""
    return np.min([((x - c) ** 2).sum(axis=1) for c in chosen], axis=0) if chosen else np.ones(len(x))


Start = tuple[int, int, int]  # group, number of components, number of the start


def _by_group(asked: Iterable[Start]) -> dict[int, list[Start]]:
    out: dict[int, list[Start]] = {}
    for key in asked:
        out.setdefault(key[0], []).append(key)
    return out


def _drawn(rows: DataFrame, chosen: dict[Start, list[np.ndarray]], rules: Rules) -> dict[Start, list[np.ndarray]]:
    """Rows drawn in proportion to the squared distance from those chosen so far, as `seeds` does: every row runs a race, of which
    the rate is its distance, and the first one is drawn. The first row of all is drawn alone and evenly."""
    of = _by_group(chosen)

    def raced(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for group, own in part.groupby("group"):
                x, ids = arrays(own, rules)[0], own["loc_id"].to_numpy()
                for _, k, start in of.get(group, []):
                    near = _near(x, chosen[group, k, start])
                    for draw in range(2 + int(math.log(k)) if chosen[group, k, start] else 1):
                        time = -np.log(_uniform(ids, 42, k, start, len(chosen[group, k, start]), draw)) / np.where(near > 0, near, 1)
                        time[near <= 0] += math.inf if (near > 0).any() else 0
                        first = int(time.argmin())
                        out.append((group, k, start, draw, bool(near[first] <= 0), time[first], int(ids[first]), x[first].tolist()))
            yield pd.DataFrame(out, columns=["group", "k", "start", "draw", "last", "time", "loc_id", "x"])

    raced_rows = rows.mapInPandas(raced, "group long, k int, start int, draw int, last boolean, time double, loc_id long, x array<double>")
    found: dict[Start, list[np.ndarray]] = {}
    for r in raced_rows.groupBy("group", "k", "start", "draw").agg(F.min(F.struct("last", "time", "loc_id", "x")).alias("e")).orderBy("draw").collect():
        found.setdefault((r["group"], r["k"], r["start"]), []).append(np.array(r["e"]["x"]))
    return found


def _starts(rows: DataFrame, asked: list[Start], rules: Rules) -> dict[Start, np.ndarray]:
    """For each start as many rows as it has components, far from each other: of the rows drawn, the one after which all rows are
    nearest to a chosen one is taken. Two jobs a component, for all starts."""
    chosen: dict[Start, list[np.ndarray]] = {key: [] for key in asked}
    for c in range(max(k for _, k, _ in asked)):
        going = {key: rows_ for key, rows_ in chosen.items() if key[1] > c}
        drawn = _drawn(rows, going, rules)
        if c == 0:
            chosen |= {key: drawn[key] for key in going}
            continue
        of = _by_group(going)

        def left(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[tuple, float] = {}
            for part in parts:
                for group, own in part.groupby("group"):
                    x = arrays(own, rules)[0]
                    for key in of.get(group, []):  # noqa: B023
                        near = _near(x, going[key])  # noqa: B023
                        for draw, place in enumerate(drawn[key]):  # noqa: B023
                            total[*key, draw] = total.get((*key, draw), 0.0) + np.minimum(near, ((x - place) ** 2).sum(axis=1)).sum()
            yield pd.DataFrame([(*key, gap) for key, gap in total.items()], columns=["group", "k", "start", "draw", "gap"])

        gaps = rows.mapInPandas(left, "group long, k int, start int, draw int, gap double").groupBy("group", "k", "start", "draw").agg(F.sum("gap").alias("gap"))
        least = {(r["group"], r["k"], r["start"]): r["e"]["draw"] for r in gaps.groupBy("group", "k", "start").agg(F.min(F.struct("gap", "draw")).alias("e")).collect()}
        for key in going:
            chosen[key] = [*chosen[key], drawn[key][least[key]]]
    return {key: np.array(places) for key, places in chosen.items()}


def _summed(rows: DataFrame, models: dict[Start, Model], n: dict[int, int], rules: Rules) -> dict[Start, Sums]:
    """Sums of all models over all rows of their groups, in one job."""
    d, of = 2 if rules.pixelsize is None else 3, _by_group(models)

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[Start, Sums] = {}
        for part in parts:
            for group, own in part.groupby("group"):
                x, precision = arrays(own, rules)
                for key in of.get(group, []):
                    s = sums(x, precision, models[key])
                    total[key] = Sums(*[a + b for a, b in zip(total[key], s)]) if key in total else s
        out = [(*key, c, s.log if c == 0 else 0.0, v.tolist()) for key, s in total.items() for c, v in enumerate(np.c_[s.share, s.x, s.xx, s.precision])]
        yield pd.DataFrame(out, columns=["group", "k", "start", "c", "log", "s"])

    parts = rows.mapInPandas(partial, "group long, k int, start int, c int, log double, s array<double>")
    added = parts.groupBy("group", "k", "start", "c").agg(F.sum("log").alias("log"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(1 + 3 * d)])
    tables, logs = {key: np.zeros((key[1], 1 + 3 * d)) for key in models}, dict.fromkeys(models, 0.0)
    for r in added.collect():
        key = (r["group"], r["k"], r["start"])
        tables[key][r["c"]] = [r[f"s{i}"] for i in range(1 + 3 * d)]
        logs[key] += r["log"]
    return {key: Sums(n[key[0]], logs[key], t[:, 0], t[:, 1 : 1 + d], t[:, 1 + d : 1 + 2 * d], t[:, 1 + 2 * d :]) for key, t in tables.items()}


def _all_fitted(rows: DataFrame, models: dict[Start, Model], n: dict[int, int], rules: Rules) -> dict[Start, tuple[Model, float]]:
    """As `fitted`, for all models at once, a job a step."""
    done, last = {}, dict.fromkeys(models, -math.inf)
    for _ in range(STEPS):
        for key, s in _summed(rows, {key: done[key][0] if key in done else models[key] for key in last}, n, rules).items():
            done[key] = updated(s, rules), s.log / s.n
            if abs(s.log / s.n - last[key]) < STILL:
                del last[key]
            else:
                last[key] = s.log / s.n
        if not last:
            break
    return done


def _large_models(rows: DataFrame, rules: Rules) -> dict[int, Model]:
    """The best model of each group, by what `candidates` does, with draws and sums over all rows. So many numbers of components as
    must be tried in any case go side by side."""
    each = rows.groupBy("group").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in rows.columns if c not in ("loc_id", "group", "frame")]).toPandas()
    n = {int(g): int(m) for g, m in zip(each["group"], each["n"])}
    width = dict(zip(n, np.clip(arrays(each, rules)[1] if rules.local else rules.high, FLOOR, None) ** 2 * np.ones((len(each), 2 if rules.pixelsize is None else 3))))
    best: dict[int, tuple[float, Model]] = {}
    tried, idle = dict.fromkeys(n, 0), dict.fromkeys(n, 0)
    while True:
        numbers = [(g, k) for g in n for k in range(tried[g] + 1, min(tried[g] + rules.rounds - idle[g], n[g] // rules.least) + 1)]
        if not numbers:
            return {g: model for g, (_, model) in best.items()}
        starts = _starts(rows, [(g, k, start) for g, k in numbers for start in range(max(k, 3))], rules)
        models = {key: Model(np.full(key[1], 1 / key[1]), mean, np.tile(width[key[0]], (key[1], 1))) for key, mean in starts.items()}
        fits = _all_fitted(rows, models, n, rules)
        for g, k in numbers:
            one = best_start([fits[g, k, start] for start in range(max(k, 3))], n[g], rules)
            tried[g] = k
            if one and (g not in best or one[0] < best[g][0]):
                best[g], idle[g] = one, 0
            else:
                idle[g] += 1


def molecules(locs: DataFrame, rules: Rules = Rules(), limit: int = ROWS) -> DataFrame:
    """Molecules of each cluster (column group) as rows of MOLECULE: the components, of at least rules.least rows, of the mixture
    with the best criterion among those whose components are apart to the eye.

    frame and std_frame are weighted by the shares of rows, x, y in pixels, z in nm (null without rules.pixelsize, then z plays
    no part), lpx, lpy, lpz are errors of the place, sigma the widths in pixels and rel_sigma those by the precision.
    p_val: how likely a lower mean log density would be if the rows followed the molecule. n_events: runs of rows without a
    gap of over 3 frames whose mean is nearest to it. Clusters with fewer rows than rules.least have none. Needs loc_id,
    group, frame, x, y, lpx, lpy (z, lpz); rows with a null in one of them take no part. An empty table gives no rows.
    """
    space = ["x", "y"] if rules.pixelsize is None else ["x", "y", "z"]
    need = ["loc_id", "group", "frame", *space, *[f"lp{c}" for c in space]]
    rows = locs.select(*[F.col(c).cast("long" if c in ("loc_id", "group", "frame") else "double").alias(c) for c in need]).dropna()
    sizes = rows.groupBy("group").agg(F.count("*").alias("_n")).where(F.col("_n") >= rules.least)
    sizes = checkpointed(sizes)
    large = sizes.where(F.col("_n") > limit)
    ordinary = rows.join(sizes.where(F.col("_n") <= limit).select("group"), "group", "left_semi")

    def one(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["frame", "loc_id"])
        x, precision = arrays(own, rules)
        found = candidates(x, precision, rules)
        if not found:
            return pd.DataFrame(columns=[c.split()[0] for c in MOLECULE.split(", ")])
        model = min(found, key=lambda f: f[0])[1]
        keep = valid(model, len(own), rules)
        number = np.cumsum(np.r_[0, np.diff(own["frame"].to_numpy()) > GAP])
        means = np.stack([np.bincount(number, x[:, k]) for k in range(x.shape[1])], axis=1) / np.bincount(number)[:, None]
        events = np.bincount(nearest_component(means, model, keep), minlength=len(keep))
        return molecules_of(own["group"].iloc[0], len(own), model, keep, row_sums(own, model, keep, rules), events, rules)

    out = ordinary.groupBy("group").applyInPandas(one, MOLECULE)
    if large.isEmpty():
        return out
    mine = checkpointed(rows.join(F.broadcast(large.select("group")), "group", "left_semi"))
    best, n, spark = _large_models(mine, rules), {r["group"]: r["_n"] for r in large.collect()}, locs.sparkSession
    kept = {g: valid(m, n[g], rules) for g, m in best.items()}

    def described(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for group, own in part.groupby("group"):
                if group in best:
                    table = row_sums(own, best[group], kept[group], rules)
                    yield pd.DataFrame([{"group": group, "c": c, "s": v.tolist()} for c, v in enumerate(table)])

    def placed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scale = np.array([1, 1, 1 / (rules.pixelsize or 1)])[: len(space)]
        for part in parts:
            for group, own in part.groupby("group"):
                if group in best:
                    yield pd.DataFrame({"group": group, "c": nearest_component(own[space].to_numpy(float) * scale, best[group], kept[group])})

    width = 5 + len(space)
    table = mine.mapInPandas(described, "group long, c int, s array<double>").groupBy("group", "c").agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)]).collect()
    events = {(r["group"], r["c"]): r["count"] for r in event_means(mine, space).mapInPandas(placed, "group long, c int").groupBy("group", "c").count().collect()}
    found = []
    for group, model in best.items():
        s = np.array([[r[f"s{i}"] for i in range(width)] for r in sorted((r for r in table if r["group"] == group), key=lambda r: r["c"])])
        counts = np.array([events.get((group, c), 0) for c in range(len(kept[group]))])
        found.append(molecules_of(group, n[group], model, kept[group], s, counts, rules))
    rest = spark.createDataFrame(pd.concat(found).astype(object).where(lambda f: f.notna(), None).to_dict("records") if found else [], MOLECULE)
    return out.unionByName(rest)


def sum_mixtures(molecules: DataFrame) -> DataFrame:
    """(weight, x, y, z, sigma_x, sigma_y, sigma_z): one mixture of all clusters' molecules, weighted by their rows."""
    total = molecules.agg(F.sum("n_locs").alias("_all"))
    return molecules.join(F.broadcast(total)).select((F.col("n_locs") / F.col("_all")).alias("weight"), "x", "y", "z", "sigma_x", "sigma_y", "sigma_z")
