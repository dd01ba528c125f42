"""From movie frames to localizations: spot detection, cutting and fitting, each frame or spot where it is read.

A movie is a table (frame, height, width, dtype, pixels), pixels being the rows of one image in little-endian bytes. A frame
is the unit of work: its size is bounded by the camera, so tasks hold a frame, or a batch of spots, at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X

MOVIE = "frame long, height int, width int, dtype string, pixels binary"
IDS = "frame long, x long, y long, net_gradient double"
MOMENTS = ("fx", "fy", "photons", "bg", "sx", "sy")
FITTED_AT_ONCE = 2000


def image_of(row: dict) -> np.ndarray:
    return np.frombuffer(row["pixels"], np.dtype(row["dtype"]).newbyteorder("<")).reshape(row["height"], row["width"])


def movie_of(pixels: DataFrame, height: int, width: int, dtype: str = "uint16") -> DataFrame:
    """A movie from sparse pixels (frame, iy, ix, value); pixels outside the image are left out, missing ones are 0."""

    def dense(rows: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((height, width), dtype)
        image[rows["iy"], rows["ix"]] = rows["value"]
        return pd.DataFrame({"frame": [rows["frame"].iloc[0]], "height": height, "width": width, "dtype": dtype, "pixels": image.astype(np.dtype(dtype).newbyteorder("<")).tobytes()})

    inside = pixels.where((F.col("iy") >= 0) & (F.col("iy") < height) & (F.col("ix") >= 0) & (F.col("ix") < width))
    return inside.select("frame", "iy", "ix", "value").groupBy("frame").applyInPandas(dense, MOVIE)


def local_maxima(image: np.ndarray, box: int) -> tuple[np.ndarray, np.ndarray]:
    """(y, x) of pixels that are the first largest of the box around them, the last possible row and column left out."""
    half = box // 2
    if min(image.shape) < box + 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    boxes = np.lib.stride_tricks.sliding_window_view(image, (box, box))[:-1, :-1]
    tops = boxes.reshape(*boxes.shape[:2], -1).argmax(axis=2) == half * box + half
    y, x = np.nonzero(tops)
    return y + half, x + half


def net_gradient(image: np.ndarray, y: np.ndarray, x: np.ndarray, box: int) -> np.ndarray:
    """Sum over the box of the central differences' parts that point to its centre. Differences at an edge wrap around."""
    half = box // 2
    gy, gx = np.roll(image, -1, 0) - np.roll(image, 1, 0), np.roll(image, -1, 1) - np.roll(image, 1, 1)
    total = np.zeros(len(y))
    for i in range(-half, half + 1):
        for j in range(-half, half + 1):
            if i or j:
                total -= (gy[y + i, x + j] * i + gx[y + i, x + j] * j) / math.hypot(i, j)
    return total


def identify_in_image(image: np.ndarray, minimum: float, box: int, roi: tuple[tuple[int, int], tuple[int, int]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, x, net gradient) of the local maxima above the minimum; roi: ((y0, x0), (y1, x1)), in whose image alone they are sought."""
    (y0, x0), (y1, x1) = roi or ((0, 0), image.shape)
    part = image[y0:y1, x0:x1].astype(np.float64)
    y, x = local_maxima(part, box)
    gradient = net_gradient(part, y, x, box)
    keep = gradient > minimum
    return y[keep] + y0, x[keep] + x0, gradient[keep]


def frames_within(movie: DataFrame, frame_bounds: tuple[int | None, int | None]) -> DataFrame:
    """The movie's own columns of the frames within the bounds (inclusive, None: open)."""
    low, high = frame_bounds
    seen = movie if low is None else movie.where(F.col("frame") >= low)
    seen = seen if high is None else seen.where(F.col("frame") <= high)
    return seen.select(*[c.split()[0] for c in MOVIE.split(", ")])


def images_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(frame, image) of the rows of Arrow batches, one image at a time."""
    for batch in batches:
        for at in range(len(batch)):
            row = batch.slice(at, 1).to_pylist()[0]
            yield row["frame"], image_of(row)


def identify(movie: DataFrame, minimum: float, box: int, roi=None, frame_bounds: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """(frame, x, y, net_gradient) of the spots of every frame within the bounds (inclusive)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame, image in images_of(batches):
            y, x, gradient = identify_in_image(image, minimum, box, roi)
            yield pa.RecordBatch.from_arrays([pa.array([frame] * len(y), pa.int64()), pa.array(x), pa.array(y), pa.array(gradient)], ["frame", "x", "y", "net_gradient"])

    return frames_within(movie, frame_bounds).mapInArrow(find, IDS)


def picks_to_identifications(picks: DataFrame, frames: int, drift: DataFrame | None = None) -> DataFrame:
    """Circular picks in every frame of a movie, moved by the drift (frame, dx, dy) if there is one."""
    rows = picks.select((F.col("pick_id") + 1).alias("n_id"), "x", "y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(frames - 1).cast("long"))).alias("frame"), F.lit(101.0).alias("net_gradient"))
    if drift is None:
        return rows
    moved = rows.join(drift, "frame", "left")
    return moved.select("n_id", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "frame", "net_gradient")


def locs_to_identifications(locs: DataFrame, frames: int, around: int) -> DataFrame:
    """Each row that is far enough from the movie's ends, in the frames up to `around` before and after its own."""
    inner = locs.where((F.col("frame") > around) & (F.col("frame") < frames - around))
    span = F.explode(F.sequence(F.col("frame") - around, F.col("frame") + around)).alias("frame")
    return inner.select((F.col("loc_id") + 1).alias("n_id"), "x", "y", span, F.lit(101.0).alias("net_gradient"))


def cut_boxes(image: np.ndarray, x: np.ndarray, y: np.ndarray, box: int, baseline: float, sensitivity: float, gain: float) -> tuple[np.ndarray, np.ndarray]:
    """(keep, spots): which boxes around (x, y) lie inside the image, and the photons in those, n x box x box."""
    half = box // 2
    keep = (x >= half) & (y >= half) & (x < image.shape[1] - half) & (y < image.shape[0] - half)
    reach = np.arange(-half, half + 1)
    spots = image[y[keep][:, None, None] + reach[:, None], x[keep][:, None, None] + reach]
    return keep, (spots.astype(np.float64) - baseline) * sensitivity / gain


def get_spots(movie: DataFrame, ids: DataFrame, box: int, baseline: float = 0.0, sensitivity: float = 1.0, gain: float = 1.0) -> DataFrame:
    """ids with `box` and `spot`: the photons of the box around each, row by row. Boxes that leave the image are dropped.

    For ids from elsewhere, which have to meet their frames by a shuffle; `localize` finds, cuts and fits where a frame is read.
    """
    names = ids.columns

    def cut(own: pa.Table, images: pa.Table) -> pa.Table:
        keep, spots = np.zeros(len(own), bool), np.zeros((0, box, box))
        frames = images.slice(0, 1).to_pylist()
        if frames:
            x, y = (own.column(c).to_numpy().astype(np.int64) for c in "xy")
            keep, spots = cut_boxes(image_of(frames[0]), x, y, box, baseline, sensitivity, gain)
        kept = own.filter(pa.array(keep))
        return pa.table({**{c: kept.column(c) for c in names}, "box": pa.array([box] * len(spots), pa.int32()), "spot": pa.array(list(spots.reshape(len(spots), box * box)), pa.list_(pa.float64()))})

    shape = ", ".join(f"`{c}` {kind}" for c, kind in ids.dtypes) + ", box int, spot array<double>"
    return ids.groupBy("frame").cogroup(movie.groupBy("frame")).applyInArrow(cut, shape)


def moments(spots: np.ndarray) -> np.ndarray:
    """spots x (x, y, photons, bg, sx, sy) from centres of mass, x and y from the box's centre; a flat spot gives its centre."""
    n, box = len(spots), spots.shape[1]
    grid, bg = np.arange(box) - box // 2, spots.min(axis=(1, 2), initial=np.inf)
    free = spots - bg[:, None, None]
    total = free.sum(axis=(1, 2))
    flat = total <= 0
    weight = np.where(flat, 1.0, total)
    x, y = (np.where(flat, 0.0, (free.sum(axis=a) * grid).sum(axis=1) / weight) for a in (1, 2))
    sx, sy = (np.where(flat, 1.0, np.sqrt(np.maximum(1e-4, (free.sum(axis=a) * (grid - c[:, None]) ** 2).sum(axis=1) / weight))) for a, c in ((1, x), (2, y)))
    return np.stack([x, y, np.maximum(1.0, total), bg, sx, sy], axis=1).reshape(n, 6)


def fit_least_squares(spots: np.ndarray, rounds: int = 40, tolerance: float = 1e-6) -> np.ndarray:
    """spots x (x, y, photons, bg, sx, sy): a sampled Gaussian on a flat background by damped Gauss-Newton steps, all spots at once."""
    theta, box = moments(spots), spots.shape[1]
    grid = (np.arange(box) - box // 2).astype(float)

    def model(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dx, dy = grid - p[:, :1], grid - p[:, 1:2]
        sx, sy = p[:, 4:5], p[:, 5:6]
        gx, gy = np.exp(-0.5 * (dx / sx) ** 2) / (math.sqrt(2 * math.pi) * sx), np.exp(-0.5 * (dy / sy) ** 2) / (math.sqrt(2 * math.pi) * sy)
        both = gy[:, :, None] * gx[:, None, :]
        n = p[:, 2, None, None] * both
        slopes = [n * (dx / sx**2)[:, None, :], n * (dy / sy**2)[:, :, None], both, np.ones_like(both), n * (dx**2 / sx**3 - 1 / sx)[:, None, :], n * (dy**2 / sy**3 - 1 / sy)[:, :, None]]
        return n + p[:, 3, None, None], np.stack([s.reshape(len(p), -1) for s in slopes], axis=2)

    damping, open_ = np.full(len(theta), 1e-3), np.arange(len(theta))
    for _ in range(rounds):
        if not len(open_):
            break
        p = theta[open_]
        value, slope = model(p)
        miss = (spots[open_] - value).reshape(len(p), -1)
        square, push = np.einsum("nki,nkj->nij", slope, slope), np.einsum("nki,nk->ni", slope, miss)
        diagonal = np.einsum("nii->ni", square)[:, :, None] * np.eye(6) + 1e-12 * np.eye(6)
        step = np.linalg.solve(square + damping[open_, None, None] * diagonal, push[:, :, None])[:, :, 0]
        new = p + step
        new[:, 4:] = np.clip(np.abs(new[:, 4:]), 0.05, 10 * box)
        better = ((spots[open_] - model(new)[0]) ** 2).sum(axis=(1, 2)) <= (miss**2).sum(axis=1)
        theta[open_[better]] = new[better]
        damping[open_] = np.clip(np.where(better, damping[open_] / 5, damping[open_] * 8), 1e-9, 1e9)
        done = (better & (np.abs(step) <= tolerance * (np.abs(p) + tolerance)).all(axis=1)) | (damping[open_] >= 1e9)
        open_ = open_[~done]
    return theta


#: erf at steps of 1/512 up to 6, beyond which it is 1 to double precision.
_ERF_STEPS = 512
_ERF = np.array([math.erf(i / _ERF_STEPS) for i in range(6 * _ERF_STEPS + 2)])
_ERF_SLOPE = 2 / math.sqrt(math.pi) * np.exp(-((np.arange(len(_ERF)) / _ERF_STEPS) ** 2)) / _ERF_STEPS


def _erf(x: np.ndarray) -> np.ndarray:
    """The error function by cubic interpolation of a table with its slopes; absolute error below 1e-12."""
    at = np.minimum(np.abs(x), 6.0) * _ERF_STEPS
    i = at.astype(np.int64)
    t = at - i
    u = 1 - t
    value = u * u * ((1 + 2 * t) * _ERF[i] + t * _ERF_SLOPE[i]) + t * t * ((1 + 2 * u) * _ERF[i + 1] - u * _ERF_SLOPE[i + 1])
    return np.copysign(value, x)


def _pixel_shares(center: np.ndarray, sigma: np.ndarray, grid: np.ndarray):
    """Shares of a Gaussian in each pixel, with first and second derivatives by centre and by width."""
    s, low, high = sigma[:, None], grid - 0.5 - center[:, None], grid + 0.5 - center[:, None]
    share = 0.5 * (_erf(high / (math.sqrt(2) * s)) - _erf(low / (math.sqrt(2) * s)))
    a, b, norm = np.exp(-0.5 * (low / s) ** 2), np.exp(-0.5 * (high / s) ** 2), math.sqrt(2 * math.pi)
    first = low * a - high * b
    by_width2 = ((low**3 * a - high**3 * b) / s**5 - 2 * first / s**3) / norm
    return share, (a - b) / (norm * s), first / (norm * s**3), first / (norm * s**2), by_width2


def fit_likelihood(spots: np.ndarray, round_spot: bool = False, eps: float = 1e-3, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(theta, bounds, log-likelihood, rounds): Poisson likelihood of a Gaussian integrated over pixels.

    Newton steps on each parameter, limited in length; round_spot: one width for both axes. bounds are the diagonal of the
    inverse Fisher matrix (Cramer-Rao); with one width, those of sx and sy are equal.
    """
    theta, box = moments(spots), spots.shape[1]
    grid = (np.arange(box) - box // 2).astype(float)
    theta[:, 3] = np.maximum(theta[:, 3], 0.01)
    if round_spot:
        theta[:, 4:] = theta[:, 4:].mean(axis=1, keepdims=True)
    limit = np.column_stack([theta[:, 4], theta[:, 4], 0.1 * theta[:, 2], np.maximum(0.1 * theta[:, 3], 0.5), 0.2 * theta[:, 4], 0.2 * theta[:, 5]])
    took, open_ = np.zeros(len(theta), np.int64), np.arange(len(theta))

    def parts(p: np.ndarray):
        px, py = _pixel_shares(p[:, 0], p[:, 4], grid), _pixel_shares(p[:, 1], p[:, 5], grid)
        cross = lambda fy, fx: fy[:, :, None] * fx[:, None, :]
        n = p[:, 2, None, None]
        both = cross(py[0], px[0])
        first = [n * cross(py[0], px[1]), n * cross(py[1], px[0]), both, np.ones_like(both), n * cross(py[0], px[3]), n * cross(py[3], px[0])]
        second = [n * cross(py[0], px[2]), n * cross(py[2], px[0]), 0 * both, 0 * both, n * cross(py[0], px[4]), n * cross(py[4], px[0])]
        if round_spot:
            first[4:], second[4:] = [first[4] + first[5]] * 2, [second[4] + second[5] + 2 * n * cross(py[3], px[3])] * 2
        return n * both + p[:, 3, None, None], np.stack(first, axis=1), np.stack(second, axis=1)

    for _ in range(rounds):
        if not len(open_):
            break
        p, data = theta[open_], spots[open_]
        value, first, second = parts(p)
        seen = value > 0.01
        safe = np.where(seen, value, 1.0)
        excess, weight = np.minimum(np.where(seen, data / safe - 1, 0.0), 1e5), np.minimum(np.where(seen, data / safe**2, 0.0), 1e5)
        up = (excess[:, None] * first).sum(axis=(2, 3))
        down = (excess[:, None] * second - weight[:, None] * first**2).sum(axis=(2, 3))
        step = np.where(down == 0, np.sign(up) * limit[open_], np.clip(up / np.where(down == 0, 1.0, down), -limit[open_], limit[open_]))
        new = p - step
        new[:, 2], new[:, 3], new[:, 4:] = np.maximum(new[:, 2], 1.0), np.maximum(new[:, 3], 0.01), np.clip(new[:, 4:], 0.01, box)
        theta[open_], took[open_] = new, took[open_] + 1
        moved = np.abs(new - p) / np.column_stack([np.ones((len(p), 2)), p[:, 2:4], np.ones((len(p), 2))])
        open_ = open_[moved.max(axis=1) >= eps]

    value, first, _ = parts(theta)
    flat = first[:, :5] if round_spot else first
    fisher = np.einsum("niyx,njyx->nij", flat / np.maximum(value, 1e-12)[:, None], flat)
    bounds = np.einsum("nii->ni", np.linalg.pinv(fisher)) if len(theta) else np.zeros((0, 6))
    bounds = np.column_stack([bounds, bounds[:, 4]]) if round_spot and len(theta) else bounds
    safe = np.maximum(value, 1e-300)
    gain = np.where(spots > 0, spots * np.log(safe) - value - spots * np.log(np.where(spots > 0, spots, 1.0)) + spots, -value)
    return theta, bounds, np.where(value > 0, gain, 0.0).sum(axis=(1, 2)), took


def _fitted_columns(method: str) -> list[str]:
    return [*MOMENTS, *([f"b{i}" for i in range(6)] + ["log_likelihood", "iterations"] if method.startswith("mle") else [])]


def _fit_columns(spots: np.ndarray, method: str) -> list[np.ndarray]:
    """Values of `_fitted_columns` for n x box x box photons."""
    if method == "lq":
        return [*fit_least_squares(spots).T]
    if method == "average":
        total, zero, one = spots.sum(axis=(1, 2)), np.zeros(len(spots)), np.ones(len(spots))
        return [zero, zero, total, total, one, one]
    theta, bounds, likelihood, took = fit_likelihood(spots, method == "mle_round")
    return [*theta.T, *bounds.T, likelihood, took.astype(float)]


def _as_localizations(fitted: DataFrame, names: list[str], method: str, em: bool) -> DataFrame:
    """Fitted columns beside those of the ids (`names`) as a localization table."""
    wide, narrow = F.greatest("sx", "sy"), F.least("sx", "sy")
    kept = [F.col(c) for c in names if c not in ("x", "y")]
    place = [(F.col("x") + F.col("fx")).alias("x"), (F.col("y") + F.col("fy")).alias("y")]
    found = [F.col(c) for c in ("photons", "sx", "sy", "bg")]
    if method.startswith("mle"):
        precision = [F.sqrt("b0").alias("lpx"), F.sqrt("b1").alias("lpy")]
        found += [F.col("log_likelihood"), F.col("iterations").cast("long").alias("iterations"), *[F.sqrt(b).alias(f"{c}_unc") for b, c in (("b2", "photons"), ("b3", "bg"), ("b4", "sx"), ("b5", "sy"))]]
    else:
        precision = [X.localization_precision(F.col("photons"), F.col(a), F.col(b), F.col("bg"), em).alias(c) for a, b, c in (("sx", "sy", "lpx"), ("sy", "sx", "lpy"))]
    return fitted.select(*kept, *place, *found, *precision, ((wide - narrow) / wide).alias("ellipticity"))


def fit_spots(spots: DataFrame, method: str = "lq", em: bool = False) -> DataFrame:
    """Localizations of cut spots, each task fitting its batches as they come.

    method lq: least squares; mle: likelihood with two widths; mle_round: with one; average: the sum of the box at its
    centre. Columns of the ids stay (x and y are moved to the fitted place); photons, sx, sy, bg, lpx, lpy and ellipticity
    are added, by likelihood also log_likelihood, iterations and *_unc. em: electron-multiplying camera.
    """
    names, added = [c for c in spots.columns if c not in ("spot", "box")], _fitted_columns(method)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), FITTED_AT_ONCE):
                part = batch.slice(at, FITTED_AT_ONCE)
                box = part.column("box")[0].as_py()
                values = _fit_columns(np.array(part.column("spot").to_pylist(), float).reshape(-1, box, box), method)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array(np.ascontiguousarray(c)) for c in values)], [*names, *added])

    kinds = dict(spots.dtypes)
    shape = ", ".join([f"`{c}` {kinds[c]}" for c in names] + [f"{c} double" for c in added])
    return _as_localizations(spots.mapInArrow(fit, shape), names, method, em)


def localize(movie: DataFrame, minimum: float, box: int, method: str = "lq", roi=None, frame_bounds=(None, None), baseline: float = 0.0, sensitivity: float = 1.0, gain: float = 1.0, em: bool = False) -> DataFrame:
    """Detection, cutting and fitting of a whole movie (methods as in `fit_spots`), each frame where it is read: no image is
    shuffled, and a task holds one image and the spots of its frames up to FITTED_AT_ONCE, or those of one crowded frame.
    A frame without spots gives no row; columns that a movie has besides its own are ignored."""
    names, added = [c.split()[0] for c in IDS.split(", ")], _fitted_columns(method)

    def fitted(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        frame, x, y, gradient, spots = (np.concatenate(c) for c in zip(*held, strict=True))
        for at in range(0, len(spots), FITTED_AT_ONCE):
            part = slice(at, at + FITTED_AT_ONCE)
            values = _fit_columns(spots[part], method)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (frame[part], x[part], y[part], gradient[part], *values)], [*names, *added])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for frame, image in images_of(batches):
            y, x, gradient = identify_in_image(image, minimum, box, roi)
            keep, spots = cut_boxes(image, x, y, box, baseline, sensitivity, gain)
            held.append((np.full(len(spots), frame, np.int64), x[keep], y[keep], gradient[keep], spots))
            waiting += len(spots)
            if waiting >= FITTED_AT_ONCE:
                yield from fitted(held)
                held, waiting = [], 0
        if waiting:
            yield from fitted(held)

    shape = ", ".join([IDS, *[f"{c} double" for c in added]])
    return _as_localizations(frames_within(movie, frame_bounds).mapInArrow(work, shape), names, method, em)


def localize_3d(movie: DataFrame, minimum: float, box: int, cx: list[float], cy: list[float], magnification: float = 1.0, **options) -> DataFrame:
    return fit_z(localize(movie, minimum, box, **options), cx, cy, magnification)


def likelihood_width_uncertainty(sigma, photons, bg):
    """Standard error of a width fitted by likelihood, as a column."""
    sa2 = sigma * sigma + F.lit(1 / 12)
    tau = X.ratio(F.lit(2 * math.pi) * sa2 * bg, photons)
    return F.sqrt(X.ratio(sigma * sigma, 4 * photons) * (1 + 8 * tau + F.sqrt(X.ratio(8 * tau, 1 + 2 * tau))))


def calibration_means(locs: DataFrame) -> DataFrame:
    """(frame, sx, sy): mean widths of each frame's rows that lie within one deviation of its mean in both widths."""
    frames = locs.groupBy("frame").agg(*[f(c).alias(f"_{n}{c}") for c in ("sx", "sy") for f, n in ((F.avg, "m"), (F.var_samp, "v"))])
    near = [F.pow(F.col(c) - F.col(f"_m{c}"), 2) < F.col(f"_v{c}") for c in ("sx", "sy")]
    kept = locs.select("frame", "sx", "sy").join(frames, "frame").where(near[0] & near[1])
    return kept.groupBy("frame").agg(F.avg("sx").alias("sx"), F.avg("sy").alias("sy"))


def calibrate_z(locs: DataFrame, frames: int, step: float, frame_bounds: tuple[int, int] | None = None) -> dict[str, list[float]]:
    """Coefficients (highest power first, of degree 6) of the widths' curves over z of a scan in steps of `step` nm from
    the bottom up; they cross at z = 0. The driver sees a row for each frame of the scan."""
    low, high = frame_bounds or (0, frames - 1)
    means = calibration_means(locs.where(F.col("frame").between(low, high))).toPandas().set_index("frame").reindex(range(low, high + 1))
    widths = [means[c].interpolate("linear", limit_direction="both").to_numpy(float) for c in ("sx", "sy")]
    z = (frames - 1) * step / 2 - np.arange(low, high + 1) * step
    curves = [np.polyfit(z, w, 6) for w in widths]
    fine = np.linspace(z[0], z[-1], 10_000)
    z = z - fine[np.argmin(np.abs(np.polyval(curves[0], fine) - np.polyval(curves[1], fine)))]
    return {"cx": np.polyfit(z, widths[0], 6).tolist(), "cy": np.polyfit(z, widths[1], 6).tolist()}


def fit_z(locs: DataFrame, cx: list[float], cy: list[float], magnification: float = 1.0, reach: float = 1000.0) -> DataFrame:
    """Adds z (nm) and d_zcalib: the place within +-reach whose curve widths are nearest to sx, sy by the squares of the
    differences of roots, and that distance. A grid of 5 nm and three finer ones about its best place."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def miss(z, sx, sy):
            wx, wy = (np.sqrt(np.maximum(np.polyval(c, z), 0.0)) for c in (cx, cy))
            return (np.sqrt(sx)[:, None] - wx) ** 2 + (np.sqrt(sy)[:, None] - wy) ** 2

        for batch in batches:
            for at in range(0, len(batch), 4000):
                part = batch.slice(at, 4000)
                sx, sy = (part.column(c).to_numpy(zero_copy_only=False) for c in ("sx", "sy"))
                z, width = np.zeros(len(part)), reach
                grid = np.linspace(-reach, reach, int(reach / 2.5) + 1)[None]
                for _ in range(4):
                    tried = np.clip(z[:, None] + grid, -reach, reach)
                    z = tried[np.arange(len(z)), miss(tried, sx, sy).argmin(axis=1)]
                    width = (grid[0, 1] - grid[0, 0]) * 1.5
                    grid = np.linspace(-width, width, 31)[None]
                d = np.sqrt(miss(z[:, None], sx, sy)[:, 0])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(z * magnification), pa.array(d)], [*part.schema.names, "z", "d_zcalib"])

    rows = locs.drop("z", "d_zcalib")
    shape = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes) + ", z double, d_zcalib double"
    return rows.mapInArrow(nearest, shape)
