"""Registered queries of views, drift by intersections, resolution and fiducials, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift as V
from ..operators import picks as P
from ..operators import rendering as R
from ..operators import resolution as Q
from ..operators import tables as T
from ..sources import adapters as A
from .catalogue import query, tidy

VIEW, SCALE, BLUR = (100.0, 20.0, 200.0, 80.0), 2.0, 0.15
ANGLES = (0.3, -0.2, 0.5)
COLORS = {"click": (1.0, 0.0, 0.5), "view": (0.0, 1.0, 0.5)}
IN_VIEW = "x > 100 AND x < 200 AND y > 20 AND y < 80"
DRAWN = """SELECT iy, ix, round(sum(exp(-(a * a * yy - 2 * a * b * xy + b * b * xx) / (2 * det)) / (2 * pi() * sqrt(det))), 6) AS value FROM (
SELECT *, ix + 0.5::DOUBLE - x AS a, iy + 0.5::DOUBLE - y AS b FROM (
SELECT *, unnest(range(greatest(CAST(trunc(x - 3 * sqrt(xx)) AS BIGINT), 0), least(CAST(trunc(x + 3 * sqrt(xx) + 1) AS BIGINT), 200))) AS ix FROM (
SELECT *, unnest(range(greatest(CAST(trunc(y - 3 * sqrt(yy)) AS BIGINT), 0), least(CAST(trunc(y + 3 * sqrt(yy) + 1) AS BIGINT), 120))) AS iy FROM (SELECT *, xx * yy - xy * xy AS det FROM g)))) GROUP BY iy, ix"""


def _turn(i: int, *names: str) -> str:
    """A row of the rotation in SQL, times names."""
    return "(" + " + ".join(f"{float(m)!r}::DOUBLE * {n}" for m, n in zip(R._matrix(ANGLES)[i], names, strict=True)) + ")"


def _spread(i: int, j: int) -> str:
    unit = R._matrix(ANGLES)
    return "(" + " + ".join(f"{float(unit[i, k] * unit[j, k])!r}::DOUBLE * {s} * {s}" for k, s in enumerate(("sa", "sb", "sc"))) + ")"


@query(f", g AS (SELECT (x - 100) * 2 AS x, (y - 20) * 2 AS y, pow(greatest(lpx, {BLUR}::DOUBLE) + greatest(lpy, {BLUR}::DOUBLE), 2) AS xx, pow(greatest(lpx, {BLUR}::DOUBLE) + greatest(lpy, {BLUR}::DOUBLE), 2) AS yy, 0::DOUBLE AS xy FROM locs WHERE {IN_VIEW}) " + DRAWN)
def render_round_gaussian(spark, d):
    return tidy(R.render(A.locs(spark, d), VIEW, SCALE, "gaussian_iso", BLUR))


@query(
    f", t AS (SELECT {_turn(0, '(x - 150)', '(y - 50)', '(z / 130)')} + 150 AS x, {_turn(1, '(x - 150)', '(y - 50)', '(z / 130)')} + 50 AS y, lpx * 2 AS sa, lpy * 2 AS sb, (lpx + lpy) * 2 AS sc FROM locs)"
    f", g AS (SELECT (x - 100) * 2 AS x, (y - 20) * 2 AS y, {_spread(0, 0)} AS xx, {_spread(1, 1)} AS yy, {_spread(0, 1)} AS xy FROM t WHERE {IN_VIEW}) " + DRAWN
)
def render_turned_gaussian(spark, d):
    return tidy(R.render(A.locs(spark, d), VIEW, SCALE, "gaussian", angles=ANGLES, pixelsize=A.PIXELSIZE))


@query(
    f", m AS (SELECT quantile_disc(lpx, 0.5) * 2 AS sx, quantile_disc(lpy, 0.5) * 2 AS sy FROM locs WHERE {IN_VIEW}), im AS (SELECT CAST(floor((y - 20) * 2) AS BIGINT) AS iy, CAST(floor((x - 100) * 2) AS BIGINT) AS ix, count(*) AS value FROM locs WHERE {IN_VIEW} GROUP BY 1, 2)"
    ", ky AS (SELECT i, exp(-i * i / (2 * sy * sy)) AS w FROM range(-9, 10) t(i), m WHERE abs(i) <= floor(5 * sy + 0.5)), kx AS (SELECT i, exp(-i * i / (2 * sx * sx)) AS w FROM range(-9, 10) t(i), m WHERE abs(i) <= floor(5 * sx + 0.5))"
    " SELECT iy + a.i AS iy, ix + b.i AS ix, round(sum(value * a.w * b.w) / (SELECT sum(w) FROM ky) / (SELECT sum(w) FROM kx), 6) AS value FROM im, ky a, kx b WHERE iy + a.i BETWEEN 0 AND 119 AND ix + b.i BETWEEN 0 AND 199 GROUP BY 1, 2"
)
def render_convolved(spark, d):
    return tidy(R.render(A.locs(spark, d), VIEW, SCALE, "convolve"))


@query("SELECT CAST(floor((y - 20) * 2) AS BIGINT) AS iy, CAST(floor(x - 100) AS BIGINT) AS ix, CAST(floor((z / 130 - (-200::DOUBLE / 130)) * 4) AS BIGINT) AS iz, count(*) AS value FROM locs WHERE " + IN_VIEW + " AND z > -200 AND z < 200 GROUP BY 1, 2, 3")
def render_voxels(spark, d):
    return R.render_voxels(A.locs(spark, d), VIEW, -200.0, 200.0, (1.0, 2.0, 4.0), A.PIXELSIZE)


@query(
    f", im AS (SELECT channel, CAST(floor((y - 20) * 2) AS BIGINT) AS iy, CAST(floor((x - 100) * 2) AS BIGINT) AS ix, count(*) AS value FROM locs WHERE {IN_VIEW} AND channel IN ('click', 'view') GROUP BY 1, 2, 3)"
    ", s AS (SELECT iy, ix, channel, value / max(value) OVER (PARTITION BY channel) * CASE channel WHEN 'view' THEN 0.5::DOUBLE ELSE 1 END AS v FROM im)"
    " SELECT iy, ix, round(least(coalesce(sum(v) FILTER (channel = 'click'), 0), 1), 6) AS red, round(least(coalesce(sum(v) FILTER (channel = 'view'), 0), 1), 6) AS green, round(least(sum(v) * 0.5::DOUBLE, 1), 6) AS blue FROM s GROUP BY 1, 2"
)
def render_channels(spark, d):
    return tidy(R.render_channels(A.locs(spark, d), COLORS, VIEW, SCALE, intensities={"view": 0.5}))


@query(
    ', m AS (SELECT "group", avg(x) AS mx, avg(y) AS my, row_number() OVER (ORDER BY "group") - 1 AS nth FROM locs WHERE "group" IS NOT NULL GROUP BY "group"), p AS (SELECT loc_id, nth, x - mx + nth % 7 * 30 AS x, y - my + nth // 7 * 30 AS y FROM locs JOIN m USING ("group"))'
    ' SELECT loc_id, nth AS "group", round(x - (SELECT min(x) FROM p), 6) AS x, round(y - (SELECT min(y) FROM p), 6) AS y FROM p'
)
def unfold_square(spark, d):
    return tidy(T.unfold_square(A.locs(spark, d), 7, 30.0).select("loc_id", "group", "x", "y"))


@query()
def intersection_drift(spark, d):
    return tidy(V.intersection_drift(A.locs(spark, d), A.FRAMES, 864, side=1.0, radius=3.0), 4)


@query()
def ring_correlation(spark, d):
    return tidy(Q.ring_correlation(A.locs(spark, d), (0.0, 0.0, A.HEIGHT, A.HEIGHT), 2.0, A.PIXELSIZE)[0])


@query()
def permutation_test(spark, d):
    return tidy(Q.permutation_test(A.locs(spark, d), "channel", "x", "click", "view", 200))


@query()
def fiducials(spark, d):
    rows = A.locs(spark, d)
    return P.find_fiducials(rows.where(F.col("channel") == "view"), int(A.WIDTH), int(A.HEIGHT), 4, A.PIXELSIZE)[0]
