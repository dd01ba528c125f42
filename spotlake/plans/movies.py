"""Registered queries of detection and fitting on movies that are rendered from the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detection as D
from ..sources import adapters as A
from .catalogue import query, tidy

WIDE, HIGH, BOX = int(A.WIDTH), int(A.HEIGHT), 7
CX, CY = [1e-16, -3e-14, 2e-12, 4e-9, 3e-6, 1e-3, 1.05], [1e-16, 2e-14, 2e-12, -3e-9, 3e-6, -1e-3, 1.06]
PIXELS = ", pixels AS (SELECT frame // 432 AS frame, CAST(floor(y) AS BIGINT) AS iy, CAST(floor(x) AS BIGINT) AS ix, 10 * count(*) + CAST(sum(loc_id % 7) AS BIGINT) AS value FROM locs WHERE x >= 0 AND x < 512 AND y >= 0 AND y < 128 GROUP BY 1, 2, 3)"
FOUND = (
    PIXELS
    + """, best AS (SELECT p.* FROM pixels p WHERE iy BETWEEN 3 AND 123 AND ix BETWEEN 3 AND 507 AND NOT EXISTS (SELECT 1 FROM pixels q WHERE q.frame = p.frame AND q.iy BETWEEN p.iy - 3 AND p.iy + 3 AND q.ix BETWEEN p.ix - 3 AND p.ix + 3
    AND (q.value > p.value OR (q.value = p.value AND (q.iy < p.iy OR (q.iy = p.iy AND q.ix < p.ix)))))),
offs AS (SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CASE WHEN abs(i) <= 3 AND abs(j) <= 3 AND (i <> 0 OR j <> 0) THEN -i / sqrt(i * i + j * j) ELSE 0::DOUBLE END AS uy,
  CASE WHEN abs(i) <= 3 AND abs(j) <= 3 AND (i <> 0 OR j <> 0) THEN -j / sqrt(i * i + j * j) ELSE 0::DOUBLE END AS ux FROM range(-5, 6) a(i), range(-5, 6) b(j)),
kern AS (SELECT o.i, o.j, (SELECT uy FROM offs a WHERE a.i = o.i - 1 AND a.j = o.j) - (SELECT uy FROM offs a WHERE a.i = o.i + 1 AND a.j = o.j)
  + (SELECT ux FROM offs a WHERE a.i = o.i AND a.j = o.j - 1) - (SELECT ux FROM offs a WHERE a.i = o.i AND a.j = o.j + 1) AS w FROM offs o WHERE abs(o.i) <= 4 AND abs(o.j) <= 4),
found AS (SELECT b.frame, b.ix AS x, b.iy AS y, sum(q.value * w) AS net_gradient FROM best b JOIN pixels q ON q.frame = b.frame JOIN kern k ON k.i = (q.iy - b.iy + 192) % 128 - 64 AND k.j = (q.ix - b.ix + 768) % 512 - 256 GROUP BY ALL HAVING sum(q.value * w) > 40)"""
)


def movie(spark, d):
    rows = A.locs(spark, d).where("x >= 0 AND x < 512 AND y >= 0 AND y < 128")
    pixels = rows.groupBy(F.expr("frame div 432").alias("frame"), F.floor("y").alias("iy"), F.floor("x").alias("ix")).agg((10 * F.count("*") + F.sum(F.col("loc_id") % 7)).alias("value"))
    return D.movie_of(pixels, HIGH, WIDE)


@query(FOUND + " SELECT frame, x, y, round(net_gradient, 6) AS net_gradient FROM found")
def identify(spark, d):
    return tidy(D.identify(movie(spark, d), 40.0, BOX))


@query(FOUND + ", s AS (SELECT f.frame, f.x, f.y, (sum(q.value) - 49 * 2) * 0.5::DOUBLE AS photons FROM found f JOIN pixels q ON q.frame = f.frame AND abs(q.iy - f.y) <= 3 AND abs(q.ix - f.x) <= 3 GROUP BY ALL) SELECT frame, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, round(photons, 6) AS photons, round(photons, 6) AS bg, 0::DOUBLE AS ellipticity FROM s")
def average_roi(spark, d):
    return tidy(D.localize(movie(spark, d), 40.0, BOX, "average", baseline=2.0, sensitivity=0.5).select("frame", "x", "y", "photons", "bg", "ellipticity"))


@query()
def localize_least_squares(spark, d):
    return tidy(D.localize(movie(spark, d), 40.0, BOX), 3)


@query()
def localize_likelihood(spark, d):
    return tidy(D.localize(movie(spark, d), 40.0, BOX, method="mle"), 3)


@query()
def localize_3d(spark, d):
    return tidy(D.localize_3d(movie(spark, d), 40.0, BOX, CX, CY, 0.79, method="mle_round"), 3)


@query("SELECT pick_id + 1 AS n_id, round(x + frame * 0.001::DOUBLE, 6) AS x, round(y - frame * 0.0005::DOUBLE, 6) AS y, CAST(frame AS BIGINT) AS frame, 101::DOUBLE AS net_gradient FROM picks, range(100) t(frame)")
def picks_to_identifications(spark, d):
    drift = spark.range(100).select(F.col("id").alias("frame"), (F.col("id") * 0.001).alias("dx"), (F.col("id") * -0.0005).alias("dy"))
    return tidy(D.picks_to_identifications(A.picks(spark, d), 100, drift))


@query("SELECT loc_id + 1 AS n_id, x, y, frame + CAST(t.i AS BIGINT) AS frame, 101::DOUBLE AS net_gradient FROM locs, range(-2, 3) t(i) WHERE frame > 2 AND frame < 4318")
def locs_to_identifications(spark, d):
    return D.locs_to_identifications(A.locs(spark, d), A.FRAMES, 2)


@query(", m AS (SELECT frame // 144 AS frame, sx + 0.001::DOUBLE * (frame // 144) AS sx, sy FROM locs), s AS (SELECT frame, avg(sx) AS mx, avg(sy) AS my, var_samp(sx) AS vx, var_samp(sy) AS vy FROM m GROUP BY frame) SELECT m.frame, round(avg(sx), 6) AS sx, round(avg(sy), 6) AS sy FROM m JOIN s ON m.frame = s.frame WHERE pow(sx - mx, 2) < vx AND pow(sy - my, 2) < vy GROUP BY 1")
def calibration_means(spark, d):
    f = F.expr("frame div 144")
    return tidy(D.calibration_means(A.locs(spark, d).select(f.alias("frame"), (F.col("sx") + 0.001 * f).alias("sx"), "sy")))


@query()
def fit_z(spark, d):
    return tidy(D.fit_z(A.locs(spark, d), CX, CY, 0.79).select("loc_id", "z", "d_zcalib"), 4)


@query("SELECT loc_id, round(sqrt(sx * sx / (4 * photons) * (1 + 8 * tau + sqrt(8 * tau / (1 + 2 * tau)))), 6) AS se FROM (SELECT *, 2 * pi() * (sx * sx + 1::DOUBLE / 12) * bg / photons AS tau FROM locs)")
def likelihood_width_uncertainty(spark, d):
    return tidy(A.locs(spark, d).select("loc_id", D.likelihood_width_uncertainty(F.col("sx"), F.col("photons"), F.col("bg")).alias("se")))
