"""Registered queries of picks, thresholds and registration, with their SQL."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import images as I
from ..operators import picks as P
from ..operators import registration as R
from ..operators import tables as T
from ..sources import adapters as A
from .catalogue import query, tidy
from .measures import GREY, HIGH, IMAGE, WIDE, image

CIRCLED = ", picked AS (SELECT l.*, pick_id FROM locs l JOIN picks p ON (l.x - p.x) * (l.x - p.x) + (l.y - p.y) * (l.y - p.y) < 100)"
BARS = ", bars AS (SELECT pick_id, x AS x0, y AS y0, x + 30 AS x1, y + 40 AS y1 FROM picks), cut AS (SELECT loc_id, pick_id, ((x - x0) * 30 + (y - y0) * 40) / 50::DOUBLE AS x_pick_rot, ((y - y0) * 30 - (x - x0) * 40) / 50::DOUBLE AS y_pick_rot FROM locs, bars)"


def circled(spark, d):
    return P.picked_locs(A.locs(spark, d), A.picks(spark, d), "circle", 20.0)


def bars(spark, d):
    return A.picks(spark, d).select("pick_id", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 30).alias("x1"), (F.col("y") + 40).alias("y1"))


def kites(spark, d):
    corner = lambda c, *steps: F.array(*[F.col(c) + s for s in steps])
    return A.picks(spark, d).select("pick_id", corner("x", 0.0, 12.0, 0.0, -12.0).alias("xs"), corner("y", -9.0, 0.0, 15.0, 0.0).alias("ys"))


@query(CIRCLED + " SELECT pick_id, loc_id FROM picked")
def picked_by_shape(spark, d):
    return circled(spark, d).select("pick_id", "loc_id")


@query(BARS + " SELECT pick_id, loc_id, round(x_pick_rot, 6) AS x_pick_rot, round(y_pick_rot, 6) AS y_pick_rot FROM cut WHERE x_pick_rot > 0 AND x_pick_rot < 50 AND abs(y_pick_rot) < 4")
def picked_rectangles(spark, d):
    return tidy(P.picked_locs(A.locs(spark, d), bars(spark, d), "rectangle", 8.0).select("pick_id", "loc_id", "x_pick_rot", "y_pick_rot"))


@query(BARS + " SELECT pick_id, CAST(least(floor(x_pick_rot / (50::DOUBLE / 10)), 9) AS BIGINT) AS bin, count(*) AS n FROM cut WHERE x_pick_rot > 0 AND x_pick_rot < 50 AND abs(y_pick_rot) < 4 GROUP BY 1, 2")
def pick_profile(spark, d):
    return P.profile(P.picked_locs(A.locs(spark, d), bars(spark, d), "rectangle", 8.0), 10, 50.0)


# the crossings of a kite's four edges: left of the right one, and not left of the left one
@query("SELECT pick_id, loc_id FROM locs l, picks p WHERE (l.y >= p.y - 9 AND l.y < p.y AND l.x < p.x + 12 * ((l.y - (p.y - 9)) / 9) AND NOT l.x < (p.x - 12) + 12 * ((l.y - p.y) / -9)) OR (l.y >= p.y AND l.y < p.y + 15 AND l.x < (p.x + 12) + -12 * ((l.y - p.y) / 15) AND NOT l.x < p.x + -12 * ((l.y - (p.y + 15)) / -15))")
def picked_polygons(spark, d):
    return P.picked_locs(A.locs(spark, d), kites(spark, d), "polygon").select("pick_id", "loc_id")


@query(BARS + " SELECT loc_id FROM locs WHERE loc_id NOT IN (SELECT loc_id FROM cut WHERE x_pick_rot > 0 AND x_pick_rot < 50 AND abs(y_pick_rot) < 4)")
def remove_in_rectangles(spark, d):
    return P.remove_in_picks(A.locs(spark, d), bars(spark, d), "rectangle", 8.0).select("loc_id")


@query("SELECT pick_id, round(pi() * 100, 6) AS circle, 400::DOUBLE AS square, 400::DOUBLE AS rectangle, 288::DOUBLE AS polygon FROM picks")
def pick_areas(spark, d):
    out = P.pick_areas(A.picks(spark, d), "circle", 20.0).withColumnRenamed("area", "circle")
    for shape, table, size in (("square", A.picks(spark, d), 20.0), ("rectangle", bars(spark, d), 8.0), ("polygon", kites(spark, d), None)):
        out = out.join(P.pick_areas(table, shape, size).withColumnRenamed("area", shape), "pick_id")
    return tidy(out)


@query(CIRCLED + ", n AS (SELECT *, row_number() OVER (PARTITION BY pick_id, frame ORDER BY loc_id) AS nth FROM picked) SELECT pick_id, nth, min(frame) AS frame, max(frame) - min(frame) + 1 AS len, count(*) AS n, round(sum(x / (lpx * lpx)) / sum(1 / (lpx * lpx)), 6) AS x, round(sum(y / (lpy * lpy)) / sum(1 / (lpy * lpy)), 6) AS y, round(sqrt(1 / sum(1 / (lpx * lpx))), 6) AS lpx, round(sum(photons), 6) AS photons, round(avg(sx), 6) AS sx FROM n GROUP BY 1, 2")
def combine_in_picks(spark, d):
    return tidy(P.combine_in_picks(circled(spark, d)).select("pick_id", "nth", "frame", "len", "n", "x", "y", "lpx", "photons", "sx"))


PICK_EVENTS = CIRCLED + ", ev AS (SELECT *, sum(fresh) OVER (PARTITION BY pick_id ORDER BY frame, loc_id ROWS UNBOUNDED PRECEDING) AS event FROM (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY pick_id ORDER BY frame, loc_id) <= 4 THEN 0 ELSE 1 END AS fresh FROM picked))"


@query(PICK_EVENTS + " SELECT pick_id, count(*) AS n, round(sqrt(var_pop(x) + var_pop(y)) * 130, 6) AS rmsd, round(stddev_pop(z), 6) AS rmsd_z, CAST(count(DISTINCT event) AS BIGINT) AS n_events FROM ev GROUP BY pick_id")
def evaluate_picks(spark, d):
    return tidy(P.evaluate_picks(circled(spark, d), A.PIXELSIZE))


@query()
def pick_properties(spark, d):
    return tidy(P.pick_properties(circled(spark, d), areas=P.pick_areas(A.picks(spark, d), "circle", 20.0)), 4)


@query(CIRCLED + " SELECT pick_id FROM picks LEFT JOIN (SELECT pick_id, count(*) AS n FROM picked GROUP BY 1) USING (pick_id) WHERE coalesce(n, 0) BETWEEN 1 AND 50")
def filter_picks(spark, d):
    return P.filter_picks(A.picks(spark, d), circled(spark, d), 1, 50).select("pick_id")


@query(CIRCLED + " SELECT CAST(f.frame AS BIGINT) AS frame, count(p.loc_id) AS n, round(coalesce(sum(p.photons), 0), 6) AS photons FROM range(4320) f(frame) LEFT JOIN (SELECT * FROM picked WHERE pick_id = 3) p ON p.frame = f.frame GROUP BY 1")
def pick_trace(spark, d):
    return tidy(P.pick_trace(circled(spark, d), 3, A.FRAMES))


def _level(spark, value):
    return spark.range(1).select(F.lit(value).cast("double").alias("threshold"))


CLASSES = GREY + ", every AS (SELECT b.bin, coalesce(n, 0) AS n, (b.bin + 0.5::DOUBLE) * (SELECT m FROM top) / 256 AS center FROM range(256) b(bin) LEFT JOIN grey g ON g.bin = b.bin)"
LOCAL = IMAGE + ", steps AS (SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CASE i WHEN 0 THEN 1 ELSE exp(-4.5::DOUBLE) END * CASE j WHEN 0 THEN 1 ELSE exp(-4.5::DOUBLE) END / pow(1 + 2 * exp(-4.5::DOUBLE), 2) AS w FROM range(-1, 2) a(i), range(-1, 2) b(j)), near AS (SELECT p.iy, p.ix, p.value AS own, w, coalesce(q.value, 0) AS v FROM image p CROSS JOIN steps LEFT JOIN image q ON q.iy = least(greatest(p.iy + i, 0), 127) AND q.ix = least(greatest(p.ix + j, 0), 511)) SELECT iy, ix FROM near GROUP BY iy, ix, own HAVING own > (1 + 1e-9::DOUBLE) * "


@query(CLASSES + ", s AS (SELECT bin, center, sum(n) OVER b AS n1, sum(n * center) OVER b AS m1, sum(n) OVER () AS n0, sum(n * center) OVER () AS m0 FROM every WINDOW b AS (ORDER BY bin ROWS UNBOUNDED PRECEDING)) SELECT round(arg_min(center, bin), 6) AS threshold FROM s WHERE bin < 255 AND n1 > 0 AND n0 > n1 AND (m1 / n1 + (m0 - m1) / (n0 - n1)) / 2 - center >= 0 AND (m1 / n1 + (m0 - m1) / (n0 - n1)) / 2 - center < (SELECT m FROM top) / 256")
def threshold_isodata(spark, d):
    return tidy(_level(spark, I.threshold_isodata(image(spark, d), WIDE * HIGH)))


@query(CLASSES + ", s AS (SELECT bin, center, n / (SELECT sum(n) FROM every) AS p FROM every), c AS (SELECT bin, center, sum(p) OVER b AS p1, sum(p * p) OVER b AS q1, sum(p * p) OVER a AS q2 FROM s WINDOW b AS (ORDER BY bin ROWS UNBOUNDED PRECEDING), a AS (ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) SELECT round(arg_min(center, -ln(pow(p1 * (1 - p1), 2) / (q1 * q2))), 6) AS threshold FROM c WHERE bin < 255 AND q2 > 0 AND q1 > 0 AND p1 * (1 - p1) > 0")
def threshold_yen(spark, d):
    return tidy(_level(spark, I.threshold_yen(image(spark, d), WIDE * HIGH)))


@query()
def threshold_li(spark, d):
    return tidy(_level(spark, I.threshold_li(image(spark, d), WIDE * HIGH)))


@query()
def threshold_triangle(spark, d):
    return tidy(_level(spark, I.threshold_triangle(image(spark, d), WIDE * HIGH)))


@query()
def threshold_minimum(spark, d):
    return tidy(_level(spark, I.threshold_minimum(image(spark, d), WIDE * HIGH)))


@query(LOCAL + "(sum(v) / 9)")
def mask_above_local_mean(spark, d):
    return I.local_mask(image(spark, d), HIGH, WIDE, "mean")


@query(LOCAL + "sum(v * w)")
def mask_above_local_gaussian(spark, d):
    return I.local_mask(image(spark, d), HIGH, WIDE, "gaussian")


@query(LOCAL + "list_sort(list(v))[5]")
def mask_above_local_median(spark, d):
    return I.local_mask(image(spark, d), HIGH, WIDE, "median")


@query(IMAGE + ", f AS (SELECT iy, ix, value, (ix - 64) / 128::DOUBLE AS u, (127 - iy - 64) / 128::DOUBLE AS w FROM image WHERE ix < 128) SELECT iy, ix, round(value * CASE WHEN abs(u) < 0.375 THEN 1 ELSE 0.5 - 0.5 * cos(pi() * 8 * u) END * CASE WHEN abs(w) < 0.375 THEN 1 ELSE 0.5 - 0.5 * cos(pi() * 8 * w) END, 6) AS value FROM f")
def tukey_window(spark, d):
    return tidy(I.tukey_window(image(spark, d).where("ix < 128"), 128))


@query(", im AS (SELECT frame // 1440 AS image, CAST(floor(y) AS BIGINT) AS iy, CAST(floor(x) AS BIGINT) AS ix, count(*) AS value FROM locs GROUP BY ALL) SELECT a.image AS a, b.image AS b, b.iy - a.iy AS sy, b.ix - a.ix AS sx, CAST(sum(a.value * b.value) AS BIGINT) AS value FROM im a JOIN im b ON a.image < b.image AND abs(b.iy - a.iy) <= 4 AND abs(b.ix - a.ix) <= 4 GROUP BY ALL")
def cross_correlation(spark, d):
    rows = A.locs(spark, d).withColumn("third", F.expr("frame div 1440"))
    return R.cross_correlation(R.counted(rows, "third"), 4)


@query()
def correlation_drift(spark, d):
    return tidy(R.correlation_drift(A.locs(spark, d), A.FRAMES, 1440, reach=4), 4)


@query()
def align_channels(spark, d):
    return tidy(R.align_channels(A.locs(spark, d), reach=4).select("loc_id", "channel", "x", "y"), 4)
