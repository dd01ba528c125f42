"""Registered queries of the localization operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import events as E
from ..operators import spatial as S
from ..operators import tables as T
from ..sources import adapters as A

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str = ""):
    """Registers a function (spark, sf_dir) under its name; sql may use the views locs and picks."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH locs AS ({A.LOCS_SQL}), picks AS ({A.PICKS_SQL}) {sql}"
        return f

    return register


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison."""
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


ISLANDS = """ev AS (SELECT *, sum(fresh) OVER (PARTITION BY "group" ORDER BY frame, loc_id ROWS UNBOUNDED PRECEDING) AS event FROM (
  SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY "group" ORDER BY frame, loc_id) <= {gap} THEN 0 ELSE 1 END AS fresh FROM locs))"""
LINKED = ", " + ISLANDS.format(gap=4) + """, linked AS (SELECT "group", CAST(event AS BIGINT) AS event, min(frame) AS frame, max(frame) - min(frame) + 1 AS len, count(*) AS n,
  sum(x / (lpx * lpx)) / sum(1 / (lpx * lpx)) AS x, sqrt(1 / sum(1 / (lpx * lpx))) AS lpx, sum(photons) AS photons FROM ev GROUP BY ALL)"""


@query(LINKED + ' SELECT "group", event, frame, len, n, round(x, 6) AS x, round(lpx, 6) AS lpx, round(photons / n, 6) AS photon_rate FROM linked')
def link_events(spark, d):
    return tidy(E.link_events(A.locs(spark, d)).select("group", "event", "frame", "len", "n", "x", "lpx", "photon_rate"))


@query(LINKED + ', dark AS (SELECT *, frame - max(frame + len - 1) OVER (PARTITION BY "group" ORDER BY frame, event ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dark FROM linked) SELECT "group", event, frame, len, dark FROM dark WHERE dark > 0')
def dark_times(spark, d):
    return E.dark_times(E.link_events(A.locs(spark, d))).select("group", "event", "frame", "len", "dark")


@query(LINKED + ', dark AS (SELECT *, frame - max(frame + len - 1) OVER (PARTITION BY "group" ORDER BY frame, event ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dark FROM linked) SELECT "group", count(*) AS n_events, round(avg(len), 6) AS len_mean, round(stddev_samp(len), 6) AS len_std, round(avg(dark), 6) AS dark_mean, round(stddev_samp(dark), 6) AS dark_std, round(1 / avg(dark), 6) AS qpaint_idx FROM dark WHERE dark > 0 GROUP BY "group"')
def group_properties(spark, d):
    rows = E.dark_times(E.link_events(A.locs(spark, d))).select("group", "len", "dark")
    return tidy(E.group_properties(rows))


@query(LINKED + ", " + 'edge AS (SELECT * FROM linked WHERE frame > 0 AND frame + len - 1 < 4320) SELECT count(*) AS events, CAST(sum(len) AS BIGINT) AS len, CAST(sum(n) AS BIGINT) AS n FROM edge')
def link_censored(spark, d):
    found = E.link_events(A.locs(spark, d), frames=A.FRAMES)
    return found.agg(F.count("*").alias("events"), F.sum("len").alias("len"), F.sum("n").alias("n"))


@query(", " + ISLANDS.format(gap=3) + ' SELECT "group", round(avg(frame), 6) AS frame, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(stddev_samp(x) / sqrt(count(*)), 6) AS lpx, round(sum(z / ((lpx + lpy) * (lpx + lpy))) / sum(1 / ((lpx + lpy) * (lpx + lpy))), 6) AS z, count(*) AS n_locs, CAST(max(event) AS BIGINT) AS n_events, round(4.18879::DOUBLE * pow(2::DOUBLE / 3 * (stddev_samp(x) + stddev_samp(y) + stddev_samp(z) / 130), 3), 3) AS volume FROM ev GROUP BY "group"')
def cluster_centers(spark, d):
    found = E.cluster_centers(A.locs(spark, d), A.PIXELSIZE)
    return tidy(found.select("group", "frame", "x", "y", "lpx", "z", "n_locs", "n_events", F.round("volume", 3).alias("volume")))


@query("SELECT a.loc_id, count(*) AS density FROM locs a JOIN locs b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 9 GROUP BY a.loc_id")
def local_density(spark, d):
    return S.local_density(A.locs(spark, d), 3.0)


@query("SELECT CAST(floor(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 0.5::DOUBLE) AS BIGINT) AS bin, count(*) AS n FROM locs a JOIN locs b ON a.loc_id < b.loc_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 9 GROUP BY 1")
def distance_histogram(spark, d):
    return S.distance_histogram(A.locs(spark, d), 0.5, 3.0)


@query(", h AS (SELECT CAST(floor(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 0.5::DOUBLE) AS BIGINT) AS bin, count(*) AS n FROM locs a JOIN locs b ON a.loc_id < b.loc_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 9 GROUP BY 1) SELECT bin, (bin + 1) * 0.5::DOUBLE AS r, round(n / (pi() * 0.25::DOUBLE * ((bin + 2) * (bin + 2) - (bin + 1) * (bin + 1))), 6) AS g FROM h")
def pair_correlation(spark, d):
    return tidy(S.pair_correlation(A.locs(spark, d), 0.5, 3.0))


@query('SELECT CAST(floor(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 2::DOUBLE) AS BIGINT) AS bin, count(*) AS n FROM locs a JOIN locs b ON a."group" = b."group" AND a.frame + 1 = b.frame AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 3600 GROUP BY 1')
def next_frame_distances(spark, d):
    return S.next_frame_distances(A.locs(spark, d), 2.0, 60.0)


@query("SELECT loc_id, CAST(rank AS BIGINT) AS rank, u.neighbour, round(u.d, 6) AS d FROM (SELECT loc_id, unnest(best) AS u, generate_subscripts(best, 1) AS rank FROM (SELECT a.loc_id, min({'d': sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 'neighbour': b.loc_id}, 3) AS best FROM locs a JOIN locs b ON a.loc_id <> b.loc_id GROUP BY a.loc_id))")
def nearest_neighbours(spark, d):
    rows = A.locs(spark, d)
    return tidy(S.nearest_neighbours(rows, rows, 3, 1.0, same=True))


@query("SELECT pick_id, loc_id FROM locs l JOIN picks p ON (l.x - p.x) * (l.x - p.x) + (l.y - p.y) * (l.y - p.y) < 100")
def picked_circles(spark, d):
    return S.picked_circles(A.locs(spark, d), A.picks(spark, d), 10.0).select("pick_id", "loc_id")


@query("SELECT pick_id, loc_id FROM locs l JOIN picks p ON abs(l.x - p.x) < 6 AND abs(l.y - p.y) < 6")
def picked_squares(spark, d):
    return S.picked_squares(A.locs(spark, d), A.picks(spark, d), 12.0).select("pick_id", "loc_id")


@query("SELECT loc_id, frame FROM locs l WHERE NOT EXISTS (SELECT 1 FROM picks p WHERE (l.x - p.x) * (l.x - p.x) + (l.y - p.y) * (l.y - p.y) < 100)")
def remove_picked(spark, d):
    return S.remove_picked(A.locs(spark, d), A.picks(spark, d), 10.0).select("loc_id", "frame")


@query("SELECT pick_id, count(*) AS n, round(sqrt(var_pop(l.x) + var_pop(l.y)) * 130, 6) AS rmsd FROM locs l JOIN picks p ON (l.x - p.x) * (l.x - p.x) + (l.y - p.y) * (l.y - p.y) < 100 GROUP BY pick_id")
def pick_statistics(spark, d):
    return tidy(E.pick_statistics(S.picked_circles(A.locs(spark, d), A.picks(spark, d), 10.0), A.PIXELSIZE))


@query("SELECT loc_id, x, round(along, 6) AS along, round(across, 6) AS across FROM (SELECT loc_id, x, (x - 50) * 0.8::DOUBLE + (y - 10) * 0.6::DOUBLE AS along, (y - 10) * 0.8::DOUBLE - (x - 50) * 0.6::DOUBLE AS across FROM locs) l WHERE along > 0 AND along < 100 AND abs(across) < 10")
def picked_rectangle(spark, d):
    inside, along, across = X.in_rectangle(F.col("x"), F.col("y"), 50.0, 10.0, 130.0, 70.0, 20.0)
    return tidy(A.locs(spark, d).where(inside).select("loc_id", "x", along.alias("along"), across.alias("across")))


@query("SELECT loc_id FROM locs WHERE y < 80 AND y >= 10 AND x < 100 + 3 * (80 - y) AND x >= 100")
def picked_polygon(spark, d):
    inside = X.in_polygon(F.col("x"), F.col("y"), [100.0, 310.0, 100.0, 100.0], [10.0, 10.0, 80.0, 10.0])
    return A.locs(spark, d).where(inside).select("loc_id")


@query("SELECT loc_id FROM locs WHERE x >= 0 AND y >= 0 AND x < 300 AND y < 64 AND isfinite(x) AND isfinite(y)")
def ensure_sanity(spark, d):
    return T.ensure_sanity(A.locs(spark, d), 300.0, 64.0).select("loc_id")


@query("SELECT loc_id, photons FROM locs WHERE photons > 500 AND photons < 2500")
def filter_range(spark, d):
    return T.in_range(A.locs(spark, d), "photons", 500.0, 2500.0).select("loc_id", "photons")


@query('SELECT loc_id FROM locs WHERE channel = \'click\' AND "group" IN (SELECT "group" FROM locs WHERE channel = \'view\')')
def sync_groups(spark, d):
    rows = A.locs(spark, d)
    return T.sync_groups([rows.where("channel = 'click'"), rows.where("channel = 'view'")])[0].select("loc_id")


@query(', m AS (SELECT max(frame) AS f, max("group") AS g FROM locs WHERE channel = \'click\') SELECT loc_id, frame, "group" FROM locs WHERE channel = \'click\' UNION ALL SELECT loc_id, frame + m.f, "group" + m.g FROM locs, m WHERE channel = \'view\'')
def merge_locs(spark, d):
    rows = A.locs(spark, d)
    return T.merge_locs([rows.where("channel = 'click'"), rows.where("channel = 'view'")]).select("loc_id", "frame", "group")


@query("SELECT loc_id, round(x - frame * 0.001::DOUBLE, 6) AS x, round(y + frame * 0.0005::DOUBLE, 6) AS y FROM locs")
def apply_drift(spark, d):
    return tidy(T.apply_drift(A.locs(spark, d), A.drift(spark, d), A.FRAMES).select("loc_id", "x", "y"))


PICKED = ", p AS (SELECT pick_id, frame, channel, l.x, l.y FROM locs l JOIN picks p ON (l.x - p.x) * (l.x - p.x) + (l.y - p.y) * (l.y - p.y) < 100)"


@query(PICKED + ", c AS (SELECT frame, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, 1 / nullif(var_pop(x) OVER w, 0) AS wx, 1 / nullif(var_pop(y) OVER w, 0) AS wy FROM p WINDOW w AS (PARTITION BY pick_id)) SELECT frame, round(sum(x * wx) / sum(wx), 6) AS dx, round(sum(y * wy) / sum(wy), 6) AS dy FROM c WHERE wx IS NOT NULL AND wy IS NOT NULL GROUP BY frame")
def fiducial_drift(spark, d):
    return tidy(T.fiducial_drift(S.picked_circles(A.locs(spark, d), A.picks(spark, d), 10.0)))


FILLED = """, q AS (SELECT pick_id, frame, loc_id, l.x, l.y, l.z FROM locs l JOIN picks p ON (l.x - p.x) * (l.x - p.x) + (l.y - p.y) * (l.y - p.y) < 100),
c AS (SELECT pick_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM q GROUP BY 1),
d AS (SELECT pick_id, frame, arg_max(x, loc_id) - any_value(mx) AS x, arg_max(y, loc_id) - any_value(my) AS y, arg_max(z, loc_id) - any_value(mz) AS z FROM q JOIN c USING (pick_id) GROUP BY 1, 2),
e AS (SELECT pick_id, x - avg(x) OVER f AS ex, y - avg(y) OVER f AS ey, z - avg(z) OVER f AS ez FROM d WINDOW f AS (PARTITION BY frame)),
w AS (SELECT pick_id, 1 / greatest(avg(ex * ex), 1e-30) AS wx, 1 / greatest(avg(ey * ey), 1e-30) AS wy, 1 / greatest(avg(ez * ez), 1e-30) AS wz FROM e GROUP BY 1),
v AS (SELECT frame, sum(x * wx) / sum(wx) AS dx, sum(y * wy) / sum(wy) AS dy, sum(z * wz) / sum(wz) AS dz FROM d JOIN w USING (pick_id) GROUP BY 1),
g AS (SELECT r.frame, max(v.frame) OVER (ORDER BY r.frame ROWS UNBOUNDED PRECEDING) AS f0, min(v.frame) OVER (ORDER BY r.frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f1 FROM range(4320) r(frame) LEFT JOIN v ON r.frame = v.frame)
SELECT g.frame, """ + ", ".join(f"round(coalesce(a.d{c} + (b.d{c} - a.d{c}) * (g.frame - f0) / nullif(f1 - f0, 0), a.d{c}, b.d{c}), 6) AS d{c}" for c in "xyz") + " FROM g LEFT JOIN v a ON a.frame = f0 LEFT JOIN v b ON b.frame = f1"


@query(FILLED)
def picked_drift(spark, d):
    return tidy(T.picked_drift(S.picked_circles(A.locs(spark, d), A.picks(spark, d), 10.0), A.FRAMES))


@query(PICKED + ", c AS (SELECT channel, pick_id, avg(x) AS x, avg(y) AS y FROM p GROUP BY ALL) SELECT a.channel AS a, b.channel AS b, round(avg(b.x - a.x), 6) AS dx, round(avg(b.y - a.y), 6) AS dy FROM c a JOIN c b ON a.pick_id = b.pick_id AND a.channel < b.channel GROUP BY ALL")
def channel_shifts(spark, d):
    return tidy(T.channel_shifts(S.picked_circles(A.locs(spark, d), A.picks(spark, d), 10.0)))


@query('SELECT loc_id, round(x - avg(x) OVER (PARTITION BY "group"), 9) AS x, round(y - avg(y) OVER (PARTITION BY "group"), 9) AS y FROM locs')
def center_groups(spark, d):
    return tidy(T.center_groups(A.locs(spark, d)).select("loc_id", "x", "y"), 9)


@query("SELECT CAST(floor(frame / (4319::DOUBLE / 10)) AS BIGINT) AS segment, count(*) AS n FROM locs WHERE floor(frame / (4319::DOUBLE / 10)) < 10 GROUP BY 1")
def segment(spark, d):
    return T.segment(A.locs(spark, d), A.FRAMES, 10).groupBy("segment").agg(F.count("*").alias("n"))


@query("SELECT CAST(floor(y * 2) AS BIGINT) AS iy, CAST(floor(x * 2) AS BIGINT) AS ix, count(*) AS value FROM locs WHERE x > 0 AND x < 512 AND y > 0 AND y < 128 GROUP BY 1, 2")
def render_histogram(spark, d):
    return T.render_histogram(A.locs(spark, d), 2.0, 0.0, 0.0, A.WIDTH, A.HEIGHT)


@query("SELECT CAST(floor(y) AS BIGINT) AS iy, CAST(floor(x) AS BIGINT) AS ix, CAST(floor(z / 130 - (-200::DOUBLE / 130)) AS BIGINT) AS iz, count(*) AS value FROM locs WHERE x > 0 AND x < 512 AND y > 0 AND y < 128 AND z > -200 AND z < 200 GROUP BY 1, 2, 3")
def render_histogram3d(spark, d):
    return T.render_histogram3d(A.locs(spark, d), 1.0, 0.0, 0.0, A.WIDTH, A.HEIGHT, -200.0, 200.0, A.PIXELSIZE)


@query("""SELECT iy, ix, round(sum(exp(-pow(ix + 0.5::DOUBLE - x, 2) / (2 * lpx * lpx) - pow(iy + 0.5::DOUBLE - y, 2) / (2 * lpy * lpy)) / (2 * pi() * lpx * lpy)), 6) AS value FROM (
SELECT *, unnest(range(greatest(CAST(trunc(x - 3 * lpx) AS BIGINT), 0), least(CAST(trunc(x + 3 * lpx + 1) AS BIGINT), 512))) AS ix FROM (
SELECT x, y, lpx, lpy, unnest(range(greatest(CAST(trunc(y - 3 * lpy) AS BIGINT), 0), least(CAST(trunc(y + 3 * lpy + 1) AS BIGINT), 128))) AS iy FROM locs WHERE x > 0 AND y > 0 AND x < 512 AND y < 128)) GROUP BY iy, ix""")
def render_gaussian(spark, d):
    return tidy(T.render_gaussian(A.locs(spark, d), 1.0, A.WIDTH, A.HEIGHT))


@query(", m AS (SELECT DISTINCT CAST(floor(y / 128 * 32) AS BIGINT) AS iy, CAST(floor(x / 512 * 128) AS BIGINT) AS ix FROM picks) SELECT loc_id FROM locs WHERE (CAST(floor(y / 128 * 32) AS BIGINT), CAST(floor(x / 512 * 128) AS BIGINT)) IN (SELECT (iy, ix) FROM m)")
def mask_locs(spark, d):
    mask = A.picks(spark, d).select(F.floor(F.col("y") / A.HEIGHT * 32).cast("long").alias("iy"), F.floor(F.col("x") / A.WIDTH * 128).cast("long").alias("ix")).distinct()
    return T.mask_locs(A.locs(spark, d), mask, A.WIDTH, A.HEIGHT, 128, 32)[0].select("loc_id")


@query("SELECT CAST(least(greatest(floor((photons - 100) / 150::DOUBLE), 0), 31) AS BIGINT) AS color, count(*) AS n FROM locs GROUP BY 1")
def split_by_property(spark, d):
    return T.split_by_property(A.locs(spark, d), "photons", 32, 100.0, 4900.0).groupBy("color").agg(F.count("*").alias("n"))


@query(", c AS (SELECT channel, frame, count(*) AS n FROM locs GROUP BY ALL) SELECT channel, frame, n, round(CASE WHEN count(*) OVER w = 10 THEN avg(n) OVER w END, 6) AS rolling FROM c WINDOW w AS (PARTITION BY channel ORDER BY frame ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def locs_per_frame(spark, d):
    return tidy(T.locs_per_frame(A.locs(spark, d), 10))


@query(", c AS (SELECT x, count(*) FILTER (channel = 'click') AS na, count(*) FILTER (channel = 'view') AS nb FROM locs WHERE channel IN ('click', 'view') GROUP BY x) SELECT round(max(d), 6) AS ks FROM (SELECT abs(sum(na) OVER o / sum(na) OVER () - sum(nb) OVER o / sum(nb) OVER ()) AS d FROM c WINDOW o AS (ORDER BY x))")
def ks_statistic(spark, d):
    return tidy(T.ks_statistic(A.locs(spark, d), "channel", "x", "click", "view"))


@query("SELECT loc_id, round(sqrt((sx * sx + 1::DOUBLE / 12) * (16::DOUBLE / 9 + 8 * pi() * sqrt((sx * sx + 1::DOUBLE / 12) * (sy * sy + 1::DOUBLE / 12)) * bg / photons) / photons), 6) AS lp FROM locs")
def localization_precision(spark, d):
    lp = X.localization_precision(F.col("photons"), F.col("sx"), F.col("sy"), F.col("bg"))
    return tidy(A.locs(spark, d).select("loc_id", lp.alias("lp")))


@query(", a AS (SELECT frame, arg_max(photons - bg, loc_id) AS a FROM locs WHERE channel = 'click' GROUP BY frame), d AS (SELECT frame, arg_max(photons - bg, loc_id) AS d FROM locs WHERE channel = 'view' GROUP BY frame), e AS (SELECT frame, coalesce(a, 0) / nullif(coalesce(a, 0) + coalesce(d, 0), 0) AS fret FROM a FULL JOIN d USING (frame)) SELECT frame, round(fret, 6) AS fret FROM e WHERE fret > 0 AND fret < 1")
def fret(spark, d):
    rows = A.locs(spark, d)
    return tidy(E.fret(rows.where("channel = 'click'"), rows.where("channel = 'view'")))


@query(', r AS (SELECT *, max(frame) OVER () + 1 AS frames FROM locs), b AS (SELECT "group", least(floor(frame * 20::DOUBLE / frames), 19) AS bin, count(*) AS n, sum(frame) AS s, any_value(frames) AS frames FROM r GROUP BY 1, 2), g AS (SELECT "group" FROM b GROUP BY "group" HAVING sum(s) / sum(n) BETWEEN 0.2::DOUBLE * any_value(frames) AND 0.8::DOUBLE * any_value(frames) AND max(n) <= 0.8::DOUBLE * sum(n)) SELECT "group", count(*) AS n FROM locs WHERE "group" IN (SELECT "group" FROM g) GROUP BY "group"')
def drop_uneven_clusters(spark, d):
    return E.drop_uneven_clusters(A.locs(spark, d)).groupBy("group").agg(F.count("*").alias("n"))
