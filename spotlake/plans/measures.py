"""Registered queries of clusters, images, statistics and exports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import events as E
from ..operators import graphs as G
from ..operators import images as I
from ..operators import quality as Q
from ..operators import spatial as S
from ..operators import statistics as M
from ..operators import tables as T
from ..sources import adapters as A
from ..sources import exports as O
from .catalogue import query, tidy

WIDE, HIGH = int(A.WIDTH), int(A.HEIGHT)
IMAGE = ", image AS (SELECT CAST(floor(y) AS BIGINT) AS iy, CAST(floor(x) AS BIGINT) AS ix, count(*) AS value FROM locs WHERE x > 0 AND x < 512 AND y > 0 AND y < 128 GROUP BY 1, 2)"
CLUSTERS = ', clusters AS (SELECT "group", channel AS cluster, avg(frame) AS frame, sum(x * photons) / sum(photons) AS x, sum(y * photons) / sum(photons) AS y, stddev_pop(x) / sqrt(count(*)) AS lpx, stddev_pop(y) / sqrt(count(*)) AS lpy, count(*) AS n FROM locs GROUP BY ALL)'
GREY = IMAGE + ", top AS (SELECT CAST(max(value) AS DOUBLE) AS m, 512 * 128 - count(*) AS rest FROM image), grey AS (SELECT bin, CAST(sum(n) AS BIGINT) AS n, (bin + 0.5::DOUBLE) * any_value(m) / 256 AS center FROM (SELECT CAST(least(floor(value / (m / 256)), 255) AS BIGINT) AS bin, count(*) AS n, any_value(m) AS m FROM image, top GROUP BY 1 UNION ALL SELECT 0, rest, m FROM top) GROUP BY bin)"


def image(spark, d):
    return T.render_histogram(A.locs(spark, d), 1.0, 0.0, 0.0, A.WIDTH, A.HEIGHT)


def clusters(spark, d):
    return M.combine_clusters(A.locs(spark, d).withColumnRenamed("channel", "cluster"))


def density_sql(r: float, samples: int, least: int, stretch: float | None = None) -> str:
    """Density clusters: the smallest core that each core reaches, then rows near a core."""
    deep = "" if stretch is None else f" + ((p.z - q.z) * {stretch}::DOUBLE) * ((p.z - q.z) * {stretch}::DOUBLE)"
    return f""", p AS (SELECT loc_id, x, y, z, floor(x / {r}::DOUBLE) AS cx, floor(y / {r}::DOUBLE) AS cy FROM locs),
  q AS (SELECT loc_id, x, y, z, cx + i AS cx, cy + j AS cy FROM p, (VALUES (-1), (0), (1)) s(i), (VALUES (-1), (0), (1)) t(j)),
  near AS MATERIALIZED (SELECT p.loc_id AS i, q.loc_id AS j FROM p JOIN q USING (cx, cy) WHERE (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y){deep} <= {r}::DOUBLE * {r}::DOUBLE),
  cores AS MATERIALIZED (SELECT i FROM near GROUP BY i HAVING count(*) >= {samples}),
  edges AS MATERIALIZED (SELECT i, j FROM near WHERE i IN (SELECT i FROM cores) AND j IN (SELECT i FROM cores)),
  roots AS MATERIALIZED (SELECT i, min(c) AS c FROM (WITH RECURSIVE w AS (SELECT i, i AS c FROM cores UNION SELECT e.j, w.c FROM w JOIN edges e ON e.i = w.i WHERE w.c < e.j) SELECT i, c FROM w) GROUP BY i),
  found AS (SELECT i AS loc_id, c AS cluster FROM roots UNION ALL SELECT near.i, min(c) FROM near JOIN roots ON roots.i = near.j WHERE near.i NOT IN (SELECT i FROM cores) GROUP BY near.i)
  SELECT loc_id, cluster FROM found QUALIFY count(*) OVER (PARTITION BY cluster) >= {least}"""


@query(density_sql(0.6, 4, 5))
def dbscan(spark, d):
    return G.dbscan(A.locs(spark, d), 0.6, 4, min_locs=5).select("loc_id", "cluster")


@query(density_sql(1.5, 4, 5, 1.5 / 150))
def dbscan_3d(spark, d):
    return G.dbscan(A.locs(spark, d), 1.5, 4, min_locs=5, r_z=150.0).select("loc_id", "cluster")


SPACE = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + ((a.z - b.z) * {s}::DOUBLE) * ((a.z - b.z) * {s}::DOUBLE))".format(s=1 / A.PIXELSIZE)


@query(f"SELECT loc_id, CAST(rank AS BIGINT) AS rank, u.neighbour, round(u.d, 6) AS d FROM (SELECT loc_id, unnest(best) AS u, generate_subscripts(best, 1) AS rank FROM (SELECT a.loc_id, min({{'d': {SPACE}, 'neighbour': b.loc_id}}, 2) AS best FROM locs a JOIN locs b ON a.loc_id <> b.loc_id GROUP BY a.loc_id))")
def nearest_neighbours_3d(spark, d):
    rows = A.locs(spark, d)
    return tidy(S.nearest_neighbours(rows, rows, 2, 2.0, same=True, stretch=1 / A.PIXELSIZE))


@query()
def link_near(spark, d):
    return G.link_near(A.locs(spark, d), 20.0, 36).select("loc_id", "event")


@query()
def kinetic_rates(spark, d):
    steps = G.checkpointed(E.dark_times(E.link_events(A.locs(spark, d))).select("group", "len", "dark"))
    bright, dark = (M.kinetic_rates(steps, "group", c).withColumnRenamed("rate", f"{c}_cdf") for c in ("len", "dark"))
    both = bright.join(dark.withColumnRenamed("group", "_group"), F.expr("`group` <=> _group")).drop("_group")
    return tidy(both.withColumn("qpaint_idx_cdf", 1 / F.col("dark_cdf")))


@query(CLUSTERS + ' SELECT "group", cluster, round(frame, 6) AS frame, round(x, 6) AS x, round(y, 6) AS y, round(lpx, 6) AS lpx, round(lpy, 6) AS lpy, n FROM clusters')
def combine_clusters(spark, d):
    return tidy(clusters(spark, d))


@query(CLUSTERS + ' SELECT a."group", a.cluster, round(min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 6) AS d FROM clusters a LEFT JOIN clusters b ON a."group" = b."group" AND a.cluster <> b.cluster GROUP BY ALL')
def min_distance(spark, d):
    return tidy(G.min_distance(clusters(spark, d), 40.0))


@query(', s AS (SELECT "group", frame // 48 AS frame, count(*) AS n FROM locs GROUP BY ALL), w AS (SELECT *, lag(n) OVER o AS a, lead(n) OVER o AS b FROM s WINDOW o AS (PARTITION BY "group" ORDER BY frame)) SELECT "group", frame, n FROM w WHERE a > n AND n < b')
def local_minima(spark, d):
    series = A.locs(spark, d).groupBy("group", F.expr("frame div 48").alias("frame")).agg(F.count("*").alias("n"))
    return G.local_minima(series, "group", "frame", "n")


@query("SELECT pick_id FROM picks p WHERE NOT EXISTS (SELECT 1 FROM locs l WHERE channel = 'purchase' AND (l.x - p.x) * (l.x - p.x) + (l.y - p.y) * (l.y - p.y) < 0.25::DOUBLE)")
def subtract_picks(spark, d):
    return S.subtract_picks(A.picks(spark, d), A.locs(spark, d).where("channel = 'purchase'"), 1.0).select("pick_id")


@query("SELECT CAST(least(floor((y - 0) / 4::DOUBLE), 24) AS BIGINT) AS iy, CAST(least(floor((x - 10) / 2::DOUBLE), 199) AS BIGINT) AS ix, count(*) AS value FROM locs WHERE x BETWEEN 10 AND 410 AND y BETWEEN 0 AND 100 GROUP BY 1, 2")
def histogram2d(spark, d):
    return S.histogram2d(A.locs(spark, d), F.col("x"), F.col("y"), 10.0, 410.0, 0.0, 100.0, 200, 25)


@query(IMAGE + " SELECT CAST(floor(sqrt((iy - 64) * (iy - 64) + (ix - 256) * (ix - 256))) AS BIGINT) AS ring, CAST(sum(value) AS BIGINT) AS value FROM image GROUP BY 1")
def radial_sum(spark, d):
    return I.radial_sum(image(spark, d), 64, 256)


@query(IMAGE + ", k AS (SELECT i, exp(-i * i / 2::DOUBLE) / (SELECT sum(exp(-j * j / 2::DOUBLE)) FROM range(-4, 5) t(j)) AS w FROM range(-4, 5) t(i)) SELECT iy + a.i AS iy, ix + b.i AS ix, round(sum(value * a.w * b.w), 6) AS value FROM image, k a, k b WHERE iy + a.i BETWEEN 0 AND 127 AND ix + b.i BETWEEN 0 AND 511 GROUP BY 1, 2")
def render_smooth(spark, d):
    return tidy(I.blur(image(spark, d), 1.0, HIGH, WIDE))


@query(IMAGE + " SELECT iy, ix, round(least(greatest(value / (SELECT max(value) / 2 FROM image), 0), 1), 6) AS value FROM image")
def scale_contrast(spark, d):
    return tidy(I.scale_contrast(image(spark, d)))


@query(IMAGE + " SELECT iy, ix, CAST(floor(value / (SELECT max(value) FROM image) * 255 + 0.5::DOUBLE) AS BIGINT) AS value FROM image")
def to_8bit(spark, d):
    return I.to_8bit(image(spark, d))


@query(GREY + ", v AS (SELECT center, sum(n) OVER b * sum(n) OVER a * pow(sum(n * center) OVER b / sum(n) OVER b - sum(n * center) OVER a / sum(n) OVER a, 2) AS v FROM grey WINDOW b AS (ORDER BY bin ROWS UNBOUNDED PRECEDING), a AS (ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) SELECT round(arg_max(center, v), 6) AS threshold FROM v WHERE v IS NOT NULL")
def threshold_otsu(spark, d):
    return tidy(I.threshold_otsu(image(spark, d), WIDE * HIGH))


@query(IMAGE + ", t AS (SELECT sum(value) / (512 * 128) AS threshold FROM image) SELECT iy, ix FROM image, t WHERE value > threshold")
def mask_above_mean(spark, d):
    rows = image(spark, d)
    return I.mask_above(rows, I.threshold_mean(rows, WIDE * HIGH))


@query(", f AS (SELECT CAST(floor(y) AS BIGINT) AS iy, CAST(floor(x) AS BIGINT) AS ix, frame < 2160 AS early, count(*) AS value FROM locs WHERE x > 0 AND x < 512 AND y > 0 AND y < 128 GROUP BY ALL) SELECT sy, sx, CAST(sum(least(a.value, b.value)) AS BIGINT) AS n FROM (SELECT CAST(t.i AS BIGINT) AS sy FROM range(-3, 4) t(i)), (SELECT CAST(t.i AS BIGINT) AS sx FROM range(-3, 4) t(i)), f a, f b WHERE a.early AND NOT b.early AND a.iy = b.iy + sy AND a.ix = b.ix + sx GROUP BY sy, sx")
def shifted_overlap(spark, d):
    rows = A.locs(spark, d)
    parts = [T.render_histogram(rows.where(w), 1.0, 0.0, 0.0, A.WIDTH, A.HEIGHT) for w in ("frame < 2160", "frame >= 2160")]
    return I.shifted_overlap(*parts, 3).select(F.col("sy").cast("long").alias("sy"), F.col("sx").cast("long").alias("sx"), "n")


@query("SELECT n, low, high, round(width, 6) AS width, CAST(least(greatest(ceil((high - low) / width), 1), 1000) AS BIGINT) AS bins FROM (SELECT *, 2 * iqr * pow(n, -1::DOUBLE / 3) AS width FROM (SELECT count(*) AS n, min(x) AS low, max(x) AS high, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM locs))")
def optimal_bins(spark, d):
    return tidy(M.optimal_bins(A.locs(spark, d), "x"))


@query(", p AS (SELECT channel, frame, count(*) AS n FROM locs GROUP BY ALL), q AS (SELECT channel, avg(n) AS locs_per_frame FROM p GROUP BY channel) SELECT channel, count(*) AS n_locs, round(avg(x), 6) AS x_mean, round(stddev_pop(x), 6) AS x_std, round(avg(photons), 6) AS photons_mean, round(stddev_pop(photons), 6) AS photons_std, round(any_value(locs_per_frame), 6) AS locs_per_frame FROM locs JOIN q USING (channel) GROUP BY channel")
def summary(spark, d):
    return tidy(M.summary(A.locs(spark, d), ["x", "photons"], "channel"))


MEAN_SQL = ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_std" if c not in ("ellipticity", "d_zcalib") else f"NULL::DOUBLE AS {c}_mean, NULL::DOUBLE AS {c}_std" for c in Q.MEANS)


@query(f"SELECT channel AS file, count(*) AS n_locs, max(frame) AS last_frame, {MEAN_SQL} FROM locs GROUP BY 1")
def file_means(spark, d):
    return tidy(Q.file_means(A.locs(spark, d).withColumnRenamed("channel", "file")))


@query()
def file_summaries(spark, d):
    rows = A.locs(spark, d).withColumnRenamed("channel", "file")
    movies = rows.select("file").distinct().withColumn("frames", F.lit(A.FRAMES)).withColumn("pixelsize", F.lit(A.PIXELSIZE))
    return tidy(Q.file_summaries(rows, movies, r=2.0, max_dark_time=36, bin_size=0.1, d_max=10.0), 3)


@query("SELECT channel, CAST(least(floor((photons - 100) / 90::DOUBLE), 49) AS BIGINT) AS bin, count(*) AS n FROM locs WHERE photons BETWEEN 100 AND 4600 GROUP BY 1, 2")
def common_histogram(spark, d):
    return M.common_histogram(A.locs(spark, d), "channel", "photons", 50, 100.0, 4600.0)


@query("SELECT loc_id FROM locs WHERE bg <= 1.2::DOUBLE * (SELECT sqrt(avg(bg * bg)) FROM locs)")
def filter_z_fits(spark, d):
    return M.filter_z_fits(A.locs(spark, d), "bg", 1.2).select("loc_id")


@query('SELECT loc_id AS id, frame, round(x * 130, 6) AS "x [nm]", round(y * 130, 6) AS "y [nm]", round(sx * 130, 6) AS "sigma1 [nm]", round(sy * 130, 6) AS "sigma2 [nm]", round(photons, 6) AS "intensity [photon]", bg AS "offset [photon]", round((lpx + lpy) / 2 * 130, 6) AS "uncertainty_xy [nm]", z AS "z [nm]" FROM locs')
def export_thunderstorm(spark, d):
    rows = O.to_thunderstorm(A.locs(spark, d), A.PIXELSIZE)
    return rows.select(*[F.round(F.col(f"`{c}`"), 6).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in rows.dtypes])


@query("SELECT loc_id AS id, frame - (SELECT min(frame) FROM locs) AS frame, round(x, 6) AS x, round(y, 6) AS y, round(photons, 6) AS photons, round(sx, 6) AS sx, round(sy, 6) AS sy, bg, round((lpx + lpy) / 2, 6) AS lpx, round((lpx + lpy) / 2, 6) AS lpy FROM locs")
def import_thunderstorm(spark, d):
    return tidy(O.from_thunderstorm(O.to_thunderstorm(A.locs(spark, d), A.PIXELSIZE), A.PIXELSIZE))


@query("SELECT CAST(1 AS BIGINT) AS Channel, round(x * 130, 6) AS X, round(y * 130, 6) AS Y, CAST(1 AS BIGINT) AS Length, CAST(round_even(bg, 0) AS BIGINT) AS BG, CAST(round_even(photons, 0) AS BIGINT) AS Area, frame + 1 AS Frame FROM locs")
def export_nis(spark, d):
    return tidy(O.to_nis(A.locs(spark, d), A.PIXELSIZE))


@query("SELECT round(x * 130, 6) AS x, round(y * 130, 6) AS y, z, round(photons, 6) AS photons, frame FROM locs")
def export_visp(spark, d):
    return tidy(O.to_visp(A.locs(spark, d), A.PIXELSIZE))


@query("SELECT loc_id, round(sqrt((sx2 * sx2 / photons * (512::DOUBLE / 81 + 64 * pi() / 3 * sqrt(sx2 * sy2) * bg / photons)) / (4 * sx * sx)), 6) AS se FROM (SELECT *, sx * sx + 1::DOUBLE / 12 AS sx2, sy * sy + 1::DOUBLE / 12 AS sy2 FROM locs)")
def sigma_uncertainty(spark, d):
    se = X.sigma_uncertainty(F.col("sx"), F.col("sy"), F.col("photons"), F.col("bg"))
    return tidy(A.locs(spark, d).select("loc_id", se.alias("se")))
