"""Precisions of rows without photons, as floating point has them."""

import math

from pyspark.sql import functions as F

from spotlake.functions import expressions as X
from spotlake.operators import detection as D


def column(spark, expression):
    """Of three rows: with photons, with none, with unknown ones."""
    rows = spark.createDataFrame([(0, 1.0, 1.0, 500.0, 5.0), (1, 1.0, 1.0, 0.0, 5.0), (2, 1.0, 1.0, None, 5.0)], "loc_id long, sx double, sy double, photons double, bg double")
    return [r[0] for r in rows.orderBy("loc_id").select(expression(*[F.col(c) for c in ("sx", "sy", "photons", "bg")])).collect()]


def test_likelihood_width_of_rows_without_photons(spark):
    some, none, unknown = column(spark, lambda sx, sy, photons, bg: D.likelihood_width_uncertainty(sx, photons, bg))
    assert 0 < some < 1 and math.isnan(none) and unknown is None


def test_position_of_rows_without_photons(spark):
    some, none, unknown = column(spark, lambda sx, sy, photons, bg: X.localization_precision(photons, sx, sy, bg))
    assert 0 < some < 1 and none == math.inf and unknown is None


def test_width_of_rows_without_photons(spark):
    some, none, unknown = column(spark, lambda sx, sy, photons, bg: X.sigma_uncertainty(sx, sy, photons, bg))
    assert 0 < some < 1 and none == math.inf and unknown is None
