import math

import pytest
from pyspark.sql import functions as F

from spotlake.sources import files

LOCS = "loc_id long, frame long, x double, y double, z double, photons double, sx double, sy double, bg double, lpx double, lpy double"
ROWS = [(0, 3, 1.5, 2.25, -40.0, 700.9, 1.1, 1.2, 5.5, 0.1, 0.2), (1, 5, 7.125, 0.5, 12.5, 80.0, 0.9, 1.0, 3.0, 0.3, 0.1)]


def whole(spark, path):
    return "".join(r.value for r in spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("f")).orderBy("f").collect())


def test_lines_and_header(spark, tmp_path):
    locs = spark.createDataFrame(ROWS, LOCS).coalesce(1)
    files.write_lines(locs, files.imagej_line(), f"{tmp_path}/a")
    assert whole(spark, f"{tmp_path}/a") == "3   1.50000   2.25000\r\n5   7.12500   0.50000\r\n"
    files.write_lines(locs, files.chimera_line(100.0), f"{tmp_path}/b", files.CHIMERA_HEADER)
    assert whole(spark, f"{tmp_path}/b") == "Molecule export\r\n1\t150.00000\t225.00000\t-40.00000\r\n1\t712.50000\t50.00000\t12.50000\r\n"
    files.write_lines(locs.where("false"), files.visp_line(100.0), f"{tmp_path}/c", "head")
    assert whole(spark, f"{tmp_path}/c") == "head\r\n"


@pytest.mark.parametrize("solid", [True, False])
def test_thunderstorm_round_trip(spark, tmp_path, solid):
    locs = spark.createDataFrame(ROWS, LOCS)
    files.write_thunderstorm(locs if solid else locs.drop("z"), f"{tmp_path}/ts", 100.0)
    back = files.read_thunderstorm(spark, f"{tmp_path}/ts", 100.0).orderBy("frame").collect()
    assert [r.frame for r in back] == [0, 2] and [r.photons for r in back] == [700.0, 80.0] and [r.bg for r in back] == [5.0, 3.0]
    assert all(math.isclose(r.x, w[2]) and math.isclose(r.lpx, (w[9] + w[10]) / 2) and math.isclose(r.sy, w[7] if solid else w[6]) for r, w in zip(back, ROWS, strict=True))
    assert ("z" in back[0].asDict()) == solid
    spark.createDataFrame([(1, 2.0)], "frame long, other double").write.csv(f"{tmp_path}/bad", header=True)
    with pytest.raises(ValueError, match="missing"):
        files.read_thunderstorm(spark, f"{tmp_path}/bad", 100.0)


def test_drift_round_trip(spark, tmp_path):
    rows = [(f, f * 0.1 + 1 / 3, -f * 0.2) for f in range(12)]
    files.write_drift(spark.createDataFrame(rows[::-1], "frame long, dx double, dy double").repartition(3), f"{tmp_path}/d")
    assert sorted(map(tuple, files.read_drift(spark, f"{tmp_path}/d").collect())) == rows
    spark.createDataFrame([("1 2 3 4",)], "value string").write.text(f"{tmp_path}/e")
    with pytest.raises(ValueError, match="columns"):
        files.read_drift(spark, f"{tmp_path}/e")


def test_picks_of_all_shapes(spark):
    table, shape, size = files.picks_table(spark, {"Shape": "Circle", "Centers": [[1, 2], [3, 4]], "Diameter (nm)": 260}, 130.0)
    assert (shape, size) == ("circle", 2.0) and sorted(map(tuple, table.collect())) == [(0, 1.0, 2.0), (1, 3.0, 4.0)]
    assert files.picks_table(spark, {"Centers": [[1, 2]], "Diameter": 3})[1:] == ("circle", 3)
    table, _, size = files.picks_table(spark, {"Shape": "Rectangle", "Center-Axis-Points": [[[1, 2], [3, 4]]], "Width": 5})
    assert size == 5 and tuple(table.first()) == (0, 1.0, 2.0, 3.0, 4.0)
    table, _, size = files.picks_table(spark, {"Shape": "Polygon", "Vertices": [[[1, 2], [3, 4], [5, 6]]]})
    assert size is None and table.first().ys == [2.0, 4.0, 6.0]
    with pytest.raises(ValueError, match="picks"):
        files.picks_table(spark, {"Other": 1})
