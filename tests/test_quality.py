import numpy as np
import pytest
from pyspark.sql import functions as F

from spotlake.operators import clustering as C
from spotlake.operators import quality as Q
from spotlake.operators import registration as R
from spotlake.streaming import live

SCHEMA = "file string, loc_id long, frame long, x double, y double, photons double, lpx double, lpy double"
FRAMES = 200


def blinking(name: str, seed: int, first: int, moved: float):
    """Emitters that stay on for 2 to 5 frames, seen with a precision of 0.02 pixels, under a linear drift."""
    rng = np.random.default_rng(seed)
    rows = []
    for cx, cy in rng.uniform(5, 60, (60, 2)):
        at = int(rng.integers(0, 12))
        while at < FRAMES:
            for f in range(at, min(FRAMES, at + int(rng.integers(2, 6)))):
                x, y = rng.normal((cx + moved * f / FRAMES, cy - 0.5 * moved * f / FRAMES), 0.02)
                rows.append((name, first + len(rows), f, float(x), float(y), float(rng.uniform(100, 900)), 0.02, 0.02))
            at += int(rng.integers(12, 25))
    return rows


@pytest.fixture(scope="module")
def files():
    return {"a": blinking("a", 1, 0, 3.0), "b": blinking("b", 2, 100_000, 0.0)}


def test_summaries_equal_those_of_each_file_alone(spark, files):
    odd = [(None, 900_000, 3, 1.0, 1.0, 1.0, 0.1, 0.1), ("c", 900_001, 7, 2.0, None, 5.0, None, None), ("c", 900_002, None, 2.0, 2.0, None, None, 0.1), ("d", 900_003, 5, 1.0, 1.0, 7.0, 0.1, 0.1)]
    locs = spark.createDataFrame(files["a"] + files["b"] + odd, SCHEMA).withColumns({"group": F.lit("another"), "frames": F.lit(-1), "lp": F.lit("x")})
    movies = spark.createDataFrame([("a", FRAMES, 130.0), ("a", 10, 7.0), ("b", FRAMES, 100.0), ("unseen", 5, 1.0)], "file string, frames long, pixelsize double")
    got = {r["file"]: r for r in Q.file_summaries(locs, movies, r=0.2).collect()}
    assert sorted(got) == ["a", "b", "c", "d"]
    for name, size in (("a", 130.0), ("b", 100.0)):
        own, r = spark.createDataFrame(files[name], SCHEMA).withColumn("group", F.lit(0)), got[name]
        photons = np.array([row[5] for row in files[name]])
        assert (r["n_locs"], r["frames"], r["pixelsize"], r["locs_frame"]) == (len(photons), FRAMES, size, len(photons) / FRAMES)
        assert r["photons_mean"] == pytest.approx(photons.mean()) and r["photons_std"] == pytest.approx(photons.std(ddof=1)) and r["sx_mean"] is None
        assert r["len_mean"] == pytest.approx(C.link(own, 0.2, 3, FRAMES).agg(F.avg("len")).first()[0]) and 2 <= r["len_mean"] <= 5
        assert r["nena_px"] == pytest.approx(C.nena(own)["s"], rel=1e-3) and r["nena_px"] == pytest.approx(0.02, rel=0.25)
        assert r["nena_nm"] == pytest.approx(r["nena_px"] * size)
        drift = R.correlation_drift(own, FRAMES, FRAMES // 10).agg(F.avg("dx"), F.avg("dy")).first()
        assert (r["drift_x"], r["drift_y"]) == pytest.approx(tuple(drift), abs=1e-9)
    assert got["a"]["drift_x"] == pytest.approx(1.35, abs=0.4) and abs(got["b"]["drift_x"]) < 0.3
    assert (got["c"]["n_locs"], got["c"]["frames"], got["c"]["photons_mean"], got["c"]["len_mean"], got["c"]["nena_nm"]) == (2, 8, 5.0, None, None)
    assert (got["d"]["n_locs"], got["d"]["frames"], got["d"]["nena_px"], got["d"]["drift_x"]) == (1, 6, None, 0.0)
    assert Q.file_summaries(locs.where("false"), movies).count() == 0


def test_table_follows_files_and_replays_change_nothing(spark, files, tmp_path):
    columns = "frame long, x double, y double, photons double, lpx double, lpy double"
    describe = lambda session: session.createDataFrame([], "file string, frames long, pixelsize double")

    def arrive(name):
        rows = [r[2:] for r in files[name]]
        spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def follow():
        stream = live.follow_quality(live.watch(spark, f"{tmp_path}/in/*", columns), describe, f"{tmp_path}/table", r=0.2)
        stream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return {r["file"]: r for r in live.quality_table(spark, f"{tmp_path}/table").collect()}

    arrive("a")
    once = follow()
    assert len(once) == 1 and follow() == once
    arrive("b")
    both = follow()  # a restart from the checkpoint: only the new file is read
    assert len(both) == 2 and once.items() <= both.items()
    assert sorted(r["n_locs"] for r in both.values()) == sorted(len(v) for v in files.values())
    (first,) = once
    batch = spark.read.schema(columns).parquet(f"{tmp_path}/in/a").withColumn("file", F.lit(first))
    live.record_quality(batch, 0, f"{tmp_path}/table", describe(spark), r=0.2)  # the first batch again
    replayed = {r["file"]: r for r in live.quality_table(spark, f"{tmp_path}/table").collect()}
    assert replayed == both
    live.record_quality(batch.limit(5), 7, f"{tmp_path}/table", describe(spark))  # the file again, later
    assert {r["file"]: r["n_locs"] for r in live.quality_table(spark, f"{tmp_path}/table").collect()}[first] == 5
    live.record_quality(batch.where("false"), 8, f"{tmp_path}/table", describe(spark))
    assert live.quality_table(spark, f"{tmp_path}/table").count() == 2
