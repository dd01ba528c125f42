from spotlake.streaming import live


def test_windows_of_arriving_files(spark, tmp_path):
    schema = "frame long, photons double, lpx double, lpy double"
    for k, frames in enumerate(([0, 5, 9, 10], [11, 12, None, 29], [95])):
        spark.createDataFrame([(f, 10.0 + k, 0.1, 0.2) for f in frames], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    rows = live.watch(spark, f"{tmp_path}/in/*", schema)
    assert "file" in rows.columns and rows.isStreaming
    out = live.quality_by_time(rows, 1.0, 10, 20)
    stream = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    got = {r.start: (r.n, r.photons) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {0: (3, 10.0), 10: (3, (10 + 11 + 11) / 3), 20: (1, 11.0)}
