from terraloom.functions.raster import Grid
from terraloom.streaming.points import latest_cells, passes

SCHEMA = "x double, y double, v double, t timestamp"


def run(spark, tmp_path, build, mode):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = build(stream).writeStream.outputMode(mode).format("memory").queryName("out").option("checkpointLocation", str(tmp_path / mode)).start()
    try:
        q.processAllAvailable()
        return spark.table("out").collect()
    finally:
        q.stop()


def points(spark, tmp_path, rows):
    spark.createDataFrame(rows, "x double, y double, v double, t string").selectExpr("x", "y", "v", "cast(t as timestamp) as t").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_latest_cells(spark, tmp_path):
    points(spark, tmp_path, [(0.5, 0.5, 1.0, "2024-01-01 00:00:00"), (0.6, 0.6, 2.0, "2024-01-01 00:02:00"), (9.0, 9.0, 5.0, "2024-01-01 00:00:00"), (None, 1.0, 5.0, "2024-01-01 00:00:00")])
    points(spark, tmp_path, [(0.7, 0.7, 3.0, "2024-01-01 00:01:00"), (1.5, 1.5, 4.0, "2024-01-01 00:01:00")])
    got = {(r["row"], r["col"]): r["value"] for r in run(spark, tmp_path, lambda s: latest_cells(s, Grid.from_bounds(0, 0, 2, 2, 2, 2), "v", "t"), "complete")}
    assert got == {(1, 0): 2.0, (0, 1): 4.0}


def test_passes_are_final_behind_the_watermark(spark, tmp_path):
    points(spark, tmp_path, [(0.5, 0.5, 1.0, "2024-01-01 00:10:00"), (0.5, 0.5, 3.0, "2024-01-01 00:20:00")])
    points(spark, tmp_path, [(0.5, 0.5, 9.0, "2024-01-01 05:00:00")])
    got = run(spark, tmp_path, lambda s: passes(s, Grid.from_bounds(0, 0, 2, 2, 2, 2), "v", "t"), "append")
    assert [(r["row"], r["col"], r["value"], r["confidence"]) for r in got] == [(1, 0, 2.0, 2)]
