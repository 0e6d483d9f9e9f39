from pyspark.sql import functions as F

from punctum.streaming.tiles import in_tiles, tile_counts

SCHEMA = "tx_id long, sample_id string, global_x double, global_y double, loaded_at timestamp"


def test_counts_and_lookup_of_a_stream(spark, tmp_path):
    rows = [(i, "a", float(i % 40), 5.0) for i in range(100)] + [(3, "a", 3.0, 5.0), (200, "a", float("nan"), 1.0)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "tx_id long, sample_id string, global_x double, global_y double").withColumn("loaded_at", F.lit("2025-01-01 10:05:00").cast("timestamp")).write.parquet(src)
    stream = spark.readStream.schema(SCHEMA).parquet(src)
    counts = tile_counts(stream, width=20.0, keys=["sample_id"], time="loaded_at")
    tiles = spark.createDataFrame([("t0", "a", 10.0, 10.0), ("t1", "a", 30.0, 10.0)], "spot_id string, sample_id string, global_x double, global_y double")
    found = in_tiles(stream, tiles, width=20.0, keys=["sample_id"], tile_id="spot_id").groupBy("spot_id").agg(F.count(F.lit(1)).alias("n"))
    for df, name in ((counts, "counts"), (found, "found")):
        q = df.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert {(r["tile_row"], r["tile_col"]): r["n"] for r in spark.table("counts").collect()} == {(0, 0): 60, (0, 1): 40}
    assert {r["spot_id"]: r["n"] for r in spark.table("found").collect()} == {"t0": 61, "t1": 40}
