import datetime
import os

import pytest
from pyspark.sql import functions as F

from punctum.operators import compaction
from punctum.operators.compaction import checksum, consolidate, consolidate_points

T0 = datetime.datetime(2025, 1, 1)
POINTS = "file_path string, scenario string, seed long, point_no long, global_x double, granule_id long, written_at timestamp, __key string"
NAMES = [("even_mix_stack", 1), ("sparse_flat", 0)]


def points(spark, rows):
    return spark.createDataFrame([(*r[:4], r[4], 0, T0 + datetime.timedelta(r[5]), None) for r in rows], POINTS)


def test_paths_spellings_copies_and_nulls(spark, tmp_path):
    rows = [
        ("sim/stack/even_mix_stack/seed_27.0.parquet", "Even-Mix STACK", None, 1, 1.0, 0),
        ("sim/stack/scenario=even_mix_stack/seed=27/part-0.parquet", None, 27, 1, 1.0, 1),  # written again
        ("rerun/07/even-mix-stack__s0000027__c6_5.parquet", None, None, 2, 1.0, 0),  # equal content, another point
        ("sim/flat/SPARSE_FLAT/000009/chunk7.parquet", " ", None, 1, None, 0),
        ("staging/7c7f.parquet", "sparse flat", 9, 2, 2.0, 0),
        ("staging/7c7f.parquet", None, None, 5, 2.0, 0),  # can't be identified
        ("staging/7c7f.parquet", None, None, 5, 2.0, 0),
        (None, "unheard of", 1, 1, 2.0, 0),
    ]
    out = consolidate_points(points(spark, rows), spark.createDataFrame(NAMES, "scenario string, is_3d int"), str(tmp_path / "out"))
    got = sorted((tuple(r) for r in out.select("scenario", "seed", "point_no").collect()), key=str)
    assert got == sorted([("even_mix_stack", 27, 1), ("even_mix_stack", 27, 2), ("sparse_flat", 9, 1), ("sparse_flat", 9, 2), (None, None, 5), (None, 1, 1)], key=str)
    kept = out.where("seed = 27 AND point_no = 1").first()
    assert kept["file_path"].startswith("sim/stack/scenario=")  # the last written


def test_empty_table(spark, tmp_path):
    out = consolidate_points(points(spark, []), spark.createDataFrame(NAMES, "scenario string, is_3d int"), str(tmp_path / "out"))
    assert out.count() == 0 and "scenario" in out.columns


def test_few_files_of_about_the_target_size(spark, tmp_path):
    df = spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("s")).repartition(50)
    path = str(tmp_path / "out")
    out = consolidate(df, path, target_bytes=4 << 20)
    files = [f for f in os.listdir(path) if f.endswith(".parquet")]
    assert 2 <= len(files) <= 12
    assert checksum(out) == checksum(df)


def test_checksum_sees_multisets(spark):
    a = spark.createDataFrame([(1, None), (None, 1), (2, 2)], "a int, b int")
    assert checksum(a) == checksum(a.orderBy("b"))
    assert checksum(a) != checksum(a.union(a.limit(1)))
    assert checksum(a) != checksum(spark.createDataFrame([(None, 1), (None, 1), (2, 2)], "a int, b int"))


def test_lost_rows_leave_nothing_behind(spark, tmp_path, monkeypatch):
    real = compaction.checksum  # what is read back has a file name; rows that went in have none
    monkeypatch.setattr(compaction, "checksum", lambda df: real(df.limit(1)) if df.inputFiles() else real(df))
    path = str(tmp_path / "out")
    with pytest.raises(ValueError, match="differ"):
        consolidate(spark.range(10), path)
    assert not os.path.exists(path)
    monkeypatch.undo()
    consolidate(spark.range(10), path)
    with pytest.raises(ValueError, match="exists"):
        consolidate(spark.range(10), path)


def test_rows_counted_twice_on_their_way_are_summed_again(spark, tmp_path, monkeypatch):
    class Twice(compaction.Observation):
        @property
        def get(self):
            return {k: v * 2 for k, v in super().get.items()}

    monkeypatch.setattr(compaction, "Observation", Twice)
    assert consolidate(spark.range(10), str(tmp_path / "out")).count() == 10


def test_the_whole_simulated_table_is_written(spark, monkeypatch):
    from punctum.catalog import relational

    rows = [("rerun/a/1/p.parquet", 1.0), ("scenario=a/seed=2/p.parquet", 2.0), (None, 3.0)]
    df = spark.createDataFrame([(f, x, 0.0, 0.0, "g", 1) for f, x in rows], "file_path string, global_x double, global_y double, global_z double, gene string, granule_id long")
    monkeypatch.setattr(relational, "table", lambda *_: df)
    assert sorted(r["x"] for r in relational.a11_simulated_data(spark, None).collect()) == [1.0, 2.0, 3.0]
