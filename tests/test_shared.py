import os

from punctum.plans.shared import clean, cut, forget, staging_path, written_once


def _folders(spark):
    own = os.path.dirname(staging_path(spark, "x")).removeprefix("file:").replace("//", "/")
    return {f.split("-")[0] for f in os.listdir(own)} if os.path.isdir(own) else set()


def test_tables_lie_in_the_applications_folder_and_go_with_it(spark):
    a, b = cut(spark.range(5)), written_once(spark.range(3), "kept")
    assert a.count() == 5 and b.count() == 3 and {"round", "kept"} <= _folders(spark)
    assert spark.sparkContext.applicationId in b.inputFiles()[0]
    forget(b)
    assert "kept" not in _folders(spark)
    clean(spark)
    assert _folders(spark) == set()
    assert written_once(spark.range(4), "again").count() == 4
