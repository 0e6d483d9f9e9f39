"""Storage that every executor reaches: tables that cut lineage, and staging folders."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset (tests, one machine), a temporary one."""
    sc = spark.sparkContext
    found = sc.getConf().get(CHECKPOINT_CONF)
    if found:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(found)
        return found.rstrip("/")
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError(f"on a cluster, set {CHECKPOINT_CONF} to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="punctum-"))
    return sc.getCheckpointDir().rstrip("/")


_kept: set[str] = set()


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/punctum-{spark.sparkContext.applicationId}"


def staging_path(spark: SparkSession, label: str) -> str:
    """A folder name that no other call gets, below the application's own folder in the shared one.

    Results read their tables when they are used, so these stay until ``clean`` is called, which also happens when the
    driver's Python ends.
    """
    folder = _own_folder(spark)
    if folder not in _kept:
        _kept.add(folder)
        atexit.register(_clean_at_exit, spark)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Removes every table that this application staged; results that weren't written elsewhere can't be read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _clean_at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have been stopped; its folder names the application
        clean(spark)


def written_once(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table written to the shared folder, which later passes read instead of computing it again."""
    path = staging_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as a table in the shared folder, with no lineage behind it.

    For loops: unlike ``checkpoint()`` this also leaves the plan's constraints behind, which grow with every self-join.
    """
    return written_once(df, "round")


def forget(*tables: DataFrame) -> None:
    """Removes tables made by ``cut`` or ``written_once`` that nothing will read again."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
