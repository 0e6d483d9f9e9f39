"""Many small files into few well-sized ones, with nothing lost and nothing twice.

Rows are shuffled under a REBALANCE hint, so that adaptive execution merges small and splits large output partitions
by their measured sizes. The result lands in a staging folder and is renamed only after its multiset checksum, read
back from the written files, equals that of the rows that went in.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from punctum.functions.names import scenario_key

#: Shuffled bytes that make one output file.
TARGET_BYTES = 128 << 20


def _checks(columns: Sequence[str]) -> list[Column]:
    named = [F.col(f"`{c}`") for c in sorted(columns)]
    row = F.xxhash64(*named, *(c.isNull() for c in named))
    return [F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(38,0)")).alias("total"), F.bit_xor(F.xxhash64(row, F.lit(1))).alias("mixed")]


def checksum(df: DataFrame) -> tuple:
    """Row count, and sum and exclusive or of row hashes: equal for equal multisets of rows, in any order and layout.

    NULLs count by position. Empty tables give (0, None, None). Map columns can't be hashed and raise an error.
    """
    return tuple(df.agg(*_checks(df.columns)).first())


def newest_by_key(df: DataFrame, key: Sequence[str], newest: str) -> DataFrame:
    """One row for each key: the one with the greatest ``newest``, then the greatest other columns in name order.

    NULLs in a key equal each other. The choice depends on the rows alone and not on their order, so that a repeated
    run gives the same rows.
    """
    rest = [newest, *sorted(c for c in df.columns if c not in key and c != newest)]
    best = df.groupBy(*key).agg(F.max(F.struct(*rest)).alias("__best"))
    return best.select(*(F.col(c) if c in key else F.col(f"__best.`{c}`").alias(c) for c in df.columns))


@contextmanager
def _sized(spark: SparkSession, target_bytes: int):
    names = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true", "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_bytes), "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for n, v in names.items():
            spark.conf.set(n, v)
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


def consolidate(df: DataFrame, path: str, *, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Writes the rows of ``df`` to few parquet files below ``path``, a folder that must not exist, and reads them back.

    ``df`` must give the same rows each time it runs. An empty input gives a folder with the schema and no rows. Raises
    ValueError, and leaves no ``path``, if the written rows aren't those of ``df``.

    The rows' checksum is taken as they pass on their way into the shuffle, so ``df`` runs once. Tasks that were run again
    after a loss may count twice there; where the checksums differ, ``df`` is therefore summed once more by itself.
    """
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    final, staged = hadoop.Path(path), hadoop.Path(f"{path}.staged")
    files = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(final):
        raise ValueError(f"{path} exists")
    passed = Observation()
    with _sized(spark, target_bytes):
        df.observe(passed, *_checks(df.columns)).hint("rebalance").write.mode("overwrite").parquet(str(staged))
    found = checksum(spark.read.schema(df.schema).parquet(str(staged)))
    expected = tuple(passed.get.get(k) for k in ("n", "total", "mixed"))
    if found != expected:
        expected = checksum(df)
    if found != expected:
        files.delete(staged, True)
        raise ValueError(f"written rows {found} differ from {expected}")
    if not files.rename(staged, final):
        raise ValueError(f"{staged} can't be renamed to {path}")
    return spark.read.schema(df.schema).parquet(path)


#: Where a path tells scenario and seed: key=value folders, name__s<seed>, name/seed_<seed>, name/<seed>/file.
_SCENARIO_IN_PATH = (r"(?i)scenario=([^/]+)", r"([^/]+?)__s\d+", r"([^/]+)/seed_\d+", r"([^/]+)/\d+/[^/]+$")
_SEED_IN_PATH = (r"(?i)seed=(\d+)", r"__s(\d+)", r"/seed_(\d+)", r"/(\d+)/[^/]+$")


def _in_path(path: Column, patterns: Sequence[str]) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(path, p, 1), F.lit("")) for p in patterns))


def identified_points(points: DataFrame, scenarios: DataFrame) -> DataFrame:
    """``points`` with scenario as ``scenarios`` writes it and with seed, both from file_path where they are NULL or blank.

    Names are equal once case, spaces, hyphens and underscores are ignored. A name that ``scenarios`` lacks, or a path
    that tells nothing, leaves NULL.
    """
    names = scenarios.where("scenario IS NOT NULL").groupBy(scenario_key(F.col("scenario")).alias("__key")).agg(F.min("scenario").alias("__scenario"))
    key = F.coalesce(F.nullif(scenario_key(F.col("scenario")), F.lit("")), scenario_key(_in_path(F.col("file_path"), _SCENARIO_IN_PATH)))
    found = points.withColumn("__key", key).join(names, "__key", "left")
    seed = F.coalesce(F.col("seed"), _in_path(F.col("file_path"), _SEED_IN_PATH).cast("long"))
    return found.withColumns({"scenario": F.col("__scenario"), "seed": seed}).select(*points.columns)


def consolidate_points(points: DataFrame, scenarios: DataFrame, path: str, *, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """The distinct simulated points of many small files, consolidated below ``path``.

    A point is known by scenario, seed and point_no; of several copies the last written one stays. Points that can't
    be identified are kept, one for each distinct row.
    """
    key = ["scenario", "seed", "point_no"]
    rows = identified_points(points, scenarios)
    known = " AND ".join(f"{k} IS NOT NULL" for k in key)
    return consolidate(newest_by_key(rows.where(known), key, "written_at").unionByName(rows.where(f"NOT ({known})").distinct()), path, target_bytes=target_bytes)
