"""File sources and sinks: CSV, atomic parquet, matrices of three tables, tile shards, simulated data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A CSV file or folder with a header; the schema is given, never guessed. NULLs are written as \\N, blanks kept."""
    return spark.read.csv(path, header=True, schema=schema, nullValue="\\N", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.csv(path, header=True, nullValue="\\N", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


def write_parquet_atomic(df: DataFrame, path: str) -> str:
    """``df`` at ``path``, which appears at once when all files are written; an older table there is replaced.

    The older table is moved aside, never deleted, until the new one is in its place, and comes back if that fails. Between
    the two renames a reader finds no table, as file systems can't swap folders.
    """
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    staged, final = hadoop.Path(f"{path}.staged"), hadoop.Path(path)
    df.write.mode("overwrite").parquet(str(staged))
    files = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = hadoop.Path(f"{path}.replaced")
    files.delete(aside, True)
    older = files.exists(final) and files.rename(final, aside)
    if not files.rename(staged, final):
        if older:
            files.rename(aside, final)
        raise OSError(f"{staged} can't be renamed to {path}")
    files.delete(aside, True)
    return path


def write_matrix(path: str, *, expr: DataFrame, obs: DataFrame, var: DataFrame) -> str:
    """A sparse matrix with annotations as three tables: counts by row and column, rows, columns."""
    for name, df in (("expr", expr), ("obs", obs), ("var", var)):
        df.write.parquet(f"{path}/{name}")
    return path


def read_matrix(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("expr", "obs", "var")}


def discover(spark: SparkSession, pattern: str, parts: dict[str, str]) -> DataFrame:
    """The parquet files that match ``pattern``, with file_path and a string column for each regular expression of ``parts``."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(pattern).withColumn("file_path", F.col("_metadata.file_path"))
    return df.withColumns({n: F.nullif(F.regexp_extract("file_path", p, 1), F.lit("")) for n, p in parts.items()})


def write_simulated(points: DataFrame, path: str, *, is_3d: bool, extra: Sequence[str] = ()) -> str:
    """Points as x, y, z, gene and ``extra`` columns; a flat simulation has z 0."""
    z = F.col("global_z") if is_3d else F.lit(0.0)
    points.select(F.col("global_x").alias("x"), F.col("global_y").alias("y"), z.alias("z"), "gene", *extra).write.parquet(path)
    return path


def tile_of(points: DataFrame, width: float, keys: Sequence[str] = (), x: str = "global_x", y: str = "global_y") -> DataFrame:
    """``points`` with tile_row and tile_col, counted from the smallest position; the last tile takes the far edge in.

    Edges come from an aggregation, so no group of points is gathered. NULL keys drop out.
    """
    k = list(keys)
    edges = points.groupBy(*k).agg(*(f(c).alias(f"__{n}_{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max))))
    out = points.join(edges, k) if k else points.crossJoin(edges)
    for name, c in (("tile_row", y), ("tile_col", x)):
        lo, hi = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        last = F.greatest(F.ceil((hi - lo) / width), F.lit(1)) - 1
        out = out.withColumn(name, F.least(F.floor((F.col(c) - lo) / width), last).cast("int"))
    return out.drop(*(f"__{n}_{c}" for c in (x, y) for n in ("lo", "hi")))


def write_shards(df: DataFrame, path: str, by: Sequence[str]) -> str:
    """``df`` in one folder for each value of ``by``, so that a reader of one tile reads that tile alone."""
    df.repartition(*by).write.partitionBy(*by).parquet(path)
    return path
