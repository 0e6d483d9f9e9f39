"""Enough partitions for work that costs far more than a shuffle of its input."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` itself, or shuffled to one partition for each core if it has fewer, as a few small files have.

    Input large enough to occupy the cluster is never shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
