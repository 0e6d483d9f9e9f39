"""Canonical spellings: genes, scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gene_key(name: Column) -> Column:
    """``name`` without white space of any kind and in lower case; NULL stays NULL."""
    return F.lower(F.regexp_replace(name, r"(?U)[\s\p{Z}]+", ""))


def with_gene(df: DataFrame, panel: DataFrame, name: str, out: str = "gene_entry", how: str = "inner") -> DataFrame:
    """Adds to ``df`` the ``gene`` of ``panel`` that column ``name`` denotes.

    ``how="inner"`` keeps only rows that denote an entry, ``"left"`` keeps all; a column ``out`` that is there is replaced. The panel is a table of fixed size, so
    Catalyst broadcasts it by its file size.
    """
    keys = panel.where("gene IS NOT NULL").groupBy(gene_key(F.col("gene")).alias("__gene_key")).agg(F.min("gene").alias(out))
    if name != out:
        df = df.drop(out)
    return df.withColumn("__gene_key", gene_key(F.col(name))).join(keys, "__gene_key", how).drop("__gene_key")


def scenario_key(name: Column) -> Column:
    """``name`` without spaces, hyphens and underscores and in lower case."""
    return F.lower(F.regexp_replace(name, r"(?U)[\s\p{Z}_-]+", ""))


def finite(col: Column) -> Column:
    """True for a number that is neither NULL, NaN nor infinite."""
    return F.coalesce(F.abs(col) < F.lit(float("inf")), F.lit(False))
