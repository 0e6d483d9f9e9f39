"""Per-key results where a few keys hold most rows: two-stage salted aggregation.

Heavy keys are those with more than ``heavy_rows`` rows; they alone get a salt. Stage one computes partial results by
key and salt, stage two merges them by key. The salt is a hash of the row's id and not a fresh random number, so that a
task that runs again after an executor is lost puts every row where it was.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctum.functions.names import finite
from punctum.plans.shared import cut

#: Rows of one key above which it is salted.
HEAVY_ROWS = 100_000
#: Salts of a heavy key.
SALTS = 32
#: Rows of one key that one task may order.
ORDERED_ROWS = 1 << 16
#: Up to so many keys, at well under 200 bytes each, their picked digits are broadcast; beyond, they are joined by a shuffle.
BROADCAST_KEYS = 50_000


def heavy_keys(rows: DataFrame, keys: Sequence[str], heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """The keys with more than ``heavy_rows`` rows; at most one for so many rows of the input."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > heavy_rows).select(*keys, F.lit(True).alias("__heavy"))


def salted(rows: DataFrame, keys: Sequence[str], salt_on: Column, heavy: DataFrame, salts: int = SALTS) -> DataFrame:
    """``rows`` with a column ``__salt``: 0, or for keys in ``heavy`` one of ``salts`` numbers by the hash of ``salt_on``."""
    salt = F.when(F.col("__heavy"), F.pmod(F.xxhash64(salt_on), F.lit(salts))).otherwise(F.lit(0).cast("long"))
    return rows.join(heavy, list(keys), "left").withColumn("__salt", salt).drop("__heavy")


def salted_aggregate(rows: DataFrame, keys: Sequence[str], salt_on: Column, partial: dict[str, Column], merge: dict[str, Column], *, heavy_rows: int = HEAVY_ROWS, salts: int = SALTS) -> DataFrame:
    """``merge`` over ``partial`` by ``keys``: partial results by key and salt first, then merged by key.

    A NULL in a key makes no group. Empty input gives no rows. ``partial`` names the columns that ``merge`` reads.
    """
    rows = rows.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    heavy = heavy_keys(rows, keys, heavy_rows)
    first = salted(rows, keys, salt_on, heavy, salts).groupBy(*keys, "__salt").agg(*(c.alias(n) for n, c in partial.items()))
    return first.groupBy(*keys).agg(*(c.alias(n) for n, c in merge.items()))


def _picked(rows: DataFrame, keys: list[str], digit: Column, rank: Column | None, heavy: DataFrame, salts: int) -> DataFrame:
    """For each key, the digit that holds the row of the wanted rank, the rank within it, and its number of rows."""
    first = salted(rows.withColumn("__digit", digit), keys, F.col("__id"), heavy, salts)
    have = [] if rank is None else [F.first("__rank").alias("__rank")]
    counts = first.groupBy(*keys, "__salt", "__digit").agg(F.count(F.lit(1)).alias("__n"), *have)
    counts = counts.groupBy(*keys, "__digit").agg(F.sum("__n").alias("__n"), *have)
    up_to = Window.partitionBy(*keys).orderBy("__digit").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("__upto", F.sum("__n").over(up_to))
    if rank is None:
        total = F.sum("__n").over(Window.partitionBy(*keys))
        counts = counts.withColumn("__rank", F.floor((total + 1) / 2))
    before = F.col("__upto") - F.col("__n")
    return counts.where((before < F.col("__rank")) & (F.col("__rank") <= F.col("__upto"))).select(*keys, "__digit", (F.col("__rank") - before).cast("long").alias("__rank"), "__n")


def middle_rows(rows: DataFrame, keys: Sequence[str], *, order: str, row_id: str, width: float = 16.0, heavy_rows: int = HEAVY_ROWS, salts: int = SALTS, ordered_rows: int = ORDERED_ROWS) -> DataFrame:
    """(keys, row_id) of each key's middle row: number n/2, rounded up, of its n rows ordered by ``order``, then ``row_id``.

    ``row_id`` is a whole number that names a row within its key. Rows are never gathered by key: salted counts of
    ever finer digits of (order, row_id) find the digit that holds the middle, until no key has more than ``ordered_rows`` rows
    left in it. The last digit holds at most 65,536 ids, so the ordering step is bounded for every input. ``rows`` is read once for
    each digit and should be a written table.

    NULL keys and rows without a finite ``order`` are left out; rows that tie in ``order`` go by ``row_id``.
    """
    keys = list(keys)
    left = rows.where(finite(F.col(order)) & F.col(row_id).isNotNull()).select(*keys, F.col(order).cast("double").alias("__x"), F.col(row_id).cast("long").alias("__id"))
    left = left.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    heavy = cut(heavy_keys(left, keys, heavy_rows))
    x, ident = F.col("__x"), F.col("__id")
    digits = [F.floor(x / width), F.floor(x / (width / 1024)), x + F.lit(0.0), F.shiftright(ident, 32), F.shiftright(ident, 16)]
    rank = None
    for digit in digits:
        picked = cut(_picked(left, keys, digit, rank, heavy, salts))
        n_keys, most = picked.agg(F.count(F.lit(1)), F.max("__n")).first()
        side = picked.drop("__n")
        side = F.broadcast(side) if n_keys <= BROADCAST_KEYS else side
        left = left.drop("__rank").withColumn("__digit", digit).join(side, [*keys, "__digit"]).drop("__digit")
        rank = F.col("__rank")
        if most is None or most <= ordered_rows:
            break
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("__x", "__id"))
    return left.withColumn("__place", place).where(F.col("__place") == rank).select(*keys, F.col("__id").alias(row_id))
