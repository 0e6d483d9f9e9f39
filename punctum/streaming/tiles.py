"""Streaming forms of operators that need only static tables beside the stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctum.functions.names import finite


def tile_counts(stream: DataFrame, *, width: float, keys: Sequence[str], time: str, delay: str = "10 minutes", window: str = "1 hour", row_id: str = "tx_id") -> DataFrame:
    """(window, keys, tile_row, tile_col, n): points of a stream in square tiles, by windows of ``time``.

    Points later than ``delay`` are dropped; a point delivered again within it counts once. Positions that aren't finite
    count nowhere.
    """
    at = stream.where(finite(F.col("global_x")) & finite(F.col("global_y"))).withWatermark(time, delay)
    at = at.dropDuplicatesWithinWatermark([row_id])
    tile = [F.floor(F.col(c) / width).alias(n) for c, n in (("global_y", "tile_row"), ("global_x", "tile_col"))]
    return at.groupBy(F.window(time, window), *keys, *tile).agg(F.count(F.lit(1)).alias("n"))


def in_tiles(stream: DataFrame, tiles: DataFrame, *, width: float, keys: Sequence[str], tile_id: str) -> DataFrame:
    """The points of a stream with the ``tile_id`` of the half-open tile of a regular grid that holds them.

    ``tiles`` is a static table of centres; the join is on the grid cell of keys, row and column.
    """
    cell = lambda c, n: F.floor(F.col(c) / width).alias(n)
    grid = tiles.select(*keys, F.col(tile_id), cell("global_x", "__ix"), cell("global_y", "__iy"))
    stream = stream.where(finite(F.col("global_x")) & finite(F.col("global_y")))
    return stream.withColumns({"__ix": F.floor(F.col("global_x") / width), "__iy": F.floor(F.col("global_y") / width)}).join(grid, [*keys, "__ix", "__iy"]).drop("__ix", "__iy")
