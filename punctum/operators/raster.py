"""Stain masks from images, one image a row, and their look-up tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class MaskParams:
    """block: side of the neighbourhood whose mean is the threshold; c: taken off that mean; area: least pixels of a kept object; radius: of the dilation."""

    block: int = 49
    c: float = -1.0
    area: int = 100
    radius: int = 10


def _box_mean(img: np.ndarray, block: int) -> np.ndarray:
    """Mean of the ``block`` x ``block`` pixels around each pixel, borders repeated."""
    h = block // 2
    p = np.pad(img, h, mode="edge")
    s = np.pad(p.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
    n, m = img.shape
    k = 2 * h + 1
    return (s[k : k + n, k : k + m] - s[:n, k : k + m] - s[k : k + n, :m] + s[:n, :m]) / (k * k)


def objects(mask: np.ndarray) -> np.ndarray:
    """A number for each 8-connected object of ``mask``, its least pixel plus 1, and 0 outside."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    big = mask.size + 1
    while True:
        p = np.pad(np.where(mask, label, big), 1, constant_values=big)
        low = np.minimum.reduce([p[1 + i : 1 + i + mask.shape[0], 1 + j : 1 + j + mask.shape[1]] for i in (-1, 0, 1) for j in (-1, 0, 1)])
        low = np.where(mask, low, 0)
        flat = np.concatenate([[0], low.ravel()])
        low = np.where(mask, flat[low], 0)  # pointer jumping: the label of the label's pixel
        if np.array_equal(low, label):
            return label
        label = low


def stain_mask(img: np.ndarray, p: MaskParams = MaskParams()) -> np.ndarray:
    """True for the bright objects of an image: above the local mean, large enough, and grown by a disk.

    Values are scaled to 0..255 first; an image of one value has no objects.
    """
    img = np.asarray(img, float)
    lo, hi = (img.min(), img.max()) if img.size else (0.0, 0.0)
    if hi <= lo:
        return np.zeros(img.shape, bool)
    img = np.floor((img - lo) / (hi - lo) * 255)
    mask = img > _box_mean(img, p.block) - p.c
    label = objects(mask)
    sizes = np.bincount(label.ravel(), minlength=label.max() + 1)
    sizes[0] = 0
    mask = sizes[label] >= p.area
    wide = np.pad(mask, p.radius)
    out = np.zeros_like(mask)
    for i in range(-p.radius, p.radius + 1):
        reach = int((p.radius**2 - i * i) ** 0.5)
        row = np.pad(wide[p.radius + i : p.radius + i + mask.shape[0]].astype(np.int32).cumsum(axis=1), ((0, 0), (1, 0)))
        at = np.arange(mask.shape[1]) + p.radius
        out |= row[:, at + reach + 1] - row[:, at - reach] > 0
    return out


def images(pixels: DataFrame) -> DataFrame:
    """(z, n_rows, n_cols, pixels) of every image of which ``pixels`` (z, row, col, value, n_rows, n_cols) has the pixels that aren't 0.

    Rows and columns count from 0. An image is one row, put together in one task.
    """

    def run(t: pa.Table) -> pa.Table:
        z, n, m = (t[c][0].as_py() for c in ("z", "n_rows", "n_cols"))
        img = np.zeros(n * m)
        img[t["row"].to_numpy().astype(np.int64) * m + t["col"].to_numpy()] = t["value"].to_numpy()
        return pa.table([pa.array([z], pa.float64()), pa.array([n], pa.int32()), pa.array([m], pa.int32()), pa.ListArray.from_arrays([0, n * m], img)], ["z", "n_rows", "n_cols", "pixels"])

    return pixels.select("z", "row", "col", "value", "n_rows", "n_cols").groupBy("z").applyInArrow(run, "z double, n_rows int, n_cols int, pixels array<double>")


def mask_pixels(images: DataFrame, params: MaskParams = MaskParams()) -> DataFrame:
    """(z, row, col) of the mask of every image (z, n_rows, n_cols, pixels), a table for an equi-join with pixel numbers.

    An image is worked on in one task; NULL or empty images have no pixels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for z, n, m, px in zip(*(b[c].to_pylist() for c in ("z", "n_rows", "n_cols")), b["pixels"]):
                if not px.is_valid or not len(px):
                    continue
                r, c = np.nonzero(stain_mask(px.values.to_numpy(zero_copy_only=False).astype(float).reshape(n, m), params))
                yield pa.RecordBatch.from_arrays([pa.array([z] * len(r), pa.float64()), pa.array(r, pa.int32()), pa.array(c, pa.int32())], ["z", "row", "col"])

    return images.select("z", "n_rows", "n_cols", "pixels").mapInArrow(run, "z double, row int, col int")
