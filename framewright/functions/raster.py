"""Difference hashes and image quality: for whole images by NumPy, for small rasters as expressions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.session import mapped


def luma(bgr: np.ndarray) -> np.ndarray:
    """Gray of 8-bit blue-green-red, rounded in 14-bit fixed point (weights .299, .587, .114)."""
    b, g, r = (bgr[..., i].astype(np.int64) for i in range(3))
    return ((r * 4899 + g * 9617 + b * 1868 + (1 << 13)) >> 14).astype(np.uint8)


def area_resized(gray: np.ndarray, width: int, height: int) -> np.ndarray:
    """Each target pixel is the mean of the source area under it; 8-bit, halves to even."""
    def weights(n: int, m: int) -> np.ndarray:
        edges = np.arange(m + 1) * n / m
        cells = np.arange(n)
        return np.clip(np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells), 0, None) * m / n

    mean = weights(gray.shape[0], height) @ gray.astype(np.float64) @ weights(gray.shape[1], width).T
    return np.clip(np.rint(mean), 0, 255).astype(np.uint8)


def difference_hash(gray: np.ndarray, core_size: int) -> np.ndarray:
    """core_size**2 bits: whether each pixel's right neighbour is brighter, row by row."""
    small = area_resized(gray, core_size + 1, core_size)
    return (small[:, 1:] > small[:, :-1]).ravel()


def quality(gray: np.ndarray) -> tuple[float, float, float]:
    """(brightness, contrast, blur score): mean, deviation and variance of the 4-neighbour Laplacian, to two places."""
    g = gray.astype(np.float64)
    p = np.pad(g, 1, mode="reflect") if min(g.shape) > 1 else np.pad(g, 1, mode="edge")
    edges = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
    return round(float(g.mean()), 2), round(float(g.std()), 2), round(float(edges.var()), 2)


def gray_of(height: int, width: int, channels: int, data: bytes) -> np.ndarray | None:
    """The gray raster of one row of Spark's image source; None if it could not be read."""
    if height is None or height <= 0 or width <= 0:
        return None
    raster = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return raster[..., 0] if channels == 1 else luma(raster)


def image_features(images: DataFrame, core_size: int = 16) -> DataFrame:
    """(path, im_width, im_height, im_depth, im_brightness, im_contrast, im_blur_score, hash) of image rows (column image).

    Each image is read once for all of them. An unreadable image has nulls.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, h, w, c, data in zip(*(col.to_pylist() for col in batch.columns)):
                gray = gray_of(h, w, c, data)
                rows.append((path, *([None] * 7)) if gray is None else (path, w, h, c, *quality(gray), difference_hash(gray, core_size).tolist()))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.bool_()))
            names = ("path", "im_width", "im_height", "im_depth", "im_brightness", "im_contrast", "im_blur_score", "hash")
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=list(names))

    ddl = "path string, im_width int, im_height int, im_depth int, im_brightness double, im_contrast double, im_blur_score double, hash array<boolean>"
    return mapped(images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data"), run, ddl)


def raster_bits(cells: Column, width: int, height: int) -> Column:
    """Difference bits of a raster kept as an array, row by row."""
    at = lambda i: (i / (width - 1)).cast("int") * width + i % (width - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(height * (width - 1) - 1)), lambda i: cells[at(i) + 1] > cells[at(i)])


def small_raster_quality(df: DataFrame, id_col: str, cells_col: str, width: int, height: int) -> DataFrame:
    """(id_col, brightness, contrast, blur) of rasters kept as arrays of width * height numbers, unrounded; others are left out."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, height, width)
            p = np.pad(g, ((0, 0), (1, 1), (1, 1)), mode="reflect")
            edges = p[:, :-2, 1:-1] + p[:, 2:, 1:-1] + p[:, 1:-1, :-2] + p[:, 1:-1, 2:] - 4 * g
            measures = (g.mean((1, 2)), g.std((1, 2)), edges.var((1, 2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, measures)], names=["id", "brightness", "contrast", "blur"])

    kind = df.schema[id_col].dataType.simpleString()
    whole = df.filter((F.size(cells_col) == width * height) & ~F.array_contains(F.transform(cells_col, lambda x: x.isNull()), True))
    rows = mapped(whole.select(F.col(id_col).alias("id"), F.col(cells_col).alias("c")), run, f"id {kind}, brightness double, contrast double, blur double")
    return rows.withColumnRenamed("id", id_col)
