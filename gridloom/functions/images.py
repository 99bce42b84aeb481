"""Pixels: resizing, crops and tensors as NumPy functions, applied in Arrow batches."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rgb(data: bytes, width: int, height: int, channels: int = 3) -> np.ndarray:
    """(height, width, 3) RGB of the ``image`` source's BGR bytes."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return x[:, :, 2::-1] if channels >= 3 else np.repeat(x, 3, 2)


def resize(x: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear resize as floats; source place = target place / scale, the last row and column repeat."""
    def places(n_to: int, n_from: int):
        at = np.arange(n_to) * (n_from / n_to)
        low = np.minimum(at.astype(int), n_from - 1)
        return low, np.minimum(low + 1, n_from - 1), at - low

    y0, y1, wy = places(height, x.shape[0])
    x0, x1, wx = places(width, x.shape[1])
    wy, wx = wy[:, None, None], wx[None, :, None]
    f = x.astype(np.float64)
    top = f[y0][:, x0] * (1 - wx) + f[y0][:, x1] * wx
    bottom = f[y1][:, x0] * (1 - wx) + f[y1][:, x1] * wx
    return top * (1 - wy) + bottom * wy


def page_scale(height: int, to: int = 1024) -> float:
    return to / height


def crop(x: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    left, top, right, bottom = box
    if right <= left or bottom <= top:
        raise ValueError("an empty crop")
    return x[top:bottom, left:right]


def tensor(x: np.ndarray, mean: list[float], std: list[float], side: int = 448) -> np.ndarray:
    """Resized to a square, scaled to 0..1, normalised, as (channel, width, height) floats."""
    y = np.clip(resize(x, side, side), 0, 255) / 255
    return ((y - np.array(mean)) / np.array(std)).transpose(2, 1, 0).astype(np.float32)


def letterbox(x: np.ndarray, side: int) -> np.ndarray:
    """Resized to fit a black square, centred."""
    scale = side / max(x.shape[:2])
    h, w = max(1, int(x.shape[0] * scale)), max(1, int(x.shape[1] * scale))
    out = np.zeros((side, side, 3))
    top, left = (side - h) // 2, (side - w) // 2
    out[top : top + h, left : left + w] = resize(x, w, h)
    return out


def channels_first(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.float32) / 255).transpose(2, 0, 1)


def crop_statistics(pages: DataFrame) -> DataFrame:
    """For pages (page_id, width, height, data, region l/t/r/b as ints): crop size, bytes, mean, std and SHA-256."""
    schema = "page_id long, crop_width int, crop_height int, n_bytes long, mean double, std double, sha256 string"

    def run(batches):
        for t in batches:
            out = []
            for r in t.itertuples(index=False):
                c = np.ascontiguousarray(crop(rgb(bytes(r.data), r.width, r.height), (r.l, r.t, r.r, r.b)))
                out.append((r.page_id, c.shape[1], c.shape[0], c.nbytes, float(c.mean()), float(c.std()), hashlib.sha256(c.tobytes()).hexdigest()))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return pages.select("page_id", "width", "height", "data", *"ltrb").mapInPandas(run, schema)


def array_statistics(column) -> list:
    """Least, greatest, mean and population deviation of an array column; null for an empty one."""
    n = F.size(column)
    mean = F.aggregate(column, F.lit(0.0), lambda a, x: a + x) / n
    square = F.aggregate(column, F.lit(0.0), lambda a, x: a + x * x) / n
    value = lambda v: F.when(n > 0, v)
    return [
        value(F.array_min(column)).alias("least"), value(F.array_max(column)).alias("most"), value(mean).alias("mean"),
        value(F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))).alias("std"),
    ]
