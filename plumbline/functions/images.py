"""Fingerprints and corruptions of small grey images, given as arrays of pixels; batches of rows in numpy."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dct_matrix(n: int) -> np.ndarray:
    """The orthonormal DCT-II of n points."""
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    m = np.cos(np.pi * (2 * i + 1) * k / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


def perceptual_hash(pixels: np.ndarray) -> int:
    """64 bits of a 32 x 32 image: which of the 8 x 8 lowest DCT terms exceed the median of those but the first."""
    d = dct_matrix(32)
    low = (d @ np.asarray(pixels, float).reshape(32, 32) @ d.T)[:8, :8].reshape(-1)
    bits = low > np.median(low[1:])
    return int("".join("1" if b else "0" for b in bits), 2)


def perceptual_hashes(pixels: Column | str) -> Column:
    """`perceptual_hash` of arrays of 1,024 pixels, as a signed long; null for other lengths."""

    @F.pandas_udf("long")
    def run(rows: pd.Series) -> pd.Series:
        signed = lambda h: h - (1 << 64) if h >> 63 else h
        return pd.Series([None if x is None or len(x) != 1024 else signed(perceptual_hash(x)) for x in rows], dtype="Int64")

    return run(pixels)


def smooth(field: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing, edges repeated, to four deviations."""
    radius = max(1, int(4 * sigma + 0.5))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    for axis in (0, 1):
        padded = np.pad(field, [(radius, radius) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        field = np.apply_along_axis(lambda v: np.convolve(v, kernel, "valid"), axis, padded)
    return field


def fog(pixels: np.ndarray, transmission: float, airlight: float = 0.9, noise: float = 0.04, seed: int = 0) -> np.ndarray:
    """An image in [0, 1] blended with airlight through a smooth random transmission, seeded."""
    image = np.asarray(pixels, float)
    field = smooth(np.random.default_rng(seed).normal(0, noise, image.shape), max(1.0, min(image.shape) / 12))
    t = np.clip(transmission + field, 0, 1)
    return np.clip(image * t + airlight * (1 - t), 0, 1)
