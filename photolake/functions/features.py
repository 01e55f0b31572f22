"""Image features in numpy, of pixels as (height, width, 3) uint8 arrays, premultiplied by alpha."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

WORK = 256
LUMA = np.array([0.299, 0.587, 0.114])


@dataclass(frozen=True)
class Metrics:
    width: int
    height: int
    dhash: int
    blur_var: float
    brightness: float
    colorfulness: float


def fit(width: int, height: int, most: int) -> tuple[int, int]:
    """The size with a long edge of ``most`` at most and the same shape, at least 1; never larger than it is."""
    if max(width, height) <= most:
        return max(width, 1), max(height, 1)
    return (most, max(1, height * most // width)) if width >= height else (max(1, width * most // height), most)


def scaled(img: np.ndarray, most: int = WORK) -> np.ndarray:
    """Bilinear point samples of a smaller image; small ones are as they are, and one of no size is a black pixel."""
    height, width = img.shape[:2]
    if not height or not width:
        return np.zeros((1, 1, 3), np.uint8)
    w, h = fit(width, height, most)
    if (w, h) == (width, height):
        return img

    def spots(n: int, size: int):
        at = np.clip((np.arange(n) + 0.5) * size / n - 0.5, 0, size - 1)
        low = at.astype(np.int64)
        return low, np.minimum(low + 1, size - 1), at - low

    y0, y1, fy = spots(h, height)
    x0, x1, fx = spots(w, width)
    fy, fx = fy[:, None, None], fx[None, :, None]
    top = img[y0][:, x0] * (1 - fx) + img[y0][:, x1] * fx
    low = img[y1][:, x0] * (1 - fx) + img[y1][:, x1] * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.uint8)


def laplacian_variance(luma: np.ndarray) -> float:
    """Population variance of the 4-neighbour Laplacian inside; 0 for an image without an inside."""
    if min(luma.shape) < 3:
        return 0.0
    lap = luma[:-2, 1:-1] + luma[2:, 1:-1] + luma[1:-1, :-2] + luma[1:-1, 2:] - 4 * luma[1:-1, 1:-1]
    return float(lap.var())


def colorfulness(rgb: np.ndarray) -> float:
    r, g, b = (rgb[..., i].astype(np.float64) for i in range(3))
    rg, yb = r - g, (r + g) / 2 - b
    return float(np.sqrt(rg.var() + yb.var()) + 0.3 * np.sqrt(rg.mean() ** 2 + yb.mean() ** 2))


def dhash(img: np.ndarray, truncate: bool = True) -> int:
    """Signed 64-bit difference hash of 9 x 8 point samples of the original; the browser's variant doesn't truncate luma."""
    height, width = img.shape[:2]
    ys, xs = np.arange(8) * height // 8, np.arange(9) * width // 9
    luma = img[ys][:, xs].astype(np.float64) @ LUMA
    if truncate:
        luma = np.floor(luma + 1e-9)
    bits = (luma[:, :-1] > luma[:, 1:]).ravel()
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def image_metrics(img: np.ndarray) -> Metrics:
    """All features from one decoded image and one downscaled copy of it."""
    work = scaled(img)
    luma = work.astype(np.float64) @ LUMA
    return Metrics(img.shape[1], img.shape[0], dhash(img) if img.size else 0, laplacian_variance(luma), float(luma.mean()), colorfulness(work))


@F.pandas_udf(LongType())
def dhash_of_pixels(pixels: pd.Series) -> pd.Series:
    """The browser's hash of 9 x 8 RGBA pixels (288 bytes)."""
    return pixels.map(lambda p: dhash(np.frombuffer(p, np.uint8).reshape(8, 9, 4)[..., :3], truncate=False))


def model_input(img: np.ndarray, size: int = 224) -> np.ndarray:
    """(3, size, size) float32 input of an ImageNet model."""
    ys, xs = np.arange(size) * img.shape[0] // size, np.arange(size) * img.shape[1] // size
    x = img[ys][:, xs].astype(np.float32) / 255
    return ((x - np.array([0.485, 0.456, 0.406], np.float32)) / np.array([0.229, 0.224, 0.225], np.float32)).transpose(2, 0, 1)
