"""A small PNG writer and synthetic images for tests and demonstrations."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def encode_png(img: np.ndarray) -> bytes:
    """An 8-bit RGB or RGBA PNG of a (height, width, 3 or 4) array."""
    height, width, channels = img.shape

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    lines = np.concatenate([np.zeros((height, 1), np.uint8), img.reshape(height, width * channels)], axis=1)
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def write_png(path: str, img: np.ndarray) -> None:
    with open(path, "wb") as f:
        f.write(encode_png(img))


def _grid(width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    return np.meshgrid(np.arange(width), np.arange(height))


def checkerboard(width: int, height: int, cell: int, shift: int = 0) -> np.ndarray:
    x, y = _grid(width, height)
    return np.where((((x + shift) // cell + y // cell) % 2 == 0)[..., None], np.array([220, 40, 30]), np.array([20, 60, 210])).astype(np.uint8)


def flat(width: int, height: int, luma: int) -> np.ndarray:
    x, y = _grid(width, height)
    return np.repeat((luma + (x + y) % 2)[..., None], 3, axis=2).astype(np.uint8)


def bright_page(width: int, height: int) -> np.ndarray:
    x, y = _grid(width, height)
    return np.where(((y % 12 == 0) & (x % 3 == 0))[..., None], np.array([30, 30, 30]), np.array([248, 248, 246])).astype(np.uint8)
