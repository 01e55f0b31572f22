"""Image decoders for executors: PNG and GIF in numpy, HEIC by a converter, JPEG by the JVM or Pillow if it's there."""

from __future__ import annotations

import os
import shutil
import struct
import subprocess
import tempfile
import zlib

import numpy as np


def premultiplied(rgb: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    return (rgb.astype(np.uint32) * alpha[..., None] // 255).astype(np.uint8)


def _unfilter(raw: np.ndarray, height: int, stride: int, step: int) -> np.ndarray:
    rows = raw.reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(height):
        kind, line = rows[y, 0], rows[y, 1:].copy()
        if kind == 1:
            for i in range(step):
                line[i::step] = np.cumsum(line[i::step], dtype=np.uint64).astype(np.uint8)
        elif kind == 2:
            line += above
        elif kind in (3, 4):
            cur, up = line.tolist(), above.tolist()
            for i in range(stride):
                a, b = (cur[i - step] if i >= step else 0), up[i]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    c = up[i - step] if i >= step else 0
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                cur[i] = (cur[i] + guess) & 255
            line = np.array(cur, np.uint8)
        out[y] = above = line
    return out


def decode_png(content: bytes) -> np.ndarray:
    """Pixels of a PNG of any colour type and depth that isn't interlaced."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, palette, clear = 8, [], None, None
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, color, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if interlaced:
        raise ValueError("interlaced PNG")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    stride = (width * channels * depth + 7) // 8
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    lines = _unfilter(raw[: height * (stride + 1)], height, stride, max(1, channels * depth // 8))
    if depth == 16:
        lines = lines[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(lines, axis=1).reshape(height, -1, depth)[:, : width * channels]
        lines = bits @ (1 << np.arange(depth)[::-1]).astype(np.uint8)
        if color == 0:
            lines = (lines.astype(np.uint32) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    img = lines[:, : width * channels].reshape(height, width, channels)
    if color == 3:
        alpha = np.full(256, 255, np.uint8)
        if clear:
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
        return premultiplied(palette[img[..., 0]], alpha[img[..., 0]])
    rgb = np.repeat(img[..., :1], 3, axis=2) if color in (0, 4) else img[..., :3]
    return premultiplied(rgb, img[..., -1]) if color in (4, 6) else np.ascontiguousarray(rgb)


def _lzw(data: bytes, least: int) -> bytes:
    clear, stop = 1 << least, (1 << least) + 1
    table: list[bytes] = []
    width, last, bits, held, out = least + 1, None, 0, 0, bytearray()
    for byte in data:
        held |= byte << bits
        bits += 8
        while bits >= width:
            code = held & ((1 << width) - 1)
            held >>= width
            bits -= width
            if code == clear:
                table = [bytes([i]) for i in range(clear)] + [b"", b""]
                width, last = least + 1, None
                continue
            if code == stop:
                return bytes(out)
            entry = table[code] if code < len(table) else last + last[:1]
            if last is not None and len(table) < 4096:
                table.append(last + entry[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            out += entry
            last = entry
    return bytes(out)


def decode_gif(content: bytes) -> np.ndarray:
    """The first frame of a GIF."""
    if content[:4] != b"GIF8":
        raise ValueError("not a GIF")
    flags, at = content[10], 13
    table = None
    if flags & 128:
        n = 3 << (flags & 7) + 1
        table, at = np.frombuffer(content[at : at + n], np.uint8).reshape(-1, 3), at + n
    clear = None
    while True:
        kind = content[at]
        if kind == 0x21:
            if content[at + 1] == 0xF9 and content[at + 3] & 1:
                clear = content[at + 6]
            at += 2
            while content[at]:
                at += content[at] + 1
            at += 1
        elif kind == 0x2C:
            _, _, width, height, flags = struct.unpack("<HHHHB", content[at + 1 : at + 10])
            at += 10
            if flags & 128:
                n = 3 << (flags & 7) + 1
                table, at = np.frombuffer(content[at : at + n], np.uint8).reshape(-1, 3), at + n
            least, at, parts = content[at], at + 1, []
            while content[at]:
                parts.append(content[at + 1 : at + 1 + content[at]])
                at += content[at] + 1
            index = np.frombuffer(_lzw(b"".join(parts), least), np.uint8)[: width * height].reshape(height, width)
            if flags & 64:
                order = np.concatenate([np.arange(0, height, 8), np.arange(4, height, 8), np.arange(2, height, 4), np.arange(1, height, 2)])
                index = index[np.argsort(order)]
            alpha = np.where(index == clear, 0, 255).astype(np.uint8) if clear is not None else np.full(index.shape, 255, np.uint8)
            return premultiplied(table[index], alpha)
        else:
            raise ValueError("GIF without a frame")


def from_jvm(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Pixels of a row of Spark's image source: grey, BGR or BGRA."""
    img = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(img, 3, axis=2)
    rgb = img[..., 2::-1]
    return premultiplied(rgb, img[..., 3]) if channels == 4 else np.ascontiguousarray(rgb)


def decode_other(content: bytes) -> np.ndarray:
    """Formats that need Pillow (JPEG in a task, WebP)."""
    import io

    from PIL import Image

    img = np.asarray(Image.open(io.BytesIO(content)).convert("RGBA"))
    return premultiplied(img[..., :3], img[..., 3])


def decode_heic(path: str) -> np.ndarray:
    """HEIC through ``heif-convert`` or ``sips``, whichever is there, by way of a PNG in the task's own folder."""
    tool = shutil.which("heif-convert") or shutil.which("sips")
    if tool is None:
        raise ValueError("no HEIC converter")
    with tempfile.TemporaryDirectory() as folder:
        out = os.path.join(folder, "out.png")
        subprocess.run([tool, path, out] if tool.endswith("heif-convert") else [tool, "-s", "format", "png", path, "--out", out], check=True, capture_output=True, timeout=120)
        with open(out, "rb") as f:
            return decode_png(f.read())


def decode(path: str, content: bytes) -> np.ndarray:
    """Pixels of a file by its content's format."""
    if content[:4] == b"GIF8":
        return decode_gif(content)
    if content[:4] == b"\x89PNG":
        return decode_png(content)
    if os.path.splitext(path)[1].lower() in (".heic", ".heif"):
        return decode_heic(path)
    return decode_other(content)
