"""PNG images from pixel rows."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..errors import InvalidInput


def encode(rgba: np.ndarray) -> bytes:
    """A PNG file of an array (height, width, 4) of bytes."""
    if rgba.ndim != 3 or rgba.shape[2] != 4 or 0 in rgba.shape:
        raise InvalidInput("an image is height x width x 4")
    height, width, _ = rgba.shape
    lines = np.zeros((height, 1 + width * 4), np.uint8)
    lines[:, 1:] = rgba.astype(np.uint8).reshape(height, -1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        body = kind + data
        return len(data).to_bytes(4, "big") + body + zlib.crc32(body).to_bytes(4, "big")

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"".join(n.to_bytes(4, "big") for n in (width, height)) + bytes([8, 6, 0, 0, 0])) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def images(pixels: DataFrame, keys: list[str], size: int = 256) -> DataFrame:
    """One PNG for each group of ``(px, py, r, g, b, a)`` rows; pixels without a row are transparent."""
    schema = ", ".join(f"{k} {pixels.schema[k].dataType.simpleString()}" for k in keys) + ", png binary"

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        canvas = np.zeros((size, size, 4), np.uint8)
        canvas[group.py, group.px] = group[["r", "g", "b", "a"]].to_numpy()
        return pd.DataFrame({**{k: [group[k].iloc[0]] for k in keys}, "png": [encode(canvas)]})

    return pixels.groupBy(*keys).applyInPandas(draw, schema)
