"""Uncompressed image files: BMP and PPM, written from RGB."""

from __future__ import annotations

import struct

import numpy as np


def encode_ppm(array: np.ndarray) -> bytes:
    """A binary PPM of (height, width, 3 or more); alpha is dropped."""
    height, width = array.shape[:2]
    return b"P6\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(array[..., :3]).tobytes()


def encode_bmp(array: np.ndarray) -> bytes:
    """A BMP of 24 bits a pixel, rows from the bottom up and filled to 4 bytes; alpha is dropped."""
    height, width = array.shape[:2]
    rows = np.zeros((height, -(-3 * width // 4) * 4), np.uint8)
    rows[:, : 3 * width] = array[::-1, :, 2::-1].reshape(height, 3 * width)
    head = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0)
    return struct.pack("<2sIHHI", b"BM", 14 + len(head) + rows.size, 0, 0, 14 + len(head)) + head + rows.tobytes()
