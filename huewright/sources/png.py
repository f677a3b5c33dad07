"""PNG encoding and decoding of single images, inside tasks."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
# Samples of a pixel by colour type, and the start, step of the seven interlaced passes in x and y.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_PASSES = ((0, 8, 0, 8), (4, 8, 0, 8), (0, 4, 4, 8), (2, 4, 0, 4), (0, 2, 2, 4), (1, 2, 0, 2), (0, 1, 1, 2))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _file(width: int, height: int, depth: int, colour: int, rows: np.ndarray, extra: bytes = b"") -> bytes:
    """A PNG of packed rows (height, bytes), each with filter 0."""
    if width <= 0 or height <= 0:
        raise ValueError("an image file needs at least one pixel")
    lines = np.zeros((height, rows.shape[1] + 1), np.uint8)
    lines[:, 1:] = rows
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)) + extra + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def encode_rgb(rgba: np.ndarray) -> bytes:
    """(height, width, 3 or 4) array to an RGB file; alpha is dropped."""
    height, width = rgba.shape[:2]
    return _file(width, height, 8, 2, np.ascontiguousarray(rgba[..., :3], np.uint8).reshape(height, -1))


def pack_nibbles(indices: np.ndarray) -> np.ndarray:
    """Two indices in a byte, the first in the high half; an odd row ends with a zero low half."""
    padded = np.pad(indices.astype(np.uint8), ((0, 0), (0, indices.shape[1] % 2)))
    return padded[:, ::2] << 4 | padded[:, 1::2]


def encode_indexed(indices: np.ndarray, palette: np.ndarray) -> bytes:
    """(height, width) palette indices to an indexed file, of 4 bits for up to 16 colours, else of 8."""
    if not 0 < len(palette) <= 256 or indices.size and int(indices.max()) >= len(palette):
        raise ValueError("indices must be below the size of a palette of 1 to 256 colours")
    height, width = indices.shape
    small = len(palette) <= 16
    rows = pack_nibbles(indices) if small else indices.astype(np.uint8)
    return _file(width, height, 4 if small else 8, 3, rows, _chunk(b"PLTE", np.asarray(palette, np.uint8).tobytes()))


def _unfiltered(raw: np.ndarray, height: int, stride: int, step: int) -> np.ndarray:
    """Rows (height, stride) without their filters; `step` is a pixel's bytes."""
    rows = raw[: height * (stride + 1)].reshape(height, stride + 1)
    out = np.zeros((height + 1, stride), np.uint8)
    for y in range(height):
        kind, line, above = rows[y, 0], rows[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 2:
            out[y + 1] = line + above
        elif kind == 1:
            pad = np.pad(line, (0, -stride % step)).reshape(-1, step)
            out[y + 1] = np.cumsum(pad, 0, dtype=np.uint8).reshape(-1)[:stride]
        elif kind in (3, 4):
            new = out[y + 1]
            for x in range(stride):
                a, b, c = (int(new[x - step]) if x >= step else 0), int(above[x]), (int(above[x - step]) if x >= step else 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if da <= db and da <= dc else b if db <= dc else c
                new[x] = (int(line[x]) + guess) & 255
        else:
            raise ValueError(f"unknown PNG filter {kind}")
    return out[1:]


def _samples(rows: np.ndarray, width: int, samples: int, depth: int) -> np.ndarray:
    """(height, width, samples) numbers of packed rows."""
    height = rows.shape[0]
    if depth == 8:
        return rows.reshape(height, width, samples)
    if depth == 16:
        return rows.view(">u2").reshape(height, width, samples)
    bits = np.unpackbits(rows, axis=1)[:, : width * samples * depth].reshape(height, width, samples, depth)
    return (bits * (1 << np.arange(depth)[::-1])).sum(-1).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """(height, width, 4) array of any PNG file; ValueError if it isn't one."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, body, palette, trans, header = 8, [], None, None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if len(part) < size:
            raise ValueError("the PNG file is cut off")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            trans = part
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            break
        at += size + 12
    if header is None or header[3] not in _SAMPLES:
        raise ValueError("the PNG file has no sound header")
    width, height, depth, colour, _, _, interlaced = header
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    except zlib.error as e:
        raise ValueError(f"the PNG data is damaged: {e}") from e
    samples = _SAMPLES[colour]
    values = np.zeros((height, width, samples), np.uint16 if depth == 16 else np.uint8)
    for x0, dx, y0, dy in _PASSES if interlaced else ((0, 1, 0, 1),):
        w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
        if w <= 0 or h <= 0:
            continue
        stride = (w * samples * depth + 7) // 8
        if len(raw) < h * (stride + 1):
            raise ValueError("the PNG data is too short")
        values[y0::dy, x0::dx] = _samples(_unfiltered(raw, h, stride, max(1, samples * depth // 8)), w, samples, depth)
        raw = raw[h * (stride + 1) :]
    return _rgba(values, colour, depth, palette, trans)


def _rgba(values: np.ndarray, colour: int, depth: int, palette: np.ndarray | None, trans: bytes | None) -> np.ndarray:
    out = np.full((*values.shape[:2], 4), 255, np.uint8)
    if colour == 3:
        if palette is None or values.size and int(values.max()) >= len(palette):
            raise ValueError("the PNG file's palette is missing or too short")
        out[..., :3] = palette[values[..., 0]]
        if trans:
            alpha = np.full(256, 255, np.uint8)
            alpha[: len(trans)] = np.frombuffer(trans, np.uint8)
            out[..., 3] = alpha[values[..., 0]]
        return out
    # The nearest value of 8 bits.
    eight = ((values.astype(np.uint32) + 128) // 257).astype(np.uint8) if depth == 16 else values * np.uint8(255 // ((1 << depth) - 1))
    out[..., :3] = eight[..., : 3 if colour in (2, 6) else 1]
    if colour in (4, 6):
        out[..., 3] = eight[..., -1]
    elif trans:
        key = np.frombuffer(trans, ">u2").astype(np.int64)
        out[..., 3] = np.where((values == key[: values.shape[2]]).all(-1), 0, 255)
    return out
