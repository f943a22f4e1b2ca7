"""PNG files of 8-bit RGBA images."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def encode(image: np.ndarray) -> bytes:
    h, w, c = image.shape
    if c != 4:
        raise ValueError("an image has four channels")
    raw = np.empty((h, w * 4 + 1), np.uint8)
    raw[:, 0], raw[:, 1:] = 0, np.ascontiguousarray(image, np.uint8).reshape(h, -1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """8-bit RGB or RGBA without interlacing, with any row filter."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, body, head = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        head, body = (struct.unpack(">IIBBBBB", part) if kind == b"IHDR" else head), body + (part if kind == b"IDAT" else b"")
        at += size + 12
    w, h, depth, kind = head[:4]
    if depth != 8 or kind not in (2, 6) or head[6]:
        raise ValueError("only 8-bit RGB and RGBA images without interlacing are read")
    n = 4 if kind == 6 else 3
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, w * n + 1)
    out, above = np.zeros((h, w * n), np.uint8), np.zeros(w * n, int)
    for y in range(h):
        f, line = raw[y, 0], raw[y, 1:].astype(int)
        if f == 2:
            line = line + above
        elif f in (1, 3, 4):
            for x in range(w * n):
                a, b = (line[x - n] if x >= n else 0), above[x]
                if f == 1:
                    p = a
                elif f == 3:
                    p = (a + b) // 2
                else:
                    c = above[x - n] if x >= n else 0
                    e = a + b - c
                    p = min((abs(e - a), 0, a), (abs(e - b), 1, b), (abs(e - c), 2, c))[2]
                line[x] = (line[x] + p) & 255
        above = line & 255
        out[y] = above
    image = out.reshape(h, w, n)
    return image if n == 4 else np.dstack([image, np.full((h, w), 255, np.uint8)])
