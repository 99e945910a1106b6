"""Alpha planes: the ALPH chunk, raw or lossless, with its row filters."""

from __future__ import annotations

import numpy as np

from tessellar.codecs import vp8l
from tessellar.status import CodecError, UNSUPPORTED, invalid

NONE, HORIZONTAL, VERTICAL, GRADIENT = range(4)


def unfilter(plane: np.ndarray, mode: int) -> np.ndarray:
    """The plane whose differences (modulo 256) these are. The first row is always one of differences along it."""
    p = plane.astype(np.int64)
    if mode == NONE or not p.size:
        return plane
    p[0] = p[0].cumsum()
    if mode == HORIZONTAL:
        p[:, 0] = p[:, 0].cumsum()
        p[1:] = p[1:].cumsum(1)
    elif mode == VERTICAL:
        p = p.cumsum(0)
    else:
        rows = (p & 255).tolist()
        for y in range(1, len(rows)):
            above, row = rows[y - 1], rows[y]
            left = row[0] = row[0] + above[0] & 255
            corner = above[0]
            for x in range(1, len(row)):
                up = above[x]
                left = row[x] = row[x] + min(255, max(0, left + up - corner)) & 255
                corner = up
        p = np.array(rows)
    return (p & 255).astype(np.uint8)


def header(first: int) -> tuple[int, int]:
    """Compression and filter."""
    if first >> 6 or (first >> 4 & 3) > 1:
        raise invalid("header of ALPH")
    if (first & 3) > 1:
        raise CodecError(UNSUPPORTED, "compression of ALPH")
    return first & 3, first >> 2 & 3


def decode(data: bytes, width: int, height: int) -> np.ndarray:
    if not data:
        raise invalid("an empty ALPH")
    compression, mode = header(data[0])
    if compression:
        plane = vp8l.decode_alpha(data[1:], width, height)
    else:
        if len(data) - 1 < width * height:
            raise invalid("a short alpha plane")
        plane = np.frombuffer(data, np.uint8, width * height, 1).reshape(height, width)
    return unfilter(plane, mode)
