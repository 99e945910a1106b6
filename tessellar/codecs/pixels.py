"""Pixels as numpy arrays: conversion, chroma modes, packing, premultiplication, blending, cropping and rescaling of whole frames.

Arithmetic is in 64-bit integers and exact. An ARGB frame is an array (height, width, 4) in the order alpha, red, green, blue.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

from tessellar.status import CodecError, INVALID_ARGUMENT, TOO_LARGE

#: Formats by code, taps of the chroma filters (14 and 6 bits) and the greatest scaled side.
FORMATS = ("yuv420p", "yuva420p", "argb", "rgba", "bgra", "rgb", "bgr", "Argb", "rgbA", "bgrA", "rgb565", "rgba4444", "rgbA4444", "bgr565", "bgra4444", "bgrA4444")
LANCZOS = (148, -495, 1146, -2658, 14699, 4740, -1709, 767, -295, 41)
FAST = (-10, 59, 15, 0)
MOST_SCALED = 16384
#: By layout, which of alpha, red, green, blue stands where.
LAYOUTS = {"argb": (0, 1, 2, 3), "rgba": (1, 2, 3, 0), "bgra": (3, 2, 1, 0), "rgb": (1, 2, 3), "bgr": (3, 2, 1)}
GAMMA = np.array([round(4095 * (v / 255) ** 0.8) for v in range(256)])
UNGAMMA = np.array([round(255 * (v / 32) ** 1.25) for v in range(33)])


def is_packed(fmt: str) -> bool:
    return not fmt.endswith("420p")


def is_premultiplied(fmt: str) -> bool:
    return "A" in fmt


def bytes_per_pixel(fmt: str) -> int:
    return 1 if not is_packed(fmt) else 2 if fmt.endswith(("565", "4444")) else len(fmt)


def components(fmt: str) -> int:
    return {"yuv420p": 3, "yuva420p": 4}.get(fmt, 1)


def plane_sizes(fmt: str, width: int, height: int) -> list[tuple[int, int]]:
    """(bytes a row, rows) of each plane."""
    if is_packed(fmt):
        return [(width * bytes_per_pixel(fmt), height)]
    half = ((width + 1) // 2, (height + 1) // 2)
    return [(width, height), half, half, (width, height)][: components(fmt)]


@dataclass
class Frame:
    """fmt: argb (one array), yuv420p or yuva420p (three or four). whole_chroma: U and V have full size."""

    fmt: str
    planes: list[np.ndarray]
    premultiplied: bool = False
    whole_chroma: bool = False

    @property
    def height(self) -> int:
        return self.planes[0].shape[0]

    @property
    def width(self) -> int:
        return self.planes[0].shape[1]


def argb_frame(pixels: np.ndarray) -> Frame:
    """Of 32-bit numbers."""
    p = pixels.astype(np.int64)
    return Frame("argb", [np.stack([p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255], 2)])


def matrix(y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Red, green and blue of limited-range luma and chroma."""
    high = lambda a, k: a * k >> 8
    luma = high(y, 19077)
    rgb = luma + high(v, 26149) - 14234, luma - high(u, 6419) - high(v, 13320) + 8708, luma + high(u, 33050) - 17685
    return np.stack([np.clip(c >> 6, 0, 255) for c in rgb], 2)


def fine_matrix(y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of chroma with six more bits, centred on 0."""
    luma = (y - 16) * (19077 * 64)
    return np.stack([np.clip(c + (1 << 19) >> 20, 0, 255) for c in (luma + v * 26149, luma - u * 6419 - v * 13320, luma + u * 33050)], 2)


def fancy(c: np.ndarray, height: int, width: int) -> np.ndarray:
    """Weights 9, 3, 3, 1 of the four nearest samples, rounded in two steps; past an edge stands the edge."""
    y, x = np.arange(height), np.arange(width)
    near_y, near_x = y >> 1, x >> 1
    far_y = np.clip(near_y + 2 * (y & 1) - 1, 0, c.shape[0] - 1)
    far_x = np.clip(near_x + 2 * (x & 1) - 1, 0, c.shape[1] - 1)
    n, h, v, d = c[near_y][:, near_x], c[near_y][:, far_x], c[far_y][:, near_x], c[far_y][:, far_x]
    return (n + 3 * h + 3 * v + d + 8 >> 3) + n >> 1


def taps(c: np.ndarray, size: int, weights: tuple[int, ...]) -> np.ndarray:
    """Doubles the rows of c to `size` of them by a filter whose taps are turned for even rows; past an edge stands the edge."""
    at, half = np.arange(size), len(weights) // 2
    out = np.zeros((size, c.shape[1]), np.int64)
    for t, w in enumerate(weights):
        row = (at >> 1) + np.where(at & 1, t - half + 1, half - 1 - t)
        out += w * c[np.clip(row, 0, len(c) - 1)]
    return out


def filtered(c: np.ndarray, height: int, width: int, mode: int) -> np.ndarray:
    if mode == 2:
        across = taps(c.T, width, FAST).T - 128 * 64
        return taps(across, height, FAST) + 32 >> 6
    across = taps(c.T, width, LANCZOS).T + 128 >> 8
    return (taps(across, height, LANCZOS) + (1 << 13) >> 14) - 128 * 64


def yuv_to_argb(f: Frame, mode: int = 1) -> Frame:
    """mode of the chroma: 0 nearest sample, 1 fancy, 2 three taps, 3 ten taps (Lanczos)."""
    y, u, v = (p.astype(np.int64) for p in f.planes[:3])
    h, w = y.shape
    if f.whole_chroma:
        rgb = matrix(y, u, v)
    elif mode == 0:
        at = np.ix_(np.arange(h) >> 1, np.arange(w) >> 1)
        rgb = matrix(y, u[at], v[at])
    elif mode == 1:
        rgb = matrix(y, fancy(u, h, w), fancy(v, h, w))
    elif mode in (2, 3):
        rgb = fine_matrix(y, filtered(u, h, w, mode), filtered(v, h, w, mode))
    else:
        raise CodecError(INVALID_ARGUMENT, "chroma mode")
    alpha = f.planes[3].astype(np.int64) if len(f.planes) == 4 else np.full((h, w), 255)
    return Frame("argb", [np.dstack([alpha, rgb])])


def luma_of(rgb: np.ndarray) -> np.ndarray:
    return rgb[..., 0] * 16839 + rgb[..., 1] * 33059 + rgb[..., 2] * 6420 + 32768 + (16 << 16) >> 16


def chroma_of(four: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """U and V of sums of four reds, greens and blues."""
    r, g, b = (four[..., k] for k in range(3))
    clip = lambda c: np.clip(c + (1 << 17) + (128 << 18) >> 18, 0, 255)
    return clip(28800 * b - 9719 * r - 19081 * g), clip(28800 * r - 24116 * g - 4684 * b)


def from_linear(v: np.ndarray) -> np.ndarray:
    """Four times the gamma value of a sum of four linear ones."""
    at, x = v >> 9, v & 511
    return UNGAMMA[np.minimum(at + 1, 32)] * x + UNGAMMA[at] * (512 - x) + 64 >> 7


def argb_to_yuva(f: Frame, with_alpha: bool) -> Frame:
    """4:2:0; chroma is averaged in linear light, weighted by alpha where a block is neither opaque nor clear. An odd edge counts twice."""
    p = f.planes[0]
    h, w = p.shape[:2]
    wide = np.pad(p, ((0, h & 1), (0, w & 1), (0, 0)), "edge")
    blocks = wide.reshape((h + 1) // 2, 2, (w + 1) // 2, 2, 4).transpose(0, 2, 1, 3, 4).reshape((h + 1) // 2, (w + 1) // 2, 4, 4)
    alpha, linear = blocks[..., 0], GAMMA[blocks[..., 1:]]
    total = alpha.sum(2)
    even = from_linear(linear.sum(2))
    some = np.maximum(total, 1)
    scaled = (linear * alpha[..., None]).sum(2) * ((1 << 19) // some)[..., None] & 0xFFFFFFFF
    weighted = from_linear(scaled >> 17)
    mixed = with_alpha & (total != 0) & (total != 4 * 255)
    u, v = chroma_of(np.where(mixed[..., None], weighted, even))
    planes = [luma_of(p[..., 1:]), u, v] + ([p[..., 0].copy()] if with_alpha else [])
    return Frame("yuva420p" if with_alpha else "yuv420p", planes)


def argb_to_yuv444(f: Frame) -> list[np.ndarray]:
    rgb = f.planes[0][..., 1:]
    return [luma_of(rgb), *chroma_of(4 * rgb)]


def premultiplied(p: np.ndarray) -> np.ndarray:
    """Of ARGB pixels; opaque ones stay."""
    a = p[..., :1]
    return np.concatenate([a, np.where(a == 255, p[..., 1:], p[..., 1:] * a * 32897 >> 23)], 2)


def weighted(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """x times alpha, as rescaling takes it."""
    return np.where(a == 255, x, np.where(a == 0, 0, (x * (a * ((1 << 24) // 255)) + (1 << 23) & 0xFFFFFFFF) >> 24))


def unweighted(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """x over alpha; sums wrap at 32 bits before the shift."""
    return np.where(a == 255, x, np.where(a == 0, 0, (x * ((255 << 24) // np.maximum(a, 1)) + (1 << 23) & 0xFFFFFFFF) >> 24))


def pack(p: np.ndarray, fmt: str) -> np.ndarray:
    """(height, bytes) of ARGB pixels, premultiplied where the format is and they are not yet: four-bit formats after packing."""
    plain = fmt.lower()
    if plain in LAYOUTS:
        return p[..., LAYOUTS[plain]].reshape(len(p), -1).astype(np.uint8)
    a, r, g, b = (p[..., k] for k in range(4))
    if plain.endswith("565"):
        pair = r & 0xF8 | g >> 5, g << 3 & 0xE0 | b >> 3
    else:
        pair = r & 0xF0 | g >> 4, b & 0xF0 | a >> 4
    if plain.startswith("bgr"):
        pair = pair[::-1]
    return np.stack(pair, 2).reshape(len(p), -1).astype(np.uint8)


def premultiplied_4444(rows: np.ndarray, swapped: bool) -> np.ndarray:
    """Of packed four-bit pixels."""
    pairs = rows.reshape(len(rows), -1, 2).astype(np.int64)
    rg, ba = (pairs[..., 1], pairs[..., 0]) if swapped else (pairs[..., 0], pairs[..., 1])
    factor = (ba & 15) * 0x1111
    r, g, b = ((n * 17) * factor >> 16 for n in (rg >> 4, rg & 15, ba >> 4))
    rg, ba = r & 0xF0 | g >> 4 & 15, b & 0xF0 | ba & 15
    return np.stack([ba, rg] if swapped else [rg, ba], 2).reshape(len(rows), -1).astype(np.uint8)


def to_packed(f: Frame, fmt: str, mode: int = 1) -> list[np.ndarray]:
    """The plane of a packed format. Frames that are premultiplied already stay as they are."""
    argb = f if f.fmt == "argb" else yuv_to_argb(f, mode)
    p = argb.planes[0]
    four = fmt.endswith("4444")
    if is_premultiplied(fmt) and not f.premultiplied and not four:
        p = premultiplied(p)
    out = pack(p, fmt)
    return [premultiplied_4444(out, fmt.startswith("bgr"))] if four and is_premultiplied(fmt) and not f.premultiplied else [out]


def to_planar(f: Frame, fmt: str) -> list[np.ndarray]:
    if f.fmt == "argb":
        f = argb_to_yuva(f, fmt == "yuva420p")
    planes = [p.astype(np.uint8) for p in f.planes[: components(fmt)]]
    if fmt == "yuva420p" and len(planes) < 4:
        planes.append(np.full(planes[0].shape, 255, np.uint8))
    return planes


def converted(f: Frame, fmt: str, mode: int = 1) -> list[np.ndarray]:
    """The planes of a format, rows of bytes."""
    return to_packed(f, fmt, mode) if is_packed(fmt) else to_planar(f, fmt)


def blend_straight(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Of ARGB pixels."""
    a, da = src[..., :1], dst[..., :1]
    t = da * (256 - a) >> 8
    whole = np.maximum(a + t, 1)
    mixed = np.concatenate([whole, (src[..., 1:] * a + dst[..., 1:] * t) * ((1 << 24) // whole) >> 24], 2)
    return np.where(a == 255, src, np.where(a == 0, dst, mixed))


def blend_premultiplied(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    return src + (dst * (256 - src[..., :1]) >> 8) & 255


def mix(src: np.ndarray, src_alpha: np.ndarray, dst: np.ndarray, dst_alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples blended by alpha planes, and the alpha that results."""
    t = dst_alpha * (256 - src_alpha) >> 8
    whole = np.maximum(src_alpha + t, 1)
    mixed = (src * src_alpha + dst * t) * ((1 << 24) // whole) >> 24
    choose = lambda new, keep, blend: np.where(src_alpha == 255, new, np.where(src_alpha == 0, keep, blend))
    return choose(src, dst, mixed & 255), choose(255, dst_alpha, whole)


def block_alpha(a: np.ndarray) -> np.ndarray:
    """The mean alpha of each 2 x 2 block, rounded up; at an odd edge of what is there."""
    h, w = a.shape
    total = np.add.reduceat(np.add.reduceat(a, np.arange(0, h, 2), 0), np.arange(0, w, 2), 1)
    shift = np.ones(total.shape, np.int64) * 2
    shift[:, -1] -= w & 1
    shift[-1] -= h & 1
    return -(-total >> shift)


def scaled_size(width: int, height: int, w: int, h: int) -> tuple[int, int]:
    """A side of 0 keeps the proportions, rounded up."""
    w, h = w or -(-width * h // height), h or -(-height * w // width)
    if min(w, h) <= 0 or max(w, h) > MOST_SCALED or w * h >= 1 << 32:
        raise CodecError(TOO_LARGE, "scaled size")
    return w, h


def crop(f: Frame, left: int, top: int, width: int, height: int) -> Frame:
    """Planar frames are cut at even places."""
    if min(left, top) < 0 or min(width, height) <= 0:
        raise CodecError(INVALID_ARGUMENT, "crop")
    if f.fmt != "argb":
        left, top = left & ~1, top & ~1
    if left + width > f.width or top + height > f.height:
        raise CodecError(INVALID_ARGUMENT, "crop outside the picture")

    def cut(p: np.ndarray, half: bool) -> np.ndarray:
        x, y, w, h = (left >> 1, top >> 1, width + 1 >> 1, height + 1 >> 1) if half else (left, top, width, height)
        return p[y : y + h, x : x + w]

    return replace(f, planes=[cut(p, k in (1, 2) and not f.whole_chroma) for k, p in enumerate(f.planes)])


ONE = 1 << 32


def fixed(x: np.ndarray, y: int, rounder: int = ONE >> 1) -> np.ndarray:
    """x * y / 2^32 of unsigned 32-bit numbers, rounded."""
    return (x.astype(np.uint64) * np.uint64(y) + np.uint64(rounder) >> np.uint64(32)).astype(np.int64) & 0xFFFFFFFF


def starts(size: int, out: int) -> np.ndarray:
    """The first source place of each of `out` shares of `size` places, and the end."""
    return -(-np.arange(out + 1) * size // out)


def shrink_rows(p: np.ndarray, out: int) -> np.ndarray:
    """(rows, size) to (rows, out) sums of source areas times `out`; what a share takes too much of its last place, the next one gets back."""
    size = p.shape[1]
    at = starts(size, out)
    over = p[:, at[1:] - 1] * (out * at[1:] - np.arange(1, out + 1) * size)
    back = np.pad(fixed(over, ONE // out & 0xFFFFFFFF)[:, :-1], ((0, 0), (1, 0)))
    total = np.pad(p.cumsum(1), ((0, 0), (1, 0)))
    return ((back + total[:, at[1:]] - total[:, at[:-1]]) * out - over) & 0xFFFFFFFF


def expand_rows(p: np.ndarray, out: int) -> np.ndarray:
    """(rows, size) to (rows, out) blends of neighbours, times out - 1."""
    size = p.shape[1]
    t = np.arange(out) * (size - 1)
    left = np.maximum(0, -(-t // (out - 1)) - 1)
    rest = (out - 1) * (left + 1) - t
    right = p[:, np.minimum(left + 1, size - 1)]
    return (right * (out - 1) + (p[:, left] - right) * rest) & 0xFFFFFFFF


def rescale(plane: np.ndarray, width: int, height: int) -> np.ndarray:
    """A plane (height, width) by areas where it shrinks, by neighbours where it grows; each direction on its own."""
    p = plane.astype(np.int64)
    h, w = p.shape
    rows = expand_rows(p, width) if w < width else shrink_rows(p, width)
    if h < height:
        step, factor = height - 1, ONE // (width - 1 if w < width else w) & 0xFFFFFFFF
        t = np.arange(height) * (h - 1)
        at = -(-t // step)
        behind = at * step - t
        before = rows[np.maximum(at - 1, 0)]
        weight = (behind << 32) // step  # of the row before
        mixed = rows[at].astype(np.uint64) * (ONE - weight).astype(np.uint64)[:, None] + before.astype(np.uint64) * weight.astype(np.uint64)[:, None]
        blend = (mixed + np.uint64(ONE >> 1) >> np.uint64(32)).astype(np.int64) & 0xFFFFFFFF
        return np.minimum(fixed(np.where(behind[:, None] == 0, rows[at], blend), factor), 255)
    at = starts(h, height)
    area = (width - 1 if w < width else w) * h
    ratio = (height << 32) // area
    total = np.pad(rows.cumsum(0), ((1, 0), (0, 0)))
    whole = total[at[1:]] - total[at[:-1]]
    if ratio >= ONE or not ratio:
        return whole & 255
    scale = (ONE // height & 0xFFFFFFFF) * (height * at[1:] - np.arange(1, height + 1) * h) & 0xFFFFFFFF
    over = (rows[at[1:] - 1].astype(np.uint64) * scale.astype(np.uint64)[:, None] >> np.uint64(32)).astype(np.int64)
    back = np.pad(over[:-1], ((1, 0), (0, 0)))
    return np.minimum(fixed((whole + back - over) & 0xFFFFFFFF, ratio), 255)


def scale(f: Frame, w: int, h: int, fmt: str | None = None) -> Frame:
    """To (w, h), 0 keeping the proportions; fmt: the format that the frame is for, its own by default.

    Straight ARGB is weighted by alpha; of planar frames for planar formats with alpha only luma is. For packed formats chroma is
    scaled to full size.
    """
    w, h = scaled_size(f.width, f.height, w, h)
    if f.fmt == "argb":
        p = f.planes[0]
        if not f.premultiplied:
            p = np.concatenate([p[..., :1], weighted(p[..., 1:], p[..., :1])], 2)
        out = np.dstack([rescale(p[..., k], w, h) for k in range(4)])
        if not f.premultiplied:
            out = np.concatenate([out[..., :1], unweighted(out[..., 1:], out[..., :1])], 2)
        return replace(f, planes=[out])
    packed = is_packed(fmt or f.fmt)
    weigh = not packed and len(f.planes) == 4 and fmt != "yuv420p"
    planes = [p.astype(np.int64) for p in f.planes]
    if weigh:
        planes[0] = weighted(planes[0], planes[3])
    half = (w, h) if packed else (w + 1 >> 1, h + 1 >> 1)
    planes = [rescale(p, *(half if k in (1, 2) else (w, h))) for k, p in enumerate(planes)]
    if weigh:
        planes[0] = unweighted(planes[0], planes[3])
    return replace(f, planes=planes, whole_chroma=packed)
