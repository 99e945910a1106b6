"""Lossy key frames to Y, U and V planes.

The probability tables of the format (modes of 4 x 4 blocks, default coefficients, their updates) have thousands of entries and no
rule; they are a parameter, `Tables`, in the order of RFC 6386. Parsing runs over Python integers, prediction, transforms and
filters over numpy arrays. Prediction reads unfiltered samples, so filters run over the whole frame afterwards, in block order.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np

from tessellar.status import CodecError, TOO_LARGE, UNSUPPORTED, invalid

#: Fixed values of the format: the scan, the bands, quantisers, probabilities of whole-block and chroma modes and of large values.
SCAN = (0, 1, 4, 8, 5, 2, 3, 6, 9, 12, 13, 10, 7, 11, 14, 15)
BANDS = (0, 1, 2, 3, 6, 4, 5, 6, 6, 6, 6, 6, 6, 6, 6, 7)
DC_STEPS = (
    4, 5, 6, 7, 8, 9, 10, 10, 11, 12, 13, 14, 15, 16, 17, 17, 18, 19, 20, 20, 21, 21, 22, 22, 23, 23, 24, 25, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 37, 37,
    38, 39, 40, 41, 42, 43, 44, 45, 46, 46, 47, 48, 49, 50, 51, 52, 53, 54, 55, 56, 57, 58, 59, 60, 61, 62, 63, 64, 65, 66, 67, 68, 69, 70, 71, 72, 73, 74, 75, 76,
    76, 77, 78, 79, 80, 81, 82, 83, 84, 85, 86, 87, 88, 89, 91, 93, 95, 96, 98, 100, 101, 102, 104, 106, 108, 110, 112, 114, 116, 118, 122, 124, 126, 128, 130, 132,
    134, 136, 138, 140, 143, 145, 148, 151, 154, 157,
)
#: Steps of 1 from 4 to 58, of 2 to 116, of 3 to 155 (158, 161 and so on after it), then as written.
AC_STEPS = (*range(4, 58), *range(58, 116, 2), *range(116, 173, 3), 173, 177, 181, 185, 189, 193, 197, 201, 205, 209, 213, 217, 221, 225, 229, 234, 239, 245, 249, 254, 259, 264, 269, 274, 279, 284)
MODE_ODDS, CHROMA_ODDS = (145, 156, 163, 128), (142, 114, 183)
LARGE = ((159,), (165, 145), (173, 148, 140), (176, 155, 140, 135), (180, 157, 141, 134, 130), (254, 254, 243, 230, 196, 177, 153, 140, 133, 130, 129))
DC, VERTICAL, HORIZONTAL, TRUE_MOTION, FOURS = range(5)
#: Modes of 4 x 4 blocks in the order of RFC 6386.
B_DC, B_TM, B_VE, B_HE, B_LD, B_RD, B_VR, B_VL, B_HD, B_HU = range(10)
#: What a whole-block mode counts as beside 4 x 4 blocks.
AS_FOURS = (B_DC, B_VE, B_HE, B_TM)


@dataclass(frozen=True)
class Tables:
    """modes[above][left][9], coefficients and updates [4][8][3][11], as RFC 6386 has them (13.4, 13.5 and 11.5)."""

    modes: list
    coefficients: list
    updates: list

    def __post_init__(self):
        for name, shape in (("modes", (10, 10, 9)), ("coefficients", (4, 8, 3, 11)), ("updates", (4, 8, 3, 11))):
            if np.shape(getattr(self, name)) != shape:
                raise ValueError(f"{name}: not of shape {shape}")

    @staticmethod
    def load(path: str) -> Tables:
        """From a JSON file with the three arrays."""
        with open(path) as f:
            held = json.load(f)
        return Tables(held["modes"], held["coefficients"], held["updates"])


class Coder:
    """Boolean decoder. `over` is set once a byte past the end had to stand in."""

    def __init__(self, data: bytes):
        self.data, self.at, self.value, self.range, self.n, self.over = data, 0, 0, 255, -8, False

    def load(self) -> None:
        part = self.data[self.at : self.at + 7]
        if part:
            self.at += len(part)
            self.value = self.value << 8 * len(part) | int.from_bytes(part, "big")
            self.n += 8 * len(part)
        else:
            self.over = True
            self.value <<= 8
            self.n += 8

    def bit(self, odds: int) -> int:
        while self.n < 0:
            self.load()
        split = 1 + ((self.range - 1) * odds >> 8)
        if self.value >> self.n >= split:
            self.value -= split << self.n
            self.range -= split
            out = 1
        else:
            self.range = split
            out = 0
        if self.range < 128:
            shift = 8 - self.range.bit_length()
            self.range <<= shift
            self.n -= shift
        return out

    def signed(self, v: int) -> int:
        """v or -v. The range is halved, rounded up, and always doubled once, even to 256."""
        while self.n < 0:
            self.load()
        low = (self.range + 1) // 2
        if self.value >> self.n >= low:
            self.value -= low << self.n
            self.range, v = self.range - low, -v
        else:
            self.range = low
        self.range *= 2
        self.n -= 1
        return v

    def number(self, bits: int) -> int:
        out = 0
        for _ in range(bits):
            out = out << 1 | self.bit(128)
        return out

    def optional(self, bits: int) -> int:
        """A signed number that may be left out (0)."""
        if not self.bit(128):
            return 0
        v = self.number(bits)
        return -v if self.bit(128) else v


@dataclass
class Block:
    mode: int
    fours: list[int]
    chroma: int
    segment: int
    skip: bool
    luma: np.ndarray | None = None  # (16, 16) coefficients
    chromas: np.ndarray | None = None  # (8, 16)
    coded: list[int] | None = None


def held(v: int, top: int) -> int:
    return min(top, max(0, v))


class Header:
    """Everything before the blocks: size, segments, filters, partitions, quantisers, probabilities."""

    def __init__(self, data: bytes, tables: Tables, total: int | None = None):
        """total: the size of the whole frame, of which data may be the first part."""
        total = len(data) if total is None else total
        if len(data) < 10:
            raise invalid("a short frame")
        tag = int.from_bytes(data[:3], "little")
        size = tag >> 5
        if tag & 1:
            raise invalid("not a key frame")
        if (tag >> 1 & 7) > 3:
            raise invalid("unknown profile")
        if not tag >> 4 & 1:
            raise CodecError(UNSUPPORTED, "a frame that is not shown")
        if size > total - 10 or size > len(data) - 10:
            raise invalid("a header past the end of the data")
        if data[3:6] != b"\x9d\x01\x2a":
            raise invalid("start code")
        width, height = (int.from_bytes(data[k : k + 2], "little") for k in (6, 8))
        self.width, self.height = width & 0x3FFF, height & 0x3FFF
        self.warnings = ["upscaling is not supported"] if width >> 14 or height >> 14 else []
        if not self.width or not self.height:
            raise CodecError(TOO_LARGE, "no pixels")
        c = self.coder = Coder(data[10 : 10 + size])
        if c.bit(128):
            self.warnings.append("unspecified colour space")
        c.bit(128)
        quants, levels, absolute, self.map, self.segment_odds = [0] * 4, [0] * 4, False, False, [255] * 3
        segments = c.bit(128)
        if segments:
            self.map = bool(c.bit(128))
            if c.bit(128):
                absolute = bool(c.bit(128))
                quants = [c.optional(7) for _ in range(4)]
                levels = [c.optional(6) for _ in range(4)]
            if self.map:
                self.segment_odds = [c.number(8) if c.bit(128) else 255 for _ in range(3)]
        self.simple, level, sharpness = bool(c.bit(128)), c.number(6), c.number(3)
        deltas = [0] * 8
        use_deltas = c.bit(128)
        if use_deltas and c.bit(128):
            for k in range(8):
                if c.bit(128):
                    v = c.number(6)
                    deltas[k] = -v if c.bit(128) else v
        self.filters = []  # (level, interior limit) by segment and whether the block is of 4 x 4 modes
        for k in range(4):
            base = (levels[k] if absolute else levels[k] + level) if segments else level
            both = []
            for fours in (0, 1):
                v = held(base + (deltas[0] + fours * deltas[4] if use_deltas else 0), 63)
                inner = v
                if sharpness:
                    inner = min(inner >> (sharpness + 3 >> 2), 9 - sharpness)
                both.append((v, max(1, inner)))
            self.filters.append(both)
        parts = 1 << c.number(2)
        at = 10 + size
        start = at + 3 * (parts - 1)
        if start > len(data):
            raise invalid("partition sizes past the end of the data")
        self.parts = []
        for k in range(parts - 1):
            n = int.from_bytes(data[at + 3 * k : at + 3 * k + 3], "little")
            if n > total - start:
                raise invalid("a partition past the end of the data")
            self.parts.append(Coder(data[start : start + n]))
            start += n
        self.parts.append(Coder(data[start:]))
        own = c.number(7)
        y_dc, y2_dc, y2_ac, uv_dc, uv_ac = (c.optional(4) for _ in range(5))
        self.steps = []  # (dc, ac) of luma, its second order, chroma, by segment
        for k in range(4):
            q = (quants[k] if absolute else quants[k] + own) if segments else own
            dc, ac = (lambda d, q=q: DC_STEPS[held(q + d, 127)]), (lambda d, q=q: AC_STEPS[held(q + d, 127)])
            self.steps.append(((dc(y_dc), ac(0)), (2 * dc(y2_dc), max(8, ac(y2_ac) * 101581 >> 16)), (min(132, dc(uv_dc)), ac(uv_ac))))
        c.bit(128)
        self.odds = [[[list(ctx) for ctx in band] for band in plane] for plane in tables.coefficients]
        for plane, updates in zip(self.odds, tables.updates, strict=True):
            for band, update in zip(plane, updates, strict=True):
                for ctx, odds in zip(band, update, strict=True):
                    for k, p in enumerate(odds):
                        if c.bit(p):
                            ctx[k] = c.number(8)
        self.skip_odds = c.number(8) if c.bit(128) else None


def coefficients(c: Coder, out: list[int], odds: list, at: int, ctx: int, steps: tuple[int, int]) -> int:
    """Reads a block's coefficients; returns one past the last one, 0 for none."""
    bit = c.bit
    p = odds[BANDS[at]][ctx]
    if not bit(p[0]):
        return 0
    while True:
        while not bit(p[1]):
            at += 1
            if at == 16:
                return 16
            p = odds[BANDS[at]][0]
        if not bit(p[2]):
            v, ctx = 1, 1
        else:
            ctx = 2
            if not bit(p[3]):
                v = 2 + (1 + bit(p[5]) if bit(p[4]) else 0)
            else:
                if not bit(p[6]):
                    kind, v = (1, 7) if bit(p[7]) else (0, 5)
                else:
                    a = bit(p[8])
                    kind = 2 * a + bit(p[9 + a])
                    v = 3 + (8 << kind)
                    kind += 2
                extra = 0
                for q in LARGE[kind]:
                    extra = 2 * extra + bit(q)
                v += extra
        out[SCAN[at]] = c.signed(v) * steps[at > 0]
        at += 1
        if at == 16:
            return 16
        p = odds[BANDS[at]][ctx]
        if not bit(p[0]):
            return at


def short(v: np.ndarray) -> np.ndarray:
    """As 16-bit numbers hold it."""
    return v.astype(np.int16).astype(np.int64)


def second_order(v: list[int]) -> np.ndarray:
    """The 16 luma DCs of a block's second-order coefficients (inverse Walsh-Hadamard transform)."""
    m = short(np.array(v)).reshape(4, 4)

    def half(a: np.ndarray) -> np.ndarray:
        s, d, e, f = a[0] + a[3], a[1] + a[2], a[1] - a[2], a[0] - a[3]
        return np.stack([s + d, f + e, s - d, f - e])

    m = half(m)
    m[:, 0] += 3
    return short(half(m.T).T >> 3).ravel()


def inverse(blocks: np.ndarray) -> np.ndarray:
    """Residuals (n, 4, 4) of coefficients (n, 16) (inverse cosine transform)."""
    m = short(blocks).reshape(-1, 4, 4)
    big, small = lambda a: (a * 20091 >> 16) + a, lambda a: a * 35468 >> 16

    def half(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
        s, t = a + c, a - c
        u, v = small(b) - big(d), big(b) + small(d)
        return [s + v, t + u, t - u, s - v]

    m = np.stack(half(*(m[:, k] for k in range(4))), 1)
    m[:, :, 0] += 4
    return np.stack(half(*(m[:, :, k] for k in range(4))), 2) >> 3


def four_mode(c: Coder, p: list[int]) -> int:
    if not c.bit(p[0]):
        return B_DC
    if not c.bit(p[1]):
        return B_TM
    if not c.bit(p[2]):
        return B_VE
    if not c.bit(p[3]):
        if not c.bit(p[4]):
            return B_HE
        return B_VR if c.bit(p[5]) else B_RD
    if not c.bit(p[6]):
        return B_LD
    if not c.bit(p[7]):
        return B_VL
    return B_HU if c.bit(p[8]) else B_HD


def read_modes(h: Header, tables: Tables, above: list[int], left: list[int]) -> Block:
    """above and left: the 4 x 4 modes beside the block, which are replaced by its own."""
    c = h.coder
    segment = 0
    if h.map:
        segment = 2 + c.bit(h.segment_odds[2]) if c.bit(h.segment_odds[0]) else c.bit(h.segment_odds[1])
    skip = h.skip_odds is not None and bool(c.bit(h.skip_odds))
    if not c.bit(MODE_ODDS[0]):
        mode, fours = FOURS, []
        for y in range(4):
            for x in range(4):
                m = four_mode(c, tables.modes[above[x]][left[y]])
                above[x] = left[y] = m
                fours.append(m)
    else:
        if not c.bit(MODE_ODDS[1]):
            mode = VERTICAL if c.bit(MODE_ODDS[2]) else DC
        else:
            mode = TRUE_MOTION if c.bit(MODE_ODDS[3]) else HORIZONTAL
        above[:], left[:], fours = [AS_FOURS[mode]] * 4, [AS_FOURS[mode]] * 4, []
    chroma = DC if not c.bit(CHROMA_ODDS[0]) else VERTICAL if not c.bit(CHROMA_ODDS[1]) else TRUE_MOTION if c.bit(CHROMA_ODDS[2]) else HORIZONTAL
    return Block(mode, fours, chroma, segment, skip)


def read_residuals(h: Header, c: Coder, b: Block, above: list[int], left: list[int]) -> None:
    """above and left: whether the blocks beside are coded, of 4 luma, 2 U, 2 V and one second-order place."""
    if not b.skip:
        luma_steps, second_steps, chroma_steps = h.steps[b.segment]
        luma, chromas = [[0] * 16 for _ in range(16)], [[0] * 16 for _ in range(8)]
        second, n2 = [0] * 16, 0
        if b.mode != FOURS:
            n2 = coefficients(c, second, h.odds[1], 0, above[8] + left[8], second_steps)
            above[8] = left[8] = int(n2 > 0)
        odds, first = (h.odds[3], 0) if b.mode == FOURS else (h.odds[0], 1)
        coded, some = [], 0
        for k in range(16):
            x, y = k & 3, k >> 2
            n = coefficients(c, luma[k], odds, first, above[x] + left[y], luma_steps)
            above[x] = left[y] = int(n > 0)
            coded.append(n)
            some |= n
        for k in range(8):
            x, y = 4 + 2 * (k >> 2) + (k & 1), 4 + 2 * (k >> 2) + (k >> 1 & 1)
            n = coefficients(c, chromas[k], h.odds[2], 0, above[x] + left[y], chroma_steps)
            above[x] = left[y] = int(n > 0)
            some |= n
        b.luma, b.chromas, b.coded = np.array(luma), np.array(chromas), coded
        if n2:
            b.luma[:, 0] = second_order(second)
        elif not some:
            b.skip = True
    if b.skip:
        keep = b.mode == FOURS
        for row in (above, left):
            row[:8] = [0] * 8
            row[8] = row[8] if keep else 0


def predict_whole(p: np.ndarray, y: int, x: int, size: int, mode: int, top: bool, side: bool) -> None:
    """Fills the block at (y, x) of a bordered plane; top and side: whether blocks stand there."""
    above, left, out = p[y - 1, x : x + size], p[y : y + size, x - 1], p[y : y + size, x : x + size]
    if mode == DC:
        total, n = (above.sum() if top else 0) + (left.sum() if side else 0), size * (top + side)
        out[:] = (total + n // 2) // n if n else 128
    elif mode == VERTICAL:
        out[:] = above[None]
    elif mode == HORIZONTAL:
        out[:] = left[:, None].copy()
    else:
        out[:] = np.clip(left[:, None] + above[None] - p[y - 1, x - 1], 0, 255)


def predict_four(above: list[int], left: list[int], corner: int, mode: int) -> list[int]:
    """16 samples in row order; above has eight."""
    a, l, c = above, left, corner
    two, three = lambda u, v: u + v + 1 >> 1, lambda u, v, w: u + 2 * v + w + 2 >> 2
    if mode == B_DC:
        return [sum(a[:4]) + sum(l) + 4 >> 3] * 16
    if mode == B_TM:
        return [held(l[y] + a[x] - c, 255) for y in range(4) for x in range(4)]
    if mode == B_VE:
        e = [c, *a]
        return [three(e[x], e[x + 1], e[x + 2]) for x in range(4)] * 4
    if mode == B_HE:
        e = [c, *l, l[3]]
        return [three(e[y], e[y + 1], e[y + 2]) for y in range(4) for _ in range(4)]
    if mode == B_LD:
        e = [*a, a[7]]
        d = [three(e[k], e[k + 1], e[k + 2]) for k in range(7)]
        return [d[x + y] for y in range(4) for x in range(4)]
    if mode == B_VL:
        even, odd = [two(a[k], a[k + 1]) for k in range(4)], [three(a[k], a[k + 1], a[k + 2]) for k in range(6)]
        rows = [even, odd[:4], [*even[1:], odd[4]], [*odd[1:4], odd[5]]]
        return [v for r in rows for v in r]
    if mode == B_HU:
        d = [two(l[0], l[1]), three(l[0], l[1], l[2]), two(l[1], l[2]), three(l[1], l[2], l[3]), two(l[2], l[3]), three(l[2], l[3], l[3]), *[l[3]] * 4]
        return [d[2 * y + x] for y in range(4) for x in range(4)]
    # along the edge from below on the left to the right above
    e = [*l[::-1], c, *a[:4]]
    mid = [three(e[k], e[k + 1], e[k + 2]) for k in range(7)]
    if mode == B_RD:
        return [mid[3 - y + x] for y in range(4) for x in range(4)]
    if mode == B_VR:
        even, odd = [two(e[k], e[k + 1]) for k in range(4, 8)], mid[3:7]
        return [*even, *odd, mid[2], *even[:3], mid[1], *odd[:3]]
    pairs = [two(e[k], e[k + 1]) for k in range(4)]  # B_HD
    d = [pairs[0], mid[0], pairs[1], mid[1], pairs[2], mid[2], pairs[3], mid[3], mid[4], mid[5]]
    return [d[2 * (3 - y) + x] for y in range(4) for x in range(4)]


def reconstruct(planes: list[np.ndarray], b: Block, by: int, bx: int, last: bool) -> None:
    luma = planes[0]
    y0, x0 = 16 * by + 1, 16 * bx + 1
    residual = inverse(b.luma) if not b.skip and b.luma is not None else None
    if b.mode != FOURS:
        predict_whole(luma, y0, x0, 16, b.mode, by > 0, bx > 0)
        if residual is not None:
            part = luma[y0 : y0 + 16, x0 : x0 + 16]
            part[:] = np.clip(part + residual.reshape(4, 4, 4, 4).transpose(0, 2, 1, 3).reshape(16, 16), 0, 255)
    else:
        beyond = [int(luma[y0 - 1, x0 + 15])] * 4 if last and by else luma[y0 - 1, x0 + 16 : x0 + 20].tolist()
        for k, mode in enumerate(b.fours):
            y, x = y0 + 4 * (k >> 2), x0 + 4 * (k & 3)
            above = luma[y - 1, x : x + 4].tolist() + (beyond if k & 3 == 3 else luma[y - 1, x + 4 : x + 8].tolist())
            four = np.array(predict_four(above, luma[y : y + 4, x - 1].tolist(), int(luma[y - 1, x - 1]), mode)).reshape(4, 4)
            luma[y : y + 4, x : x + 4] = four if residual is None or not b.coded[k] else np.clip(four + residual[k], 0, 255)
    y0, x0 = 8 * by + 1, 8 * bx + 1
    residual = inverse(b.chromas) if residual is not None else None
    for k in (0, 1):
        p = planes[1 + k]
        predict_whole(p, y0, x0, 8, b.chroma, by > 0, bx > 0)
        if residual is not None:
            part = p[y0 : y0 + 8, x0 : x0 + 8]
            part[:] = np.clip(part + residual[4 * k : 4 * k + 4].reshape(2, 2, 4, 4).transpose(0, 2, 1, 3).reshape(8, 8), 0, 255)


def byte(v: np.ndarray) -> np.ndarray:
    return np.clip(v, -128, 127)


def soften(w: np.ndarray, near: np.ndarray, four: np.ndarray) -> None:
    """The common filter on the columns p1, p0, q0, q1 (2 to 5 of w) of the rows `near`; where `four`, it takes p1 and q1 into account and leaves them."""
    p1, p0, q0, q1 = (w[:, k] for k in (2, 3, 4, 5))
    a = byte(3 * (q0 - p0) + np.where(four, byte(p1 - q1), 0))
    f1, f2 = np.minimum(a + 4, 127) >> 3, np.minimum(a + 3, 127) >> 3
    outer = np.where(four, 0, f1 + 1 >> 1)
    new = np.clip(np.stack([p1 + outer, p0 + f2, q0 - f1, q1 - outer], 1), 0, 255)
    w[near, 2:6] = new[near]


def edge(w: np.ndarray, limit: int, interior: int, threshold: int, inner: bool) -> None:
    """Filters across an edge: w has the eight samples p3 to q3 of each line."""
    d = np.abs(np.diff(w, axis=1))
    near = 2 * d[:, 3] + (np.abs(w[:, 2] - w[:, 5]) >> 1) <= limit
    near &= (d[:, [0, 1, 2, 4, 5, 6]] <= interior).all(1)
    if not near.any():
        return
    steep = (d[:, 2] > threshold) | (d[:, 4] > threshold)
    if inner:
        soften(w, near, steep)
        return
    old = w.copy()
    soften(w, near & steep, steep)
    flat = near & ~steep
    a = byte(byte(old[:, 2] - old[:, 5]) + 3 * (old[:, 4] - old[:, 3]))
    for k, weight in ((1, 9), (2, 18), (3, 27)):
        v = weight * a + 63 >> 7
        w[flat, k] = np.clip(old[:, k] + v, 0, 255)[flat]
        w[flat, 7 - k] = np.clip(old[:, 7 - k] - v, 0, 255)[flat]


def simple_edge(w: np.ndarray, limit: int) -> None:
    near = 2 * np.abs(w[:, 3] - w[:, 4]) + (np.abs(w[:, 2] - w[:, 5]) >> 1) <= limit
    soften(w, near, np.ones(len(w), bool))


def filter_block(planes: list[np.ndarray], level: int, interior: int, inner: bool, simple: bool, by: int, bx: int) -> None:
    """Left edge, inner upright edges, top edge, inner level edges; none on the picture's border."""
    limit, threshold = 2 * level + interior, (level >= 15) + (level >= 40)
    for plane, size in zip(planes, (16, 8, 8), strict=True):
        if simple and size == 8:
            break
        y, x = size * by, size * bx
        for upright in (True, False):
            for k in range(0, size if inner else 1, 4):
                if k == 0 and (bx if upright else by) == 0:
                    continue
                w = plane[y : y + size, x + k - 4 : x + k + 4] if upright else plane[y + k - 4 : y + k + 4, x : x + size].T
                if simple:
                    simple_edge(w, limit + (4 if k == 0 else 0))
                else:
                    edge(w, limit + (4 if k == 0 else 0), interior, threshold, k > 0)


@dataclass
class Planes:
    y: np.ndarray
    u: np.ndarray
    v: np.ndarray
    warnings: list[str]


def decode_blocks(data: bytes, tables: Tables | None, bypass_filter: bool, total: int | None = None) -> tuple[Planes, int]:
    """Planes, and how many rows of samples are final; with `total`, data may be the first part of a frame of that size."""
    if tables is None:
        raise CodecError(UNSUPPORTED, "no tables of probabilities given")
    h = Header(data, tables, total)
    across, down = -(-h.width // 16), -(-h.height // 16)
    planes = []
    for size in (16, 8, 8):  # a row of 127 above, a column of 129 on the left; the corner belongs to the row
        p = np.full((size * down + 1, size * across + 1 + 4), 127, np.int64)
        p[1:, 0] = 129
        planes.append(p)
    modes_above, coded_above = [[B_DC] * 4 for _ in range(across)], [[0] * 9 for _ in range(across)]
    filters, done = [], 0
    for by in range(down):
        modes_left, coded_left = [B_DC] * 4, [0] * 9
        part = h.parts[by % len(h.parts)]
        own = []
        for bx in range(across):
            b = read_modes(h, tables, modes_above[bx], modes_left)
            read_residuals(h, part, b, coded_above[bx], coded_left)
            if h.coder.over or part.over:
                break
            reconstruct(planes, b, by, bx, bx == across - 1)
            own.append((*h.filters[b.segment][b.mode == FOURS], b.mode == FOURS or not b.skip))
        if h.coder.over or part.over:
            if total is None:
                raise invalid("blocks past the end of the data")
            break
        filters += own
        done += 1
    planes = [p[1:, 1:-4] for p in planes]
    some = not bypass_filter and any(level for both in h.filters for level, _ in both)
    if some:
        for k, (level, interior, inner) in enumerate(filters):
            if level:
                filter_block(planes, level, interior, inner, h.simple, *divmod(k, across))
    final = h.height if done == down else max(0, 16 * done - (0 if not some else 2 if h.simple else 8))
    half_w, half_h = h.width + 1 >> 1, h.height + 1 >> 1
    y, u, v = (p.astype(np.uint8) for p in planes)
    return Planes(y[: h.height, : h.width].copy(), u[:half_h, :half_w].copy(), v[:half_h, :half_w].copy(), h.warnings), final


def decode(data: bytes, tables: Tables | None, bypass_filter: bool = False) -> Planes:
    """Planes of uint8; U and V have half the size, rounded up."""
    return decode_blocks(data, tables, bypass_filter)[0]


def decode_rows(data: bytes, total: int, tables: Tables | None) -> tuple[Planes, int]:
    """Of the first part of a frame of `total` bytes, planes as far as they go and the number of final rows (what a filter may still change is not)."""
    return decode_blocks(data, tables, False, total)
