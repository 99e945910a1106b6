"""Lossless bitstreams to ARGB pixels.

Pixels are 32-bit numbers, alpha highest. Entropy decoding and mixed predictors are sequential, so they run over Python integers;
colour transforms and palettes, which are not, run over numpy arrays.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from tessellar.status import CodecError, TOO_LARGE, invalid

#: The order in which the lengths of the length code are sent, and the alphabets of green, red, blue, alpha, distance.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
ALPHABETS = (256 + 24, 256, 256, 256, 40)
CACHE_FACTOR = 0x1E35A7BD
BLACK = 0xFF000000
PREDICTOR, COLOR, GREEN, PALETTE = range(4)


def short_distances() -> list[tuple[int, int]]:
    """The 120 places (left, up) that have codes of their own, nearest first; of equally near ones the least sideways, then the left one."""
    near = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return sorted(near, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


SHORT = short_distances()


class Bits:
    """Least significant bit first. Past the end there are zeros, and `over` says so."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def fill(self) -> None:
        part = self.data[self.at : self.at + 8]
        self.held |= int.from_bytes(part, "little") << self.n
        self.n += 64
        self.at += 8

    def read(self, n: int) -> int:
        if self.n < n:
            self.fill()
        out = self.held & ((1 << n) - 1)
        self.held >>= n
        self.n -= n
        return out

    @property
    def over(self) -> bool:
        return 8 * self.at - self.n > 8 * len(self.data)


@dataclass
class Code:
    """A prefix code as a table of the next `bits` bits: (symbol << 4 | length)."""

    bits: int
    table: list[int]

    def read(self, b: Bits) -> int:
        if b.n < 15:
            b.fill()
        v = self.table[b.held & ((1 << self.bits) - 1)]
        n = v & 15
        b.held >>= n
        b.n -= n
        return v >> 4


def build(lengths: list[int]) -> Code:
    """The canonical code: symbols by length, then by number. One symbol alone takes no bits; any other code must be complete."""
    used = [(n, s) for s, n in enumerate(lengths) if n]
    if not used:
        raise invalid("a prefix code without symbols")
    if len(used) == 1:
        return Code(0, [used[0][1] << 4])
    longest = max(n for n, _ in used)
    if sum(1 << (longest - n) for n, _ in used) != 1 << longest:
        raise invalid("a prefix code that is not complete")
    table, code, last = [0] * (1 << longest), 0, 0
    for n, s in sorted(used):
        code <<= n - last
        last = n
        turned = int(f"{code:0{n}b}"[::-1], 2)
        table[turned :: 1 << n] = [s << 4 | n] * (1 << (longest - n))
        code += 1
    return Code(longest, table)


def read_code(b: Bits, alphabet: int) -> Code:
    lengths = [0] * alphabet
    if b.read(1):
        two = b.read(1)
        symbols = [b.read(8 if b.read(1) else 1)]
        if two:
            symbols.append(b.read(8))
        for s in symbols:
            if s < alphabet:
                lengths[s] = 1
    else:
        own = [0] * len(LENGTH_ORDER)
        for k in range(4 + b.read(4)):
            own[LENGTH_ORDER[k]] = b.read(3)
        left = alphabet
        if b.read(1):
            left = 2 + b.read(2 + 2 * b.read(3))
            if left > alphabet:
                raise invalid("more code lengths than symbols")
        code, at, before = build(own), 0, 8
        while at < alphabet and left and not b.over:
            left -= 1
            n = code.read(b)
            if n < 16:
                lengths[at] = n
                at += 1
                before = n or before
                continue
            times, n = ((3 + b.read(2), before), (3 + b.read(3), 0), (11 + b.read(7), 0))[n - 16]
            if at + times > alphabet:
                raise invalid("a repeat past the last symbol")
            lengths[at : at + times] = [n] * times
            at += times
    if b.over:
        raise invalid("a prefix code past the end of the data")
    return build(lengths)


@dataclass
class Image:
    """What an entropy-coded image's header tells."""

    width: int
    height: int
    groups: list[list[Code]]
    cache_bits: int
    tile_bits: int = 0
    tiles: list[int] = field(default_factory=list)  # of each tile, its group


def ceil_shift(v: int, n: int) -> int:
    return -(-v >> n)


def read_header(b: Bits, width: int, height: int, main: bool) -> Image:
    cache = 0
    if b.read(1):
        cache = b.read(4)
        if not 1 <= cache <= 11:
            raise invalid("colour cache bits")
    bits, tiles, wanted = 0, [], range(1)
    if main and b.read(1):
        bits = b.read(3) + 2
        side = read_image(b, ceil_shift(width, bits), ceil_shift(height, bits), False)
        tiles = [p >> 8 & 0xFFFF for p in side]
        wanted = range(max(tiles) + 1)
    used = set(tiles) or {0}
    groups = []
    for k in wanted:  # groups of no tile are read and checked too
        group = [read_code(b, n + (1 << cache if cache and not j else 0)) for j, n in enumerate(ALPHABETS)]
        groups.append(group if k in used else [])
    return Image(width, height, groups, cache, bits, tiles)


def prefix_value(b: Bits, symbol: int) -> int:
    """A length or distance from its prefix symbol and extra bits."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + b.read(extra) + 1


def read_pixels(b: Bits, head: Image, partial: bool = False) -> list[int]:
    """partial: where the data end early, the pixels that were read before that."""
    width, total = head.width, head.width * head.height
    out: list[int] = []
    cache_bits = head.cache_bits
    cache = [0] * (1 << cache_bits) if cache_bits else None
    shift = 32 - cache_bits
    mask = (1 << head.tile_bits) - 1 if head.tiles else -1
    across = ceil_shift(width, head.tile_bits)
    green, red, blue, alpha, far = head.groups[0] or [None] * 5
    x = y = n = good = 0
    fresh = True
    while n < total:
        if fresh or (mask > 0 and not x & mask):
            if head.tiles:
                green, red, blue, alpha, far = head.groups[head.tiles[(y >> head.tile_bits) * across + (x >> head.tile_bits)]]
            fresh = False
        s = green.read(b)
        if s < 256:
            r = red.read(b)
            p = s << 8 | r << 16 | blue.read(b)
            p |= alpha.read(b) << 24
            out.append(p)
            if cache is not None:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> shift] = p
            n += 1
            x += 1
        elif s < 280:
            length = prefix_value(b, s - 256)
            symbol = far.read(b)
            if symbol > 39:
                raise invalid("distance symbol")
            code = prefix_value(b, symbol)
            if code <= len(SHORT):
                dx, dy = SHORT[code - 1]
                distance = max(1, dx + dy * width)
            else:
                distance = code - len(SHORT)
            if distance > n or length > total - n:
                raise invalid("a reference out of the image")
            if distance >= length:
                part = out[n - distance : n - distance + length]
            else:
                part = out[n - distance :]
                part = (part * (length // distance + 1))[:length]
            out += part
            if cache is not None:
                for p in part:
                    cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> shift] = p
            n += length
            x += length
            fresh = True
        else:
            if cache is None or s - 280 >= len(cache):
                raise invalid("colour cache index")
            p = cache[s - 280]
            out.append(p)
            cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> shift] = p
            n += 1
            x += 1
        if x >= width:
            y += x // width
            x %= width
            if b.over:
                break
            good = n
    if b.over and partial:
        return out[: good // width * width]
    if b.over:
        raise invalid("pixels past the end of the data")
    return out


def read_image(b: Bits, width: int, height: int, main: bool) -> list[int]:
    return read_pixels(b, read_header(b, width, height, main))


def add(p: int, q: int) -> int:
    """Bytewise sum modulo 256."""
    return ((p & 0xFF00FF00) + (q & 0xFF00FF00) & 0xFF00FF00) | ((p & 0xFF00FF) + (q & 0xFF00FF) & 0xFF00FF)


def mean(p: int, q: int) -> int:
    return (((p ^ q) & 0xFEFEFEFE) >> 1) + (p & q)


def select(left: int, top: int, corner: int) -> int:
    """Of left and top the one nearer to left + top - corner; top if equally near."""
    to_left = to_top = 0
    for k in (0, 8, 16, 24):
        l, t, c = left >> k & 255, top >> k & 255, corner >> k & 255
        to_left += abs(t - c)
        to_top += abs(l - c)
    return left if to_left < to_top else top


def clamped(left: int, top: int, corner: int) -> int:
    """left + top - corner, each byte held in range."""
    out = 0
    for k in (0, 8, 16, 24):
        out |= min(255, max(0, (left >> k & 255) + (top >> k & 255) - (corner >> k & 255))) << k
    return out


def half_clamped(left: int, top: int, corner: int) -> int:
    """mean + (mean - corner) / 2, the quotient towards zero."""
    m, out = mean(left, top), 0
    for k in (0, 8, 16, 24):
        a = m >> k & 255
        d = a - (corner >> k & 255)
        out |= min(255, max(0, a + (d // 2 if d >= 0 else -(-d // 2)))) << k
    return out


#: By mode, a prediction of (left, top, corner, top right).
PREDICTORS = (
    lambda l, t, c, r: BLACK,
    lambda l, t, c, r: l,
    lambda l, t, c, r: t,
    lambda l, t, c, r: r,
    lambda l, t, c, r: c,
    lambda l, t, c, r: mean(mean(l, r), t),
    lambda l, t, c, r: mean(l, c),
    lambda l, t, c, r: mean(l, t),
    lambda l, t, c, r: mean(c, t),
    lambda l, t, c, r: mean(t, r),
    lambda l, t, c, r: mean(mean(l, c), mean(t, r)),
    lambda l, t, c, r: select(l, t, c),
    lambda l, t, c, r: clamped(l, t, c),
    lambda l, t, c, r: half_clamped(l, t, c),
)


def unpredict(pixels: list[int], width: int, height: int, bits: int, tiles: list[int]) -> list[int]:
    """Adds each pixel's prediction. The first row predicts from the left, the first column from above; past the right edge stands the row's first pixel."""
    out = list(pixels)
    out[0] = add(out[0], BLACK)
    for i in range(1, width):
        out[i] = add(out[i], out[i - 1])
    across = ceil_shift(width, bits)
    for y in range(1, height):
        start = y * width
        out[start] = add(out[start], out[start - width])
        row = (y >> bits) * across
        for tile in range(across):
            mode = tiles[row + tile] >> 8 & 255
            lo, hi = max(1, tile << bits), min(width, (tile + 1) << bits)
            if lo >= hi:
                continue
            if mode > 13:
                raise invalid("predictor mode")
            predict = PREDICTORS[mode]
            for i in range(start + lo, start + hi):
                up = i - width
                out[i] = add(out[i], predict(out[i - 1], out[up], out[up - 1], out[up + 1]))
    return out


def spread(tiles: list[int], width: int, height: int, bits: int) -> np.ndarray:
    """A tile image at the size of the pixels."""
    t = np.array(tiles, np.int64).reshape(-1, ceil_shift(width, bits))
    return t[np.arange(height)[:, None] >> bits, np.arange(width)[None] >> bits]


def signed(v: np.ndarray) -> np.ndarray:
    return (v & 255 ^ 128) - 128


def uncolor(pixels: list[int], width: int, height: int, bits: int, tiles: list[int]) -> list[int]:
    p = np.array(pixels, np.int64).reshape(height, width)
    t = spread(tiles, width, height, bits)
    green = signed(p >> 8)
    red = (p >> 16) + (signed(t) * green >> 5) & 255
    blue = p + (signed(t >> 8) * green >> 5) + (signed(t >> 16) * signed(red) >> 5) & 255
    return (p & 0xFF00FF00 | red << 16 | blue).ravel().tolist()


def add_green(pixels: list[int]) -> list[int]:
    p = np.array(pixels, np.int64)
    g = p >> 8 & 255
    return (p & 0xFF00FF00 | (p & 0xFF00FF) + (g << 16 | g) & 0xFF00FF).tolist()


def unpalette(pixels: list[int], width: int, height: int, bits: int, palette: list[int]) -> list[int]:
    """Indices (several in a pixel's green, low bits first) to colours; an index past the palette gives 0."""
    p = np.array(pixels, np.int64).reshape(height, -1) >> 8 & 255
    size = 8 >> bits
    x = np.arange(width)
    index = p[:, x >> bits] >> size * (x & (1 << bits) - 1) & (1 << size) - 1
    table = np.zeros(256, np.int64)
    table[: len(palette)] = palette
    return table[index].ravel().tolist()


def read_transforms(b: Bits, width: int, height: int) -> tuple[list[tuple], int]:
    """(kind, width, bits, side image) of each transform in reading order, and the width of the coded image."""
    out, now = [], width
    while b.read(1):
        kind = b.read(2)
        if any(kind == k for k, *_ in out):
            raise invalid("a transform used twice")
        if kind in (PREDICTOR, COLOR):
            bits = b.read(3) + 2
            out.append((kind, now, bits, read_image(b, ceil_shift(now, bits), ceil_shift(height, bits), False)))
        elif kind == GREEN:
            out.append((kind, now, 0, []))
        else:
            size = b.read(8) + 1
            palette = read_image(b, size, 1, False)
            for k in range(1, size):
                palette[k] = add(palette[k], palette[k - 1])
            bits = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            out.append((kind, now, bits, palette))
            now = ceil_shift(now, bits)
    return out, now


def decode_body(b: Bits, width: int, height: int, partial: bool = False) -> np.ndarray:
    """partial: only the rows that the data reach."""
    transforms, now = read_transforms(b, width, height)
    pixels = read_pixels(b, read_header(b, now, height, True), partial)
    if partial:
        height = len(pixels) // now
        if not height:
            return np.zeros((0, width), np.uint32)
    for kind, own, bits, side in reversed(transforms):
        if kind == PREDICTOR:
            pixels = unpredict(pixels, own, height, bits, side)
        elif kind == COLOR:
            pixels = uncolor(pixels, own, height, bits, side)
        elif kind == GREEN:
            pixels = add_green(pixels)
        else:
            pixels = unpalette(pixels, own, height, bits, side)
    return np.array(pixels, np.uint32).reshape(height, width)


def decode(data: bytes) -> tuple[np.ndarray, bool]:
    """(height, width) ARGB pixels and whether the header declares alpha; without it pixels are opaque as coded."""
    b = Bits(data)
    if b.read(8) != 0x2F:
        raise invalid("lossless signature")
    width, height = b.read(14) + 1, b.read(14) + 1
    if width > 16384 or height > 16384:
        raise CodecError(TOO_LARGE)
    alpha = bool(b.read(1))
    if b.read(3):
        raise invalid("lossless version")
    return decode_body(b, width, height), alpha


def decode_rows(data: bytes) -> tuple[np.ndarray, int]:
    """Of a part of a bitstream, the pixels as far as they go (0 below) and the number of final rows."""
    b = Bits(data)
    if b.read(8) != 0x2F:
        raise invalid("lossless signature")
    width, height = b.read(14) + 1, b.read(14) + 1
    if b.read(4) >> 1:
        raise invalid("lossless version")
    rows = decode_body(b, width, height, True)
    return np.pad(rows, ((0, height - len(rows)), (0, 0))), len(rows)


def decode_alpha(data: bytes, width: int, height: int) -> np.ndarray:
    """An alpha plane: the green of a lossless image without a header."""
    return (decode_body(Bits(data), width, height) >> 8 & 255).astype(np.uint8)
