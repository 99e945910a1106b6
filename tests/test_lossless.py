"""The lossless decoder against an encoder of its own, with predictors and transforms worked out pixel by pixel here."""

import random

import numpy as np
import pytest

import webp
from tessellar.codecs import vp8l
from tessellar.status import CodecError


def channels(p):
    return [p >> k & 255 for k in (24, 16, 8, 0)]


def joined(c):
    return sum((v & 255) << k for v, k in zip(c, (24, 16, 8, 0)))


def predicted(mode, l, t, c, r):
    """The format's fourteen predictions, by channel."""
    L, T, C, R = map(channels, (l, t, c, r))
    avg = lambda a, b: [(x + y) // 2 for x, y in zip(a, b)]
    clip = lambda v: max(0, min(255, v))
    if mode == 11:
        guess = [x + y - z for x, y, z in zip(L, T, C)]
        far = lambda s: sum(abs(x - y) for x, y in zip(guess, s))
        return joined(L if far(L) < far(T) else T)
    if mode == 13:
        return joined([clip(a + int((a - z) / 2)) for a, z in zip(avg(L, T), C)])
    table = {0: [255, 0, 0, 0], 1: L, 2: T, 3: R, 4: C, 5: avg(avg(L, R), T), 6: avg(L, C), 7: avg(L, T), 8: avg(C, T), 9: avg(T, R), 10: avg(avg(L, C), avg(T, R)), 12: [clip(x + y - z) for x, y, z in zip(L, T, C)]}
    return joined(table[mode])


def residuals(pixels, width, height, bits, modes):
    across, out = -(-width // (1 << bits)), []
    for i, p in enumerate(pixels):
        y, x = divmod(i, width)
        if i == 0:
            g = 0xFF000000
        elif y == 0:
            g = pixels[i - 1]
        elif x == 0:
            g = pixels[i - width]
        else:
            g = predicted(modes[(y >> bits) * across + (x >> bits)], pixels[i - 1], pixels[i - width], pixels[i - width - 1], pixels[i - width + 1])
        out.append(joined([a - b for a, b in zip(channels(p), channels(g))]))
    return out


def image(rng, n, smooth=False):
    return [rng.getrandbits(32) if not smooth else 0xFF000000 | rng.choice((0x102030, 0x112131, 0xF0E0D0)) for _ in range(n)]


def decoded(data):
    return vp8l.decode(data)[0].ravel().tolist()


def test_one_pixel():
    argb, alpha = vp8l.decode(webp.ONE_PIXEL[20:])
    assert argb.shape == (1, 1) and not alpha


def test_nearest_distances():
    assert vp8l.SHORT[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)]
    assert len(set(vp8l.SHORT)) == 120 and vp8l.SHORT[-3:] == [(-7, 7), (8, 6), (8, 7)]


@pytest.mark.parametrize("size", [(1, 1), (1, 9), (9, 1), (17, 5), (64, 33)])
def test_literals(size):
    p = image(random.Random(size[0]), size[0] * size[1])
    assert decoded(webp.lossless(*size, webp.literals(p))) == p


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    rng = random.Random(mode)
    p = image(rng, 13 * 9, mode % 2)
    tiles = [0xFF000000 | mode << 8] * (4 * 3)
    data = webp.lossless(13, 9, webp.literals(residuals(p, 13, 9, 2, [mode] * 12)), [webp.tile_transform(0, 2, tiles)])
    assert decoded(data) == p


def test_all_transforms_together():
    rng = random.Random(5)
    w, h = 21, 14
    p = image(rng, w * h)
    modes = [rng.randrange(14) for _ in range(6 * 4)]
    multipliers = [rng.getrandbits(24) for _ in range(3 * 2)]
    now = residuals(p, w, h, 2, modes)
    s8 = lambda v: (v & 255 ^ 128) - 128
    out = []
    for i, v in enumerate(now):  # colour transform, then green from red and blue
        a, r, g, b = channels(v)
        m = multipliers[(i // w >> 3) * 3 + (i % w >> 3)]
        nb = b - (s8(m >> 8) * s8(g) >> 5) - (s8(m >> 16) * s8(r) >> 5)
        nr = r - (s8(m) * s8(g) >> 5)
        out.append(joined([a, nr - g, g, nb - g]))
    transforms = [webp.tile_transform(0, 2, [0xFF000000 | m << 8 for m in modes]), webp.tile_transform(1, 3, [0xFF000000 | m for m in multipliers]), webp.green_transform]
    assert decoded(webp.lossless(w, h, webp.literals(out), transforms)) == p


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200])
def test_palettes(colours):
    rng = random.Random(colours)
    w, h = 19, 6
    table = image(rng, colours)
    index = [rng.randrange(colours) for _ in range(w * h)]
    bits = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    per, size = 1 << bits, 8 >> bits
    packed = []
    for y in range(h):
        row = index[y * w : (y + 1) * w]
        packed += [0xFF000000 | sum(v << (size * k) for k, v in enumerate(row[x : x + per])) << 8 for x in range(0, w, per)]
    assert decoded(webp.lossless(w, h, webp.literals(packed), [webp.palette_transform(table)])) == [table[i] for i in index]


def test_index_past_the_palette():
    packed = [0xFF000000 | 2 << 8]
    assert decoded(webp.lossless(1, 1, webp.literals(packed), [webp.palette_transform([1, 2, 3])])) == [3]
    assert decoded(webp.lossless(1, 1, webp.literals([0xFF000000 | 3 << 8]), [webp.palette_transform([1, 2, 3])])) == [0]


def test_references_and_cache():
    rng = random.Random(9)
    w, h, bits = 30, 20, 4
    out, tokens, cache = [], [], [0] * 16
    while len(out) < w * h:
        kind = rng.random()
        if kind < 0.35 or not out:
            p = rng.choice(out) if out and rng.random() < 0.5 else rng.getrandbits(32)
            slot = webp.cache_slot(p, bits)
            tokens.append(("c", slot) if cache[slot] == p and p else ("p", p))
            out.append(p)
            cache[slot] = p
        else:
            n = min(rng.choice((1, 2, 3, 5, 40, 200)), w * h - len(out))
            code = rng.choice((1, 2, 3, 4, 7, 100, 120, 121, 125, 400))
            if code <= 120:
                x, y = vp8l.SHORT[code - 1]
                far = max(1, x + y * w)
            else:
                far = code - 120
            if far > len(out):
                continue
            tokens.append(("r", n, code))
            for _ in range(n):
                out.append(out[-far])
                cache[webp.cache_slot(out[-1], bits)] = out[-1]
    assert decoded(webp.lossless(w, h, tokens, cache_bits=bits)) == out


def test_groups():
    rng = random.Random(3)
    w, h = 23, 11
    p = image(rng, w * h)
    tiles = [rng.choice((0, 1, 4)) for _ in range(6 * 3)]
    assert decoded(webp.lossless(w, h, webp.literals(p), groups=(2, tiles, w))) == p


def test_alpha_image():
    rng = random.Random(4)
    plane = np.array([[rng.randrange(256) for _ in range(7)] for _ in range(5)])
    data = webp.lossless(7, 5, webp.literals((0xFF000000 | plane << 8).ravel()), header=False)
    assert (vp8l.decode_alpha(data, 7, 5) == plane).all()


def status(data):
    with pytest.raises(CodecError) as e:
        vp8l.decode(data)
    return e.value.status


def test_broken():
    rng = random.Random(1)
    p = image(rng, 64)
    good = webp.lossless(8, 8, webp.literals(p))
    assert status(b"\x2e" + good[1:]) == "invalid_data"
    assert status(good[:4] + bytes([good[4] | 0x20]) + good[5:]) == "invalid_data"
    for cut in range(5, len(good) - 4, 37):
        assert status(good[:cut]) == "invalid_data"
    assert status(webp.lossless(8, 8, webp.literals(p), [webp.green_transform] * 2)) == "invalid_data"
    assert status(webp.lossless(8, 8, [("r", 64, 1)])) == "invalid_data"
    assert status(webp.lossless(8, 8, [("p", 1), ("r", 70, 2)])) == "invalid_data"
    tiles = [0xFF000000 | 14 << 8] * 4
    assert status(webp.lossless(8, 8, webp.literals(p), [webp.tile_transform(0, 2, tiles)])) == "invalid_data"


def test_codes():
    assert vp8l.build([0, 3, 0]).table == [1 << 4]
    for bad in ([0, 0], [1, 1, 1], [1, 2]):
        with pytest.raises(CodecError):
            vp8l.build(bad)


def test_noise_never_crashes():
    rng = random.Random(2)
    good = webp.lossless(9, 7, webp.literals(image(rng, 63)), [webp.green_transform], cache_bits=3)
    for _ in range(300):
        data = bytearray(good)
        for _ in range(rng.randrange(1, 6)):
            data[rng.randrange(5, len(data))] = rng.randrange(256)
        try:
            vp8l.decode(bytes(data))
        except CodecError:
            pass
