"""Pictures of files: composition against a plain painter, formats, options and statuses."""

import random

import numpy as np
import pytest

import vp8_encoder as E
import webp
from tessellar.codecs import frames, pixels, vp8
from tessellar.operators import decode as D
from tessellar.options import SUBFRAME, Options
from tessellar.sources import riff
from tessellar.status import CodecError

T = E.tables()
TABLES = vp8.Tables(T["modes"], T["coefficients"], T["updates"])


def lossless(rng, w, h, alpha=True, flat=False):
    p = [rng.choice((0, 255, 255, rng.randrange(256))) << 24 | rng.getrandbits(24) for _ in range(w * h)]
    if not alpha:
        p = [0xFF000000 | v for v in p]
    return np.array(p, np.uint32).reshape(h, w), webp.chunk("VP8L", webp.lossless(w, h, webp.literals(p), alpha=alpha))


def lossy(rng, w, h):
    from test_lossy import blocks

    return webp.chunk("VP8 ", E.encode(w, h, blocks(rng, w, h, 0.1, top=20), T, quant=30, level=10))


def animation(rng, n, w=16, h=12):
    parts, told = [], []
    for _ in range(n):
        fw, fh = (w, h) if rng.random() < 0.3 else (rng.randrange(1, w), rng.randrange(1, h))
        x, y = 2 * rng.randrange((w - fw) // 2 + 1), 2 * rng.randrange((h - fh) // 2 + 1)
        flags, alpha = rng.randrange(4), rng.random() < 0.7
        p, c = lossless(rng, fw, fh, alpha)
        parts.append(webp.anmf(x, y, fw, fh, rng.randrange(100), flags, c))
        told.append((x, y, fw, fh, flags, alpha, p))
    return webp.riff(webp.vp8x(w, h, 2 | 16), webp.anim(0x01020304, 2), *parts), told


def over(s, d):
    """Straight blending of two pixels as numbers."""
    a, da = s >> 24, d >> 24
    if a in (0, 255):
        return s if a else d
    t = da * (256 - a) >> 8
    out = (a + t) << 24
    for k in (16, 8, 0):
        out |= ((s >> k & 255) * a + (d >> k & 255) * t) * ((1 << 24) // (a + t)) >> 24 << k
    return out


def painted(told, w, h):
    """Pixel by pixel: dispose of the frame before, then draw. Where it was disposed of nothing is blended."""
    canvas, before, key_before = np.zeros((h, w), np.int64), None, False
    for x, y, fw, fh, flags, alpha, p in told:
        whole = (x, y, fw, fh) == (0, 0, w, h)
        key = before is None or (whole and (flags & 2 or not alpha)) or (before[4] & 1 and (key_before or before[2:4] == (w, h)))
        gone = np.zeros((h, w), bool)
        if key:
            canvas[:] = 0
        elif before[4] & 1:
            bx, by, bw, bh = before[:4]
            canvas[by : by + bh, bx : bx + bw] = 0
            gone[by : by + bh, bx : bx + bw] = True
        for j in range(fh):
            for i in range(fw):
                v = int(p[j, i])
                at = y + j, x + i
                canvas[at] = v if key or flags & 2 or gone[at] else over(v, int(canvas[at]))
        before, key_before = (x, y, fw, fh, flags), key
        yield canvas.copy()


def numbers(planes, w, h):
    return np.frombuffer(planes[0], ">u4").reshape(h, w)


@pytest.mark.parametrize("seed", range(12))
def test_composition(seed):
    rng = random.Random(seed)
    data, told = animation(rng, 7)
    got = list(frames.decode_file(data, Options(fmt="argb")))
    for d, want in zip(got, painted(told, 16, 12), strict=True):
        assert (numbers(d.picture.planes, 16, 12) == want).all()
    assert [d.timestamp for d in got] == [sum(x.duration for x in got[:k]) for k in range(7)]


@pytest.mark.parametrize("seed", range(20))
def test_regions_tile_the_frame(seed):
    rng = random.Random(seed)
    box = lambda: frames.Placed(2 * rng.randrange(5), 2 * rng.randrange(5), rng.randrange(1, 9), rng.randrange(1, 9), rng.random() < 0.7, rng.random() < 0.2, True, False)
    for aligned in (False, True):
        f, before = box(), box()
        seen = np.zeros((f.height, f.width), int)
        for x, y, w, h, _ in frames.regions(f, f.width, f.height, before, True, aligned):
            assert min(x, y) >= 0 and min(w, h) > 0
            seen[y : y + h, x : x + w] += 1
        assert (seen == 1).all()


def test_subframes_composited_by_the_caller():
    rng = random.Random(40)
    data, told = animation(rng, 6)
    info = riff.checked(data)
    canvas = frames.Canvas(16, 12, Options(fmt="rgba"))
    whole = list(frames.decode_file(data, Options(fmt="rgba")))
    alone = list(frames.decode_file(data, Options(fmt="argb", animation=SUBFRAME)))
    for p, d, w in zip(frames.placed_frames(info), alone, whole, strict=True):
        own = pixels.argb_frame(numbers(d.picture.planes, d.picture.width, d.picture.height))
        assert frames.export(canvas.add(p, own), Options(fmt="rgba")).planes == w.picture.planes


@pytest.mark.parametrize("fmt", pixels.FORMATS)
def test_formats_have_their_sizes(fmt):
    rng = random.Random(6)
    for data in (webp.riff(lossless(rng, 7, 5)[1]), webp.riff(lossy(rng, 7, 5))):
        (d,) = frames.decode_file(data, Options(fmt=fmt), TABLES)
        assert [len(p) for p in d.picture.planes] == [a * b for a, b in pixels.plane_sizes(fmt, 7, 5)]


def test_planar_canvas():
    """Lossy frames with alpha stay planar until a lossless one comes; opaque ones give what is decoded."""
    rng = random.Random(3)
    a, b = lossy(rng, 16, 16), lossy(rng, 8, 8)
    veil = webp.chunk("ALPH", b"\0" + bytes(rng.choice((0, 255, 100)) for _ in range(64)))
    data = webp.riff(webp.vp8x(16, 16, 2 | 16), webp.anim(), webp.anmf(0, 0, 16, 16, 5, 0, a), webp.anmf(4, 6, 8, 8, 5, 0, veil, b), webp.anmf(2, 2, 8, 8, 5, 1, b), webp.anmf(0, 0, 8, 8, 5, 0, lossless(rng, 8, 8)[1]))
    got = list(frames.decode_file(data, tables=TABLES))
    assert [d.picture.fmt for d in got] == ["yuva420p"] * 3 + ["argb"]
    first = vp8.decode(a[8:], TABLES)
    assert got[0].picture.planes == [first.y.tobytes(), first.u.tobytes(), first.v.tobytes(), b"\xff" * 256]
    second = vp8.decode(b[8:], TABLES)
    y = np.frombuffer(got[1].picture.planes[0], np.uint8).reshape(16, 16)
    alpha = np.frombuffer(veil[9:73], np.uint8).reshape(8, 8)
    want = np.where(alpha == 255, second.y, np.where(alpha == 0, first.y[6:14, 4:12], 0))
    assert (y[6:14, 4:12][alpha != 100] == want[alpha != 100]).all()
    # premultiplied output has one ARGB canvas throughout
    assert all(d.picture.fmt == "rgbA" for d in frames.decode_file(data, Options(fmt="rgbA"), TABLES))


def test_alpha_chunks():
    rng = random.Random(8)
    plane = np.array([[rng.randrange(256) for _ in range(9)] for _ in range(6)])
    image = lossy(rng, 9, 6)
    for mode in range(4):
        sent = plane.copy()
        for y in range(6):
            for x in range(9):
                left, up = (int(plane[y, x - 1]) if x else None), (int(plane[y - 1, x]) if y else None)
                if mode == 0 or (x, y) == (0, 0):
                    g = 0
                elif y == 0:
                    g = left
                elif mode == 1:
                    g = left if x else up
                elif mode == 2 or x == 0:
                    g = up
                else:
                    g = max(0, min(255, left + up - int(plane[y - 1, x - 1])))
                sent[y, x] = plane[y, x] - g & 255
        raw = webp.chunk("ALPH", bytes([mode << 2]) + sent.astype(np.uint8).tobytes())
        packed = webp.chunk("ALPH", bytes([mode << 2 | 1]) + webp.lossless(9, 6, webp.literals((0xFF000000 | sent << 8).ravel()), header=False))
        for alph in (raw, packed):
            (d,) = frames.decode_file(webp.riff(webp.vp8x(9, 6, 16), alph, image), tables=TABLES)
            assert d.picture.planes[3] == plane.astype(np.uint8).tobytes()
    status = lambda *chunks: next(iter_status(webp.riff(webp.vp8x(9, 6, 16), *chunks, image)))

    def iter_status(data):
        try:
            list(frames.decode_file(data, tables=TABLES))
            yield "ok"
        except CodecError as e:
            yield e.status

    assert status(webp.chunk("ALPH", b"\x40" + b"\0" * 54)) == "invalid_data"
    assert status(webp.chunk("ALPH", b"\x20" + b"\0" * 54)) == "invalid_data"
    assert status(webp.chunk("ALPH", b"\x03" + b"\0" * 54)) == "unsupported"
    assert status(webp.chunk("ALPH", b"\0" + b"\0" * 53)) == "invalid_data"
    assert status(raw, raw) == "invalid_data"
    (d,) = frames.decode_file(webp.riff(webp.vp8x(9, 6, 0), raw, image), tables=TABLES)
    assert d.picture.fmt == "yuv420p"  # VP8X does not declare alpha


def test_options():
    rng = random.Random(2)
    p, c = lossless(rng, 9, 7, alpha=False)
    data = webp.riff(c)
    one = lambda **o: next(frames.decode_file(data, Options(**o))).picture
    assert (numbers(one(crop=(3, 1, 4, 5)).planes, 4, 5) == p[1:6, 3:7]).all()
    assert (numbers(one(flip=True).planes, 9, 7) == p[::-1]).all()
    assert (one(scale=(3, 0)).width, one(scale=(3, 0)).height) == (3, 3)
    assert one(crop=(1, 1, 4, 4), scale=(8, 2)).planes[0] == one(crop=(1, 1, 4, 4), scale=(8, 2), flip=True, fmt="argb").planes[0][32:] + one(crop=(1, 1, 4, 4), scale=(8, 2), flip=True).planes[0][:32]
    for bad in (dict(crop=(-1, 0, 1, 1)), dict(crop=(0, 0, 0, 1)), dict(crop=(5, 5, 9, 9)), dict(scale=(0, 0)), dict(scale=(-1, 4)), dict(fmt="rgbx"), dict(animation=SUBFRAME, flip=True), dict(chroma=4)):
        with pytest.raises(CodecError) as e:
            one(**bad)
        assert e.value.status == "invalid_argument"
    for big in (dict(scale=(20000, 1)), dict(limit=62), dict(scale=(30, 30), limit=63)):
        with pytest.raises(CodecError) as e:
            one(**big)
        assert e.value.status == "too_large"


def test_rows(spark):
    rng = random.Random(21)
    files, want = [], {}
    for k in range(4):
        data, told = animation(rng, 5)
        files.append((f"a{k}", data))
        for n, c in enumerate(painted(told, 16, 12)):
            want[f"a{k}", n] = c.astype(">u4").tobytes()
    p, c = lossless(rng, 5, 4)
    files += [("still", webp.riff(c)), ("null", None), ("junk", b"junk and more junk"), ("cut", files[0][1][:-9]), ("lossy", webp.riff(lossy(rng, 20, 20)))]
    want["still", 0] = p.astype(">u4").tobytes()
    df = spark.createDataFrame(files, "path string, content binary")
    for parts in (1, 7):
        rows = {(r["path"], r["frame_no"]): r for r in D.decode(df.repartition(parts), Options(fmt="argb")).collect()}
        for k, v in want.items():
            assert rows[k]["status"] == "ok" and bytes(rows[k]["planes"][0]) == v
        assert {rows[k, 0]["status"] for k in ("null", "cut", "lossy")} == {"truncated", "ok", "unsupported"}
        assert rows["junk", 0]["status"] == "not_webp" and rows["cut", 4]["status"] == "truncated" and rows["cut", 3]["status"] == "ok"
    assert D.decode(df.where("path = 'lossy'"), tables=TABLES).first()["format"] == "yuv420p"
    alone = D.decode(df.where("path = 'a0'"), Options(animation=SUBFRAME)).collect()
    assert len(alone) == 5 and {r["status"] for r in alone} == {"ok"}
    assert D.decode(df.limit(0)).count() == 0
