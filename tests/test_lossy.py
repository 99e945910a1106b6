"""The lossy decoder: what its parser reads against what an encoder of its own wrote, and pixels against a plain decoder of the same blocks."""

import json
import random

import numpy as np
import pytest

import vp8_encoder as E
from tessellar.codecs import vp8
from tessellar.status import CodecError

T = E.tables()
TABLES = vp8.Tables(T["modes"], T["coefficients"], T["updates"])
ZIGZAG = (0, 1, 4, 8, 5, 2, 3, 6, 9, 12, 13, 10, 7, 11, 14, 15)


def levels(rng, density, first=0, top=2048):
    out = [0] * 16
    for k in range(first, 16):
        if rng.random() < density:
            out[k] = rng.choice((-1, 1)) * min(top, rng.choice((1, 1, 1, 2, 3, 4, 5, 6, 7, 10, 18, 34, 66, rng.randrange(1, 2048))))
    return out


def blocks(rng, width, height, density=0.2, segments=False, top=100):
    out = []
    for _ in range(-(-width // 16) * -(-height // 16)):
        mode = rng.randrange(5)
        skip = rng.random() < 0.2
        fours = [rng.randrange(10) for _ in range(16)] if mode == 4 else []
        out.append((mode, fours, rng.randrange(4), rng.randrange(4) if segments else 0, skip, levels(rng, density, 0, top), [levels(rng, density, int(mode != 4), top) for _ in range(16)], [levels(rng, density, 0, top) for _ in range(8)]))
    return out


@pytest.mark.parametrize("parts", [1, 2, 8])
def test_parser(parts):
    rng = random.Random(parts)
    w, h = 70, 83
    sent = blocks(rng, w, h, 0.3, True, 2048)
    data = E.encode(w, h, sent, T, parts=parts, segments=[(q, 3) for q in (5, 50, 90, 127)])
    head = vp8.Header(data, TABLES)
    across = 5
    above, coded = [[0] * 4 for _ in range(across)], [[0] * 9 for _ in range(across)]
    for n, (mode, fours, chroma, segment, skip, second, lumas, chromas) in enumerate(sent):
        y, x = divmod(n, across)
        if not x:
            left, left_coded = [0] * 4, [0] * 9
        b = vp8.read_modes(head, TABLES, above[x], left)
        assert (b.mode, b.fours, b.chroma, b.segment, b.skip) == (mode, fours, chroma, segment, skip)
        vp8.read_residuals(head, head.parts[y % parts], b, coded[x], left_coded)
        if not skip and b.luma is not None:
            steps = head.steps[segment]
            for k in range(16):
                for i in range(int(mode != 4), 16):
                    assert b.luma[k][ZIGZAG[i]] == lumas[k][i] * steps[0][i > 0]
            for k in range(8):
                assert [b.chromas[k][ZIGZAG[i]] for i in range(16)] == [chromas[k][i] * steps[2][i > 0] for i in range(16)]
    assert not head.coder.over and not any(p.over for p in head.parts)


def idct(block):
    """The format's transform, one number at a time."""
    big, small = (lambda a: (a * 20091 >> 16) + a), (lambda a: a * 35468 >> 16)
    v = [int(x) for x in block]
    for step, other in ((4, 1), (1, 4)):
        for k in range(4):
            a, b, c, d = (v[k * other + step * j] for j in range(4))
            if step == 1:
                a += 4
            s, t, u, w = a + c, a - c, small(b) - big(d), big(b) + small(d)
            for j, x in enumerate((s + w, t + u, t - u, s - w)):
                v[k * other + step * j] = x
    return [x >> 3 for x in v]


def test_transforms():
    rng = random.Random(1)
    some = np.array([[rng.randrange(-900, 900) if rng.random() < 0.5 else 0 for _ in range(16)] for _ in range(50)])
    assert [r.ravel().tolist() for r in vp8.inverse(some)] == [idct(b) for b in some]
    assert vp8.second_order([80] + [0] * 15).tolist() == [(80 + 3) >> 3] * 16
    # a sum over all places with signs: four ups, four downs
    flat = vp8.second_order([0, 64] + [0] * 14).reshape(4, 4)
    assert (flat[:, :2] == 8).all() and (flat[:, 2:] == -8).all()


def plain_edges(plane, level, interior, inner, by, bx, size, simple):
    """The loop filter of one block, sample by sample, from the format's description."""
    c8, u8 = (lambda v: max(-128, min(127, v))), (lambda v: max(0, min(255, v)))
    limit, threshold = 2 * level + interior, (level >= 15) + (level >= 40)
    for upright in (1, 0):
        for k in range(0, size if inner else 1, 4):
            if not k and not (bx if upright else by):
                continue
            own = limit + (0 if k else 4)
            for j in range(size):
                at = [(size * by + j, size * bx + k + i) if upright else (size * by + k + i, size * bx + j) for i in range(-4, 4)]
                p3, p2, p1, p0, q0, q1, q2, q3 = s = [int(plane[a]) for a in at]
                if 2 * abs(p0 - q0) + abs(p1 - q1) // 2 > own:
                    continue
                if not simple and any(abs(s[i] - s[i + 1]) > interior for i in (0, 1, 2, 4, 5, 6)):
                    continue
                steep = simple or abs(p1 - p0) > threshold or abs(q1 - q0) > threshold
                if steep or k:
                    a = c8(3 * (q0 - p0) + (c8(p1 - q1) if steep else 0))
                    f1, f2 = min(a + 4, 127) >> 3, min(a + 3, 127) >> 3
                    new = {3: p0 + f2, 4: q0 - f1}
                    if not steep:
                        new |= {2: p1 + (f1 + 1 >> 1), 5: q1 - (f1 + 1 >> 1)}
                else:
                    a = c8(c8(p1 - q1) + 3 * (q0 - p0))
                    new = {}
                    for i, weight in ((0, 27), (1, 18), (2, 9)):
                        v = weight * a + 63 >> 7
                        new |= {3 - i: s[3 - i] + v, 4 + i: s[4 + i] - v}
                for i, v in new.items():
                    plane[at[i]] = u8(v)


@pytest.mark.parametrize("simple", [False, True])
@pytest.mark.parametrize("level,sharpness", [(5, 0), (20, 3), (63, 7), (45, 0)])
def test_filters(simple, level, sharpness):
    """The filter of whole frames equals a plain one over the unfiltered planes."""
    rng = random.Random(level)
    w, h = 48, 32
    sent = blocks(rng, w, h, 0.1, top=12)
    data = E.encode(w, h, sent, T, quant=10, level=level, sharpness=sharpness, simple=simple)
    raw, got = vp8.decode(data, TABLES, True), vp8.decode(data, TABLES)
    interior = level
    if sharpness:
        interior = min(level >> (2 if sharpness > 4 else 1), 9 - sharpness)
    planes = [p.astype(int) for p in (raw.y, raw.u, raw.v)]
    for n, (mode, _, _, _, skip, second, lumas, chromas) in enumerate(sent):
        coded = not skip and any(map(any, [second if mode != 4 else [], *lumas, *chromas]))
        for p, size in zip(planes, (16, 8, 8)):
            if size == 16 or not simple:
                plain_edges(p, level, max(1, interior), mode == 4 or coded, *divmod(n, 3), size, simple)
    for p, q in zip(planes, (got.y, got.u, got.v)):
        assert (p == q).all()
    assert not (raw.y == got.y).all()


def test_prediction_of_borders():
    """Without residuals: DC of nothing is 128, above the first row stands 127, on the left 129."""
    skip = lambda mode, chroma=0, fours=(): (mode, list(fours), chroma, 0, True, [0] * 16, [[0] * 16] * 16, [[0] * 16] * 8)
    p = vp8.decode(E.encode(16, 16, [skip(0)], T), TABLES)
    assert (p.y == 128).all() and (p.u == 128).all()
    p = vp8.decode(E.encode(16, 16, [skip(1, 2)], T), TABLES)
    assert (p.y == 127).all() and (p.v == 129).all()
    p = vp8.decode(E.encode(32, 32, [skip(2, 3), skip(0), skip(1), skip(3)], T), TABLES)
    assert (p.y[:16, :16] == 129).all() and (p.y[:16, 16:] == 129).all() and (p.y[16:, :16] == 129).all() and (p.y[16:, 16:] == 129).all()
    assert (p.u[:8, :8] == np.clip(129 + 127 - 127, 0, 255)).all()
    p = vp8.decode(E.encode(16, 16, [skip(4, 0, [2] * 16)], T), TABLES)
    assert (p.y[:4] == 127).all() and (p.y[:, 4:] == 127).all() and p.y[4, 0] == (129 + 2 * 127 + 127 + 2) // 4
    p = vp8.decode(E.encode(16, 16, [skip(4, 0, [3] * 16)], T), TABLES)
    assert p.y[0].tolist() == [(127 + 2 * 129 + 129 + 2) // 4] * 16 and (p.y[5] == 129).all()


def test_four_by_four_predictions():
    """Directions: along each mode's own diagonal the samples are equal, and a flat edge gives a flat block."""
    rng = random.Random(8)
    above, left, corner = [rng.randrange(256) for _ in range(8)], [rng.randrange(256) for _ in range(4)], rng.randrange(256)
    at = lambda m: np.array(vp8.predict_four(above, left, corner, m)).reshape(4, 4)
    ld, rd, vr, hd, vl, hu = (at(m) for m in (vp8.B_LD, vp8.B_RD, vp8.B_VR, vp8.B_HD, vp8.B_VL, vp8.B_HU))
    assert (ld[1:, :-1] == ld[:-1, 1:]).all() and (rd[1:, 1:] == rd[:-1, :-1]).all()
    assert (vr[2:, 1:] == vr[:-2, :-1]).all() and (hd[1:, 2:] == hd[:-1, :-2]).all()
    assert (vl[2, :3] == vl[0, 1:]).all() and (hu[1:, :2] == hu[:-1, 2:]).all()
    assert ld[0, 0] == (above[0] + 2 * above[1] + above[2] + 2) // 4 and ld[3, 3] == (above[6] + 3 * above[7] + 2) // 4
    assert rd[0, 0] == (left[0] + 2 * corner + above[0] + 2) // 4 and hu[3].tolist() == [left[3]] * 4
    assert vr[0, 0] == (corner + above[0] + 1) // 2 and hd[0, 0] == (corner + left[0] + 1) // 2 and vl[0, 0] == (above[0] + above[1] + 1) // 2
    for mode in range(10):
        assert vp8.predict_four([7] * 8, [7] * 4, 7, mode) == [7] * 16


def test_sizes_and_broken_data(tmp_path):
    rng = random.Random(3)
    sent = blocks(rng, 17, 33)
    data = E.encode(17, 33, sent, T)
    p = vp8.decode(data, TABLES)
    assert p.y.shape == (33, 17) and p.u.shape == p.v.shape == (17, 9)

    def status(d, t=TABLES):
        with pytest.raises(CodecError) as e:
            vp8.decode(d, t)
        return e.value.status

    assert status(data, None) == "unsupported"
    assert status(bytes([data[0] | 1]) + data[1:]) == "invalid_data"
    assert status(bytes([data[0] & 0xEF]) + data[1:]) == "unsupported"
    assert status(data[:3] + b"\0" + data[4:]) == "invalid_data"
    assert status(data[: len(data) // 2]) == "invalid_data"
    for k in range(40):
        bad = bytearray(data)
        bad[rng.randrange(10, len(bad))] ^= 1 << rng.randrange(8)
        try:
            vp8.decode(bytes(bad), TABLES)
        except CodecError:
            pass
    (tmp_path / "t.json").write_text(json.dumps(T))
    assert vp8.Tables.load(str(tmp_path / "t.json")) == TABLES
    with pytest.raises(ValueError):
        vp8.Tables([1], [2], [3])


def test_filter_levels_of_segments():
    rng = random.Random(5)
    data = E.encode(16, 16, blocks(rng, 16, 16), T, level=30, sharpness=2, segments=[(1, 0), (2, 63), (3, -5), (4, 10)], deltas=(4, -20))
    head = vp8.Header(data, TABLES)
    assert head.filters == [[(4, 2), (0, 1)], [(63, 7), (47, 7)], [(0, 1), (0, 1)], [(14, 7), (0, 1)]]
