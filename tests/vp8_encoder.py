"""An encoder of lossy frames for the tests: a boolean coder and random modes and coefficients, written as the format's trees say."""

import random

#: Made up by a rule, as the decoder takes its tables as a parameter.
def tables():
    rng = random.Random(77)
    odds = lambda *shape: rng.randrange(1, 256) if not shape else [odds(*shape[1:]) for _ in range(shape[0])]
    return {"modes": odds(10, 10, 9), "coefficients": odds(4, 8, 3, 11), "updates": [[[[250] * 11 for _ in range(3)] for _ in range(8)] for _ in range(4)]}


class BoolWriter:
    """The encoder of RFC 6386, section 7."""

    def __init__(self):
        self.out, self.range, self.bottom, self.count = bytearray(), 255, 0, 24

    def bit(self, value, odds=128):
        split = 1 + ((self.range - 1) * odds >> 8)
        if value:
            self.bottom += split
            self.range -= split
        else:
            self.range = split
        while self.range < 128:
            self.shift()

    def shift(self):
        self.range <<= 1
        if self.bottom & 1 << 31:
            self.carry()
        self.bottom = self.bottom << 1 & 0xFFFFFFFF
        self.count -= 1
        if not self.count:
            self.out.append(self.bottom >> 24)
            self.bottom &= (1 << 24) - 1
            self.count = 8

    def sign(self, negative):
        """A coefficient's sign always takes one shift, though that may leave a range of 256."""
        split = (self.range + 1) // 2
        if negative:
            self.bottom += split
            self.range -= split
        else:
            self.range = split
        self.shift()

    def carry(self):
        k = len(self.out) - 1
        while k >= 0 and self.out[k] == 255:
            self.out[k] = 0
            k -= 1
        self.out[k] += 1

    def number(self, v, bits):
        for k in reversed(range(bits)):
            self.bit(v >> k & 1)

    def optional(self, v, bits):
        self.bit(v != 0)
        if v:
            self.number(abs(v), bits)
            self.bit(v < 0)

    def done(self):
        for _ in range(4):
            self.number(0, 8)
        return bytes(self.out)


#: For each 4 x 4 mode the branches of its tree: (node, bit).
FOUR_TREE = {0: [(0, 0)], 1: [(0, 1), (1, 0)], 2: [(0, 1), (1, 1), (2, 0)], 3: [(0, 1), (1, 1), (2, 1), (3, 0), (4, 0)], 5: [(0, 1), (1, 1), (2, 1), (3, 0), (4, 1), (5, 0)], 6: [(0, 1), (1, 1), (2, 1), (3, 0), (4, 1), (5, 1)]}
FOUR_TREE |= {4: [(0, 1), (1, 1), (2, 1), (3, 1), (6, 0)], 7: [(0, 1), (1, 1), (2, 1), (3, 1), (6, 1), (7, 0)], 8: [(0, 1), (1, 1), (2, 1), (3, 1), (6, 1), (7, 1), (8, 0)], 9: [(0, 1), (1, 1), (2, 1), (3, 1), (6, 1), (7, 1), (8, 1)]}
WHOLE_TREE = {4: [(0, 0)], 0: [(0, 1), (1, 0), (2, 0)], 1: [(0, 1), (1, 0), (2, 1)], 2: [(0, 1), (1, 1), (3, 0)], 3: [(0, 1), (1, 1), (3, 1)]}
CHROMA_TREE = {0: [(0, 0)], 1: [(0, 1), (1, 0)], 2: [(0, 1), (1, 1), (2, 0)], 3: [(0, 1), (1, 1), (2, 1)]}
BANDS = (0, 1, 2, 3, 6, 4, 5, 6, 6, 6, 6, 6, 6, 6, 6, 7)
LARGE = ((5, (159,)), (7, (165, 145)), (11, (173, 148, 140)), (19, (176, 155, 140, 135)), (35, (180, 157, 141, 134, 130)), (67, (254, 254, 243, 230, 196, 177, 153, 140, 133, 130, 129)))
AS_FOUR = (0, 2, 3, 1)


def send_block(w, levels, odds, at, ctx):
    """levels: 16 in scan order. Returns whether any is sent."""
    last = max((k for k in range(at, 16) if levels[k]), default=-1)
    if last < 0:
        w.bit(0, odds[BANDS[at]][ctx][0])
        return 0
    w.bit(1, odds[BANDS[at]][ctx][0])
    while True:
        p, v = odds[BANDS[at]][ctx], abs(levels[at])
        w.bit(v > 0, p[1])
        if not v:
            at, ctx = at + 1, 0
            continue
        w.bit(v > 1, p[2])
        if v > 1:
            w.bit(v > 4, p[3])
            if v <= 4:
                w.bit(v > 2, p[4])
                if v > 2:
                    w.bit(v > 3, p[5])
            else:
                k = max(i for i, (base, _) in enumerate(LARGE) if v >= base)
                w.bit(k > 1, p[6])
                if k < 2:
                    w.bit(k, p[7])
                else:
                    w.bit(k > 3, p[8])
                    w.bit((k - 2) & 1, p[9 + (k > 3)])
                base, extra = LARGE[k]
                for i, q in enumerate(extra):
                    w.bit((v - base) >> (len(extra) - 1 - i) & 1, q)
        w.sign(levels[at] < 0)
        at, ctx = at + 1, 1 if v == 1 else 2
        if at == 16:
            return 1
        w.bit(at <= last, odds[BANDS[at]][ctx][0])
        if at > last:
            return 1


def encode(width, height, blocks, t, quant=20, level=0, sharpness=0, simple=False, parts=1, skip_odds=100, segments=None, deltas=None):
    """blocks: in row order (mode, fours, chroma, segment, skip, second, lumas, chromas), levels in scan order. segments: [(quant, level)] * 4."""
    across = -(-width // 16)
    w = BoolWriter()
    w.bit(0), w.bit(0)
    w.bit(segments is not None)
    if segments is not None:
        w.bit(1), w.bit(1), w.bit(1)
        for k, bits in ((0, 7), (1, 6)):
            for s in segments:
                w.optional(s[k], bits)
        for _ in range(3):
            w.bit(1), w.number(120, 8)
    w.bit(simple), w.number(level, 6), w.number(sharpness, 3)
    w.bit(deltas is not None)
    if deltas is not None:
        w.bit(1)
        for k in range(8):
            w.bit(k in (0, 4))
            if k in (0, 4):
                v = deltas[k // 4]
                w.number(abs(v), 6), w.bit(v < 0)
    w.number(parts.bit_length() - 1, 2)
    w.number(quant, 7)
    for _ in range(5):
        w.bit(0)
    w.bit(0)
    for _ in range(4 * 8 * 3 * 11):
        w.bit(0, 250)
    w.bit(1), w.number(skip_odds, 8)
    tokens = [BoolWriter() for _ in range(parts)]
    above_modes, above = [[0] * 4 for _ in range(across)], [[0] * 9 for _ in range(across)]
    for n, (mode, fours, chroma, segment, skip, second, lumas, chromas) in enumerate(blocks):
        y, x = divmod(n, across)
        if not x:
            left_modes, left = [0] * 4, [0] * 9
        if segments is not None:
            w.bit(segment >> 1, 120), w.bit(segment & 1, 120)
        w.bit(skip, skip_odds)
        for node, bit in WHOLE_TREE[mode]:
            w.bit(bit, (145, 156, 163, 128)[node])
        if mode == 4:
            for k, m in enumerate(fours):
                for node, bit in FOUR_TREE[m]:
                    w.bit(bit, t["modes"][above_modes[x][k & 3]][left_modes[k >> 2]][node])
                above_modes[x][k & 3] = left_modes[k >> 2] = m
        else:
            above_modes[x], left_modes = [AS_FOUR[mode]] * 4, [AS_FOUR[mode]] * 4
        for node, bit in CHROMA_TREE[chroma]:
            w.bit(bit, (142, 114, 183)[node])
        top, c, odds = above[x], tokens[y % parts], t["coefficients"]
        if skip:
            top[:8] = left[:8] = [0] * 8
            if mode != 4:
                top[8] = left[8] = 0
            continue
        if mode != 4:
            top[8] = left[8] = send_block(c, second, odds[1], 0, top[8] + left[8])
        for k in range(16):
            i, j = k & 3, k >> 2
            top[i] = left[j] = send_block(c, lumas[k], odds[3 if mode == 4 else 0], 0 if mode == 4 else 1, top[i] + left[j])
        for k in range(8):
            i, j = 4 + 2 * (k >> 2) + (k & 1), 4 + 2 * (k >> 2) + (k >> 1 & 1)
            top[i] = left[j] = send_block(c, chromas[k], odds[2], 0, top[i] + left[j])
    first = w.done()
    sent = [c.done() for c in tokens]
    head = (len(first) << 5 | 0x10).to_bytes(3, "little") + b"\x9d\x01\x2a" + width.to_bytes(2, "little") + height.to_bytes(2, "little")
    return head + first + b"".join(len(p).to_bytes(3, "little") for p in sent[:-1]) + b"".join(sent)
