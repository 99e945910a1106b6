"""Builders of image files for the tests: containers, and encoders that are independent of the decoders."""

import struct


def chunk(tag, data):
    return tag.encode() + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def riff(*chunks):
    body = b"WEBP" + b"".join(c if isinstance(c, bytes) else chunk(*c) for c in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def u24(n):
    return struct.pack("<I", n)[:3]


def vp8x(width, height, flags=0):
    return chunk("VP8X", bytes([flags, 0, 0, 0]) + u24(width - 1) + u24(height - 1))


def anim(background=0, loops=0):
    return chunk("ANIM", struct.pack("<IH", background, loops))


def anmf(x, y, width, height, duration, flags, *chunks):
    return chunk("ANMF", u24(x // 2) + u24(y // 2) + u24(width - 1) + u24(height - 1) + u24(duration) + bytes([flags]) + b"".join(chunks))


ONE_PIXEL = riff(("VP8L", bytes.fromhex("2f00000000071011118888fe0700")))


class BitWriter:
    def __init__(self):
        self.v, self.n = 0, 0

    def put(self, value, bits):
        self.v |= value << self.n
        self.n += bits

    def done(self):
        return self.v.to_bytes((self.n + 7) // 8, "little")


class Alphabet:
    """A prefix code over the symbols that are used: all of one length, as far as that goes, and sent with normal lengths."""

    def __init__(self, used, size):
        self.size, used = size, sorted(set(used)) or [0]
        n = len(used)
        bits = max(1, (n - 1).bit_length())
        short = (1 << bits) - n  # so many symbols take one bit less
        self.lengths = {s: bits - (k < short and n > 1 and bits > 1) for k, s in enumerate(used)} if n > 1 else {used[0]: 1}
        if n > 1 and bits == 1:
            self.lengths = {s: 1 for s in used}
        self.codes, code, last = {}, 0, 0
        for length, s in sorted((l, s) for s, l in self.lengths.items()):
            code <<= length - last
            last = length
            self.codes[s] = int(f"{code:0{length}b}"[::-1], 2)
            code += 1

    def send(self, w):
        w.put(0, 1)
        # lengths 0 to 15 all take four bits, repeats are not used: a complete code of 16 symbols
        order = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
        w.put(19 - 4, 4)
        for s in order:
            w.put(4 if s < 16 else 0, 3)
        w.put(0, 1)
        for s in range(self.size):
            w.put(int(f"{self.lengths.get(s, 0):04b}"[::-1], 2), 4)

    def put(self, w, s):
        if len(self.lengths) > 1:
            w.put(self.codes[s], self.lengths[s])


def prefix(value):
    """(symbol, extra bits, their number) of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    top = v.bit_length() - 1
    half = v >> (top - 1) & 1
    return 2 * top + half, v & ((1 << (top - 1)) - 1), top - 1


def cache_slot(p, bits):
    return (0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - bits)


def send_image(w, tokens, cache_bits=0, main=True, groups=None):
    """tokens: ("p", pixel), ("c", slot) or ("r", length, distance code). groups: (tile bits, tiles across and down, group of each tile, width)."""
    w.put(bool(cache_bits), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    n = 1
    owner = [0] * len(tokens)
    if main:
        w.put(groups is not None, 1)
        if groups is not None:
            bits, tiles, width = groups
            w.put(bits - 2, 3)
            send_image(w, [("p", 0xFF000000 | t << 8) for t in tiles], main=False)
            n, at = max(tiles) + 1, 0
            across = -(-width // (1 << bits))
            for k, t in enumerate(tokens):
                y, x = divmod(at, width)
                owner[k] = tiles[(y >> bits) * across + (x >> bits)]
                at += t[1] if t[0] == "r" else 1
    coders = []
    for g in range(n):
        used = [[] for _ in range(5)]
        for k, t in enumerate(tokens):
            if owner[k] != g:
                continue
            if t[0] == "p":
                for j, shift in enumerate((8, 16, 0, 24)):
                    used[j].append(t[1] >> shift & 255)
            elif t[0] == "c":
                used[0].append(280 + t[1])
            else:
                used[0].append(256 + prefix(t[1])[0])
                used[4].append(prefix(t[2])[0])
        sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
        coders.append([Alphabet(u, s) for u, s in zip(used, sizes)])
        for a in coders[-1]:
            a.send(w)
    for k, t in enumerate(tokens):
        green, red, blue, alpha, far = coders[owner[k]]
        if t[0] == "p":
            p = t[1]
            green.put(w, p >> 8 & 255), red.put(w, p >> 16 & 255), blue.put(w, p & 255), alpha.put(w, p >> 24)
        elif t[0] == "c":
            green.put(w, 280 + t[1])
        else:
            for coder, base, v in ((green, 256, t[1]), (far, 0, t[2])):
                s, extra, bits = prefix(v)
                coder.put(w, base + s)
                w.put(extra, bits)


def lossless(width, height, tokens, transforms=(), alpha=True, header=True, **image):
    """transforms: functions that write one each, in reading order."""
    w = BitWriter()
    if header:
        w.put(0x2F, 8), w.put(width - 1, 14), w.put(height - 1, 14), w.put(alpha, 1), w.put(0, 3)
    for t in transforms:
        w.put(1, 1)
        t(w)
    w.put(0, 1)
    send_image(w, tokens, **image)
    return w.done()


def literals(pixels):
    return [("p", int(p)) for p in pixels]


def tile_transform(kind, bits, tiles):
    def send(w):
        w.put(kind, 2), w.put(bits - 2, 3)
        send_image(w, literals(tiles), main=False)

    return send


def green_transform(w):
    w.put(2, 2)


def palette_transform(colours):
    def send(w):
        w.put(3, 2), w.put(len(colours) - 1, 8)
        before = 0
        out = []
        for c in colours:
            out.append(sum(((c >> k) - (before >> k) & 255) << k for k in (0, 8, 16, 24)))
            before = c
        send_image(w, literals(out), main=False)

    return send
