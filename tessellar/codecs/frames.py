"""Files to pictures: images of files and of frames, composition on a canvas, export to a format.

Frames are decoded on their own. Composition is a fold in their order; a key frame depends on nothing before it, so it starts an
island that can be folded apart from the others.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from tessellar.codecs import alpha, pixels, vp8, vp8l
from tessellar.codecs.pixels import Frame
from tessellar.options import SUBFRAME, Options
from tessellar.sources import riff
from tessellar.status import CodecError, invalid

#: Cleared pixels, as alpha, red, green, blue and as luma, U, V, alpha. A file's background colour is told, never painted.
CLEAR_ARGB, CLEAR_YUVA = (0, 0, 0, 0), (16, 128, 128, 0)


@dataclass
class Placed:
    """A frame's place and kind; key: nothing before it shows."""

    pos_x: int
    pos_y: int
    width: int
    height: int
    dispose: bool = False
    no_blend: bool = False
    has_alpha: bool = False
    key: bool = True


def key_frames(frames: list[Placed], width: int, height: int) -> None:
    """Marks key frames: the first; one that covers the canvas without blending; one after a whole or key frame that is disposed of."""
    before: Placed | None = None
    for f in frames:
        whole = (f.pos_x, f.pos_y, f.width, f.height) == (0, 0, width, height)
        f.key = before is None or (whole and (f.no_blend or not f.has_alpha)) or (before.dispose and (before.key or (before.width, before.height) == (width, height)))
        before = f


def regions(f: Placed, width: int, height: int, before: Placed | None, alpha_plane: bool, aligned: bool) -> list[tuple[int, int, int, int, bool]]:
    """(x, y, width, height, blend) parts of a frame. Where the frame before was disposed of there is nothing to blend with: that part is copied."""
    whole = (0, 0, width, height)
    if f.key or f.no_blend or not alpha_plane:
        return [(*whole, False)]
    if before is None or not before.dispose:
        return [(*whole, True)]
    x, y = max(f.pos_x, before.pos_x) - f.pos_x, max(f.pos_y, before.pos_y) - f.pos_y
    w = min(f.pos_x + width, before.pos_x + before.width) - f.pos_x - x
    h = min(f.pos_y + height, before.pos_y + before.height) - f.pos_y - y
    if aligned and w > 0 and h > 0:
        w, h = w & ~1, h & ~1
    if w <= 0 or h <= 0:
        return [(*whole, True)]
    around = [(0, 0, width, y), (0, y + h, width, height - y - h), (0, y, x, h), (x + w, y, width - x - w, h)]
    return [(*r, True) for r in around if r[2] > 0 and r[3] > 0] + [(x, y, w, h, False)]


def decode_image(tag: str, data: bytes, alpha_data: bytes | None, tables: vp8.Tables | None, bypass: bool = False) -> tuple[Frame, bool, list[str]]:
    """The frame in its own format, whether it has alpha, and warnings."""
    if tag == "VP8L":
        argb, has_alpha = vp8l.decode(data)
        return pixels.argb_frame(argb), has_alpha, []
    p = vp8.decode(data, tables, bypass)
    planes = [x.astype(np.int64) for x in (p.y, p.u, p.v)]
    if alpha_data is not None:
        planes.append(alpha.decode(alpha_data, p.y.shape[1], p.y.shape[0]).astype(np.int64))
    return Frame("yuva420p" if alpha_data is not None else "yuv420p", planes), alpha_data is not None, p.warnings


def decode_still(data: bytes, info: riff.Info, tables: vp8.Tables | None, bypass: bool = False) -> tuple[Frame, bool, list[str]]:
    tag, at, size = info.image
    if len(info.alphas) > 1:
        raise invalid("more than one ALPH")
    held = None
    if info.alphas and tag == "VP8 " and riff.alpha_allowed(info, data):
        own, n = info.alphas[0]
        held = data[own : own + n]
    frame, has_alpha, warnings = decode_image(tag, data[at : at + size], held, tables, bypass)
    if (frame.width, frame.height) != (info.width, info.height):
        raise invalid("the image is not of the size its headers tell")
    return frame, has_alpha, warnings


def decode_part(data: bytes, tables: vp8.Tables | None, bypass: bool = False) -> tuple[Frame, bool, list[str]]:
    """The image of an animation's frame, from its chunk's payload."""
    if len(data) < 16:
        raise invalid("a short frame")
    at, out, held = 16, None, None
    while len(data) - at >= 8:
        tag, size = data[at : at + 4].decode("latin-1"), riff.number(data, at + 4, 4)
        if size == 0xFFFFFFFF:
            raise invalid("size of a chunk")
        at += 8
        if len(data) - at < size + (size & 1):
            break
        if tag == "ALPH":
            if not size or out or held is not None:
                raise invalid("ALPH is empty, repeated or after its image")
            held = data[at : at + size]
            alpha.header(held[0])
        elif tag in ("VP8 ", "VP8L"):
            if out or (tag == "VP8L" and held is not None):
                raise invalid("a second image, or a lossless one with ALPH")
            out = decode_image(tag, data[at : at + size], held, tables, bypass)
        at += size + (size & 1)
    if out is None:
        raise invalid("a frame without an image")
    return out


def check_part(f: Placed, frame: Frame, width: int, height: int) -> list[str]:
    """A frame's image against what is declared: larger is wrong, smaller only worth a warning."""
    if f.pos_x + f.width > width or f.pos_y + f.height > height:
        raise invalid("a frame off the canvas")
    if frame.width > f.width or frame.height > f.height:
        raise invalid("a frame's image is larger than declared")
    return [] if (frame.width, frame.height) == (f.width, f.height) else ["a frame's image is smaller than declared"]


def for_canvas(frame: Frame, o: Options, argb: bool) -> Frame:
    """As the canvas takes it: ARGB where that is, premultiplied where the output is (also for four bits)."""
    if argb and frame.fmt != "argb":
        frame = pixels.yuv_to_argb(frame, o.chroma)
    if o.fmt and pixels.is_premultiplied(o.fmt) and frame.fmt == "argb":
        frame = Frame("argb", [pixels.premultiplied(frame.planes[0])], True)
    return frame


@dataclass
class Canvas:
    """The fold's state: the picture so far and the frame before."""

    width: int
    height: int
    options: Options
    picture: Frame | None = None
    before: Placed | None = None

    def clear(self, x: int, y: int, w: int, h: int) -> None:
        if self.picture.fmt == "argb":
            self.picture.planes[0][y : y + h, x : x + w] = CLEAR_ARGB
            return
        for k, (p, v) in enumerate(zip(self.picture.planes, CLEAR_YUVA, strict=True)):
            if k in (1, 2):
                p[y >> 1 : y + h + 1 >> 1, x >> 1 : x + w + 1 >> 1] = v
            else:
                p[y : y + h, x : x + w] = v

    def prepare(self, f: Placed, frame: Frame, fmt: str) -> None:
        if f.key and self.picture is not None and self.picture.fmt != fmt:
            self.picture = None
        if self.picture is None or f.key:
            size = self.height, self.width
            if self.picture is None:
                half = (self.height + 1 >> 1, self.width + 1 >> 1)
                planes = [np.zeros((*size, 4), np.int64)] if fmt == "argb" else [np.zeros(s, np.int64) for s in (size, half, half, size)]
                self.picture = Frame(fmt, planes, bool(self.options.fmt) and pixels.is_premultiplied(self.options.fmt))
            self.clear(0, 0, self.width, self.height)
            return
        if fmt == "argb" and self.picture.fmt != "argb":
            self.picture = for_canvas(self.picture, self.options, True)
        if self.before.dispose:
            self.clear(self.before.pos_x, self.before.pos_y, self.before.width, self.before.height)

    def paint(self, f: Placed, frame: Frame, region: tuple[int, int, int, int, bool]) -> None:
        x, y, w, h, blend = region
        at = np.s_[f.pos_y + y : f.pos_y + y + h, f.pos_x + x : f.pos_x + x + w]
        own = np.s_[y : y + h, x : x + w]
        if self.picture.fmt == "argb":
            dst, src = self.picture.planes[0], frame.planes[0][own]
            if blend:
                src = (pixels.blend_premultiplied if self.picture.premultiplied else pixels.blend_straight)(src, dst[at])
            dst[at] = src
            return
        planes = self.picture.planes
        alphas = frame.planes[3] if len(frame.planes) == 4 else np.full(frame.planes[0].shape, 255)
        cy, cx, ch, cw = f.pos_y + y >> 1, f.pos_x + x >> 1, h + 1 >> 1, w + 1 >> 1
        for k in (1, 2):
            src, dst = frame.planes[k][y >> 1 : (y >> 1) + ch, x >> 1 : (x >> 1) + cw], planes[k][cy : cy + ch, cx : cx + cw]
            dst[:] = pixels.mix(src, pixels.block_alpha(alphas[own]), dst, pixels.block_alpha(planes[3][at]))[0] if blend else src
        src = frame.planes[0][own]
        planes[0][at], planes[3][at] = pixels.mix(src, alphas[own], planes[0][at], planes[3][at]) if blend else (src, alphas[own])

    def add(self, f: Placed, frame: Frame) -> Frame:
        """The picture after a frame, whose key mark holds."""
        argb = frame.fmt == "argb" or bool(self.options.fmt and pixels.is_packed(self.options.fmt)) or (not f.key and self.picture is not None and self.picture.fmt == "argb")
        frame = for_canvas(frame, self.options, argb)
        self.prepare(f, frame, "argb" if argb else "yuva420p")
        for region in regions(f, frame.width, frame.height, self.before, frame.fmt != "yuv420p", self.picture.fmt != "argb"):
            self.paint(f, frame, region)
        self.before = f
        return self.picture


@dataclass
class Picture:
    fmt: str
    width: int
    height: int
    planes: list[bytes]


def export(frame: Frame, o: Options) -> Picture:
    """Crops, scales, converts, premultiplies and flips, in this order."""
    if o.crop:
        frame = pixels.crop(frame, *o.crop)
    fmt = o.fmt or frame.fmt
    if o.scale:
        w, h = pixels.scaled_size(frame.width, frame.height, *o.scale)
        o.fits(w, h)
        frame = pixels.scale(frame, w, h, fmt)
    planes = pixels.converted(frame, fmt, o.chroma)
    return Picture(fmt, frame.width, frame.height, [np.ascontiguousarray(p[::-1] if o.flip else p).astype(np.uint8).tobytes() for p in planes])


@dataclass
class Decoded:
    """One picture with what its file tells of it."""

    frame_no: int
    picture: Picture
    duration: int
    timestamp: int
    placed: Placed
    warnings: list[str] = field(default_factory=list)


def placed_frames(info: riff.Info) -> list[Placed]:
    out = [Placed(f.pos_x, f.pos_y, f.width, f.height, f.dispose, f.no_blend, f.has_alpha) for f in info.frames if f.complete]
    key_frames(out, info.width, info.height)
    return out


def decode_file(data: bytes, o: Options | None = None, tables: vp8.Tables | None = None):
    """All pictures of a file, one after the other; CodecError at the first thing that is wrong."""
    o = (o or Options()).check()
    info = riff.checked(data)
    if info.status != "ok":
        raise CodecError(info.status, info.error)
    o.fits(info.width, info.height)
    bypass = o.without_filter(info.width, info.height)
    if not info.is_animation:
        frame, has_alpha, warnings = decode_still(data, info, tables, bypass)
        yield Decoded(0, export(frame, o), 0, 0, Placed(0, 0, info.width, info.height, has_alpha=has_alpha), warnings)
        return
    canvas, time = Canvas(info.width, info.height, o), 0
    whole = [f for f in info.frames if f.complete]
    for n, (f, at) in enumerate(zip(placed_frames(info), whole, strict=True)):
        frame, _, warnings = decode_part(data[at.offset : at.offset + at.size], tables, bypass)
        warnings = warnings + check_part(f, frame, info.width, info.height)
        out = frame if o.animation == SUBFRAME else canvas.add(f, frame)
        yield Decoded(n, export(out, o), at.duration, time, f, warnings)
        time += at.duration
    if info.truncated:
        raise CodecError("truncated", "the file ends inside a chunk")
