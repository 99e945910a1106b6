"""Headers of image files: a walk over chunks that keeps the rules of the format and ends with the first one that is broken.

Everything is told by one pass over chunk headers; pixels are never decoded, payloads never copied.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from tessellar.status import CodecError, NOT_WEBP, OK, TOO_LARGE, TRUNCATED, invalid

#: Fixed values of the format.
ICC_FLAG, ALPHA_FLAG, EXIF_FLAG, XMP_FLAG, ANIMATION_FLAG = 0x20, 0x10, 0x08, 0x04, 0x02
METADATA = {"ICCP": (1, ICC_FLAG), "EXIF": (2, EXIF_FLAG), "XMP ": (4, XMP_FLAG)}
DISPOSE, NO_BLEND = 1, 2
MOST_PIXELS, MOST_FRAMES = 16384, 1 << 20


def number(data: bytes, at: int, size: int) -> int:
    """Little-endian; bytes past the end count as 0."""
    return int.from_bytes(data[at : at + size], "little")


@dataclass
class Chunk:
    tag: str
    offset: int  # of the payload
    size: int
    complete: bool


@dataclass
class Frame:
    pos_x: int
    pos_y: int
    width: int
    height: int
    duration: int
    dispose: bool
    no_blend: bool
    has_alpha: bool
    complete: bool
    offset: int  # of the frame's payload
    size: int


@dataclass
class Info:
    """What a file's headers tell. raw: "", or the kind of a bitstream without a container."""

    status: str = OK
    error: str = ""
    width: int = 0
    height: int = 0
    has_alpha: bool = False
    image_alpha: bool = False
    is_animation: bool = False
    frame_count: int = 0
    loop_count: int = 0
    background_argb: int = 0
    coding: str = "unknown"
    metadata: int = 0
    truncated: bool = False
    raw: str = ""
    end: int = 0
    chunks: list[Chunk] = field(default_factory=list)
    frames: list[Frame] = field(default_factory=list)
    payloads: dict[str, tuple[int, int]] = field(default_factory=dict)  # of metadata: offset and size of the first that is not empty
    image: tuple[str, int, int] | None = None  # tag, offset and size of the first still image
    alphas: list[tuple[int, int]] = field(default_factory=list)  # offset and size of ALPH chunks before it
    warnings: list[str] = field(default_factory=list)
    images: int = 0


def image_size(tag: str, head: bytes, size: int) -> tuple[int, int] | None:
    """Of a bitstream's first bytes, its width and height; None where they break a rule."""
    if tag == "VP8L":
        bits = number(head, 1, 4)
        if len(head) < 5 or head[0] != 0x2F or bits >> 29:
            return None
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if len(head) < 10 or size < 10 or head[3:6] != b"\x9d\x01\x2a":
        return None
    bits = number(head, 0, 3)
    if bits & 1 or (bits >> 1 & 7) > 3 or not bits & 0x10 or bits >> 5 > size - 10:
        return None
    return number(head, 6, 2) & 0x3FFF, number(head, 8, 2) & 0x3FFF


def frame_alpha(data: bytes, at: int, end: int) -> bool:
    """Whether the chunks of a frame give it alpha: ALPH, or the first image's own bit."""
    while end - at >= 8:
        tag, size = data[at : at + 4], number(data, at + 4, 4)
        at += 8
        if size == 0xFFFFFFFF or end - at < size + (size & 1):
            return False
        if tag == b"ALPH":
            return True
        if tag == b"VP8L":
            return size >= 5 and data[at] == 0x2F and bool(number(data, at + 1, 4) >> 28 & 1)
        if tag == b"VP8 ":
            return False
        at += size + (size & 1)
    return False


class Walk:
    """The rules' state over a file's chunks."""

    def __init__(self, data: bytes, partial: bool):
        self.data, self.partial, self.info = data, partial, Info()
        self.flags: int | None = None
        self.anim = self.still = False

    def allow_still(self) -> None:
        if (self.flags or 0) & ANIMATION_FLAG or self.anim:
            raise invalid("an image outside a frame of an animation")
        self.still = True

    def bitstream(self, tag: str, offset: int, have: int, size: int) -> None:
        """Size, coding and alpha from an image's header."""
        i = self.info
        head = self.data[offset : offset + min(have, 10)]
        i.coding = "lossless" if tag == "VP8L" else "lossy"
        got = image_size(tag, head, size)
        i.width, i.height = got or (0, 0)
        if got and tag == "VP8L" and number(head, 1, 4) >> 28 & 1:
            i.has_alpha = i.image_alpha = True

    def still_size(self, tag: str, offset: int, have: int, size: int) -> None:
        i = self.info
        canvas = i.width, i.height
        self.bitstream(tag, offset, have, size)
        if self.flags is not None and all(canvas):
            own, (i.width, i.height) = (i.width, i.height), canvas
            if all(own) and own != canvas:
                raise invalid("the canvas is not of the image's size")

    def canvas(self, at: int, size: int) -> None:
        i = self.info
        if self.flags is not None or size != 10:
            raise invalid("VP8X twice, or not of ten bytes")
        self.flags = flags = self.data[at]
        if flags & ~(ICC_FLAG | ALPHA_FLAG | EXIF_FLAG | XMP_FLAG | ANIMATION_FLAG):
            raise invalid("reserved flags")
        i.has_alpha |= bool(flags & ALPHA_FLAG)
        for bit, flag in METADATA.values():
            i.metadata |= bit if flags & flag else 0
        i.width, i.height = number(self.data, at + 4, 3) + 1, number(self.data, at + 7, 3) + 1
        if max(i.width, i.height) > MOST_PIXELS:
            raise CodecError(TOO_LARGE, "canvas")

    def frame(self, at: int, size: int, complete: bool) -> None:
        i, d = self.info, self.data
        if size < 16:
            return
        if len(i.frames) >= MOST_FRAMES:
            if not i.warnings:
                i.warnings.append(f"only the first {MOST_FRAMES} frames are listed")
            return
        x, y, w, h, duration = (number(d, at + k, 3) for k in (0, 3, 6, 9, 12))
        kind = d[at + 15]
        i.frames.append(Frame(2 * x, 2 * y, w + 1, h + 1, duration, bool(kind & DISPOSE), bool(kind & NO_BLEND), frame_alpha(d, at + 16, at + size), complete, at, size))

    def frame_fits(self, at: int, size: int) -> None:
        i, d = self.info, self.data
        if size < 16:
            raise invalid("a short frame")
        x, y, w, h = 2 * number(d, at, 3), 2 * number(d, at + 3, 3), number(d, at + 6, 3) + 1, number(d, at + 9, 3) + 1
        if i.width and i.height:
            whole = (x, y, w, h) == (0, 0, i.width, i.height)
            if not whole and (not (self.flags or 0) & ANIMATION_FLAG or x + w > i.width or y + h > i.height):
                raise invalid("a frame off the canvas")

    def whole_chunk(self, tag: str, at: int, size: int) -> None:
        i = self.info
        if tag == "VP8X":
            self.canvas(at, size)
        elif tag == "ALPH":
            self.allow_still()
            i.alphas += [(at, size)] if not i.image else []
            if self.flags is None or self.flags & ALPHA_FLAG:
                i.has_alpha = i.image_alpha = True
        elif tag == "ANIM":
            if size < 6:
                raise invalid("a short ANIM")
            if self.still:
                raise invalid("ANIM after a still image")
            if not self.anim:
                self.anim = i.is_animation = True
                i.background_argb, i.loop_count = number(self.data, at, 4), number(self.data, at + 4, 2)
        elif tag == "ANMF":
            if not self.anim:
                raise invalid("a frame before ANIM")
            if not (self.flags or 0) & ANIMATION_FLAG and i.frame_count:
                raise invalid("more than one frame without the animation flag")
            self.frame_fits(at, size)
            i.frame_count += 1
            self.frame(at, size, True)
        elif tag in ("VP8 ", "VP8L"):
            self.allow_still()
            i.images += 1
            if i.images == 1:
                i.image = (tag, at, size)
                self.still_size(tag, at, size, size)
        elif tag in METADATA:
            i.metadata |= METADATA[tag][0]
            if size:
                i.payloads.setdefault(tag, (at, size))

    def container(self) -> None:
        i, d, partial_still = self.info, self.data, False
        declared = number(d, 4, 4) + 8
        i.end = min(declared, len(d))
        i.truncated = declared > len(d)
        at = 12
        while at + 8 <= i.end:
            tag, size = d[at : at + 4].decode("latin-1"), number(d, at + 4, 4)
            if at == 12 and tag not in ("VP8X", "VP8 ", "VP8L"):
                raise invalid("the first chunk is none of VP8, VP8L and VP8X")
            if size == 0xFFFFFFFF:
                i.truncated = True
                break
            padded, at = size + (size & 1), at + 8
            have = i.end - at
            i.chunks.append(Chunk(tag, at, size, have >= padded))
            if have < padded:
                i.truncated = True
                if tag == "ANMF":
                    self.frame(at, have, False)
                if self.partial and not i.images and tag in ("VP8 ", "VP8L"):
                    self.allow_still()
                    partial_still, i.image = True, (tag, at, size)
                    self.still_size(tag, at, have, size)
                break
            self.whole_chunk(tag, at, size)
            at += padded
        if i.is_animation:
            i.coding = "unknown"
        else:
            i.frame_count = int(i.images > 0 or partial_still)
        if not i.width or not i.height:
            raise CodecError(TRUNCATED) if i.truncated else invalid("no image")
        if not self.partial and not i.truncated and (self.flags or 0) & ANIMATION_FLAG and not self.anim:
            raise invalid("the animation flag without ANIM")

    def bare(self) -> None:
        """A bitstream without a container: lossless, lossy, or ALPH and lossy."""
        i, d = self.info, self.data
        size = len(d)
        if not size:
            raise CodecError(TRUNCATED)
        if d[0] == 0x2F:
            i.raw, i.image = "lossless", ("VP8L", 0, size)
            if size < 5:
                raise CodecError(TRUNCATED)
            self.bitstream("VP8L", 0, size, size)
        elif size >= 6 and d[3:6] == b"\x9d\x01\x2a":
            i.raw, i.image = "lossy", ("VP8 ", 0, size)
            if size < 10:
                raise CodecError(TRUNCATED)
            need = 10 + (number(d, 0, 3) >> 5)
            if not self.partial or need < size:
                need = size
            self.bitstream("VP8 ", 0, size, need)
            i.truncated = bool(i.width) and need > size
        elif d[:4] == b"ALPH":
            i.raw = "alpha_and_lossy"
            if size < 8:
                raise CodecError(TRUNCATED)
            alpha = number(d, 4, 4)
            if alpha == 0xFFFFFFFF:
                raise invalid("size of ALPH")
            at = 8 + alpha + (alpha & 1)
            if at + 8 > size:
                raise CodecError(TRUNCATED)
            if d[at : at + 4] != b"VP8 ":
                raise invalid("no image after ALPH")
            declared = number(d, at + 4, 4)
            have = min(declared, size - at - 8)
            if have < declared:
                i.truncated = True
                if not self.partial:
                    raise CodecError(TRUNCATED)
            i.alphas, i.image = [(8, alpha)], ("VP8 ", at + 8, have)
            i.has_alpha = i.image_alpha = True
            if have < 10:
                raise CodecError(TRUNCATED)
            self.bitstream("VP8 ", at + 8, have, declared)
        else:
            raise CodecError(TRUNCATED if size < 12 and self.partial else NOT_WEBP)
        i.frame_count = i.images = 1
        i.end = size
        if not i.width or not i.height:
            raise invalid("header of the image")


def scan(data: bytes | None, partial: bool = True) -> Info:
    """The headers of a file, or of its first part (partial: its end may be missing). A broken rule stands in status and error; what came before it stays."""
    w = Walk(data or b"", partial)
    d = w.data
    try:
        if 4 <= len(d) < 12 and d[:4] == b"RIFF":
            raise CodecError(TRUNCATED)
        if len(d) < 12 or d[:4] != b"RIFF" or d[8:12] != b"WEBP":
            w.bare()
        else:
            w.container()
    except CodecError as e:
        w.info.status, w.info.error = e.status, str(e)
    return w.info


def checked(data: bytes | None) -> Info:
    """The headers of a whole file, which must hold all of its image: what decoding starts from."""
    i = scan(data, partial=False)
    if i.status == OK and not i.is_animation and i.image is None:
        i.status, i.error = (TRUNCATED, "the file ends inside a chunk") if i.truncated else ("invalid_data", "no image")
    return i


def alpha_allowed(info: Info, data: bytes) -> bool:
    """ALPH counts without VP8X, or where that declares alpha."""
    first = info.chunks[0] if info.chunks else None
    return first is None or first.tag != "VP8X" or bool(data[first.offset] & ALPHA_FLAG)
