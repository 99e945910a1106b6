"""Files that arrive in parts: one file's state, which can be pickled between parts.

What an animation no longer needs is dropped: payloads of frames that were handed out stay only as their places in the frame table.
"""

from __future__ import annotations

from collections.abc import Iterator

from tessellar.codecs import frames as codec
from tessellar.codecs import vp8, vp8l
from tessellar.options import SUBFRAME, Options
from tessellar.sources import riff
from tessellar.status import INVALID_ARGUMENT, OK, TRUNCATED, UNSUPPORTED, CodecError

#: Rows that a chroma mode holds back from a packed output, as rows to come may change them, and those that a loop filter does.
CHROMA_HOLDS, FILTER_HOLDS = (0, 1, 4, 10), {"none": 0, "simple": 2, "normal": 8}
#: Consumed bytes are dropped once there are so many.
COMPACT = 64 << 10


class Stream:
    """append(part) or update(all so far), then end(); pictures() gives what is new, partial() the rows of a still that are final."""

    def __init__(self, options: Options | None = None, tables: vp8.Tables | None = None):
        self.options, self.tables = (options or Options()).check(), tables
        self.data, self.mode, self.ended = b"", None, False
        self.given, self.time, self.canvas = 0, 0, None
        self.dropped: list[tuple[int, int]] = []  # payload ranges that were emptied
        self.failed: tuple[str, str] | None = None

    def room(self) -> int | None:
        """Bytes up to the container's own end; None where it is not known."""
        if len(self.data) >= 12 and self.data[:4] == b"RIFF" and self.data[8:12] == b"WEBP":
            return riff.number(self.data, 4, 4) + 8
        return None

    def take(self, mode: str) -> None:
        if self.ended or self.mode not in (None, mode):
            raise CodecError(INVALID_ARGUMENT, "parts and whole prefixes are not mixed, and nothing follows the end")
        self.mode = mode

    def append(self, part: bytes) -> None:
        self.take("append")
        self.data += part
        room = self.room()
        if room is not None:
            self.data = self.data[:room]

    def update(self, whole: bytes) -> None:
        self.take("update")
        if len(whole) < len(self.data):
            raise CodecError(INVALID_ARGUMENT, "a prefix shrank")
        self.data = whole

    def end(self) -> None:
        self.ended = True

    def rewind(self) -> None:
        """Pictures from the first again; not for parts, as what was consumed is gone."""
        if self.mode == "append":
            raise CodecError(UNSUPPORTED, "parts cannot be read again")
        self.given, self.time, self.canvas, self.failed = 0, 0, None, None

    def info(self) -> riff.Info:
        """As far as it is known; a file that is not whole yet is no error before its end."""
        i = riff.checked(self.data) if self.ended else riff.scan(self.data)
        if not self.ended and i.status == TRUNCATED:
            i.status, i.error, i.truncated = OK, "", True
        return i

    def pictures(self) -> Iterator[codec.Decoded]:
        """Pictures that are complete and were not given yet; CodecError where the file turns out to be wrong, and again from then on."""
        if self.failed:
            raise CodecError(*self.failed)
        try:
            yield from self.fresh()
        except CodecError as e:
            self.failed = e.status, str(e)
            raise

    def fresh(self) -> Iterator[codec.Decoded]:
        i = self.info()
        if i.status != OK:
            raise CodecError(i.status, i.error)
        o = self.options
        if i.width and i.height:
            o.fits(i.width, i.height)
        if not i.is_animation:
            whole = i.image and (self.ended if i.raw else not any(not c.complete for c in i.chunks if c.tag in ("VP8 ", "VP8L")))
            if whole and not self.given and i.images:
                frame, has_alpha, warnings = codec.decode_still(self.data, i, self.tables, o.without_filter(i.width, i.height))
                self.given = 1
                yield codec.Decoded(0, codec.export(frame, o), 0, 0, codec.Placed(0, 0, i.width, i.height, has_alpha=has_alpha), warnings)
        else:
            done = [f for f in i.frames if f.complete]
            placed = codec.placed_frames(i)
            if self.canvas is None:
                self.canvas = codec.Canvas(i.width, i.height, o)
            while self.given < len(done):
                f, p = done[self.given], placed[self.given]
                # alpha of frames that were emptied is not read again: it only decides whether they are key
                frame, _, warnings = codec.decode_part(self.data[f.offset : f.offset + f.size], self.tables, o.without_filter(i.width, i.height))
                p = self.kept(p, frame)
                warnings = warnings + codec.check_part(p, frame, i.width, i.height)
                out = frame if o.animation == SUBFRAME else self.canvas.add(p, frame)
                if o.animation == SUBFRAME:
                    self.canvas.before = p
                self.given += 1
                now, self.time = self.time, self.time + f.duration
                yield codec.Decoded(self.given - 1, codec.export(out, o), f.duration, now, p, warnings)
            self.compact(done)
        if self.ended and i.truncated:
            raise CodecError(TRUNCATED, "the file ends inside a chunk")

    def kept(self, p: codec.Placed, frame) -> codec.Placed:
        """The key mark from the frame before it as it was, as earlier payloads may be gone."""
        before = self.canvas.before
        pair = [p] if before is None else [before, p]
        was = before.key if before is not None else None
        codec.key_frames(pair, self.canvas.width, self.canvas.height)
        if before is not None:
            before.key = was
            whole = (p.pos_x, p.pos_y, p.width, p.height) == (0, 0, self.canvas.width, self.canvas.height)
            size = (before.width, before.height) == (self.canvas.width, self.canvas.height)
            p.key = (whole and (p.no_blend or not p.has_alpha)) or (before.dispose and (was or size))
        return p

    def compact(self, done: list[riff.Frame]) -> None:
        """Empties given frames of appended parts: their headers stay, as chunks of 16 bytes, so that places in the table stay too."""
        if self.mode != "append" or sum(f.size for f in done[: self.given]) < COMPACT:
            return
        out, at = [], 0
        for f in done[: self.given]:
            if f.size > 16:
                out += [self.data[at : f.offset - 4], (16).to_bytes(4, "little"), self.data[f.offset : f.offset + 16]]
                at = f.offset + f.size + (f.size & 1)
        kept = b"".join([*out, self.data[at:]])
        # the container's own size shrinks with it
        gone = len(self.data) - len(kept)
        self.data = kept[:4] + (riff.number(kept, 4, 4) - gone).to_bytes(4, "little") + kept[8:]

    def partial(self) -> tuple[int, codec.Picture] | None:
        """Of a still in a container: how many rows are final, and a picture whose rows below are not."""
        i = self.info()
        if i.status != OK or i.is_animation or i.raw or not i.image or not i.width or self.options.crop or self.options.scale or self.options.flip:
            return None
        tag, at, size = i.image
        part = self.data[at : at + size]
        try:
            if tag == "VP8L":
                argb, rows = vp8l.decode_rows(part)
                frame = codec.pixels.argb_frame(argb)
            else:
                held = None
                if i.alphas and riff.alpha_allowed(i, self.data):
                    own, n = i.alphas[0]
                    held = self.data[own : own + n]
                p, rows = vp8.decode_rows(part, size, self.tables)
                planes = [x.astype("int64") for x in (p.y, p.u, p.v)]
                if held is not None:
                    planes.append(codec.alpha.decode(held, i.width, i.height).astype("int64"))
                frame = codec.Frame("yuv420p" if held is None else "yuva420p", planes)
                if self.options.fmt and codec.pixels.is_packed(self.options.fmt) and rows < i.height:
                    rows = max(0, rows - CHROMA_HOLDS[self.options.chroma])
        except CodecError:
            return None
        return rows, codec.export(frame, self.options)
