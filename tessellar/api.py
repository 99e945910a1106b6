"""One file at a time, without Spark: what the operators do to each row, for callers that hold one file's bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from tessellar import status
from tessellar.codecs import frames, pixels
from tessellar.codecs.frames import Decoded, Picture
from tessellar.codecs.stream import Stream
from tessellar.codecs.vp8 import Tables
from tessellar.options import Options
from tessellar.sources import riff

VERSION = "0.2.0"
#: What each status means.
TEXTS = {
    status.OK: "success", status.TRUNCATED: "the data end too early", status.INVALID_DATA: "the data break a rule of the format", status.NOT_WEBP: "not an image of this kind",
    status.UNSUPPORTED: "not supported", status.TOO_LARGE: "larger than allowed", status.INVALID_ARGUMENT: "a wrong argument", status.BUFFER_TOO_SMALL: "the output does not fit",
    status.INTERNAL: "a fault of the decoder",
}


def info(data: bytes) -> riff.Info:
    """What a file's headers tell; CodecError where they break a rule."""
    i = riff.scan(data)
    if i.status != status.OK:
        raise status.CodecError(i.status, i.error)
    return i


def metadata(data: bytes, kind: str) -> bytes | None:
    """The payload of the first ICCP, EXIF or XMP chunk that is not empty."""
    if kind not in ("ICCP", "EXIF", "XMP"):
        raise status.CodecError(status.INVALID_ARGUMENT, f"metadata {kind}")
    at = riff.scan(data).payloads.get(f"{kind:4}")
    return data[at[0] : sum(at)] if at else None


def frame_info(data: bytes, index: int) -> riff.Frame:
    """A row of the frame table; a still is one frame of the canvas's size."""
    i = info(data)
    if not i.is_animation and index == 0:
        return riff.Frame(0, 0, i.width, i.height, 0, False, False, i.has_alpha, not i.truncated, 0, 0)
    if not 0 <= index < len(i.frames):
        raise status.CodecError(status.INVALID_ARGUMENT, "no such frame")
    return i.frames[index]


def pictures(data: bytes, options: Options | None = None, tables: Tables | None = None, log: Callable[[str], None] | None = None) -> Iterator[Decoded]:
    """All pictures of a file in order; warnings go to log, before their picture."""
    try:
        for d in frames.decode_file(data, options, tables):
            for w in d.warnings if log else []:
                log(w)
            yield d
    except status.CodecError:
        raise
    except Exception as e:  # a decoder's own fault has a status too
        raise status.CodecError(status.INTERNAL, f"{type(e).__name__}: {e}") from e


def decode(data: bytes, options: Options | None = None, tables: Tables | None = None) -> Picture:
    """The first picture."""
    return next(pictures(data, options, tables)).picture


def rows(picture: Picture, plane: int = 0) -> Iterator[bytes]:
    """A plane's rows from the top."""
    width, height = pixels.plane_sizes(picture.fmt, picture.width, picture.height)[plane]
    for y in range(height):
        yield picture.planes[plane][y * width : (y + 1) * width]


def window(picture: Picture, left: int, top: int, width: int, height: int) -> Picture:
    """A part of a packed picture."""
    if not pixels.is_packed(picture.fmt) or min(left, top) < 0 or min(width, height) <= 0 or left + width > picture.width or top + height > picture.height:
        raise status.CodecError(status.INVALID_ARGUMENT, "window")
    size = pixels.bytes_per_pixel(picture.fmt)
    part = b"".join(r[left * size : (left + width) * size] for r in list(rows(picture))[top : top + height])
    return Picture(picture.fmt, width, height, [part])


def decode_into(data: bytes, buffers: list[memoryview], strides: list[int], options: Options | None = None, tables: Tables | None = None) -> Picture:
    """The first picture's rows into the caller's buffers, one a plane; what lies between rows is left alone."""
    p = decode(data, options, tables)
    sizes = pixels.plane_sizes(p.fmt, p.width, p.height)
    if len(buffers) != len(sizes) or len(strides) != len(sizes):
        raise status.CodecError(status.INVALID_ARGUMENT, "planes")
    for (width, height), buffer, stride in zip(sizes, buffers, strides, strict=True):
        if stride < width or len(buffer) < stride * (height - 1) + width:
            raise status.CodecError(status.BUFFER_TOO_SMALL)
    for k, (buffer, stride) in enumerate(zip(buffers, strides, strict=True)):
        for y, row in enumerate(rows(p, k)):
            buffer[y * stride : y * stride + len(row)] = row
    return p


__all__ = ["Options", "Stream", "Tables", "TEXTS", "VERSION", "decode", "decode_into", "frame_info", "info", "metadata", "pictures", "rows", "window"]
