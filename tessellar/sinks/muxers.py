"""Pictures as bytes of a file: raw planes, PPM, PAM, Y4M, and the MD5 of what would be written.

A picture's bytes are a column expression over its planes, but for the planes that Y4M doubles. One file has one header, before its
first frame; MD5 runs over the bytes of a file's frames in order, one frame at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellar.codecs import pixels
from tessellar.status import INVALID_ARGUMENT, CodecError

MUXERS = ("raw", "md5", "ppm", "pam", "y4m", "null")


def format_for(muxer: str, fmt: str | None, coding: str = "unknown", has_alpha: bool = False) -> str | None:
    """The format to decode to; the one asked for must suit the muxer. coding and has_alpha: what the file's headers tell."""
    if muxer not in MUXERS:
        raise CodecError(INVALID_ARGUMENT, f"muxer {muxer}")
    only = {"ppm": "rgb", "pam": "rgba"}.get(muxer)
    if only:
        if fmt not in (None, only):
            raise CodecError(INVALID_ARGUMENT, f"{muxer} takes {only} only")
        return only
    if muxer != "y4m":
        return fmt
    if fmt is None:
        return "argb" if coding == "lossless" else "yuva420p" if has_alpha else "yuv420p"
    if fmt not in ("yuv420p", "yuva420p"):
        raise CodecError(INVALID_ARGUMENT, "y4m takes yuv420p or yuva420p only")
    return fmt


def ascii_bytes(c: Column) -> Column:
    return F.encode(c, "US-ASCII")


def frame_bytes(pictures: DataFrame, muxer: str) -> Column:
    """The bytes of a picture, headers of its own included; null where it has no planes or the wrong format."""
    whole = F.aggregate("planes", F.lit(b""), lambda a, p: F.concat(a, p))
    if muxer == "ppm":
        return F.when(F.col("format") == "rgb", F.concat(ascii_bytes(F.format_string("P6\n%d %d\n255\n", "width", "height")), whole))
    if muxer == "pam":
        return F.when(F.col("format") == "rgba", F.concat(ascii_bytes(F.format_string("P7\nWIDTH %d\nHEIGHT %d\nDEPTH 4\nMAXVAL 255\nTUPLTYPE RGB_ALPHA\nENDHDR\n", "width", "height")), whole))
    return whole


def y4m_header(width: int, height: int, fmt: str, has_alpha: bool) -> bytes:
    colour = "444alpha" if fmt == "yuva420p" or (fmt == "argb" and has_alpha) else "444" if fmt == "argb" else "420jpeg"
    return f"YUV4MPEG2 W{width} H{height} F0:0 Ip A0:0 C{colour}\n".encode()


def y4m_frame(fmt: str, width: int, height: int, planes: list[bytes], has_alpha: bool) -> bytes:
    if fmt == "argb":
        argb = np.frombuffer(planes[0], np.uint8).reshape(height, width, 4).astype(np.int64)
        out = [p.astype(np.uint8).tobytes() for p in pixels.argb_to_yuv444(pixels.Frame("argb", [argb]))]
        return b"FRAME\n" + b"".join(out) + (argb[..., 0].astype(np.uint8).tobytes() if has_alpha else b"")
    if fmt == "yuv420p":
        return b"FRAME\n" + b"".join(planes)
    half = (height + 1 >> 1, width + 1 >> 1)
    at = np.ix_(np.arange(height) >> 1, np.arange(width) >> 1)
    u, v = (np.frombuffer(p, np.uint8).reshape(half)[at].tobytes() for p in planes[1:3])
    return b"FRAME\n" + planes[0] + u + v + planes[3]


def in_order(pictures: DataFrame, id_col: str, shape: str, step) -> DataFrame:
    """Files side by side, the pictures of each in order: step(state, row) gives the new state and rows of the result; None as row ends a file."""
    from pyspark.sql.pandas.types import to_arrow_schema

    probe = to_arrow_schema(pictures.sparkSession.createDataFrame([], shape).schema)
    columns = ["frame_no", "status", "format", "width", "height", "has_alpha", "planes"]
    kind = pictures.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(ids: pa.Array, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            for r in rows:
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([v], t) for v, t in zip(r, probe.types, strict=True))], [id_col, *probe.names])

        own, ids, state = None, None, None
        for b in batches:
            for k in range(b.num_rows):
                here = b.column(0)[k].as_py()
                if ids is None or here != own:
                    if ids is not None:
                        yield from made(ids, step(state, None)[1])
                    own, ids, state = here, b.column(0).slice(k, 1), None
                row = {c: b.column(j + 1)[k].as_py() for j, c in enumerate(columns)}
                state, rows = step(state, row)
                yield from made(ids, rows)
        if ids is not None:
            yield from made(ids, step(state, None)[1])

    dealt = pictures.select(id_col, *columns).repartition(id_col).sortWithinPartitions(id_col, "frame_no")
    return dealt.mapInArrow(run, f"`{id_col}` {kind}, {shape}")


def y4m(pictures: DataFrame, id_col: str = "path") -> DataFrame:
    """id_col, frame_no, status and data (with the file's header before its first frame). One size and format a file: what differs has the status invalid_argument."""

    def step(state: tuple | None, r: dict | None) -> tuple[tuple | None, list[tuple]]:
        if r is None:
            return state, []
        if r["status"] != "ok":
            return state, [(r["frame_no"], r["status"], None)]
        now = (r["format"], r["width"], r["height"], state[3] if state else r["has_alpha"])
        if r["format"] not in ("yuv420p", "yuva420p", "argb") or (state and now != state):
            return state, [(r["frame_no"], INVALID_ARGUMENT, None)]
        head = b"" if state else y4m_header(now[1], now[2], now[0], now[3])
        return now, [(r["frame_no"], "ok", head + y4m_frame(now[0], now[1], now[2], r["planes"], now[3]))]

    return in_order(pictures, id_col, "frame_no int, status string, data binary", step)


def file_md5(pictures: DataFrame, id_col: str = "path") -> DataFrame:
    """id_col, frames, md5 of the planes of a file's pictures in order, and the first status that is not ok."""

    def step(state: tuple | None, r: dict | None) -> tuple[tuple | None, list[tuple]]:
        held, n, status = state or (hashlib.md5(), 0, "ok")
        if r is None:
            return state, [(n, held.hexdigest(), status)]
        if r["status"] != "ok":
            return (held, n, r["status"] if status == "ok" else status), []
        for p in r["planes"]:
            held.update(p)
        return (held, n + 1, status), []

    return in_order(pictures, id_col, "frames int, md5 string, status string", step)


def muxed(pictures: DataFrame, muxer: str, id_col: str = "path") -> DataFrame:
    """id_col, frame_no, status and data of each picture, in any order of rows."""
    if muxer == "y4m":
        return y4m(pictures, id_col)
    data = frame_bytes(pictures, muxer)
    wrong = (F.col("status") == "ok") & data.isNull()
    return pictures.select(id_col, "frame_no", F.when(wrong, INVALID_ARGUMENT).otherwise(F.col("status")).alias("status"), data.alias("data"))
