"""Queries on image files that are made from the events raster: one file an image, its pixels as lossless literals.

The files are synthesised in the query, as the tables hold none; so what a decoder must find in them is known to SQL.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.operators import decode
from tessellar.options import SUBFRAME, Options
from tessellar.plans import raster
from tessellar.sinks import muxers
from tessellar.sources import container
from tessellar.streaming.incremental import advance

#: Bits of byte values turned about, as codes of eight bits are sent.
TURNED = np.array([int(f"{v:08b}"[::-1], 2) for v in range(256)])


def literal_image(argb: np.ndarray) -> bytes:
    """A lossless bitstream of literals: every value of a channel has the eight-bit code of its own number. argb: (height, width, 4)."""
    h, w, _ = argb.shape
    head, n = 0x2F | (w - 1) << 8 | (h - 1) << 22 | 1 << 36, 40
    n += 1  # no transform
    n += 1  # no colour cache
    n += 1  # one group of codes
    for _ in range(4):  # green, red, blue, alpha: 256 symbols of length 8; the length code has the one symbol 8, which takes no bits
        n += 1  # a normal code
        head |= (12 - 4) << n  # twelve lengths of the length code are sent
        n += 4
        head |= 1 << n + 3 * 11  # the last is that of 8: one
        n += 3 * 12
        head |= 1 << n  # a greatest symbol is sent
        n += 1
        head |= 3 << n  # in 2 + 2 * 3 bits
        n += 3
        head |= (256 - 2) << n
        n += 8
    head |= 1 << n  # distances: a simple code, of one symbol, 0, in one bit
    n += 4
    sent = np.stack([TURNED[argb[..., k]] for k in (2, 1, 3, 0)], 2).astype(np.uint8).tobytes()
    return (head | int.from_bytes(sent, "little") << n).to_bytes((n + 8 * len(sent) + 7) // 8, "little")


def chunk(tag: bytes, data: bytes) -> bytes:
    return tag + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def riff(*chunks: bytes) -> bytes:
    body = b"WEBP" + b"".join(chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def built(spark: SparkSession, sf_dir: str, make: Callable[[np.ndarray], bytes]) -> DataFrame:
    """path (the image's number) and content; images are built side by side."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        argb = np.zeros((pdf["y"].max() + 1, pdf["x"].max() + 1, 4), np.int64)
        for k, c in enumerate("argb"):
            argb[pdf["y"], pdf["x"], k] = pdf[c]
        return pd.DataFrame({"path": [pdf["image_id"].iat[0]], "content": [make(argb)]})

    return raster.raster(spark, sf_dir).groupBy("image_id").applyInPandas(run, "path long, content binary")


def stills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir, lambda argb: riff(chunk(b"VP8L", literal_image(argb))))


def u24(n: int) -> bytes:
    return struct.pack("<I", n)[:3]


def strips(argb: np.ndarray) -> bytes:
    """An animation whose frames are the pairs of rows, which replace what is there."""
    h, w, _ = argb.shape
    parts = [chunk(b"VP8X", bytes([0x12, 0, 0, 0]) + u24(w - 1) + u24(h - 1)), chunk(b"ANIM", struct.pack("<IH", 0, 1))]
    for k in range(0, h, 2):
        rows = argb[k : k + 2]
        parts.append(chunk(b"ANMF", u24(0) + u24(k // 2) + u24(w - 1) + u24(len(rows) - 1) + u24(k + 1) + b"\2" + chunk(b"VP8L", literal_image(rows))))
    return riff(*parts)


def moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir, strips)


def pixels_of(pictures: DataFrame) -> DataFrame:
    """image_id, x, y, r, g, b, a of ARGB pictures."""
    shape = "image_id long, x long, y long, r long, g long, b long, a long"

    def run(frames):
        for f in frames:
            for k, w, h, planes in zip(f["path"], f["width"], f["height"], f["planes"], strict=True):
                p = np.frombuffer(planes[0], np.uint8).reshape(int(h), int(w), 4).astype(np.int64)
                y, x = np.divmod(np.arange(int(w) * int(h)), int(w))
                yield pd.DataFrame({"image_id": k, "x": x, "y": y, **{c: p[..., j].ravel() for j, c in enumerate("argb")}})[["image_id", "x", "y", "r", "g", "b", "a"]]

    return pictures.select("path", "width", "height", "planes").mapInPandas(run, shape)


def as_image(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("path", "image_id")


HEADER_BITS = 40 + 3 + 4 * 53 + 4
SIZES = f", s AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM p GROUP BY image_id), z AS (SELECT *, ({HEADER_BITS} + 32 * w * h + 7) // 8 AS size FROM s)"
HEXES = "lower(lpad(hex({}), 2, '0') || lpad(hex({}), 2, '0') || lpad(hex({}), 2, '0') || lpad(hex({}), 2, '0'))"
RGBA, ARGB = HEXES.format(*"rgba"), HEXES.format(*"argb")
PAIRS = ", k AS (SELECT image_id, y // 2 AS frame_no, CAST(count(DISTINCT y) AS INTEGER) AS rows, min(y) AS top FROM p GROUP BY ALL)"


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of animations that arrive in parts of 4096 bytes, by the state that the streaming operator keeps."""
    from tessellar.codecs.stream import Stream

    def rows_of(row: dict):
        s, data = Stream(Options(fmt="argb")), row["content"]
        for at in range(0, len(data), 4096):
            for r in advance(s, [(data[at : at + 4096], at + 4096 >= len(data))]):
                yield r[0], r[1], r[6], r[7][0] if r[7] else None

    out = decode.shaped(moving(spark, sf_dir), "path", "frame_no int, status string, timestamp long, data binary", rows_of)
    return as_image(out).select("image_id", "frame_no", "timestamp", F.md5("data").alias("digest"))


def animated(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decode.decode(moving(spark, sf_dir), Options(fmt="argb"), kind="animations")
    return as_image(got).select("image_id", "frame_no", "timestamp", F.md5(F.col("planes")[0]).alias("digest"))


ANIMATED = PAIRS + f" SELECT k.image_id, CAST(k.frame_no AS INTEGER) AS frame_no, CAST(k.frame_no * k.frame_no AS BIGINT) AS timestamp, md5(unhex(string_agg(CASE WHEN y // 2 <= k.frame_no THEN {ARGB} ELSE '00000000' END, '' ORDER BY y, x))) AS digest FROM k JOIN p USING (image_id) GROUP BY k.image_id, k.frame_no"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "image_info": lambda s, d: as_image(container.image_info(stills(s, d))).select("image_id", "status", "width", "height", "has_alpha", "is_animation", "frame_count", "coding"),
    "riff_chunks": lambda s, d: as_image(container.riff_chunks(stills(s, d))).select("image_id", "seq", "tag", "offset", "size", "complete"),
    "frame_table": lambda s, d: as_image(container.frame_table(moving(s, d))).select("image_id", "frame_no", "pos_y", "width", "height", "duration", "no_blend", "has_alpha"),
    "decode_lossless": lambda s, d: pixels_of(decode.decode(stills(s, d), Options(fmt="argb"), kind="stills")),
    "decode_cropped": lambda s, d: pixels_of(decode.decode(stills(s, d), Options(fmt="argb", crop=(7, 1, 40, 4), flip=True), kind="stills")),
    "decode_md5": lambda s, d: as_image(muxers.file_md5(decode.decode(stills(s, d), Options(fmt="rgba"), kind="stills"))).select("image_id", "frames", "md5", "status"),
    "decode_planar": lambda s, d: as_image(decode.decode(stills(s, d), Options(fmt="yuva420p"), kind="stills")).select("image_id", "width", "height", F.length(F.col("planes")[1]).cast("long").alias("chroma_bytes"), F.md5(F.col("planes")[0]).alias("luma_md5"), F.md5(F.col("planes")[3]).alias("alpha_md5")),
    "decode_animation": animated,
    "decode_subframes": lambda s, d: as_image(decode.decode(moving(s, d), Options(fmt="rgba", animation=SUBFRAME))).select("image_id", "frame_no", "height", F.md5(F.col("planes")[0]).alias("digest")),
    "decode_stream": streamed,
    "mux_pam": lambda s, d: as_image(muxers.muxed(decode.decode(stills(s, d), Options(fmt="rgba"), kind="stills"), "pam")).select("image_id", F.length("data").cast("long").alias("bytes"), F.md5("data").alias("digest")),
}
SQL = {
    "image_info": SIZES + " SELECT image_id, 'ok' AS status, CAST(w AS INTEGER) AS width, CAST(h AS INTEGER) AS height, true AS has_alpha, false AS is_animation, CAST(1 AS INTEGER) AS frame_count, 'lossless' AS coding FROM z",
    "riff_chunks": SIZES + " SELECT image_id, CAST(0 AS INTEGER) AS seq, 'VP8L' AS tag, CAST(20 AS BIGINT) AS \"offset\", CAST(size AS BIGINT) AS size, true AS complete FROM z",
    "frame_table": PAIRS + " SELECT image_id, CAST(frame_no AS INTEGER) AS frame_no, CAST(top AS INTEGER) AS pos_y, CAST(125 AS INTEGER) AS width, rows AS height, CAST(top + 1 AS INTEGER) AS duration, true AS no_blend, true AS has_alpha FROM k",
    "decode_lossless": " SELECT image_id, x, y, r, g, b, a FROM p",
    "decode_cropped": " SELECT image_id, x - 7 AS x, 4 - y AS y, r, g, b, a FROM p WHERE x BETWEEN 7 AND 46 AND y BETWEEN 1 AND 4",
    "decode_md5": f" SELECT image_id, CAST(1 AS INTEGER) AS frames, md5(unhex(string_agg({RGBA}, '' ORDER BY y, x))) AS md5, 'ok' AS status FROM p GROUP BY image_id",
    "decode_planar": " SELECT image_id, CAST(max(x) + 1 AS INTEGER) AS width, CAST(max(y) + 1 AS INTEGER) AS height, ((max(x) + 2) // 2) * ((max(y) + 2) // 2) AS chroma_bytes, md5(unhex(string_agg(lower(lpad(hex((16839*r + 33059*g + 6420*b + 1081344) >> 16), 2, '0')), '' ORDER BY y, x))) AS luma_md5, md5(unhex(string_agg(lower(lpad(hex(a), 2, '0')), '' ORDER BY y, x))) AS alpha_md5 FROM p GROUP BY image_id",
    "decode_animation": ANIMATED,
    "decode_subframes": f" SELECT image_id, CAST(y // 2 AS INTEGER) AS frame_no, CAST(count(DISTINCT y) AS INTEGER) AS height, md5(unhex(string_agg({RGBA}, '' ORDER BY y, x))) AS digest FROM p GROUP BY image_id, y // 2",
    "decode_stream": ANIMATED,
    "mux_pam": f", s AS (SELECT image_id, 'P7' || chr(10) || 'WIDTH ' || (max(x) + 1) || chr(10) || 'HEIGHT ' || (max(y) + 1) || chr(10) || 'DEPTH 4' || chr(10) || 'MAXVAL 255' || chr(10) || 'TUPLTYPE RGB_ALPHA' || chr(10) || 'ENDHDR' || chr(10) AS head, string_agg({RGBA}, '' ORDER BY y, x) AS body FROM p GROUP BY image_id) SELECT image_id, CAST(length(head) + length(body) // 2 AS BIGINT) AS bytes, md5(unhex(hex(head) || body)) AS digest FROM s",
}


def oracle_sql() -> dict[str, str]:
    return {name: raster.RASTER + sql for name, sql in SQL.items()}
