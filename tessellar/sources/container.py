"""Image files as tables: files, chunks, headers, frames and metadata. None of them decodes pixels."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.sources import riff
from tessellar.status import OK, TOO_LARGE

INFO = "status string, error string, width int, height int, has_alpha boolean, is_animation boolean, frame_count int, loop_count int, background_argb long, coding string, metadata int, truncated boolean, raw string, durations_ms array<int>, warnings array<string>"
CHUNK = "seq int, tag string, offset long, size long, complete boolean, head binary"
FRAME = "frame_no int, pos_x int, pos_y int, width int, height int, duration int, dispose boolean, no_blend boolean, has_alpha boolean, complete boolean, offset long, size long"
PAYLOADS = "icc binary, exif binary, xmp binary"


def read_images(spark: SparkSession, path: str, max_bytes: int = 1280 << 20) -> DataFrame:
    """path, length, content and status of files. One longer than max_bytes is not read: it has no content and the status too_large."""
    files = spark.read.format("binaryFile").load(path)
    read = files.where(F.col("length") <= max_bytes).select("path", "length", "content", F.lit(OK).alias("status"))
    rest = files.where(F.col("length") > max_bytes).select("path", "length", F.lit(None).cast("binary").alias("content"), F.lit(TOO_LARGE).alias("status"))
    return read.unionByName(rest)


def read_local(spark: SparkSession, stream, name: str = "-", max_bytes: int = 1280 << 20) -> DataFrame:
    """One file from an open stream of the driver, such as standard input."""
    data = stream.read(max_bytes + 1)
    row = (name, len(data), None, TOO_LARGE) if len(data) > max_bytes else (name, len(data), bytes(data), OK)
    return spark.createDataFrame([row], "path string, length long, content binary, status string")


def per_file(files: DataFrame, id_col: str, shape: str, rows_of) -> DataFrame:
    """id_col and the rows that rows_of gives of each file's content."""
    kind = files.schema[id_col].dataType.simpleString()
    probe = files.sparkSession.createDataFrame([], shape).schema
    names = [f.name for f in probe]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(probe)
        for b in batches:
            for k in range(b.num_rows):  # a file at a time, as contents may be large
                rows = rows_of(b.column(1)[k].as_py())
                ids = pa.array([0] * len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1).take(ids), *(pa.array([r[j] for r in rows], t.type) for j, t in enumerate(types))], [id_col, *names])

    return files.select(id_col, "content").mapInArrow(run, f"`{id_col}` {kind}, {shape}")


def riff_chunks(files: DataFrame, id_col: str = "path") -> DataFrame:
    """One row a chunk: id_col, seq, tag, offset, size, complete, and head, the first 32 bytes of its payload."""

    def rows_of(data: bytes | None) -> list[tuple]:
        return [(n, c.tag, c.offset, c.size, c.complete, data[c.offset : c.offset + min(c.size, 32)]) for n, c in enumerate(riff.scan(data).chunks)]

    return per_file(files, id_col, CHUNK, rows_of)


def image_info(files: DataFrame, id_col: str = "path") -> DataFrame:
    """One row a file: id_col, status and error of the first broken rule, and what the headers tell before it."""

    def rows_of(data: bytes | None) -> list[tuple]:
        i = riff.scan(data)
        durations = [f.duration for f in i.frames if f.complete]
        return [(i.status, i.error, i.width, i.height, i.has_alpha, i.is_animation, i.frame_count, i.loop_count, i.background_argb, i.coding, i.metadata, i.truncated, i.raw, durations, i.warnings)]

    return per_file(files, id_col, INFO, rows_of)


def frame_table(files: DataFrame, id_col: str = "path") -> DataFrame:
    """One row a frame of an animation (the last one may not be complete); a still is one frame of the canvas's size."""

    def rows_of(data: bytes | None) -> list[tuple]:
        i = riff.scan(data)
        if i.is_animation:
            return [(n, f.pos_x, f.pos_y, f.width, f.height, f.duration, f.dispose, f.no_blend, f.has_alpha, f.complete, f.offset, f.size) for n, f in enumerate(i.frames)]
        if i.status != OK or not i.image:
            return []
        return [(0, 0, 0, i.width, i.height, 0, False, False, i.has_alpha, not i.truncated, i.image[1], i.image[2])]

    return per_file(files, id_col, FRAME, rows_of)


def metadata(files: DataFrame, id_col: str = "path") -> DataFrame:
    """id_col and the payloads of the first ICC profile, Exif and XMP chunks that are not empty, as they are."""

    def rows_of(data: bytes | None) -> list[tuple]:
        found = riff.scan(data).payloads
        return [tuple(data[found[t][0] : sum(found[t])] if t in found else None for t in riff.METADATA)]

    return per_file(files, id_col, PAYLOADS, rows_of)


def info_json() -> F.Column:
    """One JSON object for each row of image_info."""
    flag = lambda bit: F.col("metadata").bitwiseAND(bit) != 0
    own = ["width", "height", "coding", "is_animation", "frame_count", "loop_count", "has_alpha"]
    return F.to_json(F.struct(*own, flag(1).alias("has_icc"), flag(2).alias("has_exif"), flag(4).alias("has_xmp"), "durations_ms"))


def info_text() -> F.Column:
    """Lines of names and values for each row of image_info."""
    flag = lambda c: F.col(c).cast("int").cast("string")
    lines = [("canvas", F.format_string("%dx%d", "width", "height")), ("coding", F.col("coding")), ("alpha", flag("has_alpha")), ("animation", flag("is_animation")), ("frames", F.col("frame_count").cast("string")), ("loops", F.col("loop_count").cast("string")), ("background", F.concat(F.lit("0x"), F.lower(F.lpad(F.hex("background_argb"), 8, "0"))))]
    return F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), v) for k, v in lines))


def frame_text() -> F.Column:
    """One line for each row of frame_table."""
    flag = lambda c: F.col(c).cast("int")
    return F.format_string("table %d: %dx%d at %d,%d duration %d dispose %d blend %d alpha %d complete %d", "frame_no", "width", "height", "pos_x", "pos_y", "duration", flag("dispose"), flag("no_blend"), flag("has_alpha"), flag("complete"))
