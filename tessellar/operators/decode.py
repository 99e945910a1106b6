"""Image files to pictures as rows.

Frames are rows before they are decoded, so one file's frames are decoded in parallel. Stills and frames on their own need no
shuffle. Composition deals frames by file and island (what follows a key frame up to the next one, which depends on nothing
before it) and folds each island in frame order, holding one canvas; so a long animation with key frames is not one task.

A file that is null, broken, too large or not understood gives a row with its status and no planes, in place of what could not be
decoded; pictures before the break stay. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.codecs import frames as codec
from tessellar.codecs import vp8
from tessellar.codecs.pixels import Frame
from tessellar.options import SUBFRAME, Options
from tessellar.sources import riff
from tessellar.status import INTERNAL, OK, TRUNCATED, CodecError

#: Rows of pictures.
PICTURE = "frame_no int, status string, error string, format string, width int, height int, duration int, timestamp long, pos_x int, pos_y int, dispose boolean, no_blend boolean, has_alpha boolean, key boolean, planes array<binary>, warnings array<string>"
#: Rows of frames before they are decoded: their place, and the bytes of the image.
PART = "frame_no int, island int, status string, error string, canvas_w int, canvas_h int, duration int, timestamp long, pos_x int, pos_y int, width int, height int, dispose boolean, no_blend boolean, has_alpha boolean, key boolean, still boolean, data binary"
#: Rows of frames after that, in their own formats.
RAW = "frame_no int, island int, status string, error string, canvas_w int, canvas_h int, duration int, timestamp long, pos_x int, pos_y int, width int, height int, dispose boolean, no_blend boolean, has_alpha boolean, key boolean, fmt string, own_w int, own_h int, planes array<binary>, warnings array<string>"


def batches_of(rows: Iterator[tuple], ids: pa.Array, names: list[str], types: list[pa.DataType], id_col: str) -> Iterator[pa.RecordBatch]:
    """One batch a row, as rows may be large; ids has one element."""
    for r in rows:
        yield pa.RecordBatch.from_arrays([ids, *(pa.array([v], t) for v, t in zip(r, types, strict=True))], [id_col, *names])


def shaped(df: DataFrame, id_col: str, shape: str, rows_of) -> DataFrame:
    """rows_of(row of df as a dictionary) gives the rows of the result, which get the id."""
    from pyspark.sql.pandas.types import to_arrow_schema

    probe = to_arrow_schema(df.sparkSession.createDataFrame([], shape).schema)
    names, types, columns = probe.names, list(probe.types), df.columns
    kind = df.schema[id_col].dataType.simpleString()
    at = columns.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b.column(j)[k].as_py() for j, c in enumerate(columns) if j != at}
                yield from batches_of(rows_of(row), b.column(at).slice(k, 1), names, types, id_col)

    return df.mapInArrow(run, f"`{id_col}` {kind}, {shape}")


def explode_frames(files: DataFrame, options: Options, id_col: str = "path") -> DataFrame:
    """One row a frame, with key frames and timestamps worked out from the headers; a still is one frame."""

    def rows_of(row: dict) -> Iterator[tuple]:
        data = row["content"]
        info = riff.checked(data)
        failed = lambda n, status, error: (n, 0, status, error, 0, 0, 0, 0, 0, 0, 0, 0, False, False, False, False, False, None)
        try:
            if info.status != OK:
                raise CodecError(info.status, info.error)
            options.fits(info.width, info.height)
        except CodecError as e:
            yield failed(0, e.status, str(e))
            return
        size = (info.width, info.height)
        if not info.is_animation:
            yield (0, 0, OK, "", *size, 0, 0, 0, 0, *size, False, False, info.has_alpha, True, True, data)
            return
        island, time = -1, 0
        whole = [f for f in info.frames if f.complete]
        for n, (f, p) in enumerate(zip(whole, codec.placed_frames(info), strict=True)):
            island += p.key
            yield (n, island, OK, "", *size, f.duration, time, p.pos_x, p.pos_y, p.width, p.height, p.dispose, p.no_blend, p.has_alpha, p.key, False, data[f.offset : f.offset + f.size])
            time += f.duration
        if info.truncated:
            yield failed(len(whole), TRUNCATED, "the file ends inside a chunk")[:1] + (max(island, 0),) + failed(0, TRUNCATED, "the file ends inside a chunk")[2:]

    return shaped(files.select(id_col, "content"), id_col, PART, rows_of)


def placed(r: dict) -> codec.Placed:
    return codec.Placed(r["pos_x"], r["pos_y"], r["width"], r["height"], r["dispose"], r["no_blend"], r["has_alpha"], r["key"])


def decode_rows(r: dict, options: Options, tables: vp8.Tables | None) -> tuple[Frame | None, str, str, list[str]]:
    """A frame's own pixels, status, error and warnings."""
    if r["status"] != OK:
        return None, r["status"], r["error"], []
    try:
        bypass = options.without_filter(r["canvas_w"], r["canvas_h"])
        if r["still"]:
            frame, _, warnings = codec.decode_still(r["data"], riff.checked(r["data"]), tables, bypass)
        else:
            frame, _, warnings = codec.decode_part(r["data"], tables, bypass)
            warnings = warnings + codec.check_part(placed(r), frame, r["canvas_w"], r["canvas_h"])
        return frame, OK, "", warnings
    except CodecError as e:
        return None, e.status, str(e), []
    except Exception as e:  # what a decoder should never do still ends one row, not the job
        return None, INTERNAL, f"{type(e).__name__}: {e}", []


def picture_row(r: dict, frame: Frame | None, status: str, error: str, warnings: list[str], options: Options) -> tuple:
    made = None
    if frame is not None:
        try:
            made = codec.export(frame, options)
        except CodecError as e:
            status, error = e.status, str(e)
    own = (made.fmt, made.width, made.height) if made else (None, None, None)
    return (r["frame_no"], status, error, *own, r["duration"], r["timestamp"], r["pos_x"], r["pos_y"], r["dispose"], r["no_blend"], r["has_alpha"], r["key"], made.planes if made else None, warnings)


def decode(files: DataFrame, options: Options | None = None, tables: vp8.Tables | None = None, id_col: str = "path", kind: str = "any") -> DataFrame:
    """One row a picture: id_col and PICTURE. tables: the probabilities of lossy frames, without which these are unsupported.

    kind: "stills" or "animations" where only such files are wanted; files are then read once. "any" reads them once for each kind, as
    stills are not shuffled and frames are.
    """
    options = (options or Options()).check()
    parts = explode_frames(files, options, id_col)
    alone = options.animation == SUBFRAME

    def finished(row: dict) -> Iterator[tuple]:
        frame, status, error, warnings = decode_rows(row, options, tables)
        yield picture_row(row, frame, status, error, warnings, options)

    if alone:
        return shaped(parts, id_col, PICTURE, finished)

    def raw(row: dict) -> Iterator[tuple]:
        frame, status, error, warnings = decode_rows(row, options, tables)
        head = tuple(row[c] for c in ("canvas_w", "canvas_h", "duration", "timestamp", "pos_x", "pos_y", "width", "height", "dispose", "no_blend", "has_alpha", "key"))
        own = (frame.fmt, frame.width, frame.height, [p.astype(np.uint8).tobytes() for p in frame.planes]) if frame else (None, None, None, None)
        yield (row["frame_no"], row["island"], status, error, *head, *own, warnings)

    # pictures of files that are no animations need no canvas
    single = (F.col("still") | (F.col("canvas_w") == 0)) & (F.col("frame_no") == 0)
    stills = shaped(parts.where(single), id_col, PICTURE, finished)
    if kind == "stills":
        return stills
    moving = shaped(parts.where(~single), id_col, RAW, raw)
    if kind == "animations":
        return composite(moving, options, id_col)
    return stills.unionByName(composite(moving, options, id_col))


def frame_of(r: dict) -> Frame:
    w, h = r["own_w"], r["own_h"]
    half = (h + 1 >> 1, w + 1 >> 1)
    shapes = [(h, w, 4)] if r["fmt"] == "argb" else [(h, w), half, half, (h, w)]
    return Frame(r["fmt"], [np.frombuffer(p, np.uint8).reshape(s).astype(np.int64) for p, s in zip(r["planes"], shapes, strict=False)])


def composite(raw: DataFrame, options: Options, id_col: str = "path") -> DataFrame:
    """Folds frames (id_col and RAW) into pictures, each island by itself and in order. After a frame that failed the rest of its island has that status."""
    from pyspark.sql.pandas.types import to_arrow_schema

    probe = to_arrow_schema(raw.sparkSession.createDataFrame([], PICTURE).schema)
    columns = raw.columns
    at = columns.index(id_col)
    kind = raw.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, canvas, failed = None, None, None
        for b in batches:
            for k in range(b.num_rows):
                r = {c: b.column(j)[k].as_py() for j, c in enumerate(columns)}
                if own != (r[id_col], r["island"]):
                    own, failed = (r[id_col], r["island"]), None
                    canvas = codec.Canvas(r["canvas_w"], r["canvas_h"], options)
                status, error, picture = r["status"], r["error"], None
                if failed:
                    status, error = failed
                elif status != OK:
                    failed = status, error
                else:
                    picture = canvas.add(placed(r), frame_of(r))
                yield from batches_of([picture_row(r, picture, status, error, r["warnings"] or [], options)], b.column(at).slice(k, 1), probe.names, list(probe.types), id_col)

    dealt = raw.repartition(id_col, "island").sortWithinPartitions(id_col, "island", "frame_no")
    return dealt.mapInArrow(run, f"`{id_col}` {kind}, {PICTURE}")
