"""Frames of animations as rows: timestamps, key frames, the frame before, regions, and budgets. Ordered by frame within an image."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RECT = ("pos_x", "pos_y", "width", "height")


def ordered(image: str, frame: str) -> W:
    return W.partitionBy(image).orderBy(frame)


def frame_timestamps(frames: DataFrame, image: str, frame: str, duration: str) -> DataFrame:
    before = F.sum(duration).over(ordered(image, frame).rowsBetween(W.unboundedPreceding, -1))
    return frames.withColumn("timestamp", F.coalesce(before, F.lit(0)))


def previous_frames(frames: DataFrame, columns: Sequence[str], image: str = "image_id", frame: str = "frame_no") -> DataFrame:
    """Each frame with the columns of the one before it, as prev_<column>; null for the first."""
    return frames.select("*", *(F.lag(c).over(ordered(image, frame)).alias(f"prev_{c}") for c in columns))


def key_frames(frames: DataFrame, image: str = "image_id", frame: str = "frame_no") -> DataFrame:
    """frames with `key` and `island` (key frames so far, from 0); frames: rectangle, canvas_w, canvas_h, dispose, no_blend, has_alpha.

    A frame after one that is disposed of is key if that one was key or whole; so within a run of frames that follow disposed ones, a key
    frame makes all later ones key: a running maximum, without recursion.
    """
    own = ordered(image, frame)
    whole = (F.col("pos_x") == 0) & (F.col("pos_y") == 0) & (F.col("width") == F.col("canvas_w")) & (F.col("height") == F.col("canvas_h"))
    full = (F.col("width") == F.col("canvas_w")) & (F.col("height") == F.col("canvas_h"))
    gone = F.coalesce(F.lag("dispose").over(own), F.lit(False))
    first = F.row_number().over(own) == 1
    starts = first | (whole & (F.col("no_blend") | ~F.col("has_alpha"))) | (gone & F.coalesce(F.lag(full).over(own), F.lit(False)))
    held = frames.withColumns({"_starts": starts.cast("int"), "_cut": (~gone).cast("int")})
    held = held.withColumn("_run", F.sum("_cut").over(own))
    held = held.withColumn("key", F.max("_starts").over(W.partitionBy(image, "_run").orderBy(frame)) == 1)
    return held.withColumn("island", (F.sum(F.col("key").cast("int")).over(own) - 1).cast("int")).drop("_starts", "_cut", "_run")


def regions(frames: DataFrame, aligned: bool = False, image: str = "image_id", frame: str = "frame_no") -> DataFrame:
    """One row a part of a frame: image, frame, x, y, w, h (in the frame) and blend; frames as key_frames returns them. Empty parts are left out."""
    f = previous_frames(frames, [*RECT, "dispose"], image, frame)
    c = F.col
    kx, ky = F.greatest(c("pos_x"), c("prev_pos_x")) - c("pos_x"), F.greatest(c("pos_y"), c("prev_pos_y")) - c("pos_y")
    kw = F.least(c("pos_x") + c("width"), c("prev_pos_x") + c("prev_width")) - c("pos_x") - kx
    kh = F.least(c("pos_y") + c("height"), c("prev_pos_y") + c("prev_height")) - c("pos_y") - ky
    f = f.select("*", kx.alias("kx"), ky.alias("ky"), kw.alias("kw"), kh.alias("kh"))
    if aligned:
        even = (c("kw") > 0) & (c("kh") > 0)
        f = f.withColumns({"kw": F.when(even, c("kw") - c("kw") % 2).otherwise(c("kw")), "kh": F.when(even, c("kh") - c("kh") % 2).otherwise(c("kh"))})

    def part(x: Column, y: Column, w: Column, h: Column, blend: bool) -> Column:
        return F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), w.cast("long").alias("w"), h.cast("long").alias("h"), F.lit(blend).alias("blend"))

    zero = F.lit(0)
    whole = lambda blend: F.array(part(zero, zero, c("width"), c("height"), blend))
    five = F.array(
        part(zero, zero, c("width"), c("ky"), True),
        part(zero, c("ky") + c("kh"), c("width"), c("height") - c("ky") - c("kh"), True),
        part(zero, c("ky"), c("kx"), c("kh"), True),
        part(c("kx") + c("kw"), c("ky"), c("width") - c("kx") - c("kw"), c("kh"), True),
        part(c("kx"), c("ky"), c("kw"), c("kh"), False),
    )
    copied = c("key") | c("no_blend") | ~c("has_alpha")
    apart = F.coalesce(~c("prev_dispose") | (c("kw") <= 0) | (c("kh") <= 0), F.lit(True))
    parts = F.when(copied, whole(False)).when(apart, whole(True)).otherwise(five)
    return f.select(image, frame, F.inline(parts)).where("w > 0 and h > 0")


def within_budget(frames: DataFrame, size: str, budget: int, image: str = "image_id", frame: str = "frame_no") -> DataFrame:
    """The frames of each image whose bytes fit a budget together with those before them."""
    spent = F.sum(size).over(ordered(image, frame))
    return frames.withColumn("spent", spent).where(F.col("spent") <= budget)


def first_frames(frames: DataFrame, most: int, image: str = "image_id", frame: str = "frame_no") -> DataFrame:
    """The first `most` frames of each image (the cap of a frame table)."""
    return frames.withColumn("_n", F.row_number().over(ordered(image, frame))).where(F.col("_n") <= most).drop("_n")
