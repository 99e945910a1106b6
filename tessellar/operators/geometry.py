"""Pixel tables: geometry, chroma, palettes, tiles and recurrences. Rows have key columns (an image, or an image and a frame), x and y.

Every operator keeps images apart by their keys: windows, groups and joins carry them, so a table of many images is dealt by image
and row. Columns that an operator does not name stay where it returns the pixels themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessellar.functions import color

KEYS = ("image_id",)
#: Taps of the chroma filters.
LANCZOS = (148, -495, 1146, -2658, 14699, 4740, -1709, 767, -295, 41)
FAST = (-10, 59, 15, 0)


def crop(pixels: DataFrame, left: int, top: int, width: int, height: int, planar: bool = False) -> DataFrame:
    """Planar pictures are cut at even places."""
    if planar:
        left, top = left & ~1, top & ~1
    inside = pixels.where(F.col("x").between(left, left + width - 1) & F.col("y").between(top, top + height - 1))
    return inside.withColumns({"x": F.col("x") - left, "y": F.col("y") - top})


def flip(pixels: DataFrame, height: int | Column) -> DataFrame:
    return pixels.withColumn("y", (height if isinstance(height, Column) else F.lit(height)) - 1 - F.col("y"))


def sizes(pixels: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, width and height of each image."""
    return pixels.groupBy(*keys).agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def scaled_size(width: Column, height: Column, w: Column, h: Column) -> dict[str, Column]:
    """A side of 0 keeps the proportions, rounded up."""
    up = lambda a, b: F.floor((a + b - 1) / b).cast("long")
    return {"w": F.when(w == 0, up(width * h, height)).otherwise(w), "h": F.when(h == 0, up(height * w, width)).otherwise(h)}


def clear_rect(pixels: DataFrame, left: int, top: int, width: int, height: int, colour: dict[str, int]) -> DataFrame:
    inside = F.col("x").between(left, left + width - 1) & F.col("y").between(top, top + height - 1)
    return pixels.withColumns({c: F.when(inside, F.lit(v).cast("long")).otherwise(F.col(c)) for c, v in colour.items()})


def copy_rect(canvas: DataFrame, frame: DataFrame, left: int, top: int, values: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """canvas with frame's pixels from (left, top) on; what lies off the canvas is left out."""
    moved = frame.select(*keys, (F.col("x") + left).alias("x"), (F.col("y") + top).alias("y"), F.struct(*values).alias("_new"))
    joined = canvas.join(moved, [*keys, "x", "y"], "left")
    return joined.withColumns({c: F.coalesce(F.col("_new")[c], F.col(c)) for c in values}).drop("_new")


def chroma_box(pixels: DataFrame, value: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """2 x 2 means, rounded; at an odd edge the last sample counts twice. Blocks are grouped once, without the images' sizes: what misses is known from the count."""
    half = lambda c: F.shiftright(F.col(c), 1).alias(c)
    return pixels.groupBy(*keys, half("x"), half("y")).agg(F.shiftright((F.sum(value) * 4 / F.count(value)).cast("long") + 2, 2).alias(value))


def chroma_point(luma: DataFrame, chroma: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every pixel with the chroma sample of its 2 x 2 block."""
    at = chroma.withColumnsRenamed({"x": "_cx", "y": "_cy"})
    return luma.withColumns({"_cx": F.shiftright("x", 1), "_cy": F.shiftright("y", 1)}).join(at, [*keys, "_cx", "_cy"]).drop("_cx", "_cy")


def around(c: Column, own: W, k: int) -> Column:
    """c at k places further along the window; past an end stands the end."""
    whole = own.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    if k == 0:
        return c
    return F.coalesce(F.lead(c, k).over(own), F.last(c).over(whole)) if k > 0 else F.coalesce(F.lag(c, -k).over(own), F.first(c).over(whole))


def doubled(chroma: DataFrame, values: Sequence[str], taps: Sequence[int], along: str, across: str, keys: Sequence[str], finish) -> DataFrame:
    """For each sample and value the filtered samples at its even and its odd place along an axis: <value>0 and <value>1. The taps are turned for even places."""
    own, half = W.partitionBy(*keys, across).orderBy(along), len(taps) // 2

    def total(c: str, odd: int) -> Column:
        weights = taps if odd else taps[::-1]
        return sum((around(F.col(c), own, t - half + odd) * w for t, w in enumerate(weights) if w), F.lit(0).cast("long"))

    return chroma.select(*keys, "x", "y", *(finish(total(c, odd)).alias(f"{c}{odd}") for c in values for odd in (0, 1)))


def chroma_filtered(luma: DataFrame, chroma: DataFrame, mode: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pixels with u and v: fancy (as stored), or with six more bits, centred on 0, by three taps (fast) or ten (lanczos).

    Windows along rows, then along columns of the chroma samples give the four pixels of each sample; luma joins them once.
    """
    if mode == "fancy":
        rows, columns = W.partitionBy(*keys, "y").orderBy("x"), W.partitionBy(*keys, "x").orderBy("y")
        wide = chroma.select(*keys, "x", "y", *(around(F.col(c), rows, k).alias(f"{c}_{k + 1}") for c in "uv" for k in (-1, 0, 1)))

        def sample(c: str, oy: int, ox: int) -> Column:
            dx, dy = 2 * ox, 2 * oy - 1
            n, h = F.col(f"{c}_1"), F.col(f"{c}_{dx}")
            v, d = around(n, columns, dy), around(h, columns, dy)
            return F.shiftright(F.shiftright(n + h * 3 + v * 3 + d + 8, 3) + n, 1)

        four = wide.select(*keys, "x", "y", *(sample(c, oy, ox).alias(f"{c}{ox}{oy}") for c in "uv" for oy in (0, 1) for ox in (0, 1)))
    else:
        taps = FAST if mode == "fast" else LANCZOS
        first = (lambda t: t - 128 * 64) if mode == "fast" else (lambda t: color.shr(t + 128, 8))
        last = (lambda t: color.shr(t + 32, 6)) if mode == "fast" else (lambda t: color.shr(t + (1 << 13), 14) - 128 * 64)
        half = doubled(chroma, "uv", taps, "x", "y", keys, first)
        four = doubled(half, ["u0", "u1", "v0", "v1"], taps, "y", "x", keys, last)
    four = four.select(*keys, F.col("x").alias("_cx"), F.col("y").alias("_cy"), *(F.col(f"{c}{ox}{oy}") for c in "uv" for ox in (0, 1) for oy in (0, 1)))
    joined = luma.withColumns({"_cx": F.shiftright("x", 1), "_cy": F.shiftright("y", 1)}).join(four, [*keys, "_cx", "_cy"])
    ox, oy = F.col("x") % 2, F.col("y") % 2
    pick = lambda c: F.when((ox == 0) & (oy == 0), F.col(f"{c}00")).when(oy == 0, F.col(f"{c}10")).when(ox == 0, F.col(f"{c}01")).otherwise(F.col(f"{c}11"))
    return joined.select(*luma.columns, pick("u").alias("u"), pick("v").alias("v"))


def rgb_to_chroma(pixels: DataFrame, weigh: bool, keys: Sequence[str] = KEYS) -> DataFrame:
    """u and v of 2 x 2 blocks, averaged in linear light, by alpha where a block is neither opaque nor clear; an odd edge counts twice."""
    half = lambda c: F.shiftright(F.col(c), 1).alias(c)
    linear = {c: color.to_linear(F.col(c)) for c in "rgb"}
    sums = [F.sum(v).alias(c) for c, v in linear.items()] + [F.sum(v * F.col("a")).alias(f"w{c}") for c, v in linear.items()]
    blocks = pixels.groupBy(*keys, half("x"), half("y")).agg(*sums, F.sum("a").alias("total"), F.count("*").alias("n"))
    times = F.floor(F.lit(4) / F.col("n")).cast("long")  # of four places
    total = F.col("total") * times
    inverse = F.floor(F.lit(1 << 19).cast("long") / F.when(total == 0, 1).otherwise(total)).cast("long")
    mixed = F.lit(weigh) & (total != 0) & (total != 4 * 255)
    value = lambda c: color.from_linear(F.when(mixed, color.shr((F.col(f"w{c}") * times * inverse).bitwiseAND(0xFFFFFFFF), 17)).otherwise(F.col(c) * times))
    out = color.chroma_of_four(*(value(c) for c in "rgb"))
    return blocks.select(*keys, "x", "y", out["u"].alias("u"), out["v"].alias("v"))


def block_alpha(pixels: DataFrame, alphas: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """The mean of each 2 x 2 block, rounded up; at an odd edge of what is there."""
    half = lambda c: F.shiftright(F.col(c), 1).alias(c)
    return pixels.groupBy(*keys, half("x"), half("y")).agg(*(F.ceil(F.sum(a) / F.count(a)).cast("long").alias(a) for a in alphas))


def unfilter_horizontal(pixels: DataFrame, value: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """First column: running sum down; then running sums along each row, modulo 256. Rows are summed side by side."""
    down = pixels.where("x = 0").select(*keys, "y", (F.sum(value).over(W.partitionBy(*keys).orderBy("y")) - F.col(value)).alias("_above"))
    along = F.sum(value).over(W.partitionBy(*keys, "y").orderBy("x"))
    return pixels.withColumn("_along", along).join(down, [*keys, "y"]).withColumn(value, (F.col("_along") + F.col("_above")) % 256).drop("_along", "_above")


def unfilter_vertical(pixels: DataFrame, value: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """First row: running sum along; then running sums down each column, modulo 256."""
    along = pixels.where("y = 0").select(*keys, "x", (F.sum(value).over(W.partitionBy(*keys).orderBy("x")) - F.col(value)).alias("_left"))
    down = F.sum(value).over(W.partitionBy(*keys, "x").orderBy("y"))
    return pixels.withColumn("_down", down).join(along, [*keys, "x"]).withColumn(value, (F.col("_down") + F.col("_left")) % 256).drop("_down", "_left")


def unfilter_gradient(pixels: DataFrame, value: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Sums with a clamped gradient, which no window can express: one image a group, as a whole plane. keys, x, y and value."""
    from tessellar.codecs.alpha import GRADIENT, unfilter

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        plane = np.zeros((pdf["y"].max() + 1, pdf["x"].max() + 1), np.uint8)
        plane[pdf["y"], pdf["x"]] = pdf[value]
        return pdf.assign(**{value: unfilter(plane, GRADIENT)[pdf["y"], pdf["x"]].astype(np.int64)})

    rows = pixels.select(*keys, "x", "y", F.col(value).cast("long").alias(value))
    return rows.groupBy(*keys).applyInPandas(run, rows.schema)


def predict_left(pixels: DataFrame, values: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Each row's samples are differences from the left, modulo 256 (a row that one mode covers)."""
    own = W.partitionBy(*keys, "y").orderBy("x")
    return pixels.withColumns({c: F.sum(c).over(own) % 256 for c in values})


def predict_top(pixels: DataFrame, values: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    own = W.partitionBy(*keys, "x").orderBy("y")
    return pixels.withColumns({c: F.sum(c).over(own) % 256 for c in values})


def palette_lookup(pixels: DataFrame, palette: DataFrame, index: str = "g") -> DataFrame:
    """palette: entry (0 to 255) and colour columns; an index past the palette gives 0. At most 256 entries are used, so it is broadcast."""
    own = palette.where("entry between 0 and 255").dropDuplicates(["entry"])
    colours = [c for c in own.columns if c != "entry"]
    joined = pixels.drop(*colours).withColumn("entry", pixels[index]).join(F.broadcast(own), "entry", "left")
    return joined.fillna(0, colours)


def palette_delta(palette: DataFrame, values: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Entries from differences to the one before, by channel modulo 256."""
    own = W.partitionBy(*keys).orderBy("entry")
    return palette.withColumns({c: F.sum(c).over(own) % 256 for c in values})


def palette_expand(pixels: DataFrame, bits: int, width: int, index: str = "g", keys: Sequence[str] = KEYS) -> DataFrame:
    """2, 4 or 8 indices of each sample (bits 1, 2, 3), low ones first, at their own x: keys, x, y and index; places past the width go."""
    size, per = 8 >> bits, 1 << bits
    out = pixels.select(*keys, "y", F.col("x").alias("_x"), F.col(index).alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(per - 1))).alias("_k"))
    value = F.expr(f"shiftright(_v, {size} * _k)").bitwiseAND((1 << size) - 1)
    return out.select(*keys, (F.col("_x") * per + F.col("_k")).alias("x"), "y", value.alias(index)).where(F.col("x") < width)


def tile_lookup(pixels: DataFrame, tiles: DataFrame, bits: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """pixels with the values of the tile that they lie in; tiles: keys, x, y (of tiles) and values."""
    at = tiles.withColumnsRenamed({"x": "_tx", "y": "_ty"})
    return pixels.withColumns({"_tx": F.shiftright("x", bits), "_ty": F.shiftright("y", bits)}).join(at, [*keys, "_tx", "_ty"]).drop("_tx", "_ty")


def code_groups(entropy: DataFrame, group: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pixels of entropy images with a dense number of their code group, in order of first use, and the number of codes sent (the largest group + 1)."""
    first = entropy.groupBy(*keys, group).agg(F.min(F.struct("y", "x")).alias("_first"))
    own = W.partitionBy(*keys)
    named = first.select(*keys, group, (F.row_number().over(own.orderBy("_first")) - 1).cast("long").alias("dense"), (F.max(group).over(own) + 1).alias("codes"))
    return entropy.join(named, [*keys, group])


def code_lengths(codes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many symbols have each length, and whether a code is complete, too full or not full; rows: keys, symbol, length (0: not used)."""
    counts = codes.where("length > 0").groupBy(*keys, "length").agg(F.count("*").alias("n"))
    full = F.sum(F.col("n") * F.expr("shiftleft(1L, cast(15 - length as int))")).over(W.partitionBy(*keys))
    symbols = F.sum("n").over(W.partitionBy(*keys))
    kind = F.when((full == 1 << 15) | (symbols == 1), "complete").when(full > 1 << 15, "over").otherwise("under")
    return counts.withColumn("kind", kind)


def canonical_codes(codes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The code of each symbol that is used: by length, then by symbol. For codes that are not too full."""
    used = codes.where("length > 0")
    share = F.expr("shiftleft(1L, cast(15 - length as int))")
    before = F.coalesce(F.sum(share).over(W.partitionBy(*keys).orderBy("length", "symbol").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return used.withColumn("code", before).withColumn("code", F.expr("shiftright(code, cast(15 - length as int))"))


def alpha_class(pixels: DataFrame, alpha: str, keys: Sequence[str]) -> DataFrame:
    """Whether all pixels of a group are opaque, all clear, or neither."""
    told = pixels.groupBy(*keys).agg(F.min(alpha).alias("least"), F.max(alpha).alias("most"))
    return told.select(*keys, F.when(F.col("least") == 255, "opaque").when(F.col("most") == 0, "clear").otherwise("mixed").alias("kind"))


def differences(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pixels of two pictures that differ: visible, transparent (clear in both), or there in one alone (geometry); r, g, b and a are compared."""
    own = lambda df, n: df.select(*keys, "x", "y", F.struct(*"rgba").alias(n))
    both = own(a, "p").join(own(b, "q"), [*keys, "x", "y"], "full")
    missing = F.col("p").isNull() | F.col("q").isNull()
    clear = (F.col("p.a") == 0) & (F.col("q.a") == 0)
    count = lambda c: F.count_if(c).alias
    differ = ~missing & (F.col("p") != F.col("q"))
    return both.groupBy(*keys).agg(count(differ & ~clear)("visible"), count(differ & clear)("transparent"), count(missing)("geometry"))


def row_bytes(pixels: DataFrame, layout: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """The bytes of each image's rows in order, as one binary: keys and data. An image is one group; rows are joined first."""
    hexed = pixels.withColumn("_h", color.packed_hex(layout, *(F.col(c) for c in "rgba")))
    joined = lambda by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "_h"))), lambda r: r["_h"]), "")
    rows = hexed.groupBy(*keys, "y").agg(joined("x").alias("_h"))
    return rows.groupBy(*keys).agg(F.unhex(joined("y")).alias("data"))


def transform_blocks(blocks: DataFrame, keys: Sequence[str] = ("block_id",)) -> DataFrame:
    """Residuals of 4 x 4 blocks by the inverse cosine transform; rows: keys, place (0 to 15) and value. Pure arithmetic on one row a block."""
    wide = blocks.groupBy(*keys).agg(*(F.max(F.when(F.col("place") == k, F.col("value"))).alias(f"c{k}") for k in range(16)))
    big, small = lambda a: color.shr(a * 20091, 16) + a, lambda a: color.shr(a * 35468, 16)

    def half(a: Column, b: Column, c: Column, d: Column) -> list[Column]:
        s, t, u, v = a + c, a - c, small(b) - big(d), big(b) + small(d)
        return [s + v, t + u, t - u, s - v]

    first = [half(*(F.col(f"c{4 * j + x}") for j in range(4))) for x in range(4)]
    wide = wide.select(*keys, *(first[x][y].alias(f"t{4 * y + x}") for y in range(4) for x in range(4)))
    rows = [half(F.col(f"t{4 * y}") + 4, *(F.col(f"t{4 * y + j}") for j in (1, 2, 3))) for y in range(4)]
    return wide.select(*keys, F.posexplode(F.array(*(color.shr(rows[y][x], 3) for y in range(4) for x in range(4)))).alias("place", "value"))


def second_order(blocks: DataFrame, keys: Sequence[str] = ("block_id",)) -> DataFrame:
    """The 16 DCs of a block's second-order coefficients (inverse Walsh-Hadamard transform); rows as in transform_blocks."""
    wide = blocks.groupBy(*keys).agg(*(F.max(F.when(F.col("place") == k, F.col("value"))).alias(f"c{k}") for k in range(16)))

    def half(a: Column, b: Column, c: Column, d: Column) -> list[Column]:
        s, t, u, v = a + d, b + c, b - c, a - d
        return [s + t, v + u, s - t, v - u]

    first = [half(*(F.col(f"c{4 * j + x}") for j in range(4))) for x in range(4)]
    wide = wide.select(*keys, *(first[x][y].alias(f"t{4 * y + x}") for y in range(4) for x in range(4)))
    rows = [half(F.col(f"t{4 * y}") + 3, *(F.col(f"t{4 * y + j}") for j in (1, 2, 3))) for y in range(4)]
    return wide.select(*keys, F.posexplode(F.array(*(color.shr(rows[y][x], 3) for y in range(4) for x in range(4)))).alias("place", "value"))
