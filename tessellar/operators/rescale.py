"""Rescaling of pixel tables by areas (shrinking) and neighbours (growing), in 32-bit fixed point.

Each output sample comes from a group of source samples that its number gives directly, and what a share takes too much of its last
source sample goes to the next share alone: so a pass is one group by (or one explode) and one window, without a range join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessellar.functions.color import shr
from tessellar.operators.geometry import KEYS

ONE = 1 << 32


def div(a: Column, b: Column) -> Column:
    return F.floor(a / b).cast("long")


def up(a: Column, b: Column) -> Column:
    return div(a + b - 1, b)


def fixed(x: Column, y: Column) -> Column:
    """x * y / 2^32, rounded; the product is below 2^63, as samples stay below 2^24 here."""
    return shr(x * y + (ONE >> 1), 32)


def column(v: int | Column) -> Column:
    return v if isinstance(v, Column) else F.lit(v).cast("long")


def shares(rows: DataFrame, value: str, along: str, across: str, size: Column, out: Column, keys: Sequence[str]) -> DataFrame:
    """For each share of an axis: the sum, the last sample and how far the share ends before it (in units of 1 / out)."""
    rows = rows.withColumns({"_size": size, "_out": out})
    own = rows.withColumn("_i", div(F.col(along) * F.col("_out"), F.col("_size")))
    sums = own.groupBy(*keys, across, "_i").agg(F.sum(value).alias("_sum"), F.max(F.struct(along, value)).alias("_last"), F.first("_size").alias("_size"), F.first("_out").alias("_out"))
    end = (F.col("_i") + 1) * F.col("_size")
    return sums.withColumn("_rest", up(end, F.col("_out")) * F.col("_out") - end).withColumn("_last", F.col("_last")[value])


def shrink_rows(pixels: DataFrame, value: str, size: int | Column, out: int | Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, y, x (of `out`) and value: sums of areas times `out`, as the vertical pass takes them."""
    s = shares(pixels, value, "x", "y", column(size), column(out), keys).withColumn("_over", F.col("_last") * F.col("_rest"))
    factor = div(F.lit(ONE).cast("long"), F.col("_out")).bitwiseAND(0xFFFFFFFF)
    back = F.coalesce(F.lag(fixed(F.col("_over"), factor)).over(W.partitionBy(*keys, "y").orderBy("_i")), F.lit(0))
    return s.select(*keys, "y", F.col("_i").alias("x"), ((back + F.col("_sum")) * F.col("_out") - F.col("_over")).alias(value))


def shrink_columns(rows: DataFrame, value: str, size: int | Column, out: int | Column, row_units: int | Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, x, y (of `out`) and value, 0 to 255. row_units: what a source row's samples are multiplied by (its width, or the grown width - 1)."""
    s = shares(rows.withColumn("_units", column(row_units)), value, "y", "x", column(size), column(out), [*keys, "_units"])
    scale = (div(F.lit(ONE).cast("long"), F.col("_out")).bitwiseAND(0xFFFFFFFF) * F.col("_rest")).bitwiseAND(0xFFFFFFFF)
    s = s.withColumn("_over", shr(F.col("_last") * scale, 32))
    back = F.coalesce(F.lag("_over").over(W.partitionBy(*keys, "x").orderBy("_i")), F.lit(0))
    ratio = div(F.col("_out") * F.lit(ONE).cast("long"), F.col("_units") * F.col("_size"))
    plain = F.col("_sum").bitwiseAND(255)
    scaled = F.least(fixed(F.col("_sum") + back - F.col("_over"), ratio), F.lit(255))
    return s.select(*keys, "x", F.col("_i").alias("y"), F.when(ratio >= ONE, plain).otherwise(scaled).alias(value))


def grown(rows: DataFrame, value: str, along: str, across: str, size: Column, out: Column, keys: Sequence[str]) -> DataFrame:
    """For each output place between two samples: _i, _left, _right and _rest (how far it stands before the right one, of out - 1)."""
    own = W.partitionBy(*keys, across).orderBy(along)
    rows = rows.withColumns({"_size": size, "_out": out, "_next": F.coalesce(F.lead(value).over(own), F.col(value))})
    at, gaps, steps = F.col(along), F.greatest(F.col("_size") - 1, F.lit(1)), F.col("_out") - 1
    first = F.when(at == 0, F.lit(0)).otherwise(div(at * steps, gaps) + 1)
    last = F.when(F.col("_size") == 1, steps).otherwise(div((at + 1) * steps, gaps))
    inner = rows.where((at < F.col("_size") - 1) | (F.col("_size") == 1))
    out_rows = inner.withColumn("_i", F.explode(F.sequence(first, last)))
    rest = (at + 1) * steps - F.col("_i") * (F.col("_size") - 1)
    return out_rows.select(*keys, across, "_i", F.col(value).alias("_left"), F.col("_next").alias("_right"), rest.alias("_rest"), "_out", "_size")


def expand_rows(pixels: DataFrame, value: str, size: int | Column, out: int | Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, y, x (of `out`) and value: blends of neighbours times out - 1."""
    g = grown(pixels, value, "x", "y", column(size), column(out), keys)
    blend = F.col("_right") * (F.col("_out") - 1) + (F.col("_left") - F.col("_right")) * F.col("_rest")
    return g.select(*keys, "y", F.col("_i").alias("x"), blend.alias(value))


def expand_columns(rows: DataFrame, value: str, size: int | Column, out: int | Column, row_units: int | Column, keys: Sequence[str] = KEYS) -> DataFrame:
    g = grown(rows.withColumn("_units", column(row_units)), value, "y", "x", column(size), column(out), [*keys, "_units"])
    weight = div(F.col("_rest") * F.lit(ONE).cast("long"), F.col("_out") - 1)
    # a place on a sample takes it whole: the right one where nothing is left to it
    whole = F.when(F.col("_rest") == 0, F.col("_right"))
    first = F.when(F.col("_i") == 0, F.col("_left"))
    mixed = shr(F.col("_right") * (ONE - weight) + F.col("_left") * weight + (ONE >> 1), 32)
    factor = div(F.lit(ONE).cast("long"), F.col("_units")).bitwiseAND(0xFFFFFFFF)
    return g.select(*keys, "x", F.col("_i").alias("y"), F.least(fixed(F.coalesce(first, whole, mixed), factor), F.lit(255)).alias(value))


def rescale(pixels: DataFrame, value: str, width: Column, height: Column, out_w: Column, out_h: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """Both passes where both shrink or keep their size: keys, x, y and value. Sizes are columns of pixels that are equal within an image."""
    held = pixels.withColumns({"_w": width, "_h": height, "_ow": out_w, "_oh": out_h})
    both = [*keys, "_w", "_h", "_ow", "_oh"]
    rows = shrink_rows(held, value, F.col("_w"), F.col("_ow"), both)
    return shrink_columns(rows, value, F.col("_h"), F.col("_oh"), F.col("_w"), both).select(*keys, "x", "y", value)
