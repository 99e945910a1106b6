"""Colour arithmetic as column expressions, in exact integers (BIGINT)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column, low: int = 0, high: int = 255) -> Column:
    return F.least(F.greatest(c, F.lit(low).cast("long")), F.lit(high).cast("long"))


def shr(c: Column, n: int) -> Column:
    return F.shiftright(c.cast("long"), n)


def yuv_to_rgb(y: Column, u: Column, v: Column) -> dict[str, Column]:
    """BT.601, limited range."""
    high = lambda a, k: shr(a * k, 8)
    clip = lambda c: clamp(shr(c, 6))
    luma = high(y, 19077)
    return {"r": clip(luma + high(v, 26149) - 14234), "g": clip(luma - high(u, 6419) - high(v, 13320) + 8708), "b": clip(luma + high(u, 33050) - 17685)}


def rgb_to_yuv444(r: Column, g: Column, b: Column) -> dict[str, Column]:
    chroma = lambda c: clamp(shr(c * 4 + (1 << 17) + (128 << 18), 18))
    return {"y": shr(r * 16839 + g * 33059 + b * 6420 + 32768 + (16 << 16), 16), "u": chroma(b * 28800 - r * 9719 - g * 19081), "v": chroma(r * 28800 - g * 24116 - b * 4684)}


def premultiply(x: Column, a: Column) -> Column:
    return F.when(a == 255, x).otherwise(shr(x * a * 32897, 23))


def unpremultiply(x: Column, a: Column) -> Column:
    """x over a as 32-bit unsigned arithmetic has it: sums wrap before the shift."""
    scale = F.floor(F.lit(255 << 24).cast("long") / F.when(a == 0, 1).otherwise(a)).cast("long")
    return F.when(a == 0, 0).when(a == 255, x).otherwise(shr((x * scale + (1 << 23)).bitwiseAND(0xFFFFFFFF), 24)).cast("long")


def multiply(x: Column, a: Column) -> Column:
    """x times alpha as rescaling takes it, rounded."""
    return F.when(a == 0, 0).when(a == 255, x).otherwise(shr((x * (a * ((1 << 24) // 255)) + (1 << 23)).bitwiseAND(0xFFFFFFFF), 24)).cast("long")


def premultiply4444(b0: Column, b1: Column) -> dict[str, Column]:
    """Of packed four-bit red and green, blue and alpha."""
    factor = b1.bitwiseAND(15) * 0x1111
    wide = lambda n: shr(n * 17 * factor, 16)
    r, g, b = wide(shr(b0, 4)), wide(b0.bitwiseAND(15)), wide(shr(b1, 4))
    return {"b0": r.bitwiseAND(0xF0).bitwiseOR(shr(g, 4).bitwiseAND(15)), "b1": b.bitwiseAND(0xF0).bitwiseOR(b1.bitwiseAND(15))}


#: By layout, the channels in the order of their bytes.
ORDERS = {"argb": "argb", "rgba": "rgba", "bgra": "bgra", "rgb": "rgb", "bgr": "bgr"}


def packed_hex(layout: str, r: Column, g: Column, b: Column, a: Column) -> Column:
    """The bytes of a pixel in hexadecimal."""
    own = {"r": r, "g": g, "b": b, "a": a}
    return F.lower(F.concat(*(F.lpad(F.hex(own[c]), 2, "0") for c in ORDERS[layout])))


def fine_yuv_to_rgb(y: Column, u: Column, v: Column) -> dict[str, Column]:
    """Of luma and chroma with six more bits, centred on 0."""
    luma = (y - 16) * (19077 * 64)
    clip = lambda c: clamp(shr(c + (1 << 19), 20))
    return {"r": clip(luma + v * 26149), "g": clip(luma - u * 6419 - v * 13320), "b": clip(luma + u * 33050)}


def table(values: list[int], index: Column) -> Column:
    """An entry of a small table, from 0."""
    return F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), (index + 1).cast("int"))


#: Gamma 0.8 on twelve bits, and back on a grid of 33 places.
GAMMA = [round(4095 * (v / 255) ** 0.8) for v in range(256)]
UNGAMMA = [round(255 * (v / 32) ** 1.25) for v in range(33)]


def to_linear(v: Column) -> Column:
    return table(GAMMA, v)


def from_linear(total: Column) -> Column:
    """Four times the gamma value of a sum of four linear ones."""
    at, x = shr(total, 9), total.bitwiseAND(511)
    return shr(table(UNGAMMA, F.least(at + 1, F.lit(32))) * x + table(UNGAMMA, at) * (512 - x) + 64, 7)


def chroma_of_four(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """U and V of sums of four reds, greens and blues."""
    clip = lambda c: clamp(shr(c + (1 << 17) + (128 << 18), 18))
    return {"u": clip(b * 28800 - r * 9719 - g * 19081), "v": clip(r * 28800 - g * 24116 - b * 4684)}


def mean2(a: Column, b: Column) -> Column:
    return shr(a + b, 1)


def mean3(a: Column, b: Column, c: Column) -> Column:
    return mean2(mean2(a, c), b)


def mean4(a: Column, b: Column, c: Column, d: Column) -> Column:
    return mean2(mean2(a, b), mean2(c, d))


def select(left: dict[str, Column], top: dict[str, Column], corner: dict[str, Column]) -> dict[str, Column]:
    """Of left and top the one nearer to left + top - corner over all channels; top if equally near."""
    total = lambda p, q: sum((F.abs(p[k] - q[k]) for k in p), F.lit(0).cast("long"))
    nearer = total(top, corner) < total(left, corner)
    return {k: F.when(nearer, left[k]).otherwise(top[k]) for k in left}


def clamp_full(left: Column, top: Column, corner: Column) -> Column:
    return clamp(left + top - corner)


def clamp_half(left: Column, top: Column, corner: Column) -> Column:
    """mean + (mean - corner) / 2, the quotient towards zero."""
    m = mean2(left, top)
    d = m - corner
    return clamp(m + F.when(d >= 0, shr(d, 1)).otherwise(-shr(-d, 1)))


def blend_sample(src: Column, src_alpha: Column, dst: Column, dst_alpha: Column) -> Column:
    """A luma or chroma sample over another, by straight alphas."""
    t = shr(dst_alpha * (256 - src_alpha), 8)
    whole = src_alpha + t
    scale = F.floor(F.lit(1 << 24).cast("long") / F.when(whole == 0, 1).otherwise(whole)).cast("long")
    return F.when(src_alpha == 255, src).when(src_alpha == 0, dst).otherwise(shr((src * src_alpha + dst * t) * scale, 24))


def blend_alpha(src_alpha: Column, dst_alpha: Column) -> Column:
    return F.when(src_alpha == 255, 255).when(src_alpha == 0, dst_alpha).otherwise(src_alpha + shr(dst_alpha * (256 - src_alpha), 8)).cast("long")


def pack565(r: Column, g: Column, b: Column) -> dict[str, Column]:
    return {"b0": r.bitwiseAND(0xF8).bitwiseOR(shr(g, 5)), "b1": (g * 8).bitwiseAND(0xE0).bitwiseOR(shr(b, 3))}


def pack4444(r: Column, g: Column, b: Column, a: Column) -> dict[str, Column]:
    return {"b0": r.bitwiseAND(0xF0).bitwiseOR(shr(g, 4)), "b1": b.bitwiseAND(0xF0).bitwiseOR(shr(a, 4))}


def blend_straight(src: dict[str, Column], dst: dict[str, Column]) -> dict[str, Column]:
    """Source over destination with straight alpha; both have r, g, b, a."""
    a = src["a"]
    t = shr(dst["a"] * (256 - a), 8)
    whole = a + t
    scale = F.floor(F.lit(1 << 24).cast("long") / F.when(whole == 0, 1).otherwise(whole)).cast("long")
    mixed = lambda k: F.when(a == 255, src[k]).when(a == 0, dst[k]).otherwise(shr((src[k] * a + dst[k] * t) * scale, 24))
    return {k: mixed(k) for k in "rgb"} | {"a": F.when(a == 255, a).when(a == 0, dst["a"]).otherwise(whole)}


def blend_premultiplied(src: dict[str, Column], dst: dict[str, Column]) -> dict[str, Column]:
    return {k: (src[k] + shr(dst[k] * (256 - src["a"]), 8)).bitwiseAND(255) for k in "rgba"}


def add_green(r: Column, g: Column, b: Column) -> dict[str, Column]:
    return {"r": (r + g).bitwiseAND(255), "g": g, "b": (b + g).bitwiseAND(255)}


def signed(c: Column) -> Column:
    return F.when(c > 127, c - 256).otherwise(c)


def color_transform(r: Column, g: Column, b: Column, green_red: Column, green_blue: Column, red_blue: Column) -> dict[str, Column]:
    """Inverse colour transform; the three multipliers are signed bytes."""
    red = (r + shr(green_red * signed(g), 5)).bitwiseAND(255)
    blue = (b + shr(green_blue * signed(g), 5) + shr(red_blue * signed(red), 5)).bitwiseAND(255)
    return {"r": red, "g": g, "b": blue}
