"""Queries on rasters that are derived from the events table (it holds no images): images of 125 x 25 pixels, with odd sides.

event_id gives image_id (of 3125 events), y and x; the channels are made of event_id and user_id. Frames, palettes, tiles, blocks and
codes are derived likewise, as said at each. Every query runs over the whole table and comes with the same result in SQL, written
from the formulas rather than from the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.codecs import pixels
from tessellar.functions import color
from tessellar.operators import animation, geometry, rescale

WIDTH, HEIGHT = 125, 25
RASTER = """WITH p AS (SELECT event_id // 3125 AS image_id, event_id % 125 AS x, event_id // 125 % 25 AS y, (event_id * 31 + user_id * 17) % 256 AS r,
 (event_id * 7 + user_id * 29) % 256 AS g, (event_id * 13 + user_id * 3) % 256 AS b, (event_id * 5 + user_id * 11) % 256 AS a FROM events)"""
#: Frames: a file a row of the raster, a frame a pixel; a canvas of 16 x 16, which half of the frames cover.
FRAMES = """, f AS (SELECT image_id * 25 + y AS image_id, x AS frame_no, r AS duration, CASE WHEN r < 128 THEN 0 ELSE 2 * (g % 4) END AS pos_x, CASE WHEN r < 128 THEN 0 ELSE 2 * (b % 4) END AS pos_y,
 CASE WHEN r < 128 THEN 16 ELSE 1 + g % 8 END AS width, CASE WHEN r < 128 THEN 16 ELSE 1 + b % 8 END AS height, a % 2 = 1 AS dispose, a // 2 % 2 = 1 AS no_blend, a // 4 % 2 = 1 AS has_alpha FROM p)"""
CHROMA = ", c AS (SELECT image_id, x // 2 AS cx, y // 2 AS cy, g AS u, b AS v FROM p WHERE x % 2 = 0 AND y % 2 = 0), d AS (SELECT image_id, max(cx) AS w, max(cy) AS h FROM c GROUP BY image_id)"


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    own = {"r": (e * 31 + u * 17) % 256, "g": (e * 7 + u * 29) % 256, "b": (e * 13 + u * 3) % 256, "a": (e * 5 + u * 11) % 256}
    place = [F.expr("event_id div 3125").alias("image_id"), (e % 125).alias("x"), F.expr("event_id div 125 % 25").alias("y")]
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(*place, *(c.alias(k) for k, c in own.items()))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = raster(spark, sf_dir)
    c, whole = F.col, F.col("r") < 128
    bit = lambda n: F.shiftright("a", n) % 2 == 1
    part = lambda v, w: F.when(whole, F.lit(w).cast("long")).otherwise(v)
    return p.select(
        (c("image_id") * 25 + c("y")).alias("image_id"), c("x").alias("frame_no"), c("r").alias("duration"),
        part(c("g") % 4 * 2, 0).alias("pos_x"), part(c("b") % 4 * 2, 0).alias("pos_y"), part(c("g") % 8 + 1, 16).alias("width"), part(c("b") % 8 + 1, 16).alias("height"),
        bit(0).alias("dispose"), bit(1).alias("no_blend"), bit(2).alias("has_alpha"), F.lit(16).alias("canvas_w"), F.lit(16).alias("canvas_h"),
    )


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str, frame: Query | None = None):
    """Registers a query with its SQL; sql begins with a comma where it goes on after the raster's definition."""

    def put(f: Query) -> Query:
        QUERIES[name], SQL[name] = f, sql
        return f

    return put(frame) if frame else put


def pixelwise(name: str, columns: Callable[..., dict[str, Column]], sql: str) -> None:
    """A query of columns worked out from r, g, b, a; sql: their expressions."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = raster(spark, sf_dir)
        return p.select("image_id", "x", "y", *(c.alias(k) for k, c in columns(*map(F.col, "rgba")).items()))

    query(name, f" SELECT image_id, x, y, {sql} FROM p", run)


def longs(columns: dict[str, Column]) -> dict[str, Column]:
    return {k: c.cast("long") for k, c in columns.items()}


def cases(a: str, opaque: str, clear: str, other: str) -> str:
    return f"CASE {a} WHEN 255 THEN {opaque} WHEN 0 THEN {clear} ELSE {other} END"


def limit(v: str) -> str:
    return f"least(greatest({v}, 0), 255)"


# colour, one pixel at a time
DA = "((r + b) % 256)"
T = f"(({DA} * (256 - a)) >> 8)"
source = lambda r, g, b, a: {"r": r, "g": g, "b": b, "a": a}
canvas = lambda r, g, b, a: {"r": g, "g": b, "b": r, "a": (r + b) % 256}

pixelwise("yuv_to_rgb", lambda r, g, b, a: longs(color.yuv_to_rgb(r, g, b)), f"{limit('(((r*19077)>>8) + ((b*26149)>>8) - 14234) >> 6')} AS r, {limit('(((r*19077)>>8) - ((g*6419)>>8) - ((b*13320)>>8) + 8708) >> 6')} AS g, {limit('(((r*19077)>>8) + ((g*33050)>>8) - 17685) >> 6')} AS b")
pixelwise("rgb_to_yuv444", lambda r, g, b, a: {"luma": (yuv := color.rgb_to_yuv444(r, g, b))["y"], "u": yuv["u"], "v": yuv["v"]}, f"(16839*r + 33059*g + 6420*b + 32768 + 1048576) >> 16 AS luma, {limit('(4*(28800*b - 9719*r - 19081*g) + 131072 + 33554432) >> 18')} AS u, {limit('(4*(28800*r - 24116*g - 4684*b) + 131072 + 33554432) >> 18')} AS v")
pixelwise("premultiply", lambda r, g, b, a: longs({k: color.premultiply(c, a) for k, c in zip("rgb", (r, g, b))}), ", ".join(f"CASE a WHEN 255 THEN {c} ELSE ({c}*a*32897)>>23 END AS {c}" for c in "rgb"))
pixelwise("unpremultiply", lambda r, g, b, a: longs({"r": color.unpremultiply(r, a), "g": color.unpremultiply(g, a)}), ", ".join(cases("a", c, "0", f"(({c}*(4278190080 // a) + 8388608) & 4294967295) >> 24") + f" AS {c}" for c in "rg"))
pixelwise("multiply_alpha", lambda r, g, b, a: {"r": color.multiply(r, a), "g": color.multiply(g, a)}, ", ".join(cases("a", c, "0", f"(({c} * a * 65793 + 8388608) & 4294967295) >> 24") + f" AS {c}" for c in "rg"))
pixelwise("premultiply_4444", lambda r, g, b, a: color.premultiply4444(**color.pack4444(r, g, b, a)), "((((r >> 4) * 17 * (a >> 4) * 4369) >> 16) & 240) | ((((g >> 4) * 17 * (a >> 4) * 4369) >> 20) & 15) AS b0, ((((b >> 4) * 17 * (a >> 4) * 4369) >> 16) & 240) | (a >> 4) AS b1")
pixelwise("pack_rgb565", lambda r, g, b, a: color.pack565(r, g, b), "(r & 248) | (g >> 5) AS b0, ((g << 3) & 224) | (b >> 3) AS b1")
pixelwise("pack_bgr565", lambda r, g, b, a: {"b0": (p := color.pack565(r, g, b))["b1"], "b1": p["b0"]}, "((g << 3) & 224) | (b >> 3) AS b0, (r & 248) | (g >> 5) AS b1")
pixelwise("pack_rgba4444", lambda r, g, b, a: color.pack4444(r, g, b, a), "(r & 240) | (g >> 4) AS b0, (b & 240) | (a >> 4) AS b1")
pixelwise("pack_bgra4444", lambda r, g, b, a: {"b0": (p := color.pack4444(r, g, b, a))["b1"], "b1": p["b0"]}, "(b & 240) | (a >> 4) AS b0, (r & 240) | (g >> 4) AS b1")
pixelwise("pack_orders", lambda *p: {k: color.packed_hex(k, *p) for k in color.ORDERS}, ", ".join("lower(" + " || ".join(f"lpad(hex({c}), 2, '0')" for c in order) + f") AS {order}" for order in ("argb", "rgba", "bgra", "rgb", "bgr")))
pixelwise("blend_straight", lambda *p: color.blend_straight(source(*p), canvas(*p)), ", ".join(cases("a", s, d, f"(({s}*a + {d}*{T}) * (16777216 // greatest(a + {T}, 1))) >> 24") + f" AS {s}" for s, d in ("rg", "gb", "br")) + f", {cases('a', '255', DA, f'a + {T}')} AS a")
pixelwise("blend_premult", lambda *p: color.blend_premultiplied(source(*p), canvas(*p)), ", ".join(f"({s} + (({d} * (256-a)) >> 8)) & 255 AS {s}" for s, d in (("r", "g"), ("g", "b"), ("b", "r"), ("a", DA))))
pixelwise("blend_ya", lambda r, g, b, a: {"luma": color.blend_sample(r, a, g, (r + b) % 256), "a": color.blend_alpha(a, (r + b) % 256)}, cases("a", "r", "g", f"((r*a + g*{T}) * (16777216 // greatest(a + {T}, 1))) >> 24") + f" AS luma, {cases('a', '255', DA, f'a + {T}')} AS a")
pixelwise("add_green", lambda r, g, b, a: color.add_green(r, g, b), "(r+g)%256 AS r, g, (b+g)%256 AS b")
S8 = "((g + 128) % 256 - 128)"
NR = f"((r + (((a-128) * {S8}) >> 5)) & 255)"
pixelwise("color_transform", lambda r, g, b, a: color.color_transform(r, g, b, a - 128, g % 64, b % 32), f"{NR} AS r, g, (b + (((g%64) * {S8}) >> 5) + (((b%32) * (({NR}+128)%256 - 128)) >> 5)) & 255 AS b")
pixelwise("averages", lambda r, g, b, a: {"two": color.mean2(r, g), "three": color.mean3(r, g, b), "four": color.mean4(r, g, b, a)}, "(r + g) // 2 AS two, ((r + b) // 2 + g) // 2 AS three, ((r + g) // 2 + (b + a) // 2) // 2 AS four")
pixelwise("clamped_predictors", lambda r, g, b, a: {"whole": color.clamp_full(r, g, b), "half": color.clamp_half(r, g, b)}, f"{limit('r + g - b')} AS whole, {limit('(r + g) // 2 + ((r + g) // 2 - b) // 2')} AS half")
pixelwise("select_predictor", lambda r, g, b, a: color.select({"r": r, "g": g}, {"r": g, "g": b}, {"r": b, "g": a}), "CASE WHEN abs(g-b) + abs(b-a) < abs(r-b) + abs(g-a) THEN r ELSE g END AS r, CASE WHEN abs(g-b) + abs(b-a) < abs(r-b) + abs(g-a) THEN g ELSE b END AS g")
pixelwise("gamma_tables", lambda r, g, b, a: {"linear": color.to_linear(r), "back": color.from_linear(color.to_linear(r) + color.to_linear(g) + color.to_linear(b) + color.to_linear(a))}, "CAST(round(4095 * pow(r / 255.0, 0.8)) AS BIGINT) AS linear, (CAST(round(255 * pow(least(s // 512 + 1, 32) / 32.0, 1.25)) AS BIGINT) * (s % 512) + CAST(round(255 * pow((s // 512) / 32.0, 1.25)) AS BIGINT) * (512 - s % 512) + 64) >> 7 AS back")
SQL["gamma_tables"] = ", q AS (SELECT *, CAST(round(4095 * pow(r / 255.0, 0.8)) + round(4095 * pow(g / 255.0, 0.8)) + round(4095 * pow(b / 255.0, 0.8)) + round(4095 * pow(a / 255.0, 0.8)) AS BIGINT) AS s FROM p)" + SQL["gamma_tables"].replace("FROM p", "FROM q")
pixelwise("extract_channels", lambda r, g, b, a: {"green": g, "alpha": a, "opaque": F.lit(255).cast("long")}, "g AS green, a AS alpha, CAST(255 AS BIGINT) AS opaque")
pixelwise("alpha_headers", lambda r, g, b, a: {"compression": r.bitwiseAND(3), "filter": color.shr(r, 2).bitwiseAND(3), "levels": color.shr(r, 4).bitwiseAND(3), "status": F.when((color.shr(r, 6) > 0) | (color.shr(r, 4).bitwiseAND(3) > 1), "invalid_data").when(r.bitwiseAND(3) > 1, "unsupported").otherwise("ok")}, "r % 4 AS compression, r // 4 % 4 AS filter, r // 16 % 4 AS levels, CASE WHEN r >= 64 OR r // 16 % 4 > 1 THEN 'invalid_data' WHEN r % 4 > 1 THEN 'unsupported' ELSE 'ok' END AS status")
pixelwise("scaled_sizes", lambda r, g, b, a: geometry.scaled_size(r + 1, g + 1, b, F.when(b == 0, a + 1).otherwise(a)), "CASE b WHEN 0 THEN ((r + 1) * (a + 1) + g) // (g + 1) ELSE b END AS w, CASE WHEN b = 0 THEN a + 1 WHEN a = 0 THEN ((g + 1) * b + r) // (r + 1) ELSE a END AS h")

# geometry
query("crop", " SELECT image_id, x - 3 AS x, y - 5 AS y, r, g, b, a FROM p WHERE x >= 3 AND x < 34 AND y >= 5 AND y < 20", lambda s, d: geometry.crop(raster(s, d), 3, 5, 31, 15))
query("crop_planar", " SELECT image_id, x - 2 AS x, y - 4 AS y, r, g, b, a FROM p WHERE x >= 2 AND x < 33 AND y >= 4 AND y < 19", lambda s, d: geometry.crop(raster(s, d), 3, 5, 31, 15, planar=True))


@query("flip", ", s AS (SELECT image_id, max(y) AS last FROM p GROUP BY image_id) SELECT image_id, x, last - y AS y, r, g, b, a FROM p JOIN s USING (image_id)")
def flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = raster(spark, sf_dir)
    return geometry.flip(p.join(geometry.sizes(p), "image_id"), F.col("height")).drop("width", "height")


query("clear_rect", " SELECT image_id, x, y, CASE WHEN x BETWEEN 10 AND 29 AND y BETWEEN 2 AND 4 THEN 0 ELSE r END AS r, CASE WHEN x BETWEEN 10 AND 29 AND y BETWEEN 2 AND 4 THEN 0 ELSE a END AS a FROM p", lambda s, d: geometry.clear_rect(raster(s, d).select("image_id", "x", "y", "r", "a"), 10, 2, 20, 3, {"r": 0, "a": 0}))
query("copy_rect", " SELECT p.image_id, p.x, p.y, coalesce(q.g, p.r) AS r, coalesce(q.b, p.g) AS g FROM p LEFT JOIN (SELECT image_id, x + 100 AS x, y + 2 AS y, g, b FROM p WHERE x < 40 AND y < 9) q USING (image_id, x, y)", lambda s, d: geometry.copy_rect((p := raster(s, d)).select("image_id", "x", "y", "r", "g"), p.where("x < 40 and y < 9").select("image_id", "x", "y", F.col("g").alias("r"), F.col("b").alias("g")), 100, 2, ["r", "g"]))
query("plane_sizes", ", q(fmt, layout, size) AS (VALUES ('yuv420p', 'planar', 1), ('yuva420p', 'planar', 1), ('argb', 'packed', 4), ('rgba', 'packed', 4), ('bgra', 'packed', 4), ('rgb', 'packed', 3), ('bgr', 'packed', 3), ('Argb', 'packed', 4), ('rgbA', 'packed', 4), ('bgrA', 'packed', 4), ('rgb565', 'packed', 2), ('rgba4444', 'packed', 2), ('rgbA4444', 'packed', 2), ('bgr565', 'packed', 2), ('bgra4444', 'packed', 2), ('bgrA4444', 'packed', 2)), s AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM p GROUP BY image_id) SELECT image_id, fmt, fmt IN ('Argb', 'rgbA', 'bgrA', 'rgbA4444', 'bgrA4444') AS premultiplied, CASE layout WHEN 'packed' THEN w * h * size ELSE w * h * (CASE fmt WHEN 'yuva420p' THEN 2 ELSE 1 END) + 2 * ((w + 1) // 2) * ((h + 1) // 2) END AS total FROM s, q", lambda s, d: plane_sizes(s, d))


def plane_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each image in every format; a row a format, from the formats' properties."""
    rows = [(f, pixels.is_premultiplied(f), pixels.is_packed(f), pixels.bytes_per_pixel(f), pixels.components(f)) for f in pixels.FORMATS]
    formats = spark.createDataFrame(rows, "fmt string, premultiplied boolean, packed boolean, size long, parts long")
    w, h = F.col("width"), F.col("height")
    half = color.shr(w + 1, 1) * color.shr(h + 1, 1)
    total = F.when(F.col("packed"), w * h * F.col("size")).otherwise(w * h * (F.col("parts") - 2) + half * 2)
    return geometry.sizes(raster(spark, sf_dir)).crossJoin(F.broadcast(formats)).select("image_id", "fmt", "premultiplied", total.alias("total"))  # 16 formats


# chroma
def chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = raster(spark, sf_dir)
    return p.where("x % 2 = 0 and y % 2 = 0").select("image_id", F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y"), F.col("g").alias("u"), F.col("b").alias("v"))


def luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster(spark, sf_dir).select("image_id", "x", "y", F.col("r").alias("luma"))


BLOCKS = ", s AS (SELECT image_id, max(x) AS mx, max(y) AS my FROM p GROUP BY image_id), i AS (SELECT DISTINCT image_id, x // 2 AS cx, y // 2 AS cy FROM p), k AS (SELECT image_id, cx, cy, least(2*cx + dx, mx) AS x, least(2*cy + dy, my) AS y FROM i JOIN s USING (image_id), range(2) t1(dx), range(2) t2(dy))"
query("chroma_box", BLOCKS + " SELECT image_id, cx AS x, cy AS y, CAST((sum(r) + 2) // 4 AS BIGINT) AS r FROM k JOIN p USING (image_id, x, y) GROUP BY image_id, cx, cy", lambda s, d: geometry.chroma_box(raster(s, d), "r"))
query("chroma_point", CHROMA + " SELECT image_id, x, y, r AS luma, u, v FROM p JOIN c USING (image_id) WHERE cx = x // 2 AND cy = y // 2", lambda s, d: geometry.chroma_point(luma(s, d), chroma(s, d)).select("image_id", "x", "y", "luma", "u", "v"))


NEAR = ", q AS (SELECT p.*, x // 2 AS nx, y // 2 AS ny, greatest(0, least(w, x // 2 + 2 * (x % 2) - 1)) AS fx, greatest(0, least(h, y // 2 + 2 * (y % 2) - 1)) AS fy FROM p JOIN d USING (image_id))"
FANCY = ", ".join(f"((m0.{c} + 3*m1.{c} + 3*m2.{c} + m3.{c} + 8) // 8 + m0.{c}) // 2 AS {c}" for c in "uv")
JOINS = " ".join(f"JOIN c m{k} ON m{k}.image_id = q.image_id AND m{k}.cx = q.{x} AND m{k}.cy = q.{y}" for k, (x, y) in enumerate((("nx", "ny"), ("fx", "ny"), ("nx", "fy"), ("fx", "fy"))))
query("chroma_fancy", CHROMA + NEAR + f" SELECT q.image_id, x, y, r AS luma, {FANCY} FROM q {JOINS}", lambda s, d: geometry.chroma_filtered(luma(s, d), chroma(s, d), "fancy"))


def filtered(mode: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = geometry.chroma_filtered(luma(spark, sf_dir), chroma(spark, sf_dir), mode)
        return got.select("image_id", "x", "y", *(c.alias(k) for k, c in color.fine_yuv_to_rgb(*map(F.col, ("luma", "u", "v"))).items()))

    return run


def filter_sql(taps: tuple[int, ...], first: str, second: str) -> str:
    """Two passes of clamped neighbours: along rows to every x, then along columns to every y."""
    half = len(taps) // 2
    weights = ", ".join(f"({t}, {w}, {taps[-1 - t]})" for t, w in enumerate(taps))
    across = f", t(t, odd_w, even_w) AS (VALUES {weights}), hp AS (SELECT image_id, x, cy, " + ", ".join(first.format(f"sum({c} * CASE WHEN x % 2 = 1 THEN odd_w ELSE even_w END)") + f" AS {c}" for c in "uv")
    across += f" FROM (SELECT DISTINCT image_id, x, w FROM p JOIN d USING (image_id)) xs CROSS JOIN t JOIN c USING (image_id) WHERE cx = greatest(0, least(w, x // 2 + t - {half} + x % 2)) GROUP BY image_id, x, cy)"
    down = ", vp AS (SELECT image_id, x, y, " + ", ".join(second.format(f"sum({c} * CASE WHEN y % 2 = 1 THEN odd_w ELSE even_w END)") + f" AS {c}" for c in "uv")
    down += f" FROM (SELECT DISTINCT image_id, y, h FROM p JOIN d USING (image_id)) ys CROSS JOIN t JOIN hp USING (image_id) WHERE cy = greatest(0, least(h, y // 2 + t - {half} + y % 2)) GROUP BY image_id, x, y)"
    rgb = [f"{limit(f'((r - 16) * 1220928 {terms} + 524288) >> 20')} AS {c}" for c, terms in (("r", "+ v * 26149"), ("g", "- u * 6419 - v * 13320"), ("b", "+ u * 33050"))]
    return CHROMA + across + down + f" SELECT image_id, x, y, {', '.join(rgb)} FROM p JOIN vp USING (image_id, x, y)"


query("chroma_fast", filter_sql((-10, 59, 15, 0), "CAST({} - 8192 AS BIGINT)", "CAST({} + 32 AS BIGINT) >> 6"), filtered("fast"))
query("chroma_lanczos", filter_sql((148, -495, 1146, -2658, 14699, 4740, -1709, 767, -295, 41), "CAST({} + 128 AS BIGINT) >> 8", "(CAST({} + 8192 AS BIGINT) >> 14) - 8192"), filtered("lanczos"))

LINEAR = ", ".join(f"CAST(round(4095 * pow({c} / 255.0, 0.8)) AS BIGINT) AS l{c}" for c in "rgb")
SUMS = ", ".join(f"CAST(sum(l{c}) AS BIGINT) AS {c}, CAST(sum(l{c} * a) AS BIGINT) AS w{c}" for c in "rgb")
BACK = "((CAST(round(255 * pow(least({0} // 512 + 1, 32) / 32.0, 1.25)) AS BIGINT) * ({0} % 512) + CAST(round(255 * pow(({0} // 512) / 32.0, 1.25)) AS BIGINT) * (512 - {0} % 512) + 64) >> 7)"
MEANS = ", ".join(f"CASE WHEN ta IN (0, 1020) THEN {c} ELSE ((w{c} * (524288 // ta)) & 4294967295) >> 17 END AS {c}" for c in "rgb")
UV = f"{limit('(28800*b - 9719*r - 19081*g + 131072 + 33554432) >> 18')} AS u, {limit('(28800*r - 24116*g - 4684*b + 131072 + 33554432) >> 18')} AS v"
query(
    "rgb_to_yuv420",
    BLOCKS + f", l AS (SELECT *, {LINEAR} FROM p), m AS (SELECT image_id, cx, cy, {SUMS}, CAST(sum(a) AS BIGINT) AS ta FROM k JOIN l USING (image_id, x, y) GROUP BY image_id, cx, cy), n AS (SELECT image_id, cx, cy, {MEANS} FROM m), o AS (SELECT image_id, cx, cy, {', '.join(BACK.format(c) + f' AS {c}' for c in 'rgb')} FROM n) SELECT image_id, cx AS x, cy AS y, {UV} FROM o",
    lambda s, d: geometry.rgb_to_chroma(raster(s, d), True),
)
query("block_alpha", BLOCKS.replace("least(2*cx + dx, mx)", "2*cx + dx").replace("least(2*cy + dy, my)", "2*cy + dy") + " SELECT image_id, cx AS x, cy AS y, CAST((sum(a) + count(*) - 1) // count(*) AS BIGINT) AS a FROM k JOIN p USING (image_id, x, y) GROUP BY image_id, cx, cy", lambda s, d: geometry.block_alpha(raster(s, d), ["a"]))


@query("blend_uv", CHROMA + f", m AS (SELECT image_id, x // 2 AS cx, y // 2 AS cy, CAST((sum(a) + count(*) - 1) // count(*) AS BIGINT) AS a, CAST((sum({DA}) + count(*) - 1) // count(*) AS BIGINT) AS da FROM p GROUP BY ALL), n AS (SELECT *, (da * (256 - a)) >> 8 AS t FROM m JOIN c USING (image_id, cx, cy)) SELECT image_id, cx AS x, cy AS y, " + ", ".join(cases("a", s, o, f"(({s}*a + {o}*t) * (16777216 // greatest(a + t, 1))) >> 24") + f" AS {s}" for s, o in ("uv", "vu")) + " FROM n")
def blend_uv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chroma over chroma (here with U and V changed about) by the alphas of their blocks."""
    p = raster(spark, sf_dir)
    alphas = geometry.block_alpha(p.withColumn("da", (F.col("r") + F.col("b")) % 256), ["a", "da"])
    c = F.col
    return chroma(spark, sf_dir).join(alphas, ["image_id", "x", "y"]).select("image_id", "x", "y", color.blend_sample(c("u"), c("a"), c("v"), c("da")).alias("u"), color.blend_sample(c("v"), c("a"), c("u"), c("da")).alias("v"))


# palettes, tiles, recurrences
def palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.palette_lookup(raster(spark, sf_dir).select("image_id", "x", "y", "g"), spark.range(200).select(F.col("id").alias("entry"), (F.col("id") * 3 % 256).alias("r"), (F.col("id") * 5 % 256).alias("b"))).select("image_id", "x", "y", "g", "r", "b")


query("palette_lookup", " SELECT image_id, x, y, g, CASE WHEN g < 200 THEN g*3%256 ELSE 0 END AS r, CASE WHEN g < 200 THEN g*5%256 ELSE 0 END AS b FROM p", palette)
query("palette_delta", " SELECT image_id, y, x AS entry, CAST(sum(r) OVER (PARTITION BY image_id, y ORDER BY x) % 256 AS BIGINT) AS r, CAST(sum(g) OVER (PARTITION BY image_id, y ORDER BY x) % 256 AS BIGINT) AS g FROM p", lambda s, d: geometry.palette_delta(raster(s, d).select("image_id", "y", F.col("x").alias("entry"), "r", "g"), ["r", "g"], ["image_id", "y"]))
for bits, width in ((1, 249), (2, 499), (3, 993)):
    query(f"palette_expand_{8 >> bits}bit", f" SELECT image_id, x * {1 << bits} + k AS x, y, (g >> ({8 >> bits} * k)) & {(1 << (8 >> bits)) - 1} AS g FROM p, range({1 << bits}) t(k) WHERE x * {1 << bits} + k < {width}", lambda s, d, bits=bits, width=width: geometry.palette_expand(raster(s, d), bits, width).withColumn("x", F.col("x").cast("long")))
query("palette_alpha", " SELECT image_id, x * 4 + k AS x, y, (((g >> (2 * k)) & 3) * 85) % 256 AS a FROM p, range(4) t(k) WHERE x * 4 + k < 499", lambda s, d: geometry.palette_lookup(geometry.palette_expand(raster(s, d), 2, 499), s.range(4).select(F.col("id").alias("entry"), (F.col("id") * 85).alias("a"))).select("image_id", F.col("x").cast("long").alias("x"), "y", "a"))


@query("tile_color_transform", ", t AS (SELECT image_id, x AS tx, y AS ty, a AS m1, g AS m2, b AS m3 FROM p), q AS (SELECT p.image_id, x, y, r, g, b, (m1 + 128) % 256 - 128 AS m1, (m2 + 128) % 256 - 128 AS m2, (m3 + 128) % 256 - 128 AS m3 FROM p JOIN t ON p.image_id = t.image_id AND tx = x // 4 AND ty = y // 4), n AS (SELECT *, (r + ((m1 * ((g + 128) % 256 - 128)) >> 5)) & 255 AS nr FROM q) SELECT image_id, x, y, nr AS r, g, (b + ((m2 * ((g + 128) % 256 - 128)) >> 5) + ((m3 * ((nr + 128) % 256 - 128)) >> 5)) & 255 AS b FROM n")
def tile_color_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The colour transform with the multipliers of tiles of 4 x 4; the tile image is the raster's own corner."""
    p = raster(spark, sf_dir)
    joined = geometry.tile_lookup(p.select("image_id", "x", "y", "r", "g", "b"), p.select("image_id", "x", "y", F.col("a").alias("m1"), F.col("g").alias("m2"), F.col("b").alias("m3")), 2)
    c = F.col
    return joined.select("image_id", "x", "y", *(v.alias(k) for k, v in color.color_transform(c("r"), c("g"), c("b"), *(color.signed(c(m)) for m in ("m1", "m2", "m3"))).items()))


query("code_groups", ", g1 AS (SELECT image_id, a % 8 AS grp, min(y * 1000 + x) AS spot FROM p GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY spot) - 1 AS dense, max(grp) OVER (PARTITION BY image_id) + 1 AS codes FROM g1) SELECT p.image_id, x, y, grp, dense, codes FROM p JOIN n ON p.image_id = n.image_id AND grp = a % 8", lambda s, d: geometry.code_groups(raster(s, d).select("image_id", "x", "y", (F.col("a") % 8).alias("grp")), "grp"))
CODES = ", z AS (SELECT image_id, y, x AS symbol, r % 16 AS length FROM p)"
codes = lambda s, d: raster(s, d).select("image_id", "y", F.col("x").alias("symbol"), (F.col("r") % 16).alias("length"))
query("code_length_histogram", CODES + ", n AS (SELECT image_id, y, length, count(*) AS n FROM z WHERE length > 0 GROUP BY ALL), m AS (SELECT image_id, y, sum(n * pow(2, 15 - length)) AS filled, sum(n) AS symbols FROM n GROUP BY ALL) SELECT image_id, y, length, n, CASE WHEN filled = 32768 OR symbols = 1 THEN 'complete' WHEN filled > 32768 THEN 'over' ELSE 'under' END AS kind FROM n JOIN m USING (image_id, y)", lambda s, d: geometry.code_lengths(codes(s, d), ["image_id", "y"]))
query("canonical_codes", CODES + " SELECT u.image_id, u.y, u.symbol, u.length, CAST(floor(coalesce(sum(pow(2, 15 - v.length)), 0) / pow(2, 15 - u.length)) AS BIGINT) AS code FROM z u LEFT JOIN z v ON u.image_id = v.image_id AND u.y = v.y AND v.length > 0 AND (v.length < u.length OR (v.length = u.length AND v.symbol < u.symbol)) WHERE u.length > 0 GROUP BY u.image_id, u.y, u.symbol, u.length", lambda s, d: geometry.canonical_codes(codes(s, d), ["image_id", "y"]))
query("unfilter_horizontal", ", c AS (SELECT image_id, y, sum(a) OVER (PARTITION BY image_id ORDER BY y ROWS UNBOUNDED PRECEDING) - a AS up FROM p WHERE x = 0) SELECT p.image_id, p.x, p.y, CAST((sum(a) OVER (PARTITION BY p.image_id, p.y ORDER BY p.x ROWS UNBOUNDED PRECEDING) + up) % 256 AS BIGINT) AS a FROM p JOIN c USING (image_id, y)", lambda s, d: geometry.unfilter_horizontal(raster(s, d).select("image_id", "x", "y", "a"), "a").select("image_id", "x", "y", "a"))
query("unfilter_vertical", ", c AS (SELECT image_id, x, sum(a) OVER (PARTITION BY image_id ORDER BY x ROWS UNBOUNDED PRECEDING) - a AS l FROM p WHERE y = 0) SELECT p.image_id, p.x, p.y, CAST((sum(a) OVER (PARTITION BY p.image_id, p.x ORDER BY p.y ROWS UNBOUNDED PRECEDING) + l) % 256 AS BIGINT) AS a FROM p JOIN c USING (image_id, x)", lambda s, d: geometry.unfilter_vertical(raster(s, d).select("image_id", "x", "y", "a"), "a").select("image_id", "x", "y", "a"))
GRADIENT = "WITH RECURSIVE " + RASTER.removeprefix("WITH ") + ", w AS (SELECT image_id, y, list(a ORDER BY x) AS row FROM p GROUP BY ALL), q AS (SELECT image_id, y, list_transform(range(1, len(row) + 1), lambda i: CAST(list_sum(row[1:i]) % 256 AS BIGINT)) AS row FROM w WHERE y = 0 UNION ALL SELECT w.image_id, w.y, list_reduce(range(1, len(w.row)), lambda acc, i: list_append(acc, (w.row[i + 1] + least(greatest(acc[i] + q.row[i + 1] - q.row[i], 0), 255)) % 256), [(w.row[1] + q.row[1]) % 256]) AS row FROM q JOIN w ON w.image_id = q.image_id AND w.y = q.y + 1) SELECT image_id, unnest(range(len(row))) AS x, y, unnest(row) AS a FROM q"
query("unfilter_gradient", GRADIENT, lambda s, d: geometry.unfilter_gradient(raster(s, d), "a"))
query("predict_left", " SELECT image_id, x, y, CAST(sum(r) OVER (PARTITION BY image_id, y ORDER BY x) % 256 AS BIGINT) AS r, CAST(sum(g) OVER (PARTITION BY image_id, y ORDER BY x) % 256 AS BIGINT) AS g FROM p", lambda s, d: geometry.predict_left(raster(s, d).select("image_id", "x", "y", "r", "g"), ["r", "g"]))
query("predict_top", " SELECT image_id, x, y, CAST(sum(r) OVER (PARTITION BY image_id, x ORDER BY y) % 256 AS BIGINT) AS r, CAST(sum(g) OVER (PARTITION BY image_id, x ORDER BY y) % 256 AS BIGINT) AS g FROM p", lambda s, d: geometry.predict_top(raster(s, d).select("image_id", "x", "y", "r", "g"), ["r", "g"]))

# blocks: 16 events each; coefficients from the red channel
BLOCK = ", z AS (SELECT (image_id * 3125 + y * 125 + x) // 16 AS block_id, (image_id * 3125 + y * 125 + x) % 16 AS place, (r - 128) * 4 AS v FROM p), w AS (SELECT block_id, " + ", ".join(f"max(v) FILTER (place = {k}) AS c{k}" for k in range(16)) + " FROM z GROUP BY block_id)"


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("image_id") * 3125 + F.col("y") * 125 + F.col("x")
    return raster(spark, sf_dir).select(F.shiftright(at, 4).alias("block_id"), (at % 16).alias("place"), ((F.col("r") - 128) * 4).alias("value"))


def both_ways(kind: Callable[[str, str, str, str], list[str]], bias: int) -> str:
    """SQL of a transform along columns, then rows."""
    first = ", ".join(f"{e} AS t{4 * y + x}" for x in range(4) for y, e in enumerate(kind(*(f"c{4 * j + x}" for j in range(4)))))
    last = [e for y in range(4) for e in kind(f"(t{4 * y} + {bias})", *(f"t{4 * y + j}" for j in (1, 2, 3)))]
    return BLOCK + f", m AS (SELECT block_id, {first} FROM w), n AS (SELECT block_id, [{', '.join(f'({e}) >> 3' for e in last)}] AS v FROM m) SELECT block_id, CAST(unnest(range(16)) AS INTEGER) AS place, unnest(v) AS value FROM n"


def cosine(a: str, b: str, c: str, d: str) -> list[str]:
    u, v = f"((({b}) * 35468) >> 16) - (((({d}) * 20091) >> 16) + ({d}))", f"(((({b}) * 20091) >> 16) + ({b})) + ((({d}) * 35468) >> 16)"
    return [f"({a}) + ({c}) + ({v})", f"({a}) - ({c}) + ({u})", f"({a}) - ({c}) - ({u})", f"({a}) + ({c}) - ({v})"]


query("idct_blocks", both_ways(cosine, 4), lambda s, d: geometry.transform_blocks(blocks(s, d)))
query("wht_blocks", both_ways(lambda a, b, c, d: [f"({a}) + ({b}) + ({c}) + ({d})", f"({a}) + ({b}) - ({c}) - ({d})", f"({a}) - ({b}) - ({c}) + ({d})", f"({a}) - ({b}) + ({c}) - ({d})"], 3), lambda s, d: geometry.second_order(blocks(s, d)))

# rescaling
SHRINK = ", u AS (SELECT image_id, y, i, (i * 125 + 39) // 40 AS lo, ((i + 1) * 125 + 39) // 40 AS hi FROM (SELECT DISTINCT image_id, y FROM p), range(40) t(i)), v AS (SELECT u.image_id, u.y, i, CAST(sum(r) AS BIGINT) AS total, CAST(arg_max(r, x) AS BIGINT) * (40 * hi - (i + 1) * 125) AS fract FROM u JOIN p ON p.image_id = u.image_id AND p.y = u.y AND p.x >= lo AND p.x < hi GROUP BY ALL, hi), rs AS (SELECT image_id, y, i AS x, (total + coalesce((lag(fract) OVER (PARTITION BY image_id, y ORDER BY i) * 107374182 + 2147483648) >> 32, 0)) * 40 - fract AS r FROM v)"
query("rescale_shrink_rows", SHRINK.replace(" GROUP BY ALL, hi", " GROUP BY u.image_id, u.y, i, hi") + " SELECT * FROM rs", lambda s, d: rescale.shrink_rows(raster(s, d), "r", WIDTH, 40))
EXPAND = ", j AS (SELECT DISTINCT image_id, y FROM p), u AS (SELECT *, greatest(0, (i * 124 + 298) // 299 - 1) AS l FROM j, range(300) t(i)), rs AS (SELECT u.image_id, u.y, i AS x, q.r * 299 + (p.r - q.r) * (299 * (l + 1) - i * 124) AS r FROM u JOIN p ON p.image_id = u.image_id AND p.y = u.y AND p.x = l JOIN p q ON q.image_id = u.image_id AND q.y = u.y AND q.x = l + 1)"
query("rescale_expand_rows", EXPAND + " SELECT * FROM rs", lambda s, d: rescale.expand_rows(raster(s, d), "r", WIDTH, 300))


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = raster(spark, sf_dir)
    return p.join(geometry.sizes(p), "image_id")


SIZES = ", s AS (SELECT image_id, max(y) + 1 AS h FROM p GROUP BY image_id)"
DOWN = ", hh AS (SELECT image_id, h, greatest(1, h * 2 // 5) AS oh FROM s), yy AS (SELECT image_id, h, oh, i, (i * h + oh - 1) // oh AS lo, ((i + 1) * h + oh - 1) // oh AS hi FROM hh, LATERAL (SELECT unnest(range(oh)) AS i)), vv AS (SELECT yy.image_id, x, i, h, oh, CAST(sum(r) AS BIGINT) AS total, (CAST(arg_max(r, y) AS BIGINT) * (((4294967296 // oh) * (oh * hi - (i + 1) * h)) & 4294967295)) >> 32 AS over FROM yy JOIN rs ON rs.image_id = yy.image_id AND y >= lo AND y < hi GROUP BY yy.image_id, x, i, h, oh, hi) SELECT image_id, x, i AS y, least(255, ((total + coalesce(lag(over) OVER (PARTITION BY image_id, x ORDER BY i), 0) - over) * ((oh * 4294967296) // (125 * h)) + 2147483648) >> 32) AS r FROM vv"
query("rescale_plane", SHRINK.replace(" GROUP BY ALL, hi", " GROUP BY u.image_id, u.y, i, hi") + SIZES + DOWN, lambda s, d: rescale.rescale(sized(s, d), "r", F.lit(WIDTH), F.col("height"), F.lit(40), F.greatest(F.lit(1), rescale.div(F.col("height") * 2, F.lit(5)))))
UP = ", hh AS (SELECT image_id, h, 2 * h + 3 AS oh FROM s), yy AS (SELECT image_id, oh, k, (k * (h - 1) + oh - 2) // (oh - 1) AS row, ((k * (h - 1) + oh - 2) // (oh - 1)) * (oh - 1) - k * (h - 1) AS behind FROM hh, LATERAL (SELECT unnest(range(oh)) AS k)) SELECT yy.image_id, p.x, k AS y, least(255, ((CASE behind WHEN 0 THEN n.r * 299 ELSE (n.r * 299 * (4294967296 - (behind * 4294967296) // (oh - 1)) + p.r * 299 * ((behind * 4294967296) // (oh - 1)) + 2147483648) >> 32 END) * 14364439 + 2147483648) >> 32) AS r FROM yy JOIN p ON p.image_id = yy.image_id AND p.y = greatest(row - 1, 0) JOIN p n ON n.image_id = yy.image_id AND n.x = p.x AND n.y = row"


@query("rescale_expand_columns", SIZES + UP)
def expand_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of samples times 299 (as a row grown to 300 has them) grow to 2 h + 3 rows."""
    rows = sized(spark, sf_dir).withColumn("r", F.col("r") * 299)
    got = rescale.expand_columns(rows, "r", F.col("height"), F.col("height") * 2 + 3, 299)
    return got.select("image_id", "x", "y", "r")


# frames
query("frame_timestamps", FRAMES + " SELECT image_id, frame_no, duration, CAST(coalesce(sum(duration) OVER (PARTITION BY image_id ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS timestamp FROM f", lambda s, d: animation.frame_timestamps(frames(s, d).select("image_id", "frame_no", "duration"), "image_id", "frame_no", "duration").withColumn("timestamp", F.col("timestamp").cast("long")))
query("previous_frames", FRAMES + " SELECT image_id, frame_no, lag(pos_x) OVER w AS prev_pos_x, lag(width) OVER w AS prev_width, lag(dispose) OVER w AS prev_dispose FROM f WINDOW w AS (PARTITION BY image_id ORDER BY frame_no)", lambda s, d: animation.previous_frames(frames(s, d), ["pos_x", "width", "dispose"]).select("image_id", "frame_no", "prev_pos_x", "prev_width", "prev_dispose"))
KEYS = ", k AS (SELECT image_id, frame_no, width, height, dispose, true AS key FROM f WHERE frame_no = 0 UNION ALL SELECT f.image_id, f.frame_no, f.width, f.height, f.dispose, ((f.no_blend OR NOT f.has_alpha) AND f.pos_x = 0 AND f.pos_y = 0 AND f.width = 16 AND f.height = 16) OR (k.dispose AND (k.key OR (k.width = 16 AND k.height = 16))) FROM k JOIN f ON f.image_id = k.image_id AND f.frame_no = k.frame_no + 1)"
RECURSIVE = "WITH RECURSIVE " + RASTER.removeprefix("WITH ") + FRAMES + KEYS
query("key_frames", RECURSIVE + " SELECT image_id, frame_no, key, CAST(sum(CAST(key AS INTEGER)) OVER (PARTITION BY image_id ORDER BY frame_no) - 1 AS INTEGER) AS island FROM k", lambda s, d: animation.key_frames(frames(s, d)).select("image_id", "frame_no", "key", "island"))
REGIONS = """, g AS (SELECT f.*, k.key, lag(f.pos_x) OVER w AS px, lag(f.pos_y) OVER w AS py, lag(f.width) OVER w AS pw, lag(f.height) OVER w AS ph, lag(f.dispose) OVER w AS pd FROM f JOIN k USING (image_id, frame_no) WINDOW w AS (PARTITION BY f.image_id ORDER BY f.frame_no)),
 h AS (SELECT *, greatest(px - pos_x, 0) AS kx, greatest(py - pos_y, 0) AS ky, least(pos_x + width, px + pw) - greatest(pos_x, px) AS kw, least(pos_y + height, py + ph) - greatest(pos_y, py) AS kh FROM g),
 o AS (SELECT *, CASE WHEN key OR no_blend OR NOT has_alpha THEN 'copy' WHEN NOT pd OR kw <= 0 OR kh <= 0 THEN 'blend' ELSE 'parts' END AS kind FROM h),
 r AS (SELECT image_id, frame_no, 0 AS x, 0 AS y, width AS w, height AS h, kind = 'blend' AS blend FROM o WHERE kind <> 'parts' UNION ALL SELECT image_id, frame_no, 0, 0, width, ky, true FROM o WHERE kind = 'parts' UNION ALL SELECT image_id, frame_no, 0, ky + kh, width, height - ky - kh, true FROM o WHERE kind = 'parts'
 UNION ALL SELECT image_id, frame_no, 0, ky, kx, kh, true FROM o WHERE kind = 'parts' UNION ALL SELECT image_id, frame_no, kx + kw, ky, width - kx - kw, kh, true FROM o WHERE kind = 'parts' UNION ALL SELECT image_id, frame_no, kx, ky, kw, kh, false FROM o WHERE kind = 'parts')
 SELECT image_id, frame_no, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h, blend FROM r WHERE w > 0 AND h > 0"""
query("frame_regions", RECURSIVE + REGIONS, lambda s, d: animation.regions(animation.key_frames(frames(s, d))))
query("output_budget", FRAMES + " SELECT * FROM (SELECT image_id, frame_no, width * height * 4 AS bytes, CAST(sum(width * height * 4) OVER (PARTITION BY image_id ORDER BY frame_no) AS BIGINT) AS spent FROM f) WHERE spent <= 20000", lambda s, d: animation.within_budget(frames(s, d).select("image_id", "frame_no", (F.col("width") * F.col("height") * 4).alias("bytes")), "bytes", 20_000))
query("frame_cap", FRAMES + " SELECT image_id, frame_no FROM f WHERE frame_no < 100", lambda s, d: animation.first_frames(frames(s, d), 100).select("image_id", "frame_no"))
query("frame_summary", FRAMES + " SELECT image_id, count(*) AS frame_count, bool_or(has_alpha) AS has_alpha, CAST(bit_or(CASE WHEN dispose THEN 1 ELSE 0 END + CASE WHEN no_blend THEN 2 ELSE 0 END) AS INTEGER) AS flags FROM f GROUP BY image_id", lambda s, d: frames(s, d).groupBy("image_id").agg(F.count("*").alias("frame_count"), F.bool_or("has_alpha").alias("has_alpha"), F.bit_or(F.col("dispose").cast("int") + F.col("no_blend").cast("int") * 2).alias("flags")))

# whole pictures
query("alpha_classes", " SELECT image_id, y, CASE WHEN min(v) = 255 THEN 'opaque' WHEN max(v) = 0 THEN 'clear' ELSE 'mixed' END AS kind FROM (SELECT image_id, y, CASE y % 3 WHEN 0 THEN 255 WHEN 1 THEN 0 ELSE a END AS v FROM p) GROUP BY ALL", lambda s, d: geometry.alpha_class(raster(s, d).withColumn("v", F.when(F.col("y") % 3 == 0, 255).when(F.col("y") % 3 == 1, 0).otherwise(F.col("a"))), "v", ["image_id", "y"]))
OTHER = "SELECT image_id, x, y, CASE WHEN x % 7 = 0 THEN g ELSE r END AS r, g, b, CASE WHEN x % 5 = 0 THEN 0 ELSE a END AS a FROM p WHERE y < 24"


@query("picture_differences", f", u AS (SELECT image_id, x, y, r, g, b, CASE WHEN x % 5 = 0 THEN 0 ELSE a END AS a FROM p WHERE x > 1), q AS ({OTHER}) SELECT image_id, count(*) FILTER (WHERE u.r IS NOT NULL AND q.r IS NOT NULL AND (u.r, u.g, u.b, u.a) <> (q.r, q.g, q.b, q.a) AND NOT (u.a = 0 AND q.a = 0)) AS visible, count(*) FILTER (WHERE u.r IS NOT NULL AND q.r IS NOT NULL AND (u.r, u.g, u.b, u.a) <> (q.r, q.g, q.b, q.a) AND u.a = 0 AND q.a = 0) AS transparent, count(*) FILTER (WHERE u.r IS NULL OR q.r IS NULL) AS geometry FROM u FULL JOIN q USING (image_id, x, y) GROUP BY image_id")
def picture_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = raster(spark, sf_dir).withColumn("a", F.when(F.col("x") % 5 == 0, 0).otherwise(F.col("a")))
    return geometry.differences(p.where("x > 1"), p.where("y < 24").withColumn("r", F.when(F.col("x") % 7 == 0, F.col("g")).otherwise(F.col("r"))))


query("picture_md5", " SELECT image_id, md5(unhex(string_agg(lower(lpad(hex(r), 2, '0') || lpad(hex(g), 2, '0') || lpad(hex(b), 2, '0') || lpad(hex(a), 2, '0')), '' ORDER BY y, x))) AS digest FROM p GROUP BY image_id", lambda s, d: geometry.row_bytes(raster(s, d), "rgba").select("image_id", F.md5("data").alias("digest")))


def oracle_sql() -> dict[str, str]:
    return {name: sql if sql.startswith("WITH") else RASTER + sql for name, sql in SQL.items()}
