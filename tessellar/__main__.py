"""python -m tessellar INPUT...: decodes files (paths or globs that Spark reads) to a folder, or tells what their headers say."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessellar import api
from tessellar.codecs.pixels import FORMATS
from tessellar.operators import animation, decode
from tessellar.options import COMPOSITED, SUBFRAME, Options
from tessellar.sinks import files, muxers
from tessellar.sources import container
from tessellar.status import CodecError

SUFFIX = {"raw": "raw", "ppm": "ppm", "pam": "pam", "y4m": "y4m"}


def numbers(n: int, separators: str):
    def read(text: str) -> tuple[int, ...]:
        for s in separators:
            text = text.replace(s, ",")
        got = tuple(int(v) for v in text.split(","))
        if len(got) != n:
            raise argparse.ArgumentTypeError(f"{n} numbers")
        return got

    return read


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser("tessellar", description=__doc__)
    p.add_argument("input", nargs="+", help="files, folders or globs; - for standard input")
    p.add_argument("--version", action="version", version=api.VERSION)
    p.add_argument("--info", nargs="?", const="text", choices=["text", "json"], help="headers only")
    p.add_argument("--output", help="a folder that all executors share")
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--muxer", choices=muxers.MUXERS, default="md5")
    p.add_argument("--format", choices=FORMATS)
    p.add_argument("--crop", type=numbers(4, ""), metavar="L,T,W,H")
    p.add_argument("--scale", type=numbers(2, "x"), metavar="WxH", help="0 keeps the proportions")
    p.add_argument("--flip", action="store_true")
    p.add_argument("--uvmode", type=int, choices=range(4), default=1)
    p.add_argument("--nofilter", action="store_true")
    p.add_argument("--subframes", action="store_true", help="frames on their own, without a canvas")
    p.add_argument("--metadata", action="store_true", help="write the ICC, Exif and XMP payloads too")
    p.add_argument("--tables", help="JSON file of the probabilities of lossy frames")
    p.add_argument("--limit", type=int, default=0, help="greatest number of pixels")
    p.add_argument("--max-input", type=int, default=1280 << 20, help="greatest size of a file in bytes")
    p.add_argument("--max-output", type=int, help="greatest number of bytes written for a file; frames beyond it are left out")
    return p.parse_args(argv)


def run(a: argparse.Namespace, spark: SparkSession) -> list[str]:
    """The lines that are printed."""
    if a.input == ["-"]:
        found = container.read_local(spark, sys.stdin.buffer, max_bytes=a.max_input)
    else:
        found = None
        for path in a.input:
            one = container.read_images(spark, path, a.max_input)
            found = one if found is None else found.unionByName(one)
    told = container.image_info(found)
    if a.info:
        shown = container.info_json() if a.info == "json" else container.info_text()
        return [f"{r['path']}: {r['line']}" for r in told.select("path", F.when(F.col("status") == "ok", shown).otherwise(F.col("status")).alias("line")).orderBy("path").toLocalIterator()]
    if a.metadata and a.output:
        files.write_files(files.metadata_files(container.metadata(found)), a.output, a.overwrite)
    if a.muxer == "y4m" and a.format is None:
        raise CodecError("invalid_argument", "y4m needs --format yuv420p or yuva420p here, as one run has one format")
    fmt = muxers.format_for(a.muxer, a.format)
    options = Options(fmt, a.crop, a.scale, a.flip, a.uvmode, a.nofilter, SUBFRAME if a.subframes else COMPOSITED, a.limit).check()
    pictures = decode.decode(found, options, api.Tables.load(a.tables) if a.tables else None)
    if a.muxer == "md5":
        return [f"{r['md5']}  {r['path']}" + ("" if r["status"] == "ok" else f"  ({r['status']})") for r in muxers.file_md5(pictures).orderBy("path").toLocalIterator()]
    if a.muxer == "null" or not a.output:
        files.discard(pictures)
        return []
    out = muxers.muxed(pictures, a.muxer)
    if a.max_output is not None:
        out = animation.within_budget(out.withColumn("bytes", F.length("data")), "bytes", a.max_output, "path")
    stem = F.regexp_extract("path", r"([^/]+)$", 1)
    named = out.select(F.format_string(f"%s.%06d.{SUFFIX[a.muxer]}", stem, "frame_no").alias("name"), "data")
    files.write_files(named, a.output, a.overwrite)
    return []


def main() -> int:
    a = arguments(sys.argv[1:])
    spark = SparkSession.builder.appName("tessellar").getOrCreate()
    try:
        for line in run(a, spark):
            print(line)
    except CodecError as e:
        print(f"{e.status}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
