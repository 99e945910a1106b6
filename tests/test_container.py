"""Container rules one by one, and the tables made of headers."""

import io
import json
import struct

import pytest
from pyspark.sql import functions as F

from tessellar.sources import container, riff
from webp import ONE_PIXEL, anim, anmf, chunk, u24, vp8x
from webp import riff as file_of


def vp8l(w, h, alpha=False, version=0):
    return chunk("VP8L", b"\x2f" + struct.pack("<I", w - 1 | h - 1 << 14 | alpha << 28 | version << 29) + b"\x88\x88\x08")


def vp8(w, h, tag=0x10, code=b"\x9d\x01\x2a"):
    return chunk("VP8 ", u24(tag) + code + struct.pack("<HH", w, h) + b"\0" * 4)


FRAME = anmf(0, 0, 8, 8, 40, 0, vp8l(8, 8))
RULES = [
    ("not an image", b"not a webp file at all", "not_webp"),
    ("short", b"RIFF\0\0\0\0", "truncated"),
    ("empty", b"", "truncated"),
    ("first chunk", file_of(("EXIF", b"x"), vp8l(8, 8)), "invalid_data"),
    ("size of all ones", file_of(vp8x(8, 8)) + b"VP8L\xff\xff\xff\xff", "ok"),
    ("no image at all", file_of(), "invalid_data"),
    ("cut", ONE_PIXEL[:20], "truncated"),
    ("VP8X twice", file_of(vp8x(8, 8), vp8x(8, 8)), "invalid_data"),
    ("VP8X of nine bytes", file_of(("VP8X", b"\0" * 9)), "invalid_data"),
    ("reserved flags", file_of(vp8x(8, 8, 1), vp8l(8, 8)), "invalid_data"),
    ("wide canvas", file_of(vp8x(16385, 8), vp8l(8, 8)), "too_large"),
    ("still in an animation", file_of(vp8x(8, 8, 2), anim(), vp8l(8, 8)), "invalid_data"),
    ("alpha in an animation", file_of(vp8x(8, 8, 2), anim(), ("ALPH", b"\0\0")), "invalid_data"),
    ("short ANIM", file_of(vp8x(8, 8, 2), ("ANIM", b"\0" * 5)), "invalid_data"),
    ("ANIM after a still", file_of(vp8x(8, 8), vp8l(8, 8), anim()), "invalid_data"),
    ("frame before ANIM", file_of(vp8x(8, 8, 2), FRAME), "invalid_data"),
    ("two frames without the flag", file_of(vp8x(8, 8), anim(), FRAME, FRAME), "invalid_data"),
    ("one frame without the flag", file_of(vp8x(8, 8), anim(), FRAME), "ok"),
    ("small frame without the flag", file_of(vp8x(9, 8), anim(), FRAME), "invalid_data"),
    ("frame off the canvas", file_of(vp8x(8, 8, 2), anim(), anmf(2, 0, 8, 8, 1, 0)), "invalid_data"),
    ("short frame", file_of(vp8x(8, 8, 2), anim(), ("ANMF", b"\0" * 15)), "invalid_data"),
    ("canvas and image differ", file_of(vp8x(8, 8), vp8l(8, 9)), "invalid_data"),
    ("lossless version", file_of(vp8l(8, 8, version=1)), "invalid_data"),
    ("lossy start code", file_of(vp8(8, 8, code=b"\x9d\x01\x2b")), "invalid_data"),
    ("lossy inter frame", file_of(vp8(8, 8, tag=0x11)), "invalid_data"),
    ("lossy profile", file_of(vp8(8, 8, tag=0x18)), "invalid_data"),
    ("lossy hidden", file_of(vp8(8, 8, tag=0)), "invalid_data"),
    ("lossy", file_of(vp8(8, 9)), "ok"),
    ("bare lossless", vp8l(8, 8)[8:], "ok"),
    ("bare lossy", vp8(8, 8)[8:], "ok"),
    ("bare alpha", chunk("ALPH", b"\0\0\0") + vp8(8, 8), "ok"),
    ("bare alpha without image", chunk("ALPH", b"\0\0\0") + chunk("XXXX", b"12345678"), "invalid_data"),
]


@pytest.mark.parametrize("name,data,status", RULES, ids=[r[0] for r in RULES])
def test_rules(name, data, status):
    assert riff.scan(data).status == status


def test_whole_files_need_their_ends():
    assert riff.scan(file_of(vp8x(8, 8, 2))).status == "ok"
    assert riff.checked(file_of(vp8x(8, 8, 2))).status == "invalid_data"  # the flag without ANIM
    odd = file_of(("VP8L", b"\x2f" + struct.pack("<I", 7 | 7 << 14) + b"\0\0"))
    assert riff.checked(odd).status == "ok"
    cut = riff.checked(odd[:-1])  # without the last pad byte
    assert cut.status == "truncated"


def test_info(spark):
    cases = {
        "still": file_of(vp8l(8, 5, True)),
        "moving": file_of(vp8x(8, 9, 2), anim(5, 3), anmf(0, 0, 8, 8, 40, 1, vp8l(8, 8)), anmf(0, 0, 8, 8, 50, 2, chunk("XTRA", b"x"), chunk("ALPH", b"\0\0"), vp8(8, 8)), ("EXIF", b"x")),
        "unflagged": file_of(vp8x(8, 8), anim(), FRAME),
        "flags": file_of(vp8x(8, 8, 0x20 | 8 | 4 | 0x10), vp8l(8, 8), ("ICCP", b""), ("ICCP", b"abc"), ("ICCP", b"def")),
        "alph": file_of(vp8x(8, 8, 0), ("ALPH", b"\0\0"), vp8(8, 8)),
        "none": None,
        "junk": b"some junk here",
    }
    cases["cut"] = cases["moving"][:-20]
    files = spark.createDataFrame(list(cases.items()), "path string, content binary").withColumns({c: F.lit(1) for c in ("seq", "status", "width")})
    info = {r["path"]: r for r in container.image_info(files).collect()}
    told = lambda k: tuple(info[k][c] for c in ("status", "width", "height", "has_alpha", "is_animation", "frame_count", "loop_count", "background_argb", "coding", "metadata"))
    assert told("still") == ("ok", 8, 5, True, False, 1, 0, 0, "lossless", 0)
    assert told("moving") == ("ok", 8, 9, False, True, 2, 3, 5, "unknown", 2)
    assert told("unflagged") == ("ok", 8, 8, False, True, 1, 0, 0, "unknown", 0)
    assert told("flags") == ("ok", 8, 8, True, False, 1, 0, 0, "lossless", 7)
    assert told("alph")[3] is False
    assert info["none"]["status"] == "truncated" and info["junk"]["status"] == "not_webp" and info["cut"]["truncated"]
    assert info["moving"]["durations_ms"] == [40, 50]
    assert container.riff_chunks(files).where("not complete").count() == 1
    frames = {(r["path"], r["frame_no"]): r for r in container.frame_table(files).collect()}
    assert [frames["moving", k][c] for k in (0, 1) for c in ("duration", "dispose", "no_blend", "has_alpha")] == [40, True, False, False, 50, False, True, True]
    assert (frames["still", 0]["width"], frames["still", 0]["height"]) == (8, 5) and ("alph", 0) in frames
    held = {r["path"]: r for r in container.metadata(files).collect()}
    assert bytes(held["flags"]["icc"]) == b"abc" and bytes(held["moving"]["exif"]) == b"x" and held["still"]["xmp"] is None
    for table in (container.image_info, container.riff_chunks, container.frame_table, container.metadata):
        assert table(files.limit(0)).count() == 0
    shown = {r["path"]: r["j"] for r in container.image_info(files).select("path", container.info_json().alias("j")).collect()}
    assert json.loads(shown["moving"]) == {"width": 8, "height": 9, "coding": "unknown", "is_animation": True, "frame_count": 2, "loop_count": 3, "has_alpha": False, "has_icc": False, "has_exif": True, "has_xmp": False, "durations_ms": [40, 50]}


def test_files(spark, tmp_path):
    (tmp_path / "a.webp").write_bytes(ONE_PIXEL)
    (tmp_path / "b.webp").write_bytes(ONE_PIXEL + b"x" * 100)
    got = {r["path"].rsplit("/", 1)[1]: (r["status"], r["content"] is None, r["length"]) for r in container.read_images(spark, str(tmp_path), 40).collect()}
    assert got == {"a.webp": ("ok", False, 34), "b.webp": ("too_large", True, 134)}
    assert container.read_local(spark, io.BytesIO(ONE_PIXEL)).first()["status"] == "ok"
    assert container.read_local(spark, io.BytesIO(ONE_PIXEL), max_bytes=33).first()["status"] == "too_large"
