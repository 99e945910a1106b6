"""Streams against whole files, sinks and muxers."""

import hashlib
import pickle
import random

import pytest
from pyspark.sql import functions as F

import webp
from tessellar.codecs import frames, vp8, vp8l
from tessellar.codecs.stream import Stream
from tessellar.operators import decode as D
from tessellar.options import Options
from tessellar.sinks import files, muxers
from tessellar.sources import container
from tessellar.status import CodecError
from tessellar.streaming import incremental
from test_frames import TABLES, animation, lossless, lossy


def shown(pictures):
    return [(d.frame_no, d.picture.fmt, d.picture.planes, d.duration, d.timestamp) for d in pictures]


@pytest.mark.parametrize("size", [1, 64, 1021, 4096])
def test_parts_equal_the_whole(size):
    rng = random.Random(size)
    big = animation(rng, 40, 64, 48)[0] if size > 64 else animation(rng, 5)[0]
    for data in (big, webp.riff(lossless(rng, 20, 9)[1]), webp.riff(lossy(rng, 33, 20)), lossless(rng, 5, 5)[1][8:]):
        s, got = Stream(Options(fmt="rgba"), TABLES), []
        step = max(size, len(data) // 400)
        for at in range(0, len(data), step):
            s.append(data[at : at + step])
            got += shown(s.pictures())
            s = pickle.loads(pickle.dumps(s))
        s.append(b"trailing bytes" if data[:4] == b"RIFF" else b"")
        s.end()
        got += shown(s.pictures())
        assert got == shown(frames.decode_file(data, Options(fmt="rgba"), TABLES))
        if data is big and size > 64:
            assert len(s.data) < len(data) // 2  # what was consumed is gone


def test_prefixes_and_rules():
    rng = random.Random(2)
    data = animation(rng, 4)[0]
    s = Stream()
    n = 0
    for at in range(10, len(data) + 50, 50):
        s.update(data[:at])
        n += len(list(s.pictures()))
        assert s.info().frame_count <= 4
    assert n == 4
    s.rewind()
    assert len(list(s.pictures())) == 4
    for wrong in (lambda: s.append(b"x"), lambda: s.update(data[:9])):
        with pytest.raises(CodecError) as e:
            wrong()
        assert e.value.status == "invalid_argument"
    s = Stream()
    s.append(data[:60])
    assert list(s.pictures()) == []  # not whole is no error before the end
    with pytest.raises(CodecError) as e:
        s.rewind()
    assert e.value.status == "unsupported"
    s.end()
    for _ in range(2):
        with pytest.raises(CodecError) as e:
            list(s.pictures())
        assert e.value.status == "truncated"


def test_partial_rows():
    rng = random.Random(4)
    p, c = lossless(rng, 30, 40)
    image = lossy(rng, 40, 70)
    y = vp8.decode(image[8:], TABLES).y
    seen = {"l": set(), "y": set()}
    for cut in range(40, len(c), 300):
        argb, rows = vp8l.decode_rows(c[8:][:cut]) if cut > 1300 else (p, 0)
        assert (argb[:rows] == p[:rows]).all()
        seen["l"].add(rows)
    for cut in range(20, len(image) - 8, 40):
        try:
            planes, rows = vp8.decode_rows(image[8 : 8 + cut], len(image) - 8, TABLES)
        except CodecError:
            continue
        assert (planes.y[:rows] == y[:rows]).all()
        seen["y"].add(rows)
    assert len(seen["l"]) > 3 and len(seen["y"]) > 1
    s = Stream(Options(fmt="rgb"), TABLES)
    whole = webp.riff(image)
    s.append(whole[: len(whole) * 3 // 4])
    got = s.partial()
    assert got is None or got[0] % 16 in (7, 15, 0)
    s.append(whole[len(whole) * 3 // 4 :])
    assert s.partial()[0] == 70
    assert s.partial()[1].planes == next(s.pictures()).picture.planes


def test_stream_of_parts(spark, tmp_path):
    rng = random.Random(7)
    told = {"a": animation(rng, 6)[0], "b": webp.riff(lossless(rng, 9, 9)[1]), "junk": b"no image, but long enough"}
    rows = []
    for k, data in told.items():
        cut = [data[at : at + 700] for at in range(0, len(data), 700)]
        rows += [(k, n, d, n == len(cut) - 1) for n, d in enumerate(cut)]
    rng.shuffle(rows)
    shape = "stream_id string, seq int, data binary, last boolean"
    for n in range(3):
        spark.createDataFrame(rows[n::3] + rows[n::7], shape).write.mode("append").parquet(f"{tmp_path}/in/{n}")
    source = spark.readStream.schema(shape).option("maxFilesPerTrigger", 3).parquet(f"{tmp_path}/in/*")
    q = incremental.decode_stream(source, Options(fmt="argb")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = {(r["stream_id"], r["frame_no"]): r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got.pop(("junk", 0))["status"] == "not_webp"
    want = {(k, d.frame_no): d for k in "ab" for d in frames.decode_file(told[k], Options(fmt="argb"))}
    assert set(got) == set(want)
    assert all(bytes(got[k]["planes"][0]) == d.picture.planes[0] and got[k]["timestamp"] == d.timestamp for k, d in want.items())


def test_muxers(spark):
    rng = random.Random(11)
    p, c = lossless(rng, 5, 3, alpha=False)
    moving = animation(rng, 3)[0]
    df = spark.createDataFrame([("still", webp.riff(c)), ("moving", moving), ("lossy", webp.riff(lossy(rng, 5, 3)))], "path string, content binary")
    one = lambda muxer, fmt, path="still": {r["frame_no"]: r for r in muxers.muxed(D.decode(df.where(F.col("path") == path), Options(fmt=fmt), TABLES), muxer).collect()}
    rgb = b"".join(bytes((v >> 16 & 255, v >> 8 & 255, v & 255)) for v in map(int, p.ravel()))
    assert bytes(one("ppm", "rgb")[0]["data"]) == b"P6\n5 3\n255\n" + rgb
    assert bytes(one("pam", "rgba")[0]["data"]).startswith(b"P7\nWIDTH 5\nHEIGHT 3\nDEPTH 4\nMAXVAL 255\nTUPLTYPE RGB_ALPHA\nENDHDR\n")
    assert one("ppm", "rgba")[0]["status"] == "invalid_argument"
    assert bytes(one("y4m", "argb")[0]["data"]).startswith(b"YUV4MPEG2 W5 H3 F0:0 Ip A0:0 C444\nFRAME\n")
    assert len(one("y4m", "argb")[0]["data"]) == len(b"YUV4MPEG2 W5 H3 F0:0 Ip A0:0 C444\nFRAME\n") + 45
    assert bytes(one("y4m", "yuv420p", "lossy")[0]["data"])[:40] == b"YUV4MPEG2 W5 H3 F0:0 Ip A0:0 C420jpeg\nFRAME\n"[:40]
    frames_of = one("y4m", "yuva420p", "moving")
    assert bytes(frames_of[0]["data"]).startswith(b"YUV4MPEG2 W16 H12 F0:0 Ip A0:0 C444alpha\nFRAME\n") and bytes(frames_of[2]["data"]).startswith(b"FRAME\n")
    assert len(frames_of[1]["data"]) == 6 + 4 * 16 * 12
    sums = {r["path"]: r for r in muxers.file_md5(D.decode(df, Options(fmt="rgba"), TABLES)).collect()}
    for path, data in (("moving", moving), ("still", webp.riff(c))):
        want = hashlib.md5(b"".join(d.picture.planes[0] for d in frames.decode_file(data, Options(fmt="rgba")))).hexdigest()
        assert sums[path]["md5"] == want and sums[path]["status"] == "ok"
    assert muxers.format_for("ppm", None) == "rgb" and muxers.format_for("y4m", None, "lossless") == "argb" and muxers.format_for("y4m", None, "lossy", True) == "yuva420p"
    for bad in (("ppm", "rgba"), ("y4m", "rgb"), ("gif", None)):
        with pytest.raises(CodecError):
            muxers.format_for(*bad)


def test_files(spark, tmp_path):
    held = webp.riff(webp.vp8x(8, 8, 0x20 | 8), webp.chunk("ICCP", b"profile"), webp.chunk("VP8L", bytes.fromhex("2f07c00100888808")), webp.chunk("EXIF", b"camera"))
    df = spark.createDataFrame([("x/a.webp", held), ("x/b.webp", webp.ONE_PIXEL)], "path string, content binary")
    found = files.metadata_files(container.metadata(df))
    files.write_files(found, str(tmp_path / "out"))
    assert {f.name: f.read_bytes() for f in (tmp_path / "out").iterdir()} == {"a.webp.icc": b"profile", "a.webp.exif": b"camera"}
    with pytest.raises(Exception):
        files.write_files(found, str(tmp_path / "out"))
    files.write_files(found, str(tmp_path / "out"), overwrite=True)
    with pytest.raises(Exception):
        files.write_files(found.union(found), str(tmp_path / "two"))
    with pytest.raises(Exception):
        files.write_files(spark.createDataFrame([("../up", b"x")], "name string, data binary"), str(tmp_path / "bad"))
    assert all(not [f for f in (tmp_path / d).iterdir() if f.name.startswith(".")] for d in ("out", "two"))
    files.discard(df)
