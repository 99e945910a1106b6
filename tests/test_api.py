import json
import random

import pytest

import webp
from tessellar import __main__ as cli
from tessellar import api, status
from test_frames import TABLES, animation, lossless, lossy


def test_one_file():
    rng = random.Random(1)
    p, c = lossless(rng, 7, 5)
    data = webp.riff(webp.vp8x(7, 5, 16 | 8), c, webp.chunk("EXIF", b"camera"))
    assert (api.info(data).width, api.info(data).metadata) == (7, 2)
    assert api.metadata(data, "EXIF") == b"camera" and api.metadata(data, "XMP") is None
    got = api.decode(data, api.Options(fmt="argb"))
    assert got.planes[0] == p.astype(">u4").tobytes()
    assert list(api.rows(got))[2] == p[2].astype(">u4").tobytes()
    assert api.window(got, 2, 1, 3, 2).planes[0] == p[1:3, 2:5].astype(">u4").tobytes()
    assert api.frame_info(data, 0).width == 7
    buffer = bytearray(b"x" * 200)
    api.decode_into(data, [memoryview(buffer)], [32], api.Options(fmt="argb"))
    assert bytes(buffer[32:60]) == p[1].astype(">u4").tobytes() and buffer[28:32] == b"xxxx"
    wrong = [(lambda: api.decode_into(data, [memoryview(bytearray(100))], [32], api.Options(fmt="argb")), "buffer_too_small"), (lambda: api.info(b"junk, and more of it"), "not_webp"), (lambda: api.metadata(data, "PNG"), "invalid_argument"), (lambda: api.frame_info(data, 1), "invalid_argument"), (lambda: api.window(got, 6, 0, 3, 1), "invalid_argument"), (lambda: api.decode(webp.riff(lossy(rng, 8, 8))), "unsupported")]
    for f, want in wrong:
        with pytest.raises(status.CodecError) as e:
            f()
        assert e.value.status == want
    assert set(api.TEXTS) == set(status.ALL)
    moving, told = animation(rng, 5)
    assert len(list(api.pictures(moving))) == 5 and api.frame_info(moving, 3).width == told[3][2]


def test_warnings_and_faults(monkeypatch):
    rng = random.Random(3)
    small = webp.anmf(0, 0, 8, 8, 1, 0, lossless(rng, 4, 4)[1])
    heard = []
    list(api.pictures(webp.riff(webp.vp8x(8, 8, 2), webp.anim(), small), log=heard.append))
    assert heard == ["a frame's image is smaller than declared"]
    large = webp.anmf(0, 0, 4, 4, 1, 0, lossless(rng, 8, 8)[1])
    with pytest.raises(status.CodecError) as e:
        list(api.pictures(webp.riff(webp.vp8x(8, 8, 2), webp.anim(), large)))
    assert e.value.status == "invalid_data"
    monkeypatch.setattr(api.frames, "decode_file", lambda *a: 1 / 0)
    with pytest.raises(status.CodecError) as e:
        list(api.pictures(b""))
    assert e.value.status == "internal"


def test_command_line(spark, tmp_path):
    rng = random.Random(2)
    p, c = lossless(rng, 6, 4, alpha=False)
    (tmp_path / "a.webp").write_bytes(webp.riff(c))
    (tmp_path / "b.webp").write_bytes(animation(rng, 3)[0])
    (tmp_path / "c.webp").write_bytes(webp.riff(lossy(rng, 9, 9)))
    run = lambda *argv: cli.run(cli.arguments([str(tmp_path / "*.webp"), *argv]), spark)
    assert [json.loads(x.split(": ", 1)[1])["frame_count"] for x in run("--info=json")] == [1, 3, 1]
    assert "canvas: 16x12" in run("--info")[1]
    sums = run("--format", "rgba")
    assert len(sums) == 3 and sums[2].endswith("(unsupported)")
    run("--muxer", "ppm", "--output", str(tmp_path / "out"), "--crop", "1,1,4,2")
    assert sorted(f.name for f in (tmp_path / "out").iterdir()) == ["a.webp.000000.ppm", *(f"b.webp.{k:06d}.ppm" for k in range(3))]
    run("--muxer", "pam", "--output", str(tmp_path / "few"), "--max-output", str(2 * (16 * 12 * 4 + 80)))
    assert len([f for f in (tmp_path / "few").iterdir() if f.name.startswith("b.")]) == 2
    assert TABLES is not None and run("--muxer", "null") == []
