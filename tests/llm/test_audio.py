"""Chroma fingerprints against all pairs, on melodies with planted takes and on edge cases."""

import numpy as np
from pyspark.sql import functions as F

from tessellar.llm import audio

SCHEMA = "recording_id long, audio binary, component_id string"


def expected(rows, s):
    fps = [audio.fingerprint(d, s) for _, d in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sorted([fps[i].tobytes(), fps[j].tobytes()], key=lambda f: __import__("hashlib").sha256(f).hexdigest())
            if len(a) and len(b) and (a == b or audio.linked(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4"), s)):
                root[find(i)] = find(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    least = lambda g: min((k for k in g if k is not None), default=None)
    return [(k, len(f), k if not len(f) else least(groups[find(i)])) for i, ((k, _), f) in enumerate(zip(rows, fps, strict=True))]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def test_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(12):
        x = audio.melody(list(rng.normal(0, 0.125, 48)))
        rows.append((10 * k, audio.wav(x, 4000)))
        rows += [(10 * k + j, audio.wav(0.4 * x[1024 * 4 * j :] + rng.normal(0, 30, len(x) - 4096 * j), 4000)) for j in range(1, k % 4)]
    silence = audio.wav(np.zeros(40_000), 4000)
    rows += [(5, rows[0][1]), (5, silence), (None, silence), (None, None), (900, b"no wave"), (901, b""), (902, audio.wav(np.zeros(10), 4000)), (902, rows[3][1])]
    df = spark.createDataFrame([(k, d, "x") for k, d in rows], SCHEMA)
    got = [(r["recording_id"], r["n_items"], r["component_id"]) for r in audio.align_recordings(df).collect()]
    want = expected(rows, audio.Settings())
    assert sorted(got, key=key) == sorted(want, key=key)
    groups = {k: c for k, n, c in got if k is not None and n}
    assert all(groups[10 * k + j] == 10 * k for k in range(1, 12) for j in range(1, k % 4))
    assert len({groups[10 * k] for k in range(12)}) == 12


def test_large_buckets(spark):
    """Recordings that share words with a hub but not enough: small buckets as rows and large ones in blocks give all pairs' groups."""
    rng, rows = np.random.default_rng(9), []
    common = list(rng.normal(0, 0.125, 20))
    for k in range(8):
        own = list(rng.normal(0, 0.125, 120))
        for j in range(3):
            x = audio.melody(common + own)
            rows.append((10 * k + j, audio.wav((1 - 0.2 * j) * x + rng.normal(0, 20 * j, len(x)), 4000)))
    df = spark.createDataFrame([(k, d, "x") for k, d in rows], SCHEMA)
    for s in (audio.Settings(share=0.4, pairwise=1, block=4), audio.Settings(share=0.4, pairwise=1000)):
        got = [(r["recording_id"], r["n_items"], r["component_id"]) for r in audio.align_recordings(df, s).collect()]
        assert sorted(got, key=key) == sorted(expected(rows, s), key=key)
        assert len({c for _, _, c in got}) == 8


def test_every_link_counts(spark):
    """n_links is that of all pairs of distinct fingerprints, also within groups whose members all meet, from small and large buckets and both."""
    rng, rows = np.random.default_rng(11), []
    for k, takes in enumerate((1, 2, 3, 5, 9)):
        x = audio.melody(list(rng.normal(0, 0.125, 64)))
        rows += [(10 * k + j, audio.wav((1 - 0.05 * j) * x[700 * j :] + rng.normal(0, 20, len(x) - 700 * j), 4000)) for j in range(takes)]
    rows.append((99, rows[-1][1]))
    df = spark.createDataFrame([(k, d, "x") for k, d in rows], SCHEMA)
    s = audio.Settings()
    fps = {k: audio.fingerprint(d, s).tobytes() for k, d in rows}
    want = {k: sum(f != g and audio.linked_in_order(f, g, s) is not None for g in set(fps.values())) for k, f in fps.items()}
    assert sum(want.values()) > 2 * (len(rows) - 5)
    assert {r["recording_id"]: r["n_links"] for r in audio.align_recordings(df).collect()} == want
    for s in (audio.Settings(pairwise=1, block=3), audio.Settings(pairwise=4, block=100), audio.Settings(pairwise=1, block_items=1000)):
        assert {r["recording_id"]: r["n_links"] for r in audio.align_recordings(df, s).collect()} == want


def test_takes_off_the_grid(spark):
    rng, rows = np.random.default_rng(5), []
    starts = [1, 16, 31, 32, 33, 64, 96, 128, 256, 300, 511, 8192 + 32, 8192 + 64 + 32, 8192 + 128, 8192 + 256, 9001]
    for k, start in enumerate(starts):
        x = audio.melody(list(rng.normal(0, 0.125, 64)))
        rows += [(2 * k, audio.wav(x, 4000)), (2 * k + 1, audio.wav(0.5 * x[start:] + rng.normal(0, 40, len(x) - start), 4000))]
    df = spark.createDataFrame([(k, d, "x") for k, d in rows], SCHEMA)
    got = {r["recording_id"]: r["component_id"] for r in audio.align_recordings(df).collect()}
    assert got == {k: k - k % 2 for k, _ in rows}


def test_query_plants_takes_off_the_grid(spark):
    df = spark.createDataFrame([(k, [0.1 * (i % 5) - 0.2 for i in range(64)]) for k in range(0, 200, 20)], "vec_id long, embedding array<double>")
    sizes = {r["recording_id"]: len(audio.samples(r["audio"])[0]) for r in audio.recordings_of(df).collect()}
    assert sum((sizes[2 * k] - sizes[2 * k + 1]) % audio.Settings().hop != 0 for k in range(0, 200, 20)) >= 8


def test_empty(spark):
    assert audio.align_recordings(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_finds_second_takes(spark):
    rows = audio.op5_chroma(spark, "/root/testdata/sf0.001").collect()
    by = {r["recording_id"]: r for r in rows}
    n = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    takes = [k for k in by if k % 2]
    assert len(rows) == n + len(takes) and takes
    assert all(by[k]["component_id"] == k - 1 for k in takes)
    assert all(by[k]["component_id"] == k for k in by if k % 2 == 0)
