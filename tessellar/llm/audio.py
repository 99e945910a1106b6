"""Chroma audio fingerprints: recordings become packed integers, and those that align are grouped.

A recording (WAV, 16-bit PCM; channels are averaged) is cut into overlapping windows; the energy of each window's spectrum is
folded onto twelve pitch classes and brought to unit length. On the integral image of these frames, filters of several shapes
compare areas of pitch and time; each filter's logarithmic ratio becomes two Gray-coded bits, sixteen filters one 32-bit item.

Two recordings are linked if, at the peak of the histogram of offsets between equal items (ties: nearest to 0, then the smaller),
at least `share` of the landmark words of the one that has more of them meet, and the mean bit error of the overlap is at most
`bit_error`. A word is two items `gap` frames apart (of recordings with `gap` items or fewer, one item): single items agree by
chance too often. Of the distinct words only landmarks count, those whose hash is 0 modulo `thin` (at least the word of smallest
hash): the same sound has the same landmarks wherever a take starts. Only the first item of a run of equal ones votes, so silence does not drown the histogram. Candidates come from
a prefix filter: words are ordered by their number of recordings over the whole table, rarest first, and of n distinct words two
recordings that meet the share have one of their first n - ceil(share * n) + 1 in common. So a word that very many recordings
hold is hardly ever looked up. Every two members of a bucket are compared, once however many buckets they share: those of small
buckets as rows; members of large ones lie in blocks, and blocks that meet in a word are held against each other. Recordings with
equal fingerprints form a class and are compared once.

Audio that is null, not 16-bit PCM WAV, or too short for an item has n_items 0 and is linked with nothing. Each row of the input
gives a row; rows that share an id but not a fingerprint are grouped by their own fingerprints; null ids are kept, and a
group's component_id is its smallest id that is not null. An empty table gives an empty result. Columns other than the id and
the audio are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .near import components

#: (shape, first pitch class, pitch classes, frames) of each filter.
FILTERS = [(k % 4, (5 * k) % 12, 4 + 2 * (k % 5), 16 * (1 + k % 4)) for k in range(16)]
GRAY = np.array([0, 1, 3, 2], np.uint32)


@dataclass(frozen=True)
class Settings:
    window: int = 1024
    hop: int = 128  # a take may start anywhere: at half a hop off the grid, the worst place, 0.11 of the landmarks and more still meet on 120 melodies, and none of unrelated ones
    low_hz: float = 55.0
    high_hz: float = 1760.0
    step: float = 0.25  # a filter's outer thresholds: -step and step
    gap: int = 32
    thin: int = 3  # one word of so many is a landmark
    share: float = 0.05
    bit_error: float = 0.2
    pairwise: int = 24  # largest bucket whose pairs are written as rows; larger ones are compared in blocks
    block: int = 128  # recordings that are compared with as many others in one task
    block_items: int = 1 << 21  # and their items, but for one recording that has more


def samples(data: bytes | None) -> tuple[np.ndarray, int] | None:
    """The mean of the channels and the rate, or None where it is not 16-bit PCM WAV."""
    try:
        with wave.open(io.BytesIO(data or b"")) as w:
            if w.getsampwidth() != 2 or not w.getframerate() or not w.getnchannels():
                return None
            n, rate = w.getnchannels(), w.getframerate()
            x = np.frombuffer(w.readframes(w.getnframes()), "<i2")
    except (wave.Error, EOFError, ValueError):
        return None
    x = x[: len(x) // n * n]
    return (x.reshape(-1, n).mean(1, dtype=np.float32) if n > 1 else x.astype(np.float32)), rate


def chroma(x: np.ndarray, rate: int, s: Settings) -> np.ndarray:
    """(frames, 12) energies of pitch classes, each frame of unit length; silent frames are zero."""
    if len(x) < s.window:
        return np.zeros((0, 12))
    hz = np.fft.rfftfreq(s.window, 1 / rate)
    low, high = np.searchsorted(hz, s.low_hz), np.searchsorted(hz, s.high_hz, "right")
    if low >= high:
        return np.zeros((0, 12))
    pitch = np.rint(12 * np.log2(hz[low:high] / 440)).astype(int)
    starts = np.flatnonzero(np.r_[True, np.diff(pitch) > 0])  # runs of bins of one semitone
    classes = pitch[starts] % 12
    cut = np.lib.stride_tricks.sliding_window_view(x, s.window)[:: s.hop]
    taper, out = np.hanning(s.window).astype(np.float32), []
    for at in range(0, len(cut), 2048):  # bounds memory on long recordings
        f = np.fft.rfft(cut[at : at + 2048] * taper)[:, low:high]
        tones = np.add.reduceat(f.real**2 + f.imag**2, starts, axis=1)
        c = np.zeros((len(tones), 12), np.float32)
        for k in range(12):
            c[:, k] = tones[:, classes == k].sum(1)
        size = np.linalg.norm(c, axis=1, keepdims=True)
        out.append(np.divide(c, size, out=np.zeros_like(c), where=size > 1e-3))
    return np.concatenate(out).astype(float)


def items(frames: np.ndarray, s: Settings) -> np.ndarray:
    """The packed integers, one for each frame that the longest filter can start at."""
    longest = max(w for *_, w in FILTERS)
    n = len(frames) - longest + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    # pitch classes go round: two octaves of columns
    image = np.zeros((len(frames) + 1, 25))
    image[1:, 1:] = np.concatenate([frames, frames], 1).cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[at + t1, p1] - image[at + t0, p1] - image[at + t1, p0] + image[at + t0, p0]

    out = np.zeros(n, np.uint32)
    for shape, p, h, w in FILTERS:
        whole = area(0, w, p, p + h)
        if shape == 0:  # lower against higher pitches
            part = area(0, w, p, p + h // 2)
        elif shape == 1:  # earlier against later
            part = area(0, w // 2, p, p + h)
        elif shape == 2:  # opposite quarters
            part = area(0, w // 2, p, p + h // 2) + area(w // 2, w, p + h // 2, p + h)
        else:  # the middle half of the time
            part = area(w // 4, w - w // 4, p, p + h)
        v = np.log((part + 0.01) / (whole - part + 0.01))
        level = (v > -s.step).astype(int) + (v > 0) + (v > s.step)
        out = (out << np.uint32(2)) | GRAY[level]
    return out


def fingerprint(data: bytes | None, s: Settings) -> np.ndarray:
    got = samples(data)
    return items(chroma(*got, s), s) if got else np.zeros(0, np.uint32)


def run_starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, int)


def words(x: np.ndarray, s: Settings) -> np.ndarray:
    x = x.astype(np.uint64)
    return (x[: -s.gap] << np.uint64(32)) | x[s.gap :] if len(x) > s.gap else x << np.uint64(32)


def landmarks(x: np.ndarray, s: Settings) -> np.ndarray:
    """The distinct words that count, sorted."""
    w = np.unique(words(x, s))
    if not len(w):
        return w
    h = (w ^ (w >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) >> np.uint64(16)
    kept = w[h % np.uint64(s.thin) == 0]
    return kept if len(kept) else w[[h.argmin()]]


def align(a: np.ndarray, b: np.ndarray, s: Settings) -> tuple[int, float, float] | None:
    """Offset (place in a less place in b), share and bit error at the histogram's peak, or None where no item is in both."""
    pa_, pb = run_starts(a), run_starts(b)
    votes = np.zeros(len(a) + len(b), np.int64)
    order = np.argsort(b[pb], kind="stable")
    values, places = b[pb][order], pb[order]
    lo, hi = np.searchsorted(values, a[pa_], "left"), np.searchsorted(values, a[pa_], "right")
    for i in np.flatnonzero(hi > lo):
        votes[pa_[i] - places[lo[i] : hi[i]] + len(b)] += 1  # places differ, so no index repeats
    if not votes.any():
        return None
    offset = min((int(k) - len(b) for k in np.flatnonzero(votes == votes.max())), key=lambda k: (abs(k), k))
    x, y = (a[offset:], b) if offset >= 0 else (a, b[-offset:])
    n = min(len(x), len(y))
    error = float(np.bitwise_count(x[:n] ^ y[:n]).mean() / 32)
    u, v = words(a, s), words(b, s)
    x, y = (u[offset:], v) if offset >= 0 else (u, v[-offset:])
    n = min(len(x), len(y))
    u, v = landmarks(a, s), landmarks(b, s)
    met = len(np.intersect1d(x[:n][x[:n] == y[:n]], np.intersect1d(u, v, assume_unique=True)))
    return offset, met / max(len(u), len(v)), error


def linked(a: np.ndarray, b: np.ndarray, s: Settings) -> tuple[int, float, float] | None:
    got = align(a, b, s)
    return got if got and got[1] >= s.share and got[2] <= s.bit_error else None


def fingerprints(recordings: DataFrame, s: Settings, id_col: str, audio_col: str) -> DataFrame:
    """id, n, cls (digest of the fingerprint), fp (little-endian items)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                fps = [fingerprint(x.as_py(), s).astype("<u4").tobytes() for x in part.column(1)]
                names = [hashlib.sha256(f).hexdigest() for f in fps]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(f) // 4 for f in fps], pa.int64()), pa.array(names, pa.string()), pa.array(fps, pa.binary())], ["id", "n", "cls", "fp"])

    kind = recordings.schema[id_col].dataType.simpleString()
    return recordings.select(id_col, audio_col).mapInArrow(run, f"id {kind}, n long, cls string, fp binary")


def word_rows(classes: DataFrame, s: Settings) -> DataFrame:
    """k and word, a row for each landmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                sets = [landmarks(np.frombuffer(f, "<u4"), s).view(np.int64) for f in part.column(1).to_pylist()]
                owner = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(owner), pa.array(np.concatenate(sets))], ["k", "word"])

    return classes.select("k", "fp").mapInArrow(run, "k long, word long")


LINK = "a long, b long, offset long, share double, error double"


def linked_in_order(f: bytes, g: bytes, s: Settings) -> tuple[int, float, float] | None:
    """As linked, whichever of the two comes first: ties of offsets are settled by the order of the digests."""
    f, g = sorted((f, g), key=lambda x: hashlib.sha256(x).digest())
    return linked(np.frombuffer(f, "<u4"), np.frombuffer(g, "<u4"), s)


def confirmed(pairs: DataFrame, classes: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) that are linked, with their alignment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, y, f, g in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if got := linked_in_order(f, g, s):
                    out.append((x, y, *got))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["a", "b", "offset", "share", "error"])

    both = pairs.join(classes.select(F.col("k").alias("a"), F.col("fp").alias("fp_a")), "a").join(classes.select(F.col("k").alias("b"), F.col("fp").alias("fp_b")), "b")
    return both.select("a", "b", "fp_a", "fp_b").mapInArrow(run, LINK)


def in_common(own: list[np.ndarray], other: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each set of own, the number of its elements in each set of other."""
    codes = np.unique(np.concatenate([*own, *other]), return_inverse=True)[1]
    cuts = np.cumsum([len(x) for x in own])
    *mine, rest = np.split(codes, cuts)
    owner, held = np.repeat(np.arange(len(other)), [len(x) for x in other]), np.zeros(len(codes), bool)
    for x in mine:
        held[x] = True
        yield np.bincount(owner[held[rest]], minlength=len(other))
        held[x] = False


def block_links(members: DataFrame, classes: DataFrame, s: Settings) -> DataFrame:
    """a, b and n for each member of a large bucket and block that it has links in: n links, which join it to b.

    members: word, hub, k, size. Each member lies in one block of those that have its home, the smallest hub of its large buckets, so
    that near copies lie together however many words they share. Pairs that share a small bucket are left to its rows.
    """
    import pandas as pd

    large = members.where(F.col("size") > s.pairwise)
    homes = written(large.groupBy("k").agg(F.min("hub").alias("home")).join(classes.select("k", "n"), "k"), "block-homes")
    parts = F.greatest(F.ceil(F.count("*") / s.block), F.ceil(F.sum("n") / s.block_items))
    parts = homes.groupBy("home").agg(parts.alias("parts"))
    block = F.xxhash64("home", F.pmod(F.xxhash64("k"), F.col("parts")))  # blocks whose hashes clash are one
    blocks = written(homes.join(parts, "home").select("k", block.alias("block")), "blocks")
    words_in = written(large.join(blocks, "k").select("word", "block").distinct(), "block-words")
    x, y = (words_in.withColumnRenamed("block", c) for c in ("lo", "hi"))
    meet = written(x.join(y, "word").where("lo <= hi").select("lo", "hi").distinct(), "block-pairs")
    small = members.where(F.col("size") <= s.pairwise).groupBy("k").agg(F.collect_list("word").alias("small"))
    inside = written(blocks.join(classes.select("k", "fp"), "k").join(small, "k", "left"), "block-members")
    sides = meet.withColumn("block", F.explode(F.array_distinct(F.array("lo", "hi")))).withColumn("right", F.col("block") == F.col("hi"))
    rows = sides.withColumn("left", F.col("block") == F.col("lo")).join(inside, "block").select("lo", "hi", "left", "right", "k", "fp", "small")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, fps = pdf["k"].to_numpy(), [bytes(f) for f in pdf["fp"]]
        sets = [landmarks(np.frombuffer(f, "<u4"), s) for f in fps]
        few = [np.zeros(0, np.int64) if x is None else np.asarray(x, np.int64) for x in pdf["small"]]
        left, right = np.flatnonzero(pdf["left"]), np.flatnonzero(pdf["right"])
        same, size = bool(pdf["left"].iat[0] and pdf["right"].iat[0]), np.array([len(x) for x in sets])
        met = in_common([sets[i] for i in left], [sets[j] for j in right])
        apart = in_common([few[i] for i in left], [few[j] for j in right])
        root, n = np.arange(len(names)), np.zeros(len(names), np.int64)  # root: of each row, the group that links found here have made
        for i, m, f in zip(left, met, apart, strict=True):
            fit = (f == 0) & (m >= s.share * np.maximum(size[i], size[right]) - 1e-9)
            for j in right[fit & (names[right] > names[i])] if same else right[fit]:
                if linked_in_order(fps[i], fps[j], s):
                    n[[i, j]] += 1
                    if root[i] != root[j]:
                        root[root == root[j]] = root[i]
        at = np.flatnonzero(n)
        return pd.DataFrame({"a": names[at], "b": names[root[at]], "n": n[at]})

    # little data but long work: adaptive execution would put it into few tasks
    return rows.repartition(max(1, min(meet.count(), 4096)), "lo", "hi").groupBy("lo", "hi").applyInPandas(run, "a long, b long, n long")


def align_recordings(recordings: DataFrame, settings: Settings | None = None, id_col: str = "recording_id", audio_col: str = "audio") -> DataFrame:
    """One row a row of recordings: id_col, n_items, fingerprint_sha256, component_id, kept, n_links (classes that its own is linked with, all of them; copies not counted)."""
    s = settings or Settings()
    if not 0 < s.share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    rows = written(fingerprints(recordings, s, id_col, audio_col), "fingerprints")
    classes = rows.where("n > 0").select("cls", "n", "fp").dropDuplicates(["cls"])
    classes = written(classes.select(F.monotonically_increasing_id().alias("k"), "cls", "n", "fp"), "fingerprint-classes")  # numbers keep the rows of words short
    own = written(word_rows(classes, s), "words")
    common = own.groupBy("word").agg(F.count("*").alias("size"))
    ranked = own.join(common, "word").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("size", "word"))).alias("set"))
    need = F.ceil(F.size("set") * F.lit(s.share) - F.lit(1e-9)).cast("int")
    prefix = ranked.select("k", F.explode(F.slice("set", F.lit(1), F.size("set") - need + 1)).alias("x")).select("k", "x.word")
    prefix = written(prefix, "word-prefixes")
    buckets = prefix.groupBy("word").agg(F.min("k").alias("hub"), F.count("*").alias("size")).where("size > 1")
    members = written(prefix.join(buckets, "word"), "word-buckets")
    few = members.where(F.col("size") <= s.pairwise)
    x, y = (few.select("word", F.col("k").alias(c)) for c in "ab")
    pairs = x.join(y, "word").where("a < b").select("a", "b").distinct()
    links = written(confirmed(pairs, classes, s).select("a", "b"), "audio-links")
    ends = links.select(F.col("a").alias("k"), F.lit(1).alias("n")).union(links.select("b", F.lit(1)))
    if not members.where(F.col("size") > s.pairwise).isEmpty():
        late = written(block_links(members, classes, s), "audio-links")
        links, ends = links.union(late.select("a", "b")), ends.union(late.select("a", "n"))
    labels, ends = components(links), ends.groupBy("k").agg(F.sum("n").alias("n_links"))
    # a class without links is its own component
    names = classes.select("k", "cls").join(labels.withColumnRenamed("id", "k"), "k", "left").join(ends, "k", "left")
    names = written(names.select("cls", F.coalesce("component", "k").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "audio-components")
    smallest = rows.where("n > 0").groupBy("cls").agg(F.min("id").alias("least")).join(names, "cls").groupBy("component").agg(F.min("least").alias("component_id"))
    out = rows.select("id", "n", "cls").join(names.join(smallest, "component"), "cls", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_items"), F.col("cls").alias("fingerprint_sha256"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def wav(x: np.ndarray, rate: int) -> bytes:
    with io.BytesIO() as f:
        with wave.open(f, "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
            w.writeframes(np.clip(np.rint(x), -32768, 32767).astype("<i2").tobytes())
        return f.getvalue()


def melody(vector: list[float | None] | None, rate: int = 4000, note: int = 1024) -> np.ndarray | None:
    """A tone for each component: its pitch, of two octaves, by the component's size; None where a component is null or not finite."""
    if vector is None or any(v is None or not np.isfinite(v) for v in vector):
        return None
    t = np.arange(note) / rate
    pitch = np.clip(np.rint(np.array(vector, float) * 64), -12, 12)
    return (8000 * np.sin(2 * np.pi * (440 * 2 ** (pitch / 12))[:, None] * t)).ravel()


def recordings_of(embeddings: DataFrame) -> DataFrame:
    """recording_id and audio of embeddings, for tables that hold no audio: the vector's melody at 2 * vec_id, and of every twentieth id a
    second take at 2 * vec_id + 1, which begins eight to nine notes later (mostly off the grid of the hop), is quieter and has noise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, audio = [], []
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = melody(v)
                ids.append(None if k is None else 2 * k)
                audio.append(None if x is None else wav(x, 4000))
                if k is not None and k % 20 == 0 and x is not None:
                    ids.append(2 * k + 1)
                    late = x[8 * 1024 + 37 * abs(k) % 1021 :]
                    audio.append(wav(0.5 * late + np.random.default_rng(abs(k)).normal(0, 40, len(late)), 4000))
                if len(ids) >= 64:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(audio, pa.binary())], ["recording_id", "audio"])
                    ids, audio = [], []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(audio, pa.binary())], ["recording_id", "audio"])

    return embeddings.select("vec_id", "embedding").mapInArrow(run, "recording_id long, audio binary")


def op5_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_recordings(recordings_of(table(spark, sf_dir, "embeddings")))
