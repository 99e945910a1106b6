"""Best-fit packing of documents into sequences, by patterns fitted with non-negative least squares.

Every document becomes tokens and an end id; only longer ones than a sequence are cut, into full pieces after a first, shorter
one. The histogram of piece lengths (one count for each possible length, whatever the corpus) goes to the driver. There,
patterns of up to three lengths that fill a sequence exactly are enumerated, repeat counts are fitted to the histogram by
non-negative least squares and rounded, and what remains is packed best fit, longest first. The result is a table of slots,
bounded by the number of patterns. Executors number the pieces of each length (in salted groups, so that one common length
is no bottleneck) and look their slots up.

Null texts count as empty: they give the end id alone. Texts of any length are encoded whole. Repeated rows are packed once
for each row; ties in the numbering are ordered by id, piece and checksum. An empty table gives an empty result. Columns
other than the id and the text are ignored.
"""

from __future__ import annotations

import bisect
import json
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe_trie import byte_alphabet
from .common import still, table, written

CAPACITY, END_ID, KEPT = 1024, 2, 400_000


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


class ByteBPE:
    """Token ids of whole texts as little-endian u32, by a byte-level vocabulary whose ids are its merge order.

    A chunk between two single spaces that neither starts nor ends with white space gives the same tokens wherever it stands,
    so its ids are kept; texts with other white space at chunk borders are encoded at once.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_alphabet())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        # the pattern of byte-level pre-tokenizers
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.model = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)
        self.memo: dict[str, bytes | None] = {}

    def whole(self, text: str) -> bytes:
        return packed(self.model.encode(text, allowed_special="all"))

    def ids(self, text: str) -> bytes:
        if any(t in text for t in self.special):
            return self.whole(text)
        head, *rest = text.split(" ")
        memo = self.memo
        if head[-1:].isspace():
            return self.whole(text)
        try:
            body = b"".join([memo[c] for c in rest])
        except (KeyError, TypeError):
            if len(memo) > KEPT:
                memo.clear()
            encode = self.model.encode_ordinary
            for c in rest:
                if c not in memo:
                    memo[c] = packed(encode(" " + c)) if c and not c[0].isspace() and not c[-1].isspace() else None
            try:
                body = b"".join([memo[c] for c in rest])
            except TypeError:
                return self.whole(text)
        return self.whole(head) + body if head else body


_models: dict[str, ByteBPE] = {}


def model(path: str | None) -> ByteBPE:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _models:
        _models[path] = ByteBPE(path)
    return _models[path]


def tokenize_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer_path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row a piece: id, piece, start, length, ids_crc32 (and ids, if keep_ids)."""
    end = packed([end_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = model(tokenizer_path)
        for b in still(batches):
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                owner, rows, ids = [], [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    raw = enc.ids(t or "") + end
                    n = len(raw) // 4
                    cut = (n - 1) % capacity + 1
                    for k, (lo, hi) in enumerate(zip([0, *range(cut, n, capacity)], [*range(cut, n, capacity), n], strict=True)):
                        own = raw[4 * lo : 4 * hi]
                        owner.append(i)
                        rows.append((k, lo, hi - lo, zlib.crc32(own)))
                        if keep_ids:
                            ids.append(np.frombuffer(own, "<u4").astype(np.int32))
                a = np.array(rows, np.int64).reshape(-1, 4)
                cols = [part.column(0).take(pa.array(owner, pa.int64())), pa.array(a[:, 0].astype(np.int32)), *(pa.array(a[:, k]) for k in (1, 2, 3))]
                if keep_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, [id_col, "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def patterns_of(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All multisets of up to three of the lengths that add up to capacity; unused places are 0."""
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    out = [[(capacity, 0, 0)]] if have[capacity] else []
    for a in np.flatnonzero(have[: capacity // 2 + 1]):
        if have[capacity - a]:
            out.append([(capacity - a, a, 0)])
    for a in np.flatnonzero(have[: capacity // 3 + 1]):  # a <= b <= c
        b = np.arange(a, (capacity - a) // 2 + 1)
        b = b[have[b] & have[capacity - a - b]]
        if len(b):
            out.append(np.stack([capacity - a - b, b, np.full(len(b), a)], 1))
    return np.concatenate([np.asarray(x, np.int64) for x in out]) if out else np.zeros((0, 3), np.int64)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squares of what the patterns leave of the histogram, by accelerated projected gradients."""
    if not len(patterns):
        return np.zeros(0)
    n = len(histogram)
    used = (patterns > 0).astype(float)
    target = histogram.astype(float)
    target[0] = 0
    forward = lambda x: np.bincount(patterns.ravel(), (x[:, None] * used).ravel(), n)
    back = lambda r: (r[patterns] * used).sum(1)
    v = np.ones(len(patterns))
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = back(forward(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        z = np.maximum(y - back(forward(y) - target) / (1.02 * top), 0)
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = z + (t - 1) / t_next * (z - x)
        x, t = z, t_next
    return x


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of sequences that hold exactly the pieces of the histogram (counts by length, 0 to capacity)."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...], times: int) -> None:
        out.append((lengths, times))
        for n in lengths:
            left[n] -= times

    if left[capacity]:
        take((capacity,), int(left[capacity]))
    patterns = patterns_of(np.flatnonzero(left), capacity)
    fitted = fit_counts(patterns, left)
    for p in np.argsort(-fitted, kind="stable"):
        want = int(np.rint(fitted[p]))
        if want < 1:
            break
        own = tuple(int(n) for n in patterns[p] if n)
        times = min(want, min(int(left[n]) // own.count(n) for n in own))
        if times > 0:
            take(own, times)
    some = sorted(int(n) for n in np.flatnonzero(left))
    while some:  # best fit, longest first; an exact pair is preferred to the longest that fits
        own, space = [some[-1]], capacity - some[-1]
        free = lambda n, own=own: int(left[n]) > own.count(n)
        while space:
            k = bisect.bisect_right(some, space) - 1
            while k >= 0 and not free(some[k]):
                k -= 1
            if k < 0:
                break
            pick = some[k]
            if pick < space:
                lo, hi = 0, k
                while lo < hi:
                    s = some[lo] + some[hi]
                    if s == space and free(some[lo]) and free(some[hi]):
                        pick = some[hi]
                        break
                    lo, hi = (lo + 1, hi) if s < space else (lo, hi - 1)
            own.append(pick)
            space -= pick
        times = min(int(left[n]) // own.count(n) for n in own)
        take(tuple(own), times)
        some = [n for n in some if left[n]] if any(not left[n] for n in own) else some
    return out


def slots(planned: list[tuple[tuple[int, ...], int]], capacity: int) -> tuple[np.ndarray, ...]:
    """Sorted keys length * 2^44 + first number, and for each the number, sequence and offset where its run of slots begins."""
    rows, filled, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for lengths, times in planned:
        at = 0
        for n in lengths:
            rows.append((n << 44 | int(filled[n]), int(filled[n]), sequence, at))
            filled[n] += times
            at += n
        sequence += times
    a = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return tuple(a[:, k].copy() for k in range(4))


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY, rows_a_salt: int = 200_000) -> DataFrame:
    """pieces (a table that is cheap to read twice, with length from 1 to capacity) with sequence_id and offset; order: the columns that tell pieces apart."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most capacity rows
        counts[r["length"]] = r["count"]
    keys, first, sequence, at = slots(plan(counts, capacity), capacity)
    salts = int(max(64, -(-counts.sum() // rows_a_salt)))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    before = salted.groupBy("length", "_salt").count().withColumn("_before", F.sum("count").over(W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)))
    before = before.select("length", "_salt", F.coalesce("_before", F.lit(0)).alias("_before"))
    ranked = salted.withColumn("_rank", F.row_number().over(W.partitionBy("length", "_salt").orderBy(*order))).join(before, ["length", "_salt"])
    ranked = ranked.select(*pieces.columns, (F.col("_rank") - 1 + F.col("_before")).alias("_number"))
    spot = len(pieces.columns)
    place = pieces.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = b.column(place).to_numpy(zero_copy_only=False), b.column(spot).to_numpy(zero_copy_only=False)
            k = np.searchsorted(keys, length << 44 | number, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:spot], pa.array(sequence[k] + number - first[k]), pa.array(at[k])], [*b.schema.names[:spot], "sequence_id", "offset"])

    schema = ranked.drop("_number").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer_path: str | None = None, keep_ids: bool = False) -> DataFrame:
    pieces = written(tokenize_pieces(docs, id_col, text_col, capacity, end_id, tokenizer_path, keep_ids), "pieces")
    return pack(pieces, [id_col, "piece", "ids_crc32"], capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its token ids, of what pack_documents(keep_ids=True) returned; a sequence holds at most capacity ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
