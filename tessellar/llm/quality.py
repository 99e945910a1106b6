"""Quality classifier by compression with two dictionaries.

One zstandard dictionary is made of good labelled text and one of bad labelled text. A text is cut into blocks of fixed size,
so that the dictionaries count throughout a long text, and every block is compressed with both. The difference of the two
sums of compressed sizes, divided by their sum, is put through a rising curve fitted to labelled texts that are in neither
dictionary (isotonic regression). Short texts say little: their log odds are drawn towards those of the labels at large.

The dictionaries and the curve are fitted on a bounded sample of labelled rows: of each class the `texts` with the smallest hashes
of their ids. A sampled text gives each dictionary of its class an equal share of bytes, in pieces from evenly spaced places of
the whole text. The curve takes the whole sampled texts: they fall into `folds`, and each fold is measured with dictionaries
made of the others, so that the few labels of a small table serve both ends. Pieces and differences are worked out where the
texts are; the driver gets `dictionary_bytes` of pieces a class and a number a text, never texts. Every row is scored on its
whole text. Null and empty texts get the share of good labels. Labels that are null are left out, and repeated labels count once.
Without labels of both classes every score is the share of good labels (0.5 if there are none). Repeated rows give equal rows; an
empty table gives an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table, written


@dataclass(frozen=True)
class Settings:
    texts: int = 2400  # of each class
    folds: int = 4
    dictionary_bytes: int = 256 << 10
    piece: int = 128  # bytes that a text gives at one place
    block: int = 128
    level: int = 5
    threshold: float = 0.7
    little: float = 60.0  # bytes at which a text counts half


@dataclass
class Model:
    good: bytes
    bad: bytes
    at: np.ndarray  # differences, rising
    odds: np.ndarray  # log odds of a good label there
    prior: float
    settings: Settings

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.at):
            return np.full(len(texts), 1 / (1 + np.exp(-self.prior)))
        n = np.array([len(t.encode()) if t else 0 for t in texts], float)
        weight = n / (n + self.settings.little)
        odds = np.interp([difference(t, self) for t in texts], self.at, self.odds)
        return 1 / (1 + np.exp(-(weight * odds + (1 - weight) * self.prior)))


_compressors: dict[tuple[bytes, int], object] = {}


def compressor(dictionary: bytes, level: int) -> object:
    import zstandard as z

    if (dictionary, level) not in _compressors:
        if len(_compressors) >= 16:
            _compressors.clear()
        held = z.ZstdCompressionDict(dictionary, dict_type=z.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=level)
        _compressors[dictionary, level] = z.ZstdCompressor(dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)
    return _compressors[dictionary, level]


def difference(text: str | None, model: Model) -> float:
    """(size with the bad dictionary - size with the good one) / their sum."""
    raw = (text or "").encode()
    if not raw:
        return 0.0
    good, bad = (compressor(d, model.settings.level) for d in (model.good, model.bad))
    step = model.settings.block
    g = b = 0
    for at in range(0, len(raw), step):
        part = raw[at : at + step]
        g += len(good.compress(part))
        b += len(bad.compress(part))
    return (b - g) / (b + g)


def pieces(text: str, share: int, size: int) -> bytes:
    """About `share` bytes of a text, in pieces of `size` from evenly spaced places between its start and its end; all of a shorter one."""
    raw = text.encode()
    if len(raw) <= share:
        return raw
    n = max(1, share // size)
    each = share // n
    return b"".join(raw[at : at + each] for at in ((len(raw) - each) * k // max(1, n - 1) if n > 1 else (len(raw) - each) // 2 for k in range(n)))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising means of y over x with weights w, by pooling adjacent violators: places and means."""
    pools: list[list[float]] = []
    for k in np.argsort(x, kind="stable"):
        pools.append([y[k] * w[k], w[k], x[k] * w[k]])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    a = np.array(pools)
    return a[:, 2] / a[:, 1], a[:, 0] / a[:, 1]


def sample(docs: DataFrame, labels: DataFrame, settings: Settings, id_col: str, text_col: str) -> tuple[DataFrame, dict[int, int]]:
    """The sampled rows with their texts (id, y, text, fold), written, and the number of labels of each class."""
    marked = labels.where(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("y")).distinct()
    counts = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    order = F.xxhash64("id")
    chosen = [marked.where(F.col("y") == y).orderBy(order, "id").limit(settings.texts) for y in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(chosen), "id")  # 2 * texts rows at most
    rows = rows.dropDuplicates(["id", "y"]).withColumn("fold", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(settings.folds)).cast("int"))
    return written(rows.select("id", "y", "text", "fold"), "quality-sample"), counts


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """labels: id_col and quality (0 or 1), of the rows that may be learned from."""
    s = settings or Settings()
    rows, counts = sample(docs, labels, s, id_col, text_col)
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    prior = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    none = np.zeros(0)
    each = {y: max(64, s.dictionary_bytes // max(1, min(s.texts, counts.get(y, 0)))) for y in (0, 1)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column(1)
            raw = [pieces(t, each[k], s.piece) for t, k in zip(b.column(2).to_pylist(), y.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([y, b.column(3), pa.array(raw, pa.binary())], ["y", "fold", "raw"])

    got = rows.mapInArrow(cut, "y int, fold int, raw binary").collect()  # dictionary_bytes a class, or 64 bytes a text
    got = sorted((r["y"], r["fold"], bytes(r["raw"])) for r in got)
    if len({y for y, _, _ in got}) < 2:
        return Model(b"", b"", none, none, prior, s)

    def made(without: int) -> Model:
        return Model(*(b"\n".join(raw for v, fold, raw in got if v == y and fold != without)[-s.dictionary_bytes :] for y in (1, 0)), none, none, prior, s)

    models = [made(k) for k in range(s.folds)]
    # a fold that holds all texts of a class leaves no dictionary of it
    whole = made(-1)
    models = [m if m.good and m.bad else whole for m in models]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = [difference(t, models[k]) for t, k in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(d, pa.float64())], ["y", "d"])

    held = sorted((r["d"], r["y"]) for r in rows.mapInArrow(measured, "y int, d double").collect())  # a number a text
    x, y = np.array([h[0] for h in held]), np.array([h[1] for h in held], float)
    weights = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))  # the sample's classes are balanced, the labels' may not be
    whole.at, p = isotonic(x, y, weights)
    whole.odds = np.log(np.clip(p, 0.002, 0.998) / (1 - np.clip(p, 0.002, 0.998)))
    return whole


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score, 0 to 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(1).to_pylist()), pa.float64())], [id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted; learns from the labels whose crc32 fold (of 4) is not 2. Rows without an id are never learned from: held out."""
    settings = settings or Settings()
    model = fit(docs, labels.where(crc_mod("doc_id", 4) != 2), settings)
    return score(docs, model).select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(True)).alias("held_out"), "score", (F.col("score") >= settings.threshold).cast("int").alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
