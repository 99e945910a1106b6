"""Language identification by a convolutional network over bytes.

A text's UTF-8 bytes are cut into windows of fixed length, the last one padded with zeros. Bytes have learned embeddings;
filters of several widths slide over them, a rectifier and max pooling over the window follow, and a linear layer with
softmax gives the languages. A text's log odds are the means over all its windows. Training is plain numpy (Adam) on the
driver, on a bounded sample of windows: of each language about `texts` whole texts, chosen by the hash of their ids, are cut into
windows, and about `windows` of these are chosen by the hash of id and place, wherever in a text they stand. Prediction covers
whole texts. There, embeddings and filters are folded into one table for each filter position, so a convolution is a sum of table rows.

Texts that are null or have no letter get `und` and score 0. Texts with a null language are not learned from. With no
language to learn every text gets `und` and score 0. Repeated rows give equal rows; an empty table gives an empty result;
columns other than those named are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table, written

LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Settings:
    texts: int = 400  # of each language, about
    windows: int = 3200  # of each language, about
    window: int = 128
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 12
    embedding: int = 8
    epochs: int = 5
    batch: int = 64
    rate: float = 0.01


def windows(raw: bytes, size: int) -> np.ndarray:
    n = max(1, -(-len(raw) // size))
    return np.frombuffer(raw.ljust(n * size, b"\0"), np.uint8).reshape(n, size)


@dataclass
class Network:
    languages: list[str]
    settings: Settings
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    tables: list[list[np.ndarray]] = field(default_factory=list)

    def start(self, seed: int = 7) -> None:
        rng, s = np.random.default_rng(seed), self.settings
        normal = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
        self.weights = {"e": normal(256, s.embedding) * 0.5, "u": normal(len(s.widths) * s.filters, len(self.languages)) * 0.1, "c": np.zeros(len(self.languages), np.float32)}
        for w in s.widths:
            self.weights[f"k{w}"] = normal(w * s.embedding, s.filters) * (2 / (w * s.embedding)) ** 0.5
            self.weights[f"b{w}"] = np.zeros(s.filters, np.float32)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over windows x (n, window) with languages y."""
        s, p = self.settings, self.weights
        n, size = x.shape
        emb = p["e"][x]
        pooled, back = [], []
        for w in s.widths:
            cols = np.concatenate([emb[:, j : size - w + 1 + j] for j in range(w)], 2)  # (n, places, w * embedding)
            conv = cols @ p[f"k{w}"] + p[f"b{w}"]
            at = conv.argmax(1)
            top = np.take_along_axis(conv, at[:, None], 1)[:, 0]
            pooled.append(np.maximum(top, 0))
            back.append((cols, at, top > 0))
        h = np.concatenate(pooled, 1)
        z = h @ p["u"] + p["c"]
        q = np.exp(z - z.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        q[np.arange(n), y] -= 1
        q /= n
        g = {"u": h.T @ q, "c": q.sum(0), "e": np.zeros_like(p["e"])}
        dh = q @ p["u"].T
        rows = np.arange(n)[:, None]
        for k, w in enumerate(s.widths):
            cols, at, on = back[k]
            d = dh[:, k * s.filters : (k + 1) * s.filters] * on  # (n, filters)
            chosen = cols[rows, at]  # (n, filters, w * embedding)
            g[f"k{w}"] = np.einsum("nf,nfd->df", d, chosen)
            g[f"b{w}"] = d.sum(0)
            de = d[:, :, None] * p[f"k{w}"].T[None]  # (n, filters, w * embedding)
            for j in range(w):
                np.add.at(g["e"], x[rows, at + j], de[:, :, j * s.embedding : (j + 1) * s.embedding])
        return g

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> None:
        self.start(seed)
        rng, s = np.random.default_rng(seed + 1), self.settings
        m = {k: np.zeros_like(v) for k, v in self.weights.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.weights.items()}
        t = 0
        steps = s.epochs * -(-len(x) // s.batch)
        for _ in range(s.epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), s.batch):
                pick = order[at : at + s.batch]
                t += 1
                rate = s.rate * (1 - (t - 1) / steps)
                for k, g in self.gradients(x[pick], y[pick]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.999 * v2[k] + 0.001 * g * g
                    self.weights[k] = (self.weights[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        self.fold()

    def fold(self) -> None:
        """Embeddings times filters: what each byte adds at each filter position."""
        d = self.settings.embedding
        self.tables = [[np.ascontiguousarray(self.weights["e"] @ self.weights[f"k{w}"][j * d : (j + 1) * d]) for j in range(w)] for w in self.settings.widths]

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Log odds (up to a constant) of each window, in blocks that fit a cache."""
        out = []
        size = x.shape[1]
        for at in range(0, len(x), 64):
            part = x[at : at + 64]
            pooled = []
            for w, tables in zip(self.settings.widths, self.tables, strict=True):
                conv = tables[0].take(part[:, : size - w + 1], 0)
                for j in range(1, w):
                    conv += tables[j].take(part[:, j : size - w + 1 + j], 0)
                pooled.append(conv.max(1) + self.weights[f"b{w}"])
            out.append(np.maximum(np.concatenate(pooled, 1), 0) @ self.weights["u"] + self.weights["c"])
        return np.concatenate(out)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        todo = [i for i, t in enumerate(texts) if t and self.languages and has_letter(t)]
        at = 0
        while at < len(todo):  # some 4 MB of windows at a time
            cut, own, size = [], [], 0
            while at < len(todo) and (not cut or size < 4 << 20):
                cut.append(windows(texts[todo[at]].encode(), self.settings.window))
                own.append(todo[at])
                size += cut[-1].size
                at += 1
            starts = np.cumsum([0, *(len(c) for c in cut)])
            z = np.add.reduceat(self.logits(np.concatenate(cut)), starts[:-1], 0) / np.diff(starts)[:, None]
            q = np.exp(z - z.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            for i, k, row in zip(own, q.argmax(1), q, strict=True):
                names[i], scores[i] = self.languages[k], float(row[k])
        return names, scores


def has_letter(text: str) -> bool:
    m = LETTER.search(text)
    return m is not None and (m.group().isalpha() or any(map(str.isalpha, text)))


def fit(docs: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network:
    """docs: the rows that may be learned from. The driver gets a row and a literal for each distinct language, and the windows."""
    s = settings or Settings()
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Network([], s)
    spread = 1 << 30
    wanted = F.create_map(*(F.lit(x) for l, n in counts.items() for x in (l, min(spread, spread * s.texts // n))))
    rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(spread)) < wanted[F.col("lang")]).dropDuplicates(["id", "lang"])
    rows = written(rows.select("lang", F.xxhash64("id").alias("h"), "text"), "langid-sample")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.ceil(F.octet_length("text") / s.window)).alias("n")).collect()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for l, h, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if has_letter(t):
                    w = windows(t.encode(), s.window)
                    x = (np.arange(len(w), dtype=np.uint64) + np.uint64(h % (1 << 64))) * np.uint64(0x9E3779B97F4A7C15)
                    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                    w = w[(x >> np.uint64(32)).astype(float) < 2.0**32 * s.windows / sizes[l]]
                    yield pa.RecordBatch.from_arrays([pa.array([l] * len(w), pa.string()), pa.array([r.tobytes() for r in w], pa.binary())], ["lang", "bytes"])

    got = sorted((r["lang"], bytes(r["bytes"])) for r in rows.mapInArrow(cut, "lang string, bytes binary").collect())
    net = Network(sorted({l for l, _ in got}), s)
    if got:
        net.train(np.frombuffer(b"".join(w for _, w in got), np.uint8).reshape(len(got), s.window), np.array([net.languages.index(l) for l, _ in got]))
    return net


def identify(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = net.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without an id are never learned from: held out."""
    docs = table(spark, sf_dir, "documents")
    net = fit(docs.where(crc_mod("doc_id", 5) != 0))
    return identify(docs, net).select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(True)).alias("held_out"), "lang_pred", "score")
