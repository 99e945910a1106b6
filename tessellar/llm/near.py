"""Near-duplicate documents by MinHash with sequential Bayesian verification.

Texts become sets of word shingles (64-bit hashes), sets become signatures of bands x rows minima. Texts with equal sets form
a class, named by a 128-bit digest, and one text stands for it, so copies cost nothing further. Classes that share a band
are candidates. Of a bucket, first every member is held against the smallest one (its hub); then only members that are still
in different components are held against each other, large buckets in blocks. A candidate pair's signatures are
compared batch by batch, and it is dropped once the posterior probability that its similarity reaches the threshold (uniform
prior) falls below `miss`; survivors are confirmed on the full shingle sets. A pair at the threshold itself shares no band
with probability (1 - threshold^rows)^bands, 3e-6 at the default; pairs of equal sets are never missed.

Links are joined to components by minimum labels with pointer jumping, on written tables; nothing but counts goes to the
driver. Classes get numbers (as their table is written, by its partitions) that pairs and labels carry; they are never keyed by the
rows' ids, so rows that share an id but not a text are linked by their own texts. A hub, a label or a class may hold much of the
table; no grouping follows a join on one of them in the same stage, so adaptive execution splits such joins. The texts of classes
that share a band are fetched once.

Texts that are null or without words have an empty set and are linked with nothing, not even each other. Each row of
the input gives a row; repeated rows fall into one class. A component's id is its smallest id that is not null, null if there
is none. An empty table gives an empty result. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty, written

STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5
    batch: int = 16  # signature places compared at a time
    miss: float = 1e-6  # a pair goes once its posterior of reaching the threshold is below this
    pairwise: int = 24  # largest bucket whose open pairs are written as rows; larger ones are compared in blocks
    block: int = 512


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles: A-Z lower-cased, words between ASCII white space; with fewer words than size, of the whole sequence."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    words = np.array([h(w) for w in (text or "").encode().lower().split()], np.uint64)
    n = len(words)
    if not n:
        return words
    k = min(size, n)
    s = words[: n - k + 1].copy()
    for j in range(1, k):
        s = mix(s) + words[j : n - k + 1 + j]
    return np.unique(mix(s + np.uint64(k)))


def factors(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_229)
    a, b = (rng.integers(0, 1 << 63, s.bands * s.rows, np.uint64) << np.uint64(1) for _ in range(2))
    return a | np.uint64(1), b


def signatures(sets: list[np.ndarray], s: Settings) -> np.ndarray:
    """(sets, bands * rows) minima, uint32; sets that are empty get the largest value."""
    a, b = factors(s)
    out = np.full((len(sets), len(a)), 0xFFFFFFFF, np.uint32)
    at = 0
    full = [i for i, x in enumerate(sets) if len(x)]
    while at < len(full):
        own, size = [], 0
        while at < len(full) and (not own or size + len(sets[full[at]]) <= 1 << 15):
            own.append(full[at])
            size += len(sets[full[at]])
            at += 1
        x = np.concatenate([sets[i] for i in own])
        starts = np.cumsum([0, *(len(sets[i]) for i in own[:-1])])
        for k in range(len(a)):
            out[own, k] = np.minimum.reduceat((x * a[k] + b[k]) >> np.uint64(32), starts)
    return out


def band_keys(sig: np.ndarray, s: Settings) -> np.ndarray:
    """(n, bands) keys of 64 bits that hold the band's number too."""
    v = sig.astype(np.uint64).reshape(len(sig), s.bands, s.rows)
    key = np.broadcast_to(np.arange(s.bands, dtype=np.uint64) * STEP, v.shape[:2])
    for r in range(s.rows):
        key = mix(key + v[:, :, r])
    return key.view(np.int64)


def least_matches(s: Settings) -> list[tuple[int, int]]:
    """After n places: the fewest equal ones with a posterior P(similarity >= threshold) = P(Binomial(n + 1, threshold) <= equal) of at least `miss`."""
    t, out = s.percent / 100, []
    total = s.bands * s.rows
    for n in [*range(s.batch, total, s.batch), total]:
        p, m = 0.0, -1
        while p < s.miss:
            m += 1
            p += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def surviving(u: np.ndarray, v: np.ndarray, s: Settings) -> np.ndarray:
    """Which pairs of signature rows are still open after all batches."""
    alive, equal, last = np.arange(len(u)), np.zeros(len(u), np.int64), 0
    for n, least in least_matches(s):
        equal = equal + (u[alive, last:n] == v[alive, last:n]).sum(1)
        keep = equal >= least
        alive, equal, last = alive[keep], equal[keep], n
    return alive


def sign(docs: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """id, version (hash of the text), n, cls (digest of the set), sig (both binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sets = [shingles(t, s.shingle) for t in part.column(2).to_pylist()]
                sig = signatures(sets, s)
                digest = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array([r.tobytes() for r in sig], pa.binary())], ["id", "version", "n", "cls", "sig"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("version"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, version long, n long, cls binary, sig binary")


def unpack(column: pa.Array, s: Settings) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, s.bands * s.rows)


def banded(reps: DataFrame, s: Settings) -> DataFrame:
    """A row for each class and band: key, k, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                keys = band_keys(unpack(part.column(2), s), s)
                owner = pa.array(np.repeat(np.arange(len(keys)), s.bands))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), part.column(0).take(owner), part.column(1).take(owner)], ["key", "k", "n"])

    return reps.select("k", "n", "sig").mapInArrow(run, "key long, k long, n long")


def fits(x: str, y: str, s: Settings) -> F.Column:
    """Whether sets of these sizes may be similar enough."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * s.percent


def open_pairs(pairs: DataFrame, reps: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) that neither their sizes nor the sequential test drop; a may hold many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4000):
                part = b.slice(at, 4000)
                alive = pa.array(surviving(unpack(part.column(2), s), unpack(part.column(3), s), s))
                yield pa.RecordBatch.from_arrays([part.column(0).take(alive), part.column(1).take(alive)], ["a", "b"])

    own = lambda c: reps.select(F.col("k").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))
    both = pairs.join(own("b"), "b").join(own("a"), "a").where(fits("n_a", "n_b", s))
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def texts_of(classes: DataFrame, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k and the text that stands for it, written; classes: k, distinct."""
    wanted = reps.select("k", "id", "version").join(classes, "k", "left_semi")
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_or_empty(text_col)).alias("_version"), F.col(text_col).alias("text"))
    met = rows.join(wanted, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_version") == F.col("version")))
    return written(met.select("k", "text"), "near-texts")


def confirmed(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """The pairs (distinct) whose full sets reach the threshold; a text may come twice, where rows repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = None, None  # a hub's pairs mostly come one after the other
        for b in batches:
            keep = []
            for i, (x, ta, tb) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                if known != x:
                    known, own = x, shingles(ta, s.shingle)
                other = shingles(tb, s.shingle)
                common = len(np.intersect1d(own, other, assume_unique=True))
                if common and 100 * common >= s.percent * (len(own) + len(other) - common):
                    keep.append(i)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows)], ["a", "b"])

    text = lambda c: texts.select(F.col("k").alias(c), F.col("text").alias(f"text_{c}"))
    both = pairs.join(text("b"), "b").join(text("a"), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of every id in the edges (a, b)."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        met = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("met"))
        beyond = labels.select(F.col("id").alias("met"), F.col("component").alias("beyond"))
        step = written(met.join(beyond, "met").select("id", "old", F.least("met", "beyond").alias("component")), "labels")
        if step.where("component < old").isEmpty():
            return labels
        labels = step.drop("old")


def block_links(members: DataFrame, reps: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """Links (confirmed on full sets) that join the components of large buckets' members, block against block; members: key, k, n, component, size.

    A pair is looked at in the first band that it shares. A block leaves out pairs that links found in it have joined, so it
    returns fewer rows than it has members.
    """
    import pandas as pd

    wanted = members.select("k").distinct()
    own_rows = reps.select("k", "sig").join(wanted, "k", "left_semi").join(texts.dropDuplicates(["k"]), "k")
    own_rows = written(own_rows, "block-texts")
    blocks = F.ceil(F.col("size") / s.block).cast("int")
    own = F.pmod(F.xxhash64("k"), blocks).cast("int")
    rows = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "k", "n", "component").join(own_rows, "k")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi, key = pdf["lo"].iat[0], pdf["hi"].iat[0], pdf["key"].iat[0]
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(len(pdf), -1)
        keys = band_keys(sig, s)
        ids, n, block, texts = pdf["k"].to_numpy(), pdf["n"].to_numpy(), pdf["own"].to_numpy(), pdf["text"].tolist()
        root, sets, out = pd.factorize(pdf["component"])[0], {}, []  # root: of each row, the group that links found here have made
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)

        def own_set(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingles(texts[i], s.shingle)
            return sets[i]

        for i in left:
            j = right[(root[right] != root[i]) & (100 * np.minimum(n[right], n[i]) >= s.percent * np.maximum(n[right], n[i]))]
            if lo == hi:
                j = j[ids[j] > ids[i]]
            if len(j):
                j = j[surviving(np.broadcast_to(sig[i], (len(j), sig.shape[1])), sig[j], s)]
            if len(j):
                same = keys[j] == keys[i]
                j = j[keys[i][same.argmax(1)] == key]
            for x in j:
                if root[x] != root[i]:
                    a, b = own_set(i), own_set(x)
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    if common and 100 * common >= s.percent * (len(a) + len(b) - common):
                        out.append((min(ids[i], ids[x]), max(ids[i], ids[x])))
                        root[root == root[x]] = root[i]
        return pd.DataFrame(out, columns=["a", "b"])

    return rows.groupBy("key", "lo", "hi").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of docs: id, n_shingles, component_id (smallest id reachable by links), kept (the row has that id; of a component without ids, every row), version (hash of the text) and first.

    first: no row of the component comes before it, by id (nulls last), then by version; it holds for one row of each component, and its repetitions.
    """
    s = settings or Settings()
    rows = written(sign(docs, s, id_col, text_col), "signed")
    name = lambda i, v: F.struct(i.isNull().alias("none"), i.alias("id"), v.alias("version"))
    # equal sets have equal n and sig
    full = rows.where("n > 0").groupBy("cls").agg(F.min(name(F.col("id"), F.col("version"))).alias("least"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    reps = written(full.select(F.monotonically_increasing_id().alias("k"), "cls", "least.id", "least.version", "least", "copies", "n", "sig"), "classes")
    bands = banded(reps, s)
    shared = written(bands.groupBy("key").agg(F.min("k").alias("hub"), F.count("*").alias("size")).where("size > 1"), "buckets")
    members = written(bands.join(shared, "key"), "members")
    texts = texts_of(members.select("k").distinct(), reps, docs, id_col, text_col)
    pairs = members.where("k != hub").select(F.col("hub").alias("a"), F.col("k").alias("b")).distinct()
    links = written(confirmed(open_pairs(pairs, reps, s), texts, s).distinct(), "links")
    labels = components(links)
    # members but the hub, in buckets where they lie in several components
    rest = members.where("k != hub and size > 2").join(labels.withColumnRenamed("id", "k"), "k", "left").select("key", "k", "n", F.coalesce("component", "k").alias("component"))
    mixed = rest.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low < high").select("key", "size")
    rest = written(rest.join(written(mixed, "mixed"), "key"), "open-members")
    if not rest.isEmpty():
        small = rest.where(F.col("size") <= s.pairwise)
        x, y = (small.select("key", F.col("k").alias(c), F.col("n").alias(f"s_{c}"), F.col("component").alias(f"c_{c}")) for c in "ab")
        few = x.join(y, "key").where((F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b")) & fits("s_a", "s_b", s)).select("a", "b").distinct()
        some = confirmed(open_pairs(few, reps, s), texts, s)
        late = written(some.union(block_links(rest.where(F.col("size") > s.pairwise), reps, texts, s)).distinct(), "links")
        if not late.isEmpty():
            labels = components(links.union(late))
    # classes in a component of their own, without copies, need no name
    linked = reps.select("k", "cls", "least", "copies").join(labels.withColumnRenamed("id", "k"), "k", "left").where("copies > 1 or component is not null")
    linked = written(linked.select("cls", "least", F.coalesce("component", "k").alias("component")), "linked")
    firsts = linked.groupBy("component").agg(F.min("least").alias("first"))
    names = written(linked.select("cls", "component").join(firsts, "component").select("cls", "first"), "class-names")
    out = rows.select("id", "version", "n", "cls").join(names, "cls", "left")
    own = name(F.col("id"), F.col("version"))
    first = F.when((F.col("n") > 0) & F.col("first").isNotNull(), F.col("first")).otherwise(own)
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        first["id"].alias("component_id"),
        first["id"].eqNullSafe(F.col("id")).alias("kept"),
        "version",
        (first == own).alias("first"),
    )


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Settings(shingle=4)).drop("version", "first")


#: All pairs that share a shingle, and their closure: for small tables.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END)) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
m AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM m JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 80 * (p.n + q.n - common)),
c AS (SELECT a, b FROM l UNION SELECT c.a, l.b FROM c JOIN l ON l.a = c.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(g.least_id, d.doc_id)) AS component_id, least(d.doc_id, coalesce(g.least_id, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS least_id FROM c GROUP BY a) g USING (doc_id)
"""
