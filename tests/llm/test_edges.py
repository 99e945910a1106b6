"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for the operators whose queries are tested elsewhere."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tessellar.llm import bpe_trie, langid, near, packing, quality, topk, warc

LONG = "alpha beta gamma delta epsilon zeta eta theta " * 20_000
ROWS = [(1, LONG), (1, LONG), (1, "other words stand here now"), (2, None), (None, None), (None, "a b"), (3, ""), (4, " \n\t "), (5, "é" * 5000), (6, LONG)]
CLASH = ["n", "id", "cls", "label", "score", "component", "sequence_id", "piece", "size", "key", "hub"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASH}).cache()


def ids(rows, name="doc_id"):
    return sorted((r[name] is None, r[name] or 0) for r in rows)


WANT = sorted((k is None, k or 0) for k, _ in ROWS)


def test_bpe(docs):
    rows = bpe_trie.encode_digest(docs).collect()
    assert ids(rows) == WANT
    assert all(r["n_tokens"] == 0 and r["ids_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows if r["doc_id"] in (2, 3, 4))
    assert len({r["ids_sha256"] for r in rows if r["n_tokens"] > 10_000}) == 1
    assert bpe_trie.encode_digest(docs.limit(0)).count() == 0


def test_packing(docs):
    rows = packing.pack_documents(docs).collect()
    firsts = [r for r in rows if r["piece"] == 0]
    assert ids(firsts) == WANT and {r["length"] for r in firsts if r["doc_id"] in (2, 3)} == {1}
    filled = {}
    for r in rows:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_quality(spark, docs):
    marks = spark.createDataFrame([(1, 1), (1, 1), (5, 0), (6, None), (None, 1)], "doc_id long, quality int")
    for labels in (marks, marks.limit(0)):
        rows = quality.classify(docs, labels).collect()
        assert ids(rows) == WANT and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.classify(docs.limit(0), marks).count() == 0


def test_language(docs):
    known = docs.withColumn("lang", F.when(F.col("doc_id") == 1, "en").when(F.col("doc_id") == 5, "fr"))
    for net in (langid.fit(known), langid.fit(known.limit(0))):
        rows = langid.identify(known, net).collect()
        assert ids(rows) == WANT and all(0 <= r["score"] <= 1 for r in rows)
        assert all((r["lang_pred"], r["score"]) == ("und", 0) for r in rows if r["doc_id"] in (2, 3, 4))
        assert langid.identify(known.limit(0), net).count() == 0


def test_near(docs):
    rows = near.near_duplicates(docs).collect()
    assert ids(rows) == WANT
    got = {(r["doc_id"], r["n_shingles"] > 5): r["component_id"] for r in rows}
    assert got[(1, True)] == got[(6, True)] == 1 and got[(2, False)] == 2 and got[(3, False)] == 3
    assert near.near_duplicates(docs.limit(0)).count() == 0


def test_near_shared_ids(spark):
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(0, text), (1, text[:-8]), (1, "quite another text stands here now and then"), (None, text), (None, "alone among these rows it stands")]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {(r["doc_id"], r["n_shingles"] > 10): (r["component_id"], r["kept"], r["first"]) for r in got}
    assert by == {(0, True): (0, True, True), (1, True): (0, False, False), (1, False): (1, True, True), (None, True): (0, False, False), (None, False): (None, True, True)}


def test_warc(spark, tmp_path, docs):
    pages = docs.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").withColumn("url", F.when(F.col("page_id") != 3, "http://a/b c"))
    for k, (frame, n) in enumerate(((pages, len(ROWS)), (pages.limit(0), 0))):
        path = f"file://{tmp_path}/warc{k}"
        warc.write_archives(frame, path)
        rows = warc.resolve(warc.read_archives(spark, path)).collect()
        assert len(rows) == n
        if n:
            assert ids(rows, "id") == WANT
            by = {(r["id"], r["payload_bytes"]): (r["record_type"], r["refers_to"]) for r in rows}
            size = len(LONG.encode())
            assert by[(6, size)] == ("response", None) and by[(1, size)] == ("revisit", 6)
            assert by[(3, 0)] == ("response", None) and by[(2, 0)] == ("revisit", 3)


def test_top_k(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, None]), (4, None), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [1.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("rank", "score", "query_id", "shard", "id", "v")})
    got = topk.top_k(df, F.col("vec_id") % 100 == 0).select("query_id", "rank", "vec_id", "score").collect()
    one = 1024 * 1024
    assert sorted(map(tuple, got)) == [(0, 1, 8, 2 * one), (0, 2, 8, 2 * one), (0, 3, 1, one), (0, 4, 2, one)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert topk.top_k(df.where("vec_id = 0"), F.col("vec_id") % 100 == 0).count() == 0


def test_near_large_buckets(spark):
    """Groups whose members are not all links of the smallest one: blocks and small buckets give the components of all pairs."""
    base = [f"w{i}" for i in range(60)]
    rows, k = [], 0
    for cut in range(0, 30, 3):
        for j in range(6):
            k += 1
            rows.append((k, " ".join(base[:cut] + [f"x{cut}a{i}" for i in range(cut // 2)] + base[cut : 58 - j])))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = [{r["doc_id"]: r["component_id"] for r in near.near_duplicates(frame, near.Settings(shingle=2, pairwise=p, block=8)).collect()} for p in (2, 1000)]
    sets = {k: set(near.shingles(t, 2).tolist()) for k, t in rows}
    root = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert 1 < len(set(root.values())) < len(root)
    assert got[0] == got[1] == root
