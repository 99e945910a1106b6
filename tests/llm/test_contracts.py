"""Queries against brute force on whole small tables."""

import base64
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessellar.llm import bpe_trie, near, packing, topk, warc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def whole(name):
    t = Tokenizer.from_file(str(public_tokenizers.path(name)))
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe(spark, texts):
    t = whole("word_bpe_49k.json")
    rows = bpe_trie.op8_bpe_trie(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = t.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_packing(spark, texts):
    t = whole("byte_bpe_50k.json")
    ids = {k: [*t.encode(v, add_special_tokens=False).ids, 2] for k, v in texts.items()}
    rows = packing.op4_packing(spark, SF).collect()
    by, filled = {}, {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
        assert r["start"] == by.get(r["doc_id"], 0) and (r["length"] == 1024 or r["piece"] == 0)
        by[r["doc_id"]] = r["start"] + r["length"]
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert by == {k: len(v) for k, v in ids.items()}
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(filled) <= 1.02 * -(-sum(map(len, ids.values())) // 1024) + 1


def test_warc(spark):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    first = {}
    for k, v in pages.items():
        first[v] = max(k, first.get(v, k))
    rows = warc.op9_warc(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        v = pages[r["page_id"]]
        whole_one = first[v] == r["page_id"]
        assert r["payload_bytes"] == len(v) and r["payload_digest"] == base64.b32encode(hashlib.sha1(v).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if whole_one else ("revisit", first[v]))


def test_near(spark, texts):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
        return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()

    sets = {k: shingles(v) for k, v in texts.items()}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near.op10_near_dedup(spark, SF).collect()}
    assert got == {k: (len(s), find(k), find(k) == k) for k, s in sets.items()}


def test_top_k(spark):
    rows = {r["vec_id"]: np.floor(np.array(r["embedding"], float) * 1024).astype(int) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    want = []
    for q in (k for k in rows if k % 100 == 0):
        best = sorted((-int(v @ rows[q]), k) for k, v in rows.items() if k != q)[:10]
        want += [(q, i + 1, k, -s) for i, (s, k) in enumerate(best)]
    got = topk.op2_kdtree_topk(spark, SF).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want)
