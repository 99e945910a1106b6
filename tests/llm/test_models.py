"""The two classifiers' arithmetic against plain forms of it, and evidence that stands far inside long texts."""

import numpy as np
import zstandard

from tessellar.llm import langid, quality, topk
from pyspark.sql import functions as F

SMALL = langid.Settings(window=16, widths=(2, 3), filters=3, embedding=4)


def network(seed=3):
    net = langid.Network(["a", "b", "c"], SMALL)
    net.start(seed)
    rng = np.random.default_rng(seed)
    for k, v in net.weights.items():
        net.weights[k] = v + rng.normal(0, 0.1, v.shape).astype(np.float32)
    net.fold()
    return net


def plain_logits(net, x):
    """Embeddings, filters at every place, rectifier, maximum, linear layer."""
    p, s, out = net.weights, net.settings, []
    for row in x:
        pooled = []
        for w in s.widths:
            for f in range(s.filters):
                best = max(sum(float(p["e"][row[i + j]] @ p[f"k{w}"][j * s.embedding : (j + 1) * s.embedding, f]) for j in range(w)) + float(p[f"b{w}"][f]) for i in range(s.window - w + 1))
                pooled.append(max(0.0, best))
        out.append(np.array(pooled) @ p["u"] + p["c"])
    return np.array(out)


def test_convolution_equals_a_plain_one():
    net, x = network(), np.random.default_rng(1).integers(0, 256, (6, 16)).astype(np.uint8)
    assert np.allclose(net.logits(x), plain_logits(net, x), atol=1e-4)


def test_gradients_equal_numeric_ones():
    net = network()
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 256, (5, 16)), rng.integers(0, 3, 5)

    def loss():
        z = plain_logits(net, x)
        z = z - z.max(1, keepdims=True)
        return -np.mean(z[np.arange(5), y] - np.log(np.exp(z).sum(1)))

    got = net.gradients(x, y)
    for k, v in net.weights.items():
        at = [tuple(rng.integers(0, n) for n in v.shape) for _ in range(4)] if k != "e" else [(int(x[0, 3]), 1), (int(x[2, 7]), 2)]
        for i in at:
            v[i] += 1e-5
            up = loss()
            v[i] -= 2e-5
            down = loss()
            v[i] += 1e-5
            assert abs((up - down) / 2e-5 - got[k][i]) < 1e-4, (k, i)


def test_difference_is_that_of_compressed_sizes():
    good, bad = b"the quick brown fox jumps over the lazy dog " * 40, b"WIN $$$ NOW!!! click here >>> " * 40
    s = quality.Settings()
    model = quality.Model(good, bad, np.zeros(0), np.zeros(0), 0.0, s)
    for text in ("the lazy dog jumps over the quick brown fox " * 20, "click here >>> WIN NOW!!!" * 9, "é" * 200, "x"):
        sizes = []
        for d in (good, bad):
            c = zstandard.ZstdCompressor(level=s.level, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            raw = text.encode()
            sizes.append(sum(len(c.compress(raw[k : k + s.block])) for k in range(0, len(raw), s.block)))
        assert abs(quality.difference(text, model) - (sizes[1] - sizes[0]) / sum(sizes)) < 0.02


def test_pieces_come_from_all_of_a_text():
    text = "".join(f"{k:08d}" for k in range(10_000))
    got = quality.pieces(text, 1024, 128)
    assert len(got) == 1024 and got.startswith(b"00000000") and got.endswith(b"00009999")
    assert quality.pieces("short", 1024, 128) == b"short"


def test_evidence_at_the_end_of_long_texts(spark):
    """Training texts of 1 MB that differ in their last tenth alone."""
    rng = np.random.default_rng(4)
    words = [[f"{c}{i}{c}" for i in range(50)] for c in "gb"]
    same = " ".join(rng.choice([f"n{i}" for i in range(900)], 180_000))
    tail = lambda y: " ".join(rng.choice(words[y], 25_000))
    rows = [(k, f"{same} {tail(k % 2)}", "xy"[k % 2]) for k in range(16)]
    rows += [(100 + k, " ".join(rng.choice(words[k % 2], 60)), None) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(16)], "doc_id long, quality int")
    model = quality.fit(docs, labels, quality.Settings(dictionary_bytes=64 << 10))
    score = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert np.mean([score[100 + k] for k in range(0, 20, 2)]) > np.mean([score[100 + k] for k in range(1, 20, 2)]) + 0.2
    net = langid.fit(docs, langid.Settings(texts=16, windows=4000, epochs=2))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, net).collect()}
    assert [got[100 + k] for k in range(20)] == ["x", "y"] * 10


def test_repeated_labels_count_once(spark):
    docs = spark.createDataFrame([(1, "good words here"), (2, "bad words there")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 9 + [(2, 0), (None, 1)], "doc_id long, quality int")
    assert abs(quality.fit(docs, labels).prior) < 1e-9


def test_top_k_of_empty_vectors_and_large_scores(spark):
    df = spark.createDataFrame([(k, []) for k in range(300)], "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") == 7).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(k, 0) for k in range(11) if k != 7]
    big = [(k, [float(2**20 + k), 1.0]) for k in range(60)]
    got = topk.top_k(spark.createDataFrame(big, df.schema), F.col("vec_id") == 0, topk.Settings(k=3, shard_rows=8, leaf=4)).collect()
    want = sorted(((int(a[1][0] * 1024) * 2**30 + 2**20, -a[0]) for a in big[1:]), reverse=True)[:3]
    assert [(r["score"], -r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == want
