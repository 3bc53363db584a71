import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from helpers import frame, text_of, vocabulary

from seqledger.llm.quality_net import BUCKETS, DIM, Network, index_vectors, pooled, score, word_vectors


def rows(n=400):
    rng = random.Random(9)
    vocab = vocabulary(80)
    return [(i, " ".join(w + ("###" if i % 3 == 0 and rng.random() < 0.4 else "") for w in text_of(rng, vocab, rng.randint(5, 40)).split())) for i in range(n)]


def test_word_vectors_sum_the_neighbours(spark):
    texts = ["a b c", "b a", "", None]
    vectors = word_vectors(frame(spark, list(enumerate(texts))))
    dims, signs = index_vectors()
    index = np.zeros((BUCKETS, DIM))
    for j in range(dims.shape[1]):
        np.add.at(index, (np.arange(BUCKETS), dims[:, j]), signs[:, j])
    from seqledger.llm.quality_net import _tokens

    context, times = np.zeros((BUCKETS, DIM)), np.zeros(BUCKETS)
    for t in texts:
        b, _ = _tokens(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len(t or "")]))
        for i, x in enumerate(b):
            times[x] += 1
            for j, y in enumerate(b):
                if 0 < abs(i - j) <= 2:
                    context[x] += index[y]
    context -= np.outer(times, context.sum(axis=0) / times.sum())
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    assert np.allclose(vectors[:, :DIM], context, atol=1e-5)
    x = pooled(vectors, pa.array(["b a", None]))
    assert np.allclose(x[0, :-1], vectors[[*_tokens(np.frombuffer(b"b a", np.uint8), np.array([0, 3]))[0]]].mean(axis=0), atol=1e-5)
    assert not x[1].any()


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = (rng.random(3000) < 1 / (1 + np.exp(-2 * x[:, 0] * x[:, 1]))).astype(float)
    net = Network(x[:2000], y[:2000], np.arange(2000) % 5 == 0)
    p = net.scores(x[2000:])
    assert abs(p.mean() - y[2000:].mean()) < 0.05
    for low, high in ((0, 0.3), (0.3, 0.7), (0.7, 1.01)):
        at = (p >= low) & (p < high)
        assert abs(p[at].mean() - y[2000:][at].mean()) < 0.12


def test_held_out_documents_get_the_right_label(spark):
    data = rows()
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in data] + [(None, 1), (2, None)], "doc_id long, quality int")
    extra = [(None, "a b"), (1000, None), (1001, ""), (4, data[4][1]), (1002, "w " * 60_000)]
    out = score(frame(spark, data + extra), labels).collect()
    assert len(out) == len(data) + len(extra)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)
    held = [r for r in out if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in [*range(400), 1000, 1001, 1002] if zlib.crc32(str(i).encode()) % 4 == 2}
    mine = [r for r in held if r["doc_id"] < 400]
    assert sum((r["score"] >= 0.5) == (r["doc_id"] % 3 > 0) for r in mine) > 0.9 * len(mine)


def test_labels_of_one_kind_and_none(spark):
    docs = frame(spark, rows(20))
    one = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    assert {r["score"] for r in score(docs, one).collect()} == {1.0}
    assert {r["score"] for r in score(docs, one.limit(0)).collect()} == {0.5}
    assert score(frame(spark, []), one).collect() == []


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no test tables here")
def test_accuracy_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs, labels).filter("held_out").join(labels, "doc_id").selectExpr("avg(cast(predicted = quality as int))").first()[0]
    assert out > 0.95
