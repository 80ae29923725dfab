"""Operator 6: the text alone decides, bit by bit, and a plain version of the network agrees."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.llm.language import CONTEXT, SEGMENT, predict, train

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return train(spark.read.parquet(f"{SF}/documents.parquet"), rows=60, steps=60)


def encoded(texts):
    parts = [t.encode() for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def texts_of(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect() if r.text]
    return [t[i : i + n] for t in texts[:60] for i, n in ((0, 1), (0, 6), (5, 11), (20, 40), (3, 239), (0, 241), (0, 700))] + texts[:5]


def test_sums_alone_beside_others_and_shuffled(spark, model):
    texts = texts_of(spark)
    alone = np.array([model.sums(*encoded([t]))[0] for t in texts])
    assert (model.sums(*encoded(texts)) == alone).all()
    order = np.random.default_rng(1).permutation(len(texts))
    assert (model.sums(*encoded([texts[i] for i in order])) == alone[order]).all()


def test_labels_and_scores_by_partitions(spark, model):
    docs = spark.createDataFrame(list(enumerate([*texts_of(spark), None, "", "123"])), "doc_id long, text string")
    got = [{r.doc_id: (r.lang_pred, r.score) for r in predict(d, model).collect()} for d in (docs.coalesce(1), docs.repartition(7), docs.orderBy(F.rand(3)).coalesce(2))]
    assert got[0] == got[1] == got[2]


def test_sums_against_a_plain_version(spark, model):
    """Byte by byte, one text at a time, in double precision."""
    p = {n: v.astype(float) for n, v in model.p.items()}
    half, h = lambda a: 1 / (1 + np.exp(-a)), model.h

    def states(part, d):
        s, out = np.zeros(h), []
        for b in part:
            a, g = p[f"x{d}"][:, b] + p[f"c{d}"][:, 0], p[f"u{d}"] @ s
            z, r = half(a[:h] + g[:h]), half(a[h : 2 * h] + g[h : 2 * h])
            n = np.tanh(a[2 * h :] + r * g[2 * h :])
            s = n + z * (s - n)
            out.append(s)
        return out

    for text in texts_of(spark)[:40]:
        data, total = text.encode(), np.zeros(len(model.classes))
        for at in range(0, len(data), SEGMENT):
            first = max(0, at - CONTEXT)
            part = data[first : at + SEGMENT + CONTEXT]
            both = [np.concatenate(x) for x in zip(states(part, "f"), states(part[::-1], "b")[::-1])]
            for x in both[at - first : at - first + SEGMENT]:
                e = np.exp(p["o"] @ x + p["ob"][:, 0])
                total += e / e.sum()
        assert np.allclose(model.sums(*encoded([text]))[0], total, rtol=1e-3, atol=1e-3)
