"""Recall of operator 10 on planted pairs near its threshold, with many more cells than probes."""

import numpy as np
import pyarrow as pa
import pytest

from roadloom.llm.vectors import PROBES, SAMPLE_ROWS, fit_cells, recall


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def noisy(x, cosine, r):
    """Rows at that cosine from the rows of the unit vectors x, in a random direction."""
    n = r.normal(size=x.shape)
    n = unit(n - (n * x).sum(1, keepdims=True) * x)
    cosine = np.asarray(cosine).reshape(-1, 1)
    return cosine * x + np.sqrt(1 - cosine**2) * n


@pytest.mark.parametrize("sample_rows", [SAMPLE_ROWS, 600])
def test_recall_of_planted_pairs(spark, sample_rows):
    r = np.random.default_rng(5)
    base = unit(r.normal(size=(6000, 32)))
    made = np.stack([base, noisy(base, r.uniform(0.951, 0.96, 6000), r)], axis=1).reshape(-1, 32)
    assert len(made) // 256 >= 10 * PROBES  # cells
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(range(len(made))), "embedding": pa.array(list(made))})).repartition(4)
    found, there = recall(df, sample_rows=sample_rows)
    assert there >= 240 and 0.9 * there <= found <= there
    one, _ = recall(df, sample_rows=sample_rows, probes=1)
    assert one < found  # the cells do part pairs, so the figure above is one of an index


def test_probes_at_hundreds_of_cells():
    r = np.random.default_rng(6)
    base = unit(r.normal(size=(20000, 64)))
    centres = fit_cells(base[:4096], 1024)
    assert len(centres) == 1024
    a, b = (np.argpartition(-(x @ centres.T), PROBES - 1, axis=1)[:, :PROBES] for x in (base[-4000:], noisy(base[-4000:], 0.951, r)))
    assert (a[:, :, None] == b[:, None, :]).any((1, 2)).mean() >= 0.95
