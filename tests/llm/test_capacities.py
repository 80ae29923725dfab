"""Operator 7 under binding capacities of each kind, operator 10 on vectors of any length."""

import collections

import pytest

from roadloom.llm.packing import pack
from roadloom.llm.vectors import near_vectors

TEXTS = [" ".join(f"w{i}" for i in range(n)) for n in (1, 2, 3, 5, 8, 13, 21, 34, 55, 3, 3, 2, 1, 40)] + [None, ""]


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize(("docs_", "cost"), [(2, None), (None, 9000.0), (3, 6000.0)])
def test_every_capacity_holds(spark, rule, docs_, cost):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = pack(df, capacity=128, max_docs=docs_, max_cost=cost, rule=rule).collect() if cost is None or cost >= 128**2 else None
    if got is None:  # pieces are cut to what fits a bin alone
        got = pack(df, capacity=64, max_docs=docs_, max_cost=cost, rule=rule).collect()
    most = 128 if cost is None or cost >= 128**2 else 64
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    full = 0
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= most and len(parts) <= (docs_ or most) and sum(n * n for _, n in parts) <= (cost or most**2)
        full += len(parts) == docs_ or cost is not None and at < most
    assert full and len({r.doc_id for r in got}) == len(TEXTS)


def test_huge_and_tiny_vectors(spark):
    rows = [(1, [1e200, 1e200]), (2, [2e200, 2.1e200]), (3, [1e-200, 1.02e-200]), (4, [1e308, -1e308]), (5, [0.0, 0.0]), (6, [float("inf"), 1.0]), (7, [5e-324, 5e-324]), (8, None), (9, [None, 1.0]), (10, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df, 0.95).collect()}
    assert got == {**{v: (3, 1, v == 1) for v in (1, 2, 3, 7)}, **{v: (0, v, True) for v in (4, 5, 6, 8, 9, 10)}}
