"""Operator 4: every document's class and links, and ranges of doc_id that stay even."""

import collections

import pytest
from pyspark.sql import functions as F

from roadloom.llm.spotsigs import add_signatures, near_members, ranges, with_next

WORDS = "the quick fox of old towns and a bright lamp for every narrow road in winter with long shadows by the quiet river".split()


def test_members(spark):
    base = " ".join(WORDS * 3 + [f"the k{i} m{i}" for i in range(40)])
    texts = ["the only copy of something", "the only copy of something", base, base, base + " the one more", "nothing alike", base, None, ""]
    df = spark.createDataFrame([*[(i, t) for i, t in enumerate(texts)], (None, base)], "doc_id long, text string")
    sigs = {r.doc_id: frozenset(r.sigs) for r in add_signatures(df.where("doc_id is not null"), F.coalesce("text", F.lit("")), "sigs").collect()}
    alike = {d: [e for e in sigs if e != d and len(sigs[d] & sigs[e]) / len(sigs[d] | sigs[e]) >= 0.8] for d in sigs}
    got = {r.doc_id: r for r in near_members(df).collect()}
    assert set(got) == set(sigs) and alike[4] == [2, 3, 6]
    for d, r in got.items():
        same = [e for e in sigs if sigs[e] == sigs[d]]
        assert (r.class_id, r.copies, r.n_links, r.component_id) == (min(same), len(same), len(alike[d]), min([d, *alike[d]]))


@pytest.mark.parametrize("ids", [[*range(5000), 10**15], [(i % 5 << 40) + i // 5 for i in range(5000)], [7] * 3 + list(range(2000)), [-5, 2**62, 2**62 + 1]])
def test_even_ranges(spark, ids):
    df = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    n = collections.Counter(r[0] for r in df.select(ranges(df)).collect())
    assert max(n.values()) <= max(520, len(ids) / 8)
    order = sorted(ids)
    want = collections.Counter((a, f"text {b}") for a, b in zip(order, [*order[1:], order[0]]))
    assert collections.Counter((r.doc_id, r.next_text) for r in with_next(df).collect()) == want
