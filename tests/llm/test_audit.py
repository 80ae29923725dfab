"""Operator 13 against filters applied in each order to lists of rows."""

import collections
import itertools
import re

import numpy as np

from roadloom.llm.audit import filter_audit, walk

DOCS = "doc_id long, text string, lang string, part string, mask int, rows long, bits int, quality int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def fails(rows):
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    out = []
    for i, text, lang in rows:
        s, w = text or "", WORDS.findall(text or "")
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", s)) > 3 * len(s), "D": any(c in s for c in "#$%&*|"), "E": i is not None and i > first[s]}
        out.append((lang or "", i, {k for k, v in bad.items() if v}))
    return out


def plain(rows, labels):
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    out, shapley = [], collections.Counter()
    marked = fails(rows)
    for part in {m[0] for m in marked}:
        own = [m for m in marked if m[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[2]]
                before = sum(f in m[2] for m in own) - len(gone)
                left = [m for m in left if f not in m[2]]
                shapley[part, f] += len(gone)
                out.append((part, "".join(order), step, len(left), len(gone), before, sum(m[2] == {f} for m in own), sum(m[1] in good for m in gone), sum(m[1] in toxic for m in gone)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def of(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "clash", 1, 1, 1, 1) for r in rows], DOCS).repartition(5)
    marks = spark.createDataFrame([(*x, "clash") for x in labels], "doc_id long, quality int, toxic int, text string")
    return sorted(map(tuple, filter_audit(docs, marks).collect()))


PLAIN = " ".join(f"w{i}" for i in range(220))


def test_orders(spark):
    kinds = [PLAIN, PLAIN + " #", PLAIN.upper(), "a " * 300, "few words", "Few $ Words", "", None, "x " * 40_000, "é漢 " * 210, "\t\x0b\x0c\r\n \x1c\x85 "]
    rows = [(i, kinds[i * 7 % 11] if i % 3 else PLAIN, ["en", "de", None, ""][i % 4]) for i in range(120)]
    rows += [(None, PLAIN, "en"), (5, "few words", "en"), (5, "few words", "en"), (5, "few words", "fr")]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 120, 2)] + [(4, 1, 1), (5, None, 1), (None, 1, 1), (7, None, None)]
    assert of(spark, rows, labels) == plain(rows, labels)


def test_empty_tables(spark):
    assert of(spark, [], [(1, 1, 1)]) == []
    assert of(spark, [(1, "x", "en")], []) == plain([(1, "x", "en")], [])


def test_walk_equals_a_count_of_every_subset():
    r = np.random.default_rng(0)
    masks, counts = r.permutation(32)[:20], r.integers(0, 99, (20, 3))
    got = walk(masks, counts, 5)
    for s in range(32):
        assert (got[s] == counts[masks & s == 0].sum(0)).all()
