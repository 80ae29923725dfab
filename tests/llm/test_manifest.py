"""Operator 12 against a plain recursive version, over one and several superblocks."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from roadloom.llm.manifest import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, leaf int, root string, pos int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, low=False):
    text = r[1] if not low or r[1] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
    show = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(*map(show, (r[0], r[3], r[2], r[4], text)))


def grow(nodes):
    """Levels from the nodes to the top."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def way(levels, at):
    out = []
    for level in levels[:-1]:
        out.append((at % 16, level[at - at % 16 : at - at % 16 + 16]))
        at //= 16
    return out


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    keys = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in keys:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: grow([leaf(r) for r in by[s]]) for s in keys}
    top = grow([trees[s][-1][0] for s in keys])
    root, out = top[-1][0] if keys else None, []
    for j, s in enumerate(keys):
        for i, r in enumerate(by[s]):
            path = way(trees[s], i) + way(top, j)
            node = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0)
            for at, run in path:
                node = h(*run[:at], node, *run[at + 1 :])
            out.append((r[0], leaf(r), trees[s][-1][0], root, h(*(x for at, run in path for x in run[:at] + run[at + 1 :])), node, node == root))
    return sorted(out, key=str)


def of(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1, "clash", 2) for r in rows], SCHEMA).repartition(5)
    return sorted(map(tuple, manifest(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).collect()), key=str)


AWKWARD = [(None, None, None, None, None), (None, "A", "en", "s", 1), (3, "", "en", "", 0), (-1, "é漢 ABC", "de", "ß", 9), (3, "X" * 200_000, None, "s", 5), (9, None, "en", "s", None)]


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 256, 300])
def test_sizes(spark, n):
    rows = [(i * 3, f"Text {i}", "en", None if i % 5 == 0 else f"src{i % 3}", i) for i in range(n)]
    assert of(spark, rows) == plain(rows)


def test_awkward_and_repeated_rows(spark):
    rows = AWKWARD + [(i // 4, "Same", "en", "s", 4) for i in range(90)] + [(None, "B", "en", "s", 1)] * 3
    assert of(spark, rows) == plain(rows)


def test_several_superblocks_and_many_sources(spark):
    rows = [(i, f"T{i}", "en", "hot", 2) for i in range(4096 * 2 + 1)] + [(i, "x", "en", f"one{i}", 1) for i in range(40)]
    got = of(spark, rows)
    assert got == plain(rows) and 0 < sum(not r[6] for r in got) < len(got)


def test_untampered_all_verify(spark):
    df = spark.createDataFrame([(*r, "a", 1, "b", 2) for r in AWKWARD], SCHEMA)
    assert all(r.verified and r.folded_root == r.root for r in manifest(df).collect())
