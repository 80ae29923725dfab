"""Operator 11: evenness, gapless slots, copies kept together, and splitters against a sorted list."""

import collections
import zlib

import pytest
from pyspark.sql import functions as F

from roadloom.llm import queries as q
from roadloom.llm.shards import keyed, shard, splitters, write_shards

SF = "/root/testdata/sf0.001"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, size string")


def hot(n=3000):
    """A third of the rows share one text, another third one doc_id and text."""
    return [(i, "copy " * 20, "x", "y") if i % 3 == 0 else (7, "same row", "x", "y") if i % 3 == 1 else (i, f"text {i} " * (i % 40), "x", "y") for i in range(n)]


def checked(rows, got, shards):
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in got) == sorted((d if d is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    slots = collections.defaultdict(list)
    for r in got:
        assert 0 <= r.shard < shards and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return slots


@pytest.mark.parametrize("tolerance", [0.002, 0.2])
def test_bytes(spark, tolerance):
    rows = hot()
    got = shard(docs_of(spark, rows).repartition(7), 16, tolerance=tolerance).collect()
    checked(rows, got, 16)
    mass = collections.Counter()
    for r in got:
        mass[r.shard] += r.size
    even, largest = sum(mass.values()) / 16, max(r.size for r in got)
    assert max(abs(mass[s] - even) for s in range(16)) <= 2 * max(tolerance * even, largest)


@pytest.mark.parametrize("n", [3000, 5, 0])
def test_rows_are_at_most_one_apart(spark, n):
    rows = hot(n)
    slots = checked(rows, shard(docs_of(spark, rows), 16, law="rows").collect(), 16)
    counts = [len(slots[s]) for s in range(16)]
    assert max(counts) - min(counts) <= 1


def test_splitters_against_sorted_keys(spark):
    keys = keyed(docs_of(spark, hot(2000)), ["doc_id"])
    rows = sorted((r.k0__, r.k1__, r.k2__, r.size) for r in keys.collect())
    total, tolerance = sum(r[3] for r in rows), 0.002
    for i, cut in enumerate(splitters(keys, F.col("size"), 16, tolerance), 1):
        below, goal = sum(r[3] for r in rows if r[:3] < cut), total * i // 16
        sums = [0]
        for r in rows:
            sums.append(sums[-1] + r[3])
        assert abs(below - goal) <= max(tolerance * total / 16, min(abs(s - goal) for s in sums))


def test_copies_stay_together_within_the_tolerance(spark):
    rows = [(i, f"text {i % 500}", "x", "y") for i in range(4000)]
    got = shard(docs_of(spark, rows), 4, tolerance=0.02).collect()
    where = collections.defaultdict(set)
    for r in got:
        where[r.text].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_awkward_rows_and_reruns(spark):
    rows = [(None, None, "x", "y"), (1, "", "x", "y"), (1, "", "x", "y"), (2, "é漢", "x", "y"), (3, "z" * 300_000, "x", "y"), (None, None, "x", "y")]
    a = shard(docs_of(spark, rows), 3)
    assert a.columns == ["doc_id", "text", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    checked(rows, a.collect(), 3)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, two = ({r.doc_id: (r.shard, r.slot) for r in shard(d, 16, columns=["doc_id"]).collect()} for d in (docs, docs.repartition(9)))
    assert one == two


def test_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    write_shards(docs, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert {*back.columns} >= {*docs.columns, "slot"} and back.select(docs.columns).exceptAll(docs).isEmpty() and back.count() == docs.count()


def test_query(spark):
    got = q.op11_sharding(spark, SF)
    assert got.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    checked(rows, got.collect(), 16)
    assert {r.law for r in got.collect()} == {"bytes"}
