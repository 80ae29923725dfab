"""Operator 11: sharding by histogram sort; DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.common import materialize

#: Bits of each of the three parts of a key, and bins into which a round cuts an open bracket.
KEY_BITS, BINS = 60, 4096
#: Rows that one piece of a shard holds on the average, at most, and pieces of a shard at least.
PIECE_ROWS, LEAST_PIECES = 1 << 16, 16
#: Pieces in all up to which their offsets are broadcast (some 30 MB); beyond it they are joined by key.
MOST_BROADCAST = 1_000_000

_PARTS = ("k0__", "k1__", "k2__")


def _hash(*values: Column | str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*values), 64 - KEY_BITS)


def keyed(docs: DataFrame, carried: list[str]) -> DataFrame:
    """row__ (the carried columns), size, text_crc32 and the three parts of each row's key, written once.

    The parts are hashes of the text, of doc_id, and of the row's place, so equal texts are neighbours in key order and
    even rows that repeat in full can be told apart.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return materialize(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row__"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        _hash(text).alias("k0__"), _hash(F.lit(1), "doc_id").alias("k1__"), _hash(F.lit(2), F.monotonically_increasing_id()).alias("k2__"),
    ))


def _inside(bracket: tuple) -> Column:
    """bracket: (fixed values of the parts before, lo, hi) of the part that is searched."""
    fixed, lo, hi = bracket
    return reduce(lambda x, y: x & y, [*(F.col(p) == v for p, v in zip(_PARTS, fixed)), F.col(_PARTS[len(fixed)]).between(lo, hi)])


def _crossings(keys: DataFrame, weight: Column, searches: dict[tuple, list[tuple[int, int]]]) -> list:
    """For each bracket and each (splitter, goal) in it, the bin in which the running sum of weights reaches the goal.

    Every row below a bin's edge is counted, in one partial aggregate of BINS rows a bracket; a row for each goal comes back.
    """
    brackets = list(searches)
    at, bin_ = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, b in enumerate(brackets):
        width = -(-(b[2] - b[1] + 1) // BINS)
        at = F.when(_inside(b), i).otherwise(at)
        bin_ = F.when(F.col("at") == i, F.expr(f"(key - {b[1]}L) div {width}L")).otherwise(bin_)
    key = reduce(lambda other, i: F.when(F.col("at") == i, F.col(_PARTS[len(brackets[i][0])])).otherwise(other), range(len(brackets)), F.lit(None).cast("long"))
    rows = keys.withColumn("at", at).where("at is not null").withColumn("key", key).withColumn("w", weight)
    bins = rows.groupBy("at", bin_.alias("bin")).agg(F.sum("w").alias("w"), F.min("key").alias("least"), F.max("key").alias("most"))
    bins = bins.withColumn("upto", F.sum("w").over(Window.partitionBy("at").orderBy("bin"))).withColumn("before", F.col("upto") - F.col("w"))
    goals = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(s).alias("splitter"), F.lit(g).cast("long").alias("goal")) for i, b in enumerate(brackets) for s, g in searches[b]])
    hit = F.filter(goals, lambda g: (g["at"] == F.col("at")) & (F.col("before") < g["goal"]) & (g["goal"] <= F.col("upto")))
    return bins.select("at", "least", "most", "before", "upto", F.explode(hit).alias("g")).select("at", "least", "most", "before", "upto", "g.splitter", "g.goal").collect()


def splitters(keys: DataFrame, weight: Column, shards: int, tolerance: float) -> list[tuple[int, int, int]]:
    """shards - 1 keys, ascending: rows at or over the i-th belong to shard i or above.

    Round by round the exact weight below the bins' edges of each open bracket is summed over all rows in it. A splitter is
    settled when an edge lies within tolerance times a shard's even share of its goal; else its bracket shrinks to the one
    bin around the goal (to the keys that are there), and from a single text hash to the rows of that text by doc_id, and
    by place. So a boundary falls between texts wherever the tolerance allows it, and cuts a group of equal texts only if
    the group is larger than that. With tolerance 0 and weight 1 the counts of shards are at most one apart.
    The driver holds shards - 1 brackets and gets a row for each in a round; texts and keys stay where they are.
    """
    total = keys.agg(F.sum(weight).alias("w")).first().w or 0
    slack = tolerance * total / shards
    out: dict[int, tuple[int, int, int]] = {}
    searches: dict[tuple, list[tuple[int, int]]] = {}
    for i in range(1, shards):
        if goal := total * i // shards:
            searches.setdefault(((), 0, (1 << KEY_BITS) - 1), []).append((i, goal))
        else:
            out[i] = (0, 0, 0)
    while searches:
        brackets, more = list(searches), {}
        for r in _crossings(keys, weight, searches):
            fixed = brackets[r["at"]][0]
            low, high = r["goal"] - r["before"], r["upto"] - r["goal"]
            last = r["least"] == r["most"] and len(fixed) == len(_PARTS) - 1
            if min(low, high) <= slack or last:
                edge = r["least"] if low <= high else r["most"] + 1
                out[r["splitter"]] = (*fixed, edge, *[0] * (len(_PARTS) - 1 - len(fixed)))
            else:
                bracket = ((*fixed, r["least"]), 0, (1 << KEY_BITS) - 1) if r["least"] == r["most"] else (fixed, r["least"], r["most"])
                more.setdefault(bracket, []).append((r["splitter"], low))
        searches = more
    return [out[i] for i in sorted(out)]


def _over(key: tuple[int, int, int]) -> Column:
    a, b, c = (F.col(p) for p in _PARTS)
    return (a > key[0]) | ((a == key[0]) & ((b > key[1]) | ((b == key[1]) & (c >= key[2]))))


def shard(docs: DataFrame, shards: int = 16, law: str = "bytes", tolerance: float = 0.002, columns: list[str] | None = None) -> DataFrame:
    """docs (or the given columns of it) with size, text_crc32, law, shard, slot and grown_shard.

    size: UTF-8 bytes of the text and 1. Shards are ranges of the key (see `keyed`), cut by `splitters`: under the law
    `bytes` their sizes are even within twice `tolerance` or one document, under `rows` their counts are at most one apart.
    slot counts from 0 in each shard without gaps. grown_shard is null, as neither law has one. Rows are exchanged once,
    by shard and piece: pieces are dealt by the hash of doc_id, so neither a large shard nor a group of copies lands in one
    task, and the offsets of pieces come from their counts. Where no row repeats in full, text and doc_id decide alone.
    A null text counts as an empty one (size 1, checksum 0); a null doc_id is a value like others; repeated rows each have
    a slot; an empty table gives no rows; with fewer rows than shards some shards stay empty. Columns of docs named like
    the new ones are replaced.
    """
    if law not in ("bytes", "rows"):
        raise ValueError(f"no law {law}")
    new = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    carried = [c for c in (docs.columns if columns is None else columns) if c not in new]
    keys = keyed(docs, carried)
    weight, even = (F.col("size"), tolerance) if law == "bytes" else (F.lit(1).cast("long"), 0.0)
    cuts = splitters(keys, weight, shards, even)
    number = reduce(add, [_over(c).cast("int") for c in cuts], F.lit(0)).alias("shard")
    rows = keys.count()
    pieces = max(LEAST_PIECES, -(-rows // (PIECE_ROWS * shards)))
    few = F.broadcast if shards * pieces <= MOST_BROADCAST else (lambda df: df)
    placed = keys.select("*", number, F.pmod(F.xxhash64("k1__"), F.lit(pieces)).alias("piece__"))
    # a doc_id that repeats very often makes its piece large: by their places its rows go to several parts
    large = placed.groupBy("shard", "piece__").agg(F.count("*").alias("n")).where(F.col("n") > 4 * max(1, rows // (shards * pieces)))
    large = materialize(large.select("shard", "piece__", F.ceil(F.col("n") * shards * pieces / rows).alias("parts__")))
    part = F.coalesce(F.pmod(F.col("k2__"), F.col("parts__")), F.lit(0)).cast("long").alias("part__")
    placed = placed.join(few(large), ["shard", "piece__"], "left").select(*placed.columns, part)
    cell = ["shard", "piece__", "part__"]
    counts = placed.groupBy(*cell).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("piece__", "part__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = few(counts.select(*cell, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base__")))
    dealt = placed.withColumn("nth__", F.row_number().over(Window.partitionBy(*cell).orderBy(*_PARTS)) - 1).join(offsets, cell)
    return dealt.select(
        *[F.col(f"row__.`{c}`").alias(c) for c in carried], "size", "text_crc32", F.lit(law).alias("law"), "shard",
        (F.col("base__") + F.col("nth__")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, law: str = "bytes", tolerance: float = 0.002) -> None:
    """The rows of `shard`, all columns, as Parquet files in a folder for each shard."""
    shard(docs, shards, law, tolerance).write.partitionBy("shard").parquet(path)
