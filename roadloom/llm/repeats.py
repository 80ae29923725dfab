"""Operator 5: removal of long strings that occur elsewhere, over all bytes of the corpus.

`longest_previous` is the suffix-array form for texts that one task holds. Over a corpus, suffixes are sampled at anchors:
each window of `length` bytes has an anchor chosen by its own bytes alone, so equal windows meet under equal anchor keys,
and only suffixes that share an anchor are compared. Whole ranges of windows are settled by one key each (both ends of
the common prefix at once); what differs is cut into blocks of 16 windows, then single ones. All are counts by key with
partial aggregation, so no group of copies is ever gathered.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import Roll, bytes_of, chunks, id_filter, join_counted, map_batches, materialize, mix, packed, unpacked, without

#: Bytes of an anchor string.
GRAM = 100
#: Window starts that are handled at a time; a longer text is read in parts that overlap.
PART = 1 << 18


def parts_of(batch, length: int):
    """(data, offsets of the rows in it, first row, place of data in that row) of rows end to end, or parts of a long row."""
    data, offsets = bytes_of(batch.column(batch.schema.get_field_index("text")))
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PART, side="right")) - 1)
        if to == at + 1 and offsets[to] - offsets[at] > PART + length:
            own = data[offsets[at] : offsets[to]]
            for s in range(0, len(own) - length + 1, PART):
                piece = own[s : s + PART + length - 1]
                yield piece, np.array([0, len(piece)]), at, s
        else:
            yield data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at, 0
        at = to


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, roll: Roll):
    """(row, first start, last start, anchor, anchor key, key of the span) of each range of windows with one anchor.

    The anchor of a window is the leftmost of its GRAM-byte strings with the smallest hash, so equal windows have equal
    anchors at equal places, whatever stands around them.
    """
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    if len(data) < length:
        return none
    sums = roll.sums(data)
    grams = roll.spans(sums, np.arange(len(data) - GRAM + 1), np.arange(GRAM, len(data) + 1))
    low = np.uint64((1 << 24) - 1)
    best = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width, have = length - GRAM + 1, 1
    while 2 * have <= width:
        best = np.minimum(best[:-have], best[have:])
        have *= 2
    if have < width:
        best = np.minimum(best[: len(best) - (width - have)], best[width - have :])
    starts = np.arange(len(best))
    row = np.searchsorted(offsets, starts, side="right") - 1
    starts = starts[starts + length <= offsets[row + 1]]
    if not len(starts):
        return none
    at = (best[starts] & low).astype(np.int64)
    cut = np.concatenate([[True], at[1:] != at[:-1]])
    first = starts[cut]
    last = starts[np.append(np.flatnonzero(cut)[1:] - 1, len(starts) - 1)]
    p = at[cut]
    span = roll.spans(sums, first, last + length) ^ mix2(first - p, last - p)
    return row[first], first, last, p, grams[p], span


def mix2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((a.astype(np.uint64) << np.uint64(20)) ^ b.astype(np.uint64))


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    def run(batches):
        roll = Roll(5)
        for batch in chunks(batches):
            ids = batch.column(0)
            for data, offsets, at, base in parts_of(batch, length):
                row, first, last, p, key, span = anchors(data, offsets, length, roll)
                own = offsets[row] - base
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at + row)), *(pa.array((x - own).astype(np.int32)) for x in (first, last, p)), pa.array(key.view(np.int64)), pa.array(span.view(np.int64))],
                    ["doc_id", "first", "last", "p", "anchor", "span"],
                )

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, first int, last int, p int, anchor long, span long")


def _ask(docs: DataFrame, requests: DataFrame, run, schema: str, most: int = 1 << 17) -> DataFrame:
    """run(roll, sums of the bytes, requests) -> arrays, for each document of requests (doc_id and a struct column `ask`
    with lo and hi). Requests are answered some at a time, so that about `most` places are expanded at once."""
    lists = requests.groupBy("doc_id").agg(F.collect_list("ask").alias("asks")).withColumnRenamed("doc_id", "id_")
    joined = packed(docs, id_filter(lists, "id_")).join(lists, F.col("doc_id") == F.col("id_")).drop("id_")
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def each(batches):
        roll = Roll(5)
        for batch in batches:
            for i in range(batch.num_rows):
                doc, size, z = (batch.column(c)[i].as_py() for c in range(3))
                asks = batch.column(3)[i].values
                asks = {f.name: asks.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k, f in enumerate(asks.type)}
                sums = roll.sums(np.frombuffer(unpacked(z, size), np.uint8))
                upto = np.cumsum(asks["hi"] - asks["lo"] + 1)
                cuts = np.flatnonzero(np.diff(upto // most)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(upto)]):
                    arrays = run(roll, sums, {n: v[a:b] for n, v in asks.items()})
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(arrays[0]), doc)), *map(pa.array, arrays)], names)

    return map_batches(joined, each, schema)


def repeated_windows(docs: DataFrame, length: int = 400, block: int = 16) -> DataFrame:
    """(doc_id, lo, hi): ranges of byte places where strings of `length` bytes start that also start anywhere else.

    length must be above GRAM, the bytes of an anchor. Keys that very many ranges share meet their counts by broadcast.
    """
    if length <= GRAM:
        raise ValueError(f"length must be above {GRAM}")
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(_anchor_rows(docs, length))
    often = materialize(rows.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1"))
    some = materialize(join_counted(rows, often, ["anchor"], "c").drop("c"))
    groups = materialize(some.groupBy("anchor", "span").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "first", "last", "p")).alias("one")))
    several = groups.where("c > 1").select("anchor", "span", "c")
    whole = join_counted(some, several, ["anchor", "span"], "c").select("doc_id", F.col("first").alias("lo"), F.col("last").alias("hi"))

    split = materialize(groups.groupBy("anchor").agg(F.min("c").alias("least"), F.count("*").alias("n")).where("least = 1 and n > 1").select("anchor", "n"))
    asks = join_counted(groups, split, ["anchor"], "n").select("one.doc_id", F.struct(F.col("one.first").alias("lo"), F.col("one.last").alias("hi"), "one.p", F.least("c", F.lit(2)).alias("c")).alias("ask"))

    def cut(roll, sums, ask):
        first, last, p, c = (ask[n] for n in ("lo", "hi", "p", "c"))
        top = -(-(length - GRAM) // block) * block  # start - p + top is at least 0
        b0, b1 = (first - p + top) // block, (last - p + top) // block
        many = b1 - b0 + 1
        i = np.repeat(np.arange(len(first)), many)
        b = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + b0[i]
        left = p[i] - top + b * block
        lo, hi = np.maximum(first[i], left), np.minimum(last[i], left + block - 1)
        core = roll.spans(sums, left + block - 1, left + length) ^ mix2(b, b)
        union = roll.spans(sums, lo, hi + length) ^ mix2(lo - p[i] + top, hi - p[i] + top)
        return lo.astype(np.int32), hi.astype(np.int32), core.view(np.int64), union.view(np.int64), c[i]

    cuts = materialize(_ask(docs, asks, cut, "doc_id long, lo int, hi int, core long, union_ long, c long"))
    unions = materialize(cuts.groupBy("core", "union_").agg(F.sum("c").alias("c"), F.count("*").alias("n"), F.min(F.struct("doc_id", "lo", "hi")).alias("one")))
    several = unions.where("c > 1").select("core", "union_", "n")
    blocks = join_counted(cuts, several, ["core", "union_"], "n").where("c = 1").select("doc_id", "lo", "hi")

    split = materialize(unions.groupBy("core").agg(F.min("c").alias("least"), F.count("*").alias("n_")).where("least = 1 and n_ > 1").select("core", "n_"))
    asks = join_counted(unions, split, ["core"], "n_").select("one.doc_id", F.struct("one.lo", "one.hi", F.least("c", F.lit(2)).alias("c")).alias("ask"))

    def windows(roll, sums, ask):
        lo, hi, c = (ask[n] for n in ("lo", "hi", "c"))
        many = hi - lo + 1
        i = np.repeat(np.arange(len(lo)), many)
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + lo[i]
        return at.astype(np.int32), roll.spans(sums, at, at + length).view(np.int64), c[i]

    single = materialize(_ask(docs, asks, windows, "doc_id long, at int, key long, c long"))
    twice = materialize(single.groupBy("key").agg(F.sum("c").alias("all"), F.count("*").alias("n")).where("all > 1").select("key", "n"))
    ones = join_counted(single, twice, ["key"], "n").where("c = 1").select("doc_id", F.col("at").alias("lo"), F.col("at").alias("hi"))
    return whole.union(blocks).union(ones)


def _kept(data: bytes, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[bytes, np.ndarray]:
    """What is left, and the maximal removed runs (start, end)."""
    if not len(lo):
        return data, np.zeros((0, 2), np.int64)
    order = np.argsort(lo)
    lo, end = lo[order].astype(np.int64), np.maximum.accumulate(hi[order].astype(np.int64) + length)
    new = np.concatenate([[True], lo[1:] > end[:-1]])
    runs = np.stack([lo[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]], axis=1)
    edges = [0, *runs.ravel().tolist(), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])), runs


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans array<struct<start,end>>, kept_sha256 for every row of docs.

    Every byte under a string of `length` bytes that also starts anywhere else, the same text included, is removed; all
    copies go. Texts are UTF-8 bytes, null is empty; rows that repeat a doc_id should hold one text. A row with a null
    doc_id is not searched and stays whole. An empty table gives no rows. Only texts with something to remove are moved.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = materialize(repeated_windows(docs, length))
    lists = found.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("asks")).withColumnRenamed("doc_id", "id_")
    hits = id_filter(found, "doc_id")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept_sha256 string"
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def batch_of(ids, rows):
        size, kept, runs = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(size, pa.int64()), pa.array([n - len(k) for n, k in zip(size, kept)], pa.int64()), pa.array([len(r) for r in runs], pa.int64()),
             pa.array([[{"start": a, "end": b} for a, b in r.tolist()] for r in runs], kinds), pa.array([hashlib.sha256(k).hexdigest() for k in kept])],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"],
        )

    def whole(batches):
        for batch in chunks(batches):
            data, offsets = bytes_of(batch.column(1))
            rows = [(b - a, data[a:b].tobytes(), np.zeros((0, 2), np.int64)) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield batch_of(batch.column(0), rows)

    def cut(batches):
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                size, z, asks = (batch.column(c)[i] for c in (1, 2, 3))
                lo, hi = (asks.values.field(k).to_numpy() for k in (0, 1)) if asks.is_valid else (np.zeros(0, np.int64),) * 2
                rows.append((size.as_py(), *_kept(unpacked(z.as_py(), size.as_py()), lo, hi, length)))
            if rows:
                yield batch_of(batch.column(0), rows)

    changed = packed(docs, hits).join(lists, F.col("doc_id") == F.col("id_"), "left").drop("id_")
    return map_batches(without(docs, hits), whole, schema).unionByName(map_batches(changed, cut, schema))


def suffix_array(data: bytes) -> np.ndarray:
    """Places of the suffixes in order, by prefix doubling."""
    rank = np.frombuffer(data, np.uint8).astype(np.int64)
    n, k = len(rank), 1
    order = np.argsort(rank, kind="stable")
    while True:
        second = np.full(n, -1, np.int64)
        second[: max(0, n - k)] = rank[k:]
        order = np.lexsort((second, rank))
        a, b = rank[order], second[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.concatenate([[0], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if n else 0
        rank = fresh
        if n == 0 or rank.max() == n - 1 or k >= n:
            return order
        k *= 2


def longest_previous(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous factor of each place, and an earlier place where it starts (-1: none).

    The previous and the next smaller places in suffix order are the only candidates.
    """
    n = len(data)
    order = suffix_array(data)
    near = {-1: [-1] * n, 1: [-1] * n}
    for way in (1, -1):
        stack: list[int] = []
        for p in order[::way].tolist():
            while stack and stack[-1] > p:
                stack.pop()
            near[way][p] = stack[-1] if stack else -1
            stack.append(p)
    size, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    for way in (1, -1):
        k = 0
        for i in range(n):
            j = near[way][i]
            if j < 0:
                k = 0
                continue
            k = max(0, k - 1)
            while i + k < n and data[j + k] == data[i + k]:
                k += 1
            if k > size[i]:
                size[i], source[i] = k, j
    return size, source


def drop_later_copies(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, text: inside each text, bytes under a string of `length` that starts earlier in it are removed; the first copy stays.

    Texts are taken one at a time; a cut inside a character drops its broken bytes. Nulls stay null.
    """

    def run(batches):
        for batch in chunks(batches):
            out = []
            for t in batch.column(1).to_pylist():
                if t is not None and len(data := t.encode()) > length:
                    size, _ = longest_previous(data)
                    at = np.flatnonzero(size >= length)
                    t = _kept(data, at, at + (size[at] - length), length)[0].decode(errors="ignore")
                out.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, text string")
