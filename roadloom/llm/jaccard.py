"""Operator 1: n-gram Jaccard join in metric space, exact.

Every single shingle is a pivot. A document is nearest to the pivots it contains; among those the rarest one (by a
fixed-size table of counts over the whole corpus, then by hash) is its Voronoi region. Two documents within distance t
share a pivot that is among the first n - ceil((1 - t) * n) + 1 of both, so a document is replicated over just that
window of regions. Whole documents as first-level pivots don't work on text: nearly all distances are 1.
Inside a region the document with the fewest rarer shingles becomes the pivot; all members are compared with it. Members that end up in one component
need no further pairs; the others join recursively. Before any sets are moved, each pair must lie in the windows that the
triangle inequality leaves around CLASSES more pivots: the shingles of one hash class each. A document's distances to
them are its counts by class, and no two documents differ less than those counts do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import Roll, bytes_of, chunks, id_filter, map_batches, materialize, mix, packed, pick, unpacked, word_spans
from roadloom.llm.components import components

#: Counts of the corpus table (2**18 of 4 bytes, 1 MB) and the rows it is dealt in.
SKETCH_BITS, SKETCH_ROWS = 18, 64
#: Hash classes whose counts (a byte each) bound the distance of two sets from below.
CLASSES = 256


def shingle_sets(batch, k: int, roll: Roll):
    """Sorted distinct 64-bit shingle hashes of each row. Fewer than k words: all of them as one; no words: none."""
    data, offsets = bytes_of(batch.column(batch.schema.get_field_index("text")))
    starts, ends, first = word_spans(data, offsets)
    words = roll.spans(roll.sums(data), starts, ends)
    n = max(0, len(words) - k + 1)
    grams = np.full(n, np.uint64(k))
    for j in range(k):
        grams = mix(grams * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n])
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            s = np.sort(grams[a : b - k + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif b > a:
            h = np.full(1, np.uint64(b - a))
            for w in words[a:b]:
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w)
            yield h
        else:
            yield np.zeros(0, np.uint64)


def _counts(docs: DataFrame, k: int) -> np.ndarray:
    """How many documents have a shingle of each hash bucket, over the whole corpus. Always 1 MB."""
    size = 1 << SKETCH_BITS
    per = size // SKETCH_ROWS

    def count(batches):
        roll, table = Roll(1, lower=True), np.zeros(size, np.int64)
        for batch in chunks(batches):
            sets = list(shingle_sets(batch, k, roll))
            every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            table += np.bincount((every >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=size)
        if table.any():
            rows = [table[i * per : (i + 1) * per].astype("<u4").tobytes() for i in range(SKETCH_ROWS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_ROWS), pa.int32()), pa.array(rows, pa.binary())], ["i", "part"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(per, np.int64)
        for batch in batches:
            for x in batch.column(1):
                total += np.frombuffer(x.as_buffer(), "<u4")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.minimum(total, 2**32 - 1).astype("<u4").tobytes()], pa.binary())], ["i", "part"])

    out = np.zeros(size, np.uint32)
    for r in map_batches(docs.select("text"), count, "i int, part binary").groupBy("i").applyInArrow(add, "i int, part binary").collect():
        out[r.i * per : (r.i + 1) * per] = np.frombuffer(bytes(r.part), "<u4")
    return out


def _window(n, num: int, den: int):
    return n - -(-num * n // den) + 1


def _class_counts(s: np.ndarray) -> bytes:
    return np.minimum(np.bincount((s & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES), 255).astype(np.uint8).tobytes()


def near_groups(docs: DataFrame, k: int = 5, least: tuple[int, int] = (4, 5)) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs.

    Documents link when intersection / union of their sets of k-word shingles is least[0] / least[1] or more, A-Z
    lower-cased; component_id is the smallest doc_id that links reach, the document's own included. Equal sets are one
    class from the start, so copies are never paired. Texts that are null or without words have an empty set and link
    with nothing. A row with a null doc_id links with nothing and keeps a null component_id; rows that repeat a doc_id
    share its component. An empty table gives no rows. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    num, den = least
    table = docs.sparkSession.sparkContext.broadcast(_counts(docs, k))

    def heads(batches):
        roll = Roll(1, lower=True)
        for batch in chunks(batches):
            n, digest, window, counts = [], [], [], []
            for s in shingle_sets(batch, k, roll):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                counts.append(_class_counts(s))
                if not len(s):
                    window.append(b"")
                    continue
                size = _window(len(s), num, den)
                common = table.value[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.lexsort((s, common))[:size] if size < len(s) else slice(None)
                window.append(s[order].tobytes())
            yield pa.RecordBatch.from_arrays([*pick(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(window, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "n", "digest", "window", "counts"])

    rows = materialize(map_batches(docs, heads, "doc_id long, n long, digest binary, window binary, counts binary"))
    classes = materialize(rows.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")))

    def spread(batches):
        for batch in batches:
            data, offsets = bytes_of(batch.column(batch.schema.get_field_index("window")).cast(pa.large_binary()))
            size = np.diff(offsets) // 8
            many = np.repeat(np.arange(batch.num_rows), size)
            n = batch.column(batch.schema.get_field_index("n")).to_numpy()[many]
            place = np.arange(len(many)) - np.repeat(np.cumsum(size) - size, size)
            yield pa.RecordBatch.from_arrays([pa.array(data.view(np.int64)), batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(many)), pa.array(n), pa.array(place)], ["pivot", "doc", "n", "place"])

    one = rows.join(classes, (rows.digest == classes.digest) & (rows.doc_id == classes.rep))
    entries = map_batches(one.select("window", "doc_id", "n"), spread, "pivot long, doc long, n long, place long")
    regions = entries.groupBy("pivot").agg(F.count("*").alias("c"), F.min(F.struct("place", "doc", "n")).alias("center")).where("c > 1").select("pivot", "center")
    members = materialize(entries.join(regions, "pivot"))
    counts = materialize(one.select(F.col("doc_id").alias("id"), "n", "counts").join(members.select(F.col("doc").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id"]))

    def meet(x: str, y: str):
        """At its first shared pivot a pair within distance t has as much left of either set as it must share."""
        need = (F.col(f"{x}.n") + F.col(f"{y}.n")) * num
        return ((F.col(f"{x}.n") - F.col(f"{x}.place")) * (num + den) >= need) & ((F.col(f"{y}.n") - F.col(f"{y}.place")) * (num + den) >= need)

    pair = lambda x, y: (F.least(f"{x}.doc", f"{y}.doc").alias("a"), F.greatest(f"{x}.doc", f"{y}.doc").alias("b"))
    star = members.alias("m").where((F.col("doc") != F.col("center.doc")) & meet("center", "m")).select(*pair("center", "m")).distinct()
    seen = materialize(_links(docs, star, counts, k, num, den))
    # what the star of each region leaves: members of different components
    part = components(seen).withColumnRenamed("node", "doc")
    known = members.join(part, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    mixed = known.groupBy("pivot").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("pivot")
    rest = materialize(known.where(F.col("doc") != F.col("center.doc")).join(mixed, "pivot").drop("center"))
    x, y = rest.alias("x"), rest.alias("y")
    left = x.join(y, (F.col("x.pivot") == F.col("y.pivot")) & (F.col("x.component") < F.col("y.component")) & meet("x", "y")).select(*pair("x", "y")).distinct()
    more = materialize(_links(docs, left, counts, k, num, den))
    part = components(seen.union(more)).select(F.col("node").alias("rep"), F.col("component").alias("found"))
    final = classes.join(part, "rep", "left").select("digest", F.coalesce("found", "rep").alias("component"))
    out = rows.select("doc_id", "n", "digest").join(final, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, s): the sorted shingle hashes of the documents that share a region with another."""

    def run(batches):
        roll = Roll(1, lower=True)
        for batch in batches:
            texts = pa.array([unpacked(z, n) for z, n in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist())], pa.binary())
            for part in chunks([pa.RecordBatch.from_arrays([batch.column(0), texts], ["id", "text"])]):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(part, k, roll)], pa.binary())], ["id", "s"])

    texts = packed(docs, id_filter(ids, "doc")).join(ids, F.col("doc_id") == F.col("doc"), "left_semi")
    return materialize(map_batches(texts, run, "id long, s binary").dropDuplicates(["id"]))


def _links(docs: DataFrame, pairs: DataFrame, counts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, decided in whole numbers."""
    of = lambda c: counts.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("counts").alias(f"c{c}"))

    def near(batches):
        for batch in batches:
            if batch.num_rows:
                ca, cb = (bytes_of(c.cast(pa.large_binary()))[0].reshape(-1, CLASSES).astype(np.int16) for c in pick(batch, "ca", "cb"))
                na, nb = (c.to_numpy() for c in pick(batch, "na", "nb"))
                yield batch.filter(pa.array(np.abs(ca - cb).sum(1) * (num + den) <= (den - num) * (na + nb))).select(["a", "b"])

    close = materialize(map_batches(pairs.join(of("a"), "a").join(of("b"), "b"), near, "a long, b long"))
    sets = _sets(docs, close.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), k)

    def compare(batches):
        for batch in batches:
            linked = []
            for p, q in zip(*pick(batch, "sa", "sb")):
                u, v = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                if len(u) > len(v):
                    u, v = v, u
                both = int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum())
                linked.append(den * both >= num * (len(u) + len(v) - both))
            yield batch.filter(pa.array(linked, pa.bool_())).select(["a", "b"])

    full = close.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    return map_batches(full.select("a", "b", "sa", "sb"), compare, "a long, b long")
