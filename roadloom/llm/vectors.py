"""Operator 10: near-duplicate embeddings by spherical k-means cells and blocked cosine products."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import map_batches, materialize, pick
from roadloom.llm.components import components

#: Bounds: rows that the centres are fitted on, cells, cells a vector is put in, vectors of a block.
SAMPLE_ROWS, MOST_CELLS, PROBES, BLOCK = 16_384, 4096, 4, 1024


def _rows(column) -> list[np.ndarray | None]:
    """Unit vectors in float64; None where null, empty, zero, or with null or non-finite components.

    The largest component is divided out first, so that no square is too large or too small for a number.
    """
    out = []
    for x in column:
        v = None
        if x.is_valid and len(x) and not x.values.null_count:
            v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(v).all() or not v.any():
                v = None
            else:
                v = v / np.abs(v).max()
                v = v / np.linalg.norm(v)
        out.append(v)
    return out


def fit_cells(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Spherical k-means over unit rows: centres are renewed as normalised sums; empty cells keep their centre."""
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        home = np.concatenate([(p @ c.T).argmax(1) for p in np.array_split(x, -(-len(x) // 4096))])
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), c)
    return c


def near_vectors(vectors: DataFrame, least: float = 0.95, sample_rows: int = SAMPLE_ROWS, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (columns vec_id, embedding).

    Vectors that are equal but for their length are one class and counted, not paired. Each class goes to the `probes` cells with the nearest centres;
    a cell is cut into blocks, and each pair of blocks is one small matrix product. A pair that shares several cells
    counts in the first only. Blocks return, for each vector, how many it links with, and a forest of links: never pairs.
    Vectors that are null, zero or hold null or non-finite components link with nothing; vectors of other lengths are
    compared among themselves; a null vec_id keeps a null component_id. An empty table gives no rows.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    spark = vectors.sparkSession

    def digests(batches):
        for batch in batches:
            ids, emb = pick(batch, "vec_id", "embedding")
            units = _rows(emb)
            keys = [None if v is None else hashlib.blake2b((v + 0.0).tobytes(), digest_size=16).digest() for v in units]
            yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.binary()), pa.array(units, pa.list_(pa.float64()))], ["vec_id", "digest", "embedding"])

    rows = materialize(map_batches(vectors, digests, "vec_id long, digest binary, embedding array<double>"))
    classes = materialize(rows.where("digest is not null and vec_id is not null").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    reps = rows.join(classes, (rows.digest == classes.digest) & (rows.vec_id == classes.rep)).select("rep", "copies", rows.digest, "embedding").dropDuplicates(["digest"])
    reps = materialize(reps.select("rep", "copies", "embedding", F.size("embedding").alias("dim")))
    dims = [r.dim for r in reps.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()]
    centres = None
    if dims:
        count = reps.where(F.col("dim") == dims[0]).count()
        sample = reps.where(F.col("dim") == dims[0]).orderBy(F.xxhash64("rep"), "rep").limit(sample_rows).select("embedding").toArrow()
        x = sample.column(0).combine_chunks().values.to_numpy().reshape(-1, dims[0])
        centres = fit_cells(x, int(min(MOST_CELLS, max(4, count // 256))))
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches):
        c = shared.value
        for batch in batches:
            cells = []
            for x in _rows(batch.column(batch.schema.get_field_index("embedding"))):
                if c is None or len(x) != c.shape[1]:
                    cells.append([-len(x)])
                else:
                    score = c @ x
                    cells.append(sorted(np.argpartition(-score, min(probes, len(score)) - 1)[:probes].tolist()))
            yield pa.RecordBatch.from_arrays([*pick(batch, "rep", "copies", "embedding"), pa.array(cells, pa.list_(pa.int32()))], ["rep", "copies", "embedding", "cells"])

    placed = materialize(map_batches(reps, assign, "rep long, copies long, embedding array<double>, cells array<int>"))
    spread = placed.withColumn("cell", F.explode("cells"))
    blocks = spread.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    spread = spread.join(blocks, "cell").withColumn("mine", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("rep", "copies", "embedding", "cells", "cell", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine")

    def compare(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        cell, i, j = (k.as_py() for k in key)
        rep, copies, mine = (t.column(n).to_numpy() for n in ("rep", "copies", "mine"))
        flat = t.column("embedding").combine_chunks()
        x = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(rep), -1)
        cells = t.column("cells").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rep), -1)
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        links, root = np.zeros(len(rep), np.int64), np.arange(len(rep))

        def find(v):
            while root[v] != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        for start in range(0, len(left), 256):
            part = left[start : start + 256]
            a, b = np.nonzero(x[part] @ x[right].T >= least)
            a, b = part[a], right[b]
            keep = a < b if i == j else a != b
            a, b = a[keep], b[keep]
            # the first cell that both are in counts
            before = ((cells[a][:, :, None] == cells[b][:, None, :]) & (cells[a][:, :, None] < cell)).any((1, 2))
            a, b = a[~before], b[~before]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            for u, v in zip(a.tolist(), b.tolist()):
                u, v = find(u), find(v)
                if u != v:
                    root[max(u, v, key=lambda z: rep[z])] = min(u, v, key=lambda z: rep[z])
        top = np.array([find(v) for v in range(len(rep))], np.int64)
        some = links > 0
        return pa.table({"rep": rep[some], "links": links[some], "root": rep[top][some]})

    found = materialize(spread.groupBy("cell", "i", "j").applyInArrow(compare, "rep long, links long, root long"))
    part = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("rep"), "component")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.join(links, "rep", "left").join(part, "rep", "left")
    known = known.select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("vec_id", "digest").join(known, "digest", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def recall(vectors: DataFrame, least: float = 0.95, every: int = 50, **options) -> tuple[int, int]:
    """(links found, links there are) of the rows whose vec_id is divisible by `every`, against all rows by brute force."""
    found = near_vectors(vectors, least, **options).where(F.col("vec_id") % every == 0).agg(F.sum("n_links")).first()[0] or 0
    queries = vectors.where(F.col("vec_id") % every == 0).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).toPandas()
    q = np.array([v for v in _rows(pa.array(queries.embedding, pa.list_(pa.float64()))) if v is not None])
    shared = vectors.sparkSession.sparkContext.broadcast(q)

    def count(batches):
        for batch in batches:
            x = [v for v in _rows(batch.column(0)) if v is not None]
            x = np.array(x) if x else np.zeros((0, shared.value.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array([int((x @ shared.value.T >= least).sum())])], ["n"])

    there = vectors.select(F.col("embedding").cast("array<double>")).mapInArrow(count, "n long").agg(F.sum("n")).first()[0]
    return int(found), int(there) - len(q)
