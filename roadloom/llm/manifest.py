"""Operator 12: a Merkle manifest of a dataset, by cogrouped subtree exchange."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.common import materialize

#: Nodes that one parent joins, and levels inside a superblock, which so has up to 16**3 leaves.
FAN, LEVELS = 16, 3
BLOCK = FAN**LEVELS
#: Rows of the table of counts up to which it is broadcast.
MOST_BROADCAST = 200_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """`-` if null, else UTF-8 byte count, `:`, value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(*[field(F.col(c)) for c in FIELDS[:-1]], field(text)).cast("binary"), 256)


def lower_ascii(text: Column) -> Column:
    """Only A-Z become small."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with pos (from 0 by `by`, ascending in `order`) and n (rows of its `by`), written once.

    Range partitions over by and order, so no task holds all rows of a key; a row's place is its number in the partition
    and what the partitions before it hold of its key.
    """
    names = rows.columns
    dealt = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    dealt = materialize(dealt.select(*names, F.spark_partition_id().alias("part__"), F.monotonically_increasing_id().alias("nth__")))
    parts = dealt.groupBy(*by, "part__").agg(F.count("*").alias("c__"), F.min("nth__").alias("first__"))
    w = Window.partitionBy(*by).orderBy("part__")
    base = F.coalesce(F.sum("c__").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = materialize(parts.select(*by, "part__", (base - F.col("first__")).alias("shift__"), F.sum("c__").over(Window.partitionBy(*by)).alias("n")))
    parts = F.broadcast(parts) if parts.count() <= MOST_BROADCAST else parts
    return dealt.join(parts, [*by, "part__"]).select(*names, (F.col("nth__") + F.col("shift__")).alias("pos"), "n")


def parents(nodes: list[str]) -> list[str]:
    """One level up: the H of every FAN consecutive nodes."""
    return [hashlib.sha256("".join(nodes[i : i + FAN]).encode()).hexdigest() for i in range(0, len(nodes), FAN)]


def local_levels(leaves: list[str], total: int) -> list[list[str]]:
    """The nodes of a superblock level by level, its leaves first; `total` leaves are in the whole tree.

    A superblock of several has LEVELS levels above its leaves, even with one leaf; an only one ends with the subroot.
    """
    out = [leaves]
    while len(out) <= LEVELS and (total > BLOCK or len(out[-1]) > 1):
        out.append(parents(out[-1]))
    return out


def others(place: int, nodes: list[str]) -> list[str]:
    return [*nodes[:place], *nodes[place + 1 :]]


def fold(node: str, path: list[tuple[int, list[str]]]) -> str:
    """The top over a node: at each level it takes its place among the nodes of its run."""
    for place, nodes in path:
        node = hashlib.sha256("".join([*nodes[:place], node, *nodes[place + 1 :]]).encode()).hexdigest()
    return node


def climb(nodes: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(by.., pos, path) of every node and (by.., top): the levels over nodes (by.., pos, n, node), n nodes in each tree.

    path has (at, nodes) of the node's run at each level, up to the top; an only node has none. Up, one aggregate over runs
    of FAN nodes a level; down, one join a level in which a parent meets FAN rows at most.
    """
    kind = "array<struct<at:int,nodes:array<string>>>"
    level, runs, tops = nodes.select(*by, "pos", "n", "node"), [], None
    while True:
        done = level.where("n = 1").select(*by, F.col("node").alias("top"), F.lit(len(runs)).alias("height"))
        tops = done if tops is None else tops.unionByName(done)
        level = level.where("n > 1")
        if level.isEmpty():
            break
        run = level.groupBy(*by, F.expr(f"pos div {FAN}").alias("pos"), "n").agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("x"))
        run = materialize(run.select(*by, "pos", "n", F.col("x.node").alias("nodes")))
        runs.append(run)
        level = run.select(*by, "pos", F.ceil(F.col("n") / FAN).cast("long").alias("n"), F.sha2(F.array_join("nodes", "").cast("binary"), 256).alias("node"))
    tops = materialize(tops)
    path = tops.select(*by, F.lit(0).cast("long").alias("pos"), F.array().cast(kind).alias("path"), "height")
    for k in range(len(runs) - 1, -1, -1):
        here = path.where(F.col("height") > k)
        below = runs[k].drop("n").join(here, [*by, "pos"]).select(*by, "pos", "path", "height", "nodes", F.posexplode("nodes").alias("at", "node"))
        below = below.select(*by, (F.col("pos") * FAN + F.col("at")).alias("pos"), F.concat(F.array(F.struct("at", "nodes")), "path").cast(kind).alias("path"), "height")
        path = materialize(below.unionByName(path.where(F.col("height") <= k)))
    return path.select(*by, "pos", "path"), tops.select(*by, "top")


def _block_root(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("pos")
    top = local_levels(rows["leaf"].tolist(), int(rows["n"].iloc[0]))[-1]
    return pd.DataFrame({"source_key": [key[0]], "pos": [key[1]], "n": [-(-int(rows["n"].iloc[0]) // BLOCK)], "node": top})


def _finish(key: tuple, rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Local levels, proofs and folded roots of one superblock, whose outer nodes are in the one row of outer."""
    rows = rows.sort_values("pos")
    subroot, root = outer["subroot"].iloc[0], outer["root"].iloc[0]
    path = [(r["at"], list(r["nodes"])) for r in outer["path"].iloc[0]]
    leaves = rows["leaf"].tolist()
    levels = local_levels(leaves, int(rows["n"].iloc[0]))[:-1]
    proofs, folded = [], []
    for i, (own, changed) in enumerate(zip(leaves, rows["changed"])):
        way, at = [], i
        for level in levels:
            way.append((at % FAN, level[at - at % FAN : at - at % FAN + FAN]))
            at //= FAN
        way += path
        proofs.append(hashlib.sha256("".join(x for step in way for x in others(*step)).encode()).hexdigest())
        folded.append(fold(changed or own, way))
    return pd.DataFrame({"id": rows["id"], "leaf": leaves, "subroot": subroot, "root": root, "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded]})


def leaves_of(docs: DataFrame, tampered: Column | None = None, change=lower_ascii) -> DataFrame:
    """source_key, doc_id, id (its decimal form), leaf, changed (the leaf of tampered rows, else null), place; written once.

    source_key sorts as null first, then by UTF-8 bytes, and is never null. With equal doc_id rows go by leaf, then by place.
    """
    changed = F.when(F.coalesce(tampered, F.lit(False)), leaf(change(F.col("text")))) if tampered is not None else F.lit(None).cast("string")
    return materialize(docs.select(
        F.coalesce(F.concat(F.lit(":"), F.col("source").cast("string")), F.lit("-")).alias("source_key"), "doc_id", F.col("doc_id").cast("string").alias("id"),
        leaf(F.col("text")).alias("leaf"), changed.alias("changed"), F.monotonically_increasing_id().alias("place"),
    ))


def manifest(docs: DataFrame, tampered: Column | None = None, change=lower_ascii) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of docs.

    leaf: H over the fields doc_id, source, lang, n_chars, text. A tree of each source (leaves by doc_id, null first, equal
    ones by leaf) has the subroot on top, one over the subroots (by source, null first) the root; FAN nodes have one
    parent, a last run fewer. proof_sha256: H of the siblings on the way from the leaf to the root. folded_root is computed
    from the leaf of the row, for `tampered` rows with `change` applied to its text, and the original siblings.
    Leaves are dealt by superblocks of 4,096 consecutive ones of a source, so no task holds a whole source: one applyInPandas
    gives the superblocks' roots, joins of small tables the outer levels, and one cogroup of leaves and outer nodes the rest.
    Nulls count as `-`; repeated rows are leaves each; an only row is leaf, subroot and root with an empty proof; an empty
    table gives no rows. Other columns of docs are not read.
    """
    of = docs.schema["doc_id"].dataType
    rows = ranked(leaves_of(docs, tampered, change), ["source_key"], ["doc_id", "leaf", "place"])
    rows = rows.select("source_key", F.expr(f"pos div {BLOCK}").alias("block"), "pos", "n", "id", "leaf", "changed")
    blocks = materialize(rows.select("source_key", "block", "pos", "n", "leaf").groupBy("source_key", "block").applyInPandas(_block_root, "source_key string, pos long, n long, node string"))
    inner, subroots = climb(blocks, ["source_key"])
    trees = ranked(subroots, [], ["source_key"]).withColumn("all", F.lit(0))
    upper, tops = climb(trees.select("all", "pos", "n", F.col("top").alias("node")), ["all"])
    of_source = trees.join(upper, ["all", "pos"]).join(F.broadcast(tops.withColumnRenamed("top", "root")), "all").select("source_key", F.col("top").alias("subroot"), "root", F.col("path").alias("more"))
    outer = inner.join(of_source, "source_key").select("source_key", F.col("pos").alias("block"), "subroot", "root", F.concat("path", "more").alias("path"))
    done = rows.groupBy("source_key", "block").cogroup(outer.groupBy("source_key", "block")).applyInPandas(
        _finish, "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )
    return done.select(F.col("id").cast(of).alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
