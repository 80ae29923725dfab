"""Operator 2: mixing sources to target weights with hash-threshold histograms; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.common import WORD, materialize

#: Bits of the hash that each histogram level reads, and the bits of the whole hash.
LEVEL_BITS, HASH_BITS = 10, 60


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: list[int], share: float, cap: float) -> DataFrame:
    """(source, source_size) -> adds target: `share` of all sizes by weight, none above cap * source_size.

    Weights repeat over the sources in code point order, null last. Sources sorted by cap / weight fill up first;
    the rest share what is left by weight (water filling in closed form). Only the table of sources is ordered.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order % len(weights) + 1).cast("int"))
    s = sources.withColumn("w", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before, rest, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    s = s.withColumn("left", F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / F.sum("w").over(rest)).withColumn("open", F.col("level") * F.col("w") < F.col("most"))
    level = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return s.withColumn("target", F.coalesce(F.least(F.col("most"), level * F.col("w")), F.col("most"))).select("source", "source_size", "target")


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, source_size, target, rounds, below): every document is taken `rounds` times, once more if its hash < below.

    Level by level the sizes are summed by (source, next 10 hash bits); the running sum finds the bucket that holds the
    goal, and only that bucket is summed at the next level. What the last level leaves is within one document.
    """
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = goals.withColumn("rounds", rounds).withColumn("goal", F.col("target") - F.col("rounds") * F.col("source_size"))
    state = state.withColumn("below", F.lit(0).cast("long")).withColumn("done", F.lit(0.0))
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        here = sized if shift == HASH_BITS - LEVEL_BITS else _boundary(sized, state, shift + LEVEL_BITS)
        bins = here.groupBy("source", F.shiftright("h", shift).alias("bin")).agg(F.sum("size").alias("mass"))
        running = F.sum("mass").over(Window.partitionBy("source").orderBy("bin"))
        bins = bins.withColumn("upto", running).join(state.select(F.col("source").alias("s"), "goal", F.col("done").alias("base")), F.col("source").eqNullSafe(F.col("s")))
        fits = F.col("base") + F.col("upto") <= F.col("goal")
        step = bins.groupBy("source").agg(
            F.max(F.when(fits, F.col("upto"))).alias("add"),
            F.min(F.when(~fits, F.col("bin"))).alias("edge"),
            F.max("bin").alias("last"),
        ).withColumnRenamed("source", "s")
        state = state.join(step, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source", "source_size", "target", "rounds", "goal",
            F.when(F.col("last").isNull(), F.col("below")).otherwise(F.shiftleft(F.coalesce(F.col("edge"), F.col("last") + 1), shift)).alias("below"),
            (F.col("done") + F.coalesce("add", F.lit(0))).alias("done"),
        )
        state = materialize(state)
    return state.select("source", "source_size", "target", "rounds", "below")


def _boundary(sized: DataFrame, state: DataFrame, bits: int) -> DataFrame:
    edge = state.select(F.col("source").alias("s"), F.shiftright("below", bits).alias("edge"))
    return sized.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", bits) == F.col("edge"))).select("source", "h", "size")


def place(salt: int) -> Column:
    """A 60-bit hash of doc_id."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(salt), F.col("doc_id")), 64 - HASH_BITS)


def _marks(sized: DataFrame, weights, share: float, cap: float) -> DataFrame:
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), list(weights), share, cap)
    return thresholds(sized, materialize(goals))


def with_copies(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, salt: int = 0) -> DataFrame:
    """All columns of docs and __copies (one of that name is replaced), how often the mix takes the row (0, 1 or 2).

    Texts are not moved: only the small table of sources is joined. Nulls and repeated rows are as in mix_sources.
    """
    sized = materialize(docs.select("source", word_count("text").alias("size"), place(salt).alias("h")))
    marks = _marks(sized, weights, share, cap).select(F.col("source").alias("s"), "rounds", "below")
    names = [c for c in docs.columns if c != "__copies"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("source").alias("key"), place(salt).alias("h"))
    copies = (F.col("rounds") + (F.col("h") < F.col("below")).cast("long")).cast("int").alias("__copies")
    return rows.join(marks, F.col("key").eqNullSafe(F.col("s"))).select(*[F.col(f"row.`{c}`").alias(c) for c in names], copies)


def mix_sources(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, salt: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every document (one row each).

    A null or empty text has size 0 and takes 0; a null source is a source of its own, last in order; repeated rows
    count each; an empty table gives no rows. Other columns of docs are not read. The same rows and salt give the same mix.
    """
    sized = materialize(docs.select("doc_id", "source", word_count("text").alias("size"), place(salt).alias("h")))
    marks = _marks(sized, weights, share, cap).withColumnRenamed("source", "s")
    copies = (F.col("rounds") + (F.col("h") < F.col("below")).cast("long")).alias("copies")
    return sized.join(marks, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "source", "size", "source_size", "target", copies
    ).withColumn("taken", F.col("size") * F.col("copies"))
