"""Operator 13: how filters interact, by a Gray-code walk over their subsets."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import WORD, join_counted, materialize

#: Fixed letters of the filters, in the order of their bits.
LETTERS = "ABCDE"


def text_failures(text: Column) -> list[tuple[str, Column]]:
    """(letter, whether a text fails) of the filters that look at the text alone; text is never null.

    A: under 200 words. B: distinct words under half of all. C: capitals A-Z over 3 of 100 code points. D: any of # $ % & * |.
    """
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)
    n = F.size(words)
    return [
        ("A", n < 200), ("B", 100 * F.size(F.array_distinct(words)) < 50 * n),
        ("C", 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text)), ("D", F.regexp_like(text, F.lit("[#$%&*|]"))),
    ]


def _bit(letter: str) -> int:
    return 1 << LETTERS.index(letter)


def failures(docs: DataFrame) -> DataFrame:
    """part, doc_id, mask (a bit for each filter that a row fails) and how many rows are so, written once.

    Filter E, a text that a smaller doc_id has, compares digests: the smallest doc_id of each comes from partial aggregates,
    and is joined so that no task gets all rows of a very common text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    mask = sum((F.when(fails, _bit(letter)).otherwise(0) for letter, fails in text_failures(text)), F.lit(0))
    part = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    rows = materialize(docs.select("doc_id", part.alias("part"), mask.alias("bits"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")))
    first = materialize(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")))
    again = F.when(F.col("doc_id") > F.col("first"), _bit("E")).otherwise(0)
    return materialize(join_counted(rows, first, ["digest"], "copies").groupBy("part", "doc_id", (F.col("bits") + again).alias("mask")).agg(F.count("*").alias("rows")))


def cells(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, docs, good, toxic: rows that fail just the filters of a mask, those labelled quality=1, those toxic=1.

    A doc_id with several labels is good if any says so, and toxic likewise; one without counts as neither.
    """
    some = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    j = failed.join(some, "doc_id", "left")
    count = lambda c: F.sum(F.when(F.col(c), F.col("rows")).otherwise(0)).alias(c)
    return j.groupBy("part", "mask").agg(F.sum("rows").alias("docs"), count("good"), count("toxic"))


def walk(masks: np.ndarray, counts: np.ndarray, filters: int) -> np.ndarray:
    """Survivors (2**filters, columns of counts) of every subset of the filters, by its bits.

    Subsets follow each other in Gray code, so one filter is switched at a time: the cells that fail it have one active
    failure more or less, and those that leave or come back to none change the running survivors.
    """
    states = np.zeros((1 << filters, counts.shape[1]), np.int64)
    active, alive, subset = np.zeros(len(masks), np.int64), counts.sum(0), 0
    states[0] = alive
    for i in range(1, 1 << filters):
        f = (i & -i).bit_length() - 1
        subset ^= 1 << f
        hit = masks >> f & 1 == 1
        if subset >> f & 1:
            alive = alive - counts[hit & (active == 0)].sum(0)
            active[hit] += 1
        else:
            active[hit] -= 1
            alive = alive + counts[hit & (active == 0)].sum(0)
        states[subset] = alive
    return states


def steps(states: np.ndarray, letters: str) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every order's every step."""
    every, out, sums = (1 << len(letters)) - 1, [], np.zeros(len(letters), np.int64)
    for order in permutations(range(len(letters))):
        before = 0
        for step, f in enumerate(order, 1):
            gone = states[before] - states[before | 1 << f]
            sums[f] += gone[0]
            fails, only = states[0][0] - states[1 << f][0], states[every ^ 1 << f][0] - states[every][0]
            before |= 1 << f
            out.append(("".join(letters[i] for i in order), step, f, states[before][0], gone[0], fails - gone[0], only, gone[1], gone[2]))
    return [(*r[:2], *r[3:], sums[r[2]]) for r in out]


COLUMNS = ("filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _part(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    states = walk(rows["mask"].to_numpy(), rows[["docs", "good", "toxic"]].to_numpy(np.int64), len(LETTERS))
    out = pd.DataFrame(steps(states, LETTERS), columns=COLUMNS)
    out.insert(0, "part", key[0])
    return out


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One row for each part (language; null is the empty string), each of the 120 orders of the five filters and each step,
    zeros included. The corpus is only counted: rows become at most 32 cells a part (languages x masks), with partial
    aggregates before every shuffle; each part's walk is one task over its cells.
    A null text counts as empty; a null doc_id never fails E and makes no other fail; repeated rows count each, and don't
    fail E by each other as neither id is smaller; an empty table gives no rows. Other columns are not read.
    """
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COLUMNS[2:])
    return cells(failures(docs), labels).groupBy("part").applyInPandas(_part, schema)
