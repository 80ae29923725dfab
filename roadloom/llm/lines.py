"""Operator 9: removal of later copies of repeated line runs, found by distributed prefix doubling over line ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.common import Roll, bit_table, bytes_of, chunks, join_counted, map_batches, materialize, pick, with_hits, word_spans

_WORDS = 50
#: A document is told by its id and the hash of its text, so rows may repeat an id.
DOC = ["doc_id", "sig"]


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, sig, at, line, key, words): place among the non-blank lines, line number, 64-bit id of the line, its words."""

    def run(batches):
        roll = Roll(3)
        for batch in chunks(batches):
            ids, sigs, texts = pick(batch, "doc_id", "sig", "text")
            data, offsets = bytes_of(texts)
            breaks = np.flatnonzero(data == 10)
            starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
            starts = starts[starts < len(data)]
            ends = np.minimum(np.append(starts[1:], len(data)), np.append(breaks, len(data))[np.searchsorted(breaks, starts)])
            doc = np.searchsorted(offsets, starts, side="right") - 1
            word, _, _ = word_spans(data, offsets)
            words = np.searchsorted(word, ends) - np.searchsorted(word, starts)
            number = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[doc])
            full = words > 0
            starts, ends, doc, words, number = (x[full] for x in (starts, ends, doc, words, number))
            keys = roll.spans(roll.sums(data), starts, ends)
            at = np.arange(len(doc)) - np.searchsorted(doc, doc)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(doc)), sigs.take(pa.array(doc)), pa.array(at.astype(np.int32)), pa.array(number.astype(np.int32)), pa.array(keys.view(np.int64)), pa.array(words.astype(np.int32))],
                [*DOC, "at", "line", "key", "words"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", F.xxhash64("text").alias("sig"), "text"), run, f"doc_id {kind}, sig long, at int, line int, key long, words int")


def repeated(blocks: DataFrame) -> DataFrame:
    """Blocks (a written table) whose key occurs more than once, with `later`: another place that holds the key comes before.

    The place of the first copy is a partial aggregate and a very common key meets it by broadcast: no copies are gathered.
    """
    place = F.struct(*DOC, "at")
    firsts = materialize(blocks.groupBy("key").agg(F.count("*").alias("copies"), F.min(place).alias("first")).where("copies > 1"))
    return join_counted(blocks, firsts, ["key"], "copies").withColumn("later", place > F.col("first")).drop("first", "copies")


def doubled(blocks: DataFrame, step: int, size: int) -> DataFrame:
    """Blocks of `size` lines from repeated blocks that lie `step` lines apart in one document."""
    w = Window.partitionBy(*DOC).orderBy("at")
    if step == 1:
        pair = blocks.dropDuplicates([*DOC, "at"])  # repeated rows
        for c in ("at", "key", "words", "lines"):
            pair = pair.withColumn(f"next_{c}", F.lead(c, 1).over(w))
        pair = pair.where(F.col("next_at") == F.col("at") + 1)
    else:
        other = blocks.select(*DOC, (F.col("at") - step).alias("at"), F.col("key").alias("next_key"), F.col("words").alias("next_words"), F.col("lines").alias("next_lines"))
        pair = blocks.join(other, [*DOC, "at"])
    overlap = 2 * step != size
    merged = F.array_distinct(F.concat("lines", "next_lines"))
    total = F.aggregate(merged, F.lit(0), lambda a, x: a + x["words"]) if overlap else F.col("words") + F.col("next_words")
    return pair.select(*DOC, "at", F.xxhash64(F.lit(size), "key", "next_key").alias("key"), total.alias("words"), merged.alias("lines"))


def removed_lines(docs: DataFrame, min_lines: int = 3, min_words: int = _WORDS) -> DataFrame:
    """(doc_id, sig, line): lines of later copies of repeated runs of `min_lines` non-blank lines, or of `min_words` words.

    The names of blocks of 1, 2, 4 .. lines are doubled as in the building of a suffix array, over the documents' line
    ids; only equality of names is needed, so a name is a hash, not a rank, and no global sort is run. A block that
    occurs again is part of a maximal repeated run (an interval of the longest-common-prefix array of that height or
    more), and the union of such blocks that are not the first copy is what is deleted. A place whose line occurs once
    in the corpus ends every run and leaves after the first round.
    """
    size = 1
    blocks = materialize(line_table(docs.where("doc_id is not null")))
    blocks = materialize(repeated(blocks.withColumn("lines", F.array(F.struct("line", "words"))).drop("line")))
    parts = []
    while size < min_lines:
        parts.append(blocks.where((F.col("words") >= min_words) & F.col("later")))
        step = min(size, min_lines - size)
        size += step
        blocks = materialize(repeated(materialize(doubled(blocks.drop("later"), step, size))))
    parts.append(blocks.where("later"))
    out = parts[0].select(*DOC, "lines")
    for p in parts[1:]:
        out = out.union(p.select(*DOC, "lines"))
    return out.select(*DOC, F.explode("lines").alias("l")).select(*DOC, "l.line").distinct()


def _rest(text: Column, gone: Column) -> Column:
    """The text without the lines of the sorted array gone: the slices between its runs."""
    lines = F.split(text, "\n", -1)
    starts = F.filter(gone, lambda x, i: (i == 0) | (F.get(gone, i - 1) != x - 1))
    ends = F.filter(gone, lambda x, i: (i == F.size(gone) - 1) | (F.get(gone, i + 1) != x + 1))

    def between(i):
        lo = F.when(i == 0, 0).otherwise(F.get(ends, i - 1) + 1)
        return F.slice(lines, lo + 1, F.coalesce(F.get(starts, i), F.size(lines)) - lo)

    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(starts)), between)), "\n")


def dedup_lines(docs: DataFrame, min_lines: int = 3, min_words: int = _WORDS) -> DataFrame:
    """All columns of docs; text without the later copies of repeated line runs; n_lines, n_removed (columns of these names are replaced).

    The first copy by (doc_id, line) stays. Blank lines are no part of a run and stay. Null texts stay null with 0
    lines; rows with a null doc_id stay as they are; equal rows lose the same lines, rows that repeat a doc_id with other
    texts are documents of their own; an empty table gives no rows. A text is rebuilt from all its lines, whatever its
    length. Only texts that lose lines (and what a bit table takes for them) are moved; the others stay in their tasks.
    """
    gone = removed_lines(docs, min_lines, min_words).groupBy(*DOC).agg(F.sort_array(F.collect_list("line")).alias("gone"))
    gone = materialize(gone.withColumnRenamed("doc_id", "id"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("sig"))
    rows = with_hits(rows, bit_table(gone, "id"), "id")
    some = rows.where("hit__").join(gone, ["id", "sig"], "left").select("row", "gone")
    out = rows.where("not hit__").select("row", F.lit(None).cast("array<int>").alias("gone")).unionByName(some)
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(_rest(F.col("row.text"), F.col("gone")))
    n_lines = F.when(F.length("row.text") > 0, F.length("row.text") - F.length(F.replace("row.text", F.lit("\n"))) + 1).otherwise(0)
    columns = [text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names]
    return out.select(*columns, n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
