"""Operator 4: SpotSigs document fingerprints; DataFrame functions only."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.common import materialize
from roadloom.llm.components import components

#: Common words of English, German, French and Spanish that anchor a signature.
ANCHORS = """the of and to in is was for that with by as on at this it an are be or from
der die das und zu den von mit sich des auf als im dem ein nicht
le la les de des et du est un une dans que qui par pour pas sur
el los las del y en se por con una su para al lo como""".split()
#: Most ranges of doc_id, a power of two.
MOST_BUCKETS = 4096


def _factored(words) -> str:
    """A pattern of the words with shared beginnings written once, so that a mismatch is seen at its first letter."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        heads.setdefault(w[:1], []).append(w[1:])
    ends = heads.pop("", None)
    parts = [re.escape(c) + _factored(rest) for c, rest in heads.items()]
    body = parts[0] if len(parts) == 1 and ends is None else f"(?:{'|'.join(parts)})" if parts else ""
    return f"(?:{body})?+" if ends is not None and parts else body


def add_signatures(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds sorted distinct 64-bit hashes of signatures: an anchor word and the next two words that are no anchors.

    A text without any has one signature, of its words as a whole. Each step is a projection of its own, so that
    nothing is computed twice.
    """
    df = df.withColumn("__plain", F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" ")))
    # anchors are joined to what stands before them by "_", so runs of them have no space and need no nested repetition
    marked = F.regexp_replace("__plain", f" ({_factored(ANCHORS)})(?= )", "_$1")
    df = df.withColumn("__found", F.regexp_extract_all(marked, F.lit("_(?=([^ _]+[^ ]*+ [^ _]+[^ ]*+ [^ _]+))"), F.lit(1)))
    chain = F.transform("__found", lambda s: F.xxhash64(F.regexp_replace(s, "_[^ _]+", "")))
    sigs = F.when(F.size("__found") > 0, F.array_sort(F.array_distinct(chain))).otherwise(F.array(F.xxhash64(F.lit("#"), "__plain")))
    return df.withColumn(name, sigs).drop("__plain", "__found")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets."""
    both = F.size(F.array_intersect(a, b))
    return F.when(a == b, F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both)).cast("double")


def fingerprint(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda s: F.hex(s)), "")


def ranges(docs: DataFrame) -> Column:
    """The number of doc_id's range; null for a null one. Bounds are quantiles, so ranges hold about as many rows each.

    The bounds are found by halving; they only need to be in order, so rounded ones part the rows as well.
    """
    n = docs.agg(F.count("doc_id")).first()[0]
    steps = [1]
    while 2 * steps[0] < min(MOST_BUCKETS, n // 128):
        steps.insert(0, 2 * steps[0])
    many = 2 * steps[0]
    bounds = docs.agg(F.percentile_approx("doc_id", [i / many for i in range(1, many)], 20 * many)).first()[0] or [0]
    halve = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.element_at(F.lit(bounds), at + step) <= F.col("doc_id"), at + step).otherwise(at))
    return F.when(F.col("doc_id").isNotNull(), halve).cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, sigs and those of the next document by doc_id (next_text, next_sigs; after the last, the first).

    Documents are dealt once by ranges of doc_id; the first document of each range is also sent to the range before it.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bucket = ranges(docs)
    firsts = docs.where("doc_id is not null").groupBy(bucket.alias("bucket")).agg(F.min("doc_id").alias("first_id"))
    order = Window.partitionBy().orderBy("bucket")
    ends = Window.partitionBy().orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("first_id", F.coalesce(F.lag("bucket").over(order), F.last("bucket").over(ends)).alias("before"))
    sent = docs.join(F.broadcast(firsts), docs.doc_id == firsts.first_id, "left").select(
        "doc_id", "text", F.explode(F.when(F.col("before").isNull(), F.array(F.struct(bucket.alias("bucket"), F.lit(0).alias("guest")))).otherwise(
            F.array(F.struct(bucket.alias("bucket"), F.lit(0).alias("guest")), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("guest"))))).alias("to"),
    ).select("doc_id", "text", "to.bucket", "to.guest")
    dealt = add_signatures(sent.repartition("bucket"), F.col("text"), "sigs")
    near = Window.partitionBy("bucket").orderBy("guest", "doc_id", "text")
    return dealt.withColumn("next_text", F.lead("text").over(near)).withColumn("next_sigs", F.lead("sigs").over(near)).where("guest = 0").drop("guest", "bucket")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Per document: n_chars, edited text's SHA-256, fingerprints, and likeness to the edited and to the next text.

    The last floor(n/2) code points are replaced by as many of the next document's first ones (all, if it has fewer).
    A null text counts as empty; a null doc_id stands first; repeated ids follow each other; no rows give no rows.
    """
    t = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    edited = F.concat(F.expr("left(text, cast(n_chars - floor(n_chars / 2) as int))"), F.coalesce(F.expr("left(next_text, cast(floor(n_chars / 2) as int))"), F.lit("")))
    t = add_signatures(t.withColumn("edited", edited), F.col("edited"), "edited_sigs")
    return t.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.coalesce("next_sigs", "sigs")).alias("near_next"),
    )


def near_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, likeness) of class representatives a < b with likeness >= least, compared through pruned Jaccard.

    Equal signature sets are one class (its smallest doc_id). Sets are partitioned by length, each partition reaching from
    a length to that length / least: two sets so alike lie in one partition or in neighbours, so a set goes to its own and,
    as a guest, to the next one. There it sends its rarest n - ceil(least * n) + 1 signatures; sets meet on a signature of
    one partition where the shorter has at least least * the longer's length, and guests don't meet each other.
    """
    full = add_signatures(docs.where("doc_id is not null").select("doc_id", "text"), F.coalesce("text", F.lit("")), "sigs")
    sets = materialize(full.groupBy("sigs").agg(F.min("doc_id").alias("doc_id")))
    sets = sets.select("doc_id", "sigs", F.size("sigs").alias("n"))
    parts = sets.select("doc_id", "n", F.explode("sigs").alias("sig"))
    seen = parts.groupBy("sig").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "sig"))
    partition = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(least)) + 1e-9).cast("int")
    heads = materialize(parts.join(seen.where("df > 1"), "sig", "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("rank", rank).where(
        (F.col("rank") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1) & (F.col("df") > 1)).select("doc_id", "n", "sig", partition.alias("own")))
    a = heads.withColumn("part", F.explode(F.array("own", F.col("own") + 1))).alias("a")
    b = heads.withColumn("part", F.col("own")).alias("b")
    near = (F.col("a.sig") == F.col("b.sig")) & (F.col("a.part") == F.col("b.part")) & (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * least - 1e-9)
    once = (F.col("a.own") < F.col("b.own")) | (F.col("a.own") == F.col("b.own")) & (F.col("a.doc_id") < F.col("b.doc_id"))
    pairs = a.join(b, near & once).select(F.least("a.doc_id", "b.doc_id").alias("a"), F.greatest("a.doc_id", "b.doc_id").alias("b")).distinct()
    full = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("sigs").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("sigs").alias("sb")), "b")
    return full.select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness")).where(F.col("likeness") >= least)


def near_members(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, class_id, copies, n_links, component_id for every row of docs with a doc_id, beside the pairs of near_duplicates.

    class_id is the smallest doc_id with an equal signature set, copies the number of rows that have it; n_links counts the
    other rows with likeness >= least, exact copies too; component_id is the smallest doc_id that links lead to.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    key = F.sha2(fingerprint(F.col("sigs")).cast("binary"), 256)
    rows = materialize(add_signatures(docs, F.coalesce("text", F.lit("")), "sigs").select("doc_id", key.alias("key")))
    classes = materialize(rows.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies")))
    pairs = materialize(near_duplicates(docs, least).select("a", "b"))
    both = pairs.union(pairs.select("b", "a")).toDF("class_id", "other")
    links = both.join(classes.select(F.col("class_id").alias("other"), "copies"), "other").groupBy("class_id").agg(F.sum("copies").alias("links"))
    part = components(pairs).select(F.col("node").alias("class_id"), "component")
    known = classes.join(links, "class_id", "left").join(part, "class_id", "left")
    known = known.select("key", "class_id", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class_id").alias("component_id"))
    return rows.join(known, "key").drop("key")
