"""Facility sources as one table, coordinates by address, and reports on what was loaded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Columns of the common facility table.
FACILITY = ("kind", "ref", "lat", "lon", "height_m", "width_m", "weight_t")


def facilities(**sources: DataFrame) -> DataFrame:
    """The sources (bridge, tunnel, underpass, width, ..) under one schema; columns that a source lacks are null."""
    if not sources:
        raise ValueError("no facility source given")
    types = {c: "double" for c in FACILITY} | {"kind": "string", "ref": "string"}
    parts = [df.withColumn("kind", F.lit(kind)) for kind, df in sources.items()]
    parts = [p.select(*[(F.col(c) if c in p.columns else F.lit(None)).cast(types[c]).alias(c) for c in FACILITY]) for p in parts]
    return reduce(DataFrame.unionByName, parts)


def attach_coords(rows: DataFrame, geocodes: DataFrame) -> DataFrame:
    """rows (start_address, end_address) with lat, lon halfway between both ends; rows with an end unknown are dropped.

    geocodes (address, lat, lon) may repeat an address; its least row counts. Places without lat or lon don't.
    """
    g = geocodes.where("address is not null and lat is not null and lon is not null").groupBy("address").agg(F.min(F.struct("lat", "lon")).alias("at"))
    for side in ("start", "end"):
        rows = rows.join(g.select(F.col("address").alias(f"{side}_address"), F.col("at").alias(f"{side}_at")), f"{side}_address")
    middle = lambda c: ((F.col(f"start_at.{c}") + F.col(f"end_at.{c}")) / 2).alias(c)
    keep = [c for c in rows.columns if c not in ("start_at", "end_at", "lat", "lon")]
    return rows.select(*keep, middle("lat"), middle("lon"))


def facility_report(all_facilities: DataFrame, matches: DataFrame) -> DataFrame:
    """By kind: fetched, no_value (neither height, width nor weight), matched and unmatched of those with a value."""
    m = matches.select(F.col("kind"), F.col("ref"), F.lit(True).alias("hit")).distinct()
    value = F.coalesce("height_m", "width_m", "weight_t").isNotNull()
    j = all_facilities.join(m, ["kind", "ref"], "left")
    hit = F.col("hit").isNotNull()
    return j.groupBy("kind").agg(F.count("*").alias("fetched"), F.count_if(~value).alias("no_value"), F.count_if(value & hit).alias("matched"), F.count_if(value & ~hit).alias("unmatched"))


def check_catalog(pages: DataFrame) -> DataFrame:
    """One row of counts and `complete` for catalogue pages (asked_page, page, total, stop_id, payload; one row a stop).

    A page without stops is one row with a null stop_id and a null payload.
    """
    page = pages.groupBy("asked_page").agg(
        F.count("payload").alias("n"), F.bool_and(F.col("page").eqNullSafe(F.col("asked_page"))).alias("as_asked"), F.min("total").alias("lo"), F.max("total").alias("hi"),
        F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("payload"))), 256).alias("digest"))
    by_page = page.groupBy("digest").agg(F.count("*").alias("same"), F.sum("n").alias("n"), F.count_if(F.col("n") == 0).alias("empty"), F.count_if(~F.col("as_asked")).alias("misnumbered"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    p = by_page.agg(F.sum("n").alias("rows"), F.sum("empty").alias("empty_pages"), F.sum("misnumbered").alias("misnumbered_pages"), F.sum(F.when(F.col("n") > 0, F.col("same") - 1).otherwise(0)).alias("repeated_pages"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    rows = pages.where("payload is not null").groupBy(F.sha2("payload", 256)).agg(F.count("*").alias("c"), F.count_if(F.coalesce(F.trim("stop_id"), F.lit("")) == "").alias("blank"))
    r = rows.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("overlapping_rows"), F.coalesce(F.sum("blank"), F.lit(0)).alias("blank_ids"))
    faults = F.col("empty_pages") + F.col("misnumbered_pages") + F.col("repeated_pages") + F.col("overlapping_rows") + F.col("blank_ids")
    whole = (faults == 0) & (F.col("lo") == F.col("hi")) & (F.col("rows") == F.col("hi"))
    return p.crossJoin(r).select("rows", F.col("hi").alias("total"), "empty_pages", "misnumbered_pages", "repeated_pages", "overlapping_rows", "blank_ids", F.coalesce(whole, F.lit(False)).alias("complete"))


def append_rows(new: DataFrame, id_column: str, after: int, *order: str, buckets: int = 256) -> DataFrame:
    """New rows with ids from after + 1 without gaps, and READY where trip_status is missing or null.

    Rows are numbered in hash buckets of the `order` columns (name unique ones) and shifted by the counts of the buckets
    before, so that no task numbers them all and a task that runs again gives the same ids.
    """
    rows = new.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    n = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    shift = n.select("bucket", F.coalesce(before, F.lit(0)).alias("shift"))  # one row a bucket
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(*order))
    df = rows.withColumn("rank", rank).join(F.broadcast(shift), "bucket").withColumn(id_column, F.lit(after) + F.col("shift") + F.col("rank"))
    status = F.coalesce(F.col("trip_status"), F.lit("READY")) if "trip_status" in new.columns else F.lit("READY")
    return df.withColumn("trip_status", status).drop("bucket", "rank", "shift")
