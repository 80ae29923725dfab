"""Stop matching, completeness reports, fleet statistics and data-quality checks."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions.scalars import ars_id
from roadloom.sources.scratch import materialize


def match_stops(stops: DataFrame, catalog: DataFrame, ids: bool = False) -> DataFrame:
    """line_no, stop_index -> method and bstopid, or a reason. By ARS number if there is one, else by node id.

    With ids also the stop's own number and node id (ars, node), as they were looked up.

    A node id must agree where both exist; equal catalogue rows count once; a number that finds nothing does not fall back.
    The catalogue is counted by number, by number and node id, and by node id; a stop meets one row of these, not all
    catalogue rows of its number.
    """
    valid = F.col("gpsy").isNotNull() & F.col("gpsx").isNotNull() & (F.col("gpsy") != 0) & (F.col("gpsx") != 0) & F.col("gpsy").between(-90, 90) & F.col("gpsx").between(-180, 180)
    c = catalog.select(ars_id(F.col("arsno")).alias("ars"), F.trim("bstopid").alias("bstopid"), "gpsy", "gpsx").distinct().where("bstopid is not null").withColumn("valid", valid)
    counts = F.count("*").alias("left"), F.max("valid").alias("valid")
    number = c.groupBy("ars").agg(F.max("bstopid").alias("bstopid"), *counts)
    both = c.groupBy("ars", F.col("bstopid").alias("node")).agg(*counts)
    by_node = c.groupBy(F.col("bstopid").alias("node")).agg(*counts)
    key = ["line_no", "stop_index", "ars", "node"]
    s = stops.select("line_no", "stop_index", ars_id(F.col("ars_number")).alias("ars"), F.trim("node_id").alias("node")).groupBy(*key).agg(F.count("*").alias("rows"))
    one = s.where("ars is not null and node is null").join(number, "ars", "left").withColumn("found", F.col("left"))
    two = s.where("ars is not null and node is not null").join(number.select("ars", F.col("left").alias("found")), "ars", "left").join(both, ["ars", "node"], "left")
    three = s.where("ars is null").join(by_node, "node", "left").withColumn("found", F.col("left"))
    columns = [*key, F.coalesce("found", F.lit(0)).alias("found"), (F.coalesce("left", F.lit(0)) * F.col("rows")).alias("left"), "bstopid", "valid"]
    g = one.select(*columns)
    for more in (two, three):
        g = g.unionByName(more.withColumn("bstopid", F.col("node")).select(*columns))
    reason = F.when(F.col("found") == 0, "not_found").when(F.col("left") == 0, "identifier_conflict").when(F.col("left") > 1, "ambiguous_match").when(~F.col("valid"), "invalid_static_coordinates")
    g = g.withColumn("reason", reason)
    method = F.when(F.col("reason").isNull(), F.when(F.col("ars").isNotNull(), "ars_number").otherwise("node_id"))
    own = ["ars", "node"] if ids else []
    return g.select("line_no", "stop_index", *own, method.alias("method"), F.when(F.col("reason").isNull(), F.col("bstopid")).alias("bstopid"), "reason")


def match_report(matches: DataFrame) -> DataFrame:
    """Of match_stops with ids: one row for all stops (level all), one for each line, and one for each unresolved stop with its reason.

    The unresolved stops are rows, not a list in the row of their line, as a line may have any number of them.
    """
    matches = materialize(matches)
    lines = matches.groupBy("line_no").agg(F.count("*").alias("total"), F.count_if(F.col("reason").isNull()).alias("matched"))
    whole = lines.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "matched")])
    sums = lines.withColumn("level", F.lit("line")).unionByName(whole.withColumn("level", F.lit("all")), allowMissingColumns=True)
    sums = sums.withColumn("unresolved", F.col("total") - F.col("matched")).withColumn("complete", F.col("unresolved") == 0)
    left = matches.where("reason is not null").select(F.lit("stop").alias("level"), "line_no", "stop_index", "ars", "node", "reason")
    every = sums.unionByName(left, allowMissingColumns=True)
    return every.select("level", "line_no", "stop_index", "ars", "node", "reason", "total", "matched", "unresolved", "complete")


def class_share(events: DataFrame) -> DataFrame:
    """Risk events and mean distance by class, and the class's share of all."""
    g = events.groupBy("class_name").agg(F.count("*").alias("events"), F.avg("distance_m").alias("mean_m"))
    total = events.agg(F.count("*").alias("total"))
    return g.crossJoin(F.broadcast(total)).select("class_name", "events", "mean_m", (F.col("events") / F.col("total")).alias("share"))


def frame_totals(detections: DataFrame, masked: Column) -> DataFrame:
    """Items of each frame, and those with a mask."""
    return detections.groupBy("session_id", "frame_id").agg(F.count("*").alias("items"), F.count_if(masked).alias("masks"))


def clusters(events: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """events (lat, lng) with the cluster of each and its centre; rows without a point are left out. Needs a row at least."""
    points = VectorAssembler(inputCols=["lat", "lng"], outputCol="at__").transform(events.where("lat is not null and lng is not null"))
    model = KMeans(k=k, seed=seed, featuresCol="at__", predictionCol="cluster").fit(points)
    centres = F.array(*[F.struct(F.lit(float(c[0])).alias("lat"), F.lit(float(c[1])).alias("lng")) for c in model.clusterCenters()])
    return model.transform(points).drop("at__").withColumn("centre", F.element_at(centres, F.col("cluster") + 1))


def daily_risk(events: DataFrame, warning: float = 5.0) -> DataFrame:
    day = F.date_format("detected_at", "yyyy-MM-dd").alias("day")
    return events.where(F.col("distance_m") < warning).groupBy(day, "class_name").agg(F.count("*").alias("events"), F.avg("distance_m").alias("mean_m"), F.countDistinct("vehicle_id").alias("vehicles"))


def goal_metrics(goals: DataFrame, now: str) -> DataFrame:
    late = (F.col("goal_status") != "COMPLETED") & (F.col("target_eta") < F.lit(now).cast("timestamp_ntz"))
    done = F.count_if(F.col("goal_status") == "COMPLETED")
    return goals.groupBy("assigned_vehicle_id").agg(F.count("*").alias("total"), done.alias("completed"), F.count_if(F.col("goal_status") == "IN_PROGRESS").alias("in_progress"), F.count_if(late).alias("delayed"), (done / F.count("*")).alias("ratio"))


def heatmap(points: DataFrame, size: float) -> DataFrame:
    return points.groupBy(F.floor(F.col("lat") / size).alias("cy"), F.floor(F.col("lng") / size).alias("cx")).agg(F.count("*").alias("n"), F.avg("speed_kmh").alias("mean_kmh"))


def build_alerts(events: DataFrame, trips: DataFrame, deviated: DataFrame, critical_m: float = 1000.0) -> DataFrame:
    """Alerts of near objects, of routes left and of completed trips: one cause each, of which cause_id is the id.

    deviated: vehicle_id, deviation_id, distance_m of positions at or over the threshold (operator `deviations`).
    """
    off = deviated.select("vehicle_id", F.col("deviation_id").alias("cause_id"), F.lit("ROUTE_DEVIATION").alias("alert_type"), F.when(F.col("distance_m") >= critical_m, "CRITICAL").otherwise("WARNING").alias("severity"))
    near = events.where("distance_m < 5").select("vehicle_id", F.col("detection_event_id").alias("cause_id"), F.lit("OBJECT_PROXIMITY").alias("alert_type"), F.when(F.col("distance_m") < 2, "CRITICAL").otherwise("WARNING").alias("severity"))
    done = trips.where("trip_status = 'COMPLETED'").select("vehicle_id", F.col("trip_id").alias("cause_id"), F.lit("TRIP_COMPLETED").alias("alert_type"), F.lit("INFO").alias("severity"))
    return near.unionByName(off).unionByName(done)


def check_table(df: DataFrame, key: str, rules: dict[str, str], unique: list[str] | None = None, parents: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """(rule, key) of each violation: rows where a rule is not true, repeated unique keys, values without a parent."""
    bad = [df.where(f"not coalesce({sql}, false)").select(F.lit(name).alias("rule"), F.col(key).cast("string").alias("key")) for name, sql in rules.items()]
    for c in unique or []:
        bad.append(df.groupBy(c).count().where("count > 1").select(F.lit(f"unique:{c}").alias("rule"), F.col(c).cast("string").alias("key")))
    for c, (parent, pk) in (parents or {}).items():
        bad.append(df.where(F.col(c).isNotNull()).join(parent.select(F.col(pk).alias(c)).distinct(), c, "left_anti").select(F.lit(f"foreign:{c}").alias("rule"), F.col(key).cast("string").alias("key")))
    out = bad[0]
    for b in bad[1:]:
        out = out.unionByName(b)
    return out
