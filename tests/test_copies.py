"""Copies at one place or under one number are met once, not each by each."""

import pytest
from pyspark.sql import functions as F

from roadloom.operators import feeds, history
from roadloom.operators import reference_data as ref
from roadloom.operators import roadnet as road


def most_rows(df) -> int:
    """The most rows that any step of the plan has given, after a run."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        inner = {"AdaptiveSparkPlanExec": "executedPlan", "ShuffleQueryStageExec": "plan", "BroadcastQueryStageExec": "plan", "ResultQueryStageExec": "plan"}.get(node.getClass().getSimpleName())
        if inner:
            todo.append(getattr(node, inner)())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_points_and_vertices_at_one_place(spark):
    points = spark.range(500).select(F.col("id").alias("point_id"), F.lit(35.0).alias("lat"), F.when(F.col("id") < 490, 128.0).otherwise(128.004).alias("lon"))
    vertices = spark.range(7, 507).select(F.col("id").alias("node_id"), F.lit(35.001).alias("lat"), F.when(F.col("id") < 500, 128.0).otherwise(128.004).alias("lon"))
    got = road.nearest_vertex(points, vertices)
    assert most_rows(got) < 10_000
    assert {(r.point_id, r.node_id) for r in got.collect()} == {(i, 7 if i < 490 else 500) for i in range(500)}


def test_facilities_and_ways_at_one_place(spark):
    ways = spark.range(1, 401).select(F.col("id").alias("way_id"), F.lit("primary").alias("highway"))
    ends = F.explode(F.array(F.struct(F.lit(0).alias("seq"), F.lit(1).alias("node_id")), F.struct(F.lit(1).alias("seq"), F.lit(2).alias("node_id")))).alias("e")
    refs = ways.select("way_id", ends).select("way_id", "e.seq", (F.col("e.node_id") + F.when(F.col("way_id") > 200, 0).otherwise(2)).alias("node_id"))
    nodes = spark.createDataFrame([(1, 35.0, 128.0), (2, 35.0, 128.01), (3, 35.0003, 128.0), (4, 35.0003, 128.01)], "node_id int, lat double, lon double")
    facilities = spark.range(300).select(F.col("id").alias("facility_id"), F.lit(35.0001).alias("lat"), F.when(F.col("id") < 290, 128.005).otherwise(128.05).alias("lon"))
    got = road.nearest_way(facilities, nodes, ways, refs)
    assert most_rows(got) < 20_000
    rows = got.collect()
    assert {(r.facility_id, r.way_id) for r in rows} == {(i, 201) for i in range(290)} and all(abs(r.distance_m - 11.132) < 1e-6 for r in rows)


def test_stops_and_catalogue_rows_of_one_number(spark):
    catalog = spark.range(600).select(F.lit("7").alias("arsno"), F.col("id").cast("string").alias("bstopid"), F.when(F.col("id") == 3, 0.0).otherwise(35.0).alias("gpsy"), F.lit(128.0).alias("gpsx"))
    stops = spark.range(400).select(F.lit(1).alias("line_no"), F.col("id").alias("stop_index"), F.lit("00007").alias("ars_number"), F.when(F.col("id") > 0, F.col("id") + F.when(F.col("id") == 9, 9000).otherwise(0)).cast("string").alias("node_id"))
    more = spark.createDataFrame([(2, 0, None, "5"), (2, 1, None, "x"), (2, 2, None, None), (2, 3, "8", "5"), (2, 4, "7", "6"), (2, 4, "7", "6")], "line_no int, stop_index long, ars_number string, node_id string")
    got = ref.match_stops(stops.union(more), catalog)
    assert most_rows(got) < 10_000
    at = {(r.line_no, r.stop_index): (r.method, r.bstopid, r.reason) for r in got.collect()}
    assert at[1, 0] == (None, None, "ambiguous_match") and at[1, 3] == (None, None, "invalid_static_coordinates") and at[1, 9] == (None, None, "identifier_conflict") and at[1, 8] == ("ars_number", "8", None)
    assert [at[2, i] for i in range(5)] == [("node_id", "5", None), (None, None, "not_found"), (None, None, "not_found"), (None, None, "not_found"), (None, None, "ambiguous_match")]
    assert len(at) == 405


def test_report_of_all_lines_and_unresolved_stops(spark):
    catalog = spark.createDataFrame([("7", "1", 35.0, 128.0), ("8", "2", 0.0, 128.0)], "arsno string, bstopid string, gpsy double, gpsx double")
    stops = spark.createDataFrame([(1, 0, "7", None), (1, 1, "8", None), (1, 2, None, "9"), (2, 0, " 7 ", "1")], "line_no int, stop_index int, ars_number string, node_id string")
    report = lambda s: {tuple(r) for r in ref.match_report(ref.match_stops(s, catalog, ids=True)).collect()}
    none = (None,) * 4
    assert report(stops) == {
        ("all", None, *none, 4, 2, 2, False), ("line", 1, *none, 3, 1, 2, False), ("line", 2, *none, 1, 1, 0, True),
        ("stop", 1, 1, "00008", None, "invalid_static_coordinates", *none), ("stop", 1, 2, None, "9", "not_found", *none),
    }
    assert report(stops.limit(0)) == {("all", None, *none, 0, 0, 0, True)}


def test_centers_at_one_place(spark):
    points = spark.range(600).select((F.col("id") % 3).alias("vehicle_id"), F.col("id").alias("position_id"), (F.col("id") % 150).alias("recorded_at"), F.when(F.col("id") < 599, 35.001).otherwise(36.0).alias("lat"), F.lit(128.0).alias("lng"))
    centers = spark.range(400).select(F.col("id").alias("center_id"), F.when(F.col("id") < 399, 35.0).otherwise(50.0).alias("center_lat"), F.lit(128.0).alias("center_lng"))
    got = history.within_radius(points, centers, 500.0)
    assert most_rows(got) < 10_000
    last = {v: max((i % 150, i) for i in range(599) if i % 3 == v)[1] for v in range(3)}
    assert {(r.center_id, r.vehicle_id, r.position_id) for r in got.collect()} == {(c, v, last[v]) for c in range(399) for v in range(3)}
    then = history.within_radius(points, centers, 500.0, "latest_then_radius").collect()
    assert {(r.center_id, r.vehicle_id) for r in then} == {(c, v) for c in range(399) for v in (0, 1)}


@pytest.mark.parametrize("places", [1 << 16, 7])
def test_pairs_near_centers_are_not_exchanged(spark, monkeypatch, places):
    monkeypatch.setattr(history, "PLACES", places, raising=False)
    points = spark.range(600).select((F.col("id") % 3).alias("vehicle_id"), F.col("id").alias("position_id"), (F.col("id") % 150).alias("recorded_at"), (35.0 + (F.col("id") % 20) / 1000).alias("lat"), F.lit(128.0).alias("lng"))
    centers = spark.range(40).select(F.col("id").alias("center_id"), (35.0 + (F.col("id") % 20) / 1000).alias("center_lat"), F.lit(128.0).alias("center_lng"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the centers were many
    try:
        got = history.within_radius(points, centers, 120.0)
        plan = got._jdf.queryExecution().executedPlan().toString()
        rows = got.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    last = {}
    for i in sorted(range(600), key=lambda i: (i % 150, i)):
        for c in range(40):
            if abs(i % 20 - c % 20) <= 1:
                last[c, i % 3] = i
    assert {(r.center_id, r.vehicle_id): r.position_id for r in rows} == last and len(rows) == len(last)


def test_fixes_at_one_place_are_looked_up_once(spark, monkeypatch):
    looked, inner = [], feeds.ring_nearest
    monkeypatch.setattr(feeds, "ring_nearest", lambda queries, *a, **k: looked.append(queries.count()) or inner(queries, *a, **k))
    trace = spark.createDataFrame([("L", "in", 0.0, 35.0, 128.0, 5.0), ("L", "in", 10.0, 35.0, 128.01, 5.0)], "line_no string, direction string, trace_time_s double, lat double, lng double, speed_kmh double")
    fixes = spark.range(300).select(F.col("id").alias("fix_id"), F.lit("L").alias("line_no"), F.lit("in").alias("direction"), F.lit(35.001).alias("lat"), F.lit(128.005).alias("lng"))
    got = feeds.project_to_trace(fixes, trace).collect()
    assert looked == [1] and {r.fix_id for r in got} == set(range(300))
    assert all(abs(r.distance_m - 111.0) < 1e-6 and abs(r.trace_time_s - 5.0) < 1e-6 for r in got)
