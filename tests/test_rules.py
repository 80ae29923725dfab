"""Rules on small tables against plain versions: reach of cells, times, risk, segments over unknown nodes, geometry."""

import math
import random

import pytest
from pyspark.sql import functions as F

from roadloom.functions import scalars
from roadloom.operators import history, roadnet


def metres(a, b, c, d):
    p = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371000.0 * math.asin(math.sqrt(min(1.0, p)))


@pytest.mark.parametrize("radius", [3000.0, 40_000.0])
def test_reach_everywhere(spark, radius):
    r = random.Random(1)
    at = [(0, 0), (35.1, 129.0), (72, 20), (80, -150), (-85, 179.99), (-40, -179.999), (89.99, 5), (-90, 0), (60.0, 180.0)]
    centers = [(i, float(a), float(b)) for i, (a, b) in enumerate(at)]
    points = []
    for i, a, b in centers:
        for _ in range(60):
            lat = max(-90.0, min(90.0, a + r.uniform(-1, 1) * radius / 90_000))
            lng = (b + r.uniform(-1, 1) * min(180.0, radius / 90_000 / max(1e-3, math.cos(math.radians(a)))) + 180) % 360 - 180
            points.append((len(points), len(points), lat, lng))
    p = spark.createDataFrame([*points, (-1, -1, None, None)], "vehicle_id long, position_id long, lat double, lng double").withColumn("recorded_at", F.current_timestamp())
    c = spark.createDataFrame(centers, "center_id long, center_lat double, center_lng double")
    got = sorted((x.center_id, x.vehicle_id) for x in history.within_radius(p, c, radius).collect())
    want = sorted((i, v) for i, a, b in centers for v, _, lat, lng in points if metres(a, b, lat, lng) <= radius)
    assert got == want and len(want) > 200


def test_times_and_clocks(spark):
    rows = [("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05",), ("2024-01-02T12:04:05+09:00",), (" 2024-01-02 03:04:05 ",), ("2024-01-02",), ("no",), ("",), (None,)]
    df = spark.createDataFrame(rows, "t string").select("t", F.unix_seconds(scalars.ts_utc(F.col("t"))).alias("s"))
    assert [r.s for r in df.collect()] == [1704164645] * 4 + [1704153600, None, None, None]
    df = spark.createDataFrame([(90000,), (1,), (7,), (2**33 * 1000,)], "p long").select("p", scalars.pts_to_us(F.col("p")).alias("us"))
    assert [r.us for r in df.collect()] == [p * 10**6 // 90000 for p in (90000, 1, 7, 2**33 * 1000)]


def test_risk_level(spark):
    df = spark.createDataFrame([(None, 5.0), (1.0, 5.0), (3.0, 5.0), (3.0, 2.5)], "d double, w double").select(scalars.risk_level(F.col("d"), F.col("w"), 2.0).alias("r"))
    assert [r.r for r in df.collect()] == ["UNKNOWN", "DANGER", "CAUTION", "NORMAL"]


def test_calibration(spark):
    df = spark.createDataFrame([(1, None), (2, 1.5)], "i int, h double")
    g = scalars.ground_distance(F.lit(0.5), F.lit(0.9), F.lit(1.0), F.lit(0.0), F.col("h"), digits=2)
    got = [(r.g.status, r.g.distance) for r in df.select("i", g.alias("g")).orderBy("i").collect()]
    assert got[0] == ("calibration_missing", None) and got[1][0] == "ok" and got[1][1] == round(got[1][1], 2)


def network(spark):
    nodes = spark.createDataFrame([(i, 35.0 + i / 100, 129.0 + (i % 3) / 100) for i in (1, 2, 4, 5, 6, 7, 9)], "node_id long, lat double, lon double")
    refs = [(10, [1, 2, 3, 4, 5]), (11, [3, 6, 7]), (12, [8, 2, 9]), (13, [4, 4, 9]), (14, [6])]
    ways = [(10, "primary", None), (11, "track", "yes"), (12, "service", None), (13, "secondary_link", None), (14, "primary", None), (15, "footway", None)]
    r = spark.createDataFrame([(w, i, n) for w, ns in refs for i, n in enumerate(ns)] + [(15, 0, 5)], "way_id long, seq int, node_id long")
    return nodes, spark.createDataFrame(ways, "way_id long, highway string, oneway string"), r


def test_segments_span_unknown_nodes(spark):
    """Unknown nodes 3 and 8: way 10 goes on from 2 to 4 over 3, ways 11 and 12 begin at their next vertex."""
    nodes, ways, refs = network(spark)
    at = {r.node_id: (r.lat, r.lon) for r in nodes.collect()}
    e = {(r.way_id, r.src, r.dst): r.dist_m for r in roadnet.build_edges(nodes, ways, refs).collect()}
    both = {(10, 2, 1), (10, 1, 2), (10, 2, 4), (10, 4, 2), (10, 4, 5), (10, 5, 4), (12, 2, 9), (12, 9, 2), (13, 4, 4), (13, 4, 9), (13, 9, 4)}
    assert set(e) == both | {(11, 6, 7)}
    for (_, a, b), d in e.items():
        assert d == pytest.approx(metres(*at[a], *at[b]), abs=1e-6)


def test_geometry_of_edges(spark):
    nodes, ways, refs = network(spark)
    e = roadnet.build_edges(nodes, ways, refs)
    paths = e.select(F.concat_ws("/", "way_id", "src", "dst", "reverse").alias("id"), F.lit(0).alias("step"), "way_id", "segment", "reverse")
    lines = {r.id: [(p.lat, p.lon) for p in r.line] for r in roadnet.path_geometry(paths, roadnet.edge_points(nodes, ways, refs), ["id"]).collect()}
    at = {r.node_id: (r.lat, r.lon) for r in nodes.collect()}
    assert len(lines) == e.count()
    for key, line in lines.items():
        _, a, b, _ = map(int, key.split("/"))
        assert line[0] == at[a] and line[-1] == at[b]


def test_profiles_and_lists(spark):
    e = spark.createDataFrame([(1, ["no", None], None), (2, ["destination"], "no"), (3, None, None)], "way_id long, access array<string>, hgv string").withColumns({"dist_m": F.lit(100.0), "highway": F.lit("track")})
    got = {(r.way_id, r.profile): round(r.seconds, 6) for r in roadnet.profile_edges(e).collect()}
    assert got == {(2, "car"): 24.0} | {(3, p[0]): 24.0 for p in roadnet.PROFILES}


@pytest.mark.parametrize("lat", [0.0, 35.0, 69.5])
def test_nearest_way_at_any_size_and_latitude(spark, lat):
    """Segments from metres to degrees against all pairs."""
    r = random.Random(5)
    k = math.cos(math.radians(lat))
    nodes, refs = [], []
    for w in range(120):
        a, b, size = lat + r.uniform(-0.02, 0.02), 20 + r.uniform(-0.02, 0.02) / k, 10 ** r.uniform(-4, 0.3)
        for i in range(2):
            nodes.append((2 * w + i, a, b))
            refs.append((w, i, 2 * w + i))
            a, b = a + r.uniform(-1, 1) * size, b + r.uniform(-1, 1) * size / k
    f = [(i, lat + r.uniform(-0.02, 0.02), 20 + r.uniform(-0.02, 0.02) / k) for i in range(150)]
    ways = spark.createDataFrame([(w, "primary") for w in range(120)], "way_id long, highway string")
    got = {x.facility_id: (x.way_id, x.distance_m) for x in roadnet.nearest_way(spark.createDataFrame(f, "facility_id long, lat double, lon double"), spark.createDataFrame(nodes, "node_id long, lat double, lon double"), ways, spark.createDataFrame(refs, "way_id long, seq int, node_id long")).collect()}
    want = {}
    for i, y, x in f:
        best = []
        for w in range(120):
            (_, y1, x1), (_, y2, x2) = nodes[2 * w : 2 * w + 2]
            c = math.cos(math.radians((y1 + y2) / 2)) * 111320.0
            dx, dy, px, py = (x2 - x1) * c, (y2 - y1) * 111320.0, (x - x1) * c, (y - y1) * 111320.0
            t = max(0.0, min(1.0, (px * dx + py * dy) / (dx * dx + dy * dy)))
            best.append((math.hypot(px - t * dx, py - t * dy), w))
        d, w = min(best)
        if d < 60:
            want[i] = (w, pytest.approx(d, abs=1e-5))
    assert got == want and len(want) > 10
