"""Growing cells and circles against all pairs."""

import random

from pyspark.sql import functions as F

from roadloom.operators import feeds, history
from roadloom.operators.near import crossed_cells


def test_fixes_near_and_far_from_a_long_trace(spark):
    r = random.Random(1)
    pts, lat, lng = [], 35.0, 128.0
    for i in range(3000):
        lat, lng = lat + r.uniform(-0.001, 0.002), lng + r.uniform(-0.002, 0.002)
        pts.append(("L", "in", i * 2.0, lat, lng, 5.0))
    pts += [("M", "full_route", 0.0, 10.0, 20.0, None)]
    trace = spark.createDataFrame(pts, "line_no string, direction string, trace_time_s double, lat double, lng double, speed_kmh double")
    fixes = [(i, "L", "in", 35 + r.uniform(-0.5, 3), 128 + r.uniform(-1, 1)) for i in range(60)] + [(60, "L", "in", -80.0, -170.0), (61, "M", "out", 11.0, 20.0), (62, "N", "in", 1.0, 1.0), (63, "L", "in", 89.9, 0.0), (64, "L", "in", None, 1.0)]
    df = spark.createDataFrame(fixes, "fix_id long, line_no string, direction string, lat double, lng double")
    got = {x.fix_id: x for x in feeds.project_to_trace(df, trace).collect()}
    seg = [p for p in zip(pts[:2999], pts[1:3000])]
    import math

    for i, line, _, la, lo in fixes:
        if line == "N" or la is None:
            assert i not in got
            continue
        kx = max(1.0, math.cos(math.radians(la)) * 111000.0)
        if line == "M":
            assert got[i].distance_m == round(math.hypot((10 - la) * 111000, (20 - lo) * 91000), 6) and got[i].trace_time_s == 0.0
            continue
        best = None
        for a, b in seg:
            ax, ay, dx, dy = (a[4] - lo) * kx, (a[3] - la) * 111000, (b[4] - a[4]) * kx, (b[3] - a[3]) * 111000
            t = max(0.0, min(1.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy)))
            best = min(best or (9e99,), (round(math.hypot(ax + t * dx, ay + t * dy), 6), a[2], a[2] + 2 * t))
        assert abs(got[i].distance_m - best[0]) < 1e-5 and abs(got[i].trace_time_s - best[2]) < 1e-4
    assert len(got) == len(fixes) - 2


def test_crossed_cells_miss_no_near_point(spark):
    r = random.Random(2)
    segs = [(i, r.uniform(-1, 1), r.uniform(-1, 1), r.uniform(-1, 1), r.uniform(-1, 1)) for i in range(40)] + [(40, 0.5, -1.0, 0.5, 1.0), (41, -1.0, 0.3, 1.0, 0.3), (42, 0.2, 0.2, 0.2, 0.2)]
    df = spark.createDataFrame(segs, "id long, lat1 double, lon1 double, lat2 double, lon2 double").withColumns({"pad_lat": F.lit(0.01), "pad_lon": F.lit(0.02)})
    cells = {}
    for x in crossed_cells(df, 0.1).collect():
        assert (x.cy, x.cx) not in cells.setdefault(x.id, set())
        cells[x.id].add((x.cy, x.cx))
    for i, a, b, c, d in segs:
        for k in range(201):
            la, lo = a + (c - a) * k / 200 + r.uniform(-0.0099, 0.0099), b + (d - b) * k / 200 + r.uniform(-0.0199, 0.0199)
            assert (la // 0.1, lo // 0.1) in cells[i]
        assert len(cells[i]) <= 4 + 2.6 * (abs(c - a) + abs(d - b)) / 0.1 + 4


def test_crowded_and_empty_centers(spark):
    r = random.Random(3)
    at = [(i, i, 35 + r.gauss(0, 0.002), 128 + r.gauss(0, 0.002)) for i in range(400)] + [(i, i, 35 + r.uniform(-0.1, 0.1), 128 + r.uniform(-0.1, 0.1)) for i in range(400, 450)]
    p = spark.createDataFrame(at, "position_id long, vehicle_id long, lat double, lng double").withColumn("recorded_at", F.timestamp_seconds("position_id"))
    c = spark.createDataFrame([(1, 35.0, 128.0), (2, 35.05, 128.05), (3, 50.0, 10.0), (4, 35.1, 127.9)], "center_id long, center_lat double, center_lng double")
    got = sorted((x.center_id, x.rank, x.vehicle_id) for x in history.nearest_vehicles(p, c, 3, 8000.0).collect())
    all_ = history.within_radius(p, c, 8000.0, "latest_then_radius").collect()
    want = []
    for center in (1, 2, 3, 4):
        rows = sorted((x.distance_m, x.vehicle_id) for x in all_ if x.center_id == center)[:3]
        want += [(center, i + 1, v) for i, (_, v) in enumerate(rows)]
    assert got == want
