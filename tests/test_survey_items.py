"""Survey items G12, F14/G5, J4 and W5 on small tables."""

from roadloom.operators import roadnet, timeseries


def test_all_restrictions_close_edges(spark):
    nodes = spark.createDataFrame([(1, 35.0, 129.0), (2, 35.01, 129.0)], "node_id long, lat double, lon double")
    tags = [(1, None, None, None), (2, "3 m", None, None), (3, None, "18", None), (4, None, None, "no"), (5, "2", None, "yes")]
    ways = spark.createDataFrame([(i, "primary", "yes", None, None, None, *t) for i, *t in tags], "way_id long, highway string, oneway string, maxheight string, maxweight string, access string, maxwidth string, maxlength string, hgv string")
    refs = spark.createDataFrame([(i, s, s) for i in range(1, 6) for s in (1, 2)], "way_id long, seq int, node_id long")
    got = {(r.profile, r.way_id) for r in roadnet.profile_edges(roadnet.build_edges(nodes, ways, refs)).collect()}
    assert got == {("car", i) for i in range(1, 6)} | {("truck_small", i) for i in (1, 2, 3, 5)} | {("truck_semi", i) for i in (1, 2)} | {("truck_special", 1)}


def test_routes_by_profile_side_by_side(spark):
    rows = [(1, "car", "ok", 2.0, 3.0), (1, "truck_semi", "no_route_for_profile", None, None), (2, "car", "no_road_near", None, None)]
    got = roadnet.compare_routes(spark.createDataFrame(rows, "request_id long, profile string, status string, minutes double, km double")).orderBy("request_id").collect()
    assert [(r.request_id, r.car_minutes, r.car_km, r.truck_semi_minutes, r.truck_semi_km) for r in got] == [(1, 2.0, 3.0, None, None), (2, None, None, None, None)]


def test_single_point_ways(spark):
    f = spark.createDataFrame([(1, 35.0, 129.0)], "facility_id long, lat double, lon double")
    nodes = spark.createDataFrame([(1, 35.0001, 129.0), (2, 35.0004, 129.0), (3, 35.0004, 129.001)], "node_id long, lat double, lon double")
    ways = spark.createDataFrame([(7, "primary"), (8, "primary")], "way_id long, highway string")
    refs = spark.createDataFrame([(7, 0, 1), (7, 1, 99), (8, 0, 2), (8, 1, 3)], "way_id long, seq int, node_id long")
    near = lambda **k: [(r.way_id, round(r.distance_m, 2)) for r in roadnet.nearest_way(f, nodes, ways, refs, **k).collect()]
    assert near(single_points=True) == [(7, 11.12)] and near() == [(8, 44.53)]


def test_carry_without_a_clock(spark):
    rows = [(1, 1, 0, 50, True)] + [(1, s, None, None, False) for s in (3, 7, 8, 900)] + [(2, 1, None, 60, True), (2, 5, 10**12, None, False), (2, 9, 10**12, None, True)]
    df = spark.createDataFrame(rows, "session_id long, seq long, capture_timestamp_ns long, source_timestamp_ns long, decode_success boolean")
    got = [(r.session_id, r.seq, r.status, r.resolved_ns) for r in timeseries.qr_resolve(df).orderBy("session_id", "seq").collect()]
    assert got == [(1, 1, "ok", 50), (1, 3, "qr_stale", 50), (1, 7, "qr_stale", 50), (1, 8, "qr_missing", None), (1, 900, "qr_missing", None), (2, 1, "ok", 60), (2, 5, "qr_stale", 60), (2, 9, "qr_missing", None)]
