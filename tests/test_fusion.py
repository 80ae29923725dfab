"""Fused positions, stateful streams, payload readers and small rules on hand-made rows."""

import datetime as dt
import json

from pyspark.sql import functions as F

from roadloom.functions import media
from roadloom.operators import facilities as fac
from roadloom.operators import history, reference_data, roadnet
from roadloom.operators.fusion import fuse_positions
from roadloom.sources import payloads
from roadloom.streaming.states import deviation_stream, packet_epochs, retain

T0 = dt.datetime(2024, 1, 1)


def fused(spark, fixes, **options):
    rows = [(i, "L1", "outbound", float(lat), float(lng), T0 + dt.timedelta(seconds=s)) for i, (s, lat, lng) in enumerate(fixes)]
    f = spark.createDataFrame(rows, "fix_id long, line_no string, direction string, lat double, lng double, observed_at timestamp")
    points = [("L1", "outbound", "T", float(s), 35.0 + s * 0.0001, 129.0, 30.0) for s in range(0, 101, 10)]
    trace = spark.createDataFrame(points, "line_no string, direction string, trace_id string, trace_time_s double, lat double, lng double, speed_kmh double")
    out = fuse_positions(f, trace, **options).orderBy("tick").collect()
    base = int(T0.replace(tzinfo=dt.timezone.utc).timestamp())
    return {int(r.tick) - base: r for r in out}


def test_silent_line_moves_along_its_trace_and_blends_back(spark):
    got = fused(spark, [(0, 35.0, 129.0), (30, 35.005, 129.001), (32, 35.006, 129.0)])
    assert [got[s].state for s in (0, 15, 16, 29, 30, 31, 32, 34, 35, 47, 48)] == ["live", "live", "interpolated", "interpolated", "reconciling", "reconciling", "reconciling", "reconciling", "live", "live", "interpolated"]
    assert abs(got[16].lat - 35.0) < 1e-9 and abs(got[29].lat - 35.0013) < 1e-9
    # the first blend starts at the place shown at 29 and goes to the fix's place on the trace; the second starts inside it
    assert abs(got[30].lat - 35.0013) < 1e-9 and abs(got[31].lat - (35.0013 + 0.0037 / 3)) < 1e-9
    second = 35.0013 + 0.0037 * 2 / 3
    assert abs(got[32].lat - second) < 1e-9 and abs(got[33].lat - (second + (35.006 - second) / 3)) < 1e-9 and abs(got[40].lat - 35.006) < 1e-9
    assert max(got) == 92 and not got[88].past_end and got[92].past_end and abs(got[92].lat - 35.01) < 1e-9


def test_far_line_is_hidden_and_comes_back_at_once(spark):
    got = fused(spark, [(0, 36.0, 129.0), (40, 36.1, 129.0)])
    assert 15 in got and 16 not in got and 39 not in got and got[40].state == "live" and got[40].lat == 36.1


def test_fusion_of_nothing(spark):
    assert fused(spark, []) == {}


def test_a_long_silence_is_listed_by_many_tasks(spark):
    f = spark.createDataFrame([(1, "L1", "outbound", 35.0, 129.0, T0)], "fix_id long, line_no string, direction string, lat double, lng double, observed_at timestamp")
    points = [("L1", "outbound", "T", float(s), 35.0 + s * 0.00001, 129.0, 30.0) for s in range(0, 5001, 1000)]
    trace = spark.createDataFrame(points, "line_no string, direction string, trace_id string, trace_time_s double, lat double, lng double, speed_kmh double")
    out = fuse_positions(f, trace, after_s=9000.0).withColumn("task", F.spark_partition_id())
    rows = {int(r.tick) - int(T0.replace(tzinfo=dt.timezone.utc).timestamp()): r for r in out.collect()}
    silent = [r.task for r in rows.values() if r.state == "interpolated"]
    assert sorted(rows) == list(range(9001)) and len(silent) == 8985 and len(set(silent)) > 1
    assert all(abs(rows[k].lat - (35.0 + min(k - 16, 5000) * 0.00001)) < 1e-9 and rows[k].past_end == (k - 16 > 5000) for k in range(16, 9001))


def run(stream, name, path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path / name)).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)


def test_packet_epochs_over_batches(spark, tmp_path):
    for i, rows in enumerate([[(1, 0, 65534), (1, 1, 65535), (1, 2, 0)], [(1, 3, 65535), (1, 4, 1), (1, 5, 9), (2, 0, 7)]]):
        spark.createDataFrame(rows, "session_id long, arrival long, seq16 int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("session_id long, arrival long, seq16 int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.session_id, r.arrival): (r.late, r.gap, r.epoch) for r in run(packet_epochs(s), "packets", tmp_path).collect()}
    assert got[1, 2] == (False, False, 0) and got[1, 3] == (True, False, 0) and got[1, 4] == (False, False, 0) and got[1, 5] == (False, True, 1) and got[2, 0] == (False, False, 0)


def test_retention_opens_epochs(spark, tmp_path):
    spark.createDataFrame([(1, s * 90000) for s in (0, 20, 30, 31, 40, 80)], "session_id long, pts_90k long").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("session_id long, pts_90k long").parquet(str(tmp_path / "in"))
    got = {r.pts_90k // 90000: (r.epoch, r.discarded) for r in run(retain(s), "held", tmp_path).collect()}
    assert got == {0: (0, False), 20: (0, False), 30: (0, False), 31: (0, True), 40: (1, False), 80: (1, True)}


def test_deviation_stream(spark, tmp_path):
    rows = [(7, 35.0, 129.01, T0), (7, 35.0, 129.02, T0 + dt.timedelta(seconds=30)), (7, 35.0, 129.0, T0 + dt.timedelta(seconds=40)), (7, 35.0, 129.03, T0 + dt.timedelta(seconds=300)), (8, 0.0, 0.0, T0)]
    schema = "trip_id long, lat double, lng double, recorded_at timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    routes = spark.createDataFrame([(7, 0, 34.9, 129.0, True), (7, 1, 35.1, 129.0, True), (8, 0, 0.0, 0.0, True)], "trip_id long, seq int, lat double, lng double, is_current boolean")
    s = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = sorted(run(deviation_stream(s, routes, 500.0), "off", tmp_path, "complete").select("trip_id", "samples").collect())
    assert [tuple(r) for r in got] == [(7, 1), (7, 2)]


def test_payloads(spark):
    texts = [
        json.dumps({"response": {"body": {"items": {"item": [{"lineNo": "1", "carNo": "B1"}, {"lineNo": "2"}]}}}}), json.dumps({"response": {"body": {"items": {"item": {"lineNo": "3"}}}}}),
        json.dumps({"response": {"body": {"items": ""}}}), "<response><header><resultCode>00</resultCode></header><body><items><item><lineNo>4</lineNo></item><item><lineNo>5</lineNo></item></items></body></response>", "broken", None,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "raw string")
    got = payloads.parse_feed(df).select(media.first_field(F.col("item"), "line_no", "lineid").alias("n")).collect()
    assert sorted(r.n for r in got) == ["1", "2", "3", "4", "5"]


def test_files(spark, tmp_path):
    (tmp_path / "routes.json").write_text(json.dumps({"10": {"line_id": "5", "stops": [{"bstopid": "a"}, {"bstopid": "b"}]}, "11": {"line_id": "6", "stops": []}}))
    assert [(r.line_no, r.seq) for r in payloads.read_routes(spark, str(tmp_path / "routes.json")).orderBy("line_no", "seq").collect()] == [("10", 0), ("10", 1), ("11", None)]
    (tmp_path / "stops.json").write_text(json.dumps({"version": "1", "complete": True, "total_count": 1, "stops": [{"arsno": "01", "bstopid": "x", "gpsx": 129.0, "gpsy": 35.0}]}))
    assert payloads.read_stop_catalog(spark, str(tmp_path / "stops.json")).first().total_count == 1
    one = {"sidoNm": "부산광역시", "facilName": " b ", "sLatitude": "0", "eLatitude": "35.1", "sLongitude": "129.1", "height": "9", "totWidth": "3", "alowPass": "40"}
    (tmp_path / "b.json").write_text(json.dumps({"response": {"body": {"items": {"item": one}}}}))
    assert tuple(payloads.read_bridges(spark, str(tmp_path / "b.json")).first()) == ("b", 35.1, 129.1, None, 3.0, 40.0)
    for name, code in (("u", "utf-8-sig"), ("c", "cp949")):
        (tmp_path / f"{name}.csv").write_bytes('시설명,위도,경도,통과높이(m),보도폭,차도폭\n"하단, 지하",35.1,128.9,3.2,1,7\n'.encode(code))
        assert tuple(payloads.read_underpass(spark, str(tmp_path / f"{name}.csv")).first()) == ("하단, 지하", 35.1, 128.9, 3.2, 7.0)
    (tmp_path / "w.csv").write_text("출발지 이름,도착지 이름,도로명칭,제한너비\nA,B,,3\nA,,r,3\nA,B,r,99\n")
    assert [tuple(r) for r in payloads.read_widths(spark, str(tmp_path / "w.csv")).collect()] == [("A", "B", "A ~ B", 3.0)]


def test_geojson_routes(spark, tmp_path):
    rows = [(1, json.dumps({"type": "LineString", "coordinates": [[129.0, 35.0], [129.1, 35.1]]})), (2, json.dumps({"type": "Point", "coordinates": [1, 2]})), (3, None)]
    payloads.save_route(spark.createDataFrame(rows, "id int, geojson string"), str(tmp_path / "r"))
    got = spark.read.parquet(str(tmp_path / "r")).collect()
    assert [(r.id, len(r.line), r.line[1].y, r.is_current) for r in got] == [(1, 2, 35.1, True)]


def test_small_rules(spark):
    df = spark.createDataFrame([(["3.5 m", "2", "x"], {"Line-No": " ", "LINENO": "7"}, 1.0, None)], "tags array<string>, m map<string,string>, a double, b double")
    r = df.select(media.limit_tags(F.col("tags")), media.tag_is(F.col("tags"), "2"), media.first_field(F.col("m"), "line_no"), media.make_point(F.col("a"), F.col("b")), media.route_summary(F.lit(1234.5), F.lit(90.0), F.col("tags"))).first()
    assert r[:4] == (2.0, True, "7", None) and tuple(r[4]) == (1.235, 1.5, 3)


def test_append_ids_have_no_gaps(spark):
    df = fac.append_rows(spark.range(500).selectExpr("id as k", "if(id % 2 = 0, 'PAUSED', null) as trip_status"), "trip_id", 100, "k")
    rows = df.collect()
    assert sorted(r.trip_id for r in rows) == list(range(101, 601)) and {r.trip_status for r in rows} == {"PAUSED", "READY"}


def test_clusters_and_bundle(spark):
    df = spark.createDataFrame([(35.0, 129.0, 1), (35.001, 129.0, 2), (36.0, 128.0, 3), (None, 1.0, 4)], "lat double, lng double, capture_timestamp_ns long")
    assert reference_data.clusters(df, 2).select("cluster").distinct().count() == 2
    parts = history.replay_bundle(F.lit(2), F.lit(3), detections=df)
    assert [r.capture_timestamp_ns for r in parts["detections"].collect()] == [2, 3]


def test_path_geometry_and_snapped_requests(spark):
    pts = [(1, 0, s, 35.0 + s / 1000, 129.0) for s in range(3)] + [(2, 0, s, 35.002, 129.0 + s / 1000) for s in range(2)]
    points = spark.createDataFrame(pts, "way_id long, segment int, seq int, lat double, lon double")
    paths = spark.createDataFrame([(9, 0, 2, 0, 1), (9, 1, 1, 0, 1)], "id long, step int, way_id long, segment int, reverse int")
    line = roadnet.path_geometry(paths, points, ["id"]).first().line
    assert [tuple(p) for p in line] == [(35.002, 129.001), (35.002, 129.0), (35.001, 129.0), (35.0, 129.0)]
    v = spark.createDataFrame([(1, 35.0, 129.0), (2, 35.1, 129.1)], "node_id long, lat double, lon double")
    e = spark.createDataFrame([(1, 2, 60.0)], "src long, dst long, seconds double")
    od = spark.createDataFrame([(1, 35.0, 129.0, 35.1, 129.1), (2, 35.1, 129.1, 35.0, 129.0), (3, 0.0, 0.0, 35.0, 129.0)], "request_id long, origin_lat double, origin_lon double, goal_lat double, goal_lon double")
    got = roadnet.route_requests(od, v, e, 2).orderBy("request_id").collect()
    assert [(r.status, r.minutes) for r in got] == [("ok", 1.0), ("no_route_within_hops", None), ("no_road_near", None)]
