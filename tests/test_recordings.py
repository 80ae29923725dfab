"""Recordings, logs, declared tables, versions and the position sink on small files."""

import json

import pytest
from pyspark.sql import functions as F

from roadloom.operators import history, reference_data, timeseries
from roadloom.sources import tables


def test_recording(spark, tmp_path):
    (tmp_path / "frame_0.csv").write_text("frame_index,timestamp_ns\n0,10\n1,x\n2,30\n")
    (tmp_path / "frame_1.csv").write_text("frame_index,timestamp_ns\n3,40\n")
    (tmp_path / "imu_0.csv").write_text("timestamp_ns,pitch_deg,roll_deg,yaw_deg,accuracy\n10,1.5,0,0,\n20,,0,0,3\n30,1,2,3,2\n")
    (tmp_path / "intrinsics.json").write_text(json.dumps({"width": 1280, "height": 720, "fx": 920.0, "fy": 690.0, "cx": 640.0, "cy": 360.0}))
    r = tables.read_recording(spark, str(tmp_path))
    assert sorted(map(tuple, r["frames"].collect())) == [(0, 10), (2, 30), (3, 40)]
    assert [(x.timestamp_ns, x.accuracy) for x in r["imu"].orderBy("timestamp_ns").collect()] == [(10, None), (30, 2)]
    assert r["intrinsics"].first().fx == 920.0 and r["calibration"].count() == 0
    (tmp_path / "monocular_calibration.json").write_text(json.dumps({"camera_height_m": 2.0, "max_distance_m": 90.0}))
    c = tables.read_recording(spark, str(tmp_path))["calibration"].first()
    assert (c.camera_height_m, c.camera_roll_offset_deg, c.min_distance_m, c.max_distance_m) == (2.0, 0.0, 0.1, 90.0)


def test_qr_log(spark, tmp_path):
    (tmp_path / "q.csv").write_text("decode_success,decoded_value,capture_ts_elapsed_ns,capture_index\nTRUE,5,100,0\nfalse,7,200,1\ntrue,,300,2\n")
    got = tables.read_qr_log(spark, str(tmp_path / "q.csv")).orderBy("seq").collect()
    assert [tuple(r) for r in got] == [(0, 100, 5, True), (1, 200, None, False), (2, 300, None, False)]


def test_declared_tables(spark, tmp_path):
    assert len(tables.TABLES) == 13
    spark.range(2).selectExpr("id as trip_id", "'READY' as trip_status").write.parquet(str(tmp_path / "trip.parquet"))
    t = tables.read_table(spark, str(tmp_path), "trip")
    assert t.count() == 2 and t.schema["vehicle_id"].dataType.simpleString() == "bigint" and t.where("vehicle_id is null").count() == 2
    for name, schema in tables.TABLES.items():
        assert len(spark.createDataFrame([], schema).columns) == len(set(spark.createDataFrame([], schema).columns)), name


def test_versions(spark, tmp_path):
    path = str(tmp_path / "doc")
    for n in (1, 5, 3):
        tables.publish(spark.range(n), path)
        assert tables.read_published(spark, path).count() == n
    with pytest.raises(Exception):  # noqa: B017 (whatever the write raises)
        tables.publish(spark.range(3).select(F.raise_error(F.lit("broken"))), path)
    assert tables.read_published(spark, path).count() == 3


def test_position_sink(spark, tmp_path):
    schema = "latitude double, longitude double, speed_kmh double"
    spark.createDataFrame([(35.123456789, 129.0, 33.336)], schema).write.parquet(str(tmp_path / "in"))
    q = tables.stream_positions(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    assert tuple(spark.read.parquet(str(tmp_path / "out")).first()) == (35.1234568, 129.0, 33.34)


def test_pairing_goes_on_in_rounds(spark):
    s = 1_000_000_000
    frames = spark.createDataFrame([(1, 1, -5, s), (1, 2, -6, s + 50_000_000), (1, 3, -7, 9 * s)], "session_id long, frame_seq long, media_ts long, received long")
    events = spark.createDataFrame([(1, 10, 1, s, -1), (1, 11, 2, s + 10_000_000, -1), (1, 12, 3, 5 * s, -1)], "session_id long, event_id long, media_ts long, received long, latency long")
    got = sorted((r.event_id, r.frame_seq) for r in timeseries.pair_events(frames, events).collect())
    assert got == [(10, 1), (11, 2)]


def test_guards_and_causes(spark):
    p = spark.createDataFrame([(1, 5, 7, 35.0, 129.01)], "position_id long, vehicle_id long, trip_id long, lat double, lng double")
    r = spark.createDataFrame([(7, 70, i, 34.9 + i / 5, 129.0) for i in range(2)] + [(7, 71, 0, 35.0, 129.0), (8, 80, 0, 35.0, 129.0), (8, 80, 1, 35.1, 129.0)], "trip_id long, route_id long, seq int, lat double, lng double")
    asked = spark.createDataFrame([(5, 7, 70, 1), (6, 7, 70, 1), (5, 8, 70, 1), (5, 7, 71, 1), (5, 7, 80, 1), (5, 7, 70, 2)], "vehicle_id long, trip_id long, route_id long, position_id long")
    got = history.measured_on(asked, p, r).collect()
    assert [(x.vehicle_id, x.trip_id, x.route_id, x.position_id) for x in got] == [(5, 7, 70, 1)] and abs(got[0].distance_m - 911.9) < 1
    none = spark.createDataFrame([], "vehicle_id long, detection_event_id long, distance_m double")
    off = spark.createDataFrame([(5, 1, 700.0), (5, 2, 1000.0)], "vehicle_id long, deviation_id long, distance_m double")
    trips = spark.createDataFrame([(5, 7, "COMPLETED")], "vehicle_id long, trip_id long, trip_status string")
    assert sorted((r.alert_type, r.cause_id, r.severity) for r in reference_data.build_alerts(none, trips, off).collect()) == [("ROUTE_DEVIATION", 1, "WARNING"), ("ROUTE_DEVIATION", 2, "CRITICAL"), ("TRIP_COMPLETED", 7, "INFO")]


def test_heavy_history_is_cut_by_bytes(spark, tmp_path):
    from roadloom.streaming.states import retain

    spark.createDataFrame([(1, i * 90, 40) for i in range(6)], "session_id long, pts_90k long, bytes long").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("session_id long, pts_90k long, bytes long").parquet(str(tmp_path / "in"))
    q = retain(s, 30.0, 100).writeStream.format("memory").queryName("cut").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.epoch, r.discarded) for r in spark.table("cut").orderBy("pts_90k").collect()] == [(0, False), (0, False), (0, True), (1, False), (1, False), (1, True)]
