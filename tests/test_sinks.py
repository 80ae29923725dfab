"""The sink of positions under failures at each point, repeated and late rows; readers of histories and bans."""

import json

import pytest
from pyspark.sql import functions as F

from roadloom.operators import feeds
from roadloom.sources import tables
from roadloom.streaming import sinks

ROWS = "external_id string, observed_at timestamp, lat double"


def batch(spark, *rows):
    df = spark.createDataFrame(list(rows), "external_id string, t string, lat double")
    return df.select("external_id", F.col("t").cast("timestamp").alias("observed_at"), "lat")


def held(spark, path, schema):
    return sorted((r.external_id, str(r.observed_at), r.lat) for r in sinks.stored_positions(spark, path, schema).collect())


def test_failed_and_repeated_batches(spark, tmp_path, monkeypatch):
    path, known = str(tmp_path / "sink"), spark.createDataFrame([("A",), ("B",), ("B",)], "external_id string")
    one = batch(spark, ("A", "2024-01-01 10:00:00", 1.0), ("A", "2024-01-01 10:00:00", 2.0), ("B", "2024-01-02 10:00:00", 3.0), ("Z", "2024-01-01 10:00:00", 4.0), ("A", None, 5.0))
    two = batch(spark, ("A", "2024-01-01 10:00:00", 9.0), ("A", "2024-01-01 10:00:01", 6.0))
    want = [("A", "2024-01-01 10:00:00", 1.0), ("B", "2024-01-02 10:00:00", 3.0)]
    mark = sinks._mark
    monkeypatch.setattr(sinks, "_mark", lambda *_: (_ for _ in ()).throw(OSError("no space")))
    with pytest.raises(OSError):
        sinks.store_batch(one, 0, path, known)
    assert held(spark, path, one.schema) == [] and (tmp_path / "sink" / "rows").exists()
    monkeypatch.setattr(sinks, "_mark", mark)
    assert sinks.store_batch(one, 0, path, known) and held(spark, path, one.schema) == want
    assert not sinks.store_batch(one, 0, path, known)
    assert sinks.store_batch(two, 3, path, known) and sinks.store_batch(one, 4, path, known)
    assert held(spark, path, one.schema) == sorted([*want, ("A", "2024-01-01 10:00:01", 6.0)])


def test_stream_with_a_write_that_fails_once(spark, tmp_path, monkeypatch):
    known = spark.createDataFrame([("A",)], "external_id string")
    df = batch(spark, *[("A", f"2024-01-01 10:00:0{i % 5}", float(i)) for i in range(9)])
    for i in range(3):
        df.where(F.col("lat") % 3 == i).write.mode("append").parquet(str(tmp_path / "in"))
    failed, mark = [], sinks._mark

    def once(*a):
        if not failed:
            failed.append(1)
            raise OSError("once")
        mark(*a)

    monkeypatch.setattr(sinks, "_mark", once)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sinks.persist_positions(stream, known, str(tmp_path / "out"), str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    assert failed and [r[:2] for r in held(spark, str(tmp_path / "out"), df.schema)] == [("A", f"2024-01-01 10:00:0{i}") for i in range(5)]


def test_history_layouts(spark, tmp_path):
    (tmp_path / "p.csv").write_text("﻿line_number,direction,logical_trace_id,vehicle_id,trace_time_s,latitude,longitude,speed_kmh,stop_index,route_stop_count\n"
                                    " 10 ,out,t1,v,0.5,35.1,129.1,\"1,000\",5,20\n 10 ,out,,v2,1.5,35.2,129.1,,,\n10,out,,,2,91,0,,,\n10,out,t1,v,x,35,129,,,\n,out,t1,v,3,35,129,,,\n", encoding="utf-8")
    got = sorted((r.line_no, r.direction, r.trace_id, r.trace_time_s, r.lat, r.speed_kmh, r.stop_index, r.progress) for r in tables.read_history(spark, str(tmp_path / "p.csv")).collect())
    assert got == [("10", "outbound", "t1", 0.5, 35.1, 1000.0, 5.0, 25.0), ("10", "outbound", "v2", 1.5, 35.2, None, None, None)]
    head = "observed_at_utc,logical_trace_id,line_number,vehicle_id,longitude,latitude,speed_kmh,direction,point_class,extra\n"
    body = [("2024-01-01T00:00:10Z", "", "a1", "v", 129, 35.2, "", "in", "changed"), ("2024-01-01T09:00:00+09:00", "", "a1", "v", 129, 35.1, 7, "in", ""), ("2024-01-01T00:00:10Z", "", "a1", "v", 129, 35.9, "", "in", "changed"),
            ("2024-01-01T00:00:20Z", "", "a1", "v", 129, 35.3, "", "in", "Rejected_jump"), ("2024-01-01T00:00:30Z", "", "a1", "v", 129, 35.3, "", "in", "duplicate"), ("bad", "", "a1", "v", 129, 35.3, "", "in", "changed")]
    (tmp_path / "r.csv").write_text(head + "".join(",".join(map(str, r)) + ",x\n" for r in body))
    raw = tables.read_history(spark, str(tmp_path / "r.csv"))
    assert [(r.line_no, r.direction, r.trace_id, r.trace_time_s, r.lat) for r in raw.orderBy("trace_time_s").collect()] == [("A1", "inbound", "v", 0.0, 35.1), ("A1", "inbound", "v", 10.0, 35.2)]
    assert feeds.select_trace(raw).count() == 2
    none = tables.read_history(spark, str(tmp_path / "no.csv"))
    assert none.isEmpty() and none.dtypes == raw.dtypes


def test_turn_bans_in_both_forms(spark, tmp_path):
    bans = [{"from_way": 1, "via_node": 2, "to_way": 3, "restriction": "no_left_turn"}, {"from_way": 1, "via_node": 2, "to_way": 3}, {"from_way": 1, "via_node": None, "to_way": 3}, {"from_way": 4, "via_node": 5, "to_way": 6}]
    (tmp_path / "o.json").write_text(json.dumps({"_readme": "text", "restrictions": bans}, indent=2))
    (tmp_path / "l.json").write_text(json.dumps(bans))
    (tmp_path / "e.json").write_text(json.dumps({"_readme": "text"}))
    for name, want in (("o", [(1, 2, 3), (4, 5, 6)]), ("l", [(1, 2, 3), (4, 5, 6)]), ("e", []), ("missing", [])):
        assert sorted(map(tuple, tables.read_turn_bans(spark, str(tmp_path / f"{name}.json")).collect())) == want


def test_sinks_keep_the_order_and_rounding(spark, tmp_path):
    df = spark.createDataFrame([(1.00000004, 35.123456789, 7.126, "v", "x")], "longitude double, latitude double, speed_kmh double, vehicle_id string, extra string")
    tables.append_positions(df, str(tmp_path / "h"))
    tables.append_fixes(df, str(tmp_path / "f"))
    hybrid, raw = spark.read.parquet(str(tmp_path / "h")), spark.read.parquet(str(tmp_path / "f"))
    assert tuple(hybrid.columns) == tables.HYBRID_COLUMNS and tuple(raw.columns) == tables.RAW_COLUMNS
    assert [(r.longitude, r.latitude, r.speed_kmh) for r in hybrid.collect() + raw.collect()] == [(1.0, 35.1234568, 7.13)] * 2
