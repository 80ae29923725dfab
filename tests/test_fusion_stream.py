"""The stream of fused positions gives the rows of the batch form, whatever the batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from roadloom.operators.fusion import fuse_positions
from roadloom.streaming.fusion_stream import fuse_stream

T0 = dt.datetime(2024, 1, 1)
FIX = "fix_id long, line_no string, direction string, vehicle_no string, payload_id long, lat double, lng double, observed_at timestamp"


def traces(spark):
    points = [("L1", "outbound", "T", float(s), 35.0 + s * 0.0001, 129.0 + (s % 30) * 0.00001, 30.0) for s in range(0, 401, 10)]
    points += [("L2", "full_route", "T", float(s), 35.1, 129.0 + s * 0.0001, 30.0) for s in range(0, 101, 20)]
    return spark.createDataFrame(points, "line_no string, direction string, trace_id string, trace_time_s double, lat double, lng double, speed_kmh double")


def play(spark, tmp_path, rows, batches, **options):
    folder = str(tmp_path / f"in{batches}")
    rows = sorted(rows, key=lambda r: r[-1])
    size = -(-len(rows) // batches)
    end = (10**6, "end", "x", "v", 10**6, 0.0, 0.0, rows[-1][-1] + dt.timedelta(seconds=600))
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], FIX).coalesce(1).write.mode("append").parquet(folder)
    for _ in range(2):  # event time goes on, so that the last timers fire
        spark.createDataFrame([end], FIX).coalesce(1).write.mode("append").parquet(folder)
    s = spark.readStream.schema(FIX).option("maxFilesPerTrigger", 1).parquet(folder)
    name = f"fused{batches}"
    q = fuse_stream(s, traces(spark), **options).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).where("line_no <> 'end'")


@pytest.mark.parametrize("batches", [1, 5])
def test_stream_equals_batch(spark, tmp_path, batches):
    r = random.Random(3)
    rows, t = [], 0.0
    for i in range(40):
        t += r.choice([0.7, 1.0, 2.0, 2.5, 5.0, 14.0, 21.0, 33.0, 70.0])
        line = r.choice(["L1", "L1", "L2"])
        near = r.random() < 0.8
        lat = 35.0 + r.random() * 0.04 + (0 if near else 0.5) if line == "L1" else 35.1
        lng = 129.0 + (r.random() * 0.01 if line == "L2" else 0.0)
        rows.append((i, line, "outbound", "v", i, lat, lng, T0 + dt.timedelta(seconds=t)))
    fixes = spark.createDataFrame(rows, FIX)
    key = lambda x: (x.line_no, round(x.tick), x.fix_id, x.state, round(x.lat, 7), round(x.lng, 7), x.live_age_s, x.past_end)
    want = sorted(map(key, fuse_positions(fixes, traces(spark)).collect()))
    got = sorted(map(key, play(spark, tmp_path, rows, batches).collect()))
    assert len(want) > 300 and {x[3] for x in want} == {"live", "interpolated", "reconciling"}
    assert got == want


def test_vehicle_stays_and_repeats_do_not_refresh(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [(1, "L1", "outbound", "b", 1, 35.001, 129.0, at(0)), (2, "L1", "outbound", "c", 1, 35.9, 129.0, at(0)), (3, "L1", "outbound", "a", 2, 35.9, 129.0, at(3)), (4, "L1", "outbound", "b", 3, 35.001, 129.0, at(0)), (5, "L1", "outbound", "b", 4, 35.002, 129.0, at(30))]
    got = play(spark, tmp_path, rows, 1).where("fix_id is not null").select("vehicle_no", "fix_id", "state", F.col("tick")).collect()
    base = T0.replace(tzinfo=dt.timezone.utc).timestamp()
    by = {int(r.tick - base): r for r in got}
    assert {r.vehicle_no for r in got} == {"b"} and {r.fix_id for r in got} == {1, 5}
    assert by[15].state == "live" and by[16].state == "interpolated" and by[30].state == "reconciling"
