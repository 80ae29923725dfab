"""Running values of one long recording in segments equal those of one window, and every segment is used."""

import pytest
from pyspark.sql import functions as F

from roadloom.operators import feeds, timeseries
from roadloom.operators.scans import SEGMENT, segmented


@pytest.fixture(scope="module")
def reads(spark):
    n = F.col("id")
    gone = (n % 5 == 0) | (n % 90).between(30, 60)
    return spark.range(3000).select(
        F.when(n < 2600, 1).otherwise(n % 3).cast("long").alias("session_id"), n.alias("seq"), (n * 33_333_333).alias("capture_timestamp_ns"),
        F.when(~gone, (n % 700) * 33_333_333).alias("source_timestamp_ns"), (~gone).alias("decode_success"),
        (n * 10 + F.when(n % 77 == 0, 25).otherwise(0)).alias("arrival"), ((n * 7 + 60000) % 65536).alias("seq16"),
    )


def same(a, b):
    assert a.columns == b.columns and SEGMENT not in a.columns
    rows = sorted(map(tuple, a.collect()), key=str)
    assert rows == sorted(map(tuple, b.collect()), key=str) and rows


def test_segments(reads):
    got = segmented(reads, ["session_id"], ["seq"], 500)
    assert got.where("session_id = 1").select(SEGMENT).distinct().count() > 2
    assert segmented(reads, ["session_id"], ["seq"]).select(SEGMENT).distinct().count() == 1


@pytest.mark.parametrize("run", [timeseries.qr_resolve, timeseries.rewind_epoch, timeseries.sequence_gaps, lambda df, **k: timeseries.unwrap(df, "seq16", 16, "session_id", "arrival", **k)])
def test_repairs(reads, run):
    same(run(reads, most=400), run(reads))


def test_video_times_keyframes_and_places(spark, reads):
    anchors = reads.where("seq % 37 = 5").select("session_id", "capture_timestamp_ns", (F.col("seq") * 33_333).alias("video_pts_us"))
    at = reads.select("session_id", "seq", (F.col("capture_timestamp_ns") + F.col("seq") % 3 * 1000).alias("capture_timestamp_ns"))
    same(timeseries.to_video_pts(at, anchors, ["session_id"], most=400), timeseries.to_video_pts(at, anchors, ["session_id"]))
    frames = reads.select("session_id", F.col("seq").alias("frame_seq"), (F.col("seq") % 12 == 5).alias("keyframe"))
    same(timeseries.keyframe_at(frames, frames, ["session_id"], most=400), timeseries.keyframe_at(frames, frames, ["session_id"]))
    trace = spark.range(2000).select(F.lit("L").alias("line_no"), F.lit("in").alias("direction"), (F.col("id") * 2.0).alias("trace_time_s"), (F.col("id") / 100).alias("lat"), F.lit(128.0).alias("lng"), F.when(F.col("id") % 3 > 0, 9.0).alias("speed_kmh"))
    ticks = spark.range(4100).select(F.lit("L").alias("line_no"), F.lit("in").alias("direction"), (F.col("id") - 50.0).alias("trace_time_s"), "id")
    same(feeds.trace_at(ticks, trace, most=400), feeds.trace_at(ticks, trace))
