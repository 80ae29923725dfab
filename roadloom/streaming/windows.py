"""Streams of positions, counters and events: the batch rules with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def stream_feed(spark: SparkSession, folder: str, schema: StructType, fmt: str = "json", files: int = 100) -> DataFrame:
    """A folder where feed payloads land, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(fmt).load(folder)


def new_positions(stream: DataFrame, vehicles: DataFrame, late: str = "15 seconds") -> DataFrame:
    """Positions of known vehicles, one for each vehicle and observed time; state is bounded by the watermark."""
    known = stream.join(vehicles.select("external_id").distinct(), "external_id", "left_semi")
    return known.withWatermark("observed_at", late).dropDuplicatesWithinWatermark(["external_id", "observed_at"])


def event_rates(stream: DataFrame, time: str = "ts", late: str = "10 minutes", size: str = "5 minutes", every: str = "1 minute") -> DataFrame:
    """Events by vehicle in sliding windows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size, every), "vehicle_id").agg(F.count("*").alias("n"))


def metric_windows(stream: DataFrame, late: str = "10 seconds", size: str = "5 seconds") -> DataFrame:
    """First and last counters of each source in tumbling windows, for rates and means."""
    w = stream.withWatermark("sampled_at", late).groupBy(F.window("sampled_at", size), "source_id")
    return w.agg(F.max_by("frames_inferred", "sampled_at").alias("frames_end"), F.min_by("frames_inferred", "sampled_at").alias("frames_start"), F.max("sampled_at").alias("t_end"), F.min("sampled_at").alias("t_start"))


def join_events(frames: DataFrame, events: DataFrame, tolerance_ms: int = 250) -> DataFrame:
    """Frames and decoded events of a session within the tolerance, both ways; both sides carry watermarks."""
    late = f"{2 * tolerance_ms} milliseconds"
    f = frames.withWatermark("frame_at", late).alias("f")
    e = events.withWatermark("event_at", late).alias("e")
    d = F.expr(f"interval {tolerance_ms} milliseconds")
    near = (F.col("f.session_id") == F.col("e.session_id")) & (F.col("e.event_at") >= F.col("f.frame_at") - d) & (F.col("e.event_at") <= F.col("f.frame_at") + d)
    return f.join(e, near).select("f.session_id", "f.frame_id", "f.frame_at", "e.event_id", "e.event_at")
