"""Readers and sinks of histories, recordings, overrides and published documents."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadloom.functions.geo import valid_point
from roadloom.functions.scalars import norm_direction, norm_line, num, ts_utc

RESTRICTIONS = ("maxheight", "maxwidth", "maxweight", "maxlength", "hgv", "access")


def _there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place))


_HISTORY = "line_no string, direction string, trace_id string, trace_time_s double, lat double, lng double, speed_kmh double, stop_index double, progress double"


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Trace points of a CSV file, or of several with one header: line_no, direction, trace_id, trace_time_s, lat, lng,
    speed_kmh, stop_index, progress; keys normalised, so that the feed operators take them. A missing file gives no rows.

    With a column trace_time_s (seconds, fractions too) points are as they lie; without it the layout is the collector's
    raw one: duplicates and rejected points go, times are seconds since the first of their trace, and of several points at
    one time the first in the file stays. Traces are kept apart by logical_trace_id, else vehicle_id, else `legacy`. Points
    without a line, a valid place or a time are dropped. Missing progress is stop_index in percent of route_stop_count.
    """
    if not _there(spark, path):
        return spark.createDataFrame([], _HISTORY)
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    text = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    filled = lambda c: F.nullif(F.trim(text(c)), F.lit(""))
    stop, stops = num(text("stop_index")), num(text("route_stop_count"))
    share = F.when(stops != 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), stop / stops * 100)))
    rows = raw.select(
        norm_line(F.coalesce(text("line_number"), F.lit(""))).alias("line_no"), norm_direction(text("direction")).alias("direction"), F.coalesce(filled("logical_trace_id"), filled("vehicle_id"), F.lit("legacy")).alias("trace_id"),
        num(text("trace_time_s")).alias("trace_time_s"), num(text("latitude")).alias("lat"), num(text("longitude")).alias("lng"), num(text("speed_kmh")).alias("speed_kmh"), stop.alias("stop_index"), F.coalesce(num(text("route_progress_pct")), share).alias("progress"),
        F.coalesce(F.lower(filled("point_class")), F.lit("changed")).alias("kind"), ts_utc(text("observed_at_utc")).alias("at"), F.monotonically_increasing_id().alias("nth"),
    ).where((F.col("line_no") != "") & valid_point(F.col("lat"), F.col("lng")))
    names = [c.split()[0] for c in _HISTORY.split(", ")]
    if "trace_time_s" in raw.columns:
        return rows.where("trace_time_s is not null").select(names)
    key = ["line_no", "direction", "trace_id"]
    kept = rows.where("at is not null and kind <> 'duplicate' and not startswith(kind, 'rejected')")
    first = kept.groupBy(*key, "at").agg(F.min(F.struct("nth", *names[4:])).alias("p")).select(*key, "at", "p.*")
    start = F.min("at").over(Window.partitionBy(*key))
    return first.withColumn("trace_time_s", (F.unix_micros("at") - F.unix_micros(start)) / 1e6).select(names)


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """way_id and its restriction fields from a JSON object keyed by way; other keys are skipped, nulls dropped."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,string>>", {"mode": "PERMISSIVE"}).alias("m"))
    rows = doc.select(F.explode("m").alias("k", "v")).where(F.col("k").rlike("^[0-9]+$"))
    return rows.select(F.col("k").cast("long").alias("way_id"), *[F.element_at("v", c).alias(c) for c in RESTRICTIONS]).dropna("all", subset=list(RESTRICTIONS))


def read_turn_bans(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (from_way, via_node, to_way) of a JSON list, or of the list under `restrictions` in an object; a missing
    file gives no rows, an entry without one of the three goes."""
    ban = "from_way bigint, via_node bigint, to_way bigint"
    if not _there(spark, path):
        return spark.createDataFrame([], ban)
    raw = spark.read.schema(f"{ban}, restrictions array<struct<{ban.replace(' bigint', ':bigint')}>>").option("multiLine", True).json(path)
    one = F.array(F.struct("from_way", "via_node", "to_way"))
    return raw.select(F.explode(F.coalesce("restrictions", one)).alias("r")).select("r.*").dropna().dropDuplicates()


def read_samples(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Sidecar CSV files of a recording as one table; malformed rows are dropped."""
    return spark.read.schema(schema).option("header", True).option("mode", "DROPMALFORMED").csv(pattern)


def _typed(spark: SparkSession, pattern: str, columns: dict[str, str]) -> DataFrame:
    """Columns of CSV files that share one header, by name; text that is no value of the type is null."""
    raw = spark.read.option("header", True).csv(pattern)
    return raw.select(*[(F.trim(c).try_cast(t) if c in raw.columns else F.lit(None).cast(t)).alias(c) for c, t in columns.items()])


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row of a JSON object; no row where the file is missing."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


INTRINSICS = "width int, height int, fx double, fy double, cx double, cy double"
CALIBRATION = "camera_height_m double, camera_pitch_offset_deg double, camera_roll_offset_deg double, camera_yaw_offset_deg double, min_distance_m double, max_distance_m double"


def read_recording(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """frames, imu, intrinsics and calibration of a recording: its frame_*.csv and imu_*.csv as tables, its JSON files as rows.

    Rows without one of the numbers they need are dropped; a missing calibration file gives an empty table, and the camera
    bounds that it leaves out are 0.1 and 200 m, its offsets 0.
    """
    frames = _typed(spark, f"{folder}/frame_*.csv", {"frame_index": "bigint", "timestamp_ns": "bigint"}).dropna()
    imu = _typed(spark, f"{folder}/imu_*.csv", {"timestamp_ns": "bigint", "pitch_deg": "double", "roll_deg": "double", "yaw_deg": "double", "accuracy": "int"})
    calibration = _document(spark, f"{folder}/monocular_calibration.json", CALIBRATION)
    offsets = {c: F.coalesce(c, F.lit(0.0)) for c in ("camera_pitch_offset_deg", "camera_roll_offset_deg", "camera_yaw_offset_deg")}
    bounds = {"min_distance_m": F.coalesce("min_distance_m", F.lit(0.1)), "max_distance_m": F.coalesce("max_distance_m", F.lit(200.0))}
    return {
        "frames": frames,
        "imu": imu.dropna(subset=["timestamp_ns", "pitch_deg", "roll_deg", "yaw_deg"]),
        "intrinsics": _document(spark, f"{folder}/intrinsics.json", INTRINSICS),
        "calibration": calibration.where("camera_height_m is not null").withColumns(offsets | bounds),
    }


def read_qr_log(spark: SparkSession, path: str) -> DataFrame:
    """seq, capture_timestamp_ns, source_timestamp_ns, decode_success of a log of decoded reads; a value counts only where the read succeeded."""
    raw = _typed(spark, path, {"decode_success": "string", "decoded_value": "bigint", "capture_ts_elapsed_ns": "bigint", "capture_index": "bigint"})
    ok = F.coalesce(F.lower("decode_success") == "true", F.lit(False))
    value = F.when(ok, F.col("decoded_value"))
    return raw.select(F.col("capture_index").alias("seq"), F.col("capture_ts_elapsed_ns").alias("capture_timestamp_ns"), value.alias("source_timestamp_ns"), (ok & value.isNotNull()).alias("decode_success"))


_POINT = "lat double, lng double"
_MADE = "created_at timestamp"
#: The operational tables and their columns; a point is two numbers.
TABLES = {
    "platform_account": f"user_id bigint, login_id string, password_hash string, user_name string, role string, is_active boolean, {_MADE}, updated_at timestamp",
    "vehicle": f"vehicle_id bigint, vehicle_code string, plate_number string, vehicle_name string, vehicle_source string, external_id string, max_load_kg decimal(10,2), height_m decimal(5,2), width_m decimal(5,2), length_m decimal(5,2), vehicle_status string, stream_url string, camera_height_m decimal(5,3), camera_pitch_deg decimal(6,2), camera_roll_deg decimal(6,2), camera_yaw_deg decimal(6,2), focal_length_mm decimal(6,2), sensor_width_mm decimal(6,2), is_active boolean, {_MADE}, updated_at timestamp",
    "driver": f"driver_id bigint, driver_name string, phone string, license_number string, driver_status string, {_MADE}, updated_at timestamp",
    "trip": f"trip_id bigint, vehicle_id bigint, driver_id bigint, origin_name string, origin_address string, origin_lat double, origin_lng double, destination_name string, destination_address string, destination_lat double, destination_lng double, trip_status string, planned_start_at timestamp, started_at timestamp, ended_at timestamp, actual_distance_m int, ai_summary string, ai_summary_generated_at timestamp, {_MADE}, updated_at timestamp",
    "trip_video": f"trip_video_id bigint, trip_id bigint, video_url string, start_frame_id bigint, end_frame_id bigint, started_at timestamp, ended_at timestamp, fps decimal(5,2), duration_sec int, {_MADE}",
    "route": f"route_id bigint, trip_id bigint, route_version int, route_type string, route_source string, source_metadata string, distance_m int, duration_sec int, encoded_polyline string, route_geojson string, route_line array<struct<lat:double,lng:double>>, is_current boolean, {_MADE}",
    "vehicle_position": f"position_id bigint, vehicle_id bigint, trip_id bigint, {_POINT}, speed_kmh decimal(6,2), heading_deg decimal(6,2), recorded_at timestamp, telemetry_source string",
    "route_deviation": f"deviation_id bigint, vehicle_id bigint, trip_id bigint, route_id bigint, deviation_distance_m decimal(10,2), {_POINT}, detected_at timestamp, resolved_at timestamp, recalculated_route_id bigint, {_MADE}",
    "object_class": "class_id bigint, model_class_id int, class_name string, display_name string, warning_distance_m decimal(6,2), is_alert_target boolean, is_active boolean",
    "detection_event": f"detection_event_id bigint, frame_id bigint, vehicle_id bigint, vehicle_code string, trip_id bigint, class_id bigint, class_name string, display_name string, confidence decimal(5,4), distance_m decimal(8,2), warning_distance_m decimal(8,2), risk_level string, {_POINT}, bbox_x1 decimal(10,4), bbox_y1 decimal(10,4), bbox_x2 decimal(10,4), bbox_y2 decimal(10,4), pitch_at_capture_deg decimal(6,3), roll_at_capture_deg decimal(6,3), telemetry_source string, detected_at timestamp, {_MADE}",
    "event_image": f"event_image_id bigint, detection_event_id bigint, image_url string, thumbnail_url string, captured_at timestamp, {_MADE}",
    "alert": f"alert_id bigint, vehicle_id bigint, detection_event_id bigint, route_deviation_id bigint, trip_id bigint, alert_type string, severity string, alert_message string, operator_note string, alert_status string, acknowledged_by bigint, acknowledged_at timestamp, resolved_at timestamp, {_MADE}",
    "transport_goal": f"goal_id bigint, goal_code string, destination_name string, destination_address string, destination_lat double, destination_lng double, cargo_weight_kg decimal(10,2), priority string, target_eta timestamp, goal_status string, assigned_vehicle_id bigint, assigned_trip_id bigint, completed_at timestamp, {_MADE}, updated_at timestamp",
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table under its declared schema (columns that its files lack are null), or as it lies where none is declared."""
    reader = spark.read.schema(TABLES[name]) if name in TABLES else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")


_ROUNDED = {"latitude": 7, "longitude": 7, "speed_kmh": 2}
#: The columns of both sinks, in order.
HYBRID_COLUMNS = ("emitted_at_utc", "line_number", "line_id", "vehicle_id", "longitude", "latitude", "speed_kmh", "direction", "source", "live_observed_at_utc", "live_age_s")
RAW_COLUMNS = (
    "observed_at_utc", "collection_session_id", "logical_trace_id", "line_number", "line_id", "vehicle_id", "longitude", "latitude", "speed_kmh", "direction",
    "api_direction_code", "gps_time", "low_plate", "stop_index", "route_stop_count", "route_point", "point_class", "continuation_from_vehicle_id",
)


def rounded(df: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """With the sinks' rounding: 7 digits for coordinates, 2 for speed; with columns just these, in order, missing ones null."""
    df = df.withColumns({c: F.round(c, n) for c, n in _ROUNDED.items()})
    return df if columns is None else df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def append_positions(df: DataFrame, path: str) -> None:
    """Positions emitted each second."""
    rounded(df, HYBRID_COLUMNS).write.mode("append").parquet(path)


def append_fixes(df: DataFrame, path: str) -> None:
    """Fixes as accepted from the feed."""
    rounded(df, RAW_COLUMNS).write.mode("append").parquet(path)


def stream_positions(stream: DataFrame, path: str, checkpoint: str, columns: tuple[str, ...] | None = None):
    """A started query whose sink writes each row of the stream once, rounded; with columns in their order."""
    return rounded(stream, columns).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def publish(df: DataFrame, path: str) -> str:
    """Write a whole new version of a document, then point to it; the old version stays where the write fails.

    The pointer is an empty file named by the time of its version, made only when all parts are there; making a file is
    one step in every store that Spark writes to.
    """
    spark = df.sparkSession
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{path}/versions/{name}")
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/current/{name}")
    place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, False).close()
    return name


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The newest version that was published whole."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/current")
    names = sorted(s.getPath().getName() for s in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place))
    return spark.read.parquet(f"{path}/versions/{names[-1]}")
