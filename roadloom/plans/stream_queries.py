"""Registered queries through files, stored versions, stored sketches and streams, over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.operators import history as h
from roadloom.operators import sketches
from roadloom.plans.feed_queries import _PAIR, _PAIRED
from roadloom.plans.queries import ORACLE, query, r6
from roadloom.sources import tables, versions
from roadloom.sources.scratch import materialize, shared_dir
from roadloom.streaming import pairing, states


def _place(df: DataFrame) -> str:
    return f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"


def _files(df: DataFrame) -> DataFrame:
    """df as a stream: its rows are written first, then read as they would come."""
    path = _place(df)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def _replayed(stream: DataFrame) -> DataFrame:
    """All that a stream gives until its files are read."""
    path = _place(stream)
    q = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


@query(ORACLE["sequence_gaps"].replace("select session_id, arrival, late", "select session_id, arrival, seq16, late"))
def packet_epochs_stream(v):
    """Late packets, gaps and epochs by the stream's state of two numbers a session."""
    p = v("packet").select("session_id", "arrival", "seq16")
    return _replayed(states.packet_epochs(_files(p)))


@query(f"with {_PAIR} select session_id, event_id, frame_seq, exact from ({_PAIRED.replace('select event_id', 'select session_id, event_id')}) p", "frame_item", "qr_read")
def event_frames_stream(v):
    """event_frames by the stream's operator, its clock begun at one second. A last row far ahead lets event time pass all others."""
    f = v("frame_item").selectExpr("session_id", "frame_seq", "source_timestamp_ns as media_ts", "source_timestamp_ns + 1005000000 as received")
    last = f.sparkSession.range(1).selectExpr("-1L as session_id", "-1L as frame_seq", "cast(null as bigint) as media_ts", "4000000000000000000L as received")
    e = v("qr_read").selectExpr("session_id", "seq as event_id", "coalesce(source_timestamp_ns, -1) as media_ts", "capture_timestamp_ns + 1000000000 + (seq % 9) * 40000000 as received", "case when seq % 3 > 0 then 20000000 else -1 end as latency")
    return _replayed(pairing.pair_stream(_files(f.unionByName(last)), _files(e), hold=20_000_000_000))


@query("""with p as (select upper(regexp_replace(line_no, '\\s+', '', 'g')) as line_no, direction, trace_id, epoch_us(cast(recorded_at as timestamp)) as t, lat, lng, speed_kmh, point_id from trace_point where point_class = 'ok'),
o as (select *, row_number() over (partition by line_no, direction, trace_id, t order by point_id) as rn from p)
select line_no, direction, trace_id, (t - min(t) over (partition by line_no, direction, trace_id)) / 1e6 as trace_time_s, round(lat, 6) as lat, round(lng, 6) as lng, round(speed_kmh, 6) as speed_kmh from o where rn = 1""", "trace_point")
def history_files(v):
    """The trace points as files of the collector's layout, read back: keys normalised, bad points gone, clocks by trace."""
    ok = F.col("point_class") == "ok"
    one = F.row_number().over(h.Window.partitionBy("line_no", "direction", "trace_id", "recorded_at", ok).orderBy("point_id"))
    p = v("trace_point").withColumn("rn", one).where(~ok | (F.col("rn") == 1))
    short = F.when(F.col("direction") == "outbound", "out").when(F.col("direction") == "inbound", "IN ").otherwise("full_route")
    at = F.date_format("recorded_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = p.select(F.concat(F.lit(" "), F.lower("line_no")).alias("line_number"), short.alias("direction"), F.lit("").alias("logical_trace_id"), F.col("trace_id").alias("vehicle_id"), at.alias("observed_at_utc"), F.col("lat").alias("latitude"), F.col("lng").alias("longitude"), "speed_kmh", "point_class")
    path = _place(rows)
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    got = tables.read_history(rows.sparkSession, path)
    return got.select("line_no", "direction", "trace_id", "trace_time_s", r6("lat").alias("lat"), r6("lng").alias("lng"), r6("speed_kmh").alias("speed_kmh"))


@query("""with s as (select concat('X', cast(user_id + 50 as string)) as external_id, event_type as st, row_number() over (partition by user_id order by case event_type when 'error' then 3 when 'click' then 2 else 1 end desc) as rn from (select distinct user_id, event_type from events where event_type in ('error', 'click', 'view')) q)
select coalesce(v.vehicle_source, 'BIMS') as vehicle_source, coalesce(v.external_id, s.external_id) as external_id, coalesce(vehicle_code, substr(concat('BIMS-', s.external_id), 1, 50)) as vehicle_code, coalesce(upper(st), vehicle_status) as vehicle_status
from vehicle v full join (select * from s where rn = 1) s on v.vehicle_source = 'BIMS' and v.external_id = s.external_id""", "vehicle")
def versioned_vehicles(v):
    """The vehicles as a table of buckets after three sets of seen statuses, each rewriting the buckets it touches."""
    dim = v("vehicle").select("vehicle_source", "external_id", "vehicle_code", "vehicle_status")
    spark, path = dim.sparkSession, _place(dim)
    versions.create(dim, path, ["vehicle_source", "external_id"], 8)
    for kind in ("view", "click", "error"):
        seen = v("events").where(F.col("event_type") == kind).select(F.lit("BIMS").alias("vehicle_source"), F.concat(F.lit("X"), (F.col("user_id") + 50).cast("string")).alias("external_id"), F.lit(kind.upper()).alias("vehicle_status")).distinct()
        versions.change(spark, path, seen, h.upsert_vehicles)
    return versions.read(spark, path)


@query("""with f as (select concat('m', cast(event_id % 3 as string)) as model_version, value from events where event_id % 10 <> 0 and cast(ts as date) >= date '2024-01-03')
select model_version, count(*) as inferred, min(value) as least_ms, max(value) as worst_ms, true as median_near, true as p99_near from f group by 1""")
def sketched_latency(v):
    """Latency by model over stored day sketches; whether the ranks of the median and of p99 are within 3 / K, by the raw rows."""
    f = v("events").where("event_id % 10 <> 0").select(F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("model_version"), "ts", "value")
    path = _place(f)
    sketches.store_days(sketches.day_sketches(f, ["model_version"], "ts", "value"), path)
    q = materialize(sketches.quantiles(sketches.stored_days(f.sparkSession, path), ["model_version"], {"p50": 0.5, "p99": 0.99}, "2024-01-03"))
    ranks = f.where("to_date(ts) >= date '2024-01-03'").join(F.broadcast(q), "model_version").groupBy("model_version", "n", "least", "most")
    near = lambda p, r: (F.abs(F.avg((F.col("value") <= F.col(p)).cast("double")) - r) <= 3 / sketches.K + F.lit(1) / F.first("n"))
    return ranks.agg(near("p50", 0.5).alias("median_near"), near("p99", 0.99).alias("p99_near")).select("model_version", F.col("n").alias("inferred"), F.col("least").alias("least_ms"), F.col("most").alias("worst_ms"), "median_near", "p99_near")
