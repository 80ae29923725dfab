"""Fleet, road and media views over the driver tables: plain SQL for Spark and DuckDB, in the order of their use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "vehicle": """
select user_id as vehicle_id, concat('V-', cast(user_id as string)) as vehicle_code,
  case when user_id % 3 = 0 then 'BIMS' else 'CUSTOM' end as vehicle_source,
  concat('X', cast(user_id as string)) as external_id,
  case user_id % 5 when 0 then 'READY' when 1 then 'DRIVING' when 2 then 'STOPPED' when 3 then 'MAINTENANCE' else 'OFFLINE' end as vehicle_status
from (select distinct user_id from events) u""",
    "vehicle_position": """
select event_id as position_id, user_id as vehicle_id, user_id * 100 + day(ts) as trip_id,
  35.0 + ((event_id * 7919) % 3000) / 10000.0e0 as lat, 128.8 + ((event_id * 104729) % 4000) / 10000.0e0 as lng,
  value as speed_kmh, cast((event_id * 37) % 360 as double) as heading_deg, ts as recorded_at,
  case event_id % 4 when 0 then 'BIMS_LIVE' when 1 then 'BIMS_REPLAY' when 2 then 'DEVICE_GPS' else 'RECORDED_GPS' end as telemetry_source
from events""",
    "trip": """
select trip_id, min(vehicle_id) as vehicle_id, min(recorded_at) as started_at, max(recorded_at) as ended_at,
  case trip_id % 5 when 0 then 'READY' when 1 then 'IN_PROGRESS' when 2 then 'PAUSED' when 3 then 'COMPLETED' else 'CANCELLED' end as trip_status
from vehicle_position group by trip_id""",
    "route_point": """
select t.trip_id * 10 + v.route_version as route_id, t.trip_id, v.route_version, s.seq,
  35.0 + ((t.trip_id * 31 + v.route_version * 7 + s.seq * 211) % 3000) / 10000.0e0 as lat,
  128.8 + ((t.trip_id * 53 + v.route_version * 11 + s.seq * 307) % 4000) / 10000.0e0 as lng,
  v.route_version = 1 + cast(t.trip_id % 2 as int) as is_current
from trip t cross join (select 1 as route_version union all select 2) v
cross join (select 0 as seq union all select 1 union all select 2 union all select 3 union all select 4) s
where v.route_version <= 1 + t.trip_id % 2""",
    "detection_event": """
select event_id as detection_event_id, cast(floor(event_id / 500.0e0) as bigint) as session_id, cast(regexp_extract(props, '[0-9]+', 0) as bigint) as frame_id,
  event_id * 33333333 as capture_timestamp_ns, user_id as vehicle_id, user_id * 100 + day(ts) as trip_id,
  case event_type when 'error' then 'person' when 'click' then 'car' else 'bicycle' end as class_name,
  (event_id % 100) / 100.0e0 as confidence, case when event_id % 11 = 0 then null else value end as distance_m,
  5.0e0 as warning_distance_m, ts as detected_at
from events where event_type in ('error', 'click', 'signup')""",
    "frame_item": """
select event_id as frame_seq, cast(floor(event_id / 500.0e0) as bigint) as session_id, event_id * 33333333 as source_timestamp_ns,
  ((event_id * 13) % 800) / 1000.0e0 as x1, ((event_id * 17) % 500) / 1000.0e0 as y1,
  ((event_id * 13) % 800) / 1000.0e0 + 0.1e0 as x2, ((event_id * 17) % 500) / 1000.0e0 + 0.4e0 as y2
from events""",
    "imu_sample": """
select cast(floor(event_id / 500.0e0) as bigint) as session_id, event_id * 33333333 + (event_id % 7 - 3) * 9000000 as timestamp_ns,
  ((event_id % 21) - 10) / 10.0e0 as pitch_deg, ((event_id % 13) - 6) / 10.0e0 as roll_deg
from events where event_id % 2 = 0 and event_id % 40 not between 20 and 27""",
    "qr_read": """
select cast(floor(event_id / 500.0e0) as bigint) as session_id, event_id as seq, event_id * 33333333 as capture_timestamp_ns,
  case when event_id % 5 = 0 or event_id % 100 between 40 and 52 then null else (event_id % 430) * 33333333 end as source_timestamp_ns,
  not (event_id % 5 = 0 or event_id % 100 between 40 and 52) as decode_success from events""",
    "packet": """
select cast(floor(event_id / 500.0e0) as bigint) as session_id, event_id * 10 + case when event_id % 77 = 0 then 25 else 0 end as arrival,
  (event_id + 60000) % 65536 as seq16, (event_id * 3000 + 4290000000) % 4294967296 as rtp_timestamp from events where event_id % 50 <> 0""",
    "video_time_anchor": """
select cast(floor(event_id / 500.0e0) as bigint) as session_id, event_id % 2 as trip_video_id, event_id * 33333333 as capture_timestamp_ns,
  event_id * 33333 - 500000 as video_pts_us from events where event_id % 10 = 0""",
    "stage_counter": """
select user_id as source_id, ts as sampled_at, count(*) over (partition by user_id order by ts, event_id rows unbounded preceding) as frames_inferred,
  sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding) as model_ms_total from events""",
    "osm_node": """
select p_partkey as node_id, 35.0 + ((p_partkey * 7919) % 3000) / 10000.0e0 as lat,
  128.8 + ((p_partkey * 104729) % 4000) / 10000.0e0 as lon from part""",
    "osm_way_ref": """
select l_orderkey as way_id, l_linenumber as seq, min(l_partkey) as node_id from lineitem group by l_orderkey, l_linenumber""",
    "osm_way": """
select o_orderkey as way_id,
  case when o_orderkey % 31 = 0 then 'track' else case o_orderpriority when '1-URGENT' then 'motorway' when '2-HIGH' then 'primary' when '3-MEDIUM' then 'residential' when '4-NOT SPECIFIED' then 'service' else 'footway' end end as highway,
  case when o_orderkey % 4 = 0 then 'yes' end as oneway,
  case when o_orderkey % 10 = 0 then '3.5 m' when o_orderkey % 10 = 1 then '4.5' end as maxheight,
  case when o_orderkey % 9 = 0 then '40t' end as maxweight,
  case when o_orderkey % 12 = 0 then '2.5 m' when o_orderkey % 12 = 5 then '3.3' when o_orderkey % 37 = 0 then '1.8m' end as maxwidth,
  case when o_orderkey % 14 = 0 then '18' when o_orderkey % 14 = 3 then '19.5 m' end as maxlength,
  case when o_orderkey % 17 = 0 then 'no' when o_orderkey % 17 = 1 then 'destination' end as hgv,
  case when o_orderkey % 50 = 0 then 'private' when o_orderkey % 50 = 7 then 'destination' end as access from orders""",
    "turn_ban": """
select distinct a.way_id as from_way, a.node_id as via_node, b.way_id as to_way from osm_way_ref a
join osm_way_ref b on a.node_id = b.node_id and a.way_id <> b.way_id where (a.way_id * 7 + b.way_id) % 97 = 0""",
    "facility": """
select s_suppkey as facility_id, 35.0 + ((s_suppkey * 6151) % 3000) / 10000.0e0 as lat,
  128.8 + ((s_suppkey * 9973) % 4000) / 10000.0e0 as lon, (s_suppkey % 80) / 10.0e0 as height_m,
  (s_suppkey % 40) * 1.0e0 as width_m from supplier""",
    "stop": """
select c_nationkey as line_no, c_custkey as stop_index, case when c_custkey % 6 = 0 then null else cast(c_custkey % 700 as string) end as ars_number,
  case when c_custkey % 4 = 0 then null else cast(c_custkey as string) end as node_id from customer""",
    "catalog_stop": """
select cast(p_partkey % 700 as string) as arsno, cast(p_partkey as string) as bstopid,
  case when p_partkey % 37 = 0 then 0.0e0 else 35.0 + (p_partkey % 3000) / 10000.0e0 end as gpsy, 128.8 + (p_partkey % 4000) / 10000.0e0 as gpsx from part""",
    "transport_goal": """
select o_orderkey as goal_id, case o_orderstatus when 'F' then 'COMPLETED' when 'O' then 'IN_PROGRESS' else 'PENDING' end as goal_status,
  o_orderdate + interval '3' day as target_eta, o_custkey as assigned_vehicle_id from orders""",
    "alert": """
select detection_event_id * 2 as alert_id, vehicle_id, detection_event_id, cast(null as bigint) as route_deviation_id, cast(null as bigint) as trip_id,
  'OBJECT_PROXIMITY' as alert_type, case when distance_m < 2 then 'CRITICAL' else 'WARNING' end as severity,
  case detection_event_id % 3 when 0 then 'UNCONFIRMED' when 1 then 'ACKNOWLEDGED' else 'RESOLVED' end as alert_status, detected_at as created_at
from detection_event where distance_m < 5
union all
select trip_id * 2 + 1, vehicle_id, cast(null as bigint), cast(null as bigint), trip_id, 'TRIP_COMPLETED', 'INFO', 'UNCONFIRMED', ended_at from trip where trip_status = 'COMPLETED'""",
    "feed_item": """
select event_id as item_id, concat(' l', cast(user_id % 40 as string), ' ') as line_no, cast(floor(event_id / 200.0e0) as bigint) as payload_id, cast(event_id % 30 as int) as stop_index,
  case when event_id % 30 in (0, 11, 19) and user_id % 3 > 0 then 'Y' else 'N' end as marker, case when event_id % 4 = 0 then null else concat('B', cast(user_id % 90 as string)) end as vehicle_no,
  ts as gps_time, 35.0 + ((user_id * 7919) % 3000) / 10000.0e0 as lat, 128.8 + ((user_id * 104729) % 4000) / 10000.0e0 as lng from events""",
    "line_candidate": """
select concat('L', cast(user_id % 40 as string)) as asked, concat('l ', cast(user_id % 60 as string)) as public_no, user_id as line_id from events""",
    "trace_point": """
select concat('L', cast(user_id % 20 as string)) as line_no, case user_id % 3 when 0 then 'outbound' when 1 then 'inbound' else 'full_route' end as direction, concat('T', cast(user_id as string)) as trace_id,
  event_id as point_id, case when event_id % 9 = 0 then 'duplicate' when event_id % 13 = 0 then 'rejected_jump' else 'ok' end as point_class, date_trunc('hour', ts) as recorded_at,
  35.0 + ((event_id * 7919) % 3000) / 10000.0e0 as lat, 128.8 + ((event_id * 104729) % 4000) / 10000.0e0 as lng, case when event_id % 6 = 0 then null else value end as speed_kmh from events""",
    "feed_fix": """
select event_id as fix_id, concat('L', cast(user_id % 25 as string)) as line_no, case event_id % 3 when 0 then 'outbound' when 1 then 'inbound' else 'full_route' end as direction,
  35.0 + ((event_id * 6151) % 3000) / 10000.0e0 as lat, 128.8 + ((event_id * 9973) % 4000) / 10000.0e0 as lng, ts as observed_at from events where event_type = 'view'""",
    "live_fix": """
select fix_id, line_no, direction, 'B1' as vehicle_no, fix_id as payload_id, lat, lng, timestamp '2024-01-01 00:00:00' + fix_id * interval '3' second as observed_at from feed_fix""",
    "relation": """
select o_orderkey as rel_id, case o_orderkey % 7 when 0 then 'only_left_turn' when 1 then 'no_u_turn' when 2 then 'no_left_turn' when 3 then 'other' else 'no_right_turn' end as restriction from orders""",
    "relation_member": """
select o_orderkey as rel_id, 0 as pos, 'way' as mtype, o_orderkey as ref, 'from' as role from orders where o_orderkey % 11 > 0
union all select o_orderkey, 1, 'node', o_custkey, 'via' from orders
union all select o_orderkey, 2, case when o_orderkey % 13 = 0 then 'relation' else 'way' end, o_orderkey + 1, 'to' from orders""",
}

#: Which views and driver tables a view reads.
_TABLES = ("events", "orders", "lineitem", "part", "customer", "supplier")  # feed, road and catalogue tables


def needed(*names: str) -> list[str]:
    """The views that the named ones read, themselves included, in order of definition."""
    todo, found = list(names), set()
    while todo:
        name = todo.pop()
        if name in VIEWS and name not in found:
            found.add(name)
            todo += [v for v in VIEWS if v != name and f" {v} " in f" {VIEWS[name].replace(chr(10), ' ')} "]
    return [v for v in VIEWS if v in found]


def register(spark: SparkSession, sf_dir: str) -> None:
    """Temp views of the driver tables in sf_dir and of everything above."""
    for t in _TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for name, sql in VIEWS.items():
        spark.sql(sql).createOrReplaceTempView(name)


def view(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def with_views(sql: str, *names: str) -> str:
    """sql behind the views it reads, as common table expressions."""
    ctes = ",\n".join(f"{v} as ({VIEWS[v].strip()})" for v in needed(*names))
    body = sql.strip()
    if not ctes:
        return body
    return f"with {ctes},\n{body[5:]}" if body.lower().startswith("with ") else f"with {ctes}\n{body}"
