"""Registered queries of the fleet, road and media operators, with SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions import scalars
from roadloom.operators import history as h
from roadloom.operators import reference_data as ref
from roadloom.operators import roadnet as road
from roadloom.operators import timeseries as ts
from roadloom.plans.fixtures import register, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Registers f(view by name) under its name, and its SQL."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            register(spark, sf_dir)
            return f(lambda name: view(spark, name))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = with_views(sql, *views)
        return f

    return add


def r6(c):
    return F.round(c, 6)


def hav(a: str, b: str, c: str, d: str) -> str:
    return f"2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


_LAST = "row_number() over (partition by {} order by recorded_at desc, position_id desc) as rn"
_CENTERS = "c as (select facility_id as center_id, lat as clat, lon as clng from facility)"


@query(f"select vehicle_id, position_id, lat, lng, speed_kmh from (select *, {_LAST.format('vehicle_id')} from vehicle_position) t where rn = 1", "vehicle_position")
def latest_position(v):
    return h.latest(v("vehicle_position"), ["vehicle_id"], ["recorded_at", "position_id"]).select("vehicle_id", "position_id", "lat", "lng", "speed_kmh")


def _centers(v):
    return v("facility").select(F.col("facility_id").alias("center_id"), F.col("lat").alias("center_lat"), F.col("lon").alias("center_lng"))


@query(f"""with {_CENTERS}, d as (select center_id, vehicle_id, position_id, recorded_at, {hav('clat', 'clng', 'lat', 'lng')} as m from vehicle_position, c),
l as (select *, row_number() over (partition by center_id, vehicle_id order by recorded_at desc, position_id desc) as rn from d where m <= 3000)
select center_id, vehicle_id, position_id, round(m, 6) as distance_m from l where rn = 1""", "vehicle_position", "facility")
def nearby_latest_in_radius(v):
    return h.within_radius(v("vehicle_position"), _centers(v), 3000.0, "latest_in_radius").select("center_id", "vehicle_id", "position_id", r6("distance_m").alias("distance_m"))


@query(f"""with {_CENTERS}, l as (select *, {_LAST.format('vehicle_id')} from vehicle_position), d as (select center_id, vehicle_id, position_id, {hav('clat', 'clng', 'lat', 'lng')} as m from l, c where rn = 1)
select center_id, vehicle_id, position_id, round(m, 6) as distance_m from d where m <= 5000""", "vehicle_position", "facility")
def nearby_latest_then_radius(v):
    return h.within_radius(v("vehicle_position"), _centers(v), 5000.0, "latest_then_radius").select("center_id", "vehicle_id", "position_id", r6("distance_m").alias("distance_m"))


_LEGS = f"""l as (select *, lag(lat) over w as plat, lag(lng) over w as plng, lag(recorded_at) over w as pt from vehicle_position window w as (partition by trip_id order by recorded_at, position_id)),
g as (select *, {hav('plat', 'plng', 'lat', 'lng')} as leg_m, epoch_us(recorded_at - pt) / 1e6 as leg_s from l)"""


@query(f"with {_LEGS} select position_id, trip_id, round(leg_m, 6) as leg_m, round(leg_s, 6) as leg_s, round(case when leg_s > 0 then leg_m / leg_s * 3.6 end, 6) as leg_kmh from g".replace("epoch_us(recorded_at - pt)", "(epoch_us(recorded_at) - epoch_us(pt))"), "vehicle_position")
def legs(v):
    return h.legs(v("vehicle_position")).select("position_id", "trip_id", *[r6(c).alias(c) for c in ("leg_m", "leg_s", "leg_kmh")])


@query(f"with {_LEGS} select trip_id, round(coalesce(sum(leg_m), 0), 5) as distance_m, count(*) as points from g group by trip_id".replace("epoch_us(recorded_at - pt)", "(epoch_us(recorded_at) - epoch_us(pt))"), "vehicle_position")
def trip_distance(v):
    return h.trip_distance(v("vehicle_position")).select("trip_id", F.round("distance_m", 5).alias("distance_m"), "points")


@query("select trip_id, position_id, lat, lng, speed_kmh from vehicle_position where recorded_at between timestamp '2024-01-01 06:00:00' and timestamp '2024-01-03 06:00:00' order by trip_id, recorded_at, position_id", "vehicle_position")
def trip_track(v):
    window = F.col("recorded_at").between(F.lit("2024-01-01 06:00:00").cast("timestamp_ntz"), F.lit("2024-01-03 06:00:00").cast("timestamp_ntz"))
    return v("vehicle_position").where(window).orderBy("trip_id", "recorded_at", "position_id").select("trip_id", "position_id", "lat", "lng", "speed_kmh")


_SEG = "sqrt(pow(px - t * dx, 2) + pow(py - t * dy, 2))"
_MEASURED = f"""s as (select trip_id, route_id, lat as lat1, lng as lon1, lead(lat) over w as lat2, lead(lng) over w as lon2 from route_point where is_current window w as (partition by route_id order by seq)),
j as (select p.trip_id, p.position_id, p.recorded_at, s.route_id, cos(radians((lat1 + lat2) / 2)) * 111320.0 as k, lat, lng, lat1, lon1, lat2, lon2 from vehicle_position p join s on p.trip_id = s.trip_id where lat2 is not null),
k as (select *, (lon2 - lon1) * k as dx, (lat2 - lat1) * 111320.0 as dy, (lng - lon1) * k as px, (lat - lat1) * 111320.0 as py from j),
t as (select *, case when dx * dx + dy * dy > 0 then greatest(0.0, least(1.0, (px * dx + py * dy) / (dx * dx + dy * dy))) else 0.0 end as t from k),
m as (select trip_id, position_id, route_id, min(recorded_at) as recorded_at, min({_SEG}) as distance_m from t group by trip_id, position_id, route_id)"""


@query(f"with {_MEASURED} select trip_id, position_id, route_id, round(distance_m, 6) as distance_m from m where distance_m >= 500", "vehicle_position", "route_point")
def deviation_events(v):
    return h.deviations(v("vehicle_position"), v("route_point"), 500.0).select("trip_id", "position_id", "route_id", r6("distance_m").alias("distance_m"))


@query(f"with {_MEASURED} select trip_id, position_id, route_id, round(distance_m, 6) as distance_m from (select *, row_number() over (partition by trip_id order by recorded_at desc, position_id desc) as rn from m) q where rn = 1", "vehicle_position", "route_point")
def current_deviation(v):
    return h.current_deviation(v("vehicle_position"), v("route_point")).select("trip_id", "position_id", "route_id", r6("distance_m").alias("distance_m"))


@query(f"""with {_MEASURED}, o as (select *, distance_m >= 5000 as off from m), f as (select *, case when off and not coalesce(lag(off) over w, false) then 1 else 0 end as n from o window w as (partition by trip_id order by recorded_at, position_id)),
i as (select *, sum(n) over (partition by trip_id order by recorded_at, position_id) as island from f)
select trip_id, cast(island as bigint) as island, count(*) as samples, round(max(distance_m), 6) as max_m from i where off group by trip_id, island""", "vehicle_position", "route_point")
def deviation_episodes(v):
    return h.deviation_episodes(v("vehicle_position"), v("route_point"), 5000.0).select("trip_id", F.col("island").cast("long").alias("island"), "samples", r6("max_m").alias("max_m"))


@query("""with o as (select *, row_number() over (partition by vehicle_id order by started_at desc, trip_id desc) as rn from trip where trip_status in ('READY', 'IN_PROGRESS', 'PAUSED')),
r as (select trip_id, route_id, route_version, row_number() over (partition by trip_id order by route_version desc, route_id desc) as rn from route_point where is_current)
select o.vehicle_id, o.trip_id, o.trip_status, r.route_id, r.route_version from o left join r on o.trip_id = r.trip_id and r.rn = 1 where o.rn = 1""", "trip", "route_point")
def open_trip_route(v):
    return h.open_trip_route(v("trip"), v("route_point"))


@query("select route_id, trip_id, route_version, seq, route_version = max(route_version) over (partition by trip_id) as is_current from route_point", "route_point")
def current_route(v):
    return h.switch_route(v("route_point")).select("route_id", "trip_id", "route_version", "seq", "is_current")


@query("select alert_id, vehicle_id, alert_type, severity from alert where alert_status = 'UNCONFIRMED' order by created_at desc, alert_id desc limit 100", "alert")
def event_feed(v):
    return h.event_feed(v("alert"), 100).select("alert_id", "vehicle_id", "alert_type", "severity")


@query("""with s as (select 'BIMS' as vehicle_source, concat('X', cast(user_id + 50 as varchar)) as external_id, max(case when event_type = 'error' then 'STOPPED' else 'DRIVING' end) as st from events group by user_id)
select coalesce(v.vehicle_source, s.vehicle_source) as vehicle_source, coalesce(v.external_id, s.external_id) as external_id, coalesce(vehicle_code, substr(concat('BIMS-', s.external_id), 1, 50)) as vehicle_code, coalesce(st, vehicle_status) as vehicle_status
from vehicle v full join s on v.vehicle_source = s.vehicle_source and v.external_id = s.external_id""".replace("as varchar", "as string"), "vehicle")
def upsert_vehicles(v):
    status = F.max(F.when(F.col("event_type") == "error", "STOPPED").otherwise("DRIVING")).alias("vehicle_status")
    seen = v("events").groupBy("user_id").agg(status).select(F.lit("BIMS").alias("vehicle_source"), F.concat(F.lit("X"), (F.col("user_id") + 50).cast("string")).alias("external_id"), "vehicle_status")
    return h.upsert_vehicles(v("vehicle"), seen)


_NEAR = "l as (select f.frame_seq, f.session_id, f.source_timestamp_ns as t, s.timestamp_ns, s.pitch_deg, s.roll_deg, row_number() over (partition by f.frame_seq order by abs(s.timestamp_ns - f.source_timestamp_ns), s.timestamp_ns) as rn from frame_item f left join imu_sample s on f.session_id = s.session_id and s.timestamp_ns between f.source_timestamp_ns - 50000000 and f.source_timestamp_ns + 50000000)"


@query(f"with {_NEAR} select frame_seq, timestamp_ns as imu_ns, pitch_deg, roll_deg from l where rn = 1", "frame_item", "imu_sample")
def imu_nearest(v):
    j = ts.nearest_asof(v("frame_item"), v("imu_sample"), ["session_id"], "source_timestamp_ns", "timestamp_ns", 50_000_000)
    return j.select("frame_seq", F.col("timestamp_ns_matched").alias("imu_ns"), "pitch_deg", "roll_deg")


@query("""with f as (select session_id, frame_seq, source_timestamp_ns as t from frame_item where frame_seq % 5 = 0), r as (select session_id, seq, capture_timestamp_ns as c from qr_read),
a as (select r.*, frame_seq, t, row_number() over (partition by r.session_id, seq order by abs(t - c), t) as rn from r left join f on f.session_id = r.session_id and t between c - 50000000 and c + 50000000),
b as (select a.*, s.timestamp_ns as i, pitch_deg, row_number() over (partition by a.session_id, seq order by abs(s.timestamp_ns - t), s.timestamp_ns) as k from (select * from a where rn = 1) a left join imu_sample s on s.session_id = a.session_id and s.timestamp_ns between t - 20000000 and t + 20000000)
select session_id, seq, frame_seq as frame_index, abs(t - c) as frame_delta_ns, i as imu_ns, abs(i - t) as imu_delta_ns, pitch_deg, case when t is null then 'dataset_timestamp_unavailable' when i is null then 'imu_unavailable' else 'ok' end as status from b where k = 1""", "frame_item", "qr_read", "imu_sample")
def timeline_match(v):
    """Every read's frame of a thinned recording, and that frame's sample within 20 ms."""
    reads = v("qr_read").select("session_id", "seq", "capture_timestamp_ns")
    frames = v("frame_item").where("frame_seq % 5 = 0").select("session_id", F.col("frame_seq").alias("frame_index"), F.col("source_timestamp_ns").alias("timestamp_ns"))
    j = ts.timeline(reads, frames, v("imu_sample"), ["session_id"], "capture_timestamp_ns", imu_ns=20_000_000)
    return j.select("session_id", "seq", "frame_index", "frame_delta_ns", "imu_ns", "imu_delta_ns", "pitch_deg", "status")


@query(f"""with {_NEAR}, a as (select f.frame_seq, (((x1 + x2) / 2) * 1280 - 640) / 920 as rx, (y2 * 720 - 360) / 690 as ry, radians(pitch_deg) as p, radians(roll_deg) as r from frame_item f join l on l.frame_seq = f.frame_seq and rn = 1),
b as (select *, cos(r) * rx - sin(r) * ry as x, sin(r) * rx + cos(r) * ry as y from a), c as (select *, cos(p) * y + sin(p) as gy, cos(p) - sin(p) * y as gz from b),
d as (select *, sqrt(pow(2.0 / gy * x, 2) + pow(2.0 / gy * gz, 2)) as m from c),
e as (select frame_seq, m, case when p is null then 'imu_unavailable' when gy <= 1e-6 then 'invalid_ray' when not (m between 0.1 and 200) then 'distance_out_of_range' else 'ok' end as status from d)
select frame_seq, status, round(case when status = 'ok' then m end, 6) as distance_m from e""", "frame_item", "imu_sample")
def ground_distance(v):
    j = ts.nearest_asof(v("frame_item"), v("imu_sample"), ["session_id"], "source_timestamp_ns", "timestamp_ns", 50_000_000)
    g = scalars.ground_distance((F.col("x1") + F.col("x2")) / 2, F.col("y2"), F.col("pitch_deg"), F.col("roll_deg"), 2.0)
    return j.withColumn("g", g).select("frame_seq", F.col("g.status").alias("status"), r6("g.distance").alias("distance_m"))


@query("""with e as (select detection_event_id, session_id, capture_timestamp_ns as t, detection_event_id % 2 as trip_video_id from detection_event),
b as (select e.*, lo.capture_timestamp_ns as t0, lo.video_pts_us as p0 from e asof left join video_time_anchor lo on e.session_id = lo.session_id and e.trip_video_id = lo.trip_video_id and e.t >= lo.capture_timestamp_ns),
c as (select b.*, hi.capture_timestamp_ns as t1, hi.video_pts_us as p1 from b asof left join video_time_anchor hi on b.session_id = hi.session_id and b.trip_video_id = hi.trip_video_id and b.t <= hi.capture_timestamp_ns)
select detection_event_id, round(case when t1 = t0 then cast(p0 as double) else p0 + (t - t0) * (p1 - p0) / cast(t1 - t0 as double) end, 3) as pts_us from c""", "detection_event", "video_time_anchor")
def video_pts(v):
    e = v("detection_event").select("detection_event_id", "session_id", "capture_timestamp_ns", (F.col("detection_event_id") % 2).alias("trip_video_id"))
    return ts.to_video_pts(e, v("video_time_anchor"), ["session_id", "trip_video_id"]).select("detection_event_id", F.round("pts_us", 3).alias("pts_us"))


@query("""with s as (select *, max(case when decode_success then seq end) over (partition by session_id order by seq) as hs from qr_read),
j as (select s.seq, s.session_id, s.decode_success, s.capture_timestamp_ns as c, o.capture_timestamp_ns as hc, o.source_timestamp_ns as hv from s left join qr_read o on o.session_id = s.session_id and o.seq = s.hs),
k as (select *, case when decode_success then 'ok' when hv is not null and greatest(0, c - hc) <= 200000000 then 'qr_stale' else 'qr_missing' end as status from j)
select seq, status, case when status <> 'qr_missing' then hv end as resolved_ns from k""", "qr_read")
def qr_resolve(v):
    return ts.qr_resolve(v("qr_read")).select("seq", "status", "resolved_ns")


@query("""with d as (select *, lag(source_timestamp_ns) over (partition by session_id order by seq) as p from qr_read where decode_success),
f as (select q.seq, q.session_id, case when d.source_timestamp_ns < d.p - 2000000 then 1 else 0 end as n from qr_read q left join d on q.seq = d.seq)
select seq, cast(sum(n) over (partition by session_id order by seq) as bigint) as epoch from f""", "qr_read")
def rewind_epoch(v):
    return ts.rewind_epoch(v("qr_read")).select("seq", F.col("epoch").cast("long").alias("epoch"))


_UNWRAP = "select *, {c} + sum(n) over (partition by session_id order by arrival) as u from (select *, case when d < -{half} then {full} when d > {half} then -{full} else 0 end as n from (select *, {c} - lag({c}) over (partition by session_id order by arrival) as d from packet) q) q2"


@query(f"select session_id, arrival, cast(u as bigint) as unwrapped from ({_UNWRAP.format(c='rtp_timestamp', half=1 << 31, full=1 << 32)}) z", "packet")
def counter_unwrap(v):
    return ts.unwrap(v("packet"), "rtp_timestamp", 32, "session_id", "arrival").select("session_id", "arrival", F.col("unwrapped").cast("long").alias("unwrapped"))


@query(f"""with u as ({_UNWRAP.format(c='seq16', half=1 << 15, full=1 << 16)}), b as (select *, max(u) over (partition by session_id order by arrival rows between unbounded preceding and 1 preceding) as best from u),
l as (select *, coalesce(u <= best, false) as late, coalesce(u > best + 1, false) as gap from b)
select session_id, arrival, late, gap, cast(sum(case when gap then 1 else 0 end) over (partition by session_id order by arrival) as bigint) as epoch from l""", "packet")
def sequence_gaps(v):
    return ts.sequence_gaps(v("packet")).select("session_id", "arrival", "late", "gap", F.col("epoch").cast("long").alias("epoch"))


@query("""with a as (select source_id, date_trunc('hour', sampled_at) as slot, max(frames_inferred) as f from stage_counter group by 1, 2), l as (select a.source_id, slot, f, max(sampled_at) as s, max(model_ms_total) as m from a join stage_counter c on c.source_id = a.source_id and c.frames_inferred = a.f group by 1, 2, 3),
d as (select *, greatest(0, f - lag(f) over w) as df, greatest(0.0, m - lag(m) over w) as dm, (epoch_us(s) - lag(epoch_us(s)) over w) / 1e6 as e from l window w as (partition by source_id order by slot))
select source_id, cast(df as bigint) as frames, round(e, 6) as elapsed_s, round(case when e > 0 then df / e end, 6) as fps, round(case when df > 0 then dm / df else 0 end, 6) as mean_ms from d where e is not null""", "stage_counter")
def stage_metrics(v):
    m = ts.stage_metrics(v("stage_counter"))
    return m.select("source_id", F.col("frames").cast("long").alias("frames"), *[r6(c).alias(c) for c in ("elapsed_s", "fps", "mean_ms")])


@query("""with p as (select customer.c_custkey as point_id, 35.0 + ((c_custkey * 4241) % 3000) / 10000.0e0 as lat, 128.8 + ((c_custkey * 9973) % 4000) / 10000.0e0 as lon from customer),
j as (select point_id, node_id, round(pow(v.lat - p.lat, 2) + pow(v.lon - p.lon, 2), 12) as d2 from p join osm_node v on abs(floor(p.lat / 0.01) - floor(v.lat / 0.01)) <= 1 and abs(floor(p.lon / 0.01) - floor(v.lon / 0.01)) <= 1)
select point_id, node_id from (select *, row_number() over (partition by point_id order by d2, node_id) as rn from j) q where rn = 1""", "osm_node")
def nearest_vertex(v):
    p = v("customer").selectExpr("c_custkey as point_id", "35.0 + ((c_custkey * 4241) % 3000) / 10000.0e0 as lat", "128.8 + ((c_custkey * 9973) % 4000) / 10000.0e0 as lon")
    return road.nearest_vertex(p, v("osm_node"))


_WAYS = "('" + "', '".join(scalars.BASE_KMH) + "')"
_NEARWAY = f"""s as (select r.way_id, lat as lat1, lon as lon1, lead(lat) over w as lat2, lead(lon) over w as lon2 from osm_way_ref r join osm_way y on r.way_id = y.way_id and highway in {_WAYS} join osm_node n on n.node_id = r.node_id window w as (partition by r.way_id order by seq)),
k as (select facility_id, way_id, cos(radians((lat1 + lat2) / 2)) * 111320.0 as k, lat, lon, lat1, lon1, lat2, lon2 from s join facility f on lat2 is not null and f.lat between least(lat1, lat2) - 0.002 and greatest(lat1, lat2) + 0.002 and f.lon between least(lon1, lon2) - 0.002 and greatest(lon1, lon2) + 0.002),
x as (select *, (lon2 - lon1) * k as dx, (lat2 - lat1) * 111320.0 as dy, (lon - lon1) * k as px, (lat - lat1) * 111320.0 as py from k),
t as (select *, case when dx * dx + dy * dy > 0 then greatest(0.0, least(1.0, (px * dx + py * dy) / (dx * dx + dy * dy))) else 0.0 end as t from x),
m as (select facility_id, way_id, {_SEG} as d from t)"""


@query(f"with {_NEARWAY} select facility_id, way_id, round(d, 6) as distance_m from (select *, row_number() over (partition by facility_id order by round(d, 6), way_id) as rn from m where d < 60) q where rn = 1", "osm_way_ref", "osm_way", "osm_node", "facility")
def nearest_way(v):
    return road.nearest_way(v("facility"), v("osm_node"), v("osm_way"), v("osm_way_ref"))


_EDGES = f"""q as (select r.way_id, r.seq, r.node_id from osm_way_ref r join osm_way y on r.way_id = y.way_id and highway in {_WAYS}),
c as (select node_id, count(*) as n from q group by node_id),
v as (select q.*, case when n >= 2 or lag(seq) over w is null or lead(seq) over w is null then 1 else 0 end as vx from q join c on c.node_id = q.node_id window w as (partition by way_id order by seq)),
g as (select *, sum(vx) over (partition by way_id order by seq) - vx as segment from v),
n as (select g.*, {hav('lag(lat) over w', 'lag(lon) over w', 'lat', 'lon')} as leg from g join osm_node o on o.node_id = g.node_id window w as (partition by way_id order by seq)),
d as (select way_id, segment, sum(coalesce(leg, 0)) as dist_m from n group by way_id, segment),
e as (select way_id, segment, node_id as dst, lag(node_id) over (partition by way_id order by seq) as src from g where vx = 1),
f as (select e.way_id, e.segment, src, dst, dist_m, highway, oneway, access, try_cast(replace(split_part(maxheight, ' ', 1), 'm', '') as double) as maxheight, try_cast(replace(maxweight, 't', '') as double) as maxweight, try_cast(replace(split_part(maxwidth, ' ', 1), 'm', '') as double) as maxwidth, try_cast(replace(split_part(maxlength, ' ', 1), 'm', '') as double) as maxlength, hgv from e join d on d.way_id = e.way_id and d.segment = e.segment join osm_way y on y.way_id = e.way_id where src is not null and src in (select node_id from osm_node) and dst in (select node_id from osm_node)),
a as (select way_id, segment, src, dst, dist_m, highway, access, maxheight, maxweight, maxwidth, maxlength, hgv, 0 as reverse from f union all select way_id, segment, dst, src, dist_m, highway, access, maxheight, maxweight, maxwidth, maxlength, hgv, 1 from f where oneway is null or oneway not in ('yes', 'true', '1'))"""


@query(f"with {_EDGES} select way_id, cast(segment as bigint) as segment, src, dst, round(dist_m, 5) as dist_m, maxheight, maxweight, maxwidth, maxlength, hgv, access, reverse from a", "osm_way_ref", "osm_way", "osm_node")
def road_edges(v):
    e = road.build_edges(v("osm_node"), v("osm_way"), v("osm_way_ref"))
    return e.select("way_id", F.col("segment").cast("long").alias("segment"), "src", "dst", F.round("dist_m", 5).alias("dist_m"), "maxheight", "maxweight", "maxwidth", "maxlength", "hgv", "access", "reverse")


_PROFILES = """(values ('car', null, null, null, 100.0, null), ('truck_small', 2.5, 1.9, 3.5, 100.0, 5.0), ('truck_semi', 4.0, 2.5, 40.0, 80.0, 18.0), ('truck_special', 4.5, 3.0, 40.0, 70.0, 20.0)) p(profile, height, width, weight, top, length)"""
_SPEED = """case highway when 'motorway' then 100.0 when 'motorway_link' then 60.0 when 'trunk' then 80.0 when 'trunk_link' then 50.0 when 'primary' then 60.0 when 'primary_link' then 40.0
when 'secondary' then 50.0 when 'secondary_link' then 35.0 when 'tertiary' then 40.0 when 'tertiary_link' then 30.0 when 'unclassified' then 30.0 when 'residential' then 25.0
when 'living_street' then 15.0 when 'service' then 15.0 when 'track' then 15.0 else 30.0 end"""
#: Whether profile p may use an edge of a.
_MAY = """(access is null or access not in ('no', 'private')) and (profile = 'car' or ((maxheight is null or height < maxheight) and (maxwidth is null or width < maxwidth)
and (maxweight is null or weight < maxweight) and (maxlength is null or length < maxlength) and coalesce(hgv, '') <> 'no'))"""


@query(f"with {_EDGES} select profile, highway, count(*) as edges, round(sum(dist_m / (least({_SPEED}, top) / 3.6)), 3) as seconds from a, {_PROFILES} where {_MAY} group by profile, highway", "osm_way_ref", "osm_way", "osm_node")
def profile_edges(v):
    e = road.profile_edges(road.build_edges(v("osm_node"), v("osm_way"), v("osm_way_ref")))
    return e.groupBy("profile", "highway").agg(F.count("*").alias("edges"), F.round(F.sum("seconds"), 3).alias("seconds"))


@query(f"with {_EDGES}, w as (select src, dst, min(dist_m / ({_SPEED} / 3.6)) as w from a group by src, dst), z as (select s_suppkey as source, s_suppkey as node, 0.0e0 as c from supplier), h1 as (select source, node, min(c) as c from (select * from z union all select source, dst, c + w from z join w on src = node) q group by 1, 2), h2 as (select source, node, min(c) as c from (select * from h1 union all select source, dst, c + w from h1 join w on src = node) q group by 1, 2) select source, node, round(c, 5) as seconds from h2", "osm_way_ref", "osm_way", "osm_node")
def shortest_times_two_hops(v):
    e = road.build_edges(v("osm_node"), v("osm_way"), v("osm_way_ref")).withColumn("seconds", F.col("dist_m") / (scalars.base_speed(F.col("highway")) / 3.6))
    return road.shortest_times(v("supplier").select(F.col("s_suppkey").alias("node_id")), e, 2).select("source", "node", F.round("seconds", 5).alias("seconds"))


@query(f"select highway, count(*) as ways, sum(case when coalesce(maxheight, maxweight, maxwidth, maxlength, hgv, access) is not null then 1 else 0 end)::bigint as tagged from osm_way where highway in {_WAYS} group by highway", "osm_way")
def restriction_coverage(v):
    return road.coverage(v("osm_way"))


_ARS = "case when x ~ '^[0-9]+$' and length(x) < 5 then lpad(x, 5, '0') else x end"
_MATCH = f"""c as (select distinct {_ARS.replace('x', 'trim(arsno)')} as ars, trim(bstopid) as b, gpsy, gpsx from catalog_stop),
s as (select line_no, stop_index, {_ARS.replace('x', 'trim(ars_number)')} as ars, trim(node_id) as node from stop),
j as (select s.line_no, s.stop_index, s.ars, s.node, b, gpsy <> 0 and gpsx <> 0 as ok from s left join c on (s.ars is not null and c.ars = s.ars) or (s.ars is null and c.b = s.node)),
g as (select line_no, stop_index, ars, node, count(b) as found, count(case when b is not null and (node is null or node = b) then 1 end) as n, max(case when node is null or node = b then b end) as b, bool_or(case when b is not null and (node is null or node = b) then ok end) as ok from j group by 1, 2, 3, 4),
r as (select *, case when found = 0 then 'not_found' when n = 0 then 'identifier_conflict' when n > 1 then 'ambiguous_match' when not ok then 'invalid_static_coordinates' end as reason from g)"""


@query(f"with {_MATCH} select line_no, stop_index, case when reason is null then case when ars is not null then 'ars_number' else 'node_id' end end as method, case when reason is null then b end as bstopid, reason from r", "stop", "catalog_stop")
def stop_match(v):
    return ref.match_stops(v("stop"), v("catalog_stop"))


_COUNTS = "count(*) as total, count(case when reason is null then 1 end) as matched, count(reason) as unresolved, count(reason) = 0 as complete from r"


@query(f"""with {_MATCH} select 'line' as level, line_no, null as stop_index, null as ars, null as node, null as reason, {_COUNTS} group by line_no
union all select 'all', null, null, null, null, null, {_COUNTS}
union all select 'stop', line_no, stop_index, ars, node, reason, null, null, null, null from r where reason is not null""", "stop", "catalog_stop")
def match_report(v):
    return ref.match_report(ref.match_stops(v("stop"), v("catalog_stop"), ids=True))


@query("select strftime(detected_at, '%Y-%m-%d') as day, class_name, count(*) as events, round(avg(distance_m), 6) as mean_m, count(distinct vehicle_id) as vehicles from detection_event where distance_m < 5 group by 1, 2", "detection_event")
def daily_risk(v):
    return ref.daily_risk(v("detection_event")).withColumn("mean_m", r6("mean_m"))


@query("select class_name, count(*) as events, round(avg(distance_m), 6) as mean_m, round(count(*) / sum(count(*)) over (), 6) as share from detection_event group by class_name", "detection_event")
def class_share(v):
    return ref.class_share(v("detection_event")).select("class_name", "events", r6("mean_m").alias("mean_m"), r6("share").alias("share"))


@query("select assigned_vehicle_id, count(*) as total, count(case when goal_status = 'COMPLETED' then 1 end) as completed, count(case when goal_status = 'IN_PROGRESS' then 1 end) as in_progress, count(case when goal_status <> 'COMPLETED' and target_eta < timestamp '1998-01-01' then 1 end) as delayed, round(count(case when goal_status = 'COMPLETED' then 1 end) / count(*), 6) as ratio from transport_goal group by 1", "transport_goal")
def goal_metrics(v):
    return ref.goal_metrics(v("transport_goal"), "1998-01-01 00:00:00").withColumn("ratio", r6("ratio"))


@query("select cast(floor(lat / 0.02) as bigint) as cy, cast(floor(lng / 0.02) as bigint) as cx, count(*) as n, round(avg(speed_kmh), 6) as mean_kmh from vehicle_position group by 1, 2", "vehicle_position")
def heatmap(v):
    return ref.heatmap(v("vehicle_position"), 0.02).withColumn("mean_kmh", r6("mean_kmh"))


@query(f"""with {_MEASURED} select vehicle_id, detection_event_id as cause_id, 'OBJECT_PROXIMITY' as alert_type, case when distance_m < 2 then 'CRITICAL' else 'WARNING' end as severity from detection_event where distance_m < 5
union all select vehicle_id, trip_id, 'TRIP_COMPLETED', 'INFO' from trip where trip_status = 'COMPLETED'
union all select p.vehicle_id, m.position_id, 'ROUTE_DEVIATION', case when distance_m >= 1000 then 'CRITICAL' else 'WARNING' end from m join vehicle_position p on p.position_id = m.position_id where distance_m >= 500""", "detection_event", "trip", "vehicle_position", "route_point")
def alerts(v):
    off = h.deviations(v("vehicle_position"), v("route_point"), 500.0).withColumn("deviation_id", F.col("position_id"))
    return ref.build_alerts(v("detection_event"), v("trip"), off)


@query("""select 'severity' as rule, cast(alert_id as string) as key from alert where not coalesce(severity in ('INFO', 'CRITICAL'), false)
union all select 'one_cause', cast(alert_id as string) from alert where not coalesce((detection_event_id is not null)::int + (trip_id is not null)::int = 1, false)
union all select 'unique:alert_id', cast(alert_id as string) from alert group by alert_id having count(*) > 1
union all select 'foreign:vehicle_id', cast(alert_id as string) from alert where vehicle_id is not null and vehicle_id not in (select vehicle_id from vehicle where vehicle_status <> 'OFFLINE')""", "alert", "vehicle")
def constraint_violations(v):
    rules = {"severity": "severity in ('INFO', 'CRITICAL')", "one_cause": "int(detection_event_id is not null) + int(trip_id is not null) = 1"}
    return ref.check_table(v("alert"), "alert_id", rules, ["alert_id"], {"vehicle_id": (v("vehicle").where("vehicle_status <> 'OFFLINE'"), "vehicle_id")})


def entry(spark: SparkSession) -> DataFrame:
    return QUERIES["nearby_latest_then_radius"](spark, "/root/testdata/sf0.001").orderBy("center_id", "distance_m", "vehicle_id")
