"""Registered queries of fused positions, facilities, detections by frame, catalogue checks and reports, with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadloom.functions import media, scalars
from roadloom.operators import facilities as fac
from roadloom.operators import fusion
from roadloom.operators import history as h
from roadloom.operators import reference_data as ref
from roadloom.operators import roadnet as road
from roadloom.plans.feed_queries import _PROJ, _trace
from roadloom.plans.queries import _EDGES, _LAST, _LEGS, _MEASURED, _NEARWAY, _SPEED, hav, query, r6

_FUSED = f"""{_PROJ}, np as (select fix_id, s, lat as plat, lng as plng from (select *, row_number() over (partition by fix_id order by distance_m, s1) as rn from pj) q where rn = 1 and distance_m <= 3000),
fx as materialized (select pk.fix_id, line_no, pk.lat, pk.lng, td, epoch_us(observed_at) / 1e6 as t, s, plat, plng from pk left join np on np.fix_id = pk.fix_id),
fg as materialized (select *, (floor((t + 15) / 1.0e0) + 1) * 1.0e0 as b, lead(t) over w as nt, lag(t) over w as pt, lag(s) over w as ps, lag(td) over w as ptd, (ceil(t / 1.0e0) - 1) * 1.0e0 as before from fx window w as (partition by line_no order by t, fix_id)),
fk as materialized (select *, unnest(range(cast(ceil(t / 1.0e0) as bigint), cast(case when nt is null then floor((t + 60) / 1.0e0) + 1 else ceil(nt / 1.0e0) end as bigint))) * 1.0e0 as tick from fg),
rq as materialized (select fix_id, line_no, td as direction, tick, s + tick - b as c from fk where tick - t > 15 and s is not null
union all select fix_id, line_no, ptd, null, ps + before - ((floor((pt + 15) / 1.0e0) + 1) * 1.0e0) from fg where t - pt >= 3 and ps is not null and before >= (floor((pt + 15) / 1.0e0) + 1) * 1.0e0),
t2 as materialized (select line_no, direction, s, lat, lng, lead(s) over w as s2, lead(lat) over w as lat2, lead(lng) over w as lng2 from tr window w as (partition by line_no, direction order by s)),
pl as materialized (select rq.*, s2 is null and c > s as past_end, case when s2 is null then lat else lat + (lat2 - lat) * (c - s) / (s2 - s) end as plat, case when s2 is null then lng else lng + (lng2 - lng) * (c - s) / (s2 - s) end as plng from rq asof join t2 on rq.line_no = t2.line_no and rq.direction = t2.direction and rq.c >= t2.s),
bl as materialized (select fk.*, h.plat as flat, h.plng as flng, coalesce(fk.plat, fk.lat) as glat, coalesce(fk.plng, fk.lng) as glng, least(1.0, (fk.tick - t) / 3) as r from fk left join pl h on h.fix_id = fk.fix_id and h.tick is null where fk.tick - t <= 15),
fo as materialized (select line_no, tick, fix_id, case when flat is not null and tick - t < 3 then 'reconciling' else 'live' end as state, case when flat is null or tick - t >= 4 then lat else flat + (glat - flat) * r end as lat, case when flat is null or tick - t >= 4 then lng else flng + (glng - flng) * r end as lng, tick - t as age, false as past_end from bl
union all select fk.line_no, fk.tick, fk.fix_id, 'interpolated', pl.plat, pl.plng, fk.tick - t, past_end from fk join pl on pl.fix_id = fk.fix_id and pl.tick = fk.tick)"""


@query(f"with {_FUSED.replace('feed_fix', 'live_fix')} select line_no, cast(tick as bigint) as tick, fix_id, state, cast(round(lat * 123456.789e0) as bigint) as lat_u, cast(round(lng * 123456.789e0) as bigint) as lng_u, past_end from fo", "live_fix", "trace_point")
def fused_positions(v):
    f = fusion.fuse_positions(v("live_fix"), _trace(v), align_m=3000.0)
    return f.select("line_no", F.col("tick").cast("long").alias("tick"), "fix_id", "state", *[F.round(F.col(c) * 123456.789).cast("long").alias(f"{c}_u") for c in ("lat", "lng")], "past_end")


@query("""select f.frame_seq, d.detection_event_id, round(x1 * 1280 / 640 * 1920, 6) as x1, round(y2 * 720 / 360 * 1080, 6) as y2 from frame_item f
join detection_event d on d.session_id = f.session_id and d.frame_id = f.frame_seq % 500 where confidence > 0.5""", "frame_item", "detection_event")
def frame_detections(v):
    kept = v("detection_event").where(media.keep_detection(F.col("confidence"), 0.5, False))
    j = v("frame_item").withColumn("frame_id", F.col("frame_seq") % 500).join(kept, ["session_id", "frame_id"])
    box = media.rescale_bbox(F.col("x1") * 1280, F.col("y1") * 720, F.col("x2") * 1280, F.col("y2") * 720, (640.0, 360.0), (1920.0, 1080.0))
    return j.withColumn("box", box).select("frame_seq", "detection_event_id", r6("box.x1").alias("x1"), r6("box.y2").alias("y2"))


@query("select session_id, frame_id, count(*) as items, count(distance_m) as masks from detection_event group by 1, 2", "detection_event")
def frame_totals(v):
    return ref.frame_totals(v("detection_event"), F.col("distance_m").isNotNull())


@query("""with p as (select frame_seq, x1 + 0.01 as a, (x1 + x2) / 2 as b, x2 as c, y2 - 0.005 as ya, y2 as yb, y2 - case when frame_seq % 2 = 0 then 0.3 else 0.002 end as yc, x1, x2, y2, frame_seq % 7 = 0 as person from frame_item)
select frame_seq, round(case when person then (x1 + x2) / 2 when frame_seq % 2 = 0 then (a + b) / 2 else b end, 6) as u, round(y2, 6) as v from p""", "frame_item")
def ground_anchor(v):
    f = v("frame_item").withColumn("cls", F.when(F.col("frame_seq") % 7 == 0, "person").otherwise("car"))
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    third = F.col("y2") - F.when(F.col("frame_seq") % 2 == 0, 0.3).otherwise(0.002)
    mask = F.array(pt(F.col("x1") + 0.01, F.col("y2") - 0.005), pt((F.col("x1") + F.col("x2")) / 2, F.col("y2")), pt(F.col("x2"), third))
    a = media.ground_anchor(F.col("cls"), mask, F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return f.withColumn("a", a).select("frame_seq", r6("a.u").alias("u"), r6("a.v").alias("v"))


_KINDS = "case facility_id % 3 when 0 then 'bridge' when 1 then 'tunnel' else 'width' end"
_ALL = f"fa as (select {_KINDS} as kind, cast(facility_id as string) as ref, facility_id, lat, lon, case when facility_id % 3 < 2 then case when height_m between 1.5 and 6 then height_m end end as height_m, case when facility_id % 3 <> 1 then case when width_m between 1.5 and 30 then width_m end end as width_m from facility)"


def _facilities(v):
    f = v("facility").select(F.col("facility_id").cast("string").alias("ref"), "facility_id", "lat", "lon", scalars.plausible(F.col("height_m"), 1.5, 6.0).alias("height_m"), scalars.plausible(F.col("width_m"), 1.5, 30.0).alias("width_m"))
    return fac.facilities(bridge=f.where("facility_id % 3 = 0"), tunnel=f.where("facility_id % 3 = 1").drop("width_m"), width=f.where("facility_id % 3 = 2").drop("height_m"))


@query(f"with {_ALL} select kind, ref, lat, lon, height_m, width_m, cast(null as double) as weight_t from fa", "facility")
def facility_sources(v):
    return _facilities(v)


@query(f"with {_NEARWAY}, {_ALL}, z as (select fa.*, height_m is not null or width_m is not null as val, facility_id in (select facility_id from m where d < 60) as hit from fa) select kind, count(*) as fetched, count(case when not val then 1 end) as no_value, count(case when val and hit then 1 end) as matched, count(case when val and not hit then 1 end) as unmatched from z group by 1", "osm_way_ref", "osm_way", "osm_node", "facility")
def facility_report(v):
    f = _facilities(v)
    m = road.nearest_way(f.select(F.concat_ws(":", "kind", "ref").alias("facility_id"), "lat", "lon"), v("osm_node"), v("osm_way"), v("osm_way_ref"))
    key = F.split("facility_id", ":")
    return fac.facility_report(f, m.select(key[0].alias("kind"), key[1].alias("ref")))


@query("""with g as (select arsno, min(gpsy * 1000 + gpsx) as k from catalog_stop group by 1), h as (select c.arsno, min(c.gpsy) as lat, min(c.gpsx) as lon from catalog_stop c join (select arsno, min(gpsy) as y from catalog_stop group by 1) m on c.arsno = m.arsno and c.gpsy = m.y group by 1)
select line_no, stop_index, round((a.lat + b.lat) / 2, 6) as lat, round((a.lon + b.lon) / 2, 6) as lon from stop join h a on a.arsno = ars_number join h b on b.arsno = node_id""", "stop", "catalog_stop")
def geocoded_rows(v):
    rows = v("stop").select("line_no", "stop_index", F.col("ars_number").alias("start_address"), F.col("node_id").alias("end_address"))
    codes = v("catalog_stop").select(F.col("arsno").alias("address"), F.col("gpsy").alias("lat"), F.col("gpsx").alias("lon"))
    return fac.attach_coords(rows, codes).select("line_no", "stop_index", r6("lat").alias("lat"), r6("lon").alias("lon"))


_PAGES = """pg as (select cast(floor(cast(bstopid as bigint) / 100.0e0) as bigint) as asked, cast(floor(cast(bstopid as bigint) / 100.0e0) as bigint) + case when cast(bstopid as bigint) between 300 and 399 then 1 else 0 end as page, case when cast(bstopid as bigint) % 211 = 0 then ' ' else bstopid end as stop_id, cast(cast(bstopid as bigint) % 1900 as string) as payload from catalog_stop)"""


_CHECKED = """a as (select asked, count(payload) as n, bool_and(page = asked) as ok, string_agg(payload, ',' order by payload) as digest, min(total) as lo, max(total) as hi from pg group by 1),
k as (select coalesce(sum(n), 0) as rows, max(hi) as total, count(case when n = 0 then 1 end) as empty_pages, count(case when not ok then 1 end) as misnumbered_pages, count(digest) - count(distinct digest) as repeated_pages, min(lo) as lo from a),
o as (select count(payload) - count(distinct payload) as overlapping_rows, count(case when payload is not null and coalesce(trim(stop_id), '') = '' then 1 end) as blank_ids from pg)
select cast(rows as bigint) as rows, total, empty_pages, misnumbered_pages, repeated_pages, overlapping_rows, blank_ids, empty_pages + misnumbered_pages + repeated_pages + overlapping_rows + blank_ids = 0 and lo = total and rows = total as complete from k, o"""


@query(f"""with {_PAGES.replace('pg as (select', 'pq as (select')}, pg as (select *, (select count(*) from pq) as total from pq union all select 999999, 999999, null, null, (select count(*) from pq)), {_CHECKED}""", "catalog_stop")
def catalog_check(v):
    """A catalogue with faults of each kind, an empty page among them."""
    n = F.col("bstopid").cast("long")
    c = v("catalog_stop")
    asked = F.floor(n / 100)
    pages = c.select(asked.alias("asked_page"), (asked + F.when(n.between(300, 399), 1).otherwise(0)).alias("page"), F.when(n % 211 == 0, " ").otherwise(F.col("bstopid")).alias("stop_id"), (n % 1900).cast("string").alias("payload"))
    total = F.broadcast(c.agg(F.count("*").alias("total")))
    none = v("catalog_stop").sparkSession.createDataFrame([(999_999, 999_999, None, None)], "asked_page long, page long, stop_id string, payload string")
    return fac.check_catalog(pages.unionByName(none).crossJoin(total))


@query(f"""with pg as (select cast(floor(cast(bstopid as bigint) / 100.0e0) as bigint) as asked, cast(floor(cast(bstopid as bigint) / 100.0e0) as bigint) as page, bstopid as stop_id, bstopid as payload, (select count(*) from catalog_stop) as total from catalog_stop), {_CHECKED}""", "catalog_stop")
def catalog_check_whole(v):
    """The same catalogue as it is: complete."""
    page = F.floor(F.col("bstopid").cast("long") / 100)
    pages = v("catalog_stop").select(page.alias("asked_page"), page.alias("page"), F.col("bstopid").alias("stop_id"), F.col("bstopid").alias("payload"))
    return fac.check_catalog(pages.crossJoin(F.broadcast(v("catalog_stop").agg(F.count("*").alias("total")))))


@query("""with w as (select *, case when alert_status <> 'UNCONFIRMED' then alert_id % 600 end as s from alert)
select alert_type, severity, count(case when alert_status = 'UNCONFIRMED' then 1 end) as unconfirmed, count(case when alert_status = 'ACKNOWLEDGED' then 1 end) as acknowledged, count(case when alert_status = 'RESOLVED' then 1 end) as resolved, quantile_disc(s, 0.5) as median_s, quantile_disc(s, 0.9) as p90_s from w group by 1, 2""", "alert")
def alert_latency(v):
    a = v("alert").withColumn("acknowledged_at", F.when(F.col("alert_status") != "UNCONFIRMED", F.col("created_at") + F.make_dt_interval(secs=F.col("alert_id") % 600)))
    return h.alert_latency(a)


@query(f"""with {_LEGS}, td as (select trip_id, coalesce(sum(leg_m), 0) as m from g group by 1), rl as (select trip_id, sum({hav('plat', 'plng', 'lat', 'lng')}) as planned from (select *, lag(lat) over w as plat, lag(lng) over w as plng from route_point where is_current window w as (partition by route_id order by seq)) q group by 1),
{_MEASURED.replace('s as (', 'sgm as (').replace('join s on p.trip_id = s.trip_id', 'join sgm s on p.trip_id = s.trip_id')}
select (select count(*) from (select *, {_LAST.format('vehicle_id')} from vehicle_position) q where rn = 1 and speed_kmh > 0) as moving, (select count(*) from detection_event where distance_m < 5) as risk_events, (select count(*) from alert where alert_status = 'UNCONFIRMED') as unhandled,
(select count(*) from m where distance_m >= 500) as deviations, (select round(avg(least(1.0, td.m / planned)), 6) from td join rl on rl.trip_id = td.trip_id where planned > 0) as mean_progress""".replace("epoch_us(recorded_at - pt)", "(epoch_us(recorded_at) - epoch_us(pt))"), "vehicle_position", "detection_event", "alert", "route_point")
def dashboard_with_routes(v):
    d = h.dashboard_with_routes(v("vehicle_position"), v("alert"), v("detection_event"), v("route_point"), 500.0)
    return d.withColumn("mean_progress", r6("mean_progress"))


@query("select trip_id, vehicle_id, started_at, trip_status, count(*) over () as rows, 1001 as first_id, 1000 + count(*) over () as last_id, count(*) over () as ids from trip", "trip")
def appended_trips(v):
    """Trips as new rows with ids of their own: any numbers, but distinct ones without gaps from 1001."""
    t = fac.append_rows(v("trip").withColumnRenamed("trip_id", "from_trip"), "trip_id", 1000, "from_trip")
    ids = t.agg(F.count("*").alias("rows"), F.min("trip_id").alias("first_id"), F.max("trip_id").alias("last_id"), F.countDistinct("trip_id").alias("ids"))
    return t.select(F.col("from_trip").alias("trip_id"), "vehicle_id", "started_at", "trip_status").crossJoin(F.broadcast(ids))


_OD = "od as (select s_suppkey as request_id, s_suppkey as a, case when s_suppkey % 10 = 0 then null else s_suppkey + 1 end as b from supplier)"


@query(f"""with {_EDGES}, {_OD}, w as (select src, dst, min(dist_m / ({_SPEED} / 3.6)) as w from a group by 1, 2), z as (select distinct a as source, a as node, 0.0e0 as c from od), h1 as (select source, node, min(c) as c from (select * from z union all select source, dst, c + w from z join w on src = node) q group by 1, 2),
h2 as (select source, node, min(c) as c from (select * from h1 union all select source, dst, c + w from h1 join w on src = node) q group by 1, 2)
select request_id, case when od.b is null then 'no_road_near' when c is null then 'no_route_within_hops' else 'ok' end as status, round(c / 60, 2) as minutes from od left join h2 on h2.source = od.a and h2.node = od.b""", "osm_way_ref", "osm_way", "osm_node")
def route_requests_two_hops(v):
    e = road.build_edges(v("osm_node"), v("osm_way"), v("osm_way_ref")).withColumn("seconds", F.col("dist_m") / (scalars.base_speed(F.col("highway")) / 3.6))
    od = v("supplier").select(F.col("s_suppkey").alias("request_id"), F.col("s_suppkey").alias("origin"), F.when(F.col("s_suppkey") % 10 != 0, F.col("s_suppkey") + 1).alias("goal"))
    return road.route_snapped(od, e, 2)
