"""One query per operator, with the SQL that gives the same rows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import phases as P
from ..operators import ordering as O
from ..operators import points as L
from ..operators import review as R
from ..operators import scans
from ..operators import timeline as W
from ..operators import tracks as K
from ..scratch import Tables
from ..sources import exports
from ..streaming import live
from .registry import query
from .views import POINTS, SAMPLES, TRAJECTORY, points, samples, table, trajectory

#: Tracks here have no camera: thresholds that let some through.
RULES = K.TrackRules(min_seconds=3600.0, appear_edge=0.5, exit_edge=0.1, min_vertical_motion=-1.0, max_lateral_vertical_ratio=1e9, min_area_ratio=0.9, max_mid_peak_ratio=100.0, close_min_road=0.0, close_side=0.3, close_min_lateral=0.0)


def rounded(df, *exact):
    """Doubles to nine digits, so that orders of summation don't show."""
    return df.select(*(F.round(c, 9).alias(c) if t == "double" and c not in exact else F.col(c) for c, t in df.dtypes))


_MEASURES = f"""SELECT track_id, count(*) AS n, arg_min(t,i) AS t_start, arg_max(t,i) AS t_end,
 median(CASE WHEN i<greatest(1,n//4) THEN cx END) AS cx_start, median(CASE WHEN i>=n-greatest(1,n//4) THEN cx END) AS cx_end,
 median(CASE WHEN i<greatest(1,n//4) THEN cy END) AS y_start, median(CASE WHEN i>=n-greatest(1,n//4) THEN cy END) AS y_end,
 median(CASE WHEN i<greatest(1,n//4) THEN area END) AS area_start, median(CASE WHEN i>=n-greatest(1,n//4) THEN area END) AS area_end,
 arg_max(i, {{'a':area,'b':-i}}) AS peak_i, max(area) AS peak_area, arg_max(cx, {{'a':area,'b':-i}}) AS peak_cx,
 avg(CASE WHEN cx BETWEEN 0.42*(1-al)+0.12*al AND 0.58*(1-al)+0.88*al THEN 1.0::DOUBLE ELSE 0 END) AS road_ratio,
 median(CASE WHEN cls='error' THEN area END) AS ego
FROM (SELECT *, greatest(0::DOUBLE, least(1::DOUBLE, (cy-0.42::DOUBLE)/0.58::DOUBLE)) AS al FROM ({SAMPLES})) GROUP BY track_id"""


@query("track_summary", f"""SELECT track_id, n, round(t_start,6) AS t_start, round(t_end,6) AS t_end, round(cx_start,9) AS cx_start, round(cx_end,9) AS cx_end,
 round(area_start,9) AS area_start, round(area_end,9) AS area_end, peak_i, peak_area, cx_end<cx_start AS inward,
 printf('%03d', row_number() OVER (ORDER BY t_start, track_id)) AS event_id FROM ({_MEASURES}) WHERE n>=5 AND t_end-t_start>=0.6""")
def track_summary(spark, sf_dir):
    m = K.track_measures(samples(spark, sf_dir)).where("n >= 5 AND t_end - t_start >= 0.6")
    m = K.number_events(m, "t_start", "track_id")
    r = lambda c, d=9: F.round(c, d).alias(c)
    return m.select("track_id", "n", r("t_start", 6), r("t_end", 6), r("cx_start"), r("cx_end"), r("area_start"), r("area_end"), F.col("peak_i").cast("long").alias("peak_i"), "peak_area", (F.col("cx_end") < F.col("cx_start")).alias("inward"), "event_id")


_VOTE = "greatest(0.05::DOUBLE, confidence)*(0.35::DOUBLE+0.65::DOUBLE*least(1::DOUBLE, least(greatest(cx,0),greatest(1-cx,0))/0.35::DOUBLE))"


@query("class_votes", f"SELECT track_id, cls, round(sum({_VOTE}),6) AS vote, min(i) AS first_i FROM ({SAMPLES}) GROUP BY ALL")
def class_votes(spark, sf_dir):
    return K.class_votes(samples(spark, sf_dir)).select("track_id", "cls", F.round("vote", 6).alias("vote"), F.col("first_i").cast("long").alias("first_i"))


_RUNS = f"""SELECT track_id, coalesce(max(len),0) AS run FROM (SELECT track_id, count(*) FILTER (WHERE hit) AS len FROM
 (SELECT track_id, hit, count(*) FILTER (WHERE NOT hit) OVER (PARTITION BY track_id ORDER BY i) AS g FROM (SELECT track_id, i, plate_score>=0.45 AS hit FROM ({SAMPLES}))) GROUP BY track_id, g) GROUP BY track_id"""
_TYPES = f"""SELECT a.track_id, CASE WHEN run>=2 AND hits>=3 AND (NOT strong OR ev>=0.75) THEN '軽' WHEN strong THEN '大型' ELSE '普通' END AS vehicle_type, det, ev, hits
FROM (SELECT track_id, arg_max(cls,{{'v':v,'b':-f}}) AS det, (arg_max(cls,{{'v':v,'b':-f}}) IN ('truck','bus') AND sum(v) FILTER (WHERE cls IN ('truck','bus'))/sum(v)>=0.7) AS strong0
  FROM (SELECT track_id, cls, sum({_VOTE}) AS v, min(i) AS f FROM (SELECT * REPLACE (CASE cls WHEN 'click' THEN 'truck' WHEN 'view' THEN 'bus' WHEN 'purchase' THEN 'truck' ELSE 'car' END AS cls) FROM ({SAMPLES})) GROUP BY ALL) GROUP BY track_id) a
JOIN (SELECT track_id, count(*) FILTER (WHERE plate_score>=0.45) AS hits, count(*) FILTER (WHERE cls IN ('click','view','purchase') AND confidence>=0.4)>=5 AS frames,
  list_median AS ev FROM (SELECT *, median(CASE WHEN rk<=3 THEN plate_score END) OVER (PARTITION BY track_id) AS list_median FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY plate_score DESC) AS rk FROM ({SAMPLES}))) GROUP BY track_id, list_median) b USING (track_id)
JOIN ({_RUNS}) c USING (track_id), LATERAL (SELECT strong0 AND frames AS strong)"""


def typed_samples(spark, sf_dir):
    kind = F.when(F.col("cls").isin("click", "purchase"), "truck").when(F.col("cls") == "view", "bus").otherwise("car")
    return samples(spark, sf_dir).withColumn("cls", kind)


@query("vehicle_type", f"SELECT track_id, vehicle_type, det AS detector_class, round(ev,9) AS plate_score, hits AS plate_hits FROM ({_TYPES})")
def vehicle_type(spark, sf_dir):
    return rounded(K.vehicle_types(typed_samples(spark, sf_dir)).drop("video_id"))


@query("top3_median", f"SELECT track_id, round(median(cx),9) AS score FROM (SELECT track_id, cx, row_number() OVER (PARTITION BY track_id ORDER BY cx DESC) AS rk FROM ({SAMPLES})) WHERE rk<=3 GROUP BY track_id")
def top3_median(spark, sf_dir):
    return rounded(K.vehicle_types(samples(spark, sf_dir)).select("track_id", F.col("plate_score").alias("score")))


@query("longest_run", f"SELECT track_id, CAST(run AS INTEGER) AS run FROM ({_RUNS})")
def longest_run(spark, sf_dir):
    return K.longest_runs(samples(spark, sf_dir), F.col("plate_score") >= 0.45).select("track_id", "run")


@query("road_occupancy", f"SELECT track_id, round(road_ratio,9) AS road_ratio FROM ({_MEASURES})")
def road_occupancy(spark, sf_dir):
    return rounded(K.track_measures(samples(spark, sf_dir)).select("track_id", "road_ratio"))


@query("road_filter", f"SELECT track_id FROM ({_MEASURES}) WHERE n>=5 AND t_end-t_start>=0.6 AND road_ratio>=0.22 AND (cx_start>=0.3 AND cx_end<cx_start AND cx_end>0.1)")
def road_filter(spark, sf_dir):
    rules = replace(RULES, min_seconds=0.6, appear_edge=0.3, stop_filter=False, trajectory_filter=False, area_filter=False, road_roi=True, min_road_ratio=0.22, close_peak_area=1e9)
    return K.passing_tracks(K.track_measures(samples(spark, sf_dir), rules), rules).select("track_id")


def measured(spark, sf_dir):
    return samples(spark, sf_dir).withColumn("flow", F.when(F.col("cls") == "error", F.col("area")))


@query("locf_flow", f"SELECT track_id, frame, last_value(CASE WHEN cls='error' THEN area END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY i) AS flow_filled FROM ({SAMPLES})")
def locf_flow(spark, sf_dir):
    return W.carry_forward(measured(spark, sf_dir), ["track_id"], ["ord"], "flow", 7 * 86400.0, "t").select("track_id", "frame", "flow_filled")


@query("ego_gate", f"SELECT track_id, round(ego,9) AS ego_motion, coalesce(ego>=40,true) AS moving FROM ({_MEASURES})")
def ego_gate(spark, sf_dir):
    motion = samples(spark, sf_dir).where("cls = 'error'").select("video_id", "frame", F.col("area").alias("flow"))
    m = K.track_measures(K.with_flow(samples(spark, sf_dir), motion))
    return rounded(m.select("track_id", "ego_motion", F.coalesce(F.col("ego_motion") >= 40, F.lit(True)).alias("moving")))


_FULL = f"""SELECT track_id, close_pass, round(CASE WHEN close_pass THEN shrink ELSE area_start/greatest(area_end,1e-9) END,6) AS area_change_ratio, round(y_start-y_end,9) AS vertical_motion
FROM (SELECT *, peak_area/greatest(area_end,1e-9) AS shrink, (n>=5 AND peak_i>=3 AND n-peak_i-1>=3 AND road_ratio>=0 AND peak_area>=0.08 AND peak_area/greatest(area_end,1e-9)>=1.8 AND peak_cx>=0.3 AND peak_cx-cx_end>=0) AS close_pass,
 (cx_start>=0.5 AND cx_end<cx_start AND cx_end>0.1) AS ordinary, peak_area/greatest(area_start,area_end,1e-9) AS mid FROM ({_MEASURES}) WHERE n>=5 AND t_end-t_start>=3600)
WHERE (ordinary OR close_pass) AND coalesce(ego>=0.8,true) AND (close_pass OR (y_start-y_end>=-1 AND abs(cx_end-cx_start)/greatest(abs(y_end-y_start),1e-6)<=1e9))
 AND (close_pass OR (area_start/greatest(area_end,1e-9)>=0.9 AND NOT (peak_i BETWEEN floor(0.2*n) AND floor(0.8*n) AND mid>100)))"""


@query("full_classifier", f"SELECT f.*, vehicle_type FROM ({_FULL}) f JOIN ({_TYPES}) USING (track_id)")
def full_classifier(spark, sf_dir):
    s = typed_samples(spark, sf_dir)
    motion = samples(spark, sf_dir).where("cls = 'error'").select("video_id", "frame", F.col("area").alias("flow"))
    out = K.classify(s, motion, RULES)
    return out.select("track_id", "close_pass", F.round("area_change_ratio", 6).alias("area_change_ratio"), F.round("vertical_motion", 9).alias("vertical_motion"), "vehicle_type")


@query("prefix_offsets", "SELECT ord, round(coalesce(sum(duration) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0),2) AS time_offset FROM (SELECT CAST(o_orderdate AS DATE) AS ord, sum(o_totalprice) AS duration FROM orders GROUP BY 1)")
def prefix_offsets(spark, sf_dir):
    days = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("ord")).agg(F.sum("o_totalprice").alias("duration"))
    return K.video_offsets(days).select("ord", F.round("time_offset", 2).alias("time_offset"))


@query("rotation_frames", f"SELECT track_id, frame, CAST(sum(CASE WHEN cx*36000+18000<p THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY i) AS BIGINT) AS frame_id FROM (SELECT *, lag(cx*36000) OVER (PARTITION BY track_id ORDER BY i) AS p FROM ({SAMPLES}))")
def rotation_frames(spark, sf_dir):
    packets = samples(spark, sf_dir).withColumn("azimuth", F.col("cx") * 36000)
    return W.rotation_frames(packets, ["track_id"], "ord", "azimuth", width=7 * 86400.0, t="t").select("track_id", "frame", "frame_id")


@query("first_per_second", f"SELECT track_id, CAST(floor(t/3600) AS BIGINT) AS hour, frame FROM ({SAMPLES}) QUALIFY row_number() OVER (PARTITION BY track_id, floor(t/3600) ORDER BY i)=1")
def first_per_second(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("hours", F.col("t") / 3600)
    return W.first_per_second(rows, ["track_id"], "hours", "ord").select("track_id", F.col("hours").cast("long").alias("hour"), "frame")


@query("robust_mean", f"""SELECT track_id, round(coalesce(avg(area) FILTER (WHERE abs(area-m)<=10), avg(area)),6) AS mean, count(*) FILTER (WHERE abs(area-m)<=10) AS used
 FROM (SELECT *, median(area) OVER (PARTITION BY track_id) AS m FROM ({SAMPLES})) GROUP BY track_id""")
def robust_mean(spark, sf_dir):
    return W.robust_mean(samples(spark, sf_dir), ["track_id"], "area", 10.0).select("track_id", F.round("mean", 6).alias("mean"), "used")


@query("long_medians", "SELECT l_returnflag, median(CAST(l_extendedprice AS DOUBLE)) AS middle FROM lineitem GROUP BY 1")
def long_medians(spark, sf_dir):
    """Few keys, each with very many distinct values."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("price"))
    return scans.medians(rows, ["l_returnflag"], "price", "middle")


@query("long_scan", """SELECT event_id, last_value(CASE WHEN event_type='error' THEN value END IGNORE NULLS) OVER w AS held, lag(event_id) OVER w AS past, CAST(sum(CASE WHEN event_type='click' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS clicks FROM events WINDOW w AS (ORDER BY epoch_us(ts), event_id)""")
def long_scan(spark, sf_dir):
    """All events as one key, in slots of a day."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    held, click = F.when(F.col("event_type") == "error", F.col("value")), (F.col("event_type") == "click").cast("long")
    return scans.scan(rows, [], ["us", "event_id"], 86400e6, last={"held": held}, lag={"past": F.col("event_id")}, total={"clicks": click}).select("event_id", "held", "past", "clicks")


_SPANS = "SELECT o_orderkey AS interval_id, CAST(o_custkey % 150 AS BIGINT) AS user_id, (o_orderkey % 2500000)::DOUBLE + 1704067200 AS lo, (o_orderkey % 2500000)::DOUBLE + 1704067200 + 86400*(o_orderkey % 3) AS hi FROM orders"


def spans(spark, sf_dir):
    lo = F.col("o_orderkey") % 2500000 + F.lit(1704067200.0)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("interval_id"), (F.col("o_custkey") % 150).alias("user_id"), lo.alias("lo"), (lo + 86400 * (F.col("o_orderkey") % 3)).alias("hi"))


@query("range_avg", f"SELECT interval_id, round(avg(area),6) AS mean, count(area) AS n FROM ({_SPANS}) s LEFT JOIN ({SAMPLES}) e ON e.track_id=s.user_id AND e.t BETWEEN s.lo AND s.hi GROUP BY interval_id")
def range_avg(spark, sf_dir):
    values = samples(spark, sf_dir).select(F.col("track_id").alias("user_id"), "t", "area")
    return W.range_average(spans(spark, sf_dir), values, ["user_id"], "lo", "hi", "t", "area", 43200.0).select("interval_id", F.round("mean", 6).alias("mean"), "n")


@query("nearest_asof", f"SELECT interval_id, arg_min(e.frame, {{'d':abs(e.t-s.lo),'t':e.t}}) AS nearest_frame FROM ({_SPANS}) s JOIN ({SAMPLES}) e ON e.track_id=s.user_id GROUP BY interval_id")
def nearest_asof(spark, sf_dir):
    right = samples(spark, sf_dir).select(F.col("track_id").alias("user_id"), F.col("t").alias("rt"), "frame")
    return W.nearest(spans(spark, sf_dir), right, ["user_id"], "lo", "rt", "frame", 43200.0).where("nearest_frame IS NOT NULL").select("interval_id", "nearest_frame")


@query("roi_filter", f"SELECT ord, laser FROM ({POINTS}) WHERE x BETWEEN -0.1 AND 0.1 AND y BETWEEN -0.2 AND 0.05 AND laser IN (1,2,3)")
def roi_filter(spark, sf_dir):
    return L.roi(points(spark, sf_dir), (0.1, -0.1), (-0.2, 0.05), [1, 2, 3]).select("ord", "laser")


_BOXES = "SELECT n_nationkey AS event_id, CAST(n_nationkey % 7 AS BIGINT) AS frame_idx, -0.05*(n_nationkey % 3) AS min_x, 0.15::DOUBLE AS max_x, -0.2::DOUBLE AS min_y, 0.02*(n_nationkey % 5) AS max_y, CASE WHEN n_nationkey % 4=0 THEN [1,2] END AS lasers FROM nation"


@query("roi_boxes", f"SELECT b.event_id, p.ord FROM ({POINTS}) p JOIN ({_BOXES}) b USING (frame_idx) WHERE x BETWEEN least(min_x,max_x) AND greatest(min_x,max_x) AND y BETWEEN least(min_y,max_y) AND greatest(min_y,max_y) AND (lasers IS NULL OR list_contains(lasers, laser))")
def roi_boxes(spark, sf_dir):
    k = F.col("n_nationkey")
    boxes = table(spark, sf_dir, "nation").select(
        k.alias("event_id"), (k % 7).cast("long").alias("frame_idx"), (-0.05 * (k % 3)).alias("min_x"), F.lit(0.15).alias("max_x"), F.lit(-0.2).alias("min_y"),
        (0.02 * (k % 5)).alias("max_y"), F.when(k % 4 == 0, F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("lasers"),
    )
    return L.boxes_join(points(spark, sf_dir), boxes).select("event_id", "ord")


@query("roi_polar", f"SELECT ord, round(sqrt(x*x+y*y+z*z),9) AS distance, round(degrees(atan2(x,y)),9) AS azimuth, round(degrees(atan2(z,sqrt(x*x+y*y))),9) AS elevation FROM ({POINTS})")
def roi_polar(spark, sf_dir):
    return rounded(points(spark, sf_dir).select("ord", *L.polar()))


@query("downsample", f"SELECT ord FROM (SELECT ord, row_number() OVER (PARTITION BY frame_idx ORDER BY ord)-1 AS i, count(*) OVER (PARTITION BY frame_idx) AS n FROM ({POINTS})) WHERE i % CAST(ceil(n/12.0) AS BIGINT)=0")
def downsample(spark, sf_dir):
    return L.thin(points(spark, sf_dir), ["frame_idx"], "ord", 12).select("ord")


@query("decode_xyz", f"SELECT ord, round(d*cos(radians(z*90))*sin(radians(x*360)),9) AS x, round(d*cos(radians(z*90))*cos(radians(x*360)),9) AS y, round(d*sin(radians(z*90)),9) AS z FROM (SELECT *, 10+y AS d FROM ({POINTS}))")
def decode_xyz(spark, sf_dir):
    return rounded(points(spark, sf_dir).select("ord", *L.cartesian(10 + F.col("y"), F.col("x") * 360, F.col("z") * 90)))


_CELLS = f"SELECT CAST(floor(x/0.05) AS BIGINT) AS gx, CAST(floor(y/0.05) AS BIGINT) AS gy, count(*) AS points FROM ({POINTS}) GROUP BY 1, 2"


@query("grid_cells", _CELLS)
def grid_cells(spark, sf_dir):
    return L.grid_cells(points(spark, sf_dir), [], 0.05)


@query("grid_components", f"""WITH RECURSIVE c AS (SELECT gx, gy FROM ({_CELLS}) WHERE points>=2), r AS (SELECT gx, gy, gx AS cx, gy AS cy FROM c UNION SELECT c.gx, c.gy, r.cx, r.cy FROM r JOIN c ON abs(c.gx-r.gx)<=1 AND abs(c.gy-r.gy)<=1)
 SELECT gx, gy, min({{'gx':cx,'gy':cy}}).gx AS component_gx, min({{'gx':cx,'gy':cy}}).gy AS component_gy FROM r GROUP BY gx, gy""")
def grid_components(spark, sf_dir):
    cells = L.grid_cells(points(spark, sf_dir), [], 0.05).where("points >= 2").drop("points")
    out = L.grid_components(cells, [], Tables(spark, "grid").path("turns"))
    return out.select("gx", "gy", F.col("component.gx").alias("component_gx"), F.col("component.gy").alias("component_gy"))


_NEAREST = f"""SELECT frame_idx, min(t) AS t, arg_min(ord, {{'d':sqrt(x*x+y*y),'o':ord}}) AS o, arg_min(x, {{'d':sqrt(x*x+y*y),'o':ord}}) AS x, arg_min(y, {{'d':sqrt(x*x+y*y),'o':ord}}) AS y, min(sqrt(x*x+y*y)) AS distance FROM ({POINTS}) GROUP BY frame_idx"""


@query("nearest_point", f"SELECT frame_idx, round(x,9) AS x, round(y,9) AS y, round(distance,9) AS distance FROM ({_NEAREST})")
def nearest_point(spark, sf_dir):
    return rounded(L.nearest_points(points(spark, sf_dir), ["frame_idx"]).select("frame_idx", "x", "y", "distance"))


@query("nearest_point_speed", f"SELECT frame_idx, round(sqrt((x-px)*(x-px)+(y-py)*(y-py))/(t-pt)*3.6,6) AS speed FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(t) OVER w AS pt FROM ({_NEAREST}) WINDOW w AS (ORDER BY t, frame_idx))")
def nearest_point_speed(spark, sf_dir):
    frames = L.nearest_points(points(spark, sf_dir), ["capture_id", "frame_idx"])
    return L.trajectory_speed(frames, ["capture_id"]).select("frame_idx", F.round("speed", 6).alias("speed"))


_PHASES = f"""SELECT track_id, CAST(1 AS INTEGER) AS p1, coalesce(max(rn) FILTER (WHERE cand AND abs(speed)<10), arg_min(rn, {{'s':abs(speed),'r':rn}}) FILTER (WHERE cand)) AS p2, any_value(c3) AS p3, min(rn) FILTER (WHERE rn>c3 AND abs(y)>=3) AS p4
FROM (SELECT *, (c3 IS NULL OR rn<c3) AND speed IS NOT NULL AS cand FROM (SELECT *, min(CASE WHEN abs(y)<3 THEN rn END) OVER (PARTITION BY track_id) AS c3 FROM ({TRAJECTORY}))) GROUP BY track_id"""


@query("phases", f"SELECT track_id, p1, p2, p3, p4, CASE WHEN p2 IS NULL THEN 'no phase 2' WHEN p3 IS NULL THEN 'no phase 3' WHEN p4 IS NULL THEN 'no phase 4' ELSE 'ok' END AS status FROM ({_PHASES})")
def phase_rows(spark, sf_dir):
    out = P.phases(trajectory(spark, sf_dir), "track_id")
    return out.select("track_id", F.col("p1.rn").alias("p1"), *(F.col(f"p{k}.rn").cast("long").alias(f"p{k}") for k in (2, 3, 4)), "status")


@query("metrics", f"""SELECT track_id, round(t4-t3,6) AS passing_time, round(abs(y2),6) AS distance_p2, round(y4-y3,6) AS distance_p3, round((y4-y3)/(t4-t3)*3.6,9) AS relative_speed, CASE WHEN y4<>y3 THEN round(abs(y2)/((y4-y3)/(t4-t3)*3.6::DOUBLE/3.6::DOUBLE),3) END AS ttc, round(lc,6) AS lc FROM
 (SELECT p.track_id, a2.y AS y2, a3.t AS t3, a3.y AS y3, a4.t AS t4, a4.y AS y4, (SELECT abs(coalesce(min(x) FILTER (WHERE distance>=1), min(x))) FROM ({TRAJECTORY}) q WHERE q.track_id=p.track_id AND q.rn BETWEEN p.p3 AND p.p4) AS lc
 FROM ({_PHASES}) p JOIN ({TRAJECTORY}) a2 ON a2.track_id=p.track_id AND a2.rn=p2 JOIN ({TRAJECTORY}) a3 ON a3.track_id=p.track_id AND a3.rn=p3 JOIN ({TRAJECTORY}) a4 ON a4.track_id=p.track_id AND a4.rn=p4)""")
def passing_metrics(spark, sf_dir):
    m = P.metrics(trajectory(spark, sf_dir), "track_id").where("status = 'ok'")
    return m.select("track_id", *(F.round(c, 6).alias(c) for c in ("passing_time", "distance_p2", "distance_p3")), F.round("relative_speed", 9).alias("relative_speed"), F.round("ttc", 3).alias("ttc"), F.round("lc", 6).alias("lc"))


_STATUS = "CASE o_orderstatus WHEN 'F' THEN '採用' WHEN 'O' THEN '除外' ELSE '未確認' END"


def reviews(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", T.ACCEPTED).when(F.col("o_orderstatus") == "O", T.REJECTED).otherwise(T.OPEN)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), "o_custkey", "o_orderpriority", status.alias("review_status"), F.col("o_orderdate").cast("timestamp").alias("at"))


@query("accepted_sorted", f"SELECT o_orderkey AS event_id, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders WHERE {_STATUS}='採用'")
def accepted_sorted(spark, sf_dir):
    number, raw = R.report_order()
    rows = R.accepted(reviews(spark, sf_dir)).withColumns({"number": number.cast("long"), "raw": raw})
    return O.number_rows(rows, ["number", "raw"], "place").select("event_id", "place")


@query("not_rejected", f"SELECT o_orderkey AS event_id FROM orders WHERE {_STATUS}<>'除外'")
def not_rejected(spark, sf_dir):
    return R.not_rejected(reviews(spark, sf_dir)).select("event_id")


@query("next_open", f"""SELECT event_id, coalesce(min(o) OVER (PARTITION BY c ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), min(o) OVER (PARTITION BY c)) AS next_open
 FROM (SELECT o_orderkey AS event_id, o_custkey AS c, CASE WHEN {_STATUS}='未確認' THEN o_orderkey END AS o FROM orders)""")
def next_open(spark, sf_dir):
    return R.next_open(reviews(spark, sf_dir), ["o_custkey"], "event_id").select("event_id", "next_open")


@query("latest_wins", "SELECT l_orderkey, arg_max(q, l_linenumber) AS l_quantity, arg_max(p, l_linenumber) AS l_partkey FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q, max(l_partkey) AS p FROM lineitem GROUP BY ALL) GROUP BY l_orderkey")
def latest_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.max("l_partkey").alias("l_partkey"))
    return R.latest(rows, ["l_orderkey"], "l_linenumber").drop("l_linenumber")


@query("anti_new", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_new(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("scalar_texts", f"""SELECT event_id, printf('%02d:%02d:%02d.%03d', ms//3600000, ms//60000%60, ms//1000%60, ms%1000) AS timecode, CAST(date_diff('day', DATE '1899-12-30', CAST(ts AS DATE)) AS INTEGER) AS excel_day,
 round(((epoch_us(ts)/1000000::DOUBLE+32400) % 86400)/86400, 9) AS day_fraction, CASE event_type WHEN 'click' THEN '大型' WHEN 'view' THEN '軽' ELSE '普通' END AS vehicle_class,
 regexp_replace(event_type || ':' || user_id, '[^0-9A-Za-z_-]', '_', 'g') AS safe_id FROM (SELECT *, CAST(round(value*1000) AS BIGINT) AS ms FROM events)""")
def scalar_texts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    name = F.when(F.col("event_type") == "click", "Bus").when(F.col("event_type") == "view", "KEI").otherwise("car")
    return e.select(
        "event_id", T.timecode(F.col("value")).alias("timecode"), T.excel_day(F.col("ts").cast("date")).alias("excel_day"),
        F.round(T.day_fraction(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6), 9).alias("day_fraction"), T.vehicle_class(name).alias("vehicle_class"),
        T.safe_id(F.concat("event_type", F.lit(":"), "user_id")).alias("safe_id"),
    )


@query("url_stem", "SELECT page_id, regexp_replace(regexp_extract(url, '[^/]*$'), '(.)\\.[^.]*$', '\\1') AS stem FROM pages")
def url_stem(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.stem(F.col("url")).alias("stem"))


@query("vocab_danger", "SELECT s_suppkey, CASE s_nationkey % 5 WHEN 1 THEN 'やや危険' WHEN 2 THEN '危険' WHEN 3 THEN '非常に危険' ELSE 'なし' END AS danger FROM supplier")
def vocab_danger(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.danger((F.col("s_nationkey") % 5).cast("string")).alias("danger"))


@query("scal_divide", "SELECT vec_id, round(embedding[1]::DOUBLE/2,6) AS a, round(embedding[2]::DOUBLE/4,6) AS b, round(embedding[3]::DOUBLE/4,6) AS c FROM embeddings")
def scal_divide(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", T.scaled(F.slice("embedding", 1, 3).cast("array<double>"), F.array(F.lit(2.0), F.lit(4.0))).alias("v"))
    return e.select("vec_id", *(F.round(F.col("v")[i], 6).alias(c) for i, c in enumerate("abc")))


@query("indicator_join", "SELECT s_suppkey, k AS indicator FROM (SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)+1 AS r FROM supplier) LEFT JOIN (VALUES (2,'p1'),(3,'p2'),(4,'p3'),(5,'p4'),(6,'lc'),(7,'time'),(8,'ttc')) v(r,k) USING (r)")
def indicator_join(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) + 1).alias("r"))
    marks = spark.createDataFrame(list(enumerate(("p1", "p2", "p3", "p4", "lc", "time", "ttc"), 2)), "r int, indicator string")
    return rows.join(F.broadcast(marks), "r", "left").select("s_suppkey", "indicator")


_REPORT_EVENTS = f"SELECT o_orderkey AS event_id, o_custkey % 150 AS track_id, o_orderpriority, CAST(o_orderkey % 5 AS VARCHAR) AS lvl FROM orders WHERE {_STATUS}='採用'"


@query("report", f"""SELECT e.event_id, CASE WHEN o_orderpriority='1-URGENT' THEN '大型' ELSE '普通' END AS vehicle_class, CASE lvl WHEN '1' THEN 'やや危険' WHEN '2' THEN '危険' WHEN '3' THEN '非常に危険' ELSE 'なし' END AS danger,
 round(m.pt,2) AS passing_time, round(s.sp,2) AS own_speed, concat_ws('; ', CASE WHEN p.track_id IS NULL THEN 'no trajectory' WHEN p.status<>'ok' THEN p.status END, CASE WHEN s.sp IS NULL THEN 'no speed' END) AS warning
 FROM ({_REPORT_EVENTS}) e LEFT JOIN (SELECT track_id, CASE WHEN p2 IS NULL THEN 'no phase 2' WHEN p3 IS NULL THEN 'no phase 3' WHEN p4 IS NULL THEN 'no phase 4' ELSE 'ok' END AS status FROM ({_PHASES})) p USING (track_id)
 LEFT JOIN (SELECT q.track_id, a4.t-a3.t AS pt FROM ({_PHASES}) q JOIN ({TRAJECTORY}) a2 ON a2.track_id=q.track_id AND a2.rn=q.p2 JOIN ({TRAJECTORY}) a3 ON a3.track_id=q.track_id AND a3.rn=q.p3 JOIN ({TRAJECTORY}) a4 ON a4.track_id=q.track_id AND a4.rn=q.p4) m USING (track_id)
 LEFT JOIN (SELECT interval_id AS event_id, avg(area)*3.6::DOUBLE AS sp FROM ({_SPANS}) s JOIN ({SAMPLES}) x ON x.track_id=s.user_id AND x.t BETWEEN s.lo AND s.hi GROUP BY 1) s USING (event_id)""")
def final_report(spark, sf_dir):
    e = reviews(spark, sf_dir).select(
        "event_id", "review_status", (F.col("o_custkey") % 150).alias("track_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "truck").otherwise("car").alias("vehicle_class"),
        (F.col("event_id") % 5).cast("string").alias("danger_level"),
    )
    m = e.select("event_id", "track_id").join(P.metrics(trajectory(spark, sf_dir), "track_id"), "track_id").drop("track_id")
    values = samples(spark, sf_dir).select(F.col("track_id").alias("user_id"), "t", "area")
    s = W.range_average(spans(spark, sf_dir), values, ["user_id"], "lo", "hi", "t", "area", 43200.0).select(F.col("interval_id").alias("event_id"), (F.col("mean") * 3.6).alias("own_speed"))
    return R.report(e.drop("track_id"), m, s).select("event_id", "vehicle_class", "danger", "passing_time", "own_speed", "warning")


@query("track_sessions", f"""SELECT track_id, count(*) AS n, min(t) AS t_start, max(t) AS t_end, arg_min(cx,i) AS cx_start, arg_max(cx,i) AS cx_end, max(area) AS peak_area, arg_min(t,{{'a':-area,'i':i}}) AS peak_t
 FROM (SELECT *, sum(CASE WHEN t-p>=21600 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY i) AS g FROM (SELECT *, lag(t) OVER (PARTITION BY track_id ORDER BY i) AS p FROM ({SAMPLES}))) GROUP BY track_id, g""")
def track_sessions(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("event_time", F.timestamp_micros("ord.us"))
    return live.track_sessions(s, "6 hours").drop("session", "video_id")


@query("union_videos", "SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM (SELECT * FROM events WHERE event_type='click' UNION ALL SELECT * FROM events WHERE event_type='view') GROUP BY 1")
def union_videos(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    both = e.where("event_type = 'click'").unionByName(e.where("event_type = 'view'"))
    return both.groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("parse_time", "SELECT event_id, CAST(event_id % 24 * 3600 + event_id % 60 * 60 + event_id % 59 AS DOUBLE) AS seconds FROM events")
def parse_time(spark, sf_dir):
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", T.parse_time(F.concat_ws(":", k % 24, k % 60, k % 59)).alias("seconds"))


@query("review_counts", f"SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE {_STATUS}<>'未確認') AS reviewed FROM orders GROUP BY 1")
def review_counts(spark, sf_dir):
    return R.progress(reviews(spark, sf_dir), ["o_custkey"])


@query("event_rows", f"""SELECT printf('%03d', row_number() OVER (ORDER BY t_start, track_id)) AS event_id, printf('%.2f', t_start) AS t_start_s, printf('%.2f', t_end-t_start) AS duration_s, n AS kei_plate_hits, 'a.mp4' AS source_video FROM ({_MEASURES}) WHERE n>=5""")
def event_rows(spark, sf_dir):
    m = K.number_events(K.track_measures(samples(spark, sf_dir)).where("n >= 5"), "t_start", "track_id")
    m = m.withColumns({c: F.lit("") for c in ("vehicle_type", "detector_class", "side")} | {"plate_score": F.lit(0.0), "plate_hits": F.col("n"), "source_video": F.lit("clips/a.mp4")})
    m = m.withColumns({"global_t_start": F.col("t_start"), "global_peak_t": F.col("t_start"), "global_t_end": F.col("t_end")})
    return exports.event_rows(m).select("event_id", "t_start_s", "duration_s", "kei_plate_hits", "source_video")
