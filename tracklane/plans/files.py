"""Queries of the operators around detections, clocks, texts and exported tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import boxes as B
from ..operators import detection as D
from ..operators import final
from ..operators import ordering as O
from ..operators import points as L
from ..operators import review as R
from ..operators import timeline as W
from ..operators import tracks as K
from ..sources import exports, telemetry
from .queries import _STATUS, reviews, rounded
from .registry import query
from .views import POINTS, SAMPLES, points, samples, table

_BOXES = """SELECT CAST(l_suppkey % 5 AS BIGINT) AS video_id, l_orderkey AS frame, l_linenumber, CAST(l_quantity AS BIGINT) % 9 AS cls_id, CAST(l_discount AS DOUBLE)*10 AS score, l_linenumber*10.0::DOUBLE AS x1, CAST(l_quantity AS DOUBLE) AS y1,
 l_linenumber*10.0::DOUBLE + CAST(l_quantity AS DOUBLE)*5 AS x2, CAST(l_quantity AS DOUBLE)+20 AS y2, 640 AS w, 360 AS h FROM lineitem"""


def found_boxes(spark, sf_dir):
    q, k = F.col("l_quantity").cast("double"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 5).alias("video_id"), F.col("l_orderkey").alias("frame"), "l_linenumber", (q.cast("long") % 9).alias("cls_id"), (F.col("l_discount").cast("double") * 10).alias("score"),
        (k * 10.0).alias("x1"), q.alias("y1"), (k * 10.0 + q * 5).alias("x2"), (q + 20).alias("y2"), F.lit(640).alias("w"), F.lit(360).alias("h"),
    )


@query("detections", f"SELECT frame, l_linenumber, CASE cls_id WHEN 2 THEN 'car' WHEN 5 THEN 'bus' ELSE 'truck' END AS cls FROM ({_BOXES}) WHERE cls_id IN (2,5,7) AND score>=0.3 AND frame % 3=0")
def detections(spark, sf_dir):
    return D.detections(found_boxes(spark, sf_dir), 0.3, 3).select("frame", "l_linenumber", "cls")


@query("box_shares", f"""SELECT frame, l_linenumber, round((x1+x2)/2/w,9) AS cx, round((y1+y2)/2/h,9) AS cy, round((x2-x1)*(y2-y1)/(w*h),9) AS area, round(y2/h,9) AS bottom_y, round(frame/CASE video_id WHEN 0 THEN 30.0::DOUBLE ELSE video_id*10 END,9) AS t
 FROM ({_BOXES}) WHERE cls_id IN (2,5,7) AND score>=0.3""")
def box_shares(spark, sf_dir):
    of = spark.range(5).select(F.col("id").alias("video_id"), F.when(F.col("id") > 0, F.col("id") * 10.0).alias("fps"), F.lit(900).alias("total_frames"))
    rows = D.detections(found_boxes(spark, sf_dir)).join(F.broadcast(D.videos(of)), "video_id")
    return rounded(rows.select("frame", "l_linenumber", *D.normalised()))


_FLOW = "SELECT vec_id // 16 AS frame, CAST(embedding[1] AS DOUBLE) AS dx, CAST(embedding[2] AS DOUBLE) AS dy, label % 5<>0 AND abs(CAST(embedding[3] AS DOUBLE))*8<1 AS good FROM embeddings"


@query("frame_flow", f"SELECT frame, round(CASE WHEN count(*) FILTER (WHERE good)<10 THEN 0 ELSE median(CASE WHEN good THEN sqrt(dx*dx+dy*dy) END) END,9) AS flow FROM ({_FLOW}) GROUP BY frame")
def frame_flow(spark, sf_dir):
    at = lambda i: F.col("embedding")[i].cast("double")
    found = (F.col("label") % 5 != 0).cast("int")
    rows = table(spark, sf_dir, "embeddings").select(
        F.lit(1).alias("video_id"), F.floor(F.col("vec_id") / 16).alias("frame"), at(0).alias("dx"), at(1).alias("dy"), F.lit(1).alias("st1"), found.alias("st2"), (F.abs(at(2)) * 8).alias("error")
    )
    return rounded(D.frame_flow(rows).select("frame", "flow"))


_CONTOURS = "SELECT l_suppkey, CAST(l_quantity AS DOUBLE) AS bw, l_linenumber*6.0::DOUBLE AS bh, CAST(l_quantity AS DOUBLE)*l_linenumber*6*(1-CAST(l_discount AS DOUBLE)) AS area FROM lineitem"


@query("plate_scores", f"""SELECT l_suppkey, round(coalesce(max(CASE WHEN bw>=6 AND bh>=3 AND area>=18 AND bw/bh BETWEEN 1.15 AND 3.8 AND area/40000 BETWEEN 0.0003 AND 0.06
 THEN least(1, 0.5*area/(bw*bh)+0.3*least(1, area/40000/0.004)+0.2*greatest(0, 1-abs(bw/bh-2)/2)) END), 0),9) AS plate_score FROM ({_CONTOURS}) GROUP BY l_suppkey""")
def plate_scores(spark, sf_dir):
    bw, bh = F.col("l_quantity").cast("double"), F.col("l_linenumber") * 6.0
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", bw.alias("bw"), bh.alias("bh"), (bw * bh * (1 - F.col("l_discount").cast("double"))).alias("area"), F.lit(250.0).alias("vw"), F.lit(160.0).alias("vh"))
    return rounded(D.plate_scores(rows, ["l_suppkey"]))


@query("clip_windows", "SELECT event_id, round(greatest(0, value-2),6) AS clip_start, round(user_id+4,6)::DOUBLE AS clip_duration, 'event_' || event_id || '_' || event_type || '.mp4' AS clip FROM events")
def clip_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("side"), F.col("value").alias("t_start"), (F.col("value") + F.col("user_id")).alias("t_end"))
    return e.select("event_id", *D.clip_window()).withColumns({c: F.round(c, 6) for c in ("clip_start", "clip_duration")})


@query("clip_exists", "SELECT event_id, event_type IN ('click','view') AND user_id % 3=0 AS has_clip FROM events")
def clip_exists(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    name = F.concat(F.lit("event_"), "event_id", F.lit("_"), "event_type", F.lit(".mp4"))
    files = e.where("event_type IN ('click','view') AND user_id % 3 = 0").select(name.alias("name"))
    return D.with_clips(e.withColumn("side", F.col("event_type")), files).select("event_id", "has_clip")


@query("global_times", """SELECT event_id, round(value+o,6) AS global_t_start, round(value+1+o,6) AS global_peak_t, round(value+3+o,6) AS global_t_end, 3.0::DOUBLE AS duration
 FROM events JOIN (SELECT n_nationkey AS v, coalesce(sum(n_nationkey*1.5::DOUBLE) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS o FROM nation) ON v=user_id % 25""")
def global_times(spark, sf_dir):
    of = K.video_offsets(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("video_id"), F.col("n_nationkey").alias("ord"), (F.col("n_nationkey") * 1.5).alias("duration")))
    v = F.col("value")
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 25).alias("video_id"), v.alias("t_start"), (v + 1).alias("peak_t"), (v + 3).alias("t_end"))
    out = D.global_times(e, F.broadcast(of))
    return out.select("event_id", *(F.round(c, 6).alias(c) for c in ("global_t_start", "global_peak_t", "global_t_end", "duration")))


@query("number_texts", """SELECT l_orderkey, l_linenumber, printf('%.15g', x) AS fifteen, printf('%.8g', y) AS eight, CAST(printf('%.2f', x) AS DOUBLE) AS two, CASE WHEN x<0 AND floor(x+0.5)<0 THEN '-' ELSE '' END || (abs(CAST(floor(x+0.5) AS BIGINT))//60) || '分' || (abs(CAST(floor(x+0.5) AS BIGINT))%60) || '秒' AS minutes
 FROM (SELECT l_orderkey, l_linenumber, (CAST(l_extendedprice AS DOUBLE)-30000)/8 AS x, CAST(l_extendedprice AS DOUBLE)*pow(10, l_linenumber*3-14) AS y FROM lineitem)""")
def number_texts(spark, sf_dir):
    p = F.col("l_extendedprice").cast("double")
    x, y = (p - 30000) / 8, p * F.pow(F.lit(10.0), (F.col("l_linenumber") * 3 - 14).cast("double"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.general(x).alias("fifteen"), T.general(y, 8).alias("eight"), T.round_exact(x, 2).alias("two"), T.minutes_text(x).alias("minutes"))


@query("collection_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 5=4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS collected FROM orders")
def collection_dates(spark, sf_dir):
    day, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 5
    form = lambda f: F.date_format(day, f)
    # folders' years are of this century
    late = day >= F.lit("2000-01-01").cast("date")
    text = F.when(k == 0, form("yyyy-MM-dd")).when(k == 1, form("yyyy/M/d")).when(k == 2, form("yyMMdd")).when(k == 3, F.when(late, "").otherwise(form("yyyy-MM-dd"))).otherwise("2026-13-40")
    folder = F.when(k == 3, F.concat(form("yyMMdd"), F.lit("_1"))).otherwise("run")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.collection_date(text, folder).alias("collected"))


@query("text_numbers", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN user_id::DOUBLE ELSE 0 END + 2.5 AS seconds, CASE event_id % 4 WHEN 0 THEN value END AS number, event_id % 4=2 AS truthy, CASE WHEN event_id % 4=3 THEN NULL ELSE event_id::DOUBLE END AS stem_time, chr(CAST(65+event_id % 26 AS INTEGER)) AS letter FROM events""")
def text_numbers(spark, sf_dir):
    k = F.col("event_id") % 4
    a = F.when(k == 0, F.col("value").cast("string")).when(k == 1, " ").when(k == 2, "TRUE").otherwise("inf?")
    b = F.when(k == 1, F.col("user_id").cast("string")).otherwise("x")
    stem = F.when(k == 0, F.col("event_id").cast("string")).when(k == 1, F.concat(F.lit("frame7_"), "event_id")).when(k == 2, F.concat(F.lit("a"), "event_id", F.lit("b"))).otherwise("none")
    rows = table(spark, sf_dir, "events").select("event_id", a.alias("a"), b.alias("b"), stem.alias("s"))
    return rows.select("event_id", final.capture_seconds("a", "b", 2.5).alias("seconds"), T.number(F.col("a")).alias("number"), T.truthy(F.col("a")).alias("truthy"), T.stem_time(F.col("s")).alias("stem_time"), T.column_letters(F.col("event_id") % 26).alias("letter"))


@query("clock_texts", "SELECT event_id, strftime(date_trunc('millisecond', ts), '%Y-%m-%d %H:%M:%S.%g') AS shown, round(epoch_us(date_trunc('millisecond', ts))/1000000.0::DOUBLE, 3) AS unix, round(epoch_us(date_trunc('millisecond', ts))/1000000.0::DOUBLE-1704067200.0::DOUBLE, 3) AS clock_offset FROM events")
def clock_texts(spark, sf_dir):
    gpsu = F.date_format(F.col("ts").cast("timestamp"), "yyMMddHHmmss.SSS")
    rows = table(spark, sf_dir, "events").select("event_id", gpsu.alias("g"))
    unix = telemetry.clock_seconds(F.col("g"))
    return rows.select("event_id", telemetry.clock_text(F.col("g")).alias("shown"), F.round(unix, 3).alias("unix"), telemetry.clock_offset(unix, F.lit(1704067200.0)).alias("clock_offset"))


@query("start_estimates", f"""SELECT track_id, round(coalesce(avg(area) FILTER (WHERE abs(area-m)<=20), avg(area)),6) AS start, count(*) AS estimates
 FROM (SELECT *, median(area) OVER (PARTITION BY track_id) AS m FROM (SELECT track_id, area, row_number() OVER (PARTITION BY track_id ORDER BY i) AS k FROM ({SAMPLES}) WHERE i<60 AND cls<>'error') WHERE k<=12) GROUP BY track_id""")
def start_estimates(spark, sf_dir):
    early = K.numbered(samples(spark, sf_dir)).where("i < 60 AND cls <> 'error'")
    some = final.first_of(early, ["track_id"], ["i"], 12)
    mean = W.robust_mean(some, ["track_id"], "area", 20.0)
    counts = some.groupBy("track_id").agg(F.count("*").alias("estimates"))
    return mean.join(counts, "track_id").select("track_id", F.round("mean", 6).alias("start"), "estimates")


@query("candidate_order", f"SELECT event_id, row_number() OVER (ORDER BY a, event_id) AS place FROM (SELECT o_orderkey AS event_id, CASE WHEN {_STATUS}='採用' THEN 0 ELSE 1 END AS a FROM orders WHERE {_STATUS}<>'除外')")
def candidate_order(spark, sf_dir):
    first, rest = final.candidate_order("event_id")
    rows = R.not_rejected(reviews(spark, sf_dir)).withColumn("a", first)
    return O.number_rows(rows, ["a", "event_id"], "place").select("event_id", "place")


@query("names_order", "SELECT page_id, row_number() OVER (ORDER BY lower(url), page_id) AS place FROM pages")
def names_order(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.lower("url").alias("low"))
    return O.number_rows(rows, ["low", "page_id"], "place").select("page_id", "place")


@query("export_counts", f"""SELECT n.f AS event_id, 1::BIGINT AS frames, count(DISTINCT frame_idx) AS written_frames, count(ord) AS points FROM (SELECT CAST(n_nationkey AS BIGINT) AS f FROM nation) n LEFT JOIN (SELECT * FROM ({POINTS}) WHERE x BETWEEN -0.1 AND 0.1) p ON p.frame_idx=n.f GROUP BY n.f""")
def export_counts(spark, sf_dir):
    asked = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("event_id"), F.col("n_nationkey").cast("long").alias("frame_idx"))
    some = L.roi(points(spark, sf_dir), (-0.1, 0.1), (-1e9, 1e9)).join(F.broadcast(asked), "frame_idx")
    return final.exported_counts(some, asked)


@query("outcome_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def outcome_counts(spark, sf_dir):
    return final.outcome_counts(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status")))


@query("filled_rows", "SELECT count(*) AS rows FROM (SELECT * FROM region r, (SELECT unnest(range(1)))) WHERE r_regionkey<>0 OR length(trim(r_name))>3")
def filled_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).cast("long").alias("place"), F.col("r_regionkey"), F.when(F.length(F.trim("r_name")) > 3, F.col("r_name")).otherwise(" ").alias("name"))
    return final.filled(final.padded(rows))


@query("stem_join", "SELECT e.event_id, n.n_nationkey FROM events e JOIN nation n ON lower(n.n_name)=lower(n.n_name) AND n.n_nationkey=e.user_id % 30")
def stem_join(spark, sf_dir):
    speeds = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("video"), "n_nationkey")
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("clips/"), F.upper("n_name"), F.lit(".MP4")).alias("source_video"))
    e = table(spark, sf_dir, "events").withColumn("k", F.col("user_id") % 30).join(F.broadcast(names), "k", "left")
    return e.withColumn("video", F.lower(T.stem(F.col("source_video")))).join(F.broadcast(speeds), "video").select("event_id", "n_nationkey")


@query("trajectory_join", "SELECT event_id, CASE WHEN user_id % 2=0 THEN 'ok' END AS status FROM events")
def trajectory_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    rows = e.withColumn("key", F.col("event_id")).withColumn("event_id", F.concat(F.lit("a "), "event_id"))
    known = e.where("user_id % 2 = 0").select(F.concat(F.lit("overtaking_a_"), "event_id", F.lit("_edit.csv")).alias("name"), F.lit("ok").alias("status"))
    return final.with_metrics(rows, known).select(F.col("key").alias("event_id"), "status")


@query("frame_groups", """SELECT file, frame, t, count(*) AS n FROM (SELECT *, min(CASE WHEN ok THEN k END) OVER (PARTITION BY file, frame) AS o, arg_min(v, CASE WHEN ok THEN k END) OVER (PARTITION BY file, frame) AS t
 FROM (SELECT CAST(user_id % 7 AS VARCHAR) AS file, CAST(user_id AS VARCHAR) AS frame, event_id AS k, value AS v, event_type<>'error' AS ok FROM events)) WHERE k>=o GROUP BY ALL""")
def frame_groups(spark, sf_dir):
    text = F.when(F.col("event_type") != "error", F.col("value").cast("string")).otherwise("x")
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 7).cast("string").alias("file"), F.col("user_id").cast("string").alias("frame"), F.col("event_id").alias("ord"), text.alias("time_text"))
    return L.frame_groups(rows).groupBy("file", "frame", "t").agg(F.count("*").alias("n"))


@query("sample_times", "SELECT vec_id, i-1 AS row_idx, round(vec_id*0.5::DOUBLE+(i-0.5::DOUBLE)/len(embedding)*0.5::DOUBLE,9) AS t, round(embedding[i]::DOUBLE/CASE i WHEN 1 THEN 2.0::DOUBLE ELSE 4 END,9) AS v FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding)+1)) AS i)")
def sample_times(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("n"), F.posexplode(T.scaled(F.col("embedding").cast("array<double>"), F.array(F.lit(2.0), F.lit(4.0)))).alias("row_idx", "v"))
    return rounded(e.select("vec_id", "row_idx", (F.col("vec_id") * 0.5 + (F.col("row_idx") + 0.5) / F.col("n") * 0.5).alias("t"), "v"))


@query("vehicle_speed", f"""SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 3>0 AND o_orderkey % 4>0 THEN round(o_orderkey % 50+0.25+(o_orderkey % 20)-3,2)::DOUBLE END AS vehicle_speed FROM orders WHERE {_STATUS}='採用'""")
def vehicle_speed(spark, sf_dir):
    k = F.col("event_id")
    e = reviews(spark, sf_dir).select("event_id", "review_status", F.lit("car").alias("vehicle_class"), F.lit("1").alias("danger_level"))
    none = F.lit(None).cast("double")
    m = e.select("event_id", F.lit("ok").alias("status"), F.when(k % 3 > 0, (k % 20) - 3.0).alias("relative_speed"), none.alias("passing_time"), none.alias("ttc"), none.alias("lc"))
    s = e.select("event_id", F.when(k % 4 > 0, (k % 50) + 0.25).alias("own_speed"))
    return R.report(e, m, s).select("event_id", "vehicle_speed")


@query("reviewed_list", f"SELECT o_orderkey AS event_id, printf('%02d:%02d:%02d.000', (o_orderkey % 7000+10)//3600, (o_orderkey % 7000+10)//60%60, (o_orderkey % 7000+10)%60) AS veloview_t_start FROM orders WHERE {_STATUS}<>'除外'")
def reviewed_list(spark, sf_dir):
    e = reviews(spark, sf_dir).withColumns({c: (F.col("event_id") % 7000).cast("string") for c in ("t_start_s", "peak_t_s", "t_end_s")} | {"clip_url": F.lit("u")})
    return final.reviewed_rows(e, 10.0).select("event_id", "veloview_t_start")


@query("trajectory_lines", f"SELECT track_id AS name, printf('%.15g', sqrt(cx*cx+cy*cy)) AS \"distance(m)\", printf('%.15g', area) AS \"speed(km/h)\", CAST(t AS VARCHAR)<>'' AS there FROM ({SAMPLES})")
def trajectory_lines(spark, sf_dir):
    rows = samples(spark, sf_dir).select(
        F.col("track_id").alias("name"), "t", F.col("t").cast("string").alias("time_text"), F.col("cx").cast("string").alias("x_text"), F.col("cy").cast("string").alias("y_text"), F.lit("0").alias("z_text"),
        F.sqrt(F.col("cx") * F.col("cx") + F.col("cy") * F.col("cy")).alias("distance"), F.col("area").alias("speed"),
    )
    return exports.trajectory_rows(rows).select("name", "`distance(m)`", "`speed(km/h)`", (F.col("unixtime") != "").alias("there"))


@query("union_streams", "SELECT key, count(*) AS n, min(vec_id) AS first FROM (SELECT 'a' AS key, vec_id FROM embeddings UNION ALL SELECT 'b', vec_id FROM embeddings WHERE label % 2=0 UNION ALL SELECT 'a', doc_id FROM documents) GROUP BY key")
def union_streams(spark, sf_dir):
    e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    parts = (e.select(F.lit("a").alias("key"), "vec_id"), e.where("label % 2 = 0").select(F.lit("b").alias("key"), "vec_id"), d.select(F.lit("a").alias("key"), F.col("doc_id").alias("vec_id")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("key").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))


_DECIDED = f"SELECT o_orderkey AS event_id, o_custkey AS c, CASE WHEN o_orderkey % 3=0 THEN CASE WHEN o_orderkey % 2=0 THEN '除外' ELSE '未確認' END ELSE {_STATUS} END AS s FROM orders"


@query("decided", f"""SELECT event_id, s AS review_status, coalesce(min(o) OVER (PARTITION BY c ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), min(o) OVER (PARTITION BY c)) AS next_open
 FROM (SELECT *, CASE WHEN s='未確認' THEN event_id END AS o FROM ({_DECIDED}))""")
def decided(spark, sf_dir):
    e = reviews(spark, sf_dir)
    some = e.where("event_id % 3 = 0")
    first = some.select("event_id", F.lit(T.ACCEPTED).alias("status"), F.lit(1).alias("seq"))
    second = some.select("event_id", F.when(F.col("event_id") % 2 == 0, T.REJECTED).otherwise(T.OPEN).alias("status"), F.lit(2).alias("seq"))
    return R.decide(e, second.unionByName(first), ["o_custkey"], "event_id").select("event_id", "review_status", "next_open")


@query("display_points", f"SELECT frame_idx, ord, CAST(printf('%.3f', x) AS DOUBLE)+0.0::DOUBLE AS x, CAST(printf('%.3f', y) AS DOUBLE)+0.0::DOUBLE AS y, CAST(printf('%.3f', z) AS DOUBLE)+0.0::DOUBLE AS z FROM (SELECT *, row_number() OVER (PARTITION BY frame_idx ORDER BY ord)-1 AS i, count(*) OVER (PARTITION BY frame_idx) AS n FROM ({POINTS})) WHERE i % CAST(ceil(n/20.0) AS BIGINT)=0")
def display_points(spark, sf_dir):
    shown = L.display(L.thin(points(spark, sf_dir), ["frame_idx"], "ord", 20).withColumn("intensity", F.lit(0)))
    return shown.select("frame_idx", "ord", *((F.col(c) + 0.0).alias(c) for c in "xyz"))


@query("follow_boxes")
def follow_boxes(spark, sf_dir):
    """Boxes through the frames of all points: state from frame to frame, which SQL lacks; the tests follow them plainly."""
    starts = spark.createDataFrame([(f"e{k}", 1, 0, 10**9, -0.3 + 0.1 * k, 0.1 + 0.1 * k, -0.2, 0.2, None) for k in range(4)], "event_id string, capture_id int, first_frame long, last_frame long, min_x double, max_x double, min_y double, max_y double, lasers array<long>")
    return B.follow_boxes(points(spark, sf_dir), F.broadcast(starts))


_STEPS = f"""WITH RECURSIVE e AS (SELECT f AS frame_idx, k, 7.0::DOUBLE*k AS bx FROM (SELECT DISTINCT vec_id//50 AS f FROM embeddings), (VALUES (0), (1)) AS t(k)),
 p AS (SELECT e.frame_idx, k, bx, x*10 AS x, y*10 AS y, floor(x*10/0.6::DOUBLE) AS gx, floor(y*10/0.6::DOUBLE) AS gy FROM e JOIN ({POINTS}) p ON p.frame_idx=e.frame_idx WHERE abs(x*10-bx)<=7.2::DOUBLE AND abs(y*10)<=7.2::DOUBLE),
 c AS (SELECT DISTINCT frame_idx, k, gx, gy FROM p),
 r AS (SELECT *, gx AS cx, gy AS cy FROM c UNION SELECT c.*, r.cx, r.cy FROM r JOIN c ON c.frame_idx=r.frame_idx AND c.k=r.k AND abs(c.gx-r.gx)<=1 AND abs(c.gy-r.gy)<=1),
 m AS (SELECT frame_idx, k, gx, gy, min({{'a':cx,'b':cy}}) AS id FROM r GROUP BY ALL),
 g AS (SELECT frame_idx, k, any_value(bx) AS bx, id, count(*) AS n, avg(x) AS x, avg(y) AS y FROM p JOIN m USING (frame_idx, k, gx, gy) GROUP BY frame_idx, k, id HAVING count(*)>=8),
 b AS (SELECT frame_idx, k, arg_min({{'n':n,'x':x,'y':y}}, sqrt((x-bx)*(x-bx)+y*y)) AS b FROM g GROUP BY frame_idx, k),
 s AS (SELECT e.*, b, coalesce(least(1::DOUBLE, 6.0::DOUBLE/sqrt((b.x-bx)*(b.x-bx)+b.y*b.y)), 0) AS part FROM e LEFT JOIN b USING (frame_idx, k))
SELECT frame_idx || '-' || k AS event_id, frame_idx, b IS NOT NULL AS found, coalesce(b.n, 0) AS n_points, round(b.x,6) AS centre_x, round(b.y,6) AS centre_y, round(bx-6+coalesce(b.x-bx,0)*part,6) AS min_x, round(6+coalesce(b.y,0)*part,6) AS max_y, round(coalesce(b.x-bx,0)*part,6) AS vel_x FROM s"""


@query("box_steps", _STEPS)
def box_steps(spark, sf_dir):
    """A step of a box at the points and of one beside them, in every frame: search, grouping, nearest vehicle, and the longest step."""
    wide = points(spark, sf_dir).withColumns({"x": F.col("x") * 10, "y": F.col("y") * 10})
    frames = wide.select("frame_idx").distinct().withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    box = {"min_x": 7.0 * F.col("k") - 6, "max_x": 7.0 * F.col("k") + 6, "min_y": F.lit(-6.0), "max_y": F.lit(6.0)}
    starts = frames.select(F.concat_ws("-", "frame_idx", "k").alias("event_id"), F.lit(1).alias("capture_id"), (F.col("frame_idx") - 1).alias("first_frame"), F.col("frame_idx").alias("last_frame"), F.lit(None).cast("array<long>").alias("lasers"), *(c.alias(n) for n, c in box.items()))
    # every event is of one frame: its points alone meet it
    of = wide.withColumn("capture_id", F.col("frame_idx"))
    out = B.follow_boxes(of, starts.withColumn("capture_id", F.col("last_frame")))
    return out.select("event_id", "frame_idx", "found", F.col("n_points").cast("long").alias("n_points"), *(F.round(c, 6).alias(c) for c in ("centre_x", "centre_y", "min_x", "max_y", "vel_x")))
