"""Queries that write the tables' rows as files of the formats and read them back.

Files lie in the shared folder; their number grows with the tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import final
from ..operators import phases as P
from ..scratch import Tables
from ..sources import exports, lidar, mp4, tables, telemetry, workbooks
from ..sources.files import register
from ..sources.named import NamedBytes, write_files
from ..streaming import live
from .queries import _PHASES, _STATUS, reviews
from .registry import query
from .views import POINTS, SAMPLES, TRAJECTORY, points, samples, table, trajectory


def _folder(spark: SparkSession, name: str) -> str:
    return Tables(spark, name).path("files")


def _hex(value: Column | int, size: int) -> Column:
    """A whole number that isn't negative as so many bytes, the highest first."""
    return F.lpad(F.hex(value.cast("long")), 2 * size, "0") if isinstance(value, Column) else F.lit(f"{value:0{2 * size}x}")


def _little(value: Column | int, size: int) -> Column:
    return F.concat(*(_hex(F.shiftright(value, 8 * k) % 256, 1) for k in range(size))) if isinstance(value, Column) else F.lit(value.to_bytes(size, "little").hex())


def _entry(key: str, kind: str, size: int, n: Column | int, data: Column) -> Column:
    """An entry as hexadecimal text, of data that fills whole words."""
    return F.concat(F.lit(key.encode().hex()), F.lit(f"{ord(kind):02x}"), _hex(size, 1), _hex(n, 2), data)


def _container(key: str, inside: Column) -> Column:
    return _entry(key, "\0", 1, F.length(inside) / 2, inside)


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, sample_idx, payload): an order's lines as accelerations in hundredths, with a clock; some 1250 orders a video.

    The clock of a video's first sample is ten seconds late.
    """
    rows = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda r: F.concat(_hex(r["l_partkey"], 4), _hex(r["l_suppkey"], 4)))
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(rows.alias("rows"))
    orders = orders.withColumn("v", F.floor(F.col("l_orderkey") / 5000)).withColumn("sample_idx", F.row_number().over(Window.partitionBy("v").orderBy("l_orderkey")) - 1)
    at = F.lit(1_767_225_600) + F.col("v") + F.col("sample_idx") / 2 - F.when(F.col("sample_idx") == 0, 10).otherwise(0)
    clock = F.hex(F.date_format(F.timestamp_millis((at * 1000).cast("long")), "yyMMddHHmmss.SSS"))
    body = F.concat(_entry("GPSU", "U", 16, 1, clock), _entry("SCAL", "l", 4, 1, _hex(100, 4)), _entry("ACCL", "l", 8, F.size("rows"), F.array_join("rows", "")))
    return orders.select(F.format_string("v%05d", "v").alias("video"), "sample_idx", F.unhex(_container("DEVC", _container("STRM", body))).alias("payload"))


_PAYLOADS = "SELECT printf('v%05d', l_orderkey//5000) AS video, dense_rank() OVER (PARTITION BY l_orderkey//5000 ORDER BY l_orderkey)-1 AS sample_idx, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)-1 AS row_idx, l_partkey/100.0::DOUBLE AS v1, l_suppkey/100.0::DOUBLE AS v2 FROM lineitem"
_ROWS = f"SELECT video, sample_idx, row_idx, round(sample_idx*0.5::DOUBLE+(row_idx+0.5::DOUBLE)/n*0.5::DOUBLE,9) AS t, v1, v2 FROM ({_PAYLOADS})"


@query("payload_rows", _ROWS)
def payload_rows(spark, sf_dir):
    rows = payloads(spark, sf_dir).withColumns({"pts": F.col("sample_idx") * 0.5, "duration": F.lit(0.5)})
    measured = telemetry.rows(rows.withColumn("sample_idx", F.col("sample_idx").cast("long")))
    return measured.select("video", "sample_idx", F.col("row_idx").cast("long").alias("row_idx"), F.round("t", 9).alias("t"), F.col("vals")[0].alias("v1"), F.col("vals")[1].alias("v2"))


@query("payload_table_function", _ROWS)
def payload_table_function(spark, sf_dir):
    telemetry.register_functions(spark)
    rows = payloads(spark, sf_dir)
    return spark.sql(
        "SELECT video, CAST(sample_idx AS BIGINT) AS sample_idx, m.row_idx, round(m.t, 9) AS t, m.ax_mps2 AS v1, m.ay_mps2 AS v2 FROM {rows}, LATERAL gpmf_rows(payload, sample_idx * 0.5D, 0.5D, 'ACCL') AS m", rows=rows
    )


def _box(kind: str, inside: Column) -> Column:
    return F.concat(_hex(F.length(inside) / 2 + 8, 4), F.lit(kind.encode().hex()), inside)


def videos(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a video for each of :func:`payloads`, a chunk a sample, two samples a second."""
    path = _folder(spark, "videos")
    register(spark, NamedBytes)
    rows = payloads(spark, sf_dir).withColumn("size", F.octet_length("payload"))
    head = 16  # of the boxes before the first sample
    before = F.coalesce(F.sum("size").over(Window.partitionBy("video").orderBy("sample_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + head
    rows = rows.withColumn("offset", before).withColumn("name", F.concat("video", F.lit(".mp4")))
    table_ = lambda kind, n, data: _box(kind, F.concat(F.lit("00000000"), _hex(n, 4), data))
    each = lambda c: F.array_join(F.transform("s", lambda s: _hex(s[c], 4)), "")
    n = F.size("s")
    codec = _box("stsd", F.concat(F.lit("00000000"), _hex(1, 4), _hex(16, 4), F.lit(mp4.CODEC.hex()), F.lit("00" * 8)))
    sizes = _box("stsz", F.concat(F.lit("00" * 8), _hex(n, 4), each("size")))
    stbl = F.concat(codec, table_("stts", F.lit(1), F.concat(_hex(n, 4), _hex(500, 4))), table_("stsc", F.lit(1), F.lit("00000001" * 3)), sizes, table_("stco", n, each("offset")))
    clock = _box("mdhd", F.concat(F.lit("00" * 12), _hex(1000, 4), F.lit("00" * 8)))
    moov = _box("moov", _box("trak", _box("mdia", F.concat(clock, _box("minf", _box("stbl", stbl))))))
    whole = rows.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("sample_idx", "size", "offset"))).alias("s"), F.sum("size").alias("total"))
    first = whole.select("name", F.lit(-1).alias("at"), F.unhex(F.concat(_box("free", F.lit("")), _hex(F.col("total") + 8, 4), F.lit(b"mdat".hex()))).alias("data"))
    last = whole.select("name", F.lit((1 << 31) - 1).alias("at"), F.unhex(moov).alias("data"))
    write_files(rows.select("name", F.col("sample_idx").alias("at"), F.col("payload").alias("data")).unionByName(first).unionByName(last), path, "named_bytes", ["at"])
    return path


def _video() -> Column:
    return F.regexp_extract("video", r"([^/]*)\.mp4$", 1).alias("video")


_SIZES = f"SELECT video, sample_idx, 60+8*any_value(n) AS size FROM ({_PAYLOADS}) GROUP BY ALL"


@query("video_samples", f"SELECT video, sample_idx, CAST(16+coalesce(sum(size) OVER (PARTITION BY video ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS \"offset\", size, sample_idx*0.5::DOUBLE AS pts, 0.5::DOUBLE AS duration FROM ({_SIZES})")
def video_samples(spark, sf_dir):
    return mp4.read_samples(spark, videos(spark, sf_dir), payload=False, split=1 << 15).select(_video(), "sample_idx", "offset", "size", "pts", "duration")


@query("video_measurements", _ROWS)
def video_measurements(spark, sf_dir):
    measured = telemetry.rows(mp4.read_samples(spark, videos(spark, sf_dir), split=1 << 15))
    return measured.select(_video(), "sample_idx", F.col("row_idx").cast("long").alias("row_idx"), F.round("t", 9).alias("t"), F.col("vals")[0].alias("v1"), F.col("vals")[1].alias("v2"))


@query("video_starts", f"SELECT video, round(CASE WHEN count(*)>1 THEN 0.0::DOUBLE ELSE -10 END+1767225600+CAST(substr(video,2) AS BIGINT),3) AS start_unix, least(count(*),12) AS estimates FROM ({_SIZES}) GROUP BY video HAVING count(*)<>2")
def video_starts(spark, sf_dir):
    """Two estimates ten seconds apart have no middle near either: left out."""
    starts = telemetry.video_starts(mp4.read_samples(spark, videos(spark, sf_dir)))
    return starts.where("estimates <> 2").select(_video(), F.round("start_unix", 3).alias("start_unix"), "estimates")


#: Bytes of a range in the captures' queries: far fewer than a user would take, so that there are many.
_RANGE = 1 << 16


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packets of a capture for each user, an event a packet: azimuth by cx, distance by value, every other block without returns."""
    path = _folder(spark, "captures")
    register(spark, NamedBytes)
    s = samples(spark, sf_dir).withColumns({"azimuth": F.floor(F.col("cx") * 36000 + 0.5) % 36000, "distance": 500 + F.floor("area") % 60000})
    block = lambda b: F.concat(F.lit("ffee"), _little((F.col("azimuth") + 10 * b) % 36000, 2), F.repeat(F.concat(_little(F.col("distance") if b % 2 == 0 else 0, 2), F.lit("50")), 32))
    packet = F.concat(*(block(b) for b in range(12)), F.lit("00" * 4), F.lit("3722"))
    us = F.col("ord.us")
    lead = F.concat(_little(F.floor(us / 1_000_000), 4), _little(us % 1_000_000, 4), _little(1206 + 42, 4), _little(1206 + 42, 4))
    name = F.format_string("%06d/user%06d.pcap", F.floor(F.col("track_id") / 1000), "track_id")  # so that no folder grows with the table
    rows = s.select(name.alias("name"), "ord", F.unhex(F.concat(lead, F.lit("00" * 42), packet)).alias("data"))
    heads = rows.select("name").distinct().select("name", F.lit(None).cast(rows.schema["ord"].dataType).alias("ord"), F.unhex(F.lit("d4c3b2a1" + "02000400" + "00" * 8 + "ffff0000" + "01000000")).alias("data"))
    write_files(rows.unionByName(heads), path, "named_bytes", ["ord"])
    return lidar.read_packets(spark, path, split=_RANGE)


def _user() -> Column:
    return F.regexp_extract("capture_id", r"user0*(\d+)\.pcap$", 1).cast("long").alias("track_id")


_PACKETS = f"SELECT track_id, i AS packet_idx, t, area, CAST(floor(cx*36000+0.5::DOUBLE) AS BIGINT) % 36000 AS az, min(t) OVER (PARTITION BY track_id) AS start FROM ({SAMPLES})"
_FRAMES = f"SELECT *, CAST(sum(CASE WHEN az+18000<p THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY packet_idx) AS BIGINT) AS frame_idx FROM (SELECT *, lag(az) OVER (PARTITION BY track_id ORDER BY packet_idx) AS p FROM ({_PACKETS}))"


@query("capture_packets", f"SELECT track_id, packet_idx, CAST(az AS INTEGER) AS azimuth, CAST(34 AS INTEGER) AS model, round(t-start,5) AS t FROM ({_PACKETS})")
def capture_packets(spark, sf_dir):
    return captures(spark, sf_dir).select(_user(), "packet_idx", "azimuth", "model", F.round("t", 5).alias("t"))


@query("capture_frames", f"SELECT track_id, frame_idx, count(*)*192 AS points, round(min(t)-min(start),5) AS t, round(min(500+floor(area)%60000)*0.002::DOUBLE,6) AS nearest FROM ({_FRAMES}) GROUP BY ALL")
def capture_frames(spark, sf_dir):
    p = lidar.points(captures(spark, sf_dir))
    way = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    return p.groupBy("capture_id", "frame_idx").agg(F.count("*").alias("points"), F.round(F.min("t"), 5).alias("t"), F.round(F.min(way), 6).alias("nearest")).select(_user(), "frame_idx", "points", "t", "nearest")


@query("capture_points", f"""SELECT track_id, packet_idx, laser, round(d*cos(radians(up))*sin(radians(turn)),6)+0.0::DOUBLE AS x, round(d*cos(radians(up))*cos(radians(turn)),6)+0.0::DOUBLE AS y, round(d*sin(radians(up)),6) AS z
 FROM (SELECT *, (500+floor(area)%60000)*0.002::DOUBLE AS d, (az+10*share)/100.0::DOUBLE AS turn FROM ({_PACKETS}), (VALUES (CAST(0 AS INTEGER), -15.0::DOUBLE, 0.0::DOUBLE), (1, 1.0, 0.53125)) AS l(laser, up, share))""")
def capture_points(spark, sf_dir):
    """Of each packet the first return of laser 0 and the second of laser 1, half a firing later."""
    p = lidar.points(captures(spark, sf_dir)).withColumn("k", F.col("ord") % 384).where("k IN (0, 17)")
    return p.select(_user(), F.floor(F.col("ord") / 384).alias("packet_idx"), "laser", *((F.round(c, 6) + 0.0).alias(c) for c in "xyz"))


def _some_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).withColumn("intensity", F.lit(7)).where("x > -0.05")


_SHOWN = f"SELECT frame_idx, ord, t, laser, printf('%.4f', x) AS xs, printf('%.4f', y) AS ys, printf('%.4f', z) AS zs FROM ({POINTS}) WHERE x>-0.05::DOUBLE"


@query("frame_files", f"SELECT printf('lidar_%06d_%010.3f', frame_idx, t) AS frame, row_number() OVER (PARTITION BY frame_idx ORDER BY ord) AS ord, round(CAST(printf('%.3f', t) AS DOUBLE),3) AS t, xs AS x_text, ys AS y_text, zs AS z_text, CAST(xs AS DOUBLE) AS x FROM ({_SHOWN})")
def frame_files(spark, sf_dir):
    path, p = _folder(spark, "frames"), _some_points(spark, sf_dir)
    frames = points(spark, sf_dir).groupBy("frame_idx").agg(F.min("t").alias("t"))
    exports.write_frame_regions(p, frames, path)
    return tables.read_frames(spark, path).select(F.col("frame_idx").alias("frame"), F.col("ord").cast("long").alias("ord"), "t", "x_text", "y_text", "z_text", "x")


@query("frame_file_checks", f"SELECT printf('lidar_%06d_%010.3f.csv', frame_idx, min(t)) AS name, CAST(NULL AS VARCHAR) AS problem FROM ({POINTS}) GROUP BY frame_idx")
def frame_file_checks(spark, sf_dir):
    path = _folder(spark, "frames")
    exports.write_frame_regions(_some_points(spark, sf_dir), points(spark, sf_dir).groupBy("frame_idx").agg(F.min("t").alias("t")), path)
    return tables.check_frames(spark, path)


@query("event_files", f"SELECT laser AS event, frame_idx AS frame, printf('%.6f', t) AS time_text, xs AS x_text, ys AS y_text, zs AS z_text, row_number() OVER (PARTITION BY laser ORDER BY frame_idx, ord)+1 AS ord FROM ({_SHOWN})")
def event_files(spark, sf_dir):
    path = _folder(spark, "regions")
    exports.write_event_regions(_some_points(spark, sf_dir).withColumn("event_id", F.col("laser")), path)
    rows = tables.read_regions(spark, path)
    return rows.select(F.regexp_extract("file", r"overtaking_(\d+)\.csv$", 1).cast("long").alias("event"), F.col("frame").cast("long").alias("frame"), "time_text", "x_text", "y_text", "z_text", F.col("ord").cast("long").alias("ord"))


@query("trajectory_files", f"SELECT track_id, rn, rn+1 AS row_number, round(t,6) AS t, round(x,6) AS x, round(y,6) AS y, round(distance,6) AS distance, round(speed,6) AS speed FROM ({TRAJECTORY})")
def trajectory_files(spark, sf_dir):
    path = _folder(spark, "trajectories")
    t = trajectory(spark, sf_dir)
    texts = {"name": F.concat(F.lit("overtaking_"), "track_id"), "time_text": F.format_string("%.6f", "t"), "x_text": F.col("x").cast("string"), "y_text": F.col("y").cast("string"), "z_text": F.lit("0")}
    exports.write_trajectories(t.withColumns(texts).withColumn("t", F.col("rn")), path)
    rows = tables.read_trajectories(spark, path)
    track = F.regexp_extract("file", r"overtaking_(\d+)_edit\.csv$", 1).cast("long").alias("track_id")
    return rows.select(track, F.col("rn").cast("long").alias("rn"), F.col("row_number").cast("long").alias("row_number"), *(F.round(c, 6).alias(c) for c in ("t", "x", "y", "distance", "speed")))


@query("event_list_file", f"""SELECT printf('%d', track_id) AS event_id, CASE arg_min(cls, i) WHEN 'click' THEN '軽' ELSE '普通' END AS class, arg_min(cls, i) AS detector_class, printf('%.2f', min(t)-1704067200) AS t_start_s, printf('%.2f', max(t)-1704067200) AS local_t_end_s, '未確認' AS review_status, false AS class_reviewed FROM ({SAMPLES}) GROUP BY track_id""")
def event_list_file(spark, sf_dir):
    path = _folder(spark, "events")
    first, base = F.min_by("cls", "ord"), 1704067200
    e = samples(spark, sf_dir).groupBy("track_id").agg(first.alias("detector_class"), F.min("t").alias("a"), F.max("t").alias("z"))
    times = {"global_t_start": F.col("a") - base, "global_peak_t": F.col("a") - base, "global_t_end": F.col("z") - base, "t_start": F.col("a") - base, "t_end": F.col("z") - base}
    e = e.withColumns({"event_id": F.col("track_id").cast("string"), "vehicle_type": F.when(F.col("detector_class") == "click", "軽").otherwise("普通"), "side": F.lit("left"), "plate_score": F.lit(0.25), "plate_hits": F.lit(2), "source_video": F.lit("v/a.mp4"), **times})
    exports.write_events(e, path)
    rows = tables.read_events(spark, tables.events_path(spark, path))
    return rows.select("event_id", "class", "detector_class", "t_start_s", "local_t_end_s", "review_status", "class_reviewed")


@query("telemetry_files", f"SELECT video, row_number() OVER (PARTITION BY video ORDER BY sample_idx, row_idx) AS line, printf('%.6f', t) AS time_text, v1, v2 FROM ({_ROWS})")
def telemetry_files(spark, sf_dir):
    path = _folder(spark, "telemetry")
    rows = payloads(spark, sf_dir).withColumns({"pts": F.col("sample_idx") * 0.5, "duration": F.lit(0.5), "sample_idx": F.col("sample_idx").cast("long")})
    exports.write_telemetry(telemetry.rows(rows), path)
    lines = tables.lines(spark, f"{path}/*/telemetry_accl.csv").where("ord > 1")
    cell = lambda k: F.col("cells")[k]
    return lines.select(F.element_at(F.split("file", "/"), -2).alias("video"), (F.col("ord") - 1).cast("long").alias("line"), cell(0).alias("time_text"), cell(1).cast("double").alias("v1"), cell(2).cast("double").alias("v2"))


@query("position_books", """SELECT lower(printf('Ride%05d', l_orderkey//20000)) AS video, round(l_orderkey%20000+0.5::DOUBLE,6) AS cts, round(l_partkey/1000.0::DOUBLE,6) AS speed FROM lineitem WHERE l_linenumber=1""")
def position_books(spark, sf_dir):
    path = _folder(spark, "positions")
    one = table(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    vals = F.array(F.lit(35.0), F.lit(139.0), F.lit(5.0), F.col("l_partkey") / 1000.0, F.lit(9.0))
    measured = one.select(
        F.format_string("Ride%05d.mp4", F.floor(F.col("l_orderkey") / 20000)).alias("video"), F.lit("GPS5").alias("key"), F.col("l_orderkey").alias("sample_idx"), F.lit(0).cast("long").alias("stream_idx"), F.lit(0).alias("row_idx"),
        (F.col("l_orderkey") % 20000 + 0.5).alias("t"), vals.alias("vals"), F.lit("260101000000.000").alias("gpsu"), F.lit(3).alias("gpsf"), F.lit(100).alias("gpsp"), F.lit("MSLV").alias("gpsa"),
    )
    exports.write_positions(measured, path)
    return workbooks.gps_speeds(spark, path).select("video", "cts", F.round("speed", 6).alias("speed"))


@query("reviewed_file", f"SELECT CAST(o_orderkey AS VARCHAR) AS event_id, {_STATUS} AS review_status, '軽' AS class, 'car' AS detector_class, printf('%02d:%02d:%02d.000', (o_orderkey % 7000+10)//3600, (o_orderkey % 7000+10)//60%60, (o_orderkey % 7000+10)%60) AS veloview_t_start, false AS lacks_evidence FROM orders WHERE {_STATUS}<>'除外'")
def reviewed_file(spark, sf_dir):
    """The reviewed list beside the detector's: the first is read, without its rejected events."""
    path = _folder(spark, "reviewed")
    second = {c: (F.col("event_id") % 7000).cast("string") for c in ("t_start_s", "peak_t_s", "t_end_s")}
    e = reviews(spark, sf_dir).select(F.col("event_id").cast("string").alias("event_id"), "review_status", F.lit("軽").alias("class"), F.lit("car").alias("detector_class"), *(c.alias(n) for n, c in second.items()))
    exports.write_csv(e.drop("review_status").limit(1), path, F.lit("overtaking_events.csv"), [F.col("event_id")])
    exports.write_reviewed(e, path, 10.0)
    rows = tables.read_events(spark, tables.events_path(spark, path))
    return rows.select("event_id", "review_status", "class", "detector_class", "veloview_t_start", F.lit(tables.lacks_evidence(rows)).alias("lacks_evidence"))


@query("report_book", f"""SELECT row_number() OVER (ORDER BY o_orderkey)+1 AS row, CAST(o_orderkey AS VARCHAR) AS organize_id, CASE o_orderkey % 4 WHEN 1 THEN 'やや危険' WHEN 2 THEN '危険' WHEN 3 THEN '非常に危険' ELSE 'なし' END AS danger,
 CASE WHEN o_orderkey % 3>0 THEN o_orderkey % 50+0.25::DOUBLE END AS own_speed, o_orderkey % 7+0.5::DOUBLE AS passing_time, '軽' AS class FROM orders WHERE {_STATUS}='採用'""")
def report_book(spark, sf_dir):
    """The workbook of all accepted events; what fills its first page stays out."""
    path, k = _folder(spark, "report"), F.col("event_id").cast("long")
    none = {c: F.lit(None).cast("double") for c in ("lc", "distance_p2", "distance_p3", "relative_speed", "ttc")}
    e = reviews(spark, sf_dir).select(F.col("event_id").cast("string").alias("event_id"), "review_status")
    e = e.withColumns({"danger_level": (k % 4).cast("string"), "status": F.lit("ok"), "t3": F.lit(1.0), "passing_time": k % 7 + 0.5, "source_video": F.lit("v/a.mp4"), "local_t_start_s": F.lit("3"), "class": F.lit("軽"), **none})
    speeds = e.where(k % 3 > 0).select("event_id", (k % 50 + 0.25).alias("own_speed"))
    exports.write_report(final.final_rows(e, speeds), path, "all")
    rows = workbooks.read_workbooks(spark, f"{path}/all_final.xlsx").where("row > 1")
    cell = lambda h: F.try_element_at("cells", F.lit(final.HEADERS.index(h) + 1))
    out = rows.select("row", cell("整理ID").alias("organize_id"), cell("危険感").alias("danger"), cell("自転車速度（km/h)").try_cast("double").alias("own_speed"), cell("通過時間").try_cast("double").alias("passing_time"), cell("車種").alias("class"))
    return out.where("organize_id <> ''")


_MARKED = f"SELECT t.track_id, t.rn, CASE WHEN p.p4=t.rn THEN 'フェーズ4' WHEN p.p3=t.rn THEN 'フェーズ3' WHEN p.p2=t.rn THEN 'フェーズ2' WHEN p.p1=t.rn THEN 'フェーズ1' ELSE '' END AS phase FROM ({TRAJECTORY}) t JOIN ({_PHASES}) p USING (track_id) WHERE p2 IS NOT NULL AND p3 IS NOT NULL AND p4 IS NOT NULL"


@query("analysis_books", f"SELECT track_id, rn+1 AS row, phase, CASE rn WHEN 1 THEN '分析指標' WHEN 2 THEN '離隔距離 (LC)' WHEN 3 THEN '通過時間' WHEN 4 THEN '距離p2' WHEN 5 THEN '距離p3' WHEN 6 THEN '相対速度' WHEN 7 THEN 'TTC' ELSE '' END AS mark FROM ({_MARKED})")
def analysis_books(spark, sf_dir):
    path = _folder(spark, "analysis")
    t = trajectory(spark, sf_dir).withColumn("file", F.concat(F.lit("overtaking_"), "track_id", F.lit("_edit.csv")))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    t = t.withColumns({"raw": F.array(*(text(c) for c in ("t", "x", "y")), F.lit("0"), text("distance"), text("speed")), "row_number": F.col("rn") + 1})
    exports.write_analysis(t, P.metrics(t, "file").where("status = 'ok'"), path)
    rows = workbooks.read_workbooks(spark, path).where("row > 1")
    cell = lambda k: F.coalesce(F.try_element_at("cells", F.lit(k)), F.lit(""))
    return rows.select(F.regexp_extract("file", r"overtaking_(\d+)_edit_analysis\.xlsx$", 1).cast("long").alias("track_id"), "row", cell(7).alias("phase"), cell(9).alias("mark"))


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that keeps timers, while a query begins."""
    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _streamed(df: DataFrame, by: Column, parts: int, name: str) -> tuple[DataFrame, Tables]:
    """The rows of a table as a stream, in batches by the remainder of a hash."""
    spark, at = df.sparkSession, Tables(df.sparkSession, name)
    for k in range(parts):
        df.where(F.pmod(by, F.lit(parts)) == k).write.mode("append").parquet(at.path("in"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, df.rdd.getNumPartitions())).parquet(at.path("in")), at


@query("rotations_stream", f"SELECT track_id, i AS packet_idx, CAST(sum(CASE WHEN az+18000<p THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY i) AS BIGINT) AS frame_idx FROM (SELECT *, lag(az) OVER (PARTITION BY track_id ORDER BY i) AS p FROM (SELECT *, floor(cx*36000+0.5::DOUBLE) AS az FROM ({SAMPLES})))")
def rotations_stream(spark, sf_dir):
    """Packets that come in three batches, each with every third of them: early ones wait for the others."""
    s = samples(spark, sf_dir).withColumn("packet_idx", F.row_number().over(Window.partitionBy("track_id").orderBy("ord")) - 1)
    packets = s.select(F.col("track_id").cast("string").alias("capture_id"), F.col("packet_idx").cast("long").alias("packet_idx"), F.floor(F.col("cx") * 36000 + 0.5).alias("azimuth"), F.timestamp_micros("ord.us").alias("event_time"))
    stream, at = _streamed(packets, F.col("packet_idx"), 3, "rotations")
    with _state_store(spark):
        q = live.rotations(stream, "366 days").writeStream.format("parquet").option("path", at.path("out")).option("checkpointLocation", at.path("state")).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(at.path("out")).select(F.col("capture_id").cast("long").alias("track_id"), "packet_idx", "frame_idx")


@query("decisions_stream", "SELECT l_orderkey AS event_id, arg_max(l_returnflag, CAST(l_linenumber AS BIGINT)*1000000000+l_partkey*1000+l_suppkey) AS status, max(CAST(l_linenumber AS BIGINT)*1000000000+l_partkey*1000+l_suppkey) AS seq FROM lineitem GROUP BY 1")
def decisions_stream(spark, sf_dir):
    """Lines as decisions on their orders, in four batches: the last of each order stays."""
    seq = F.col("l_linenumber") * F.lit(1_000_000_000).cast("long") + F.col("l_partkey") * 1000 + F.col("l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_returnflag").alias("status"), seq.alias("seq"))
    stream, at = _streamed(rows, F.xxhash64("seq"), 4, "decisions")
    latest = live.Latest(spark, at.path("table"), ["event_id"], "seq", "event_id long, status string, seq long", every=2)
    stream.writeStream.foreachBatch(latest.apply).option("checkpointLocation", at.path("state")).trigger(availableNow=True).start().awaitTermination()
    return latest.rows()
