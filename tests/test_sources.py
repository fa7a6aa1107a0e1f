import random
import struct

import pytest
from pyspark.sql import functions as F

from tracklane.operators import phases as P
from tracklane.operators import points as L
from tracklane.operators import tracks as K
from tracklane.sources import exports, lidar, tables
from tracklane.streaming import live


def packet(base):
    blocks = (struct.pack("<HH", 0xEEFF, (base + 10 * b) % 36000) + struct.pack("<HB", 5000, 80) * 32 for b in range(12))
    return b"".join(blocks) + bytes(4) + b"\x37\x22"


def capture(path, order="<"):
    head = struct.pack(f"{order}IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    rest = (struct.pack(f"{order}4I", 100, us, 1206, 1206) + packet(a) for us, a in ((0, 35000), (100_000, 100), (200_000, 300)))
    path.write_bytes(head + struct.pack(f"{order}4I", 100, 0, 3, 3) + b"abc" + b"".join(rest))


@pytest.mark.parametrize("order", "<>")
def test_capture(spark, tmp_path, order):
    capture(tmp_path / "a.pcap", order)
    packets = lidar.read_packets(spark, str(tmp_path))
    rows = lidar.points(packets)
    got = {r.frame_idx: r for r in rows.groupBy("frame_idx").agg(F.count("*").alias("n"), F.min("t").alias("t"), F.min(F.expr("sqrt(x*x+y*y+z*z)")).alias("lo"), F.max("laser").alias("laser")).collect()}
    assert {k: r.n for k, r in got.items()} == {0: 384, 1: 768}
    assert got[0].t == 0 and abs(got[1].t - 0.1) < 1e-6 and abs(got[1].lo - 10) < 1e-9 and got[1].laser == 15
    assert packets.select(lidar.model_name(F.col("model")).alias("m")).distinct().collect() == [("VLP-16",)]
    frames = rows.groupBy("frame_idx").agg(F.min("t").alias("t"))
    exports.write_frame_regions(L.roi(rows, (-100, 100), (-100, 100)).where(L.frame_range(1, 5)), frames, str(tmp_path / "roi"))
    assert sorted(p.name for p in (tmp_path / "roi").iterdir()) == ["lidar_000000_000000.000.csv", "lidar_000001_000000.100.csv"]
    one = (tmp_path / "roi" / "lidar_000001_000000.100.csv").read_bytes().decode("utf-8-sig").split("\r\n")
    assert one[0] == ",".join(exports.REGION_COLUMNS) and len(one) == 770
    assert (tmp_path / "roi" / "lidar_000000_000000.000.csv").read_bytes().startswith(b"\xef\xbb\xbfFrame,")
    exports.write_event_regions(rows.where("frame_idx < 2").withColumn("event_id", F.lit("a/1")), str(tmp_path / "event"))
    back = tables.read_regions(spark, str(tmp_path / "event" / "overtaking_a_1.csv"))
    assert back.count() == 1152 and back.groupBy("frame").count().count() == 2
    groups = L.frame_groups(back)
    near = L.nearest_points(groups, ["file", "frame"], ("x_text", "y_text"))
    assert [(r.frame, r.t) for r in near.orderBy("t").collect()] == [("0", 0.0), ("1", 0.1)]


def test_broken_capture(spark, tmp_path):
    (tmp_path / "b.pcap").write_bytes(b"\x0a\x0d\x0d\x0a" + bytes(30))
    with pytest.raises(Exception, match="not a classic packet capture"):
        lidar.read_packets(spark, str(tmp_path / "b.pcap")).collect()


def test_events(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("﻿event_id,class,detector_class,side\n001,軽,car,left\n", "utf-8")
    (tmp_path / "done.csv").write_text("event_id,class,class_reviewed,review_status,side\n001,普通,True,採用,left\n", "utf-8")
    pick = ("event_id", "class", "review_status", "class_reviewed", "danger_level")
    assert tables.read_events(spark, str(tmp_path / "raw.csv")).select(*pick).collect() == [("001", "軽", "未確認", False, "0")]
    assert tables.read_events(spark, str(tmp_path / "done.csv")).select(*pick).collect() == [("001", "普通", "採用", True, "0")]


def test_trajectory_file(spark, tmp_path):
    lines = ["0,-0.5,8,0,8.02,", "1,-1.0,7,0,7.10,12", "2,-1.5,6,0,6.20,8", "3,-2.0,5,0,5.40,7", "4,-2.5,2.5,0,3.54,14", "5,-1.0,3.2,0,3.35,16", "x,1,1,1,1,1", "6,1"]
    (tmp_path / "a_edit.csv").write_text("unixtime,X,Y,Z,distance(m),speed(km/h)\n" + "\n".join(lines) + "\n")
    rows = tables.read_trajectories(spark, str(tmp_path / "a_edit.csv"))
    assert [r.row_number for r in rows.orderBy("rn").collect()] == [2, 3, 4, 5, 6, 7]
    m = P.metrics(rows, "file").first()
    assert (m.p1 + 1, m.p2 + 1, m.p3 + 1, m.p4 + 1, m.lc, m.passing_time, m.distance_p2) == (2, 5, 6, 7, 2.5, 1.0, 5.0)
    assert abs(m.relative_speed - 2.52) < 1e-9 and abs(m.ttc - 7.142857) < 1e-6


def test_frame_folder(spark, tmp_path):
    head, lead = "intensity,laser_id,azimuth,distance_m,adjustedtime,timestamp,vertical_angle,ids,Points:0,Points:1,Points:2\n", "0,0,0,0,0,0,0,0,"
    for name, rows in (("10.0", ["3,4,0.1", "30,40,0.2"]), ("11.0", ["6,8,0.3"]), ("overtaking_001_edit", ["0,0,0"]), ("notes", ["0,0,0"])):
        (tmp_path / f"{name}.csv").write_text(head + "".join(f"{lead}{r}\n" for r in rows))
    frames = L.nearest_points(tables.read_frames(spark, str(tmp_path)), ["capture_id", "frame_idx"])
    got = L.trajectory_speed(frames, ["capture_id"]).orderBy("t").select("t", "x", "y", "distance", "speed").collect()
    assert [tuple(r) for r in got] == [(10.0, 3.0, 4.0, 5.0, None), (11.0, 6.0, 8.0, 10.0, 18.0)]


def test_passing_events_of_a_stream(spark, tmp_path):
    """The events of tracks as they end are those of the whole table."""
    rng = random.Random(8)
    rows = []
    for k in range(40):
        n = rng.randint(3, 30)
        x, y, size = rng.uniform(0.6, 1), rng.uniform(0.4, 0.9), rng.uniform(0.01, 0.1)
        for i in range(n):
            far = i / max(1, n - 1)
            rows.append((1, k, i, 10 * k + i, 100.0 * k + 0.1 * i, x - far * rng.uniform(0.1, 0.5), y - far * 0.2, size * (1 - 0.6 * far) + rng.uniform(0, 0.02), rng.choice(["car", "truck", "bus"]), None if k % 2 else y, rng.random(), rng.random(), rng.choice([None, 0.5, 3.0])))
    schema = "video_id int, track_id int, ord int, frame int, t double, cx double, cy double, area double, cls string, bottom_y double, confidence double, plate_score double, flow double"
    table = spark.createDataFrame(rows, schema).withColumn("event_time", F.timestamp_seconds("t"))
    table.orderBy("t").coalesce(1).write.option("maxRecordsPerFile", 60).parquet(str(tmp_path / "in"))
    rules = K.TrackRules(appear_edge=0.6, exit_edge=0.2, close_min_road=0.2)
    pick = ("track_id", "n", "cx_start", "area_end", "peak_i", "close_pass", "vehicle_type", "detector_class", "plate_hits")
    want = sorted(tuple(r) for r in K.classify(table, None, rules).select(*pick).collect())
    assert sorted(tuple(r) for r in live.passing_tracks(table, "5 seconds", rules=rules).select(*pick).collect()) == want and 3 < len(want) < 40
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = live.passing_tracks(stream, "5 seconds", rules=rules).select(*pick).writeStream.format("memory").queryName("passing").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    got = sorted(tuple(r) for r in spark.table("passing").collect())
    assert set(got) <= set(want) and len(got) >= len(want) - 1  # the last track has not ended


def test_streams(spark, tmp_path):
    data = [(1, t, (t * 7) % 11 + (36000 - t * 3000 % 36000)) for t in range(40)]
    rows = spark.createDataFrame([(1, a % 2, float(b), a) for a, b, _ in data for a in (b,)], "video_id long, track_id long, t double, ord long")
    rows = rows.withColumns({"event_time": F.timestamp_seconds("t"), "cx": F.col("t") / 40, "area": F.pmod(F.col("t") * 7, F.lit(11.0))})
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    batch = live.track_sessions(spark.read.parquet(str(tmp_path / "in")), "3 seconds").drop("session")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.track_sessions(stream, "3 seconds", "1 hour").drop("session").writeStream.format("memory").queryName("sessions").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert sorted(spark.table("sessions").collect()) == sorted(batch.collect()) and batch.count() == 2
