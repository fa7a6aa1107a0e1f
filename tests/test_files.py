"""Videos' telemetry, workbooks, reports and named files, on files made here."""

import json
import struct
import xml.etree.ElementTree as ET
from datetime import UTC, date, datetime
from zipfile import ZipFile

import pytest
from pyspark.sql import functions as F

from tracklane.functions import text as T
from tracklane.operators import final
from tracklane.operators import phases as P
from tracklane.operators import points as L
from tracklane.operators import timeline as W
from tracklane.sources import exports, mp4, tables, telemetry, workbooks


def box(kind, body, wide=False):
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body if wide else struct.pack(">I4s", len(body) + 8, kind) + body


def entry(key, kind, size, n, data):
    return key.encode() + struct.pack(">cBH", kind, size, n) + data + bytes(-len(data) % 4)


def numbers(key, letter, form, rows):
    data = b"".join(struct.pack(f">{len(r)}{form}", *r) for r in rows)
    return entry(key, letter, len(data) // len(rows), len(rows), data)


def container(key, body):
    return entry(key, b"\0", 1, len(body), body)


def positions(k, n):
    """A sample's positions: speed 10 k + i m/s in millimetres."""
    rows = [(351000000 + k, 1390000000 + i, 5000, (10 * k + i) * 1000, 900) for i in range(n)]
    about = entry("STNM", b"c", 3, 1, b"GPS") + entry("GPSU", b"U", 16, 1, f"2607010203{4 + k:02d}.500".encode()) + numbers("GPSF", b"L", "I", [(3,)]) + numbers("GPSP", b"S", "H", [(141,)])
    scal = numbers("SCAL", b"l", "i", [(10000000,), (10000000,), (1000,), (1000,), (100,)])
    return container("STRM", about + scal + numbers("GPS5", b"l", "i", rows))


def payload(k):
    turns = container("STRM", numbers("SCAL", b"s", "h", [(0,)]) + entry("SIUN", b"c", 5, 1, b"rad/s") + numbers("GYRO", b"s", "h", [(k, -1, 2), (3, 4, 5)]))
    texts = container("STRM", entry("NOTE", b"c", 4, 1, b"text") + entry("ODDY", b"?", 4, 1, bytes(4)))
    return container("DEVC", entry("DVNM", b"c", 3, 1, b"cam") + positions(k, 4 if k else 1) + turns + texts)


def video(path, samples, wide=False, fixed=None, kind=b"gpmd"):
    """An MP4 with two samples in each chunk but the last, a data box before the movie box."""
    data, offsets, chunks = b"", [], []
    for k, s in enumerate(samples):
        if k % 2 == 0:
            data += b"gap"
            chunks.append(len(data))
        offsets.append(len(data))
        data += s
    base = len(box(b"ftyp", b"isom")) + (16 if wide else 8)
    table = lambda name, n, body: box(name, bytes(4) + struct.pack(">I", n) + body)
    chunk = (b"co64", ">Q") if wide else (b"stco", ">I")
    sizes = box(b"stsz", bytes(4) + struct.pack(">II", fixed or 0, len(samples)) + (b"" if fixed else b"".join(struct.pack(">I", len(s)) for s in samples)))
    runs = [(1, 2, 1)] + ([(len(chunks), 1, 1)] if len(samples) % 2 else [])
    stbl = box(b"stsd", bytes(4) + struct.pack(">I", 1) + box(kind, bytes(8))) + table(b"stts", 2, struct.pack(">4I", 2, 1001, len(samples) - 2, 500)) + table(b"stsc", len(runs), b"".join(struct.pack(">3I", *r) for r in runs))
    stbl += sizes + table(chunk[0], len(chunks), b"".join(struct.pack(chunk[1], base + c) for c in chunks))
    clock = bytes([1]) + bytes(19) + struct.pack(">I", 1000) + bytes(8) if wide else bytes(12) + struct.pack(">I", 1000) + bytes(8)
    other = box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", box(b"stsd", bytes(4) + struct.pack(">I", 1) + box(b"avc1", bytes(8)))))))
    moov = other + box(b"trak", box(b"mdia", box(b"mdhd", clock) + box(b"minf", box(b"stbl", stbl))))
    path.write_bytes(box(b"ftyp", b"isom") + box(b"mdat", data, wide) + box(b"moov", moov))


@pytest.fixture(scope="module")
def clips(tmp_path_factory):
    folder = tmp_path_factory.mktemp("clips")
    video(folder / "A1.mp4", [payload(k) for k in range(5)])
    video(folder / "b2.MP4", [payload(k) for k in range(4)], wide=True)
    return folder


def test_samples(spark, clips):
    found = {(r.video.rsplit("/", 1)[1], r.sample_idx): r for r in mp4.read_samples(spark, str(clips)).collect()}
    assert sorted(found) == [("A1.mp4", k) for k in range(5)] + [("b2.MP4", k) for k in range(4)]
    for (_, k), r in found.items():
        assert bytes(r.payload) == payload(k)
        assert (r.pts, r.duration) == ((1.001 * k, 1.001) if k < 2 else (2.002 + 0.5 * (k - 2), 0.5))


def test_equal_sizes_and_broken_files(spark, tmp_path):
    same = [bytes([k]) * 12 for k in range(4)]
    video(tmp_path / "same.mp4", same, fixed=12)
    assert [bytes(r.payload) for r in mp4.read_samples(spark, str(tmp_path / "same.mp4")).orderBy("sample_idx").collect()] == same
    video(tmp_path / "none.mp4", same, kind=b"mp4a")
    (tmp_path / "cut.mp4").write_bytes((tmp_path / "same.mp4").read_bytes()[:60])
    for name, why in (("none", "no metadata track"), ("cut", "no movie box")):
        with pytest.raises(Exception, match=f"{name}.mp4: {why}"):
            mp4.read_samples(spark, str(tmp_path / f"{name}.mp4")).collect()


def test_measurements(spark, clips):
    rows = telemetry.rows(mp4.read_samples(spark, str(clips / "A1.mp4")))
    gps = rows.where("key = 'GPS5'").orderBy(*telemetry.ORDER).collect()
    assert len(gps) == 1 + 4 * 4 and {r.key for r in rows.select("key").distinct().collect()} == {"GPS5", "GYRO"}
    assert gps[0].t == 1.001 / 2 and gps[0].vals == [35.1, 139.0, 5.0, 0.0, 9.0] and (gps[0].name, gps[0].gpsf, gps[0].gpsp) == ("GPS", 3, 141)
    assert [round(r.t, 6) for r in gps[1:5]] == [round(1.001 + (i + 0.5) / 4 * 1.001, 6) for i in range(4)]
    assert [r.vals[3] for r in gps[5:9]] == [20.0, 21.0, 22.0, 23.0]
    turns = telemetry.named(rows, "GYRO", 4).orderBy(*telemetry.ORDER).collect()
    assert tuple(turns[2])[-4:] == (1.0, -1.0, 2.0, None) and list(turns[0].asDict())[-4:] == ["gx_rads", "gy_rads", "gz_rads", "col3"]  # zero scales by nothing


def test_clocks(spark, clips):
    texts = ["260701020304.500", "260701020304", "691231235959.25", "261301000000", "26070102030", "junk", None, "260701020360.0", "260701020304.5000000"]
    rows = spark.createDataFrame([(t,) for t in texts], "g string").select(telemetry.clock_text(F.col("g")), telemetry.clock_seconds(F.col("g"))).collect()
    assert [r[0] for r in rows] == ["2026-07-01 02:03:04.500", "2026-07-01 02:03:04.000", "1969-12-31 23:59:59.250", "261301000000", "26070102030", "junk", "", "260701020360.0", "260701020304.5000000"]
    at = datetime(2026, 7, 1, 2, 3, 4, tzinfo=UTC).timestamp()
    assert [r[1] for r in rows] == [at + 0.5, at, datetime(2069, 12, 31, 23, 59, 59, tzinfo=UTC).timestamp() + 0.25, None, None, None, None, None, at + 0.5]
    starts = {r.video.rsplit("/", 1)[1]: r for r in telemetry.video_starts(mp4.read_samples(spark, str(clips))).collect()}
    estimates = sorted(at + k + 0.5 - (1.001 * k if k < 2 else 2.002 + 0.5 * (k - 2)) for k in range(5))
    near = [e for e in estimates if abs(e - estimates[2]) <= 0.5]
    assert abs(starts["A1.mp4"].start_unix - sum(near) / len(near)) < 1e-6 and starts["A1.mp4"].estimates == 5
    assert spark.range(1).select(telemetry.clock_offset(F.lit(10.12345), F.lit(4.0))).first()[0] == 6.123


def test_telemetry_files(spark, clips, tmp_path):
    rows = telemetry.rows(mp4.read_samples(spark, str(clips)))
    exports.write_telemetry(rows, str(tmp_path))
    lines = (tmp_path / "A1" / "telemetry_gyro.csv").read_bytes().decode().split("\r\n")
    assert lines[:3] == ["time_s,gx_rads,gy_rads,gz_rads", "0.250250,0,-1,2", "0.750750,3,4,5"] and len(lines) == 12
    assert (tmp_path / "A1" / "telemetry_gps.csv").read_text().splitlines()[1] == "0.500500,35.1,139,5,0,9"
    exports.write_positions(rows, str(tmp_path / "gps"))
    with ZipFile(tmp_path / "gps" / "A1" / "telemetry_gps.xlsx") as book:
        assert book.testzip() is None and {"[Content_Types].xml", "_rels/.rels", "xl/workbook.xml", "xl/worksheets/sheet2.xml"} <= set(book.namelist())
        for name in book.namelist():
            ET.fromstring(book.read(name))
    seconds = [r.cells for r in workbooks.read_workbooks(spark, str(tmp_path / "gps" / "A1" / "telemetry_gps.xlsx")).orderBy("row").collect()]
    assert seconds[0] == list(exports.gps_headers("k/s")) and [float(r[5]) for r in seconds[1:]] == [0.0, 0.01, 0.02, 0.04]
    assert seconds[1][1] == "2026-07-01 02:03:04.500" and seconds[1][7:9] == ["3", "141"]
    speeds = workbooks.gps_speeds(spark, str(tmp_path / "gps"))
    assert sorted(map(tuple, speeds.where("video = 'a1'").collect())) == sorted(("a1", round(r.t, 6), r.vals[3]) for r in rows.where("key = 'GPS5' AND video LIKE '%A1.mp4'").collect())


def test_foreign_workbook(spark, tmp_path):
    """Shared strings, gaps between cells, one sheet, a column found by its header, values in km/s."""
    sheet = (
        '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="B1" t="s"><v>1</v></c><c r="AA1" t="inlineStr"><is><t>x</t></is></c><c r="C1" t="s"><v>0</v></c></row>'
        '<row r="3"><c r="B3"><v>1.5</v></c><c r="C3"><v>0.002</v></c></row><row r="4"><c r="B4"><v>2</v></c></row></sheetData></worksheet>'
    )
    strings = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><r><t>GPS (2D speed)</t></r><r><t> [k/s]</t></r></si><si><t>cts</t></si></sst>'
    (tmp_path / "Ride").mkdir()
    with ZipFile(tmp_path / "Ride" / "telemetry_gps.xlsx", "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", sheet)
        book.writestr("xl/sharedStrings.xml", strings)
    assert workbooks.gps_speeds(spark, str(tmp_path)).collect() == [("ride", 1.5, 2.0)]
    assert [workbooks.letters(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"] and all(workbooks.place(workbooks.letters(k) + "7") == k for k in range(800))


EVENTS = "event_id,class,review_status,danger_level,source_video,t_start_s,peak_t_s,t_end_s,local_t_start_s,note\n"


def test_report(spark, tmp_path):
    """From files to the workbook: trajectories by name, speeds by video and time, order, blanks, formats."""
    (tmp_path / "reviewed_overtaking_events.csv").write_text(
        "﻿" + EVENTS + "010,普通,採用,2,v/Ride.One.mp4,103,105,108,3,\nx,軽,,9,v/none.mp4,5,6,7,5,\n2,大型,採用,,v/ride.one.mp4,50,51,52,50,b\n3,大型,除外,1,v/ride.one.mp4,1,2,3,1,b\n", "utf-8"
    )
    lines = ["0,-0.5,8,0,8.02,", "1,-1.0,7,0,7.10,12", "2,-1.5,6,0,6.20,8", "3,-2.0,5,0,5.40,7", "4,-2.5,2.5,0,3.54,14", "5,-1.0,3.2,0,3.35,16"]
    for name, body in (("overtaking_010_edit.csv", lines), ("overtaking_2_edit.csv", lines[:3])):
        (tmp_path / name).write_text("﻿unixtime,X,Y,Z,distance(m),speed(km/h)\n" + "\n".join(body) + "\n", "utf-8")
    events = spark.read.csv(tables.events_path(spark, str(tmp_path)), header=True)  # as it stands: a blank status counts as accepted
    points = tables.read_trajectories(spark, f"{tmp_path}/overtaking_*_edit.csv")
    metrics = P.metrics(points, "file").withColumn("name", T.stem_name(F.col("file"))).drop("file")
    of = final.with_metrics(events, metrics)
    speeds = spark.createDataFrame([("ride.one", t / 2, 5.0 + t) for t in range(20)], "video string, cts double, speed double")
    spans = final.speed_intervals(of, -100.0)
    assert [tuple(r) for r in spans.collect()] == [("010", "ride.one", 4.0, 5.0)]
    mean = W.range_average(spans, speeds, ["video"], "lo", "hi", "cts", "speed").select(F.col("interval_id").alias("event_id"), (F.col("mean") * 3.6).alias("own_speed"))
    rows = final.final_rows(of, mean, "", "S1", date(2026, 7, 1), "lidar/a.pcap", 1_782_871_200.0)
    got = [r.asDict() for r in rows.orderBy("place").collect()]
    assert [r["整理ID"] for r in got] == ["2", "010", "x"] and [r["warning"] for r in got] == ["no phase 3", "", "no trajectory"]
    one = got[1]
    assert [one[h] for h in final.HEADERS[1:12]] == [46204, "S1", 2.5, 50.4, 52.92, "危険", 1.0, 5.0, 0.7, 2.52, 7.14]
    assert [one[h] for h in final.HEADERS[12:]] == ["Ride.One", 3 / 86400, "a.pcap", ((1_782_871_204 + 9 * 3600) % 86400) / 86400, 1_782_871_204.0, "普通"]
    assert all(got[0][h] is None for h in final.HEADERS[3:6] + final.HEADERS[7:12]) and got[2]["危険感"] == "なし"
    assert final.filled(final.padded(rows)).first().rows == 3
    exports.write_report(rows, str(tmp_path / "final"), "260701_1")
    sheet = [r.cells for r in workbooks.read_workbooks(spark, str(tmp_path / "final" / "260701_1_final.xlsx")).orderBy("row").collect()]
    assert len(sheet) == 51 and sheet[0] == list(final.HEADERS) and sheet[2][3:6] == ["2.5", "50.4", "52.92"] and not any(sheet[50])
    with ZipFile(tmp_path / "final" / "260701_1_final.xlsx") as book:
        raw = book.read("xl/worksheets/sheet1.xml").decode()
        assert 's="2"><v>46204</v>' in raw and 'sqref="R2:R51"' in raw and 'state="frozen"' in raw
    exports.write_analysis(points, P.metrics(points, "file").where("status = 'ok'"), str(tmp_path / "analysis"))
    sheet = [r.cells for r in workbooks.read_workbooks(spark, str(tmp_path / "analysis" / "overtaking_010_edit_analysis.xlsx")).orderBy("row").collect()]
    assert sheet[0][:7] == [*exports.TRAJECTORY_COLUMNS, "フェーズ区分"] and [r[6] for r in sheet[1:]] == ["フェーズ1", "", "", "フェーズ2", "フェーズ3", "フェーズ4"]
    assert sheet[1][8:] == ["分析指標", "計算値（数式）", "単位"] and sheet[2][8:] == ["離隔距離 (LC)", "2.5", "m"] and len(sheet) == 7
    exports.write_reviewed(events.withColumn("clip_url", F.lit("u")), str(tmp_path / "again"), 0.5)
    lines = (tmp_path / "again" / "reviewed_overtaking_events.csv").read_bytes().decode("utf-8-sig").split("\r\n")
    assert "clip_url" not in lines[0] and lines[0].endswith("veloview_t_start,veloview_peak_t,veloview_t_end")
    assert [line.split(",")[0] for line in lines[1:4]] == ["2", "010", "x"] and lines[2].endswith("00:01:43.500,00:01:45.500,00:01:48.500") and lines[4:] == [""]
    with pytest.raises(ValueError, match="not rejected"):
        exports.write_reviewed(events.where("event_id = '3'"), str(tmp_path / "none"), 0.0)


def test_trajectory_files(spark, tmp_path):
    """From a region file to a trajectory file: numbers as they stood, quirks of frames without points and of equal times."""
    head = "Time,Frame,Points:0,Points:1,Points:2\n"
    body = ["bad,1,9,9,9", "10.50,1,3,4,0.10", "bad,1,0.3,0.40,0.2", "11,2,x,1,1", "12,3,6.0,8,1", "12,4,0,5,1", "9.5,5,1e1,0,z", "13,6"]
    (tmp_path / "overtaking_7.csv").write_text("﻿" + head + "\n".join(body) + "\n", "utf-8")
    rows = L.frame_groups(tables.read_regions(spark, str(tmp_path / "overtaking_7.csv")))
    frames = L.trajectory_speed(L.nearest_points(rows, ["file", "frame"], ("x_text", "y_text", "z_text")).withColumn("frame_idx", F.col("frame")), ["file"])
    texts = rows.groupBy("file", "frame").agg(F.min_by("time_text", "ord").alias("time_text"))
    frames = frames.join(texts, ["file", "frame"]).withColumn("name", T.stem(F.col("file")))
    exports.write_trajectories(frames, str(tmp_path / "out"))
    lines = (tmp_path / "out" / "overtaking_7_edit.csv").read_bytes().decode("utf-8-sig").split("\r\n")
    assert lines[:3] == ["unixtime,X,Y,Z,distance(m),speed(km/h)", "9.5,1e1,0,z,10,", f"10.50,0.3,0.40,0.2,0.5,{format(((9.7**2 + 0.16) ** 0.5) / 1 * 3600 / 1000, '.15g')}"]
    assert lines[3:] == ["11,,,,,", "12,6.0,8,1,10,36", "12,0,5,1,5,", ""]
    with pytest.raises(ValueError, match="no frames"):
        exports.write_trajectories(frames.limit(0), str(tmp_path / "none"))


def test_named_files(spark, tmp_path):
    from tracklane.sources import named

    rows = spark.createDataFrame([("b", 2, 'say "hi", all'), ("a", 1, None), ("b", 1, "two\nlines")], "who string, n int, text string")
    named.write_csv(rows.repartition(3), str(tmp_path / "x"), F.concat("who", F.lit("/f.csv")), [F.col("n")], bom=False)
    assert (tmp_path / "x" / "b" / "f.csv").read_bytes() == b'who,n,text\r\nb,1,"two\nlines"\r\nb,2,"say ""hi"", all"\r\n'
    assert (tmp_path / "x" / "a" / "f.csv").read_bytes() == b"who,n,text\r\na,1,\r\n" and not list(tmp_path.rglob("*.part"))


def test_checks(spark, tmp_path):
    good = ",".join(f"c{k}" for k in range(8)) + ",Points:0,points:1\n"
    for name, text in (("b.csv", good), ("A.csv", "a,b\n1,2\n"), ("c.csv", good.replace("Points:0", "x"))):
        (tmp_path / name).write_text("﻿" + text, "utf-8")
    assert [(r.name, r.problem) for r in tables.check_frames(spark, str(tmp_path)).collect()] == [("A.csv", "fewer than 10 columns"), ("b.csv", None), ("c.csv", "columns 9 and 10 are no points")]
    with pytest.raises(FileNotFoundError):
        tables.events_path(spark, str(tmp_path))
    (tmp_path / "overtaking_events.csv").write_text("event_id,class\n1,car\n")
    raw = tables.read_events(spark, tables.events_path(spark, str(tmp_path)))
    plain = spark.read.csv(str(tmp_path / "overtaking_events.csv"), header=True)
    assert tables.lacks_evidence(plain) and not tables.lacks_evidence(plain.withColumn("review_status", F.lit("")))
    assert not tables.lacks_evidence(plain.withColumns({c: F.lit(1) for c in tables.EVIDENCE})) and raw.count() == 1
    (tmp_path / "clips").mkdir()
    (tmp_path / "clips" / "event_1_left.mp4").write_bytes(b"x")
    assert [r.name for r in tables.clip_files(spark, str(tmp_path / "clips")).collect()] == ["event_1_left.mp4"]
    assert json.loads(json.dumps(final.LAYOUT))["widths"][0] == [1, 1, 10]


def test_frame_files_come_back(spark, tmp_path):
    """Names with numbers in them, short rows, and what write_frame_regions writes."""
    head = ",".join(f"c{k}" for k in range(11)) + "\n"
    row = lambda x, more="": "0,0,0,0,0,0,0,0," + f"{x},2,3{more}\n"
    for name in ("lidar_000001_000000.020.csv", "frame_12.5.csv", "1779258541.02.csv", "none.csv", "run1_edit.csv", "overtaking_3.csv"):
        (tmp_path / name).write_text("﻿" + head + row("1.50") + "0,0,0,0,0,0,0,0,0.5,2\n" + row("x") + row('"7"', ",more,cells") + "\n", "utf-8")
    got = tables.read_frames(spark, str(tmp_path)).orderBy("t", "ord").collect()
    assert [(r.frame_idx, r.t) for r in got if r.ord == 1] == [("lidar_000001_000000.020", 0.02), ("frame_12.5", 12.5), ("1779258541.02", 1779258541.02)]
    assert [(r.x, r.x_text, r.z) for r in got[:3]] == [(1.5, "1.50", 3.0), (None, "x", 3.0), (7.0, "7", 3.0)] and len(got) == 9


def test_rounding_of_fixed_formats(spark):
    values = [0.125, 2.675, 0.375, 1e12 + 0.125, -0.125, 2.5, 1.005]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(exports._fixed("v", 2), exports._fixed("v", 0)).collect()
    assert [tuple(r) for r in got] == [(f"{v:.2f}", f"{v:.0f}") for v in values]


def test_payload_table_function(spark, clips):
    telemetry.register_functions(spark)
    samples = mp4.read_samples(spark, str(clips))
    one = spark.sql("SELECT video, sample_idx, m.* FROM {s}, LATERAL gpmf_rows(payload, pts, duration) m", s=samples)
    want = telemetry.rows(samples).select(one.columns)
    assert sorted(map(repr, one.collect())) == sorted(map(repr, want.collect()))
    gps = spark.sql("SELECT video, sample_idx, m.* FROM {s}, LATERAL gpmf_rows(payload, pts, duration, 'GPS5') m", s=samples)
    named = telemetry.named(telemetry.rows(samples), "GPS5", 5)
    assert sorted(map(repr, gps.select(named.columns).collect())) == sorted(map(repr, named.collect()))
    assert gps.columns[-5:] == list(telemetry.COLUMNS["GPS5"])
    assert spark.sql("SELECT m.* FROM (SELECT CAST(NULL AS BINARY) p), LATERAL gpmf_rows(p, 0D, 1D) m").isEmpty()
    with pytest.raises(Exception, match="the key is a constant text"):
        spark.sql("SELECT m.* FROM {s}, LATERAL gpmf_rows(payload, pts, duration, video) m", s=samples).collect()
