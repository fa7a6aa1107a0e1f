"""Files as large as the table, and many small ones: parts of a file, ranges of a sheet, several files a task."""

import io
import random
import zlib
from xml.sax.saxutils import escape
from zipfile import ZipFile

import pytest
from pyspark.sql import functions as F

from tracklane.sources import files, lidar, mp4, named, workbooks

NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def book_of(xml):
    out = io.BytesIO()
    with ZipFile(out, "w") as book:
        book.writestr("s.xml", xml)
    return ZipFile(out)


@pytest.mark.parametrize("prefix", ["", "x:"])
@pytest.mark.parametrize("numbered", [True, False])
def test_any_range_of_a_sheet(monkeypatch, prefix, numbered):
    """Each row is one range's, whatever looks like a row in comments and CDATA."""
    monkeypatch.setattr(workbooks, "_READ", 700)
    rng, rows = random.Random(5), []
    for k in range(200):
        cells = "".join(f'<{prefix}c t="inlineStr"><{prefix}is><{prefix}t>{escape(rng.choice(["a<row>", "é&", "", "]]>"]))}</{prefix}t></{prefix}is></{prefix}c>' for _ in range(rng.randrange(4)))
        odd = rng.choice(["", "", "<!-- <row r='9'> -->", f"<{prefix}c><{prefix}v><![CDATA[<row r='7'>]]></{prefix}v></{prefix}c>"])
        number = f' r="{3 * k + 1}"' if numbered else ""
        rows.append(f"<{prefix}row{number}>{cells}{odd if 'CDATA' in odd else ''}</{prefix}row>{odd if 'CDATA' not in odd else ''}")
    head = f'<{prefix}worksheet xmlns{":x" if prefix else ""}="{NS}"><{prefix}sheetData>'
    book = book_of(f"{head}{''.join(rows)}</{prefix}sheetData></{prefix}worksheet>")
    size = book.getinfo("s.xml").file_size
    whole = [r for some in workbooks.sheet_rows(book, "s.xml") for r in some]
    assert [r[0] for r in whole] == [3 * k + 1 if numbered else k + 1 for k in range(200)] and any("<row r='7'>" in r[1] for r in whole)
    for step in (1000, 1777, 9999):
        ends = [*range(0, size, step), float("inf")]
        assert [r for a, b in zip(ends, ends[1:], strict=False) for some in workbooks.sheet_rows(book, "s.xml", a, b) for r in some] == whole


def test_joined_crc():
    a, b = random.Random(1).randbytes(1000), random.Random(2).randbytes(77_777)
    assert workbooks.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b) and workbooks.joined_crc(zlib.crc32(a), 0, 0) == zlib.crc32(a)


def test_large_workbook(spark, tmp_path):
    """A workbook that several tasks write and read: whole, in order, a sound archive."""
    rows = spark.range(20_000, numPartitions=7).select(
        F.lit("w.xlsx").alias("name"), (20_000 - F.col("id")).alias("number"), F.array(workbooks.cell(F.concat(F.lit("<&>"), "id"), "text"), workbooks.cell(F.col("id") / 4, "number", 2)).alias("cells")
    )
    with named_ranges(spark, 5):
        workbooks.write_large_workbooks(rows, str(tmp_path), "S", {"formats": ["0.00"]})
    with ZipFile(tmp_path / "w.xlsx") as book:
        assert book.testzip() is None
    reader = workbooks._XlsxReader({"path": str(tmp_path), "split": "200000"})
    parts = [p for p in reader.partitions() if p.value]
    got = [(r["row"], r["cells"]) for p in parts for batch in reader.read(p) for r in batch.to_pylist()]
    assert len(parts) > 3 and got == [(n, [f"<&>{20_000 - n}", str(int(k)) if (k := (20_000 - n) / 4).is_integer() else repr(k)]) for n in range(1, 20_001)]


class named_ranges:
    """Shuffles of so many partitions that stay apart."""

    def __init__(self, spark, n):
        self.spark, self.given = spark, {"spark.sql.shuffle.partitions": n, "spark.sql.adaptive.coalescePartitions.enabled": "false"}

    def __enter__(self):
        self.before = {k: self.spark.conf.get(k) for k in self.given}
        for k, v in self.given.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_):
        for k, v in self.before.items():
            self.spark.conf.set(k, v)


def test_large_csv(spark, tmp_path, monkeypatch):
    """One file that several tasks write; the one that puts it together gets a row a part."""
    seen = []
    write_files = named.write_files
    monkeypatch.setattr(named, "write_files", lambda rows, *more, **options: (seen.append(rows.count()), write_files(rows, *more, **options)))
    rows = spark.range(5000, numPartitions=9).select((F.col("id") * 7919 % 5000).alias("n"), F.lit("x,y").alias('a,"b'))
    with named_ranges(spark, 6):
        named.write_csv(rows, str(tmp_path), F.lit("f.csv"), [F.col("n")])
    assert (tmp_path / "f.csv").read_text("utf-8-sig").splitlines() == ['n,"a,""b"', *(f'{k},"x,y"' for k in range(5000))]
    assert 3 <= seen[0] <= 6 and not list(tmp_path.rglob("*.part"))


def test_many_files_are_few_tasks(tmp_path):
    parts = [(f"f{k}", 0, None) for k in range(5000)]
    tasks = files.dealt(parts, [1000] * 5000)
    assert [p for t in tasks for p in t] == parts and len(tasks) <= files.TASKS + 1
    assert len(files.dealt(parts, [1 << 20] * 5000)) < 60 * 1.2 and len(files.dealt(parts[:64], [1] * 64)) == 64
    assert files.joined([("a", 0, 5, 1), ("a", 5, None, 3), ("b", 0, 4, 0)]) == [("a", 0, None, 1), ("b", 0, 4, 0)]
    for k in range(300):
        (tmp_path / f"{k}.pcap").write_bytes(b"")
        (tmp_path / f"{k}.mp4").write_bytes(b"")
        (tmp_path / f"{k}.xlsx").write_bytes(b"")
    at = {"path": str(tmp_path)}
    for reader in (lidar._Reader(at, []), lidar._SpanReader(at), mp4._Reader(at, [], 1 << 15), workbooks._XlsxReader(at)):
        assert len(reader.partitions()) < 2 * files.TASKS and sum(len(p.value) for p in reader.partitions()) == 300


def test_many_names_are_not_the_drivers(tmp_path):
    """A task's message to the driver is as long for many files as for few; lists and attempts go."""
    import pickle

    import pyarrow as pa

    sizes = []
    for n in (1, 3000):
        writer = named._BytesWriter({"path": str(tmp_path / str(n))})
        rows = pa.record_batch([pa.array([f"{k // 1000}/é{k:05d}\n.bin" for k in range(n)]), pa.array([b"%d" % k for k in range(n)])], ["name", "data"])
        messages = [writer.write(iter([rows])), writer.write(iter([])), None]
        sizes.append(len(pickle.dumps(messages)))
        writer.commit(messages)
        got = {p.name: p.read_bytes() for p in (tmp_path / str(n)).rglob("*") if p.is_file()}
        assert got == {f"é{k:05d}\n.bin": b"%d" % k for k in range(n)}
    assert abs(sizes[0] - sizes[1]) < 10
    writer = named._BytesWriter({"path": str(tmp_path / "gone")})
    writer.abort([writer.write(iter([rows]))])
    assert not [p for p in (tmp_path / "gone").rglob("*") if p.is_file()]


def test_a_folder_is_listed_by_tasks(spark, tmp_path, monkeypatch):
    """Captures of many folders, with false chains and long records: as each by itself, and no list of them at the driver."""
    from test_ranges import record, whole
    from test_sources import packet

    rng, head = random.Random(8), bytes.fromhex("d4c3b2a1" + "02000400" + "00" * 8 + "ffff0000" + "01000000")
    for k in range(70):
        (tmp_path / f"d{k // 9}" / "e").mkdir(parents=True, exist_ok=True)
        records = [record(9, b"none")] + [record(50 + j / 7, rng.choice([packet(j * 900), b"".join(record(j + i, packet(i)) for i in range(4)), bytes(5000) + packet(j)])) for j in range(1 + k % 7 * 3)]
        (tmp_path / f"d{k // 9}" / rng.choice(["", "e"]) / f"c{k}.PCAP").write_bytes(head + b"".join(records))
        (tmp_path / f"d{k // 9}" / f"c{k}.txt").write_text("no capture")
    want = sorted(row for p in tmp_path.rglob("*.PCAP") for row in whole(p))
    monkeypatch.setattr(lidar, "files", None)
    for split in (None, 1500, 20_000):
        got = lidar.read_packets(spark, str(tmp_path), split=split)
        assert got.rdd.getNumPartitions() == files.TASKS
        assert sorted(map(tuple, got.collect())) == want
    assert lidar.read_packets(spark, str(tmp_path / "d0"), payload=False, split=20_000).select("capture_id").distinct().count() == 9
    (tmp_path / "none").mkdir()
    assert lidar.read_packets(spark, str(tmp_path / "none")).isEmpty()


def test_packets_and_frames_are_not_sent_to_all_tasks(spark, tmp_path):
    """Few packed bytes may be very many packets: what has a row a packet or a frame is joined by a shuffle."""
    import re

    from test_ranges import record
    from test_sources import packet

    head = bytes.fromhex("d4c3b2a1" + "02000400" + "00" * 8 + "ffff0000" + "01000000")
    (tmp_path / "a.pcap").write_bytes(head + b"".join(record(50 + j / 8, packet(j * 9000 % 36000)) for j in range(40)))
    for path in (tmp_path, tmp_path / "a.pcap"):
        found = lidar.frames(lidar.read_packets(spark, str(path)))
        plan = found._jdf.queryExecution().executedPlan().toString()
        joins = re.findall(r"(\w+Join) \[capture_id#\d+, (\w+)#", plan)
        assert sorted(set(joins)) == [("SortMergeJoin", "frame_idx"), ("SortMergeJoin", "packet_idx")]
        assert [(r.packet_idx, r.frame_idx) for r in found.orderBy("packet_idx").collect()] == [(j, j // 4) for j in range(40)]
