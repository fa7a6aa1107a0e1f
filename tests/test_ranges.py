"""Captures and videos dealt by ranges of bytes, filters and columns that go to the reader."""

import random
import struct

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from test_files import payload, video
from test_sources import packet

from tracklane.sources import lidar, mp4, telemetry


def record(t, data, order="<"):
    return struct.pack(f"{order}4I", int(t), int(t % 1 * 1e6), len(data), len(data)) + data


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """A capture with other packets, a record of many ranges, and records that hold whole captures."""
    rng, path = random.Random(4), tmp_path_factory.mktemp("odd") / "odd.pcap"
    head = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    out = [record(99, b"no packet")]
    for k in range(60):
        kind = rng.random()
        if kind < 0.6:
            data = rng.randbytes(42) + packet(k * 700 % 36000) + rng.randbytes(rng.randrange(3))
        elif kind < 0.75:  # records within a record: a long false chain
            data = b"".join(record(50 + j, packet(j)) for j in range(rng.randrange(1, 12)))
        elif kind < 0.85:
            data = bytes(rng.randrange(1, 3000))
        elif kind < 0.95:
            data = b"\xff\xee" * rng.randrange(1, 900)
        else:
            data = rng.randbytes(rng.randrange(20_000))
        out.append(record(100 + k / 10, data))
    path.write_bytes(head + b"".join(out))
    return path


def whole(path):
    reader = lidar._Reader({"path": str(path)}, [c.split()[0] for c in lidar.PACKETS.split(", ")])
    return [row for part in reader.partitions() for row in reader.read(part)]


def resolved(monkeypatch, path, split):
    """spans() without Spark jobs."""
    rounds = 0

    class Frame:
        def __init__(self, options):
            self.options = options

        def collect(self):
            nonlocal rounds
            rounds += 1
            from pyspark.sql import Row

            r = lidar._SpanReader(self.options)
            names = [c.split()[0] for c in lidar._LidarSpans({}).schema().split(", ")]
            return [Row(**dict(zip(names, row, strict=True))) for part in r.partitions() for row in r.read(part)]

    class Spark:
        read = property(lambda self: self)
        given = {}

        def format(self, name):
            return self

        def options(self, **o):
            self.given = o
            return self

        def load(self, path):
            return Frame({**self.given, "path": path})

    monkeypatch.setattr(lidar, "register", lambda spark, source: None)
    return lidar.spans(Spark(), str(path), split), rounds


@pytest.mark.parametrize("split", [24, 25, 100, 1203, 1222, 5000, 9999, 40_000])
def test_any_range(monkeypatch, odd, split):
    import json

    spans, _ = resolved(monkeypatch, odd, split)
    reader = lidar._Reader({"path": str(odd), "spans": json.dumps(spans)}, [c.split()[0] for c in lidar.PACKETS.split(", ")])
    assert [row for part in reader.partitions() for row in reader.read(part)] == whole(odd)


def test_false_chains_are_found_out(monkeypatch, odd):
    _, rounds = resolved(monkeypatch, odd, 1500)
    assert rounds > 1


@pytest.mark.parametrize("order", "<>")
def test_long_capture(spark, tmp_path, order):
    head = struct.pack(f"{order}IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    (tmp_path / "a.pcap").write_bytes(head + b"".join(record(100 + k / 100, bytes(42) + packet(k * 300 % 36000), order) for k in range(400)))
    (tmp_path / "b.pcap").write_bytes(head + record(7, packet(5), order))
    one, many = lidar.read_packets(spark, str(tmp_path)), lidar.read_packets(spark, str(tmp_path), split=50_000)
    assert many.rdd.getNumPartitions() > 9 and one.rdd.getNumPartitions() == 2
    key = ["capture_id", "packet_idx"]
    assert many.orderBy(*key).collect() == one.orderBy(*key).collect()
    bare = lidar.read_packets(spark, str(tmp_path), payload=False, split=50_000)
    assert bare.columns == one.drop("payload").columns and bare.count() == 401
    (tmp_path / "b.pcap").write_bytes((tmp_path / "a.pcap").read_bytes()[:-5])
    with pytest.raises(Exception, match="b.pcap: cut off in a record"):
        lidar.read_packets(spark, str(tmp_path), split=50_000).collect()


class Counted:
    """A file that counts what is read."""

    read_bytes = 0

    def __init__(self, file):
        self.file = file

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def __getattr__(self, name):
        return getattr(self.file, name)

    def read(self, n=-1):
        data = self.file.read(n)
        Counted.read_bytes += len(data)
        return data


def read_of(path, columns, filters=(), **options):
    Counted.read_bytes = 0
    reader = mp4._Reader({"path": str(path), **options}, columns, mp4.SPLIT)
    reader.open = lambda name, open_=reader.open: Counted(open_(name))
    rest = list(reader.pushFilters(list(filters)))
    return [row for part in reader.partitions() for row in reader.read(part)], Counted.read_bytes, rest


def test_bytes_of_the_first_samples(tmp_path):
    samples = [bytes([k % 251]) * 10_000 for k in range(300)]
    video(tmp_path / "v.mp4", samples)
    every, whole_bytes, _ = read_of(tmp_path / "v.mp4", ["sample_idx", "payload"])
    first, bytes_, rest = read_of(tmp_path / "v.mp4", ["sample_idx", "payload"], [ds.LessThan(("sample_idx",), 60), ds.EqualTo(("video",), "x"), ds.IsNotNull(("pts",))])
    assert first == every[:60] and len(rest) == 2
    assert whole_bytes > 300 * 10_000 and 60 * 10_000 <= bytes_ < 60 * 10_000 + 10_000
    bare, bytes_, _ = read_of(tmp_path / "v.mp4", ["size", "sample_idx"])
    assert [b[0] for b in bare] == [10_000] * 300 and bytes_ < 10_000
    late, _, _ = read_of(tmp_path / "v.mp4", ["sample_idx"], [ds.GreaterThanOrEqual(("pts",), 2.002), ds.LessThanOrEqual(("sample_idx",), 4), ds.GreaterThan(("size",), 9.5)])
    assert late == [(2,), (3,), (4,)]


def test_the_filter_reaches_the_reader(spark, tmp_path, capsys):
    video(tmp_path / "v.mp4", [payload(k) for k in range(80)])
    starts = telemetry.video_starts(mp4.read_samples(spark, str(tmp_path)))
    starts.explain("formatted")
    assert "PushedFilters: [LessThan(sample_idx,60)]" in capsys.readouterr().out
    assert starts.first().estimates == telemetry.ESTIMATES
    assert mp4.read_samples(spark, str(tmp_path)).where("sample_idx < 7 AND video LIKE '%v.mp4' AND payload IS NOT NULL").count() == 7


def test_one_video_is_many_tasks(spark, tmp_path):
    video(tmp_path / "v.mp4", [payload(k) for k in range(200)], wide=True)
    one, many = mp4.read_samples(spark, str(tmp_path)), mp4.read_samples(spark, str(tmp_path), split=5000)
    assert one.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() > 8
    assert many.orderBy("sample_idx").collect() == one.orderBy("sample_idx").collect()
    assert many.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 5
    assert mp4.read_samples(spark, str(tmp_path), payload=False, split=5000).agg(F.sum("size")).first()[0] == sum(len(payload(k)) for k in range(200))
