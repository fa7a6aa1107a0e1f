"""Streams with state of their own: disorder, gaps, restarts and repeated batches."""

import random
import struct
import time

import pytest
from pyspark.sql import functions as F
from test_ranges import record
from test_sources import packet

from tracklane.operators import boxes
from tracklane.operators import timeline as W
from tracklane.sources import lidar
from tracklane.streaming import live

STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(STORE, before)


def run(df, name, folder, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return df.sparkSession.table(name).collect()


def as_stream(df, parts, folder):
    """A stream of the rows of each part, a batch a part."""
    for part in parts:
        df.where(part).coalesce(1).write.mode("append").parquet(str(folder))
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_rotations_in_any_order(spark, tmp_path):
    """Packets come in any order within the delay, one twice, one never."""
    rng = random.Random(2)
    order = sorted((k for k in range(60) if k != 31), key=lambda k: k + rng.uniform(0, 8))
    rows = [("a", k, k * 5000 % 36000, 100.0 + k, n // 12) for n, k in enumerate(order)] + [("a", 20, 20 * 5000 % 36000, 120.0, 3), ("a", 1000, 0, 1100.0, 6)]
    df = spark.createDataFrame(rows, "capture_id string, packet_idx long, azimuth int, t double, part int").withColumn("event_time", F.timestamp_seconds("t"))
    stream = as_stream(df, [f"part = {k}" for k in range(7)], tmp_path / "in")
    got = run(live.rotations(stream, "15 seconds"), "turns", tmp_path / "c")
    want = W.rotation_frames(df.where("packet_idx < 1000").dropDuplicates(["packet_idx"]), ["capture_id"], "packet_idx", "azimuth")
    assert {r.packet_idx: r.frame_idx for r in got} == {r.packet_idx: r.frame_id for r in want.collect()} and len(got) == 59


def test_boxes_on_a_stream(spark, tmp_path):
    """The rows of the batch tracker: a vehicle that moves, is hidden and comes back, frames out of order."""
    rng = random.Random(7)
    points = []
    for f in range(1, 25):
        if f not in (9, 10):
            points += [("c", f, i, 5 + 0.3 * f + rng.uniform(-0.5, 0.5), 2 + rng.uniform(-0.4, 0.4), i % 4) for i in range(30)]
        points += [("c", f, 100 + i, 40 + rng.uniform(-1, 1), 30.0, 1) for i in range(9)]
    df = spark.createDataFrame(points, "capture_id string, frame_idx long, ord long, x double, y double, laser int").withColumn("event_time", F.timestamp_seconds("frame_idx"))
    starts = spark.createDataFrame([("e1", "c", 1, 20, 4.0, 7.0, 1.0, 3.0, None), ("e2", "c", 3, 20, 5.0, 7.0, 1.0, 3.0, [0, 1, 3])], "event_id string, capture_id string, first_frame long, last_frame long, min_x double, max_x double, min_y double, max_y double, lasers array<int>")
    want = boxes.follow_boxes(df, starts).collect()
    # frames and points of a batch come mixed; a far frame at the end lets the watermark pass
    end = spark.createDataFrame([("c", 999, 1, None, None, None, 5000)], "capture_id string, frame_idx long, ord long, x double, y double, laser int, s long").select("capture_id", "frame_idx", "ord", "x", "y", "laser", F.timestamp_seconds("s").alias("event_time"))
    whole = df.withColumn("part", F.pmod(F.xxhash64("ord"), F.lit(2)) + 2 * F.floor(F.col("frame_idx") / 5)).unionByName(end.withColumn("part", F.lit(20).cast("long")))
    stream = as_stream(whole, [f"part = {k}" for k in (1, 0, 3, 2, 5, 4, 7, 6, 9, 8, 20)], tmp_path / "in").drop("part")
    got = run(live.follow_boxes(stream, starts, "30 seconds"), "boxes", tmp_path / "c")
    assert sorted(map(repr, want)) == sorted(map(repr, got)) and len(want) == 19 + 17
    assert {r.found for r in want} == {True, False}


def test_growing_captures(spark, tmp_path):
    """A capture grows between runs, is cut within a record, and is read on from the checkpoint."""
    folder = tmp_path / "captures"
    folder.mkdir()
    head = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    data = head + b"".join(record(100 + k / 8, b"other" if k % 7 == 3 else bytes(42) + packet(k * 300 % 36000)) for k in range(120))
    other = head + b"".join(record(50 + k, packet(k)) for k in range(5))
    seen = []

    def collect(batch, number):
        seen.append(batch.select("capture_id", "packet_idx", "t", "unix_start", "azimuth", "model", "payload").collect())

    for size, rest in ((10, None), (60_000, 30), (60_001, None), (len(data), len(other))):
        (folder / "a.pcap").write_bytes(data[:size])
        if rest:
            (folder / "b.pcap").write_bytes(other[:rest])
        q = lidar.stream_packets(spark, str(folder), 20_000).writeStream.foreachBatch(collect).option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        if size == 10:  # a file that is begun while the query runs: batches of their own size
            (folder / "a.pcap").write_bytes(data[:50_000])
            end = time.time() + 60
            while sum(map(len, seen)) < 39 and time.time() < end:
                time.sleep(0.5)
        q.stop()
    want = lidar.read_packets(spark, str(folder)).collect()
    assert [len(b) for b in seen[:4]] == [0, 16, 16, 7] and len(seen) >= 6
    assert sorted(tuple(r) for b in seen for r in b) == sorted(map(tuple, want))


def test_a_batch_that_comes_twice(spark, tmp_path):
    schema = "event_id long, status string, seq long"
    table = live.Latest(spark, str(tmp_path / "t"), ["event_id"], "seq", schema, every=3)
    assert table.rows().isEmpty()
    rng, want = random.Random(1), {}
    for k in range(8):
        rows = [(rng.randrange(20), f"s{k}.{i}", 100 * k + i) for i in range(15)]
        batch = spark.createDataFrame([(*r, "more") for r in rows], schema + ", other string")
        for _ in range(1 + k % 3):
            table.apply(batch, k)
        for e, s, n in rows:
            want[e] = (e, s, n)
        assert sorted(map(tuple, table.rows().collect())) == sorted(want.values())
    table.apply(batch, 7)
    assert sorted(map(tuple, table.rows().collect())) == sorted(want.values())
    assert table._folders("snapshot") == [2, 5]


def test_decisions_as_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(k % 5, f"s{k}", k) for k in range(40)], "event_id long, status string, seq long")
    stream = as_stream(rows, [f"seq % 4 = {k}" for k in range(4)], tmp_path / "in")
    table = live.Latest(spark, str(tmp_path / "t"), ["event_id"], "seq", "event_id long, status string, seq long", every=2)
    q = stream.writeStream.foreachBatch(table.apply).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(map(tuple, table.rows().collect())) == [(e, f"s{35 + e}", 35 + e) for e in range(5)]
