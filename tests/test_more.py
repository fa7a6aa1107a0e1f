"""Texts of numbers against Python's own, boxes that follow vehicles against a plain version, and single rules of the other operators."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from tracklane.functions import text as T
from tracklane.operators import boxes as B
from tracklane.operators import detection as D
from tracklane.operators import review as R
from tracklane.operators import timeline as W


def test_numbers_as_python_writes_them(spark):
    rng = random.Random(1)
    values = [0.0, 1.0, -2.5, 1e15, 1e14, 123456789012345678.0, 1e-4, 1e-5, 9.9999999999999995, 0.1 + 0.2, 2.675, 1.005, -1.115, 0.125, 0.375, 5e-324, 1.7e308, 1e22, 1e23]
    values += [struct.unpack("d", rng.randbytes(8))[0] for _ in range(300)] + [rng.randrange(10**7) / 1000 + 0.0005 for _ in range(500)] + [rng.uniform(-1000, 1000) for _ in range(500)]
    values = [v for v in values if math.isfinite(v)]
    v = F.col("v")
    got = spark.createDataFrame([(x,) for x in values], "v double").select("v", T.general(v), T.general(v, 8), T.round_exact(v, 2), T.round_exact(v, 6)).collect()
    near = [r for r in got if 1e-8 < abs(r.v) < 1e15]
    assert [(r.v, r[1]) for r in near if r[1] != format(r.v, ".15g")] == []
    assert sum(r[1] != format(r.v, ".15g") for r in got) <= 0.1 * len(got)  # halves at far exponents
    assert [(r.v, r[2]) for r in near if r[2] != format(r.v, ".8g")] == []
    assert [(r.v, r[3]) for r in got if r[3] != round(r.v, 2)] == []
    assert [(r.v, r[4]) for r in got if r[4] != round(r.v, 6)] == []
    odd = spark.createDataFrame([(float("nan"),), (float("-inf"),), (None,)], "v double").select(T.general(v)).collect()
    assert [r[0] for r in odd] == ["nan", "-inf", None]


@pytest.mark.parametrize(("text", "want"), [("1.23456789", 1.23456789), ("1:2", 62.0), ("01:00:00.5", 3600.5), ("1:2:3:4", None), ("-1", None), ("1:-2", None), ("a:1", None), (" 5 ", 5.0), ("", 0.0), (None, None)])
def test_times(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.parse_time(F.col("t"))).first()[0] == want


def plain_clusters(points):
    """Groups of points by flooding cells, in order of their first points."""
    cell = lambda p: (math.floor(p[0] / B.CELL), math.floor(p[1] / B.CELL))
    left, out = list(points), []
    while left:
        group, edge = [], {cell(left[0])}
        while edge:
            reach = {(x + a, y + b) for x, y in edge for a in (-1, 0, 1) for b in (-1, 0, 1)}
            more = [p for p in left if cell(p) in reach]
            left = [p for p in left if cell(p) not in reach]
            group += more
            edge = {cell(p) for p in more}
        out.append(group)
    return out


def plain_follow(frames, box):
    """(found, points, box) frame by frame."""
    x0, x1, y0, y1 = box
    vx = vy = 0.0
    out = []
    for points in frames:
        hx, hy, cx, cy = (x1 - x0) / 2, (y1 - y0) / 2, (x0 + x1) / 2, (y0 + y1) / 2
        near = [p for p in points if abs(p[0] - cx - vx) <= hx + 1.2 + abs(vx) and abs(p[1] - cy - vy) <= hy + 1.2 + abs(vy)]
        groups = [g for g in plain_clusters(near) if len(g) >= 8] if len(near) >= 8 else []
        if groups:
            centre = lambda g: (sum(p[0] for p in g) / len(g), sum(p[1] for p in g) / len(g))
            best = min(groups, key=lambda g: math.hypot(centre(g)[0] - cx - vx, centre(g)[1] - cy - vy))
            vx, vy = centre(best)[0] - cx, centre(best)[1] - cy
            if (far := math.hypot(vx, vy)) > 6:
                vx, vy = vx * 6 / far, vy * 6 / far
            x0, x1, y0, y1 = cx + vx - hx, cx + vx + hx, cy + vy - hy, cy + vy + hy
        out.append((bool(groups), len(best) if groups else 0, *(round(c, 6) for c in (x0, x1, y0, y1))))
    return out


def test_boxes(spark):
    """A vehicle beside a bicycle that comes near, is lost for two frames, leaps once, and another event with lasers of its own."""
    rng = random.Random(6)
    rows, frames = [], []
    for f in range(1, 41):
        x = 5 - 0.5 * f + (9 if f > 30 else 0)
        car = [(x + rng.uniform(-0.8, 0.8), 2 + rng.uniform(-0.5, 0.5)) for _ in range(60 if f not in (12, 13) else 5)]
        bike = [(rng.uniform(-0.2, 0.2) + 0.1 * f - 3, 3.9 + rng.uniform(-0.2, 0.2)) for _ in range(20)]
        noise = [(rng.uniform(-30, 30), rng.uniform(-30, 30)) for _ in range(80)]
        points = car + bike + noise
        frames.append(points)
        rows += [("c", f, k, px, py, k % 4) for k, (px, py) in enumerate(points)]
    rows.append(("c", 41, 0, None, None, 1))
    starts = [("a", "c", 0, 41, 3.5, 6.0, 1.2, 2.8, None), ("b", "c", 0, 30, 3.5, 6.0, 1.2, 2.8, [1, 3]), ("none", "c", 0, 3, 90.0, 91.0, 90.0, 91.0, [])]
    start_schema = "event_id string, capture_id string, first_frame long, last_frame long, min_x double, max_x double, min_y double, max_y double, lasers array<int>"
    points = spark.createDataFrame(rows, "capture_id string, frame_idx long, ord long, x double, y double, laser int").repartition(5)
    got = {}
    for r in B.follow_boxes(points, spark.createDataFrame(starts, start_schema)).orderBy("frame_idx").collect():
        got.setdefault(r.event_id, []).append((r.found, r.n_points, *(round(c, 6) for c in (r.min_x, r.max_x, r.min_y, r.max_y))))
    box = (3.5, 6.0, 1.2, 2.8)
    assert got["a"] == plain_follow([*frames, []], box) and 25 < sum(f for f, *_ in got["a"]) < 41
    assert got["b"] == plain_follow([[p for k, p in enumerate(points) if k % 4 in (1, 3)] for points in frames[:30]], box)
    assert got["none"] == [(False, 0, 90.0, 91.0, 90.0, 91.0)] * 3


def test_plates_and_flow(spark):
    sizes = [(6, 4, 18.0), (5, 4, 18.0), (6, 2, 10.0), (40, 20, 800.0), (40, 10, 390.0), (22, 20, 440.0), (40, 20, 4900.0)]
    rows = spark.createDataFrame([(k, float(w), float(h), a, 250.0, 160.0) for k, (w, h, a) in enumerate(sizes)] + [(9, 40.0, 20.0, 800.0, 39.0, 160.0)], "k int, bw double, bh double, area double, vw double, vh double")
    got = {r.k: round(r.plate_score, 6) for r in D.plate_scores(rows, ["k"]).collect()}
    assert got == {0: round(0.5 * 0.75 + 0.3 * 18 / 40000 / 0.004 + 0.2 * 0.75, 6) if 18 / 40000 >= 0.0003 else 0.0, 1: 0.0, 2: 0.0, 3: 1.0, 4: 0.0, 5: 0.0, 6: 0.0, 9: 0.0}
    flow = [(1, 1, 3.0, 4.0, 1, 1, 0.5)] * 10 + [(1, 1, 90.0, 0.0, 1, 0, 0.5)] * 30 + [(1, 2, 3.0, 4.0, 1, 1, 0.5)] * 9 + [(1, 2, 3.0, 4.0, 1, 1, 1.0)] * 9
    got = D.frame_flow(spark.createDataFrame(flow, "video_id int, frame int, dx double, dy double, st1 int, st2 int, error double")).orderBy("frame").collect()
    assert [r.flow for r in got] == [5.0, 0.0]


def test_track_samples(spark):
    boxes = spark.createDataFrame([(1, 5, 30, 2, 0.9, 10.0, 20.0, 30.0, 60.0, 0.1), (1, None, 30, 2, 0.9, 1.0, 1.0, 2.0, 2.0, 0.0), (1, 5, 60, 3, 0.9, 1.0, 1.0, 2.0, 2.0, 0.0)], "video_id int, track_id int, frame int, cls_id int, score double, x1 double, y1 double, x2 double, y2 double, plate_score double")
    of = spark.createDataFrame([(1, 0, None, 100, 200, 300)], "video_id int, ord int, fps double, w int, h int, total_frames int")
    got = D.track_samples(boxes, of).collect()
    assert [(r.track_id, r.cls, r.t, r.cx, r.cy, round(r.area, 9), r.bottom_y) for r in got] == [(5, "car", 1.0, 0.2, 0.2, 0.04, 0.3)]
    assert D.videos(of).first().duration == 10.0


def test_long_frames(spark):
    """What was once recomputed for each row: one key with many rows."""
    n = 60_000
    left = spark.range(n).select(F.lit(1).alias("k"), "id", (F.col("id") * 3.0).alias("t"))
    right = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 3.0 + 1.5).alias("rt"), F.col("id").alias("v"))
    out = W.nearest(left, right, ["k"], "t", "rt", "v")
    assert out.where("nearest_v = greatest(id - 1, 0)").count() == n  # ties go to the earlier one
    reviews = spark.range(n).select(F.lit(1).alias("k"), "id", F.when(F.col("id") % 10 == 0, "未確認").otherwise("採用").alias("review_status"))
    assert R.next_open(reviews, ["k"], "id").where(f"next_open = (floor(id / 10) * 10 + 10) % {n}").count() == n


def test_long_intervals(spark):
    """However long an interval is, it costs two rows; ends in any order and without samples."""
    samples = spark.range(100_000).select(F.lit("v").alias("k"), (F.col("id") * 0.5).alias("t"), (F.col("id") % 10).cast("double").alias("x"))
    spans = spark.createDataFrame([(1, "v", -1e12, 1e12), (2, "v", 10.0, 5.0), (3, "v", 0.1, 0.2), (4, "w", 0.0, 9.0), (5, "v", 49999.5, 1e9)], "interval_id int, k string, a double, b double")
    got = {r.interval_id: (r.mean, r.n) for r in W.range_average(spans, samples, ["k"], "a", "b", "t", "x").collect()}
    inside = [i % 10 for i in range(10, 21)]
    assert got == {1: (4.5, 100_000), 2: (sum(inside) / 11, 11), 3: (None, 0), 4: (None, 0), 5: (9.0, 1)}
