"""Each rule of the track operators just inside and just outside its threshold.

A track holds still in its first and its last quarter, so that the medians there are the given values.
"""

import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tracklane.operators import tracks as K

SCHEMA = "video_id int, track_id int, ord int, frame int, t double, cx double, cy double, area double, cls string, bottom_y double, confidence double, plate_score double"
N = 20
BARE = K.TrackRules(stop_filter=False, trajectory_filter=False, area_filter=False)
SHAPE = replace(BARE, trajectory_filter=True, area_filter=True)


def slope(start, end, n=N):
    q = max(1, n // 4)
    step = lambda i: min(1.0, max(0.0, (i - q + 1) / (n - 2 * q + 1)))
    return [start + (end - start) * step(i) for i in range(n)]


def rows(track_id=7, n=N, seconds=2.0, cx=(0.8, 0.5), cy=(0.5, 0.5), area=(0.02, 0.02), cls="car", bottom=None, confidence=0.8, plate=0.0):
    spread = lambda v: slope(*v, n) if isinstance(v, tuple) else list(v) if isinstance(v, list) else [v] * n
    columns = [spread(v) for v in (cx, cy, area, cls, bottom, confidence, plate)]
    return [(3, track_id, i, 40 + 2 * i, seconds * i / (n - 1), x, y, a, c, b, k, p) for i, (x, y, a, c, b, k, p) in enumerate(zip(*columns, strict=True))]


def peaked(height, at, start=0.02, end=0.02, n=N):
    out = slope(start, end, n)
    out[at] = height
    return out


def kept(spark, cases, motion=None):
    """Which of the (rules, track) cases pass, in one job for each set of rules."""
    by_rules = {}
    for k, (rules, track) in enumerate(cases):
        by_rules.setdefault(rules, []).extend((r[0], k, *r[2:]) for r in track)
    found = {}
    for rules, data in by_rules.items():
        out = K.classify(spark.createDataFrame(data, SCHEMA), motion, rules)
        found |= {r.track_id: r for r in out.collect()}
    return found


CASES = {
    "enough samples": (BARE, rows(n=5), True),
    "too few samples": (BARE, rows(n=4), False),
    "long enough": (BARE, rows(seconds=0.6), True),
    "too short": (BARE, rows(seconds=0.59), False),
    "appears at the edge": (BARE, rows(cx=(0.70, 0.5)), True),
    "appears too far in": (BARE, rows(cx=(0.69, 0.5)), False),
    "ends before the exit": (BARE, rows(cx=(0.8, 0.41)), True),
    "ends at the exit": (BARE, rows(cx=(0.8, 0.40)), False),
    "moves outward": (BARE, rows(cx=(0.8, 0.9)), False),
    "rear, ends at the edge": (replace(BARE, view="rear"), rows(cx=(0.5, 0.30)), True),
    "rear, ends too far in": (replace(BARE, view="rear"), rows(cx=(0.5, 0.32)), False),
    "rear, starts before the exit": (replace(BARE, view="rear"), rows(cx=(0.59, 0.2)), True),
    "rear, starts at the exit": (replace(BARE, view="rear"), rows(cx=(0.61, 0.2)), False),
    "rises enough": (SHAPE, rows(cy=(0.54, 0.5), area=(0.04, 0.02)), True),
    "rises too little": (SHAPE, rows(cy=(0.52, 0.5), area=(0.04, 0.02)), False),
    "rises by its lower edge": (SHAPE, rows(bottom=(0.66, 0.6), area=(0.04, 0.02)), True),
    "moves too flat": (SHAPE, rows(cx=(0.95, 0.5), cy=(0.55, 0.5), area=(0.04, 0.02)), False),
    "rear, sinks enough": (replace(SHAPE, view="rear"), rows(cx=(0.5, 0.2), cy=(0.5, 0.55), area=(0.02, 0.04)), True),
    "rear, rises": (replace(SHAPE, view="rear"), rows(cx=(0.5, 0.2), cy=(0.55, 0.5), area=(0.02, 0.04)), False),
    "shrinks enough": (SHAPE, rows(cy=(0.6, 0.5), area=(0.0231, 0.02)), True),
    "shrinks too little": (SHAPE, rows(cy=(0.6, 0.5), area=(0.0229, 0.02)), False),
    "rear, grows too little": (replace(SHAPE, view="rear"), rows(cx=(0.5, 0.2), cy=(0.5, 0.6), area=(0.02, 0.0229)), False),
    "peaks low in the middle": (SHAPE, rows(cy=(0.6, 0.5), area=peaked(0.070, 10, 0.04)), True),
    "peaks high in the middle": (SHAPE, rows(cy=(0.6, 0.5), area=peaked(0.073, 10, 0.04)), False),
    "peaks high at the end of the middle": (SHAPE, rows(cy=(0.6, 0.5), area=peaked(0.073, 16, 0.04)), False),
    "peaks high behind the middle": (SHAPE, rows(cy=(0.6, 0.5), area=peaked(0.073, 17, 0.04)), True),
    "on the road": (replace(BARE, road_roi=True), rows(cy=0.95), True),
    "beside the road": (replace(BARE, road_roi=True), rows(cx=(0.8, 0.6), cy=0.45), False),
}


def test_rules(spark):
    found = kept(spark, [c[:2] for c in CASES.values()])
    assert {name: k in found for k, name in enumerate(CASES)} == {name: want for name, (_, _, want) in CASES.items()}
    sides = {found[k].side for k, (name, c) in enumerate(CASES.items()) if c[2] and name.startswith("rear")}, {found[k].side for k, (name, c) in enumerate(CASES.items()) if c[2] and not name.startswith("rear")}
    assert sides == ({"right"}, {"left"})


def near_pass(peak=0.09, at=6, peak_x=0.56, end_x=0.46, end_area=0.045, cy=0.9):
    """Not an ordinary path: it begins at 0.6 and grows and shrinks again."""
    x = slope(0.6, end_x)
    x[at] = peak_x
    return rows(cx=x, cy=cy, area=peaked(peak, at, 0.01, end_area))


RESCUES = {
    "all at their limits": (near_pass(), True),
    "peak too small": (near_pass(peak=0.079, end_area=0.03), False),
    "shrinks too little": (near_pass(end_area=0.051), False),
    "peak too far in": (near_pass(peak_x=0.549, end_x=0.4), False),
    "too little way after the peak": (near_pass(end_x=0.49), False),
    "three samples before the peak": (near_pass(at=3), True),
    "two samples before the peak": (near_pass(at=2), False),
    "three samples after the peak": (near_pass(at=16), True),
    "two samples after the peak": (near_pass(at=17), False),
    "near the road's side": (near_pass(peak_x=0.68, end_x=0.59), True),
    "off the road": (near_pass(peak_x=0.68, end_x=0.59, cy=0.43), False),
}


def test_close_passes(spark):
    found = kept(spark, [(SHAPE, track) for track, _ in RESCUES.values()])
    assert {name: k in found for k, name in enumerate(RESCUES)} == {name: want for name, (_, want) in RESCUES.items()}
    assert all(r.close_pass and math.isclose(r.area_change_ratio, 2.0) for r in found.values())


@pytest.mark.parametrize(("flows", "passes"), [((0.9, 0.8, 0.1), True), ((0.79, 0.79, 9.0), False), ((), True)])
def test_own_motion(spark, flows, passes):
    """The median of the frames that were measured; none measured is no reason to reject."""
    motion = spark.createDataFrame([(3, 40 + 6 * k, f) for k, f in enumerate(flows)] + [(4, 40, 0.0)], "video_id int, frame int, flow double")
    assert (0 in kept(spark, [(replace(BARE, stop_filter=True), rows())], motion)) == passes


def test_figures(spark):
    m = K.track_measures(spark.createDataFrame(rows(cx=(0.8, 0.2), cy=(0.4, 0.7), area=peaked(0.3, 12, 0.1, 0.2)), SCHEMA)).first()
    assert (m.n, m.t_start, m.t_end, m.peak_i, m.peak_area, m.peak_in_middle) == (20, 0.0, 2.0, 12, 0.3, True)
    for name, want in {"cx_start": 0.8, "cx_end": 0.2, "ground_start": 0.4, "ground_end": 0.7, "mid_peak_ratio": 1.5, "shrink": 1.5, "lateral_vertical_ratio": 2.0}.items():
        assert math.isclose(m[name], want), name


CHOSEN = {
    "trucks enough": (["truck"] * 5 + ["car"] * 2, 0.0, "大型", "truck"),
    "one truck too few": (["truck"] * 4, 0.0, "普通", "truck"),
    "share too small": (["bus"] * 5 + ["car"] * 3, 0.0, "普通", "bus"),
    "truck and bus together": (["bus"] * 3 + ["truck"] * 4, 0.0, "大型", "truck"),
    "first class of equals": (["car", "bus"] * 3, 0.0, "普通", "car"),
    "plates enough": (["car"] * 6, [0.5, 0.46, 0.0, 0.45, 0.0, 0.0], "軽", "car"),
    "plates apart": (["car"] * 6, [0.5, 0.0, 0.5, 0.0, 0.5, 0.0], "普通", "car"),
    "two plates": (["car"] * 6, [0.5, 0.5, 0.0, 0.0, 0.0, 0.44], "普通", "car"),
    "plates beat trucks": (["truck"] * 6, [0.75, 0.75, 0.9, 0.0, 0.0, 0.0], "軽", "truck"),
    "plates too weak for trucks": (["truck"] * 6, [0.74, 0.74, 0.9, 0.5, 0.5, 0.5], "大型", "truck"),
}


def test_vehicle_types(spark):
    data = [r for k, (cls, plates, *_) in enumerate(CHOSEN.values()) for r in rows(k, len(cls), cx=0.5, cls=cls, plate=plates, confidence=0.8)]
    got = {r.track_id: (r.vehicle_type, r.detector_class) for r in K.vehicle_types(spark.createDataFrame(data, SCHEMA)).collect()}
    assert {name: got[k] for k, name in enumerate(CHOSEN)} == {name: tuple(c[2:]) for name, c in CHOSEN.items()}


def test_votes(spark):
    """At the picture's edge a vote counts 0.35 of one in the middle; no vote is from less than 0.05 of confidence."""
    data = rows(n=3, cx=[0.0, 0.5, 0.175], cls=["bus", "car", "van"], confidence=[0.8, 0.8, 0.0])
    votes = {r.cls: r.vote for r in K.class_votes(spark.createDataFrame(data, SCHEMA)).collect()}
    assert {k: round(v, 9) for k, v in votes.items()} == {"bus": 0.28, "car": 0.8, "van": 0.05 * 0.675}


def test_runs(spark):
    rng = [(i * 7919) % 10 < 6 for i in range(60)]
    data = rows(n=60, plate=[0.9 if h else 0.1 for h in rng])
    want = max(len(s) for s in "".join("x" if h else " " for h in rng).split())
    assert K.longest_runs(spark.createDataFrame(data, SCHEMA), F.col("plate_score") > 0.5).first().run == want


def test_one_shuffle(spark):
    """Measures and types from one exchange of the samples."""
    out = K.classify(spark.createDataFrame(rows(), SCHEMA).repartition(4))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Join" not in plan


def test_numbers_and_offsets(spark):
    events = spark.createDataFrame([(k, float((k * 7919) % 501 // 2)) for k in range(3000)], "track_id long, t double")
    got = [r.event_id for r in K.number_events(events, "t", "track_id").orderBy("t", "track_id").collect()]
    assert got == [f"{k:03d}" for k in range(1, 3001)]
    videos = spark.createDataFrame([(k, k, 1.5 * k) for k in range(200)], "video_id long, ord long, duration double")
    assert {r.ord: r.time_offset for r in K.video_offsets(videos).collect()} == {k: 1.5 * k * (k - 1) / 2 for k in range(200)}
