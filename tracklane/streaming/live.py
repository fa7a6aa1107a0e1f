"""Tracks, passing events, rotations, boxes and reviews of endless inputs.

Rotations and boxes keep state by key with timers: the session needs the RocksDB
state store (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..operators import boxes, review
from ..operators import tracks as K

FRAMES = "capture_id string, packet_idx long, frame_idx long"


def track_sessions(samples: DataFrame, gap: str = "2 seconds", delay: str = "10 seconds") -> DataFrame:
    """Tracks that end after ``gap`` without a sample; samples later than ``delay`` are dropped.

    samples(video_id, track_id, event_time, ord, t, cx, area).  Only aggregates with
    fixed state are kept: count, first and last sample by ord, and the first of the largest.
    """
    first, last = (f(F.struct("t", "cx", "area"), "ord") for f in (F.min_by, F.max_by))
    peak = F.min_by(F.struct("t", "cx", "area"), F.struct((-F.col("area")).alias("a"), "ord"))
    sessions = samples.withWatermark("event_time", delay).groupBy(F.session_window("event_time", gap).alias("session"), "video_id", "track_id")
    out = sessions.agg(F.count("*").alias("n"), first.alias("first"), last.alias("last"), peak.alias("peak"))
    return out.select(
        "session", "video_id", "track_id", "n", F.col("first.t").alias("t_start"), F.col("last.t").alias("t_end"), F.col("first.cx").alias("cx_start"), F.col("last.cx").alias("cx_end"),
        F.col("peak.area").alias("peak_area"), F.col("peak.t").alias("peak_t"),
    )


def _middle(values: Column) -> Column:
    """Median of an array, nulls left out; null where nothing is left."""
    s = F.sort_array(F.filter(values, lambda v: v.isNotNull()))
    n = F.size(s)
    at = lambda k: F.try_element_at(s, k.cast("int") + 1)
    return F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)


def _run(hits: Column) -> Column:
    """Longest run of true."""
    step = lambda s, hit: F.struct(F.when(hit, s["now"] + 1).otherwise(0).alias("now"), F.greatest(s["best"], F.when(hit, s["now"] + 1).otherwise(0)).alias("best"))
    return F.aggregate(hits, F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")), step, lambda s: s["best"])


def passing_tracks(samples: DataFrame, gap: str = "2 seconds", delay: str = "10 seconds", rules: K.TrackRules = K.TrackRules()) -> DataFrame:
    """Passing events of tracks that have ended: the rules of :mod:`tracks` on the samples that a session holds.

    samples: those of :mod:`tracks` with event_time, and flow of their frames (nullable).
    A session keeps its samples as state until it ends, which is as long as a vehicle is seen.
    """
    fields = ("t", "cx", "cy", "area", "cls", "bottom_y", "confidence", "plate_score", "flow")
    grouped = samples.withWatermark("event_time", delay).groupBy(F.session_window("event_time", gap).alias("session"), "video_id", "track_id")
    held = grouped.agg(F.sort_array(F.collect_list(F.struct("ord", *fields))).alias("a"))
    a, n = F.col("a"), F.size("a")
    q = F.greatest(F.lit(1), F.floor(n / 4).cast("int"))
    part = {"start": F.slice(a, F.lit(1), q), "end": F.slice(a, n - q + 1, q)}
    value = {"cx": lambda s: s["cx"], "ground": lambda s: K.ground_y(lambda c: s[c]), "area": lambda s: s["area"]}
    peak = F.array_max(F.transform(a, lambda s, i: F.struct(s["area"].alias("area"), (-i).alias("back"), s["cx"].alias("cx"), s["t"].alias("t"))))
    of = lambda s: (lambda c: s[c])
    total = lambda part: F.aggregate(part, F.lit(0.0), lambda x, s: x + K.vote(of(s)))
    classes = F.array_distinct(F.transform(a, lambda s: s["cls"]))
    votes = F.transform(classes, lambda c, i: F.struct(total(F.filter(a, lambda s: s["cls"] == c)).alias("vote"), (-i).alias("back"), c.alias("cls")))
    large = lambda s: s["cls"].isin(*K.LARGE)
    hit = lambda s: F.coalesce(s["plate_score"] >= rules.plate_threshold, F.lit(False))
    count = lambda f: F.size(F.filter(a, f))
    best = F.sort_array(F.filter(F.transform(a, lambda s: s["plate_score"]), lambda v: v.isNotNull()), asc=False)
    figures = held.select(
        "session", "video_id", "track_id", n.cast("long").alias("n"), a[0]["t"].alias("t_start"), F.element_at(a, -1)["t"].alias("t_end"), a[0]["ord"].alias("first_ord"),
        *(_middle(F.transform(part[end], f)).alias(f"{c}_{end}") for c, f in value.items() for end in part),
        (-peak["back"]).alias("peak_i"), peak["area"].alias("peak_area"), peak["cx"].alias("peak_cx"), peak["t"].alias("peak_t"),
        (count(lambda s: K.on_road(rules, of(s))) / n).alias("road_ratio"), _middle(F.transform(a, lambda s: s["flow"])).alias("ego_motion"),
        F.array_max(votes)["cls"].alias("detector_class"), (total(F.filter(a, large)) / total(a)).alias("large_share"), count(lambda s: large(s) & (s["confidence"] >= 0.40)).alias("large_frames"),
        count(hit).alias("plate_hits"), _middle(F.slice(best, 1, 3)).alias("plate_score"), _run(F.transform(a, hit)).alias("plate_run"),
    )
    return K.passing_tracks(K.with_ratios(figures).withColumn("vehicle_type", K.vehicle_type(rules)), rules)


class _Early(StatefulProcessor):
    """Rows of a key that wait for earlier ones, and timers that end the wait.

    A row is ready when the one before it has been, or when the watermark has passed
    its time: what is earlier and has not come by then is not let in any more.
    ``HELD`` is the state: numbers of its own and the rows that wait.
    """

    HELD = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", self.HELD)

    def wait(self, until: list[int]) -> None:
        """One timer, for the first of the times (in milliseconds) for which rows wait."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        if until:
            self.handle.registerTimer(min(until))

    def close(self) -> None:
        pass


def _millis(times: pd.Series) -> np.ndarray:
    return times.to_numpy("datetime64[ms]").astype(np.int64)


class _Rotations(_Early):
    HELD = "next long, azimuth long, frame long, places array<long>, azimuths array<long>, times array<long>"

    def _release(self, key: tuple, held: dict[int, tuple[int, int]], last: list, now: int) -> Iterator[pd.DataFrame]:
        """Give out what follows on, and all up to ``now``, in order; keep the rest."""
        out, (following, azimuth, frame) = [], last
        for place in sorted(held):
            if place != following and held[place][1] > now:
                break
            turn, _ = held.pop(place)
            frame += azimuth is not None and turn + 18000 < azimuth
            following, azimuth = place + 1, turn
            out.append((key[0], place, frame))
        rest = sorted(held)
        self.state.update((following, azimuth, frame, rest, [held[p][0] for p in rest], [held[p][1] for p in rest]))
        self.wait([held[p][1] for p in rest[:1]])
        if out:
            yield pd.DataFrame(out, columns=["capture_id", "packet_idx", "frame_idx"])

    def _load(self) -> tuple[dict[int, tuple[int, int]], list]:
        if not self.state.exists():
            return {}, [0, None, 0]
        following, azimuth, frame, places, azimuths, times = self.state.get()
        return dict(zip(places, zip(azimuths, times, strict=True), strict=True)), [following, azimuth, frame]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held, last = self._load()
        for part in rows:
            for place, azimuth, at in zip(part["packet_idx"].tolist(), part["azimuth"].tolist(), _millis(part["event_time"]).tolist(), strict=True):
                if place >= last[0]:
                    held[place] = (int(azimuth), at)
        yield from self._release(key, held, last, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(key, *self._load(), timerValues.getCurrentWatermarkInMs())


def rotations(packets: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """packets(capture_id, packet_idx, azimuth, event_time) with frame_idx, in any order within ``delay``.

    packet_idx counts a capture's packets from 0 and their times ascend with it.
    Packets that come early wait as state; one that never comes is given up when the
    watermark passes the time of the first one behind it.  A packet that came twice counts once.
    """
    rows = packets.select("capture_id", "packet_idx", "azimuth", "event_time").withWatermark("event_time", delay)
    return rows.groupBy("capture_id").transformWithStateInPandas(_Rotations(), FRAMES, "append", "eventTime")


class _Boxes(_Early):
    HELD = "box array<double>, frames array<long>, times array<long>, ords array<array<long>>, xs array<array<double>>, ys array<array<double>>"

    def _load(self) -> tuple[boxes.Box | None, dict[int, list]]:
        if not self.state.exists():
            return None, {}
        box, *held = self.state.get()
        return boxes.Box(*box), {f: [t, list(o), list(x), list(y)] for f, t, o, x, y in zip(*held, strict=True)}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        box, held = self._load()
        for part in rows:
            if box is None:
                box = boxes.Box(*part[["box_min_x", "box_max_x", "box_min_y", "box_max_y"]].iloc[0].astype(float))
            part = part.assign(at=_millis(part["event_time"]))
            for frame, own in part.groupby("frame_idx"):
                there = own[own["x"].notna() & own["y"].notna()]
                wait = held.setdefault(int(frame), [0, [], [], []])
                wait[0] = max(wait[0], int(own["at"].max()))
                for k, c in enumerate(("ord", "x", "y"), 1):
                    wait[k] += there[c].tolist()
        self._keep(box, held)
        return iter(())

    def _keep(self, box: boxes.Box, held: dict[int, list]) -> None:
        frames = sorted(held)
        state = [box.min_x, box.max_x, box.min_y, box.max_y, box.vel_x, box.vel_y]
        self.state.update((state, frames, *([held[f][k] for f in frames] for k in range(4))))
        self.wait([held[f][0] for f in frames])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        box, held = self._load()
        now, out = timerValues.getCurrentWatermarkInMs(), []
        for frame in sorted(held):
            at, *points = held[frame]
            if at > now:
                break
            del held[frame]
            order = np.argsort(np.array(points[0], np.int64), kind="stable")
            hit = box.follow(*(np.array(c, float)[order] for c in points[1:]))
            out.append((key[0], frame, hit is not None, *(hit or (0, None, None)), box.min_x, box.max_x, box.min_y, box.max_y, box.vel_x, box.vel_y))
        self._keep(box, held)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in boxes.FOLLOWED.split(", ")])


def follow_boxes(points: DataFrame, starts: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """:func:`boxes.follow_boxes` on a stream: points also have event_time, the time of their frame, and come in any order within ``delay``.

    The state of an event is its box and the points of frames that the watermark has
    not passed; a lost box stays where it is.  ``starts`` is a table.
    """
    rows = boxes.candidates(points.withWatermark("event_time", delay), starts, "event_time")
    return rows.groupBy("event_id").transformWithStateInPandas(_Boxes(), boxes.FOLLOWED, "append", "eventTime")


class Latest:
    """A table of the latest row of each key, kept up by a stream: ``writeStream.foreachBatch(latest.apply)``.

    A batch is a folder named by its number, so that a batch that comes again
    replaces itself and changes nothing.  After every ``every`` batches their rows and
    the last snapshot become a new snapshot, a folder that counts when it is whole.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str, schema: str, every: int = 20):
        self.spark, self.path, self.keys, self.order, self.schema, self.every = spark, path, keys, order, schema, every

    def _folders(self, kind: str) -> list[int]:
        """Numbers of the whole folders of a kind."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        found = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}-*/_SUCCESS")
        return sorted(int(s.getPath().getParent().getName().split("-")[1]) for s in found.getFileSystem(conf).globStatus(found) or [])

    def rows(self, until: int | None = None) -> DataFrame:
        """The latest row of each key, of all batches or of those up to a number."""
        inside = lambda k: until is None or k <= until
        snapshots = [k for k in self._folders("snapshot") if inside(k)]
        last = snapshots[-1] if snapshots else -1
        paths = [f"{self.path}/batch-{k}" for k in self._folders("batch") if last < k and inside(k)] + [f"{self.path}/snapshot-{k}" for k in snapshots[-1:]]
        read = self.spark.read.schema(self.schema)
        every = read.parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
        return review.latest(every, self.keys, self.order)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        columns = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        review.latest(batch.select(columns), self.keys, self.order).select(columns).write.mode("overwrite").parquet(f"{self.path}/batch-{batch_id}")
        if batch_id % self.every == self.every - 1:
            self.rows(batch_id).select(columns).write.mode("overwrite").parquet(f"{self.path}/snapshot-{batch_id}")
