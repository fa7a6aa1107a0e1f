"""A box that follows one vehicle through the frames of a capture.

What a frame does to a box depends on all frames before it, so that an event is
followed by one task; a task holds one frame's points at a time, and events are
dealt over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Metres around the box that are searched, points that a vehicle has at least, metres that a box moves in a frame at most, and the size of a cell.
MARGIN, LEAST_POINTS, MOST_STEP, CELL = 1.2, 8, 6.0, 0.6
FOLLOWED = "event_id string, frame_idx long, found boolean, n_points long, centre_x double, centre_y double, min_x double, max_x double, min_y double, max_y double, vel_x double, vel_y double"


def clusters(x: np.ndarray, y: np.ndarray, size: float = CELL) -> np.ndarray:
    """A number for each point, the same for points whose cells touch, corners included, directly or not: that of the first such point."""
    cells, first, of = np.unique(np.floor(np.column_stack((x, y)) / size).astype(np.int64), axis=0, return_index=True, return_inverse=True)
    number = {tuple(c): k for k, c in enumerate(cells.tolist())}
    parent = list(range(len(cells)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for (gx, gy), k in number.items():
        for step in ((1, -1), (1, 0), (1, 1), (0, 1)):
            other = number.get((gx + step[0], gy + step[1]))
            if other is not None:
                a, b = sorted((root(k), root(other)), key=lambda c: first[c])
                parent[b] = a
    return first[[root(k) for k in range(len(cells))]][of.ravel()]


@dataclass
class Box:
    min_x: float
    max_x: float
    min_y: float
    max_y: float
    vel_x: float = 0.0
    vel_y: float = 0.0

    def follow(self, x: np.ndarray, y: np.ndarray) -> tuple[int, float, float] | None:
        """Move to the nearest vehicle where the box is expected; (points, centre), or None where it is lost and stays."""
        half_x, half_y = (self.max_x - self.min_x) / 2, (self.max_y - self.min_y) / 2
        at = np.array([self.min_x + self.max_x, self.min_y + self.max_y]) / 2
        speed = np.array([self.vel_x, self.vel_y])
        want = at + speed
        reach = np.array([half_x, half_y]) + MARGIN + np.abs(speed)
        near = (np.abs(x - want[0]) <= reach[0]) & (np.abs(y - want[1]) <= reach[1])
        x, y = x[near], y[near]
        if len(x) < LEAST_POINTS:
            return None
        names, which, count = np.unique(clusters(x, y), return_inverse=True, return_counts=True)
        centres = np.column_stack((np.bincount(which, x), np.bincount(which, y))) / count[:, None]
        away = np.where(count >= LEAST_POINTS, np.hypot(*(centres - want).T), np.inf)
        best = int(away.argmin())
        if not np.isfinite(away[best]):
            return None
        step = centres[best] - at
        length = float(np.hypot(*step))
        if length > MOST_STEP:
            step = step * (MOST_STEP / length)
        self.vel_x, self.vel_y = step.tolist()
        new = at + step
        self.min_x, self.max_x, self.min_y, self.max_y = new[0] - half_x, new[0] + half_x, new[1] - half_y, new[1] + half_y
        return int(count[best]), float(centres[best][0]), float(centres[best][1])


def _frames(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one event and frame at a time, from rows in that order."""
    held: list[pd.DataFrame] = []
    for part in parts:
        if part.empty:
            continue
        key = part["event_id"] + "/" + part["frame_idx"].astype(str)
        for name, rows in part.groupby(key.ne(key.shift()).cumsum(), sort=False):
            if held and (held[-1]["event_id"].iloc[-1], held[-1]["frame_idx"].iloc[-1]) != (rows["event_id"].iloc[0], rows["frame_idx"].iloc[0]):
                yield pd.concat(held)
                held = []
            held.append(rows)
    if held:
        yield pd.concat(held)


def _follow(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    event, box, out = None, None, []
    for rows in _frames(parts):
        head = rows.iloc[0]
        if head["event_id"] != event:
            event, box = head["event_id"], Box(*(float(head[f"box_{c}"]) for c in ("min_x", "max_x", "min_y", "max_y")))
        points = rows[rows["x"].notna() & rows["y"].notna()]
        hit = box.follow(points["x"].to_numpy(float), points["y"].to_numpy(float))
        out.append((event, head["frame_idx"], hit is not None, *(hit or (0, None, None)), box.min_x, box.max_x, box.min_y, box.max_y, box.vel_x, box.vel_y))
        if len(out) == 1000:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FOLLOWED.split(", ")])
            out = []
    yield pd.DataFrame(out, columns=[c.split()[0] for c in FOLLOWED.split(", ")])


def candidates(points: DataFrame, starts: DataFrame, *also: str) -> DataFrame:
    """The points of the frames that each event's box goes through, with the box; x and y are null where a point doesn't count."""
    of = starts.select(F.col("event_id").cast("string").alias("event_id"), "capture_id", "first_frame", "last_frame", "lasers", *(F.col(c).cast("double").alias(f"box_{c}") for c in ("min_x", "max_x", "min_y", "max_y")))
    rows = points.join(of, "capture_id").where(F.col("frame_idx").between(F.col("first_frame") + 1, F.col("last_frame")))
    counts = F.coalesce(F.size("lasers") <= 0, F.lit(True)) | F.col("lasers").isNull() | F.array_contains("lasers", F.col("laser"))
    return rows.select("event_id", F.col("frame_idx").cast("long").alias("frame_idx"), "ord", *also, F.when(counts, F.col("x").cast("double")).alias("x"), F.when(counts, F.col("y").cast("double")).alias("y"), "box_min_x", "box_max_x", "box_min_y", "box_max_y")


def follow_boxes(points: DataFrame, starts: DataFrame, tasks: int | None = None) -> DataFrame:
    """Boxes of starts(event_id, capture_id, first_frame, last_frame, min_x, max_x, min_y, max_y, lasers) through the frames behind first_frame up to last_frame.

    points(capture_id, frame_idx, ord, x, y, laser); with lasers (null or empty: all)
    only their points count.  A frame without such points leaves the box where it is.
    """
    rows = candidates(points, starts)
    dealt = rows.repartition(tasks, "event_id") if tasks else rows.repartition("event_id")
    return dealt.sortWithinPartitions("event_id", "frame_idx", "ord").mapInPandas(_follow, FOLLOWED)
