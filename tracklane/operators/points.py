"""LiDAR points: regions, per-frame boxes, thinning, grids and the nearest-point trajectory.

Points have the columns capture_id, frame_idx, ord, t, x, y, z, intensity and laser.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .scans import scan

FAR = 99_999_999.0


def in_box(min_x, max_x, min_y, max_y, lasers=None) -> Column:
    """Inside the rectangle, ends included and in any order, with one of the lasers (null: all)."""
    between = lambda c, a, b: F.col(c).between(F.least(a, b), F.greatest(a, b))
    inside = between("x", min_x, max_x) & between("y", min_y, max_y)
    return inside if lasers is None else inside & (lasers.isNull() | F.array_contains(lasers, F.col("laser")))


def roi(points: DataFrame, x: tuple[float, float], y: tuple[float, float], lasers: Sequence[int] | None = None) -> DataFrame:
    """Points of a fixed region; an empty list of lasers selects none, null all."""
    out = points.where(in_box(*map(F.lit, (*x, *y))))
    return out if lasers is None else out.where(F.col("laser").isin(list(lasers)))


def frame_range(first: int, last: int) -> Column:
    """Frames between two, in any order; frames that are not there don't count."""
    return F.col("frame_idx").between(min(first, last), max(first, last))


def boxes_join(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points inside their frame's boxes(event_id, frame_idx, min_x, max_x, min_y, max_y, lasers); an empty list of lasers means all."""
    lasers = F.when(F.size("lasers") > 0, F.col("lasers"))
    return points.join(boxes, "frame_idx").where(in_box(F.col("min_x"), F.col("max_x"), F.col("min_y"), F.col("max_y"), lasers))


def polar() -> list[Column]:
    """distance, azimuth (from the forward axis) and elevation of a point, in degrees."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return [
        F.sqrt(x * x + y * y + z * z).alias("distance"),
        F.degrees(F.atan2(x, y)).alias("azimuth"),
        F.degrees(F.atan2(z, F.sqrt(x * x + y * y))).alias("elevation"),
    ]


def cartesian(distance: Column, azimuth: Column, elevation: Column) -> list[Column]:
    """x to the right, y ahead, z up; angles in degrees."""
    flat = distance * F.cos(F.radians(elevation))
    return [(flat * F.sin(F.radians(azimuth))).alias("x"), (flat * F.cos(F.radians(azimuth))).alias("y"), (distance * F.sin(F.radians(elevation))).alias("z")]


def thin(points: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """Every k-th point of a frame, with the least k that leaves ``most`` points at most."""
    w = Window.partitionBy(*keys)
    rows = points.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    return rows.where(F.col("_i") % F.greatest(F.lit(1), F.ceil(F.col("_n") / most)) == 0).drop("_i", "_n")


def grid_cells(points: DataFrame, keys: list[str], size: float) -> DataFrame:
    """Occupied cells with their number of points."""
    return points.groupBy(*keys, F.floor(F.col("x") / size).alias("gx"), F.floor(F.col("y") / size).alias("gy")).agg(F.count("*").alias("points"))


def grid_components(cells: DataFrame, keys: list[str], workdir: str) -> DataFrame:
    """Cells with component, the least (gx, gy) of the cells they touch, corners included, directly or not.

    Labels spread by joins on neighbouring cells, and each round also follows the
    label's own label, so that long chains shorten quickly.  Rounds are written
    under ``workdir``, a folder that all executors share, which cuts lineage.
    """
    spark = cells.sparkSession
    step = F.explode(F.array([F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("s")
    label = F.struct("gx", "gy")
    now = cells.select(*keys, "gx", "gy", label.alias("component"))
    turn = 0
    while True:
        near = now.select(*keys, "gx", "gy", "component", step)
        near = near.select(*keys, (F.col("gx") + F.col("s.dx")).alias("gx"), (F.col("gy") + F.col("s.dy")).alias("gy"), F.col("component").alias("c"))
        spread = now.join(near, [*keys, "gx", "gy"]).groupBy(*keys, "gx", "gy").agg(F.min("c").alias("new"), F.min("component").alias("old"))
        jump = spread.select(*keys, F.struct("gx", "gy").alias("new"), F.col("new").alias("further"))
        spread = spread.join(jump, [*keys, "new"], "left").select(*keys, "gx", "gy", "old", F.least("new", F.coalesce("further", "new")).alias("component"))
        path = f"{workdir}/components-{turn}"
        spread.write.mode("overwrite").parquet(path)
        written = spark.read.parquet(path)
        now = written.drop("old")
        turn += 1
        if written.where("component <> old").isEmpty():
            return now


def nearest_points(points: DataFrame, keys: list[str], also: Sequence[str] = ()) -> DataFrame:
    """Of each frame the nearest point in the plane, the first of equals, with its columns ``also``; a frame without a valid one stays, with nulls.

    ``keys`` ends with the frame.  x or y that are null, or distances of FAR and more, never win.
    """
    d = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    valid = d.isNotNull() & ~F.isnan(d) & (d < FAR)
    rows = points.withColumn("distance", F.when(valid, d))
    best = F.min_by(F.struct("x", "y", "z", "distance", *also), F.when(valid, F.struct("distance", "ord")))
    return rows.groupBy(*keys).agg(F.min("t").alias("t"), best.alias("p")).select(*keys, "t", "p.*")


def display(points: DataFrame) -> DataFrame:
    """Points to be shown: frame, place, coordinates to the millimetre, intensity and laser."""
    return points.select("frame_idx", "ord", *(T.round_exact(F.col(c), 3).alias(c) for c in "xyz"), "intensity", "laser")


def trajectory_speed(frames: DataFrame, keys: list[str], slot: float = 600.0) -> DataFrame:
    """Frames of :func:`nearest_points` in order of t, with speed in km/h.

    The first frame has none, nor has a frame without a point or without time
    since the last.  After a frame without a point the way is measured from the origin.
    Frames are ordered in slots of time, and a slot's first frame follows the last
    of the slot before, so that a long capture is many tasks' work.
    """
    zero = F.lit(0.0)
    here = F.struct(F.coalesce("x", zero).alias("x"), F.coalesce("y", zero).alias("y"), F.col("t").alias("t"))
    rows = scan(frames, keys, ["t", "frame_idx"], slot, lag={"_past": here})
    past = F.col("_past")
    dx, dy, dt = (F.col(c) - past[c] for c in ("x", "y", "t"))
    return rows.withColumn("speed", F.when(dt != 0, F.sqrt(dx * dx + dy * dy) / dt * 3600 / 1000)).drop("_past")


def frame_groups(rows: DataFrame) -> DataFrame:
    """ROI rows(file, ord, frame, time_text, ...) whose frame has been opened by a row with a numeric time; t is that row's."""
    time = F.expr("try_cast(time_text AS double)")
    w = Window.partitionBy("file", "frame")
    opened = F.min(F.when(time.isNotNull(), F.col("ord"))).over(w)
    rows = rows.withColumn("_opened", opened).where(F.col("ord") >= F.col("_opened"))
    return rows.withColumn("t", F.first(time, ignorenulls=True).over(w.orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).drop("_opened")
