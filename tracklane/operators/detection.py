"""From a detector's boxes and measurements to track samples: all plain columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The detector's classes that are vehicles.
VEHICLES = {2: "car", 5: "bus", 7: "truck"}
#: Frames a second where a video doesn't say.
FPS = 30.0
#: Points of a frame that its flow needs, and the error in pixels below which a point counts.
LEAST_POINTS, MOST_ERROR = 10, 1.0
#: Bounds of a plate's contour and of its vehicle.
PLATE = {"width": 6, "height": 3, "area": 18, "aspect": (1.15, 3.8), "share": (0.0003, 0.06), "vehicle": (40, 30)}


def videos(rows: DataFrame) -> DataFrame:
    """videos(video_id, ord, fps, w, h, total_frames) with fps filled in and duration in seconds."""
    fps = F.when(F.col("fps") > 0, F.col("fps")).otherwise(FPS)
    return rows.withColumn("fps", fps).withColumn("duration", F.coalesce("total_frames", F.lit(0)) / F.col("fps"))


def detections(boxes: DataFrame, least: float = 0.30, stride: int = 1) -> DataFrame:
    """boxes(video_id, frame, cls_id, score, ...) of vehicles with a score of ``least`` at least, on every stride-th frame; cls is the class's name."""
    name = F.create_map(*(F.lit(x) for pair in VEHICLES.items() for x in pair))
    kept = F.col("cls_id").isin(list(VEHICLES)) & (F.col("score") >= least) & (F.col("frame") % stride == 0)
    return boxes.where(kept).withColumn("cls", F.try_element_at(name, F.col("cls_id").cast("int")))


def normalised() -> list[Column]:
    """Centre, area and lower edge of a box x1, y1, x2, y2 as shares of a picture w, h; t of its frame."""
    x1, y1, x2, y2, w, h = map(F.col, ("x1", "y1", "x2", "y2", "w", "h"))
    return [
        ((x1 + x2) / 2 / w).alias("cx"), ((y1 + y2) / 2 / h).alias("cy"), ((x2 - x1) * (y2 - y1) / (w * h)).alias("area"), (y2 / h).alias("bottom_y"),
        (F.col("frame") / F.col("fps")).alias("t"),
    ]


def track_samples(boxes: DataFrame, of_videos: DataFrame, least: float = 0.30, stride: int = 1) -> DataFrame:
    """Samples of :mod:`tracks` from boxes(video_id, track_id, frame, cls_id, score, x1, y1, x2, y2, plate_score)."""
    rows = detections(boxes, least, stride).where("track_id IS NOT NULL").join(videos(of_videos), "video_id")
    return rows.select("video_id", "track_id", F.col("frame").alias("ord"), "frame", *normalised(), "cls", F.col("score").alias("confidence"), "plate_score")


def magnitude() -> Column:
    return F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))


def frame_flow(points: DataFrame) -> DataFrame:
    """(video_id, frame, flow) from points(video_id, frame, dx, dy, st1, st2, error): the median way of those that were found both ways, 0 where too few were."""
    good = (F.col("st1") == 1) & (F.col("st2") == 1) & (F.col("error") < MOST_ERROR)
    per_frame = points.groupBy("video_id", "frame").agg(F.count_if(good).alias("n"), F.median(F.when(good, magnitude())).alias("way"))
    return per_frame.select("video_id", "frame", F.when(F.col("n") < LEAST_POINTS, 0.0).otherwise(F.col("way")).alias("flow"))


def plate_contour() -> Column:
    """Whether a contour may be a plate: bw, bh, area and its vehicle's vw, vh, in pixels."""
    aspect, share = F.col("bw") / F.greatest("bh", F.lit(1)), F.col("area") / F.greatest(F.col("vw") * F.col("vh"), F.lit(1.0))
    large = (F.col("bw") >= PLATE["width"]) & (F.col("bh") >= PLATE["height"]) & (F.col("area") >= PLATE["area"])
    return large & aspect.between(*PLATE["aspect"]) & share.between(*PLATE["share"]) & (F.col("vw") >= PLATE["vehicle"][0]) & (F.col("vh") >= PLATE["vehicle"][1])


def contour_score() -> Column:
    """How much a contour looks like a plate, by its fill, its size and its shape."""
    aspect, share = F.col("bw") / F.greatest("bh", F.lit(1)), F.col("area") / F.greatest(F.col("vw") * F.col("vh"), F.lit(1.0))
    fill = F.col("area") / F.greatest((F.col("bw") * F.col("bh")).cast("double"), F.lit(1.0))
    shape = F.greatest(F.lit(0.0), 1 - F.abs(aspect - 2) / 2)
    return F.least(F.lit(1.0), 0.5 * fill + 0.3 * F.least(F.lit(1.0), share / 0.004) + 0.2 * shape)


def plate_scores(contours: DataFrame, keys: list[str]) -> DataFrame:
    """Best score of each box's contours, 0 where none may be a plate."""
    return contours.groupBy(*keys).agg(F.coalesce(F.max(F.when(plate_contour(), contour_score())), F.lit(0.0)).alias("plate_score"))


def clip_window(margin: float = 2.0) -> list[Column]:
    """Beginning and length of a clip around t_start .. t_end, and the name of its file."""
    return [
        F.greatest(F.lit(0.0), F.col("t_start") - margin).alias("clip_start"), (F.col("t_end") - F.col("t_start") + 2 * margin).alias("clip_duration"),
        F.concat(F.lit("event_"), "event_id", F.lit("_"), "side", F.lit(".mp4")).alias("clip"),
    ]


def with_clips(events: DataFrame, files: DataFrame) -> DataFrame:
    """Events with has_clip: whether ``files``(name) has their clip."""
    name = F.concat(F.lit("event_"), F.coalesce("event_id", F.lit("")), F.lit("_"), F.coalesce("side", F.lit("")), F.lit(".mp4"))
    known = files.select(F.col("name").alias("_clip")).distinct().withColumn("_there", F.lit(True))
    return events.withColumn("_clip", name).join(known, "_clip", "left").withColumn("has_clip", F.coalesce("_there", F.lit(False))).drop("_clip", "_there")


def global_times(events: DataFrame, offsets: DataFrame) -> DataFrame:
    """Events(video_id, t_start, peak_t, t_end) with duration and their times in all videos one after the other; offsets(video_id, time_offset)."""
    rows = events.join(offsets.select("video_id", "time_offset"), "video_id")
    shifted = {f"global_{c}": F.col(c) + F.col("time_offset") for c in ("t_start", "peak_t", "t_end")}
    return rows.withColumns(shifted | {"duration": F.col("t_end") - F.col("t_start")})
