"""Vehicle tracks to passing events: one aggregation by (video_id, track_id).

Samples have the columns video_id, track_id, ord (position in the track), frame,
t, cx, cy, area, cls, bottom_y (nullable), confidence and plate_score.  All windows
are within a track and the aggregation is by it, so that a track's samples are
shuffled once, for measures and vehicle type alike; none are collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import number_rows, running_total

KEYS = ("video_id", "track_id")
LARGE = ("truck", "bus")


@dataclass(frozen=True)
class TrackRules:
    """The thresholds' defaults."""

    view: str = "front"
    min_samples: int = 5
    min_seconds: float = 0.6
    appear_edge: float = 0.70
    exit_edge: float = 0.40
    stop_flow: float = 0.8
    stop_filter: bool = True
    trajectory_filter: bool = True
    min_vertical_motion: float = 0.025
    max_lateral_vertical_ratio: float = 8.0
    area_filter: bool = True
    min_area_ratio: float = 1.15
    max_mid_peak_ratio: float = 1.8
    road_roi: bool = False
    min_road_ratio: float = 0.25
    vanishing_x: float = 0.5
    vanishing_y: float = 0.42
    road_top_half_width: float = 0.08
    road_bottom_left: float = 0.12
    road_bottom_right: float = 0.88
    close_peak_area: float = 0.08
    close_min_shrink: float = 1.8
    close_min_lateral: float = 0.08
    close_side: float = 0.55
    close_min_road: float = 0.50
    plate_threshold: float = 0.45
    plate_min_run: int = 2
    plate_over_large: float = 0.75
    large_share: float = 0.70
    large_min_frames: int = 5


def ground_y(of=F.col) -> Column:
    """The lower edge of a sample, else its centre; ``of`` gives a sample's fields."""
    return F.coalesce(of("bottom_y"), of("cy"))


def on_road(rules: TrackRules, of=F.col) -> Column:
    """Whether a sample lies in the road trapezoid."""
    depth = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (ground_y(of) - rules.vanishing_y) / max(1e-6, 1.0 - rules.vanishing_y)))
    edge = lambda top, bottom: F.lit(top) * (1 - depth) + F.lit(bottom) * depth
    left = edge(rules.vanishing_x - rules.road_top_half_width, rules.road_bottom_left)
    right = edge(rules.vanishing_x + rules.road_top_half_width, rules.road_bottom_right)
    return of("cx").between(left, right)


def vote(of=F.col) -> Column:
    """A sample's vote for its class: confidence, less near the picture's edge."""
    edge = F.least(F.greatest(of("cx"), F.lit(0.0)), F.greatest(1 - of("cx"), F.lit(0.0)))
    return F.greatest(F.lit(0.05), of("confidence")) * (0.35 + 0.65 * F.least(F.lit(1.0), edge / 0.35))


def numbered(samples: DataFrame) -> DataFrame:
    """Samples with their position i (from 0) in the track, its length n and its quartile length q."""
    track = Window.partitionBy(*KEYS)
    return samples.select(
        "*", (F.row_number().over(track.orderBy("ord")) - 1).alias("i"), F.count("*").over(track).alias("n")
    ).withColumn("q", F.greatest(F.lit(1), F.floor(F.col("n") / 4)))


def _measures(samples: DataFrame, rules: TrackRules) -> list[Column]:
    """Aggregates of numbered samples for :func:`with_ratios`."""
    first, last = F.col("i") < F.col("q"), F.col("i") >= F.col("n") - F.col("q")
    middle = lambda part, c: F.median(F.when(part, c))
    at_peak = F.struct("area", -F.col("i"))
    flow = F.median("flow") if "flow" in samples.columns else F.lit(None).cast("double")
    ground = ground_y()
    value = {"cx": F.col("cx"), "ground": ground, "area": F.col("area")}
    return [
        F.count("*").alias("n"),
        F.min_by("t", "i").alias("t_start"),
        F.max_by("t", "i").alias("t_end"),
        F.min("ord").alias("first_ord"),
        *(middle(part, v).alias(f"{c}_{end}") for c, v in value.items() for part, end in ((first, "start"), (last, "end"))),
        F.max_by("i", at_peak).alias("peak_i"),
        F.max("area").alias("peak_area"),
        F.max_by("cx", at_peak).alias("peak_cx"),
        F.max_by("t", at_peak).alias("peak_t"),
        F.avg(F.when(on_road(rules), 1.0).otherwise(0.0)).alias("road_ratio"),
        flow.alias("ego_motion"),
    ]


def with_ratios(tracks: DataFrame) -> DataFrame:
    """Tracks' figures with those that follow from them."""
    small = F.lit(1e-9)
    return tracks.select(
        "*",
        (F.col("peak_area") / F.greatest("area_start", "area_end", small)).alias("mid_peak_ratio"),
        (F.col("peak_area") / F.greatest("area_end", small)).alias("shrink"),
        F.col("peak_i").between(F.floor(0.2 * F.col("n")), F.floor(0.8 * F.col("n"))).alias("peak_in_middle"),
        (F.abs(F.col("cx_end") - F.col("cx_start")) / F.greatest(F.abs(F.col("ground_end") - F.col("ground_start")), F.lit(1e-6))).alias("lateral_vertical_ratio"),
    )


def track_measures(samples: DataFrame, rules: TrackRules = TrackRules()) -> DataFrame:
    """One row per track with every figure that the rules look at; ``flow`` (nullable) may be among the samples' columns."""
    return with_ratios(numbered(samples).groupBy(*KEYS).agg(*_measures(samples, rules)))


def close_pass(rules: TrackRules) -> Column:
    """The rescue of a vehicle that passes very close."""
    side = F.col("peak_cx") >= rules.close_side if rules.view == "front" else F.col("peak_cx") <= 1 - rules.close_side
    return (
        (F.col("n") >= 5) & (F.col("peak_i") >= 3) & (F.col("n") - F.col("peak_i") - 1 >= 3)
        & (F.col("road_ratio") >= rules.close_min_road) & (F.col("peak_area") >= rules.close_peak_area)
        & (F.col("shrink") >= rules.close_min_shrink) & side & (F.col("peak_cx") - F.col("cx_end") >= rules.close_min_lateral)
    )


def ordinary_path(rules: TrackRules) -> Column:
    inward = F.col("cx_end") < F.col("cx_start")
    if rules.view == "front":
        return (F.col("cx_start") >= rules.appear_edge) & inward & (F.col("cx_end") > rules.exit_edge)
    return (F.col("cx_end") <= 1 - rules.appear_edge) & inward & (F.col("cx_start") < 1 - rules.exit_edge)


def passing_tracks(measures: DataFrame, rules: TrackRules = TrackRules()) -> DataFrame:
    """The tracks that are passing events, with side, vertical_motion and area_change_ratio."""
    front = rules.view == "front"
    rise = F.col("ground_start") - F.col("ground_end")
    grow = (F.col("area_start") / F.greatest("area_end", F.lit(1e-9))) if front else (F.col("area_end") / F.greatest("area_start", F.lit(1e-9)))
    rows = measures.where((F.col("n") >= rules.min_samples) & (F.col("t_end") - F.col("t_start") >= rules.min_seconds)).select(
        "*", close_pass(rules).alias("close_pass"), (rise if front else -rise).alias("vertical_motion"), F.lit("left" if front else "right").alias("side")
    )
    rows = rows.withColumn("area_change_ratio", F.when(F.col("close_pass"), F.col("shrink")).otherwise(grow))
    keep = ordinary_path(rules) | F.col("close_pass")
    if rules.stop_filter:
        keep &= F.coalesce(F.col("ego_motion") >= rules.stop_flow, F.lit(True))
    if rules.trajectory_filter:
        keep &= F.col("close_pass") | (F.col("vertical_motion") >= rules.min_vertical_motion) & (F.col("lateral_vertical_ratio") <= rules.max_lateral_vertical_ratio)
    if rules.area_filter:
        humped = F.col("peak_in_middle") & (F.col("mid_peak_ratio") > rules.max_mid_peak_ratio)
        keep &= F.col("close_pass") | (F.col("area_change_ratio") >= rules.min_area_ratio) & ~humped
    if rules.road_roi:
        keep &= F.col("road_ratio") >= rules.min_road_ratio
    return rows.where(keep)


def class_votes(samples: DataFrame) -> DataFrame:
    """(video_id, track_id, cls, vote, first_i): votes of each class of a track."""
    return numbered(samples).groupBy(*KEYS, "cls").agg(F.sum(vote()).alias("vote"), F.min("i").alias("first_i"))


def _with_runs(rows: DataFrame, hit: Column) -> DataFrame:
    """Numbered samples with run, the hits up to each since the last miss."""
    track = Window.partitionBy(*KEYS).orderBy("ord")  # as they were numbered: no other sort
    rows = rows.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    last = F.max(F.when(~F.col("_hit"), F.col("i"))).over(track.rowsBetween(Window.unboundedPreceding, 0))
    run = F.when(F.col("_hit"), F.col("i") - F.coalesce(last, F.lit(-1))).otherwise(0)
    return rows.withColumn("run", run).drop("_hit")


def longest_runs(samples: DataFrame, hit: Column) -> DataFrame:
    """(video_id, track_id, run): the most samples in a row for which ``hit`` holds."""
    return _with_runs(numbered(samples), hit).groupBy(*KEYS).agg(F.max("run").cast("int").alias("run"))


def _typed(rows: DataFrame, rules: TrackRules) -> DataFrame:
    """Numbered samples with what the vehicle type needs: run, place by plate score, and votes of the sample's class so far."""
    rows = _with_runs(rows, F.col("plate_score") >= rules.plate_threshold)
    own = Window.partitionBy(*KEYS, "cls")
    return rows.select(
        "*",
        F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("plate_score"), "i")).alias("score_place"),
        vote().alias("vote"),
        F.sum(vote()).over(own).alias("class_vote"),
        F.min("i").over(own).alias("class_first"),
    )


def _type_figures(rules: TrackRules) -> list[Column]:
    large = F.col("cls").isin(*LARGE)
    return [
        F.max_by("cls", F.struct("class_vote", -F.col("class_first"))).alias("detector_class"),
        (F.sum(F.when(large, F.col("vote")).otherwise(0.0)) / F.sum("vote")).alias("large_share"),
        F.count_if(large & (F.col("confidence") >= 0.40)).alias("large_frames"),
        F.count_if(F.col("plate_score") >= rules.plate_threshold).alias("plate_hits"),
        F.median(F.when(F.col("score_place") <= 3, F.col("plate_score"))).alias("plate_score"),
        F.max("run").alias("plate_run"),
    ]


def vehicle_type(rules: TrackRules) -> Column:
    """The type of a track by detector_class, large_share, large_frames, plate_hits, plate_score and plate_run."""
    strong = F.col("detector_class").isin(*LARGE) & (F.col("large_share") >= rules.large_share) & (F.col("large_frames") >= max(1, rules.large_min_frames))
    need = max(1, rules.plate_min_run)
    light = (F.col("plate_run") >= need) & (F.col("plate_hits") >= max(3, need)) & (~strong | (F.col("plate_score") >= rules.plate_over_large))
    return F.when(light, "軽").when(strong, "大型").otherwise("普通").alias("vehicle_type")


def vehicle_types(samples: DataFrame, rules: TrackRules = TrackRules()) -> DataFrame:
    """(video_id, track_id, vehicle_type, detector_class, plate_score, plate_hits)."""
    tracks = _typed(numbered(samples), rules).groupBy(*KEYS).agg(*_type_figures(rules))
    return tracks.select(*KEYS, vehicle_type(rules), "detector_class", "plate_score", "plate_hits")


def with_flow(samples: DataFrame, motion: DataFrame) -> DataFrame:
    """Samples with the flow of their frame, null where none was measured."""
    return samples.join(motion.select("video_id", "frame", "flow"), ["video_id", "frame"], "left")


def classify(samples: DataFrame, motion: DataFrame | None = None, rules: TrackRules = TrackRules()) -> DataFrame:
    """Passing events of all tracks, with their vehicle types."""
    rows = with_flow(samples, motion) if motion is not None else samples
    tracks = _typed(numbered(rows), rules).groupBy(*KEYS).agg(*_measures(rows, rules), *_type_figures(rules))
    return passing_tracks(with_ratios(tracks).withColumn("vehicle_type", vehicle_type(rules)), rules)


def video_offsets(videos: DataFrame) -> DataFrame:
    """videos(video_id, ord, duration) with time_offset, the durations before each: one row per video."""
    return running_total(videos, ["ord"], "duration", "_until").withColumn("time_offset", F.col("_until") - F.col("duration")).drop("_until")


def number_events(events: DataFrame, *order: str) -> DataFrame:
    """Event ids 001, 002, ... in order."""
    return number_rows(events, list(order), "_number").withColumn("event_id", F.format_string("%03d", "_number")).drop("_number")
