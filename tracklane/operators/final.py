"""The final report of a collection, and the tables of the other files for people: rows for the sinks of ``sources``."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import review as R
from .ordering import number_rows

#: Headers of the report.
HEADERS = (
    "整理ID", "データ収集日", "被験者名またはID", "離隔距離（ｍ）", "自転車速度（km/h)", "自動車速度（km/h)", "危険感", "通過時間", "距離p2", "距離p3", "相対速度", "TTC",
    "動画ファイル名", "動画のタイムスタンプ", "LiDARデータファイル名", "日本時間", "LiDARのタイムスタンプ", "車種",
)
#: Choices for danger and vehicle, formats of cells from style 2 on, widths of columns, and rows that are laid out.
DANGERS, VEHICLES = ("非常に危険", "危険", "やや危険", "なし"), ("普通", "軽", "大型", "二輪")
FORMATS = ("yyyy/m/d", "h:mm:ss", "0.00", "")
WIDTHS = ((1, 1, 10), (2, 3, 16), (4, 6, 17), (7, 12, 14), (13, 15, 22), (16, 18, 17))
PAGE = 50
LAYOUT = {"widths": WIDTHS, "formats": FORMATS, "lists": {f"G2:G{PAGE + 1}": DANGERS, f"R2:R{PAGE + 1}": VEHICLES}}
#: Labels of a trajectory's analysis, with their units, beside its rows from the first on.
MARKS = (("分析指標", None, "単位"), ("離隔距離 (LC)", "lc", "m"), ("通過時間", "passing_time", "秒"), ("距離p2", "distance_p2", "m"), ("距離p3", "distance_p3", "m"), ("相対速度", "relative_speed", "km/h"), ("TTC", "ttc", "秒"))
MARK_VALUE, PHASE, PHASES = "計算値（数式）", "フェーズ区分", "フェーズ"


def trajectory_name(event_id: Column) -> Column:
    """The file of an event's edited trajectory."""
    return F.concat(F.lit("overtaking_"), T.safe_id(F.coalesce(event_id, F.lit(""))), F.lit("_edit.csv"))


def with_metrics(events: DataFrame, metrics: DataFrame) -> DataFrame:
    """Events with the metrics of metrics(name, ...) whose name is that of their trajectory's file; null where there is none."""
    return events.withColumn("_file", trajectory_name(F.col("event_id"))).join(metrics.withColumnRenamed("name", "_file"), "_file", "left").drop("_file")


def speed_intervals(events: DataFrame, offset: float) -> DataFrame:
    """(interval_id, video, lo, hi): when an event's passing was, in its video's own time, for the videos' speeds.

    events(event_id, source_video, t_start_s, local_t_start_s, t3, t4), t3 and t4 in the capture's time.
    """
    shift = F.coalesce(T.number(F.col("t_start_s")), F.lit(0.0)) - F.coalesce(T.number(F.col("local_t_start_s")), F.lit(0.0))
    return events.where("t3 IS NOT NULL AND t4 IS NOT NULL").select(
        F.col("event_id").alias("interval_id"), F.lower(T.stem(F.col("source_video"))).alias("video"), (F.col("t3") - offset - shift).alias("lo"), (F.col("t4") - offset - shift).alias("hi")
    )


def final_rows(events: DataFrame, speeds: DataFrame, organize_id: str = "", subject_id: str = "", collected: date | None = None, capture: str = "", capture_start: float | None = None) -> DataFrame:
    """The report's columns for accepted events, in order of ``place``, with ``warning``.

    events: reviewed events with metrics; speeds(event_id, own_speed in km/h).  What
    is missing stays null and never drops an event.
    """
    rows = R.accepted(events).join(speeds, "event_id", "left")
    seen = F.when(F.col("status") == "ok", F.col("t3"))
    own = F.when(F.col("status") == "ok", F.col("own_speed"))
    stamp = F.lit(capture_start) + seen if capture_start is not None else seen
    japan = T.day_fraction(stamp) if capture_start is not None else F.lit(None).cast("double")
    warning = F.concat_ws(
        "; ",
        F.when(F.col("status").isNull(), "no trajectory").when(F.col("status") != "ok", F.col("status")),
        F.when(F.lit(capture_start is None) & seen.isNotNull(), "no start of the capture: times are relative"),
    )
    two = lambda c, digits=2: F.when(c.isNotNull() & (F.abs(c) < float("inf")), T.round_exact(c, digits))
    text = lambda s: F.lit(s).cast("string")
    columns = (
        F.coalesce(F.nullif(text(organize_id), F.lit("")), F.col("event_id")), T.excel_day(F.lit(collected).cast("date")), text(subject_id), two(F.col("lc")), two(own), two(own + F.col("relative_speed")),
        T.danger(F.coalesce(F.nullif("danger_level", F.lit("")), F.lit("0"))), two(F.col("passing_time")), two(F.col("distance_p2")), two(F.col("distance_p3")), two(F.col("relative_speed")), two(F.col("ttc")),
        T.stem(F.col("source_video")), T.number(F.col("local_t_start_s")) / 86400, T.stem_name(text(capture)), japan, two(stamp, 6), F.col("class"),
    )
    number, raw = R.report_order()
    rows = rows.select(number.cast("long").alias("_number"), raw.alias("_raw"), *(c.alias(h) for c, h in zip(columns, HEADERS, strict=True)), warning.alias("warning"))
    return number_rows(rows, ["_number", "_raw"], "place").drop("_number", "_raw")


#: Styles of the report's cells by header.
STYLES = {HEADERS[1]: 2, **dict.fromkeys((HEADERS[k] for k in (3, 4, 5, 7, 8, 9, 10, 11)), 4), HEADERS[13]: 3, HEADERS[15]: 3, HEADERS[16]: 5}


def padded(rows: DataFrame, page: int = PAGE) -> DataFrame:
    """Rows with a place, and empty ones behind them up to ``page``."""
    blank = rows.sparkSession.range(1, page + 1).select(F.col("id").alias("place"))
    return rows.unionByName(blank.join(rows.select("place"), "place", "left_anti"), allowMissingColumns=True)


def filled(rows: DataFrame, page: int = PAGE) -> DataFrame:
    """(rows): how many of the first ``page`` rows have a cell that is not blank or zero."""
    shown = [F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in rows.columns if c not in ("place", "warning")]
    some = [(s != "") & F.coalesce(s.try_cast("double") != 0, F.lit(True)) for s in shown]
    there = some[0]
    for s in some[1:]:
        there = there | s
    return rows.where(F.col("place") <= page).agg(F.count_if(there).alias("rows"))


def analysis_rows(points: DataFrame, metrics: DataFrame) -> DataFrame:
    """Rows of trajectories(file, rn, row_number, and texts) with the phase that each begins and, beside the first ones, the metrics.

    metrics(file, p1..p4 and those of MARKS).  Metrics beyond a trajectory's last row are lost.
    """
    phase = F.lit("")
    for k in (1, 2, 3, 4):  # of two phases that begin at a row the later one counts
        phase = F.when(F.col("rn") == F.col(f"p{k}"), f"{PHASES}{k}").otherwise(phase)
    label, value, unit = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("string")
    for k, (name, metric, of) in enumerate(MARKS, 1):
        here = F.col("rn") == k
        label, unit = F.when(here, name).otherwise(label), F.when(here, of).otherwise(unit)
        value = F.when(here, F.col(metric)).otherwise(value) if metric else value
    return points.join(metrics, "file").withColumns({"phase": phase, "mark": label, "mark_value": value, "mark_unit": unit})


def reviewed_rows(events: DataFrame, offset: float) -> DataFrame:
    """Events that were not rejected, without columns of the moment, with their times in the capture as texts."""
    rows = R.not_rejected(events if "review_status" in events.columns else events.withColumn("review_status", F.lit(None).cast("string")))
    at = lambda c: T.timecode(F.coalesce(T.number(F.col(c)), F.lit(0.0)) + offset)
    rows = rows.drop("clip_url", "veloview_display")
    return rows.withColumns({"veloview_t_start": at("t_start_s"), "veloview_peak_t": at("peak_t_s"), "veloview_t_end": at("t_end_s")})


def capture_seconds(event: str, fallback: str, offset: float) -> Column:
    """Where a candidate is in the capture: its own time, else the fallback's, and the offset."""
    return T.event_seconds(F.col(event), F.col(fallback)) + offset


def candidate_order(order: str) -> list[Column]:
    """Accepted candidates first, then as they were."""
    return [(F.coalesce(F.col("review_status"), F.lit("")) != T.ACCEPTED).cast("int"), F.col(order)]


def outcome_counts(results: DataFrame) -> DataFrame:
    """(status, n) over files that were worked on."""
    return results.groupBy("status").agg(F.count("*").alias("n"))


def exported_counts(selected: DataFrame, requested: DataFrame) -> DataFrame:
    """(event_id, frames, written_frames, points): frames that were asked for, those with points, and all points."""
    of = selected.groupBy("event_id").agg(F.countDistinct("frame_idx").alias("written_frames"), F.count("*").alias("points"))
    asked = requested.groupBy("event_id").agg(F.count("*").alias("frames"))
    return asked.join(of, "event_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("written_frames", "points")})


def first_of(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The first rows of each key, ``most`` at most."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")
