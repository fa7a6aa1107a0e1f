"""The rows of exported files, in their fixed formats, and their writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import final
from . import telemetry, workbooks
from .named import BOM, NamedText, csv_line, write_csv, write_files


def _fixed(value: Column | str, digits: int) -> Column:
    """A number with so many decimals, rounded by its exact value up to 2**53 units of the last one."""
    return F.format_string(f"%.{digits}f", T.round_exact(F.col(value) if isinstance(value, str) else value, digits))


def event_rows(events: DataFrame) -> DataFrame:
    """The detector's thirteen columns from event_id, vehicle_type, detector_class, side, times, plate_score, plate_hits and source_video."""
    two = lambda c, name: _fixed(c, 2).alias(name)
    return events.select(
        "event_id", F.col("vehicle_type").alias("class"), "detector_class", "side", two("global_t_start", "t_start_s"), two("global_peak_t", "peak_t_s"), two("global_t_end", "t_end_s"),
        two(F.col("global_t_end") - F.col("global_t_start"), "duration_s"), _fixed("plate_score", 3).alias("kei_plate_score"), F.col("plate_hits").alias("kei_plate_hits"),
        F.regexp_extract("source_video", "[^/]*$", 0).alias("source_video"), two("t_start", "local_t_start_s"), two("t_end", "local_t_end_s"),
    )


def roi_rows(points: DataFrame) -> DataFrame:
    """Selected points in the columns of a region file, with capture_id and frame_idx to write by."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    shown = lambda digits, c, name: _fixed(c, digits).alias(name)
    return points.select(
        "capture_id", "frame_idx", "ord", F.col("frame_idx").alias("Frame"), shown(6, "t", "Time"), F.col("laser").alias("Laser ID"), F.col("intensity").alias("Intensity"),
        shown(4, F.sqrt(x * x + y * y + z * z), "Distance"), shown(3, F.degrees(F.atan2(x, y)), "Azimuth"), shown(3, F.degrees(F.atan2(z, F.hypot(x, y))), "Elevation"),
        F.lit(1).alias("Selected"), shown(4, "x", "Points:0"), shown(4, "y", "Points:1"), shown(4, "z", "Points:2"),
    )


#: Columns of a region file.
REGION_COLUMNS = ("Frame", "Time", "Laser ID", "Intensity", "Distance", "Azimuth", "Elevation", "Selected", "Points:0", "Points:1", "Points:2")
#: Columns of a trajectory file.
TRAJECTORY_COLUMNS = ("unixtime", "X", "Y", "Z", "distance(m)", "speed(km/h)")
#: Names of files are those that readers look for; names of telemetry files that are not the key itself.
SUFFIXES = {"GPS5": "gps"}


def write_events(events: DataFrame, path: str) -> None:
    """The detector's list of events: one file, in order, with a byte-order mark."""
    write_csv(event_rows(events), path, F.lit("overtaking_events.csv"), [F.col("event_id").cast("long")])


def write_frame_regions(points: DataFrame, frames: DataFrame, path: str) -> None:
    """A file for each of frames(frame_idx, t), those without points included, named by frame and time."""
    points.sparkSession.dataSource.register(NamedText)
    name = F.format_string("lidar_%06d_%010.3f.csv", "frame_idx", T.round_exact(F.col("t"), 3))
    named = frames.select("frame_idx", name.alias("name"))
    rows = roi_rows(points).join(named, "frame_idx").select("name", F.lit(1).alias("_h"), "ord", csv_line([F.col(f"`{c}`") for c in REGION_COLUMNS]).alias("line"))
    head = named.select("name", F.lit(0).alias("_h"), F.lit(0).cast("long").alias("ord"), F.lit(",".join(REGION_COLUMNS)).alias("line"))
    write_files(rows.unionByName(head), path, "named_text", ["_h", "ord"], lead=BOM)


def write_event_regions(points: DataFrame, path: str) -> None:
    """A file for each event_id with the points of its frames, in order of frames and points."""
    points.sparkSession.dataSource.register(NamedText)
    name = F.concat(F.lit("overtaking_"), T.safe_id(F.coalesce(F.col("event_id").cast("string"), F.lit(""))), F.lit(".csv"))
    shaped = roi_rows(points.withColumn("capture_id", name)).withColumnRenamed("capture_id", "name")
    rows = shaped.select("name", "frame_idx", "ord", csv_line([F.col(f"`{c}`") for c in REGION_COLUMNS]).alias("line"))
    write_files(rows, path, "named_text", ["frame_idx", "ord"], lead=f"{BOM}{','.join(REGION_COLUMNS)}\r\n")


def trajectory_rows(frames: DataFrame) -> DataFrame:
    """Trajectory files' columns from frames(name, t, time_text, x_text, y_text, z_text, distance, speed)."""
    text = (F.col("time_text"), F.col("x_text"), F.col("y_text"), F.col("z_text"), T.general(F.col("distance")), F.when(F.col("distance").isNotNull(), T.general(F.col("speed"))))
    return frames.select("name", "t", *(c.alias(n) for c, n in zip(text, TRAJECTORY_COLUMNS, strict=True)))


def write_trajectories(frames: DataFrame, path: str) -> None:
    """``<name>_edit.csv`` for each name, in order of time; no frames at all is an error."""
    if frames.isEmpty():
        raise ValueError("no frames")
    rows = trajectory_rows(frames)
    rows.sparkSession.dataSource.register(NamedText)
    lines = rows.select(F.concat("name", F.lit("_edit.csv")).alias("name"), "t", csv_line([F.col(f"`{c}`") for c in TRAJECTORY_COLUMNS]).alias("line"))
    write_files(lines, path, "named_text", ["t"], lead=f"{BOM}{','.join(TRAJECTORY_COLUMNS)}\r\n")


def write_telemetry(measured: DataFrame, path: str) -> None:
    """``<video>/telemetry_<key>.csv`` for each stream of each video: time and values, the columns those of its first row."""
    measured.sparkSession.dataSource.register(NamedText)
    suffix = F.lower("key")
    for key, other in SUFFIXES.items():
        suffix = F.when(F.col("key") == key, other).otherwise(suffix)
    known = F.create_map(*(x for key, names in telemetry.COLUMNS.items() for x in (F.lit(key), F.array(*map(F.lit, names)))))
    rows = measured.withColumn("name", F.concat(T.stem(F.col("video")), F.lit("/telemetry_"), suffix, F.lit(".csv")))
    order = list(telemetry.ORDER)
    names, n = F.coalesce(F.try_element_at(known, "key"), F.array().cast("array<string>")), F.size("vals")
    more = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i >= F.size(names)), lambda i: F.concat(F.lit("col"), i.cast("string")))
    head = F.concat_ws(",", F.lit("time_s"), F.slice(names, F.lit(1), n), more)
    lines = rows.select("name", *order, F.concat_ws(",", _fixed("t", 6), F.transform("vals", lambda v: T.general(v, 8))).alias("line"), head.alias("head"))
    write_files(lines, path, "named_text", order)


def gps_headers(unit: str) -> tuple[str, ...]:
    """Headers of a positions sheet."""
    return ("cts", "date", "GPS (Lat.) [deg]", "GPS (Long.) [deg]", "GPS (Alt.) [m]", f"GPS (2D speed) [{unit}]", "GPS (3D speed) [m/s]", "fix", "precision", "altitude system")


def write_positions(measured: DataFrame, path: str) -> None:
    """``<video>/telemetry_gps.xlsx`` for each video with positions: a sheet by seconds and one of all."""
    parts = []
    for sheet, unit in (("1", "k/s"), ("2", "m/s")):
        rows = telemetry.gps_rows(measured, sheet == "1")
        shown = rows.drop("video", *telemetry.ORDER)
        name = F.concat(T.stem(F.col("video")), F.lit("/telemetry_gps.xlsx"))
        parts.append(rows.select(name.alias("name"), F.lit(sheet).alias("sheet"), *telemetry.ORDER, workbooks.cells_of(shown).alias("cells"), workbooks.texts(gps_headers(unit)).alias("head")))
    workbooks.write_workbooks(parts[0].unionByName(parts[1]).withColumn("_s", F.col("sheet")), path, ["_s", *telemetry.ORDER])


def write_analysis(points: DataFrame, metrics: DataFrame, path: str) -> None:
    """``<name>_analysis.xlsx`` for each trajectory file: its rows as texts, the phases, and the metrics beside the first rows."""
    rows = final.analysis_rows(points, metrics)
    text = lambda c: workbooks.cell(c, "text")
    value = F.when(F.col("rn") == 1, text(F.lit(final.MARK_VALUE))).otherwise(workbooks.cell(F.col("mark_value"), "number"))
    cells = F.concat(F.transform("raw", lambda c: F.struct(c.alias("text"), F.lit(None).cast("double").alias("number"), F.lit(0).alias("style"))), F.array(text(F.col("phase")), text(F.lit("")), text(F.col("mark")), value, text(F.col("mark_unit"))))
    name = F.concat(T.stem(F.col("file")), F.lit("_analysis.xlsx"))
    head = workbooks.texts((*TRAJECTORY_COLUMNS, final.PHASE, "", "", "", ""))
    rows = rows.select(name.alias("name"), F.lit("走行挙動解析").alias("sheet"), F.col("rn").cast("long").alias("rn"), cells.alias("cells"), head.alias("head"))
    workbooks.write_workbooks(rows, path, ["rn"])


def write_reviewed(events: DataFrame, path: str, offset: float) -> None:
    """The reviewed list of events without those that were rejected; nothing left is an error."""
    rows = final.reviewed_rows(events, offset)
    if rows.isEmpty():
        raise ValueError("no events that were not rejected")
    write_csv(rows, path, F.lit("reviewed_overtaking_events.csv"), [F.when(F.col("event_id").rlike("^[0-9]+$"), F.col("event_id").try_cast("long")).otherwise(999999), F.col("event_id")])


def write_report(rows: DataFrame, path: str, name: str) -> None:
    """``<name>_final.xlsx`` from :func:`final.final_rows`: a page of rows at least, with formats and choices."""
    page = final.padded(rows)
    shown = page.select(*(F.col(f"`{h}`") for h in final.HEADERS))
    body = page.select("place", workbooks.cells_of(shown, final.STYLES).alias("cells"))
    head = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("place"), workbooks.texts(final.HEADERS, 1).alias("cells"))
    both = body.unionByName(head).select(F.lit(f"{name}_final.xlsx").alias("name"), (F.col("place") + 1).alias("number"), "cells")
    workbooks.write_large_workbooks(both, path, "Sheet1", final.LAYOUT)
