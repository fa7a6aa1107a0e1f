"""CSV inputs: events, trajectories and folders of frames; rows keep their place in the file."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .files import filesystem


def file_name() -> Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)


def placed(rows: DataFrame) -> DataFrame:
    """Rows of text files with file and ord, their place in it from 1."""
    rows = rows.withColumns({"file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()})
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("file").orderBy("_block", "_at"))).drop("_block", "_at")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of the detector or of a review: class in our vocabulary, review_status, class_reviewed and danger_level filled in."""
    rows = spark.read.csv(path, header=True)
    reviewed = "review_status" in rows.columns
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    filled = lambda c, other: F.coalesce(F.nullif(has(c), F.lit("")), F.lit(other))
    return rows.withColumns(
        {
            "detector_class": has("detector_class" if "detector_class" in rows.columns else "class"),
            "class": T.vehicle_class(has("class")),
            "class_reviewed": F.coalesce(F.lower(has("class_reviewed")).isin("1", "true", "yes"), F.lit(False)) if reviewed else F.lit(False),
            "review_status": filled("review_status", T.OPEN) if reviewed else F.lit(T.OPEN),
            "danger_level": filled("danger_level", "0"),
        }
    )


def read_trajectories(spark: SparkSession, path: str) -> DataFrame:
    """Valid rows of trajectory files: file, row_number (2 is the first behind the header), rn (from 1), t, x, y, z, distance, speed."""
    names = ("t", "x", "y", "z", "distance", "speed")
    rows = spark.read.csv(path, header=True, schema=", ".join(f"{c} string" for c in names) + ", _bad string", columnNameOfCorruptRecord="_bad")
    rows = placed(rows).where("_bad IS NULL OR size(split(_bad, ',')) >= 6")
    rows = rows.select("file", (F.col("ord") + 1).alias("row_number"), F.array(*(F.coalesce(c, F.lit("")) for c in names)).alias("raw"), *(F.expr(f"try_cast({c} AS double)").alias(c) for c in names))
    rows = rows.where("t IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND distance IS NOT NULL")
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("file").orderBy("row_number")))


#: A comma outside quotes.
_COMMA = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def read_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Points of a folder with one file a frame, named by its time: capture_id (the folder), frame_idx (the file's name), ord, t, x, y, z and their texts.

    A name's time is the name as a number, else the last number in it.  Names without
    one, and exported trajectories and events, are left out, as are rows without an eleventh cell.
    """
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    rows = lines(spark, f"{folder}/*.csv").where((F.col("ord") > 1) & (F.size("cells") >= 11)).withColumn("frame_idx", stem)
    rows = rows.withColumn("t", T.stem_time(F.col("frame_idx"))).where(F.col("t").isNotNull() & ~F.lower("frame_idx").rlike("_edit$|^overtaking_"))
    text = {n: F.col("cells")[k] for k, n in enumerate("xyz", 8)}
    return rows.select(F.lit(folder).alias("capture_id"), "frame_idx", (F.col("ord") - 1).alias("ord"), "t", *(c.try_cast("double").alias(n) for n, c in text.items()), *(c.alias(f"{n}_text") for n, c in text.items()))


#: Columns of a region file by their headers, with their places where a header lacks them.
REGION = {"Frame": 0, "Time": 1, "Points:0": 8, "Points:1": 9, "Points:2": 10}
#: Columns that tell a list of events with vehicle evidence from an older one.
EVIDENCE = frozenset(("detector_class", "kei_plate_score", "kei_plate_hits"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, cells): lines of CSV files as texts, whatever their headers."""
    rows = placed(spark.read.text(path).withColumn("value", F.regexp_replace("value", "^\ufeff|\r$", "")))
    return rows.select("file", "ord", cells("value").alias("cells"))


def cells(line: str) -> Column:
    """The cells of a line of CSV."""
    bare = lambda c: F.when(c.rlike('(?s)^".*"$'), F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c)
    return F.when(F.contains(F.col(line), F.lit('"')), F.transform(F.split(line, _COMMA, -1), bare)).otherwise(F.split(line, ",", -1))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """Points of region files with several frames each: file, ord, frame and time_text as they stand, x, y, z and their texts.

    Columns are found by the headers of each file; rows that are too short for them are left out.
    """
    rows = lines(spark, path)
    header = F.first("cells").over(Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    at = {name: F.coalesce(F.nullif(F.array_position(header, name), F.lit(0)), F.lit(k + 1)).cast("int") for name, k in REGION.items()}
    rows = rows.withColumns({f"_{k}": c for k, c in enumerate(at.values())}).where((F.col("ord") > 1) & (F.size("cells") >= F.greatest("_2", "_3", "_4")))
    cell = lambda k: F.try_element_at("cells", F.col(f"_{k}"))
    texts = {"frame": cell(0), "time_text": cell(1), "x_text": cell(2), "y_text": cell(3), "z_text": cell(4)}
    return rows.select("file", "ord", *(c.alias(n) for n, c in texts.items()), *(cell(k).try_cast("double").alias(n) for k, n in ((2, "x"), (3, "y"), (4, "z"))))


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def events_path(spark: SparkSession, folder: str) -> str:
    """The reviewed events of a folder, else the detector's."""
    for name in ("reviewed_overtaking_events.csv", "overtaking_events.csv"):
        if exists(spark, f"{folder}/{name}"):
            return f"{folder}/{name}"
    raise FileNotFoundError(f"{folder}: no events")


def lacks_evidence(events: DataFrame) -> bool:
    """Whether detector events are of the older kind, without vehicle evidence; reviewed ones never are."""
    return "review_status" not in events.columns and not EVIDENCE.issubset(events.columns)


def clip_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name): the files of a folder, by their names alone."""
    return spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"))


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        heads = []
        for path in batch["path"].to_pylist():
            fs, name = filesystem(path)
            with fs.open_input_file(name) as file:
                head = b""
                while b"\n" not in head and (more := file.read(1 << 14)):
                    head += more
            heads.append(head.split(b"\n")[0].decode("utf-8-sig", "replace").rstrip("\r"))
        yield pa.record_batch([batch["path"], pa.array(heads, pa.string())], ["path", "line"])


def check_frames(spark: SparkSession, folder: str) -> DataFrame:
    """(name, problem) for the CSV files of a folder in any case's order: null where the ninth and tenth columns are points.

    No more than the first line of a file is read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).where("length > 0").select("path")
    rows = files.mapInArrow(_first_lines, "path string, line string").select(F.element_at(F.split("path", "/"), -1).alias("name"), cells("line").alias("cells"))
    column = lambda k: F.lower(F.try_element_at("cells", F.lit(k)))
    problem = F.when(F.size("cells") < 10, "fewer than 10 columns").when(~(column(9).contains("point") & column(10).contains("point")), "columns 9 and 10 are no points")
    return rows.select("name", problem.alias("problem")).orderBy(F.lower("name"), "name")
