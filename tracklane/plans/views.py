"""The operators' inputs, drawn from the general tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track samples: a user's events in order of time."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        F.lit(1).alias("video_id"), F.col("user_id").alias("track_id"), F.struct(micros.alias("us"), "event_id").alias("ord"), F.col("event_id").alias("frame"),
        (micros / 1e6).alias("t"), (k / 100).alias("cx"), (F.col("value") / 500).alias("cy"), F.col("value").alias("area"),
        F.col("event_type").alias("cls"), F.lit(None).cast("double").alias("bottom_y"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"), (k / 100).alias("plate_score"),
    )


#: The same rows in DuckDB.
SAMPLES = """SELECT 1 AS video_id, user_id AS track_id, event_id AS frame, ts, event_id, epoch_us(ts)/1e6::DOUBLE AS t,
 k/100::DOUBLE AS cx, value/500::DOUBLE AS cy, value AS area, event_type AS cls, CAST(NULL AS DOUBLE) AS bottom_y,
 least(value/100::DOUBLE, 1.0::DOUBLE) AS confidence, k/100::DOUBLE AS plate_score,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 AS i, count(*) OVER (PARTITION BY user_id) AS n
FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS DOUBLE) AS k FROM events)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points: the first three components of the vectors, fifty a frame."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: F.col("embedding")[i].cast("double")
    return e.select(
        F.lit(1).alias("capture_id"), F.floor(F.col("vec_id") / 50).alias("frame_idx"), F.col("vec_id").alias("ord"), (F.floor(F.col("vec_id") / 50) * 0.1).alias("t"),
        at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), F.col("label").cast("long").alias("laser"),
    )


POINTS = """SELECT 1 AS capture_id, vec_id//50 AS frame_idx, vec_id AS ord, (vec_id//50)*0.1::DOUBLE AS t, CAST(embedding[1] AS DOUBLE) AS x,
 CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(label AS BIGINT) AS laser FROM embeddings"""


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories: a user's events, value - 35 as the signed way ahead."""
    s = samples(spark, sf_dir)
    w = Window.partitionBy("track_id").orderBy("ord")
    x, y = F.col("cx") * 10 - 5, F.col("area") - 35
    rows = s.select("track_id", "t", x.alias("x"), y.alias("y"), F.sqrt(x * x + y * y).alias("distance"), F.row_number().over(w).alias("rn"), "plate_score")
    return rows.withColumn("speed", F.when(F.col("rn") > 1, F.col("plate_score") * 40)).drop("plate_score")


TRAJECTORY = f"""SELECT track_id, t, x, y, sqrt(x*x+y*y) AS distance, rn, CASE WHEN rn>1 THEN p*40 END AS speed
FROM (SELECT track_id, t, cx*10-5 AS x, area-35 AS y, i+1 AS rn, plate_score AS p FROM ({SAMPLES}))"""
