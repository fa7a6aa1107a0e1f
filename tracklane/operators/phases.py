"""The four phases of a passing manoeuvre along a trajectory, and its metrics.

Rows have the columns of a trajectory's key, rn (position from 1), t, x, y,
distance and speed (nullable).  Phase 1 is the first row; phase 3 the first row
within NEAR of the side line (|y| < NEAR); phase 2 the last row before it slower
than SLOW, else its slowest; phase 4 the first row after phase 3 outside NEAR.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NEAR, SLOW, LEAST_DISTANCE = 3.0, 10.0, 1.0


def phases(rows: DataFrame, key: str) -> DataFrame:
    """One row per trajectory: status, the rows p1..p4 as structs (rn, t, y, speed), and lc of the rows from p3 to p4."""
    w = Window.partitionBy(key)
    near = F.abs("y") < NEAR
    rows = rows.withColumn("c3", F.min(F.when(near, F.col("rn"))).over(w))
    rows = rows.withColumn("c4", F.min(F.when((F.col("rn") > F.col("c3")) & ~near, F.col("rn"))).over(w))
    candidate = (F.col("c3").isNull() | (F.col("rn") < F.col("c3"))) & F.col("speed").isNotNull()
    at = F.struct("rn", "t", "y", "speed")
    section = F.col("rn").between(F.col("c3"), F.col("c4"))
    rows = rows.withColumn("slow", F.abs("speed"))
    out = rows.groupBy(key).agg(
        F.min_by(at, "rn").alias("p1"),
        F.max_by(at, F.when(candidate & (F.col("slow") < SLOW), F.col("rn"))).alias("p2_slow"),
        F.min_by(at, F.when(candidate, F.struct("slow", "rn"))).alias("p2_least"),
        F.min_by(at, F.when(F.col("rn") == F.col("c3"), F.col("rn"))).alias("p3"),
        F.min_by(at, F.when(F.col("rn") == F.col("c4"), F.col("rn"))).alias("p4"),
        F.abs(F.coalesce(F.min(F.when(section & (F.col("distance") >= LEAST_DISTANCE), F.col("x"))), F.min(F.when(section, F.col("x"))))).alias("lc"),
    )
    out = out.withColumn("p2", F.coalesce("p2_slow", "p2_least")).drop("p2_slow", "p2_least")
    status = F.when(F.col("p2").isNull(), "no phase 2").when(F.col("p3").isNull(), "no phase 3").when(F.col("p4").isNull(), "no phase 4")
    return out.withColumn("status", status.when(F.col("p4.t") == F.col("p3.t"), "no time between phases 3 and 4").otherwise("ok"))


def metrics(rows: DataFrame, key: str) -> DataFrame:
    """Phases with passing_time, distance_p2, distance_p3, relative_speed, ttc and lc; null where status is not ok."""
    found = phases(rows, key)
    ok = F.col("status") == "ok"
    time = F.col("p4.t") - F.col("p3.t")
    ahead = F.col("p4.y") - F.col("p3.y")
    relative = F.try_divide(ahead, time) * 3.6
    return found.select(
        key, "status", F.col("p1.rn").alias("p1"), F.col("p2.rn").alias("p2"), F.col("p3.rn").alias("p3"), F.col("p4.rn").alias("p4"), F.col("p3.t").alias("t3"), F.col("p4.t").alias("t4"),
        F.when(ok, time).alias("passing_time"), F.when(ok, F.abs("p2.y")).alias("distance_p2"), F.when(ok, ahead).alias("distance_p3"),
        F.when(ok, relative).alias("relative_speed"), F.when(ok, F.try_divide(F.abs("p2.y"), relative / 3.6)).alias("ttc"), F.when(ok, F.col("lc")).alias("lc"),
    )
