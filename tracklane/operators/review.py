"""Review of events: acceptance, order, last decision and the final report.

Events have at least event_id and review_status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def is_accepted() -> Column:
    """A blank or missing status counts as accepted."""
    return F.coalesce(F.nullif("review_status", F.lit("")), F.lit(T.ACCEPTED)) == T.ACCEPTED


def accepted(events: DataFrame) -> DataFrame:
    return events.where(is_accepted())


def not_rejected(events: DataFrame) -> DataFrame:
    return events.where(~F.col("review_status").eqNullSafe(T.REJECTED))


def report_order(event_id: str = "event_id") -> list[Column]:
    """Numeric ids by number, others behind them by text."""
    text = F.col(event_id).cast("string")
    return [F.when(text.rlike("^[0-9]+$"), text.try_cast("long")).otherwise(999999), text]


def latest(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row with the greatest seq of each key: the last write wins."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(*keys, *(F.col("_r")[c].alias(c) for c in rest))


def next_open(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """For each event the position of the next open one, going round to the first: one pass from the last event back."""
    w = Window.partitionBy(*keys)
    open_at = F.when(F.col("review_status") == T.OPEN, F.col(order))
    after = F.min(open_at).over(w.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("next_open", F.coalesce(after, F.min(open_at).over(w)))


def decide(events: DataFrame, decisions: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Events with the last of their decisions(event_id, status, seq), and next_open as it is after all of them."""
    last = latest(decisions, ["event_id"], "seq").select("event_id", F.col("status").alias("_status"))
    decided = events.join(last, "event_id", "left").withColumn("review_status", F.coalesce("_status", "review_status")).drop("_status")
    return next_open(decided, keys, order)


def progress(events: DataFrame, keys: list[str]) -> DataFrame:
    """How many events there are, and how many of them have been decided."""
    return events.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(F.col("review_status") != T.OPEN).alias("reviewed"))


def report(events: DataFrame, metrics: DataFrame, speeds: DataFrame) -> DataFrame:
    """Accepted events with their passing metrics and speeds; what is missing stays null and is named in ``warning``.

    events(event_id, review_status, vehicle_class, danger_level), metrics(event_id,
    status, relative_speed, ...), speeds(event_id, own_speed).
    """
    rows = accepted(events).join(metrics, "event_id", "left").join(speeds, "event_id", "left")
    warning = F.concat_ws(
        "; ",
        F.when(F.col("status").isNull(), "no trajectory").when(F.col("status") != "ok", F.col("status")),
        F.when(F.col("own_speed").isNull(), "no speed"),
    )
    return rows.select(
        "event_id", T.vehicle_class(F.col("vehicle_class")).alias("vehicle_class"), T.danger(F.col("danger_level")).alias("danger"),
        *(T.shown(F.col(c)).alias(c) for c in ("passing_time", "relative_speed", "ttc", "lc", "own_speed")),
        T.shown(F.col("own_speed") + F.col("relative_speed")).alias("vehicle_speed"), warning.alias("warning"),
    )
