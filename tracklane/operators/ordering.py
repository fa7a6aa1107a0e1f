"""Row numbers and running totals over a whole table, without a window that one task would have to hold.

Rows are cut into ranges of the whole tuple of order columns, texts included, at
bounds that Spark samples; equal tuples are told apart by where they came from,
so that no range is large because a value is frequent.  The number of ranges
grows with the rows.  The input is worked out once, as a table in the shared
folder; the ordered rows are a second one, which fixes each row's place: what is
read later can't depend on another sample of bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Tables

#: Rows of a range, about.
RANGE_ROWS = 1 << 20
#: A partition's number is in the bits above these of monotonically_increasing_id.
_PLACE_BITS = 33


def in_ranges(rows: DataFrame, order: list[str | Column], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with _range and _place, their place from 0 in it; ranges and places ascend by ``order`` (nulls first unless it says otherwise)."""
    tables = Tables(rows.sparkSession, "ordered")
    once = tables.put(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    ranges = max(1, -(-once.count() // range_rows))
    ordered = once.repartitionByRange(ranges, *order, "_row").sortWithinPartitions(*order, "_row").drop("_row")
    out = tables.put(ordered.withColumn("_id", F.monotonically_increasing_id()), "ordered")
    tables.drop("rows")
    place = F.col("_id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return out.withColumns({"_range": F.shiftright("_id", _PLACE_BITS).cast("int"), "_place": place}).drop("_id")


def _offsets(totals: DataFrame, by: list[str], total: str) -> DataFrame:
    """(_range, by, _before): the sum of ``total`` over the earlier ranges of each ``by``; as many rows as ranges a window, at most."""
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("_before", F.coalesce(F.sum(total).over(earlier), F.lit(0)))


def number_rows(rows: DataFrame, order: list[str | Column], name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with ``name``, their place from 1 in ascending order of the columns ``order``."""
    placed = in_ranges(rows, order, range_rows)
    counts = _offsets(placed.groupBy("_range").agg(F.count("*").alias("_n")), [], "_n")  # one row a range
    out = placed.join(F.broadcast(counts.select("_range", "_before")), "_range")
    return out.withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_range", "_place", "_before")


def number_within(rows: DataFrame, by: list[str], order: list[str], name: str, range_rows: int = RANGE_ROWS, size: str | None = None, group: str | None = None) -> DataFrame:
    """``rows`` with ``name``, their place from 0 among the rows of the same ``by``.

    Also with ``size``, how many these are, and ``group``, the place from 0 of their
    ``by`` among all, where names are given for them.  One ``by`` with most of the rows
    is many ranges, and many small ones share a range.  Nulls in ``by`` are a value of their own.
    """
    placed = in_ranges(rows, [*by, *order], range_rows).withColumn("_by", F.struct(*by))  # equal structs may hold nulls
    groups = placed.groupBy("_range", "_by").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    groups = _offsets(groups, ["_by"], "_n").withColumn("_all", F.sum("_n").over(Window.partitionBy("_by")))
    out = {name: F.col("_before") + F.col("_place") - F.col("_first")}
    if size:
        out[size] = F.col("_all")
    if group:
        groups = groups.join(number_rows(groups.where("_before = 0").select("_by"), ["_by"], "_group", range_rows), "_by")
        out[group] = F.col("_group") - 1
    return placed.join(groups, ["_range", "_by"]).withColumns(out).drop("_range", "_place", "_by", "_n", "_first", "_before", "_all", "_group")


def running_total(rows: DataFrame, order: list[str], value: str, name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with ``name``, the sum of ``value`` over all rows up to each."""
    placed = in_ranges(rows, order, range_rows)
    totals = _offsets(placed.groupBy("_range").agg(F.sum(value).alias("_n")), [], "_n")  # one row a range
    here = F.sum(value).over(Window.partitionBy("_range").orderBy("_place"))
    out = placed.withColumn("_here", here).join(F.broadcast(totals.select("_range", "_before")), "_range")
    return out.withColumn(name, F.col("_before") + F.coalesce("_here", F.lit(0))).drop("_range", "_place", "_here", "_before")
