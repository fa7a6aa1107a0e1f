"""Shared tables and graph grouping for the document operators."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import number_rows
from ..scratch import Tables

#: Ids that are sent to all tasks at most (some 100 MB); more are shuffled.
SENT_IDS = 2_000_000


def release(spark: SparkSession) -> None:
    """Let the driver forget finished queries, so that Spark removes their shuffle files."""
    spark.range(1).isEmpty()  # listeners hold on to the last query
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows at most, for jobs whose rows are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Scratch(Tables):
    """Intermediate tables of an operator; with each the shuffles of what it was made of go."""

    def put(self, df: DataFrame, name: str) -> DataFrame:
        out = super().put(df, name)
        release(self.spark)
        return out


def by_ids(rows: DataFrame, ids: DataFrame, how: str, column: str = "doc_id") -> DataFrame:
    """Rows whose ``column`` is among ``ids`` (left_semi) or not (left_anti); few ids go to the rows, many meet them in a shuffle."""
    ids = ids.select(F.col(ids.columns[0]).alias(column))
    return rows.join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, column, how)


def spread_join(left: DataFrame, right: DataFrame, on: str, by: str, rows: int, counts: DataFrame | None = None) -> DataFrame:
    """Inner join of ``left`` (of so many ``rows``) to ``right``, which has few rows for each key.

    A key of more than 1/1024 of the rows, and of more than 1000, is dealt by the
    hash of ``by`` over as many tasks as it needs; at most 1024 keys are such.
    ``counts``: (key, n), how often the keys occur in ``left``, if known.
    """
    most = max(1000, rows // 1024)
    counts = left.groupBy(on).agg(F.count("*").alias("n")) if counts is None else counts
    hot = F.broadcast(counts.where(F.col("n") > most).select(on, F.ceil(F.col("n") / most).alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = left.join(hot, on, "left").withColumn("_part", F.pmod(F.xxhash64(by), parts))
    copied = right.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return dealt.drop("_parts").join(copied.drop("_parts"), [on, "_part"]).drop("_part")


def _content(column: str) -> Column:
    return F.xxhash64(F.coalesce(column, F.lit("")))


def told_apart(docs: DataFrame, scratch: Scratch, content: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """``docs`` (doc_id, a string ``content``, ...) with each doc_id once, null ones apart, and the way back.

    The way back is None where nothing had to change.  Else equal rows have become
    one and each content of a doc_id a document of its own: doc_id is a number in
    order of doc_id and of the content's hash, and the way back has (doc_id, own, t),
    with own the doc_id of before and t that hash.
    """
    known = docs.where("doc_id IS NOT NULL")
    if known.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs, None
    known = known.withColumnRenamed("doc_id", "own").withColumn("t", _content(content))
    keys = scratch.put(number_rows(known.select("own", "t").distinct(), ["own", "t"], "doc_id"), "texts")
    once = known.dropDuplicates(["own", "t"]).join(keys, ["own", "t"]).select(docs.columns)
    return scratch.put(once.unionByName(docs.where("doc_id IS NULL")), "once"), keys


def told_together(found: DataFrame, docs: DataFrame, keys: DataFrame | None, ids: tuple[str, ...], content: str = "text") -> DataFrame:
    """``found``, one row per doc_id of :func:`told_apart`, for the rows of ``docs``: all ``ids`` are doc_ids of before again."""
    if keys is None:
        return found
    for c in ids:
        if c != "doc_id":
            found = found.join(keys.select(F.col("doc_id").alias(c), F.col("own").alias("_own")), c, "left").withColumn(c, F.col("_own")).drop("_own")
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("own"), _content(content).alias("t")).join(keys, ["own", "t"])
    again = rows.join(found, "doc_id").withColumn("doc_id", F.col("own")).select(found.columns)
    return again.unionByName(found.where("doc_id IS NULL"))


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """Connected components of an undirected graph: (id, component), for ids with an edge.

    ``edges`` has the long columns a and b.  Large-star and small-star rounds by
    aggregation and join alone: no group of neighbours is ever gathered, and those
    of a node with very many are dealt over several tasks.  ``component`` is the least id reachable.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    links = scratch.put(links, f"{name}-0")
    turn = 0
    while True:
        rows = 2 * links.count()
        both = links.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(links.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"), F.count("*").alias("n"))
        large = spread_join(both, least.drop("n"), "x", "y", rows, least).where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u"))
        large = large.unionByName(least.where("x <> m").select(F.col("x").alias("v"), F.col("m").alias("u"))).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, least.drop("n"), "v", "u", rows, least).select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e"))
        turn += 1
        after = scratch.put(small.select("e.v", "e.u").where("v <> u").distinct(), f"{name}-{turn}")
        stars = after.groupBy("v").agg(F.count("*").alias("n"), F.min("u").alias("u"))
        # a forest of stars: each node has one parent, and no parent has a parent
        rest = stars.where("n > 1").count() or stars.select("u").distinct().join(stars.select(F.col("v").alias("u")), "u", "left_semi").count()
        scratch.drop(f"{name}-{turn - 1}")
        links = after
        if not rest:
            break
    roots = links.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct()
    return links.select(F.col("v").alias("id"), F.col("u").alias("component")).unionByName(roots)
