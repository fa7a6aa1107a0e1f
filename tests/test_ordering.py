"""Places and running totals over whole tables, against pandas."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracklane.operators import ordering as O

N = 20_000


@pytest.fixture(scope="module")
def rows(spark):
    """Two thirds of the rows have one text, many of the rest none."""
    k = F.when(F.col("id") % 3 > 0, "a").when(F.col("id") % 7 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("k"), F.col("id") % 50))
    return spark.range(N).select(k.alias("k"), ((F.col("id") * 7919) % N).alias("v"), (F.col("id") % 2).alias("two"))


def ordered(df, by):
    return df.toPandas().sort_values(by, na_position="first").reset_index(drop=True)


def test_no_range_is_large(rows):
    for order in (["two"], ["k"], ["k", "v"]):
        sizes = O.in_ranges(rows, order, 500).groupBy("_range").count().toPandas()["count"]
        assert len(sizes) == N // 500 and sizes.max() < 3 * 500


def test_ranges_grow_with_the_rows(rows):
    few = O.in_ranges(rows.where("v < 2000"), ["k"], 500).select("_range").distinct().count()
    assert few == 4


def test_places(rows):
    assert (ordered(O.number_rows(rows, ["k", "v"], "place", 500), ["k", "v"])["place"] == pd.RangeIndex(1, N + 1)).all()
    down = O.number_rows(rows, [F.desc_nulls_last("k"), F.desc("v")], "place", 500).toPandas().sort_values("place")
    assert down["k"].iloc[0] == "k9" and down["k"].iloc[-1] is None and sorted(down["place"]) == list(range(1, N + 1))


def test_places_within(rows):
    got = ordered(O.number_within(rows, ["k"], ["v"], "i", 500, "n", "g"), ["k", "v"])
    assert (got["g"] == (got["k"].fillna("") != got["k"].fillna("").shift()).cumsum() - 1).all()
    assert (got["i"] == got.groupby("k", dropna=False).cumcount()).all()
    assert (got["n"] == got.groupby("k", dropna=False)["v"].transform("size")).all()


def test_running_total(rows):
    got = ordered(O.running_total(rows, ["k", "v"], "v", "total", 500), ["k", "v"])
    assert (got["total"] == got["v"].cumsum()).all()


def test_no_rows(rows):
    none = rows.limit(0)
    assert O.number_rows(none, ["k"], "place").isEmpty() and O.number_within(none, ["k"], ["v"], "i").isEmpty() and O.running_total(none, ["v"], "v", "t").isEmpty()


def test_equal_rows_have_places_of_their_own(spark):
    same = spark.range(5000).select(F.lit("x").alias("k"))
    places = O.number_rows(same, ["k"], "place", 500)
    assert sorted(r.place for r in places.collect()) == list(range(1, 5001))


def test_tables_go_with_the_application(tmp_path):
    """A table is there as long as its application, and no longer."""
    import os
    import subprocess
    import sys

    code = (
        "from pyspark.sql import SparkSession\n"
        f"s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', '{tmp_path}').getOrCreate()\n"
        "from tracklane.scratch import Tables\n"
        "import os\n"
        f"print(Tables(s, 't').put(s.range(5), 'a').count(), sum(n.startswith('t-') for n in os.listdir('{tmp_path}')))\n"
    )
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, check=True)
    assert done.stdout.split() == ["5", "1"] and not [n for n in os.listdir(tmp_path) if n.startswith("t-")]
