"""Fill-in-middle: a text's prefix, suffix and middle in another order, cut between units.

A unit is a run of ASCII letters or one other code point.  Two passes of a lazy
matcher go over a text: the first counts its units, the second advances to the two
ranks where it is cut and stops there.  No list of units exists, so that a task
needs the text at hand and nothing that grows with its units.

Where a document is cut and which form it gets depends on its id and the seed
alone.  Texts that are empty or hold a mark stay as they are, as do documents
without an id, which have no such numbers, and the share that is to stay plain.
A null text is an empty one; repeated rows have the same result each; columns
other than doc_id and text are left out.
"""

from __future__ import annotations

import re
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: What stands before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def cuts(text: str, first: int, second: int) -> tuple[int, int, int]:
    """(units, end of the prefix, end of the middle), the ends in code points; the two draws pick the ranks."""
    n = 0
    for n, _ in enumerate(UNIT.finditer(text), 1):  # noqa: B007
        pass
    units, done, at, ends = UNIT.finditer(text), 0, 0, []
    for rank in sorted((first % (n + 1), second % (n + 1))):
        if rank > done:
            at, done = next(islice(units, rank - done - 1, None)).end(), rank
        ends.append(at)
    return n, *ends


@F.arrow_udf(StructType([StructField(c, LongType()) for c in "nab"]))
def _cuts(text: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    found = (cuts(t.as_py(), x.as_py() or 0, y.as_py() or 0) for t, x, y in zip(text, first, second, strict=True))
    return pa.array([dict(zip("nab", f, strict=True)) for f in found], pa.struct([(c, pa.int64()) for c in "nab"]))


def draw(k: int, seed: str) -> Column:
    """The k-th number from 0 of a document: eight hexadecimal digits of a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: str = "1", rate: int = 90, spm_rate: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): n is the number of units.

    ``rate`` percent of the documents are cut; of these ``spm_rate`` percent have the
    suffix first (form spm), the others the prefix (psm); the rest is plain.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("cuts", _cuts("text", draw(0, seed), draw(1, seed)))
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | marked | F.coalesce(draw(2, seed) % 100 >= rate, F.lit(True))
    form = F.when(plain, "plain").when(draw(3, seed) % 100 < spm_rate, "spm").otherwise("psm")
    a, b = F.col("cuts.a").cast("int"), F.col("cuts.b").cast("int")
    prefix, middle, suffix = F.substring("text", F.lit(1), a), F.substring("text", a + 1, b - a), F.substring("text", b + 1, F.length("text"))
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle))
    cut = F.col("form") != "plain"
    return rows.withColumn("form", form).select(
        "doc_id", "cuts.n", "form", F.when(cut, F.col("cuts.a")).alias("prefix_chars"), F.when(cut, F.col("cuts.b") - F.col("cuts.a")).alias("middle_chars"), F.coalesce(output, "text").alias("output")
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of; marks occur nowhere else in it."""
    second = F.when(form == "psm", F.instr(output, SUFFIX)).otherwise(F.instr(output, PREFIX))
    third, skip = F.instr(output, MIDDLE), len(PREFIX)
    first = F.substring(output, F.lit(skip + 1), second - skip - 1)
    next_ = F.substring(output, second + skip, third - second - skip)
    last = F.substring(output, third + skip, F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, last, next_)).otherwise(F.concat(next_, last, first))
