"""Merkle manifest of a dataset: leaves, trees of their digests, and a proof for each leaf.

A digest is the hexadecimal sha256 of concatenated inputs, digests among them as
text.  A leaf is the digest of a row's fields, each with its length before it.  The
leaves of a source ascend by doc_id and form a tree whose nodes are the digests of
up to FAN consecutive ones below; what remains of each source is the subroot, and
the subroots in order of the sources form the tree of the root.

Nodes are materialised by runs: a row (tree, level, run) holds the digests of up to
FAN siblings.  From its index and its tree's size a leaf explodes the coordinates
of the runs that hold its siblings, one a level and with its own place there, joins
the node table, and orders, concatenates and folds what it found.  Runs of the
upper levels, few and asked for by very many leaves, are sent to the tasks; those
below are asked for by few leaves each and joined by a shuffle.

Leaves are numbered by ranges of (source, doc_id), so that a source with most of
the rows is many tasks' work.  Null sources are one source, before all others;
null doc_ids come first in theirs.  Rows that share doc_id and source ascend by leaf, and equal rows
have a leaf each.  Null and empty texts differ.  Other columns are left out.  An
empty table has no rows and no root.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import number_within
from .common import Scratch, spread_join

BITS = 4
FAN = 1 << BITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Runs (of at most 32 * FAN bytes) that are sent to all tasks at most.
SENT_RUNS = 100_000
#: The tree of the subroots; those of sources count from 0.
TOP = -1


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**other: Column) -> Column:
    """The digest of a row, with ``other`` values for some of its fields."""
    return F.sha2(F.concat(*(field(other.get(c, F.col(c))) for c in FIELDS)), 256)


def height(n: Column) -> Column:
    """Levels of runs above n nodes: the digits of n - 1 to the base FAN, 16."""
    return F.when(n > 1, F.length(F.hex(n - 1))).otherwise(0)


def levels_of(n: int) -> int:
    return len(f"{n - 1:x}") if n > 1 else 0


def _text(digests: Column) -> Column:
    return F.lower(F.hex(digests))


@dataclass
class Manifest:
    """``leaves`` (doc_id, source, leaf, claimed, tree, i, n), the ``runs`` by level as (tree, level, run, digests), the number of trees and the root."""

    scratch: Scratch
    leaves: DataFrame
    runs: list[DataFrame]
    trees: int
    root: str | None

    def node_table(self, lowest: int = 0, below: int = 1 << 30) -> DataFrame:
        """All runs of levels from ``lowest`` on and under ``below``, both kinds of trees."""
        none = self.leaves.where("false").select("tree", F.lit(0).alias("level"), F.col("i").alias("run"), F.unhex("leaf").alias("digests"))
        return reduce(DataFrame.unionByName, self.runs, none).where((F.col("level") >= lowest) & (F.col("level") < below))


def _climb(nodes: DataFrame, most: int, scratch: Scratch, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The runs above ``nodes`` (tree, i, n, digest), a table a level, and the last (tree, digest) of each tree; ``most`` is the largest n."""
    runs, tops = [], nodes.where("n = 1").select("tree", "digest")
    for level in range(levels_of(most)):
        below = nodes.where("n > 1").groupBy("tree", F.shiftright("i", BITS).alias("run"), "n")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "digest"))), lambda x: x["digest"]), "")  # at most FAN
        here = scratch.put(below.agg(F.unhex(joined).alias("digests")).select("tree", F.lit(level).alias("level"), "run", "n", "digests"), f"{name}-{level}")
        nodes = here.select("tree", F.col("run").alias("i"), F.shiftright(F.col("n") + FAN - 1, BITS).alias("n"), F.sha2(_text(F.col("digests")), 256).alias("digest"))
        tops = tops.unionByName(nodes.where("n = 1").select("tree", "digest"))
        runs.append(here.drop("n"))
    return runs, tops


def build(docs: DataFrame, claimed: Column | None = None) -> Manifest:
    """The manifest of all rows of ``docs``; ``claimed`` is the text by which each row is to be verified, its own by default."""
    scratch = Scratch(docs.sparkSession, "manifest")
    rows = docs.select(*FIELDS, (F.col("text") if claimed is None else claimed).alias("claimed"))
    rows = rows.select("doc_id", "source", leaf().alias("leaf"), F.when(~F.col("claimed").eqNullSafe(F.col("text")), leaf(text=F.col("claimed"))).alias("other"))
    rows = rows.select("doc_id", "source", "leaf", F.coalesce("other", "leaf").alias("claimed"))
    leaves = scratch.put(number_within(rows, ["source"], ["doc_id", "leaf"], "i", size="n", group="tree"), "leaves")
    most, trees = leaves.agg(F.max("n"), F.coalesce(F.max("tree") + 1, F.lit(0))).first()
    runs, tops = _climb(leaves.select("tree", "i", "n", F.col("leaf").alias("digest")), most or 0, scratch, "runs")
    tops = tops.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("i"), F.lit(trees).cast("long").alias("n"), "digest")
    above, top = _climb(tops, trees, scratch, "top")
    root = top.first()  # one row, or none
    return Manifest(scratch, leaves, runs + above, trees, root and root["digest"])


def _asks(m: Manifest) -> DataFrame:
    """A row per leaf and level: step (from the leaf up), the coordinate of the run that holds the siblings, and the leaf's slot in it."""
    step = "transform(if({h} > 0, sequence(0, {h} - 1), array()), l -> named_struct('step', {from_} + l, 'tree', {tree}, 'level', l, 'run', shiftright({i}, {bits} * (l + 1)), 'slot', cast(shiftright({i}, {bits} * l) % {fan} as int)))"
    own = step.format(h="h", from_="0", tree="tree", i="i", bits=BITS, fan=FAN)
    top = step.format(h=levels_of(m.trees), from_="h", tree=f"{TOP}L", i="tree", bits=BITS, fan=FAN)
    rows = m.leaves.select("doc_id", "leaf", "claimed", "tree", "i", height(F.col("n")).alias("h"))
    rows = rows.repartition("tree", "i")  # what a leaf found comes together where it is
    return rows.select("doc_id", "leaf", "claimed", "tree", "i", "h", F.explode_outer(F.expr(f"concat({own}, {top})")).alias("at"))


def proofs(m: Manifest, sent: int | None = None) -> DataFrame:
    """(doc_id, leaf, claimed, h, steps): for each leaf the runs that hold its siblings from the leaf up, with its slots; the first h are its source's."""
    sent = SENT_RUNS if sent is None else sent
    sizes = dict(m.node_table().groupBy("level").count().collect())  # a row a level
    level, total = len(sizes), 0
    while level and total + sizes[level - 1] <= sent:
        level -= 1
        total += sizes[level]
    keys, own = ["tree", "level", "run"], ["tree", "i"]
    asks = _asks(m)
    step = F.struct("at.step", "at.slot", "digests")
    upper = m.node_table(level).select(F.struct(*keys).alias("place"), "digests")  # at most ``sent``
    place = F.struct(*(F.col(f"at.{k}") for k in keys))
    found = asks.join(F.broadcast(upper), place == F.col("place"), "left")
    found = found.groupBy(*own, "doc_id", "leaf", "claimed", "h").agg(F.collect_list(F.when(F.col("digests").isNotNull(), step)).alias("steps"))
    if level:
        low = asks.where(F.col("at.level") < level).select(*own, F.col("at.step").alias("step"), F.col("at.slot").alias("slot"), place.alias("place"))
        table = m.node_table(0, level).select(F.struct(*keys).alias("place"), "digests")
        sources = low.where(F.col("place.tree") != TOP).join(table.where(F.col("place.tree") != TOP), "place")
        tops = low.where(F.col("place.tree") == TOP)  # a run may be asked for by most of the leaves
        tops = spread_join(tops, table.where(F.col("place.tree") == TOP), "place", "i", tops.count())
        more = sources.unionByName(tops).groupBy(*own).agg(F.collect_list(F.struct("step", "slot", "digests")).alias("more"))
        found = found.join(more, own, "left").withColumn("steps", F.concat("steps", F.coalesce("more", F.array().cast(found.schema["steps"].dataType))))
    return found.select("doc_id", "leaf", "claimed", "h", F.array_sort("steps").alias("steps"))


def _left(x: Column) -> Column:
    return _text(F.substring(x["digests"], F.lit(1), 32 * x["slot"]))


def _right(x: Column) -> Column:
    return _text(F.substring(x["digests"], 32 * x["slot"] + 33, F.lit(32 * FAN)))


def fold(start: Column, steps: Column) -> Column:
    """The digest that ``start`` and the siblings lead to."""
    return F.aggregate(steps, start, lambda digest, x: F.sha2(F.concat(_left(x), digest, _right(x)), 256))


def verify(m: Manifest, sent: int | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded_root, verified): proof is the text of all siblings, folded_root what the claimed leaf leads to."""
    root, siblings = F.lit(m.root).cast("string"), F.transform("steps", lambda x: F.concat(_left(x), _right(x)))
    folded = proofs(m, sent).withColumn("folded_root", fold(F.col("claimed"), F.col("steps")))
    subroot = F.when(F.col("h") > 0, F.sha2(_text(F.get("steps", F.col("h") - 1)["digests"]), 256)).otherwise(F.col("leaf"))
    return folded.select("doc_id", "leaf", subroot.alias("subroot"), root.alias("root"), F.array_join(siblings, "").alias("proof"), "folded_root", (F.col("folded_root") == root).alias("verified"))
