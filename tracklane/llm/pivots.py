"""Near-duplicate embeddings through a pivot-permutation index.

A vector is described by the order of its nearest reference points (pivots).  Each
pair of them whose ranks add up to ``depth`` at most names an inverted list, so
that pivots count the more the nearer they are, and vectors in a common list share
two pivots at least: the least shared-pivot count of a candidate.  In a list all
members are compared in double precision; a pair is counted in the first list that
both have in common.  Long lists are dealt out in blocks, and each pair of blocks
is a task's work of its own, so that no list is ever held whole and none is cut
short.  No pair leaves its list: members send their link counts and the edges of a
spanning forest.

Pivots are chosen from a bounded sample for each length of vectors; their number
grows with the root of the vectors', so that lists keep their length, and the depth
with its logarithm, so that recall holds.  Lengths that the sample lacks have
random directions for pivots.  Vectors of different lengths are never linked.

Equal vectors are one member with a multiplicity.  Input: vec_id (integer) and
embedding; others are ignored.  Vectors that are null, zero, or hold null or
non-finite components, and rows with a null vec_id, link with nothing.  Equal rows
of a vec_id are one vector; different vectors of one vec_id are vectors of their
own, which may link with each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SENT_IDS, Scratch, components, partitions, spread_join, told_apart, told_together

#: Vectors from which pivots are chosen at most, pivots at least and at most (of a length with enough vectors).
SAMPLE, FEWEST, MOST = 4096, 16, 2048
#: Members of a list that are compared at once, against as many others.
BLOCK = 600


def pivots_for(vectors: float) -> int:
    return int(min(MOST, max(FEWEST, math.sqrt(vectors) / 2)))


def depth(pivots: int) -> int:
    """Greatest sum of two ranks (from 0) that names a list."""
    return 5 + math.ceil(max(0.0, math.log2(max(1, pivots) / 128)))


def _choose(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots far from each other: greedy by the least cosine to those chosen."""
    if not len(sample):
        return sample
    chosen = [0]
    close = sample @ sample[0]
    while len(chosen) < min(count, len(sample)):
        best = int(close.argmin())
        if close[best] > 0.95:
            break
        chosen.append(best)
        close = np.maximum(close, sample @ sample[best])
    return sample[chosen]


def _random(dim: int) -> np.ndarray:
    x = np.random.Generator(np.random.PCG64(dim)).normal(size=(4 * FEWEST, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def lists(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Codes of the inverted lists of each unit vector."""
    if len(pivots) < 2:
        return np.zeros((len(x), 1), np.int32)
    most = depth(len(pivots))
    near = np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, : most + 1].astype(np.int32)
    k = near.shape[1]
    first, second = zip(*((i, j) for i in range(k) for j in range(i + 1, k) if i + j <= most), strict=True)
    a, b = near[:, list(first)], near[:, list(second)]
    return np.minimum(a, b) * np.int32(4 * MOST) + np.maximum(a, b)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, as squares of very large or small ones are no numbers."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _units(data: list[bytes], kind: type) -> np.ndarray:
    return _unit(np.frombuffer(b"".join(data), kind).reshape(len(data), -1).astype(float))


def _describe(pivots: dict[int, np.ndarray], kind: type):
    """Rows with the length of their vector, its bytes and its lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                lengths = pyarrow.compute.list_value_length(part["embedding"]).to_numpy()
                for dim in np.unique(lengths).tolist():
                    own = part.filter(pa.array(lengths == dim))
                    flat = own["embedding"].flatten().to_numpy(zero_copy_only=False).astype(kind)
                    data = [v.tobytes() for v in flat.reshape(-1, dim)]
                    codes = lists(_units(data, kind), pivots[dim] if dim in pivots else _random(dim))
                    at = np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32)
                    columns = [own["vec_id"], own["copies"], pa.array(np.full(len(data), dim)), pa.ListArray.from_arrays(at, pa.array(codes.ravel())), pa.array(data, pa.binary())]
                    yield pa.record_batch(columns, ["vec_id", "copies", "dim", "codes", "vector"])

    return run


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the links by union-find: (member, root)."""
    parent = list(range(n))

    def find(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(v, find(v)) for v in range(n) if find(v) != v]


def _met_before(codes: np.ndarray, a: np.ndarray, b: np.ndarray, code: int) -> np.ndarray:
    """Whether the members a and b share a list before this one."""
    out = np.zeros(len(a), bool)
    hidden = np.where(codes < code, codes, -1)
    for i in range(0, len(a), 50_000):
        x, y = hidden[a[i : i + 50_000]], codes[b[i : i + 50_000]]
        for k in range(codes.shape[1]):
            out[i : i + 50_000] |= ((x[:, k : k + 1] == y) & (x[:, k : k + 1] >= 0)).any(axis=1)
    return out


def _compare(threshold: float, kind: type):
    def group(t: pa.Table) -> pa.RecordBatch:
        code, cross = t["code"][0].as_py(), t["i"][0].as_py() != t["j"][0].as_py()
        ids, copies, side = t["vec_id"].to_numpy(), t["copies"].to_numpy(), t["salt"].to_numpy()
        codes = t["codes"].combine_chunks()
        codes = (codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes).flatten().to_numpy().reshape(len(ids), -1)
        x = _units(t["vector"].to_pylist(), kind)
        left, right = (side == t["i"][0].as_py(), side == t["j"][0].as_py()) if cross else (np.ones(len(ids), bool),) * 2
        l, r = np.flatnonzero(left), np.flatnonzero(right)
        linked = x[l] @ x[r].T >= threshold
        if not cross:
            linked = np.triu(linked, 1)
        a, b = np.nonzero(linked)
        a, b = l[a], r[b]
        new = ~_met_before(codes, a, b, code)
        a, b = a[new], b[new]
        count = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
        root = np.arange(len(ids))
        for v, u in _forest(a, b, len(ids)):
            root[v] = u
        some = np.flatnonzero(count > 0)
        return pa.record_batch([pa.array(ids[some]), pa.array(count[some].astype(np.int64)), pa.array(ids[root[some]])], ["vec_id", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not t.num_rows:
                continue
            keys = np.stack([t[c].to_numpy() for c in ("dim", "code", "i", "j")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, b in zip(np.r_[0, cuts[:-1]], cuts, strict=False) if len(cuts) else ():
                if b - a > 1:
                    yield group(t.slice(int(a), int(b - a)).combine_chunks())
            held = t.slice(int(cuts[-1])) if len(cuts) else t
        if held is not None and held.num_rows > 1:
            yield group(held.combine_chunks())

    return run


def _sample(own: DataFrame, total: int) -> dict[int, np.ndarray]:
    """Pivots by length, from SAMPLE vectors at most."""
    chance = min(1.0, 0.9 * SAMPLE / max(total, 1))
    picked = own.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * chance)).orderBy("vec_id").limit(SAMPLE).select("embedding").toPandas()["embedding"]
    by_length: dict[int, list] = {}
    for v in picked:
        by_length.setdefault(len(v), []).append(v)
    out = {}
    for dim, rows in by_length.items():
        x = np.array(rows, float)
        out[dim] = _choose(_unit(x), pivots_for(len(x) / chance))
    return {dim: p for dim, p in out.items() if len(p) >= FEWEST or chance == 1.0}


def near_duplicates(embeddings: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links (other vectors with cosine >= threshold), component_id (least vec_id reachable), kept."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "pivots")
    kind = np.float32 if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64
    fit = "embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)"
    digest = F.sha2(F.to_binary(F.concat_ws(",", F.transform("embedding", lambda x: x.cast("string"))), F.lit("utf-8")), 256)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("digest", F.when(F.expr(fit), digest))
    once, keys = told_apart(rows, scratch, "digest")
    good = once.where("doc_id IS NOT NULL AND digest IS NOT NULL").withColumnRenamed("doc_id", "vec_id")
    classes = scratch.put(good.groupBy("digest").agg(F.min("vec_id").alias("class"), F.count("*").alias("n")), "digests")
    total = good.count()
    members = spread_join(good.select("vec_id", "digest"), classes.withColumn("copies", F.col("n")).drop("n"), "digest", "vec_id", total, classes.select("digest", "n"))
    members = scratch.put(members.select("vec_id", "class", "copies"), "members")
    own = good.select("vec_id", "embedding").join(members.where("vec_id = class").select("vec_id", "copies"), "vec_id")
    own = scratch.put(own, "classes")
    described = own.mapInArrow(_describe(_sample(own, total), kind), "vec_id long, copies long, dim long, codes array<int>, vector binary")
    posted = scratch.put(described, "described").withColumn("code", F.explode("codes"))
    long = scratch.put(posted.groupBy("dim", "code").agg(F.count("*").alias("length")).where(F.col("length") > BLOCK), "lengths")
    if long.count() <= SENT_IDS:
        long = F.broadcast(long)
    dealt = posted.join(long, ["dim", "code"], "left").withColumn("blocks", F.coalesce(F.ceil(F.col("length") / BLOCK), F.lit(1)).cast("int"))
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("vec_id", "copies", "codes", "vector", "dim", "code", "salt", F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"))
    dealt = dealt.repartition(partitions(spark), "dim", "code", "i", "j").sortWithinPartitions("dim", "code", "i", "j")
    found = scratch.put(dealt.mapInArrow(_compare(threshold, kind), "vec_id long, links long, root long"), "found")
    counts = found.groupBy(F.col("vec_id").alias("class")).agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")), scratch, "groups")
    of = counts.join(groups.select(F.col("id").alias("class"), "component"), "class", "full")
    of = scratch.put(of, "of")
    n = members.groupBy("class").agg(F.count("*").alias("n"))
    every = n.select("class").join(of, "class", "left")
    out = spread_join(members, every, "class", "vec_id", total, n)
    out = out.select(F.col("vec_id").alias("doc_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class").alias("component_id"))
    out = once.select("doc_id").join(out, "doc_id", "left").select("doc_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "doc_id").alias("component_id"))
    out = told_together(out, rows, keys, ("doc_id", "component_id"), "digest").withColumnRenamed("doc_id", "vec_id")
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
