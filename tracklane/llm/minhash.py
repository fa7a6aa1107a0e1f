"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union-find grouping.

A document is the set of its distinct five-word shingles (A-Z lower-cased).  With
SuperMinHash each element visits the signature's slots in its own random order
and carries values that rise with every step, so that a slot filled at a step is
never improved at a later one: the work ends at the first step that leaves no
slot empty.  Steps run for all elements of many documents at once.

Equal sets form one class: a cryptographic digest of the whole set names it, so
that members are confirmed on full sets.  Classes that share a band meet in a bucket; each is
compared with the bucket's least member on the full sets.  What stays apart in a
bucket after the links found are grouped is compared with the rest of the
bucket, unless a bound rules the link out.  One bound is the distances already
known (Jaccard distance is a metric).  The other serves buckets where many stay
apart: their documents' rare shingles are counted; a document with many of them
can only be linked to one that shares some, and those meet through the rare
shingles themselves.  So a bucket of n copies costs about n comparisons, not
n * n, and no pair of a bucket is left open.

Input: columns doc_id (integer) and text, others ignored.  Null or wordless
texts have an empty set and link with nothing.  Rows with a null doc_id come
back with their set size, no component and kept = true.  Equal rows of a doc_id
get the same result each; different texts of one doc_id are documents of their
own, each with the least doc_id that it reaches.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel
from .common import Scratch, by_ids, components, small_batches, spread_join, told_apart, told_together

U = np.uint64
BANDS, ROWS = 26, 5
SHINGLE = 5
#: Bytes of text that are sketched at once (or one longer document), and pairs of sets that are compared at once.
CHUNK, PAIRS = 1 << 19, 200
#: Documents that a Python worker gets at once: with texts, batches are large on both sides.
DOCUMENTS = 2000
#: Where more of a bucket stay apart than this, bounds decide which of them are compared.
SPARSE = 30
#: A shingle is rare if at most so many of the documents in such buckets have it.
RARE = 8


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document in ascending order, and each document's first (n + 1)."""
    raw = textkernel.lower(raw)
    starts, ends, firsts = textkernel.words(raw, offsets)
    spans = textkernel.Spans(textkernel.word_hashes(raw, starts, ends))
    n = np.diff(firsts)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), counts)
    a = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + firsts[:-1][doc]
    h = spans.hash(a, np.minimum(a + k, firsts[1:][doc]))
    by = np.lexsort((h, doc))
    h, doc = h[by], doc[by]
    if len(h):
        new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
        h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(n) + 1))


def super_minhash(h: np.ndarray, firsts: np.ndarray, slots: int = BANDS * ROWS) -> np.ndarray:
    """SuperMinHash signatures (documents x slots) of sets of 64-bit hashes; all ones where a set is empty."""
    n = len(firsts) - 1
    none = U(2**64 - 1)
    best = np.full(n * slots, none, np.uint64)
    doc = np.repeat(np.arange(n), np.diff(firsts))
    seen: list[np.ndarray] = []
    for step in range(slots):
        if not len(h):
            break
        draw = textkernel.mix(h + U(0x9E3779B97F4A7C15 * (2 * step + 1) % 2**64))
        pick = step + (textkernel.mix(draw ^ U(0x5851F42D4C957F2D)) % U(slots - step)).astype(np.int32)
        at = pick.copy()  # undo the earlier swaps of each element's permutation
        for t in range(step - 1, -1, -1):
            swapped, own = at == seen[t], at == t
            at[swapped] = t
            at[own & ~swapped] = seen[t][own & ~swapped]
        np.minimum.at(best, doc * slots + at, (U(step) << U(56)) | (draw >> U(8)))
        seen.append(pick)
        short = (best.reshape(n, slots) == none).any(axis=1)
        stay = short[doc]
        if not stay.all():
            h, doc, seen = h[stay], doc[stay], [s[stay] for s in seen]
    return best.reshape(n, slots)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, raw, offsets in textkernel.texts(batch["text"], CHUNK):
            h, firsts = shingle_sets(raw, offsets)
            sig = super_minhash(h, firsts)
            sizes = np.diff(firsts)
            digests = [blake2b(h[a:b], digest_size=16).digest() for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)]
            bands = np.zeros((j - i, BANDS), np.uint64)
            for r in range(ROWS):
                bands = textkernel.mix(bands * U(0x9E3779B97F4A7C15) + sig[:, r::ROWS])
            bands = textkernel.mix(bands + np.arange(BANDS, dtype=np.uint64))
            full = sizes > 0
            rows = np.flatnonzero(full)
            lists = pa.ListArray.from_arrays(np.arange(0, (len(rows) + 1) * BANDS, BANDS, dtype=np.int32), pa.array(bands[full].ravel().view(np.int64)))
            low = textkernel.mix(sig).astype(np.uint8)
            take = np.full(j - i, -1)
            take[rows] = np.arange(len(rows))
            index = pa.array(take, mask=~full)
            yield pa.record_batch(
                [batch["doc_id"].slice(i, j - i), pa.array(sizes), pa.array(digests, pa.binary()), lists.take(index), pa.array([x.tobytes() for x in low], pa.binary())],
                ["doc_id", "n", "digest", "bands", "low"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, raw, offsets in textkernel.texts(batch["text"], CHUNK):
            h, firsts = shingle_sets(raw, offsets)
            values = [h[a:b].tobytes() for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)]
            yield pa.record_batch([batch["doc_id"].slice(i, j - i), pa.array(values, pa.binary())], ["doc_id", "shingles"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each distinct shingle of a run of texts: how many of its documents have it, and which if at most RARE do."""
    for batch in batches:
        ids = batch["doc_id"].to_numpy()
        for i, j, raw, offsets in textkernel.texts(batch["text"], CHUNK):
            h, firsts = shingle_sets(raw, offsets)
            x = np.repeat(ids[i:j], np.diff(firsts))
            by = np.argsort(h, kind="stable")
            h, x = h[by], x[by]
            heads = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
            c = np.diff(np.append(heads, len(h)))
            few = c <= RARE
            at = np.r_[0, np.cumsum(np.where(few, c, 0))].astype(np.int32)
            xs = pa.ListArray.from_arrays(at, pa.array(x[np.repeat(few, c)]))
            yield pa.record_batch([pa.array(h[heads].view(np.int64)), pa.array(c), xs], ["h", "c", "xs"])


def _bound(n: str, r: str, m: str, q: str, shared: str, threshold: int) -> str:
    """Whether sets of n and m elements may be alike, if r and q of them are rare and both have ``shared`` rare ones in common."""
    most = f"least({n} - {r} + {shared}, {m} - {q} + {shared})"
    return f"100 * {most} >= {threshold} * ({n} + {m} - {most})"


def _rare(docs: DataFrame, heavy: DataFrame, scratch: Scratch, threshold: int) -> tuple[DataFrame, DataFrame]:
    """For the documents ``heavy`` (x, n, g): (x, r), their rare shingles, and the pairs (x, y) that share some and may be linked."""
    elements = scratch.put(by_ids(docs, heavy.select("x"), "left_semi").mapInArrow(_elements, "h long, c long, xs array<long>"), "elements")
    counts = elements.groupBy("h").agg(F.sum("c").alias("c")).where(f"c <= {RARE}")
    rare = scratch.put(elements.drop("c").join(counts, "h").select(F.explode("xs").alias("x"), "h", "c"), "rare")
    number = scratch.put(heavy.join(rare.groupBy("x").agg(F.count("*").alias("r")), "x", "left").withColumn("r", F.coalesce("r", F.lit(0))), "rareness")
    some = rare.where("c > 1")
    both = some.select("h", F.col("x").alias("a")).join(some.select("h", F.col("x").alias("b")), "h").where("a > b")  # at most RARE documents a shingle
    both = both.groupBy("a", "b").agg(F.count("*").alias("s"))
    left, right = (number.select(F.col("x").alias(k), F.col("n").alias(f"n_{k}"), F.col("g").alias(f"g_{k}"), F.col("r").alias(f"r_{k}")) for k in "ab")
    both = both.join(left, "a").join(right, "b").where("g_a <> g_b").where(_bound("n_a", "r_a", "n_b", "r_b", "s", threshold))
    return number.select("x", "r"), both.select(F.col("a").alias("x"), F.col("b").alias("y"))


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Share of equal signature bytes."""
    for batch in batches:
        n = batch.num_rows
        x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(n, BANDS * ROWS) if n else np.zeros((0, 1)) for c in ("low_x", "low_y"))
        yield pa.record_batch([batch["x"], batch["y"], pa.array((x == y).mean(axis=1) if n else np.zeros(0))], ["x", "y", "alike"])


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared = np.zeros(batch.num_rows, np.int64)
        total = np.zeros(batch.num_rows, np.int64)
        for r, (x, y) in enumerate(zip(batch["shingles_x"], batch["shingles_y"], strict=True)):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            small, large = (a, b) if len(a) <= len(b) else (b, a)
            at = np.searchsorted(large, small)
            shared[r] = (large[np.minimum(at, len(large) - 1)] == small).sum()
            total[r] = len(a) + len(b) - shared[r]
        yield pa.record_batch([batch["x"], batch["y"], pa.array(shared), pa.array(total)], ["x", "y", "shared", "total"])


def _with_both(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """``pairs`` (x, y, ...) with the ``value`` of both documents, as value_x and value_y."""
    n, counts = pairs.count(), {own: pairs.groupBy(own).agg(F.count("*").alias("n")) for own in "xy"}
    for own, other in (("x", "y"), ("y", "x")):
        pairs = spread_join(pairs, table.select(F.col("doc_id").alias(own), F.col(value).alias(f"{value}_{own}")), own, other, n, counts[own])
    return pairs


def _verified(pairs: DataFrame, light: DataFrame, docs: DataFrame, scratch: Scratch, name: str, threshold: int) -> DataFrame:
    """(x, y, shared, total) of distinct pairs whose signatures are not far apart (8 deviations).

    The estimate of a pair with similarity s has the deviation sqrt(s (1 - s) / slots).
    """
    s = threshold / 100
    least = max(0.0, s - 8 * (s * (1 - s) / (BANDS * ROWS)) ** 0.5)
    pairs = _with_both(pairs, light, "low")
    close = scratch.put(pairs.mapInArrow(_alike, "x long, y long, alike double").where(F.col("alike") >= least).select("x", "y"), f"{name}-close")
    need = scratch.put(close.select("x").union(close.select("y")).distinct(), f"{name}-need")
    sets = scratch.put(by_ids(docs, need, "left_semi").mapInArrow(_sets, "doc_id long, shingles binary"), f"{name}-sets")
    with small_batches(docs.sparkSession, PAIRS):
        joined = _with_both(close, sets, "shingles").select("x", "y", "shingles_x", "shingles_y")
        out = scratch.put(joined.mapInArrow(_overlap, "x long, y long, shared long, total long"), name)
    for part in ("close", "need", "sets"):
        scratch.drop(f"{name}-{part}")
    return out


def _grouped(docs: DataFrame, threshold: int, scratch: Scratch) -> DataFrame:
    """doc_id, n_shingles and component_id for documents with a doc_id each; rows without one have no component."""
    sketch = scratch.put(docs.mapInArrow(_sketch, "doc_id long, n long, digest binary, bands array<long>, low binary"), "sketch")
    some = sketch.where("n > 0 AND doc_id IS NOT NULL")
    total = some.count()
    classes = scratch.put(some.groupBy("digest").agg(F.min("doc_id").alias("class"), F.count("*").alias("n")).where("n > 1"), "classes")
    copies = spread_join(some.select("doc_id", "digest"), classes.drop("n"), "digest", "doc_id", total, classes).where("doc_id <> class")
    copies = scratch.put(copies.select("doc_id", "class"), "copies")
    own = by_ids(some, copies, "left_anti")
    rows = own.select(F.col("doc_id").alias("x"), F.explode("bands").alias("band"))
    centre = scratch.put(rows.groupBy("band").agg(F.min("x").alias("y"), F.count("*").alias("n")).where("n > 1"), "centres")
    buckets = scratch.put(spread_join(rows, centre.drop("n"), "band", "x", BANDS * total, centre), "buckets")
    first = scratch.put(buckets.where("x <> y").select("x", "y").distinct(), "first")
    met = scratch.put(buckets.select("x").distinct(), "met")
    light = scratch.put(by_ids(own.select("doc_id", "low", "n"), met, "left_semi"), "light")
    checked = _verified(first, light, docs, scratch, "checked", threshold)
    linked = f"100 * shared >= {threshold} * total"
    links = checked.where(linked).select(F.col("x").alias("a"), F.col("y").alias("b"))
    groups = components(links, scratch, "early")
    # members of a bucket that are still apart: all but its most frequent component against the rest
    known = checked.select("x", "y", (1 - F.col("shared") / F.col("total")).alias("d"))
    apart = buckets.join(groups.select(F.col("id").alias("x"), F.col("component").alias("g")), "x", "left").withColumn("g", F.coalesce("g", "x"))
    sizes = apart.groupBy("band", "g").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("band").agg(F.max_by("g", F.struct("c", "g")).alias("major"), F.count("*").alias("k"), (F.sum("c") - F.max("c")).alias("minors"), F.sum("c").alias("n"))
    mixed = scratch.put(mixed.where("k > 1").select("band", "major", (F.col("minors") > SPARSE).alias("dense"), "n"), "mixed")
    apart = spread_join(apart, mixed.drop("n"), "band", "x", max(1, buckets.count()), mixed)
    apart = apart.join(light.select(F.col("doc_id").alias("x"), "n"), "x").join(known, ["x", "y"], "left")
    apart = scratch.put(apart.withColumn("d", F.when(F.col("x") == F.col("y"), 0.0).otherwise(F.col("d"))), "apart")
    number, alike = _rare(docs, scratch.put(apart.where("dense").select("x", "n", "g").distinct(), "dense"), scratch, threshold)
    open_ = apart.join(number, "x", "left").withColumn("r", F.when(F.col("dense"), F.col("r")).otherwise(0)).where(f"100 * (n - r) >= {threshold} * n")
    minor = open_.where("g <> major").select("band", F.col("x").alias("x2"), F.col("g").alias("g2"), F.col("d").alias("d2"), F.col("n").alias("n2"), F.col("r").alias("r2"))
    reach = 1 - threshold / 100 + 1e-9
    near = (F.col("d").isNull() | F.col("d2").isNull() | (F.abs(F.col("d") - F.col("d2")) <= reach)) & (F.col("g") != F.col("g2"))
    near &= F.expr(_bound("n", "r", "n2", "r2", "0", threshold)) & ((F.col("g") == F.col("major")) | (F.col("x") < F.col("x2")))
    crossed = open_.join(minor, "band").where(near).select(F.greatest("x", "x2").alias("x"), F.least("x", "x2").alias("y"))
    crossed = crossed.unionByName(alike).distinct().join(first, ["x", "y"], "left_anti")
    second = _verified(scratch.put(crossed, "second"), light, docs, scratch, "rechecked", threshold)
    more = second.where(linked).select(F.col("x").alias("a"), F.col("y").alias("b"))
    final = groups
    if not more.isEmpty():
        final = components(groups.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more), scratch, "late")
    for name in ("centres", "buckets", "first", "met", "light", "mixed", "apart", "dense", "elements", "rare", "rareness", "second"):
        scratch.drop(name)
    # a copy's component is that of its class
    named = classes.join(final.select(F.col("id").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    mine = spread_join(copies, named.select("class", "component"), "class", "doc_id", copies.count(), classes.select("class", "n"))
    component = mine.select("doc_id", "component").unionByName(final.select(F.col("id").alias("doc_id"), "component"))
    out = sketch.select("doc_id", F.col("n").alias("n_shingles")).join(component, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _near(documents: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    scratch = Scratch(documents.sparkSession, "minhash")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    once, keys = told_apart(docs, scratch)
    with small_batches(documents.sparkSession, DOCUMENTS):
        return _grouped(once, threshold, scratch), docs, keys


def near_duplicates(documents: DataFrame, threshold: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links), kept (doc_id = component_id).

    Documents are linked when 100 * shared >= threshold * union of their shingles.
    A pair at 0.85 shares no band with probability 2.4e-7.
    """
    found, docs, keys = _near(documents, threshold)
    out = told_together(found, docs, keys, ("doc_id", "component_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one_of_each(documents: DataFrame, threshold: int = 80) -> DataFrame:
    """The rows of ``documents`` but for those linked, directly or not, to a document of smaller doc_id (or of the same, with another text).

    Equal rows of one doc_id stay together.
    """
    found, _, keys = _near(documents, threshold)
    gone = found.where("doc_id <> component_id").select("doc_id")
    if keys is None:
        return by_ids(documents, gone, "left_anti")
    own = documents["doc_id"].cast("long")
    gone = keys.join(gone, "doc_id").select(F.col("own").alias("_gone"), F.col("t").alias("_text"))
    return documents.join(gone, (own == gone["_gone"]) & (F.xxhash64(F.coalesce(documents["text"], F.lit(""))) == gone["_text"]), "left_anti")
