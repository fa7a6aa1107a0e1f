"""Removal of repeated passages from documents, exact and over a whole corpus.

A *window* is a run of ``window`` consecutive tokens (words or bytes).  It is
removed where the same token sequence starts earlier too.  Every window is owned
by its least k-gram (by hash): equal windows have the same owner at the same
place, so that windows need only meet others with the same owner.

0. Of documents with the same text only the first takes part: all others are
   removed whole, unless they are shorter than a window.
1. Owners are counted over all documents (pre-aggregated in each task); those
   that occur once cannot own a repeated window.
2. The rest are joined back to their documents, and a second pass over the
   texts cuts out the passages whose windows they own.  Equal passages of a run
   of texts are sent once.  Owners with very many passages are split: each of
   their windows goes where its own hash says, and is sent once by a task (for the
   first SEEN windows that it meets, the common ones among them).
3. Each shard finds the equal windows of its passages: words stream against its
   compressed FM-index, whose matching statistics say how far back from each word
   the shard has the same words elsewhere too; where that is ``window`` words, the
   interval names the group of equal windows, and else a window is alone.  Bytes are ordered by deep-shallow suffix sorting.  The
   least occurrence of each group of equal windows is the one that stays.
4. Each passage's removed ranges are joined back and cut out of the texts.

Texts go to their owners in PARTS, and passages meet in turns by key, so that
only a part of either is on disk twice.

A key has ``split_over`` passages at most, or one window of each task; nothing is
capped or sampled.  Windows are equal where their tokens are; passages are told
apart by 128 bits of hashes (of the owner and of the whole), texts by SHA-256.

Input: a table with the columns doc_id (integer) and text; others are ignored.
Null texts are empty.  Rows with a null doc_id take no part in matching and come
back unchanged.  Equal rows of a doc_id are one document and get the same result
each; different texts of one doc_id are documents of their own, in order of their
hashes.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import deep_shallow, textkernel
from .common import SENT_IDS, Scratch, by_ids, partitions, spread_join, told_apart, told_together
from .fm_index import FMIndex

U = np.uint64
#: The texts meet their owners in so many parts.
PARTS = 2
#: The passages meet in so many turns, by key, or in fewer of LEAST bytes; in more where a turn has more bytes than half the texts.
TURNS, LEAST = 4, 1 << 24
#: Bytes of a passage with its hashes and place, about.
PASSAGE = 90
#: The end of a removed range that is the whole document, if this has a window.
WHOLE = 1 << 40
#: Windows of split owners that a task remembers to have sent.
SEEN = 1_000_000
PASSAGES = "key long, seg long, doc_id long, start long, content binary"
FOUND = "key long, seg long, lo long, hi long, first_doc long, delta long"


@dataclass(frozen=True)
class Spec:
    unit: str  # 'word' or 'byte'
    window: int
    k: int
    #: An owner of more passages than this (equal ones of a run of texts count once) is split by window.
    split_over: int = 2000
    #: Tokens of passages that a shard indexes at once.
    block: int = 300_000
    within: bool = True  # whether repeats within one document count


def _tokens(raw: np.ndarray, offsets: np.ndarray, spec: Spec):
    """Spans over token values, firsts of documents, byte starts and ends of tokens (None: bytes)."""
    if spec.unit == "byte":
        return textkernel.byte_spans(raw), offsets, None, None
    starts, ends, firsts = textkernel.words(raw, offsets)
    return textkernel.Spans(textkernel.word_hashes(raw, starts, ends)), firsts, starts, ends


def _runs(spans, firsts: np.ndarray, spec: Spec):
    doc, first, last, at = textkernel.owned_windows(spans, firsts, spec.window, spec.k)
    return doc, first, last, at, spans.hash(at, at + spec.k)


def _distinct(*keys: np.ndarray) -> np.ndarray:
    """Indices of the first of each distinct tuple, in order of the tuples (last key first)."""
    by = np.lexsort(keys)
    if not len(by):
        return by
    new = np.zeros(len(by), bool)
    new[0] = True
    for k in keys:
        s = k[by]
        new[1:] |= s[1:] != s[:-1]
    return by[new]


def _grouped(h: np.ndarray, *then: np.ndarray) -> np.ndarray:
    """Indices in order of ``h`` and, where equal, of ``then`` (last key first), or else as they were.

    Where few are equal this is faster than to sort by all keys.
    """
    by = np.argsort(h)
    same = h[by[1:]] == h[by[:-1]]
    if same.any():
        tied = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
        of = by[tied]
        by[tied] = of[np.lexsort((*(k[of] for k in then or (np.arange(len(h)),)), h[of]))]
    return by


def _among(x: np.ndarray, listed: np.ndarray) -> np.ndarray:
    listed = np.sort(listed)
    return listed[np.minimum(np.searchsorted(listed, x), len(listed) - 1)] == x if len(listed) else np.zeros(len(x), bool)


def _owner_counts(spec: Spec):
    """(h, n, m): an owner's occurrences (documents, without ``within``) and its distinct passages in a run of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, offsets in textkernel.texts(batch["text"]):
                spans, firsts, _, _ = _tokens(raw, offsets, spec)
                doc, first, last, at, h = _runs(spans, firsts, spec)
                by = _grouped(h)  # documents stay in order
                h, doc = h[by], doc[by]
                new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
                counted = new | np.r_[True, doc[1:] != doc[:-1]] if len(h) and not spec.within else np.ones(len(h), bool)
                heads = np.flatnonzero(new)
                n = np.add.reduceat(counted, heads, dtype=np.int64) if len(h) else np.zeros(0, np.int64)
                m = np.ones(len(heads), np.int64)
                group = np.cumsum(new) - 1
                rest = np.flatnonzero(np.diff(np.append(heads, len(h)))[group] > 1)
                if len(rest):
                    of = by[rest]
                    seg = _segment(spans, first[of], last[of] + spec.window, at[of])
                    own = _distinct(seg, group[rest])
                    m += np.bincount(group[rest][own], minlength=len(m)) - (np.bincount(group[rest], minlength=len(m)) > 0)
                yield pa.record_batch([pa.array(h[heads].view(np.int64)), pa.array(n), pa.array(m)], ["h", "n", "m"])

    return run


def _segment(spans, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the passages [a, b) and the place of their owner."""
    return textkernel.mix(spans.hash(a, b) ^ (at - a).astype(np.uint64))


def _owners_of(spec: Spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            for i, j, raw, offsets in textkernel.texts(batch["text"]):
                spans, firsts, _, _ = _tokens(raw, offsets, spec)
                doc, _, _, _, h = _runs(spans, firsts, spec)
                own = _grouped(h)
                if len(own):
                    own = own[np.r_[True, (h[own[1:]] != h[own[:-1]]) | (doc[own[1:]] != doc[own[:-1]])]]
                yield pa.record_batch([pa.array(h[own].view(np.int64)), pa.array(ids[i:j][doc[own]])], ["h", "doc_id"])

    return run


def _keyed(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    return textkernel.mix(h) + doc.astype(np.uint64) * U(0x9E3779B97F4A7C15)


def _listed(batch: pa.RecordBatch, name: str, i: int, j: int) -> np.ndarray:
    column = batch[name].slice(i, j - i)
    counts = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return _keyed(np.repeat(np.arange(j - i), counts), values)


class _Sent:
    """Windows that a task has sent, with the least document and start of each."""

    def __init__(self):
        self.key, self.doc, self.start = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def news(self, key: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which of these distinct windows were not sent with as small a place, and remember them."""
        at = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        known = self.key[at] == key if len(self.key) else np.zeros(len(key), bool)
        less = known.copy()
        less[known] = (doc[known] < self.doc[at[known]]) | ((doc[known] == self.doc[at[known]]) & (start[known] < self.start[at[known]]))
        self.doc[at[less]], self.start[at[less]] = doc[less], start[less]
        new = np.flatnonzero(~known)[: max(0, SEEN - len(self.key))]
        new = new[np.argsort(key[new])]
        to = np.searchsorted(self.key, key[new])
        self.key, self.doc, self.start = (np.insert(old, to, more[new]) for old, more in ((self.key, key), (self.doc, doc), (self.start, start)))
        return ~known | less


def _passages(spec: Spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = _Sent()
        for batch in batches:
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            for i, j, raw, offsets in textkernel.texts(batch["text"]):
                spans, firsts, starts, ends = _tokens(raw, offsets, spec)
                doc, first, last, at, h = _runs(spans, firsts, spec)
                keyed = _keyed(doc, h)
                warm, hot = _among(keyed, _listed(batch, "warm", i, j)), _among(keyed, _listed(batch, "hot", i, j))
                n = last[hot] - first[hot] + 1
                single = np.repeat(first[hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                a = np.concatenate((first[warm], single))
                b = np.concatenate((last[warm], single)) + spec.window
                of = np.concatenate((doc[warm], np.repeat(doc[hot], n)))
                full = spans.hash(a, b)
                key = np.concatenate((h[warm], textkernel.mix(full[warm.sum() :] ^ U(0xA5A5A5A5A5A5A5A5))))
                seg = textkernel.mix(full ^ np.concatenate((at[warm] - first[warm], np.full(len(single), -1))).astype(np.uint64))
                docs, local = ids[i:j][of], a - firsts[of]
                first_here = np.zeros(len(a), bool)
                by = _grouped(key, local, docs, seg)
                if len(by):
                    new = np.r_[True, (key[by][1:] != key[by][:-1]) | (seg[by][1:] != seg[by][:-1])]
                    first_here[by[new]] = True
                once = np.flatnonzero(first_here[warm.sum() :]) + warm.sum()
                first_here[once] = sent.news(textkernel.mix(key[once] + seg[once] * U(3)), docs[once], local[once])
                lo, hi = (a, b) if starts is None else (starts[np.minimum(a, max(len(starts) - 1, 0))] if len(starts) else a, ends[b - 1])
                data = raw.tobytes()
                content = [data[x:y] if f else None for x, y, f in zip(lo.tolist(), hi.tolist(), first_here.tolist(), strict=True)]
                yield pa.record_batch(
                    [pa.array(key.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(docs), pa.array(local), pa.array(content, pa.binary())],
                    ["key", "seg", "doc_id", "start", "content"],
                )

    return run


def _equal_windows(content: pa.Array, spec: Spec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of some passages: their passage, their offset in it and a number that equal windows share."""
    raw, offsets = textkernel.flat(content)
    if spec.unit == "byte":
        firsts = offsets
    else:
        starts, ends, firsts = textkernel.words(raw, offsets)
    n = np.maximum(np.diff(firsts) - spec.window + 1, 0)
    of = np.repeat(np.arange(len(n)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = firsts[:-1][of] + offset
    group = np.zeros(len(of), np.int64)
    if spec.unit == "byte":
        place, number = deep_shallow.order(raw, at, spec.window)
        group[place] = number
        return of, offset, group
    symbols = textkernel.numbers(raw, starts, ends)
    which = np.repeat(np.arange(len(n)), np.diff(firsts))
    text = np.zeros(len(symbols) + len(n), np.int64)  # passages, each with a zero behind it
    text[np.arange(len(symbols)) + which] = symbols + 1
    length, lo, _ = FMIndex(text, spec.window).matching_statistics(text, at + of + spec.window, spec.window, 2)
    alone = length < spec.window  # the shard has the window in this place only
    return of, offset, np.where(alone, len(text) + np.arange(len(of)), lo)


def _first_of(batches: Iterator[pa.RecordBatch], spec: Spec) -> Iterator[pa.Table]:
    """Blocks of whole keys from rows in order of key."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
            held.append(part)
            size += part["content"].nbytes
            if size >= spec.block * (6 if spec.unit == "word" else 1):
                table = pa.Table.from_batches(held)
                key = table["key"].to_numpy()
                cut = int(np.searchsorted(key, key[-1], "left"))
                if cut:
                    yield table.slice(0, cut)
                    rest = table.slice(cut).combine_chunks()
                    held, size = rest.to_batches(), rest.nbytes
    if held:
        yield pa.Table.from_batches(held)


def _resolve(spec: Spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _first_of(batches, spec):
            key, seg, doc, start = (table[c].to_numpy() for c in ("key", "seg", "doc_id", "start"))
            by = np.lexsort((start, doc, seg, key))
            new = np.r_[True, (key[by][1:] != key[by][:-1]) | (seg[by][1:] != seg[by][:-1])]
            own = by[new]
            key, seg, doc, start = key[own], seg[own], doc[own], start[own]
            of, offset, group = _equal_windows(table["content"].take(pa.array(own)).combine_chunks(), spec)
            d, s = doc[of], start[of] + offset
            least = np.full(int(group.max(initial=-1)) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, group, d)
            first_doc = least[group]
            if spec.within:
                own = np.flatnonzero(d == first_doc)
                least[:] = np.iinfo(np.int64).max
                np.minimum.at(least, group[own], s[own])
                delta = least[group] - offset
            else:
                delta = np.zeros(len(of), np.int64)
            new = np.ones(len(of), bool)
            if len(of):
                new[1:] = (of[1:] != of[:-1]) | (first_doc[1:] != first_doc[:-1]) | (delta[1:] != delta[:-1])
            at = np.flatnonzero(new)
            last = np.append(at[1:], len(of)) - 1 if len(at) else at
            yield pa.record_batch(
                [pa.array(x) for x in (key[of[at]], seg[of[at]], offset[at], offset[last] + spec.window, first_doc[at], delta[at])],
                ["key", "seg", "lo", "hi", "first_doc", "delta"],
            )

    return run


def _cut(spec: Spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, offsets in textkernel.texts(batch["text"]):
                _, firsts, starts, ends = _tokens(raw, offsets, spec) if spec.unit == "word" else (None, offsets, None, None)
                lists = batch["removed"].slice(i, j - i).fill_null([])
                counts = np.diff(lists.offsets.to_numpy())
                spans = lists.flatten()
                of = np.repeat(np.arange(j - i), counts)
                lo = np.minimum(firsts[of] + spans.field("lo").to_numpy(zero_copy_only=False), firsts[of + 1])
                hi = spans.field("hi").to_numpy(zero_copy_only=False)
                hi = np.where((hi == WHOLE) & (np.diff(firsts)[of] < spec.window), lo, np.minimum(firsts[of] + hi, firsts[of + 1]))
                edges = np.zeros(firsts[-1] + 1, np.int32)
                np.add.at(edges, lo, 1)
                np.add.at(edges, hi, -1)
                gone = np.cumsum(edges)[:-1] > 0
                runs = np.flatnonzero(gone & np.r_[True, ~gone[:-1]]) if len(gone) else np.zeros(0, np.int64)
                inner = firsts[1:-1][(firsts[1:-1] > 0) & (firsts[1:-1] < len(gone))]
                runs = np.unique(np.r_[runs, inner[gone[inner]]]) if len(gone) else runs
                n_spans = np.searchsorted(runs, firsts[1:]) - np.searchsorted(runs, firsts[:-1])
                total = np.r_[0, np.cumsum(gone)]
                if spec.unit == "byte":
                    kept, before = raw[~gone], np.r_[0, np.cumsum(~gone)]
                    bounds = before[firsts]
                else:
                    stay = np.flatnonzero(~gone)
                    length = ends[stay] - starts[stay] + 1
                    to = np.r_[0, np.cumsum(length)]
                    source = np.arange(to[-1]) - np.repeat(to[:-1], length) + np.repeat(starts[stay], length)
                    kept = raw[np.minimum(source, max(len(raw) - 1, 0))] if len(raw) else raw
                    kept = kept.copy()
                    kept[to[1:] - 1] = 0x20
                    bounds = to[np.searchsorted(stay, firsts)]
                data = kept.tobytes()
                trim = 1 if spec.unit == "word" else 0
                out = [data[x : max(x, y - trim)] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.record_batch(
                    [
                        batch["doc_id"].slice(i, j - i).cast(pa.int64()),
                        pa.array(np.diff(firsts).astype(np.int64)),
                        pa.array((total[firsts[1:]] - total[firsts[:-1]]).astype(np.int64)),
                        pa.array(n_spans.astype(np.int64)),
                        pa.array(out, pa.binary()),
                    ],
                    ["doc_id", "n_tokens", "n_removed", "n_spans", "kept"],
                )

    return run


def _once(known: DataFrame, spec: Spec, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """Documents (doc_id, text) of at least ``window`` bytes, those of one text as the first of them; the doc_ids of all others of these; and the bytes of what stays."""
    long = known.where(F.octet_length("text") >= spec.window)
    digests = scratch.put(long.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").cast("long").alias("size")), "digests")
    texts = scratch.put(digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.max("size").alias("size")), "texts_once")
    several = texts.where("n > 1")
    copies = scratch.put(spread_join(digests, several.select("digest", "first"), "digest", "doc_id", digests.count(), several.select("digest", "n")).where("doc_id > first").select("doc_id"), "copies")
    scratch.drop("digests")
    n, size = texts.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if copies.isEmpty():
        return long, copies, size
    if copies.count() <= max(n, SENT_IDS):
        once = by_ids(long, copies, "left_anti")
    else:
        once = by_ids(long, texts.select("first"), "left_semi")
    if min(copies.count(), n) > SENT_IDS:  # the texts had to be shuffled: once is enough
        once = scratch.put(once, "once_each")
    return once, copies, size


def remove_repeats(documents: DataFrame, spec: Spec) -> DataFrame:
    """Documents without their repeated windows: doc_id, n_tokens, n_removed, n_spans (maximal removed runs), kept (binary).

    With words, what stays is joined by single spaces.  With ``within`` a window
    is removed where an equal one starts in a document of smaller doc_id or
    earlier in the same document; without it, only the former counts.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "repeats")
    every = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs, keys = told_apart(every, scratch)
    known, copies, size = _once(docs.where("doc_id IS NOT NULL"), spec, scratch)
    counted = known.select("text").mapInArrow(_owner_counts(spec), "h long, n long, m long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).where("n > 1")
    shared = scratch.put(counted.select("h", (F.col("m") > spec.split_over).alias("hot")), "owners")
    owned = known.mapInArrow(_owners_of(spec), "h long, doc_id long").join(shared.hint("shuffle_hash"), "h")  # each h once: no group to hold
    flags = scratch.put(
        owned.groupBy("doc_id").agg(F.collect_list(F.expr("IF(hot, NULL, h)")).alias("warm"), F.collect_list(F.expr("IF(hot, h, NULL)")).alias("hot")),
        "flags",
    )
    scratch.drop("owners")
    for part in range(PARTS):
        mine = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)) == part
        scratch.put(known.where(mine).join(flags.where(mine), "doc_id").mapInArrow(_passages(spec), PASSAGES), f"passages/part={part}")
    scratch.drop("flags")
    passages = spark.read.schema(PASSAGES).parquet(*(scratch.path(f"passages/part={part}") for part in range(PARTS)))
    sent = PASSAGE * passages.count()
    turns = max(min(TURNS, 1 + sent // LEAST), -(-2 * sent // max(size, 8 * LEAST)))
    earlier = "first_doc < doc_id OR first_doc = doc_id AND delta < start" if spec.within else "first_doc < doc_id"
    ranges = F.collect_list(F.struct("lo", "hi")).alias("removed")
    gone = []
    for turn in range(turns):
        now = passages.where(F.pmod("key", F.lit(turns)) == turn)
        spread = now.where("content IS NOT NULL").repartition(partitions(spark), "key").sortWithinPartitions("key")
        found = scratch.put(spread.mapInArrow(_resolve(spec), FOUND), f"found/turn={turn}")
        met = now.select("key", "seg", "doc_id", "start").join(found.hint("shuffle_hash"), ["key", "seg"]).where(earlier)
        met = met.select("doc_id", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))
        gone.append(scratch.put(met.groupBy("doc_id").agg(ranges), f"gone/turn={turn}"))
        scratch.drop(f"found/turn={turn}")
    scratch.drop("passages")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.lit(WHOLE).alias("hi")))
    removed = spark.read.schema(gone[0].schema).parquet(*(scratch.path(f"gone/turn={turn}") for turn in range(turns)))
    removed = removed.groupBy("doc_id").agg(F.flatten(F.collect_list("removed")).alias("removed")).unionByName(copies.select("doc_id", whole.alias("removed")))
    out = docs.join(removed, "doc_id", "left").select("doc_id", "text", "removed").mapInArrow(
        _cut(spec), "doc_id long, n_tokens long, n_removed long, n_spans long, kept binary"
    )
    return told_together(out, every, keys, ("doc_id",))


#: A match of 20 words, as an eight-word owner leaves few accidental meetings.
WORDS = Spec("word", 20, 8)
#: A match of 50 bytes in another document.
BYTES = Spec("byte", 50, 18, within=False)


def substring_dedup(documents: DataFrame, window: int = 20) -> DataFrame:
    """Word passages of ``window`` words that start earlier are removed, by FM-index search in shards.

    See :func:`remove_repeats` for columns; words are ``[^\\x20\\x09-\\x0D]+``.
    """
    return remove_repeats(documents, Spec("word", window, max(1, min(8, window // 2))))


def suffix_array_dedup(documents: DataFrame, window: int = 50) -> DataFrame:
    """Byte passages of ``window`` bytes that start in an earlier document are removed, by deep-shallow sorting in shards.

    See :func:`remove_repeats` for columns.
    """
    return remove_repeats(documents, Spec("byte", window, max(1, min(18, window // 2)), within=False))
