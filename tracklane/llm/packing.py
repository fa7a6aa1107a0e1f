"""Cost-balanced packing of documents into fixed-length token sequences.

A piece of n tokens costs n + n * n / capacity (its linear work and its
attention).  Documents longer than a sequence are cut into full pieces first.
Within a shard the rest is placed in descending order, each piece into the
lowest-cost sequence that still has room for it; where none has, the piece is
cut at the room that is left.  As many sequences are opened as the shard's tokens
need, so that a shard pads less than one sequence.

Input: columns doc_id and text, others ignored; a null text is empty (its only
token is the end id).  Null doc_ids are kept.  Repeated rows are packed each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel, tokens
from .common import Scratch, partitions, small_batches

#: Tokens that are packed together at most; a larger partition is packed in turns.
GROUP_TOKENS = 1 << 25
#: Bytes of text that are encoded at once (or one longer document), and rows that a Python worker gets at once.
CHUNK, ROWS = 1 << 19, 1000


def _pieces(path: str, end: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, offsets in textkernel.texts(batch["text"], CHUNK):
                ids, firsts = tokens.with_end(*tokens.encode_flat(raw, offsets, path), end)
                sizes = np.diff(firsts)
                n = -(-sizes // capacity)
                doc = np.repeat(np.arange(j - i), n)
                number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = number * capacity
                length = np.minimum(sizes[doc] - start, capacity)
                wide = np.uint16 if int(ids.max(initial=0)) < 65536 else np.uint32
                data, width = ids.astype(wide).tobytes(), np.dtype(wide).itemsize
                at = (firsts[:-1][doc] + start) * width
                blobs = [data[a:b] for a, b in zip(at.tolist(), (at + length * width).tolist(), strict=True)]
                yield pa.record_batch(
                    [batch["doc_id"].slice(i, j - i).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(sizes[doc]), pa.array(blobs, pa.binary())],
                    ["doc_id", "start", "length", "doc_tokens", "ids"],
                )

    return run


def place(lengths: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(piece, its tokens before, tokens, sequence, offset) for pieces in descending order of length."""
    out: list[tuple[int, int, int, int, int]] = []
    full = int((lengths == capacity).sum())
    out += [(p, 0, capacity, p, 0) for p in range(full)]
    rest = lengths[full:]
    count = -(-int(rest.sum()) // capacity)
    room = np.full(count, capacity, np.int64)
    cost = np.zeros(count)
    for p, n in enumerate(rest.tolist(), full):
        done = 0
        while done < n:
            fits = np.where(room >= n - done, cost, np.inf)
            best = int(fits.argmin())
            if room[best] < n - done:
                best = int(room.argmax())
            take = min(int(room[best]), n - done)
            out.append((p, done, take, full + best, capacity - int(room[best])))
            room[best] -= take
            cost[best] += take + take * take / capacity
            done += take
    return out


def _pack(capacity: int):
    def group(table: pa.Table, first_sequence: int) -> tuple[pa.RecordBatch, int]:
        length, start = table["length"].to_numpy(), table["start"].to_numpy()
        doc = table["doc_id"].to_numpy(zero_copy_only=False)
        by = np.lexsort((start, np.nan_to_num(doc.astype(np.float64), nan=-1), -length))
        placed = np.array(place(length[by], capacity), np.int64).reshape(-1, 5)
        source = by[placed[:, 0]]
        raw, offsets = textkernel.flat(table["ids"])
        width = np.diff(offsets)[source] // length[source]
        lo = offsets[:-1][source] + placed[:, 1] * width
        data = raw.tobytes()
        blobs = [
            np.frombuffer(data[a : a + n * w], np.uint16 if w == 2 else np.uint32).astype("<u4").tobytes()
            for a, n, w in zip(lo.tolist(), placed[:, 2].tolist(), width.tolist(), strict=True)
        ]
        at = pa.array(source)
        used = int(placed[:, 3].max(initial=-1)) + 1
        return pa.record_batch(
            [
                table["doc_id"].take(at).combine_chunks(),
                pa.array(start[source] + placed[:, 1]),
                pa.array(placed[:, 2]),
                table["doc_tokens"].take(at).combine_chunks(),
                pa.array(placed[:, 3] + first_sequence),
                pa.array(placed[:, 4]),
                pa.array(blobs, pa.binary()),
            ],
            ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
        ), used

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 36
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += pa.compute.sum(batch["length"]).as_py()
            if size >= GROUP_TOKENS:
                out, used = group(pa.Table.from_batches(held), sequence)
                yield from (out.slice(k, 2000) for k in range(0, out.num_rows, 2000))
                sequence, held, size = sequence + used, [], 0
        if held:
            out, _ = group(pa.Table.from_batches(held), sequence)
            yield from (out.slice(k, 2000) for k in range(0, out.num_rows, 2000))

    return run


def pack(documents: DataFrame, tokenizer: str, end: int = 1, capacity: int = 2048) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian 32-bit, binary)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = docs.mapInArrow(_pieces(tokenizer, end, capacity), "doc_id long, start long, length long, doc_tokens long, ids binary")
    spark = documents.sparkSession
    spread = pieces.repartition(partitions(spark), F.xxhash64("doc_id", "start"))
    packed = spread.mapInArrow(
        _pack(capacity), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    )
    with small_batches(spark, ROWS):  # texts and ids go in and out: an executor holds each batch in Spark and in Python, for each of its tasks
        return Scratch(spark, "packing").put(packed, "pieces")
