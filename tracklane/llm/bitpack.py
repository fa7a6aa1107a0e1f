"""Token ids in files of fixed-width bits with block offsets.

A file holds the ids of consecutive documents in ascending doc_id order.

    8 bytes   magic
    blocks    BLOCK ids each (the last shorter), packed little-endian in words of 64 bits
    footer    JSON: bits, block, ids, and the block offsets, doc_ids and first ids as arrays of 64 bits, base64
    8 bytes   length of the footer

Sixty-four ids fill exactly ``bits`` words, so that numpy packs and unpacks all
rows of sixty-four at once, and the block that holds the id i is at
offsets[i // BLOCK].  Files are written and read through a Python data source:
see ``files`` for how they are committed.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import textkernel, tokens
from .common import partitions, small_batches
from .files import ManifestWriter, Written, filesystem, manifest

MAGIC = b"TOKBITS1"
BLOCK = 1 << 16
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


def width(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> np.ndarray:
    """Words of 64 bits that hold the ids one after the other."""
    rows = -(-len(ids) // 64)
    grid = np.zeros((rows, 64), np.uint64)
    grid.ravel()[: len(ids)] = ids
    out = np.zeros((rows, bits), np.uint64)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        out[:, word] |= grid[:, i] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= grid[:, i] >> np.uint64(64 - shift)
    return out.ravel()


def unpack_bits(words: np.ndarray, bits: int, n: int) -> np.ndarray:
    grid = words.reshape(-1, bits)
    out = np.empty((len(grid), 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        x = grid[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | grid[:, word + 1] << np.uint64(64 - shift)
        out[:, i] = x & mask
    return out.ravel()[:n]


def _b64(x: np.ndarray) -> str:
    return base64.b64encode(np.asarray(x, "<i8").tobytes()).decode()


def _numbers(x: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(x), "<i8")


class Writer:
    """Appends documents to one file."""

    def __init__(self, out, bits: int):
        self.out, self.bits = out, bits
        self.out.write(MAGIC)
        self.at, self.offsets, self.rest, self.total = len(MAGIC), [], np.zeros(0, np.uint32), 0
        self.doc_ids: list[np.ndarray] = []
        self.firsts: list[np.ndarray] = []

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, firsts: np.ndarray) -> None:
        if int(ids.max(initial=0)) >> self.bits:
            raise ValueError(f"an id does not fit into {self.bits} bits")
        self.doc_ids.append(doc_ids)
        self.firsts.append(firsts[:-1] + self.total)
        self.total += len(ids)
        ids = np.concatenate((self.rest, ids))
        cut = len(ids) // BLOCK * BLOCK
        for k in range(0, cut, BLOCK):
            self._block(ids[k : k + BLOCK])
        self.rest = ids[cut:]

    def _block(self, ids: np.ndarray) -> None:
        data = pack_bits(ids, self.bits).astype("<u8").tobytes()
        self.offsets.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        none = np.zeros(0, np.int64)
        footer = json.dumps(
            {
                "bits": self.bits, "block": BLOCK, "ids": self.total, "offsets": _b64(np.array(self.offsets, np.int64)),
                "doc_ids": _b64(np.concatenate([none, *self.doc_ids])), "firsts": _b64(np.concatenate([none, *self.firsts])),
            }
        ).encode()
        self.out.write(footer)
        self.out.write(len(footer).to_bytes(8, "little"))
        self.out.close()


class Reader:
    """Random access to one file."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - 8)
        n = int.from_bytes(file.read(8), "little")
        file.seek(size - 8 - n)
        footer = json.loads(file.read(n))
        self.bits, self.block, self.ids = footer["bits"], footer["block"], footer["ids"]
        self.offsets, self.doc_ids, self.firsts = (_numbers(footer[k]) for k in ("offsets", "doc_ids", "firsts"))

    def blocks(self, first: int, last: int) -> np.ndarray:
        """All ids of the blocks [first, last)."""
        parts = [np.zeros(0, np.uint32)]
        for b in range(first, last):
            n = min(self.block, self.ids - b * self.block)
            self.file.seek(int(self.offsets[b]))
            words = np.frombuffer(self.file.read(-(-n // 64) * 8 * self.bits), "<u8")
            parts.append(unpack_bits(words, self.bits, n))
        return np.concatenate(parts)

    def read(self, start: int, n: int) -> np.ndarray:
        """The ids [start, start + n)."""
        first, last = start // self.block, -(-(start + n) // self.block)
        return self.blocks(first, last)[start - first * self.block :][:n]


@dataclass
class Part(InputPartition):
    name: str
    base: int


class _FileWriter(ManifestWriter):
    suffix = ".tokbits"

    def __init__(self, options: dict):
        super().__init__(options)
        self.bits = int(options["bits"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        name, out = self.create()
        writer = Writer(out, self.bits)
        for batch in iterator:
            raw, offsets = textkernel.flat(batch["ids"])
            ids = np.frombuffer(raw.tobytes(), "<u4")
            if batch.num_rows:
                writer.add(batch["doc_id"].to_numpy(), ids, offsets // 4)
        writer.close()
        return self.written([(name, writer.total)])


class _FileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[Part]:
        out, base = [], 0
        for name, ids in manifest(self.path):
            out.append(Part(name, base))
            base += ids
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(self.path)
        with fs.open_input_file(f"{root}/{part.name}") as file:
            reader = Reader(file)
            bounds = np.append(reader.firsts, reader.ids)
            i, n = 0, len(reader.doc_ids)
            while i < n:
                j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + 8 * BLOCK, "right")) - 1)
                j = min(j, n, i + 5000)
                data = reader.read(int(bounds[i]), int(bounds[j] - bounds[i])).astype("<u4").tobytes()
                at = (bounds[i : j + 1] - bounds[i]) * 4
                ids = [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.record_batch(
                    [pa.array(reader.doc_ids[i:j]), pa.array(bounds[i:j] + part.base), pa.array(np.diff(bounds[i : j + 1])), pa.array(ids, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )
                i = j


class TokenBits(DataSource):
    """``format("tokbits")``; options: path, and for writing bits."""

    @classmethod
    def name(cls) -> str:
        return "tokbits"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> _FileWriter:
        return _FileWriter(self.options)

    def reader(self, schema) -> _FileReader:
        return _FileReader(self.options)


def _ids(path: str, end: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, offsets in textkernel.texts(batch["text"]):
                ids, firsts = tokens.encode_flat(raw, offsets, path)
                if end is not None:
                    ids, firsts = tokens.with_end(ids, firsts, end)
                data = ids.astype("<u4").tobytes()
                at = firsts * 4
                blobs = [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                none = pa.array(np.zeros(j - i, np.int64))
                yield pa.record_batch([batch["doc_id"].slice(i, j - i), none, none, pa.array(blobs, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return run


def write_tokens(documents: DataFrame, path: str, tokenizer: str, end: int | None = 2) -> None:
    """Write the ids of all documents in ascending doc_id order under ``path``, in the bits that the tokenizer's ids need.

    Columns doc_id and text are used; a null text is empty, rows with a null
    doc_id are not written, repeated rows are written each.
    """
    spark = documents.sparkSession
    spark.dataSource.register(TokenBits)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    ordered = docs.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id")
    with small_batches(spark, 1000):  # texts go in and ids come out of two Python workers a task
        ordered.mapInArrow(_ids(tokenizer, end), SCHEMA).write.format("tokbits").mode("append").option("bits", width(max(tokens.vocabulary(tokenizer), (end or 0) + 1))).save(path)


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (little-endian 32-bit, binary), from the files."""
    spark.dataSource.register(TokenBits)
    return spark.read.format("tokbits").load(path)
