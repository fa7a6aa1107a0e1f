"""The timed metadata track of MP4 files: ``format("mp4_metadata")``.

A file is dealt by ranges of bytes, and many small ranges are one task's.  A task reads the file's movie box, whatever
lies before it, and then those samples of the first track whose codec is ``gpmd``
that begin in its range, one by one.  Sample tables are expanded by numpy: runs of
chunks and of durations become one row a sample.  Filters on a sample's place and
times are tested on the table, before a payload is read, and no payload is read
where the column isn't asked for.  A file without such a track ends in an error that names it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, InputPartition

from .files import RangeReader, joined, register

SAMPLES = "video string, sample_idx long, offset long, size long, pts double, duration double, payload binary"
#: The codec of the metadata track, and ticks a second where a track doesn't say.
CODEC, TICKS = b"gpmd", 1000


def boxes(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, first byte, end) of the contents of the boxes one after the other; size 1 has 64 bits behind it, 0 means to the end."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= end:
            (size,), head = struct.unpack_from(">Q", data, start + 8), 16
        elif size == 0:
            size = end - start
        if size < head:
            return
        yield kind, start + head, min(start + size, end)
        start += size


def find(data: bytes, start: int, end: int, *path: bytes) -> tuple[int, int] | None:
    """First byte and end of the box that the path leads to."""
    for name in path:
        inner = next(((a, b) for kind, a, b in boxes(data, start, end) if kind == name), None)
        if inner is None:
            return None
        start, end = inner
    return start, end


def movie(file) -> bytes | None:
    """Contents of the movie box of a file with seek; other boxes are passed over."""
    while len(head := file.read(8)) == 8:
        size, kind = struct.unpack(">I4s", head)
        rest = size - 8
        if size == 1:
            rest = int.from_bytes(file.read(8), "big") - 16
        if kind == b"moov":
            return file.read(rest) if size else file.read()
        if size == 0 or rest < 0:
            return None
        file.seek(file.tell() + rest)
    return None


def _table(data: bytes, stbl: tuple[int, int], kind: bytes, at: int, item: str, count_at: int = 4) -> np.ndarray | None:
    """Items of a table box; one that is cut off has the whole items that are there."""
    where = find(data, *stbl, kind)
    if where is None:
        return None
    n = struct.unpack_from(">I", data, where[0] + count_at)[0]
    dtype = np.dtype(item)
    return np.frombuffer(data, dtype, max(0, min(n, (where[1] - where[0] - at) // dtype.itemsize)), where[0] + at)


def sample_table(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index, file offset, size, start, duration) of the metadata track's samples, times in seconds; samples without a chunk are left out."""
    for kind, a, b in boxes(data, 0, len(data)):
        stbl = find(data, a, b, b"mdia", b"minf", b"stbl") if kind == b"trak" else None
        codec = stbl and find(data, *stbl, b"stsd")
        if codec and codec[0] + 16 <= codec[1] and data[codec[0] + 12 : codec[0] + 16] == CODEC:
            break
    else:
        raise ValueError("no metadata track")
    clock = find(data, a, b, b"mdia", b"mdhd")
    ticks = struct.unpack_from(">I", data, clock[0] + (20 if data[clock[0]] == 1 else 12))[0] if clock else TICKS
    chunks = _table(data, stbl, b"stco", 8, ">u4")
    chunks = _table(data, stbl, b"co64", 8, ">u8") if chunks is None else chunks
    sizes = _table(data, stbl, b"stsz", 12, ">u4", 8)
    fixed = find(data, *stbl, b"stsz")
    if fixed and (one := struct.unpack_from(">I", data, fixed[0] + 4)[0]):
        sizes = np.full(struct.unpack_from(">I", data, fixed[0] + 8)[0], one)
    if chunks is None or sizes is None or not len(chunks) or not len(sizes):
        raise ValueError("no samples")
    chunks, sizes = chunks.astype(np.int64), sizes.astype(np.int64)
    runs = _table(data, stbl, b"stsc", 8, ">u4,>u4,>u4")
    per_chunk = np.ones(len(chunks), np.int64)
    if runs is not None and len(runs):
        first = runs["f0"].astype(np.int64) - 1
        per_chunk = np.repeat(runs["f1"].astype(np.int64), np.diff(np.append(first, max(len(chunks), int(first[-1])))))[: len(chunks)]
    chunk = np.repeat(np.arange(len(per_chunk)), per_chunk)[: len(sizes)]
    index = np.arange(len(chunk))
    before = np.cumsum(sizes) - sizes
    heads = np.cumsum(per_chunk) - per_chunk
    offset = chunks[chunk] + before[index] - before[np.minimum(heads[chunk], len(sizes) - 1)]
    steps = _table(data, stbl, b"stts", 8, ">u4,>u4")
    lasting = np.repeat(steps["f1"].astype(np.int64), steps["f0"])[: len(sizes)] if steps is not None else np.zeros(0, np.int64)
    lasting = np.pad(lasting, (0, len(sizes) - len(lasting)))
    return index, offset, sizes[index], (np.cumsum(lasting) - lasting)[index] / ticks, lasting[index] / ticks


class _Reader(RangeReader):
    suffix = ".mp4"
    KNOWN = frozenset(("sample_idx", "offset", "size", "pts", "duration"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(joined(p.value)) for p in super().partitions()]

    def read_part(self, name: str, first: int, end: int | None) -> Iterator[tuple]:
        with self.open(name) as file:
            data = movie(file)
            if data is None:
                raise ValueError(f"{name}: no movie box")
            try:
                table = sample_table(data)
            except ValueError as e:
                raise ValueError(f"{name}: {e}") from None
            known = dict(zip(("sample_idx", "offset", "size", "pts", "duration"), table, strict=True))
            here = (known["offset"] >= first) & (known["offset"] < (end or np.inf)) & self.wanted(known)
            rows = {c: v[here].tolist() for c, v in known.items()}
            for row in zip(*rows.values(), strict=True):
                values = dict(zip(rows, row, strict=True)) | {"video": name}
                if "payload" in self.columns:
                    file.seek(values["offset"])
                    values["payload"] = file.read(values["size"])
                yield tuple(values[c] for c in self.columns)


#: Bytes of a video for a task.
SPLIT = 1 << 28


class Mp4Metadata(DataSource):
    """``format("mp4_metadata")``; path: a video, or a folder of ``*.mp4``; split: bytes of a video for a task."""

    @classmethod
    def name(cls) -> str:
        return "mp4_metadata"

    def schema(self) -> str:
        return SAMPLES

    def reader(self, schema) -> _Reader:
        return _Reader(self.options, schema.fieldNames(), SPLIT)


def read_samples(spark: SparkSession, path: str, payload: bool = True, split: int = SPLIT) -> DataFrame:
    """One row per sample of the metadata tracks: video, sample_idx, offset, size, pts, duration, and payload if it is wanted."""
    register(spark, Mp4Metadata)
    schema = SAMPLES if payload else SAMPLES.removesuffix(", payload binary")
    return spark.read.format("mp4_metadata").schema(schema).option("split", split).load(path)
