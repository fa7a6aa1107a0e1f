"""Files with names and orders of their own: ``format("named_text")`` and the base of other such sinks.

Rows come to a task file by file, in order (see :func:`write_files`); each file is
written under a name of the attempt's own and gets its final name when the whole
job has ended, so that lost executors leave no half file.  What a task has written
is listed in a file, of which the driver reads a few names at a time.  A name's rows are
written by one task.  A file that may be as large as the table is written by many
(see :func:`write_large`): each makes a part of it in the shared folder, and the
sink's task puts the parts together, byte by byte, without a row in memory.
"""

from __future__ import annotations

import io
import json
import posixpath
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import batched, chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..scratch import Tables
from .files import filesystem

#: Bytes of a part that are copied at once, files that get their names at once, and names that are held for it.
COPY, MOVERS, HELD = 1 << 22, 32, 1024


@dataclass
class Written(WriterCommitMessage):
    """The file that lists (name of the attempt, final name) of each file of a task; none where it wrote none."""

    listed: str | None


def runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[str, Iterator[pa.RecordBatch]]]:
    """Each value of a column of texts with the rows, one after the other, that have it."""

    def pieces() -> Iterator[tuple[str, pa.RecordBatch]]:
        for batch in batches:
            if batch.num_rows:
                values = batch[column].dictionary_encode()
                at = np.flatnonzero(np.diff(values.indices.to_numpy())) + 1
                for a, b in zip([0, *at.tolist()], [*at.tolist(), batch.num_rows], strict=True):
                    yield batch[column][a].as_py(), batch.slice(a, b - a)

    for value, own in groupby(pieces(), key=itemgetter(0)):
        yield value, map(itemgetter(1), own)


class NamedWriter(DataSourceArrowWriter):
    """The base: ``fill`` writes the rows of one file, of the columns ``name`` and others."""

    def __init__(self, options: dict):
        self.path, self.options = options["path"], dict(options)

    def fill(self, out, batches: Iterator[pa.RecordBatch]) -> None:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = filesystem(self.path)
        first = next(files := self._files(fs, root, iterator), None)
        if first is None:
            return Written(None)
        listed = posixpath.join(root, f".{uuid.uuid4().hex}.list")
        with fs.open_output_stream(listed, compression=None) as out:
            for names in chain([first], files):
                out.write(json.dumps(names).encode() + b"\n")
        return Written(listed)

    def _files(self, fs, root: str, iterator: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
        """Write the files, and tell the names of each that is written."""
        for name, own in runs(iterator, "name"):
            final = posixpath.join(root, name)
            attempt = posixpath.join(posixpath.dirname(final), f".{uuid.uuid4().hex}.part")
            fs.create_dir(posixpath.dirname(final), recursive=True)
            with fs.open_output_stream(attempt, compression=None) as out:
                self.fill(out, own)
            yield attempt, final

    def _each(self, messages: list, act: Callable[[str, str], None]) -> None:
        """Do something for (attempt, final) of all files, then drop the lists."""
        fs, _ = filesystem(self.path)
        lists = [m.listed for m in messages if m and m.listed]
        with ThreadPoolExecutor(MOVERS) as pool:
            for listed in lists:
                with fs.open_input_stream(listed, compression=None) as file:
                    for some in batched(io.BufferedReader(file), HELD):
                        list(pool.map(lambda line: act(*json.loads(line)), some))
        for listed in lists:
            fs.delete_file(listed)

    def commit(self, messages: list) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        self._each(messages, fs.move)

    def abort(self, messages: list) -> None:
        fs, _ = filesystem(self.path)
        self._each(messages, lambda attempt, _: fs.delete_file(attempt))


def copy_parts(out, batches: Iterator[pa.RecordBatch]) -> None:
    """Write the bytes of the files of a column ``part``."""
    for batch in batches:
        for part in batch["part"].to_pylist():
            fs, name = filesystem(part)
            with fs.open_input_stream(name, compression=None) as file:
                while data := file.read(COPY):
                    out.write(data)


def text_of(lines: pa.Array) -> bytes:
    return "".join(f"{line}\r\n" for line in lines.to_pylist()).encode()


class _TextWriter(NamedWriter):
    def fill(self, out, batches: Iterator[pa.RecordBatch]) -> None:
        out.write(self.options.get("lead", "").encode())
        if self.options.get("parts"):
            return copy_parts(out, batches)
        for k, batch in enumerate(batches):
            if not k and "head" in batch.schema.names:
                out.write(text_of(batch["head"].slice(0, 1)))
            out.write(text_of(batch["line"]))


class NamedText(DataSource):
    """Rows (name, line) as lines of the files of those names; option lead: text before the first line.

    With a column head, the first row's is a line before all; with the option parts, rows
    (name, part) name files whose bytes follow instead.
    """

    @classmethod
    def name(cls) -> str:
        return "named_text"

    def writer(self, schema, overwrite: bool) -> _TextWriter:
        return _TextWriter(self.options)


class _BytesWriter(NamedWriter):
    def fill(self, out, batches: Iterator[pa.RecordBatch]) -> None:
        for batch in batches:
            for data in batch["data"]:
                out.write(data.as_buffer())


class NamedBytes(DataSource):
    """Rows (name, data) one after the other as the files of those names."""

    @classmethod
    def name(cls) -> str:
        return "named_bytes"

    def writer(self, schema, overwrite: bool) -> _BytesWriter:
        return _BytesWriter(self.options)


def write_files(rows: DataFrame, path: str, form: str, order: list[str], **options: str) -> None:
    """Write rows(name, ...) by a sink of this module, each name's rows in order of the columns ``order``, which are not handed on."""
    dealt = rows.repartition("name").sortWithinPartitions("name", *order)
    dealt.drop(*order).write.format(form).options(**options).mode("append").save(path)


def write_large(rows: DataFrame, path: str, form: str, order: list[str], fill: Callable[..., dict], about: str, **options: str) -> None:
    """As :func:`write_files`, but that many tasks write a file: ranges of the order are parts, which the sink puts together.

    ``fill`` writes rows of one name to an open file and tells what the columns ``about`` say of them.
    """
    tables = Tables(rows.sparkSession, "parts")
    folder = tables.path("files")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        for name, own in runs(batches, "name"):
            part = f"{uuid.uuid4().hex}.part"
            with fs.open_output_stream(posixpath.join(root, part), compression=None) as out:
                known = fill(out, own)
            yield pa.RecordBatch.from_pylist([{"name": name, "range": TaskContext.get().partitionId(), "part": f"{folder}/{part}", **known}])

    once = tables.put(rows, "rows")  # the bounds of ranges are sampled from it before it is dealt
    dealt = once.repartitionByRange("name", *order).sortWithinPartitions("name", *order).drop(*order)
    parts = tables.put(dealt.mapInArrow(write, f"name string, range long, part string{about}"), "parts")
    write_files(parts, path, form, ["range"], parts="true", **options)
    for name in ("rows", "files"):
        tables.drop(name)


def csv_line(columns: list[Column]) -> Column:
    """Values as a line of CSV: nulls are empty, quotes only where they are needed."""
    text = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    quoted = [F.when(t.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t) for t in text]
    return F.array_join(F.array(*quoted), ",")


BOM = "﻿"


def write_csv(rows: DataFrame, path: str, name: Column, order: list[Column], bom: bool = True, header: list[str] | None = None) -> None:
    """One CSV with a header line for each ``name``, rows in order; a name without rows has no file.

    All columns of ``rows`` are written, under their own names or ``header``.  A file may be as large as the table.
    """
    rows.sparkSession.dataSource.register(NamedText)
    places = [f"_o{k}" for k in range(len(order))]
    lines = rows.select(name.alias("name"), *(c.alias(p) for c, p in zip(order, places, strict=True)), csv_line([F.col(f"`{c}`") for c in rows.columns]).alias("line"))
    head = ",".join(f'"{c.replace(chr(34), chr(34) * 2)}"' if set(c) & set('",\r\n') else c for c in header or rows.columns)

    def fill(out, batches: Iterator[pa.RecordBatch]) -> dict:
        for batch in batches:
            out.write(text_of(batch["line"]))
        return {}

    write_large(lines, path, "named_text", places, fill, "", lead=f"{BOM if bom else ''}{head}\r\n")
