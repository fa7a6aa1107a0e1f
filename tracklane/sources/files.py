"""Input files of readers that parse by themselves, opened where the task runs.

A reader that can begin anywhere in a file deals ranges of bytes over tasks;
others deal files.  Where there are many, a task gets several, so that the number
of tasks grows with the bytes and not with the files.  Where folders may hold very many
files, tasks list them (:func:`listing`), and the parts stay rows of a table.  Filters on numbers that a reader knows before it
reads what is large go to it, and columns that aren't asked for aren't read.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition

from ..scratch import Tables

_TESTS: dict[type, Callable] = {
    ds.EqualTo: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le,
}


def filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def register(spark: SparkSession, source: type[DataSource]) -> None:
    """Make a source known, and let filters go to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)


#: As many parts or fewer are a task each; of more, a task gets so many bytes at most; and what opening a part costs, in bytes.
TASKS, BUNDLE, OPENING = 64, 1 << 27, 1 << 14


def dealt(parts: list[tuple], sizes: list[int], bundle: int = BUNDLE) -> list[list[tuple]]:
    """The parts, in order, as a list for each task."""
    if len(parts) <= TASKS:
        return [[p] for p in parts]
    costs = [s + OPENING for s in sizes]
    room, out, left = min(bundle, sum(costs) // TASKS + 1), [], 0
    for part, cost in zip(parts, costs, strict=True):
        if left < cost or not out:
            out.append([])
            left = room
        out[-1].append(part)
        left -= cost
    return out


def files(path: str, suffix: str) -> list[tuple[str, int]]:
    """(name, bytes) of a file, or of all files of a folder and its folders whose names end so, in order of names."""
    fs, root = filesystem(path)
    info = fs.get_file_info(root)
    if info.type == pa.fs.FileType.File:
        return [(root, info.size)]
    found = fs.get_file_info(pa.fs.FileSelector(root, recursive=True))
    return sorted((f.path, f.size) for f in found if f.path.lower().endswith(suffix))


#: Files that a task hands on at once.
LISTED = 10_000


def listing(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(name, size) as :func:`files`, in no order, as a table: each folder is listed by a task, those of one depth at a time."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(path)
        for batch in batches:
            for folder in batch["name"].to_pylist():
                info = fs.get_file_info(folder)
                if info.type == pa.fs.FileType.File:
                    found = [info]
                else:
                    found = [f for f in fs.get_file_info(pa.fs.FileSelector(folder)) if f.type == pa.fs.FileType.Directory or f.path.lower().endswith(suffix)]
                for i in range(0, len(found), LISTED):
                    some = found[i : i + LISTED]
                    columns = [f.path for f in some], [f.size or 0 for f in some], [f.type == pa.fs.FileType.Directory for f in some]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.bool_()), strict=True)], ["name", "size", "folder"])

    levels, tables, most = [], Tables(spark, "listing"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    folders, n = spark.createDataFrame([(filesystem(path)[1],)], "name string"), 1
    while n:
        levels.append(tables.put(folders.repartition(min(n, most)).mapInArrow(look, "name string, size long, folder boolean"), f"level-{len(levels)}"))
        folders = levels[-1].where("folder").select("name")
        n = folders.count()
    found = spark.read.schema(levels[0].schema).parquet(*(tables.path(f"level-{k}") for k in range(len(levels))))
    return found.where("NOT folder").select("name", "size")


def spread(parts: DataFrame, size: Column, order: list[str], bundle: int = BUNDLE) -> DataFrame:
    """Rows that are parts of files, of so many bytes, in as many tasks as :func:`dealt` makes about; few are in order."""
    n, cost = parts.agg(F.count("*"), F.sum(size + OPENING)).first()
    if n <= TASKS:
        one = parts.coalesce(1).sortWithinPartitions(*order).withColumn("_task", F.monotonically_increasing_id().cast("int"))
        return one.repartitionById(max(n, 1), "_task").drop("_task")
    return parts.repartition(max(TASKS, -(-cost // bundle)))


class FileReader(DataSourceReader):
    """A file, or all files of a folder and its folders whose names end as ``suffix`` says."""

    suffix = ""

    def __init__(self, options: dict):
        self.path = options["path"]

    def parts(self) -> tuple[list[tuple], list[int]]:
        """What is dealt over tasks, and the bytes of each."""
        raise NotImplementedError

    def read_part(self, *part) -> Iterator:
        """The rows of one of the parts."""
        raise NotImplementedError

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(some) for some in dealt(*self.parts())] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator:
        for part in partition.value:
            yield from self.read_part(*part)

    def open(self, name: str):
        """A file with seek."""
        return filesystem(self.path)[0].open_input_file(name)


class RangeReader(FileReader):
    """Parts of ``split`` bytes of a file: (name, first byte, end), the end of the last one is None.

    ``columns`` are those that are asked for; tests on the columns ``KNOWN`` are
    the reader's, and :meth:`wanted` puts them to arrays or numbers.
    """

    KNOWN: frozenset[str] = frozenset()

    def __init__(self, options: dict, columns: list[str], split: int):
        super().__init__(options)
        self.columns, self.split, self.tests = columns, int(options.get("split", split)), []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in self.KNOWN and isinstance(f.value, (int, float)):
                self.tests.append((f.attribute[0], _TESTS[type(f)], f.value))
            else:
                yield f

    def wanted(self, known: dict):
        """Whether the values of KNOWN columns pass all tests."""
        keep = True
        for column, test, value in self.tests:
            keep = test(known[column], value) & keep
        return keep

    def parts(self) -> tuple[list[tuple], list[int]]:
        out, sizes = [], []
        for name, size in files(self.path, self.suffix):
            firsts = range(0, max(size, 1), self.split)
            out += [(name, a, a + self.split if a + self.split < size else None) for a in firsts]
            sizes += [min(self.split, size - a) for a in firsts]
        return out, sizes


def joined(parts: list[tuple]) -> list[tuple]:
    """Ranges (name, first byte, end, ...) with those that follow one another in a file as one, with the rest of the first."""
    out = []
    for name, a, b, *rest in parts:
        if out and out[-1][0] == name:
            name, a, _, *rest = out.pop()
        out.append((name, a, b, *rest))
    return out
