"""Files of own formats, written by Spark's tasks and committed by a manifest.

Each task writes files under names that nothing else has; the commit lists those
of the tasks that ended in ``manifest.json``, and only they are read.  So lost
executors and repeated attempts leave files that nobody sees, never half results.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage


def filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: its number, and each file's name and rows (or ids)."""

    part: int
    files: list[tuple[str, int]]


class ManifestWriter(DataSourceArrowWriter):
    """The base of writers: ``create`` files in write, and return ``written`` from it."""

    suffix = ""

    def __init__(self, options: dict):
        self.path = options["path"]

    def create(self):
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}{self.suffix}"
        return name, fs.open_output_stream(f"{root}/{name}", compression=None)

    def written(self, files: list[tuple[str, int]]) -> Written:
        return Written(TaskContext.get().partitionId(), files)

    def commit(self, messages: list) -> None:
        fs, root = filesystem(self.path)
        files = [f for m in sorted((m for m in messages if m), key=lambda m: m.part) for f in m.files]
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/manifest.json") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list) -> None:
        fs, root = filesystem(self.path)
        for name in (name for m in messages if m for name, _ in m.files):
            fs.delete_file(f"{root}/{name}")


def manifest(path: str) -> list[tuple[str, int]]:
    """Names and numbers of the committed files, in order of the tasks."""
    fs, root = filesystem(path)
    with fs.open_input_file(f"{root}/manifest.json") as file:
        return [tuple(f) for f in json.loads(file.read())]
