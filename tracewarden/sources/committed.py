"""A sink of text lines that commits: all files and their manifest, or nothing.

Each task writes one file below a staging folder of this write, and counts and
digests its lines as they pass. What it returns is a commit message; when all have
come, the files go to their place and the manifest (path, rows, sha256), which
makes them count, is written last. A task that runs again writes a file of another
name, so only those that were committed are moved. A failed write is cleared away.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tracewarden.sources.files import located

MANIFEST = "manifest.json"
STAGING = "_staging"
#: Lines that are put into one piece at a time.
LINES = 64


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int
    sha256: str


class _LineWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.id = path, overwrite, uuid.uuid4().hex
        system, at = located(path)
        if not overwrite and system.get_file_info(posixpath.join(at, MANIFEST)).type != fs.FileType.NotFound:
            raise ValueError(f"{path} has been written")

    def _staging(self) -> tuple[fs.FileSystem, str, str]:
        system, at = located(self.path)
        return system, at, posixpath.join(at, STAGING, self.id)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, _, staging = self._staging()
        task = TaskContext.get()
        name = f"part-{task.partitionId():05}-{task.taskAttemptId()}.jsonl"
        system.create_dir(staging, recursive=True)
        h, rows = hashlib.sha256(), 0
        with system.open_output_stream(posixpath.join(staging, name)) as f:
            for batch in iterator:
                for i in range(0, batch.num_rows, LINES):
                    lines = [x for x in batch.column("value").slice(i, LINES).to_pylist() if x is not None]
                    data = "".join(f"{x}\n" for x in lines).encode()
                    h.update(data)
                    f.write(data)
                    rows += len(lines)
        return Written(name, rows, h.hexdigest())

    def commit(self, messages: list[Written | None]) -> None:
        system, at, staging = self._staging()
        kept = sorted((m for m in messages if m is not None), key=lambda m: m.name)
        named = [(m, f"part-{i:05}-{self.id}.jsonl") for i, m in enumerate(m for m in kept if m.rows)]
        old = self._files(system, at)
        for m, name in named:
            system.move(posixpath.join(staging, m.name), posixpath.join(at, name))
        text = json.dumps([{"path": name, "rows": m.rows, "sha256": m.sha256} for m, name in named], indent=1)
        draft = posixpath.join(staging, MANIFEST)
        system.create_dir(staging, recursive=True)
        with system.open_output_stream(draft) as f:
            f.write(text.encode())
        if self.overwrite and system.get_file_info(posixpath.join(at, MANIFEST)).type != fs.FileType.NotFound:
            system.delete_file(posixpath.join(at, MANIFEST))
        system.move(draft, posixpath.join(at, MANIFEST))
        for name in old:
            system.delete_file(posixpath.join(at, name))
        system.delete_dir(staging)

    def abort(self, messages: list[Written | None]) -> None:
        system, _, staging = self._staging()
        if system.get_file_info(staging).type != fs.FileType.NotFound:
            system.delete_dir(staging)

    @staticmethod
    def _files(system: fs.FileSystem, at: str) -> list[str]:
        found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
        return [posixpath.basename(i.path) for i in found if i.type == fs.FileType.File and i.path.endswith(".jsonl")]


class CommittedLines(DataSource):
    """Sink of one column ``value`` at ``path``."""

    @classmethod
    def name(cls) -> str:
        return "committed_lines"

    def writer(self, schema, overwrite: bool) -> _LineWriter:
        return _LineWriter(self.options["path"], overwrite)


def write_lines(lines: DataFrame, path: str, overwrite: bool = False) -> None:
    """Writes column ``value`` of ``lines``; null values are left out."""
    lines.sparkSession.dataSource.register(CommittedLines)
    lines.select(F.col("value").cast("string").alias("value")).write.format("committed_lines").mode("overwrite" if overwrite else "append").save(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, rows, sha256 of the files of a committed write, in their order; raises where there is none."""
    return spark.read.schema("path string, rows long, sha256 string").option("multiLine", True).json(posixpath.join(path, MANIFEST))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value``: the lines of the files that the manifest names, and of no others."""
    names = [r["path"] for r in manifest(spark, path).collect()]  # one row for each file
    return spark.read.text([posixpath.join(path, n) for n in names]) if names else spark.createDataFrame([], "value string")
