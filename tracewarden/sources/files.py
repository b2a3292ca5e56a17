"""Files that tasks open by themselves: members of archives by range, and single files by path.

Paths may be local, or URIs of any store that pyarrow knows.
"""

from __future__ import annotations

import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Unpacked bytes of the members that one task reads, unless a single member is larger.
PART_BYTES = 32 << 20
#: Names that a listing hands on at a time, unless a single directory has more.
LISTED_ROWS = 10_000


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a local path or URI (``file:/x`` as Spark writes it, too)."""
    local = re.fullmatch(r"file:/+(.*)", path)
    return (fs.LocalFileSystem(), "/" + local[1]) if local else fs.FileSystem.from_uri(path if "://" in path else posixpath.abspath(path))


def content(path: str) -> bytes:
    system, at = located(path)
    with system.open_input_file(at) as f:
        return f.read()


def put(path: str, data: bytes) -> None:
    system, at = located(path)
    system.create_dir(posixpath.dirname(at), recursive=True)
    with system.open_output_stream(at) as f:
        f.write(data)


def below(path: str, suffix: str) -> list[str]:
    """Files at or below ``path`` with a suffix, in order."""
    system, at = located(path)
    info = system.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted(i.path for i in found if i.type == fs.FileType.File and i.path.endswith(suffix))


def _seen(name: str) -> bool:
    """Whether Spark's file sources look at a name."""
    return not (name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_"))


def _looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Directories and files that aren't empty directly in the folders of ``path``."""
    for b in batches:
        paths, folders = [], []
        for i, folder in enumerate(b.column("path").to_pylist(), 1):
            system, at = located(folder)
            for x in system.get_file_info(fs.FileSelector(at)):
                if _seen(x.base_name) and (x.type == fs.FileType.Directory or (x.type == fs.FileType.File and x.size != 0)):
                    paths.append(f"{folder.rstrip('/')}/{x.base_name}")
                    folders.append(x.type == fs.FileType.Directory)
            if len(paths) >= LISTED_ROWS or i == b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(folders, pa.bool_())], names=["path", "folder"])
                paths, folders = [], []


def listed(spark: SparkSession, root: str) -> DataFrame:
    """``path`` of every file below the directory ``root`` that Spark's file sources would read: not the empty ones, nor names
    that begin with a dot or an underscore. Tasks list the directories, level by level; the driver gets their number alone."""
    from tracewarden.plans import scratch

    system, at = located(root)
    if system.get_file_info(at).type != fs.FileType.Directory:
        raise FileNotFoundError(f"no directory {root}")
    top = f"file:{posixpath.normpath(at)}" if isinstance(system, fs.LocalFileSystem) else root
    folders, n, levels = spark.range(1).select(F.lit(top).alias("path")), 1, []
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while n:
        levels.append(scratch.written(folders.repartition(min(n, most)).mapInArrow(_looked, "path string, folder boolean"), "listed"))
        folders = levels[-1].where("folder").select("path")
        n = folders.count()
    return reduce(DataFrame.unionByName, levels).where("NOT folder").select("path")


@dataclass
class MemberRange(InputPartition):
    archive: str
    first: int
    last: int


class _MemberReader(DataSourceReader):
    def __init__(self, path: str, pattern: str, part_bytes: int) -> None:
        self.path, self.pattern, self.part_bytes = path, pattern, part_bytes

    def _members(self, archive: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
        return [m for m in archive.infolist() if not m.is_dir() and re.search(self.pattern, m.filename)]

    def partitions(self) -> list[MemberRange]:
        """Ranges of each archive's directory, which alone is read here; names and contents stay with the tasks."""
        out = []
        system, _ = located(self.path)
        for archive in below(self.path, ".zip"):
            with system.open_input_file(archive) as f, zipfile.ZipFile(f) as z:
                sizes = [m.file_size for m in self._members(z)]
            first = total = 0
            for i, size in enumerate(sizes):
                if i > first and total + size > self.part_bytes:
                    out.append(MemberRange(archive, first, i))
                    first, total = i, 0
                total += size
            if first < len(sizes):
                out.append(MemberRange(archive, first, len(sizes)))
        return out or [MemberRange("", 0, 0)]

    def read(self, partition: MemberRange) -> Iterator[pa.RecordBatch]:
        if partition.first == partition.last:
            return
        system, _ = located(self.path)
        with system.open_input_file(partition.archive) as f, zipfile.ZipFile(f) as z:
            for m in self._members(z)[partition.first : partition.last]:
                yield pa.RecordBatch.from_arrays([pa.array([partition.archive]), pa.array([m.filename]), pa.array([z.read(m)], pa.binary())], names=["archive", "member", "content"])


class ArchiveMembers(DataSource):
    """Members of the ZIP archives at or below ``path``: archive, member, content. Options: ``pattern`` of member names (a
    regular expression), ``partBytes``. One archive is read by as many tasks as its size asks for."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return "archive string, member string, content binary"

    def reader(self, schema) -> _MemberReader:
        return _MemberReader(self.options["path"], self.options.get("pattern", ""), int(self.options.get("partBytes", PART_BYTES)))


def archive_members(spark: SparkSession, path: str, pattern: str = "", part_bytes: int = PART_BYTES) -> DataFrame:
    spark.dataSource.register(ArchiveMembers)
    return spark.read.format("archive_members").option("pattern", pattern).option("partBytes", part_bytes).load(path)


def packed(rows: DataFrame, folder: str, log: str) -> DataFrame:
    """Writes ``rows`` (member, content) as ZIP archives below ``folder``, one for each task, each with a file ``log`` of its
    member names; returns archive and members of each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, names = f"{folder}/part{TaskContext.get().partitionId():05}.zip", []
        system, at = located(path)
        system.create_dir(posixpath.dirname(at), recursive=True)
        with system.open_output_stream(at) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            for b in batches:
                for member, data in zip(b.column("member").to_pylist(), b.column("content").to_pylist(), strict=True):
                    z.writestr(member, data)
                    names.append(member)
            z.writestr(log, "\n".join(names))
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(names)], pa.int64())], names=["archive", "members"])

    return rows.select("member", "content").mapInArrow(pack, "archive string, members long")


def placed(rows: DataFrame) -> DataFrame:
    """Writes each row's ``content`` to its ``path``; returns the paths."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                put(path, data)
            yield b.select(["path"])

    return rows.select("path", "content").mapInArrow(place, "path string")


def fetched(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``rows`` with the texts of the files that the path columns name (path column: text column); null paths give null.
    Rows are dealt out to as many tasks as a shuffle has, however few hold them; a task opens its files one at a time."""
    names = rows.columns

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                paths = [one.column(c)[0].as_py() for c in columns]
                texts = [pa.array([None if p is None else content(p).decode("utf-8", "replace")], pa.string()) for p in paths]
                yield pa.RecordBatch.from_arrays([*(one.column(c) for c in names), *texts], names=[*names, *columns.values()])

    schema = ", ".join([*(f"`{n}` {t}" for n, t in rows.dtypes), *(f"`{c}` string" for c in columns.values())])
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(fetch, schema)
