"""A log of training states: data first, then one small commit file, so a killed run leaves the last commit whole.

Below ``path``: ``data/<name>`` (Parquet, one row for each array) and
``log/<version>.json``. A version counts once its log file stands under its own
name, which a rename puts there; data without a log file is ignored and cleared
by the next commit. Files go through Spark's file system, so any store will do.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession


@dataclass
class State:
    """arrays: named arrays; note: what else is remembered (JSON)."""

    version: int
    arrays: dict[str, np.ndarray]
    note: dict


def digest(arrays: dict[str, np.ndarray]) -> str:
    h = hashlib.sha256()
    for k in sorted(arrays):
        x = np.asarray(arrays[k], float)
        h.update(f"{k}{x.shape}".encode() + x.tobytes())
    return h.hexdigest()


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, None where there is none."""
    system, at = _file_system(spark, path)
    if not system.exists(at):
        return None
    (row,) = spark.read.text(path, wholetext=True).collect()
    return row["value"]


def write_once(spark: SparkSession, path: str, text: str, replace: bool = False) -> bool:
    """Puts a small file in its place by a rename, so it is there as a whole or not at all. False if one was there already
    (unless it is replaced)."""
    system, final = _file_system(spark, path)
    parent = final.getParent()
    draft = spark._jvm.org.apache.hadoop.fs.Path(parent, f".{final.getName()}-{uuid.uuid4().hex}")
    out = system.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    if replace and system.exists(final):
        system.delete(final, False)
    if system.exists(final) or not system.rename(draft, final):
        system.delete(draft, False)
        return False
    return True


class Log:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs, _ = _file_system(spark, self.path)

    def _at(self, *parts: str):
        return _file_system(self.spark, "/".join((self.path, *parts)))[1]

    def versions(self) -> list[int]:
        if not self._fs.exists(self._at("log")):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at("log"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def record(self, version: int) -> dict:
        return json.loads(read_text(self.spark, f"{self.path}/log/{version:08}.json"))

    def commit(self, version: int, arrays: dict[str, np.ndarray], note: dict, keep: tuple[int, ...] = ()) -> None:
        """Writes a version and makes it count; data of versions other than this one and ``keep`` goes."""
        have = self.versions()
        if have and version <= have[-1]:
            raise ValueError(f"version {version} is not after {have[-1]}, the last one in {self.path}")
        name = f"{version:08}-{uuid.uuid4().hex}"
        rows = [(k, list(np.shape(v)), np.asarray(v, float).ravel().tolist()) for k, v in sorted(arrays.items())]
        self.spark.createDataFrame(rows, "name string, shape array<int>, data array<double>").coalesce(1).write.parquet(f"{self.path}/data/{name}")
        text = json.dumps({"version": version, "data": name, "sha256": digest(arrays), "note": note}, sort_keys=True)
        if not write_once(self.spark, f"{self.path}/log/{version:08}.json", text):
            raise ValueError(f"version {version} of {self.path} was committed by another run")
        used = {name} | {self.record(v)["data"] for v in have if v in keep}
        for f in self._fs.listStatus(self._at("data")):
            if f.getPath().getName() not in used:
                self._fs.delete(f.getPath(), True)

    def read(self, version: int | None = None) -> State | None:
        """A version (the last one if none is named), checked against its digest; None without any."""
        have = self.versions()
        if version is None and not have:
            return None
        r = self.record(have[-1] if version is None else version)
        rows = self.spark.read.parquet(f"{self.path}/data/{r['data']}").collect()  # as many numbers as the model has
        arrays = {x["name"]: np.array(x["data"]).reshape(x["shape"]) for x in rows}
        if digest(arrays) != r["sha256"]:
            raise ValueError(f"version {r['version']} of {self.path} is not what was committed")
        return State(r["version"], arrays, r["note"])
