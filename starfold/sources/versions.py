"""Folders whose content changes in one step.

Data goes to a fresh sub-folder first. A commit is one small file, ``_versions/<number>.json``, that says which
sub-folders are the content now; it appears by a rename that fails if that number exists. Whoever reads takes
the file with the highest number, so a write that fails half-way, or two at once, never show half a table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer committed first."""


class Versions:
    """The commits of one folder on any file system that Spark's readers know."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._log = self._path(f"{self.folder}/_versions")
        self._fs = self._log.getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """The committed versions, ascending."""
        if not self._fs.exists(self._log):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._log)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def read(self, number: int | None = None) -> dict | None:
        """The content of a version, by default the last; None when nothing was committed."""
        numbers = self.numbers()
        if not numbers:
            return None
        path = self._path(f"{self.folder}/_versions/{(number or numbers[-1]):010d}.json")
        stream = self._fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def fresh(self, name: str = "data") -> str:
        """A sub-folder no commit points to yet."""
        return f"{name}-{uuid.uuid4().hex}"

    def commit(self, content: dict, after: int) -> int:
        """Make ``content`` version ``after + 1``; raises ``Conflict`` if that version exists."""
        number = after + 1
        goal = self._path(f"{self.folder}/_versions/{number:010d}.json")
        draft = self._path(f"{self.folder}/_versions/.{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        if self._fs.exists(goal) or not self._fs.rename(draft, goal):
            self._fs.delete(draft, False)
            raise Conflict(f"version {number} of {self.folder} exists")
        return number

    def drop_unused(self, keep: int = 2) -> None:
        """Delete versions but the last ``keep`` and the sub-folders that none of those names."""
        numbers = self.numbers()
        used = {name for n in numbers[-keep:] for name in self.read(n)["parts"].values()}
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.folder}/_versions/{n:010d}.json"), False)
        for status in self._fs.listStatus(self._path(self.folder)):
            name = status.getPath().getName()
            if name != "_versions" and name not in used:
                self._fs.delete(status.getPath(), True)


def last_number(versions: Versions) -> int:
    return (versions.numbers() or [0])[-1]


def write_committed(df: DataFrame, folder: str, write: Callable[[DataFrame, str], None]) -> str:
    """Write a table by ``write(df, path)`` and make it the content of the folder; returns its path.

    Until the commit, and if the write fails, readers see the content of before.
    """
    versions = Versions(df.sparkSession, folder)
    after = last_number(versions)
    name = versions.fresh()
    write(df, f"{versions.folder}/{name}")
    versions.commit({"parts": {"data": name}}, after)
    return f"{versions.folder}/{name}"


def committed_path(spark: SparkSession, folder: str, number: int | None = None) -> str:
    """Where the content of a folder written by ``write_committed`` lies."""
    content = Versions(spark, folder).read(number)
    if content is None:
        raise FileNotFoundError(f"nothing was committed to {folder}")
    return f"{folder.rstrip('/')}/{content['parts']['data']}"
