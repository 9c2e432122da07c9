"""Versioned folders: a write never touches what readers read.

A versioned folder holds one data folder per version and one empty marker per *finished* version, named
``<number>-<data folder>.version``.  The marker is made last and never replaces a file, so a
version is either whole and current or not there: no rename, no overwrite, also on
object stores.  Of two writers that race for a number the name of the data folder decides.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

_MARKER = re.compile(r"^(\d{12})-([0-9a-f]{32})\.version$")


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, data folder) of the finished versions, oldest first."""
    where, fs = _folder(spark, path)
    if not fs.exists(where):
        return []
    found = (_MARKER.match(status.getPath().getName()) for status in fs.listStatus(where))
    return sorted((int(m[1]), m[2]) for m in found if m)


def current(spark: SparkSession, path: str) -> str | None:
    """Folder of the newest finished version, or None."""
    found = versions(spark, path)
    return f"{path.rstrip('/')}/{found[-1][1]}" if found else None


def new_version(path: str) -> str:
    """A fresh data folder; nobody reads it before ``publish``."""
    return f"{path.rstrip('/')}/{uuid.uuid4().hex}"


def publish(spark: SparkSession, path: str, data: str) -> None:
    """Make ``data`` the current version."""
    found = versions(spark, path)
    number = found[-1][0] + 1 if found else 1
    where, fs = _folder(spark, f"{path.rstrip('/')}/{number:012d}-{data.rsplit('/', 1)[1]}.version")
    fs.create(where, False).close()


def drop_old(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Delete all but the newest ``keep`` versions, once nothing reads the older ones."""
    found = versions(spark, path)
    for number, data in found[: max(0, len(found) - keep)]:
        for name in (f"{number:012d}-{data}.version", data):
            where, fs = _folder(spark, f"{path.rstrip('/')}/{name}")
            fs.delete(where, True)
