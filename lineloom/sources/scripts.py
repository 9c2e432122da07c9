"""Reading a folder of scripts."""

from __future__ import annotations

import functools
import math
import os
import re
from collections.abc import Iterable, Iterator
from fnmatch import fnmatchcase

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.session import materialize


def plain_path(uri: Column) -> Column:
    """Path without its scheme and authority."""
    return F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root``."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)


#: Names that one batch of a listing holds, and bytes of text that one batch of a read holds.
LISTED, HELD = 10_000, 8 << 20
#: Bytes of scripts that one task reads, each file counted with a cost of its own for opening it.
TASK_BYTES, OPEN_COST = 64 << 20, 16 << 10
#: Folders that one task lists.
FOLDERS = 64

_LISTING = "path string, folder boolean, bytes bigint"


def local_filesystem(uri: str):
    """The file system of a URI for reading in a task, and the path in it; None where there is none."""
    from pyarrow import fs

    scheme = uri.split(":", 1)[0] if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", uri) else "file"
    if scheme == "file":
        return fs.LocalFileSystem(), re.sub(r"^file:(//[^/]*)?", "", uri)
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def _patterns(glob: str) -> list[str]:
    """``glob`` without braces: one pattern for each choice."""
    braces = re.search(r"\{([^{}]*)\}", glob)
    if not braces:
        return [glob.replace("[^", "[!")]
    return [p for part in braces[1].split(",") for p in _patterns(glob[: braces.start()] + part + glob[braces.end() :])]


def _entries(filesystem, folder: str) -> Iterator[tuple[str, bool, int]]:
    """(name, is folder, bytes) of what one folder holds; a local folder is streamed, links to folders are not followed."""
    from pyarrow import fs

    if isinstance(filesystem, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for entry in found:
                if entry.is_dir(follow_symlinks=False):
                    yield entry.name, True, 0
                elif entry.is_file():
                    yield entry.name, False, entry.stat().st_size
        return
    for info in filesystem.get_file_info(fs.FileSelector(folder)):
        if info.type != fs.FileType.NotFound:
            yield info.base_name, info.type == fs.FileType.Directory, info.size or 0


def _qualified(spark: SparkSession, root: str) -> str:
    """``root`` with its scheme; a root that isn't there is an error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        raise FileNotFoundError(f"no folder {root}")
    return system.makeQualified(where).toString().rstrip("/")


def _listing(spark: SparkSession, root: str, glob: str) -> tuple[DataFrame, int]:
    """``(path, bytes)`` of the files below the qualified ``root``, paths relative, and their cost in bytes.

    One job per level of folders.  Its tasks list a few folders each and write what they find as rows, so the driver knows
    only how many folders a level has and how many bytes of files.
    """
    patterns = _patterns(glob)

    def look(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, base = local_filesystem(root)
        rows = []
        for batch in batches:
            for folder in batch["path"]:
                for name, is_folder, size in _entries(filesystem, f"{base}/{folder}".rstrip("/") or "/"):
                    if is_folder or any(fnmatchcase(name, p) for p in patterns):
                        rows.append((f"{folder}/{name}" if folder else name, is_folder, size))
                    if len(rows) >= LISTED:
                        yield pd.DataFrame(rows, columns=["path", "folder", "bytes"])
                        rows = []
        yield pd.DataFrame(rows, columns=["path", "folder", "bytes"])

    level, pending, levels, cost = spark.createDataFrame([("",)], "path string"), 1, [], 0
    while pending:
        spread = level.repartition(max(1, math.ceil(pending / FOLDERS)), "path")
        found, seen = materialize(
            spread.mapInPandas(look, _LISTING), "listing", folders=F.count_if("folder"), cost=F.sum(F.when(~F.col("folder"), F.col("bytes") + OPEN_COST))
        )
        levels.append(found.where("NOT folder").select("path", "bytes"))
        level, pending, cost = found.where("folder").select("path"), seen["folders"] or 0, cost + (seen["cost"] or 0)
    return functools.reduce(DataFrame.unionByName, levels), cost


def script_paths(spark: SparkSession, root: str, glob: str = "*.sql") -> DataFrame:
    """``(path, bytes)`` of every script under ``root``, without opening any."""
    found, _ = _listing(spark, where := _qualified(spark, root), glob)
    base = plain_path(F.lit(where))
    return found.select(F.concat_ws("/", base, "path").alias("path"), "bytes")


def script_scan(spark: SparkSession, root: str, glob: str = "*.sql") -> DataFrame:
    """``(path, content)``: every script under ``root``, one row per file, hidden and empty ones too.

    Folders are listed by tasks, level by level, when the scan is made; files are dealt to read tasks by a hash of their path, so
    that a task gets about ``TASK_BYTES``, and are opened when the result is read.  ``glob`` is matched with the file's name
    (``*``, ``?``, ``[...]``, ``{a,b}``).  Links to folders are not followed.  The file system must be one that pyarrow knows.
    """
    where = _qualified(spark, root)
    found, cost = _listing(spark, where, glob)

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, base = local_filesystem(where)
        rows, held = [], 0
        for batch in batches:
            for path in batch["path"]:
                with filesystem.open_input_file(f"{base}/{path}") as f:
                    rows.append((path, f.read()))
                held += len(rows[-1][1]) + OPEN_COST
                if held >= HELD:
                    yield pd.DataFrame(rows, columns=["path", "content"])
                    rows, held = [], 0
        yield pd.DataFrame(rows, columns=["path", "content"])

    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(cost / TASK_BYTES))
    raw = found.select("path").repartition(tasks, "path").mapInPandas(read, "path string, content binary")
    # Bytes that are not UTF-8 become replacement marks; line ends become \n.
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\r\n?", "\n")
    return raw.select(F.concat_ws("/", plain_path(F.lit(where)), "path").alias("path"), text.alias("content"))


def export_scripts(scripts: DataFrame, root: str) -> None:
    """Write ``(path, content)`` as files below ``root`` from the tasks; a retry rewrites the same files."""

    def write(batches):
        filesystem, base = local_filesystem(root)
        made = set()
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                folder = f"{base}/{path}".rsplit("/", 1)[0]
                if folder not in made:
                    filesystem.create_dir(folder, recursive=True)
                    made.add(folder)
                with filesystem.open_output_stream(f"{base}/{path}") as out:
                    out.write(content.encode("utf-8"))
            yield pd.DataFrame({"n": [len(batch)]})

    scripts.select("path", "content").mapInPandas(write, "n long").agg(F.sum("n")).collect()
