"""Published versions: a set of tables that appears, and is replaced, in one step, without renaming anything.

A folder holds, for each version, a folder of its own and an empty file that names it:

    folder/_versions/000000000007-3f2a…/merged_data/part-…     the tables, written first
    folder/_current/000000000007-3f2a…                          written last, by which the version counts

Readers take the version whose name is the last in order. Creating one empty file is a single step on every file system and object
store, so a reader finds the whole old set or the whole new one, and a job that fails leaves no trace that readers see.
Earlier versions stay until they are not among the last few, so that readers who have already found them can finish.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

VERSIONS, CURRENT = "_versions", "_current"
#: The table's name in a version of one table.
TABLE = "data"
#: Versions that stay readable: the current one and those before it.
KEEP = 2


def _place(spark: SparkSession, *parts: str):
    """A Hadoop path and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path("/".join(part.rstrip("/") for part in parts))
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    path, files = _place(spark, folder)
    return sorted(status.getPath().getName() for status in files.listStatus(path)) if files.exists(path) else []


def versions(spark: SparkSession, folder: str) -> list[str]:
    """The versions of ``folder`` that count, the current one last."""
    return [name for name in _names(spark, f"{folder.rstrip('/')}/{CURRENT}") if not name.startswith((".", "_"))]


def version_path(folder: str, version: str, table: str = TABLE) -> str:
    return f"{folder.rstrip('/')}/{VERSIONS}/{version}/{table}"


def current(spark: SparkSession, folder: str, table: str = TABLE) -> str:
    """Where the current version of a table is; ``folder`` itself if it has no versions (a plain table)."""
    found = versions(spark, folder)
    return version_path(folder, found[-1], table) if found else folder


def publish(spark: SparkSession, folder: str, write: Callable[[Callable[[str], str]], None], keep: int = KEEP) -> str:
    """Write a set of tables as the next version of ``folder``; returns the version.

    ``write`` gets a function from a table's name to the path that it is to be written to. If it raises, what it has written is
    removed and the earlier version stays current. Of two jobs that publish at the same time both become versions, whole; the
    current one is that with the higher number, or of equal numbers the one with the last name. A plain table that
    stands in ``folder`` is removed after its first version counts.
    """
    if keep < 1:
        raise ValueError("the current version must be kept")
    earlier = versions(spark, folder)
    number = int(earlier[-1].partition("-")[0]) + 1 if earlier else 1
    version = f"{number:012d}-{uuid.uuid4().hex}"
    draft, files = _place(spark, folder, VERSIONS, version)
    try:
        write(lambda table: version_path(folder, version, table))
    except BaseException:
        files.delete(draft, True)
        raise
    files.create(_place(spark, folder, CURRENT, version)[0], False).close()
    _clear(spark, folder, keep, plain=not earlier)
    return version


def _clear(spark: SparkSession, folder: str, keep: int, plain: bool) -> None:
    """Remove versions that no longer count: first their names, then their tables."""
    for version in versions(spark, folder)[:-keep]:
        name, files = _place(spark, folder, CURRENT, version)
        files.delete(name, False)
        files.delete(_place(spark, folder, VERSIONS, version)[0], True)
    if plain:
        for name in _names(spark, folder):
            if name not in (VERSIONS, CURRENT):
                path, files = _place(spark, folder, name)
                files.delete(path, True)
