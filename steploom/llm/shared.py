"""Helpers of the operators: written tables in the shared folder, guarded broadcasts, text in the ASCII sense."""

from __future__ import annotations

import functools
import os
import shutil
import string
import tempfile
import uuid
import weakref
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most so many narrow rows (keys, hashes: under 100 bytes each) are broadcast: 20 MB. Beyond it the join shuffles.
BROADCAST_ROWS = 200_000

#: The ASCII white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"


class Memo(dict):
    """What ``find`` returns for texts, remembered for the last ones: ``size`` at least and twice as many at most, none longer than ``chars``.

    When it is full, texts that were asked for since it last was stay, and the others go: frequent ones are found once.
    """

    def __init__(self, find: Callable[[str], Any], size: int, chars: int, use: str) -> None:
        super().__init__()
        self.find, self.size, self.chars, self.use = find, size, chars, use
        self.older: dict[str, Any] = {}
        _memos[id(self)] = self

    def __missing__(self, text: str) -> Any:
        found = self.older.get(text)
        if found is None:
            found = self.find(text)
        self._keep(text, found)
        return found

    def _keep(self, text: Any, found: Any) -> None:
        if len(text) <= self.chars:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[text] = found

    def many(self, texts: list, find_all: Callable[[list], list]) -> list:
        """What is found for each of ``texts``, all different; ``find_all`` finds the unknown ones together (never None)."""
        found = list(map(self.get, texts))
        absent = [i for i, value in enumerate(found) if value is None]
        older = list(map(self.older.get, [texts[i] for i in absent]))
        unknown = iter(find_all([texts[i] for i, value in zip(absent, older, strict=True) if value is None]))
        for i, value in zip(absent, older, strict=True):
            found[i] = next(unknown) if value is None else value
            self._keep(texts[i], found[i])
        return found


_memos: weakref.WeakValueDictionary[int, Memo] = weakref.WeakValueDictionary()


def turn_to(use: str) -> None:
    """Empty this worker's memos of other uses: a worker goes from the tasks of one operator to those of the next, and would keep all."""
    for memo in list(_memos.values()):
        if memo.use != use:
            memo.clear()
            memo.older = {}


@functools.cache
def _archive() -> str:
    import steploom

    root = os.path.dirname(os.path.dirname(os.path.abspath(steploom.__file__)))
    return shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="steploom-code-"), "steploom"), "zip", root, "steploom")


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per application: they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        context.addPyFile(_archive())
        _shipped.add(context.applicationId)


#: By application: its folder where none is named. The setting itself can't be changed in a running session.
_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; a local one only where none is named and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    application = spark.sparkContext.applicationId
    if application not in _own_folders:
        _own_folders[application] = tempfile.mkdtemp(prefix="steploom-")
    return _own_folders[application]


def _run_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/steploom-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Remove all tables that operators wrote to the shared folder in this application. Results not stored elsewhere are lost with them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written once to the shared folder: lost executors lose nothing of it, and its lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has at most BROADCAST_ROWS rows. Give a written table, as it is counted."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; all other characters as they are. Text of ASCII alone takes the quick way."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
