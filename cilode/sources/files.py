"""Trees of configuration files as DataFrames (path, modificationTime, length, content).

Folders are listed by tasks: a task walks down from the folders it was given until it has
seen a number of entries, and hands back the folders it did not come to. They are dealt out
again, round by round, until none is left; a small tree is one round. The files found stay in
a table in the shared folder. Read in the order of their paths, they are cut into splits by
bytes and number, one per task. The driver holds neither folders nor files.
"""

from __future__ import annotations

import datetime
import os
import sys

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cilode.operators.order import with_sums_before
from cilode.operators.stored import stored

FILES = "path string, modificationTime timestamp, length bigint, content binary"
LISTED = "path string, modificationTime timestamp, length bigint, folder boolean"
SUFFIXES = (".yml", ".yaml")
SPLIT_BYTES = 64 << 20
SPLIT_FILES = 5_000
BATCH_BYTES = 16 << 20
ROW_GROUP_BYTES = 32 << 20
# Entries that a task looks at before it hands back the folders left, and folders of a task.
LIST_ENTRIES = 100_000
LIST_FOLDERS = 1_000

_TIME = pa.timestamp("us", tz="UTC")


def config_files(
    spark: SparkSession,
    path: str,
    exact: bool = True,
    on_unreadable: str = "fail",
    split_bytes: int = SPLIT_BYTES,
    split_files: int = SPLIT_FILES,
    list_entries: int = LIST_ENTRIES,
    list_folders: int = LIST_FOLDERS,
) -> DataFrame:
    """All `.yml` and `.yaml` files below a folder, at any depth, hidden and empty ones included.

    `path` is a folder that all executors see, or a URL that Arrow's file systems know. A root
    that is not there raises. A folder or file that cannot be read raises too, unless
    `on_unreadable` is `error_row`: then it is a row without content. The folders are listed
    when this is called, the files are read when the rows are asked for; a task reads up to
    `split_bytes` or `split_files` of them.

    With `exact=False` Spark's own reader is used, for storage that only Spark knows; it leaves
    out empty files and all names, and all folders, that begin with a dot or an underscore.
    """
    if on_unreadable not in ("fail", "error_row"):
        raise ValueError(f"on_unreadable: {on_unreadable!r}")
    if not exact:
        return (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.{yml,yaml}")
            .load(path)
        )
    lenient = on_unreadable == "error_row"
    found = listed(spark, path, lenient, list_entries, list_folders)
    return split(found, split_bytes, split_files).mapInArrow(_read(path, lenient), FILES)


def compact(files: DataFrame, out: str) -> DataFrame:
    """Store a tree as one Parquet table and read it back.

    Many small files cost a request each, every time; a table is split by size, and queries
    that need no content do not read it. Row groups are kept small, as a scan task takes
    whole ones and loading YAML is slow next to reading it.
    """
    files.write.mode("overwrite").option("parquet.block.size", ROW_GROUP_BYTES).parquet(out)
    return files.sparkSession.read.parquet(out)


def _opened(path: str):
    """The file system of a path or URL, and the path there."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _entries(store, folder: str):
    """(path, time, length, whether it is a folder) of what a folder holds; a link that leads
    nowhere is a file without a length."""
    if not isinstance(store, fs.LocalFileSystem):
        for entry in store.get_file_info(fs.FileSelector(folder)):
            yield entry.path, entry.mtime, entry.size, entry.type == fs.FileType.Directory
        return
    with os.scandir(folder) as entries:
        for entry in entries:
            try:
                stat = entry.stat()
            except OSError:
                yield entry.path, None, None, False
                continue
            when = datetime.datetime.fromtimestamp(stat.st_mtime, datetime.timezone.utc)
            if not entry.is_dir():
                yield entry.path, when, stat.st_size, False
            elif not entry.is_symlink():
                yield entry.path, when, None, True


class _Walk:
    """The folders a task lists, and what it found."""

    def __init__(self, root: str, lenient: bool, budget: int):
        self.store, _ = _opened(root)
        self.lenient, self.left = lenient, budget

    def rows(self, folders: list[str]):
        """(path, time, length, False) of files, (path, NULL, NULL, True) of folders not come to.

        At least one entry is looked at, so that every round gets on."""
        while folders:
            folder = folders.pop()
            if self.left <= 0:
                yield folder, None, None, True
                continue
            try:
                entries = list(_entries(self.store, folder))
            except OSError:
                if not self.lenient:
                    raise
                yield folder, None, None, False
                continue
            self.left -= 1 + len(entries)
            for path, when, length, is_folder in entries:
                if is_folder:
                    folders.append(path)
                elif path.endswith(SUFFIXES):
                    yield path, when, length, False


def _walked(root: str, lenient: bool, budget: int):
    def run(batches):
        walk = _Walk(root, lenient, budget)
        for batch in batches:
            rows = []
            for row in walk.rows(batch.column(0).to_pylist()):
                rows.append(row)
                if len(rows) == 10_000:
                    yield _listing(rows)
                    rows = []
            if rows:
                yield _listing(rows)

    return run


def _listing(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), _TIME, pa.int64(), pa.bool_()]
    names = ["path", "modificationTime", "length", "folder"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def listed(
    spark: SparkSession, root: str, lenient: bool, entries: int = LIST_ENTRIES, folders: int = LIST_FOLDERS
) -> DataFrame:
    """(path, modificationTime, length) of the files below a folder; what cannot be read has no length."""
    store, top = _opened(root)
    if store.get_file_info(top).type != fs.FileType.Directory:
        raise FileNotFoundError(f"no such folder: {root}")
    frontier, left, rounds = spark.createDataFrame([(top,)], "path string"), 1, []
    while left:
        dealt = frontier.repartition(max(1, min(left, max(spark.sparkContext.defaultParallelism, left // folders))))
        rounds.append(stored(dealt.mapInArrow(_walked(root, lenient, entries), LISTED), "listed"))
        frontier = rounds[-1].where("folder").select("path")
        left = frontier.count()
    # As many tables as rounds; each task hands folders back only after it has seen `entries` of them.
    found = rounds[0]
    for more in rounds[1:]:
        found = found.unionByName(more)
    return found.where("not folder").drop("folder")


def split(found: DataFrame, size: int, files: int) -> DataFrame:
    """The files, each task's share together: neighbours in the order of their paths, up to `size` bytes
    or `files` of them."""
    # A file larger than a split takes one.
    bytes_ = F.least(F.coalesce("length", F.lit(0)), F.lit(size))
    placed = with_sums_before(found, ["path"], {"__bytes": bytes_, "__files": F.lit(1)})
    number = F.floor(F.col("__bytes") / size) + F.floor(F.col("__files") / files)
    placed = stored(placed.select("path", "modificationTime", "length", number.cast("int").alias("split")), "splits")
    count = (placed.agg(F.max("split")).first()[0] or 0) + 1
    return placed.repartitionById(count, "split").drop("split")


def _content(store, path: str, lenient: bool) -> bytes | None:
    try:
        with store.open_input_stream(path) as file:
            return file.read()
    except OSError:
        if not lenient:
            raise
        return None


def _read(root: str, lenient: bool):
    """Record batches bounded by size."""

    def run(batches):
        store, _ = _opened(root)
        rows, size = [], 0
        for batch in batches:
            for path, when, length in zip(*[column.to_pylist() for column in batch.columns]):
                content = _content(store, path, lenient)
                rows.append((path, when, length, content))
                size += len(content or b"")
                if size >= BATCH_BYTES:
                    yield _contents(rows)
                    rows, size = [], 0
        if rows:
            yield _contents(rows)

    return run


def _contents(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), _TIME, pa.int64(), pa.binary()]
    names = ["path", "modificationTime", "length", "content"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
