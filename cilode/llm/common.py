"""Helpers that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Keys with more than this part of all rows are hot; there are fewer of them than parts.
HOT_PARTS = 1000
# Words end at ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
# Words of a text in lower case: ASCII letters and digits, and everything beyond ASCII. What
# most characters are is tried first.
PLAIN_WORD = r"[a-z0-9\x{80}-\x{10FFFF}]+"


def per_worker(key: tuple, make: Callable):
    """An object that a Python worker keeps from task to task, made when first asked for.

    A worker keeps one at a time: another key takes its place."""
    kept = vars(sys).setdefault("_cilode_kept", {})
    if key not in kept:
        kept.clear()
        kept[key] = make()
    return kept[key]


def given_back() -> None:
    """Give memory that is free again back to the machine, where the C library can; workers live long."""
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)
    pa.default_memory_pool().release_unused()


def slices(batches, rows: int = 512):
    """Arrow batches in smaller ones, so that little of a batch is turned into objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Only a local session, whose one machine is the whole cluster, may do without; it gets
    a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='cilode-')}")
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back.

    Cuts the lineage: what follows, and what is done again after an executor is lost,
    starts from the files.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# For tables whose rows hold large arrays. A page ends only where its size is looked at, which is after 100 rows if nothing
# else is said; the codecs hold whole pages outside the heap, and keep that memory.
LARGE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def stored_at(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """`stored` with the path, for a table that is removed once another one has taken its place."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, *paths: str) -> None:
    """Remove stored tables that nothing reads any more. Shuffle files of finished steps go when the driver's
    collector finds that nothing refers to them, so it is asked to look."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    jvm.System.gc()


_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: int = 2 << 20):
    """Within it, rows go to Python in Arrow batches of some `size` bytes; only for what is run within it. An executor
    holds a batch outside its heap, in buffers that double as they grow."""
    before = spark.conf.get(_BATCH_SETTING, None)
    spark.conf.set(_BATCH_SETTING, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH_SETTING)
        else:
            spark.conf.set(_BATCH_SETTING, before)


def attached(rows: DataFrame, facts: DataFrame, key: str, parts: int = HOT_PARTS) -> DataFrame:
    """Join each row with what is known of its key; keys of many rows do not move.

    `facts` has the number of rows of each key as `__n`. There are less than `parts` keys with
    more than that part of all rows, whatever the table, so their facts are sent to the rows; others
    meet by the key, where none has more than that part.
    """
    total = facts.agg(F.sum("__n")).first()[0] or 0
    hot = F.col("__n") * parts > total
    few = F.broadcast(facts.where(hot).drop("__n"))
    others = rows.join(few.select(key), key, "left_anti").join(facts.where(~hot).drop("__n"), key)
    return rows.join(few, key).unionByName(others)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def words(text: Column, pattern: str = WORD) -> Column:
    """Array of words; none for NULL."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def fingerprint(text: Column) -> Column:
    """Tells texts apart; NULL has one of its own."""
    return F.coalesce(F.sha2(text, 256), F.lit(""))
