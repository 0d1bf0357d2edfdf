"""Tables that are published together.

A run writes each of its tables to a folder of its own below `<out>/runs/<run>`, then one row
per table into the log `<out>/published`. Those rows are one file, which the writer's
commit moves into place at once: a reader sees the tables of the run before or all tables of
this one, never a mixture, and a run that fails half-way leaves what was published as it was.
Two writers do not disturb each other; the run that begins last is the one published. Reading
the log needs no file system but Spark's.

Runs stay until `forget_older` removes those that are not published any more; a reader that
still uses one should be done by then.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "began timestamp, run string, name string, path string, format string"

Writer = Callable[[DataFrame, str], None]


def parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def publish(
    spark: SparkSession, out: str, tables: dict[str, DataFrame], write: Writer = parquet, format: str = "parquet"
) -> str:
    """Write the tables and switch readers to all of them at once. Gives the name of the run.

    Tables that earlier runs published under other names are not published any more.
    """
    began = spark.sql("SELECT current_timestamp() AS t").first().t
    run = uuid.uuid4().hex
    paths = {name: f"{out}/runs/{run}/{name}" for name in tables}
    for name, df in tables.items():
        write(df, paths[name])
    rows = [(began, run, name, path, format) for name, path in paths.items()]
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{out}/published")
    return run


def _log(spark: SparkSession, out: str) -> DataFrame:
    try:
        return spark.read.schema(LOG).parquet(f"{out}/published")
    except AnalysisException as failure:
        if failure.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)  # nothing was published yet


def _latest(spark: SparkSession, out: str) -> list:
    """The rows of the run that is published: a row per table."""
    log = _log(spark, out)
    last = log.agg(F.max(F.struct("began", "run")).alias("last")).select("last.run")
    return log.join(F.broadcast(last), "run", "left_semi").collect()


def published(spark: SparkSession, out: str) -> dict[str, str]:
    """Paths of the tables that are published, by name."""
    return {r.name: r.path for r in _latest(spark, out)}


def read(spark: SparkSession, out: str, name: str) -> DataFrame:
    """One of the published tables. All that is read from one call's paths is of one run; for tables that
    belong together take the paths from one call of `published`."""
    for row in _latest(spark, out):
        if row.name == name:
            reader = spark.read.format(row.format)
            return (reader.option("header", True).option("escape", '"') if row.format == "csv" else reader).load(row.path)
    raise KeyError(f"no table {name!r} is published in {out}")


def forget_older(spark: SparkSession, out: str) -> int:
    """Remove the tables of runs that began before the published one. Gives how many there were.

    Runs that began later, and runs that have published nothing yet, stay.
    """
    log = _log(spark, out)
    last = log.agg(F.max(F.struct("began", "run")).alias("last")).first().last
    if last is None:
        return 0
    older = [r.run for r in log.where(F.struct("began", "run") < F.struct(F.lit(last.began), F.lit(last.run))).select("run").distinct().collect()]
    jvm = spark.sparkContext._jvm
    removed = 0
    for run in older:
        path = jvm.org.apache.hadoop.fs.Path(f"{out}/runs/{run}")
        removed += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return removed
