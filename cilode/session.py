"""Session settings the jobs are written for. Values set elsewhere always win."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    # Configuration files are small: let a scan task open some hundreds of them.
    "spark.sql.files.openCostInBytes": "128k",
    # Parsing costs far more per byte than reading: batches are bounded in rows and bytes.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
}


def session(app: str = "cilode", **settings: str) -> SparkSession:
    """A session with the defaults above where nothing else is set.

    What the cluster, `spark-submit` or a session that is already there has set stays;
    `settings` use `__` for dots and are the caller's own wish, so they are set.
    """
    builder = SparkSession.builder.appName(app)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    held = spark.conf.getAll
    for key, value in DEFAULTS.items():
        if key not in held:
            spark.conf.set(key, value)
    return spark
