"""Write the result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cilode.functions.rules import labels_text
from cilode.operators.stored import new_path
from cilode.plans import reports as R
from cilode.sinks.published import publish

# Table names, and which report writes them.
TABLES = {
    "first": (R.FIRST, ("instrumentation_test_summary",)),
    "uncommented": (R.UNCOMMENTED, ("instrumentation_test_summary",)),
    "fixed_path": (R.FIXED_PATH, ("project_test_summary", "project_api_levels", "project_emulator_options")),
    "provenance": (R.PROVENANCE, ("project_test_types", "project_api_levels_detailed")),
}


def write_csv(df: DataFrame, path: str, parts: int | None = None) -> None:
    """CSV with a header, minimal quoting and booleans as `True` and `False`.

    The number of part files follows from the data; `parts=1` gives a single file, for
    tables known to be small.
    """
    columns = [
        F.initcap(F.col(f"`{f.name}`").cast("string")).alias(f.name)
        if f.dataType.simpleString() == "boolean"
        else F.col(f"`{f.name}`")
        for f in df.schema
    ]
    out = df.select(*columns)
    if parts is not None:
        out = out.repartition(parts)
    (
        out.write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def _stored_facts(spark: SparkSession, files: DataFrame, path: str, report: R.Report, on_bad_encoding: str) -> DataFrame:
    """One row per file, stored: they say what happened to each file, and the tables are aggregated
    from there, so that neither a further table nor a lost executor makes files be loaded again."""
    facts = R.file_facts(files, report, on_bad_encoding)
    facts = facts.withColumns(
        {"test_types": labels_text(F.col("labels"), report.rules), "error": F.col("error_kind").isNotNull()}
    )
    # The rows are small, those of many input splits go into one file.
    facts.hint("rebalance").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _frames(facts: DataFrame, report: R.Report, tables: tuple) -> dict[str, DataFrame]:
    frames = {
        "instrumentation_test_summary": lambda: R.instrumentation_test_summary(facts, report),
        "project_test_summary": lambda: R.project_test_summary(facts, report),
        "project_api_levels": lambda: R.project_api_levels(facts),
        "project_emulator_options": lambda: R.project_emulator_options(facts),
        "project_test_types": lambda: R.project_test_types(facts, report),
        "project_api_levels_detailed": lambda: R.project_api_levels_detailed(facts),
    }
    return {table: frames[table]() for table in tables}


def write_report(
    spark: SparkSession,
    files: DataFrame,
    out: str,
    name: str,
    on_bad_encoding: str = "error_row",
    parts: int | None = None,
) -> dict[str, DataFrame]:
    """Run one report of TABLES: read every file once, write its tables below `out`.

    Tables are replaced one after the other; `publish_reports` switches them together. The per-file
    rows go to `<out>/file_audit_<name>` first.
    """
    report, tables = TABLES[name]
    facts = _stored_facts(spark, files, f"{out}/file_audit_{name}", report, on_bad_encoding)
    written = _frames(facts, report, tables)
    for table, frame in written.items():
        write_csv(frame, f"{out}/{table}", parts)
    written["file_audit"] = R.file_audit(facts, report)
    return written


def publish_reports(
    spark: SparkSession,
    files: DataFrame,
    out: str,
    names: tuple = ("uncommented", "fixed_path", "provenance"),
    on_bad_encoding: str = "error_row",
    parts: int | None = None,
) -> str:
    """Run several reports and publish the CSV tables of all of them, and their audits, at once.

    `sinks.published` reads them: `published` gives their paths, `read` a table. If anything fails,
    the tables of the last run that did not stay published. Gives the name of the run.
    """
    twice = sorted({t for n in names for m in names if n != m for t in set(TABLES[n][1]) & set(TABLES[m][1])})
    if twice:
        raise ValueError(f"two of the reports {names} write {', '.join(twice)}")
    tables = {}
    for name in names:
        report, held = TABLES[name]
        facts = _stored_facts(spark, files, new_path(spark, f"file_audit_{name}"), report, on_bad_encoding)
        tables |= _frames(facts, report, held)
        tables[f"file_audit_{name}"] = R.file_audit(facts, report)
    return publish(spark, out, tables, lambda df, path: write_csv(df, path, parts), "csv")
