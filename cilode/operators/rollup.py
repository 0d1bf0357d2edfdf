"""Per-project aggregates over the per-file facts.

A project may hold a large share of all files and any number of levels, so every
aggregate here is one that Spark merges on the map side, over fixed-width states; sets are
kept in long form and never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _label_flags(labels: list[str]):
    return [F.bool_or(F.col("labels")[name]).alias(name) for name in labels]


def project_flags(facts: DataFrame, labels: list[str]) -> DataFrame:
    """project, yml_count, yaml_errors, labels (struct): one shuffle of per-project rows."""
    grouped = facts.groupBy("project").agg(
        F.count("*").alias("yml_count"),
        F.count_if(F.col("error_kind").isNotNull()).alias("yaml_errors"),
        *_label_flags(labels),
    )
    return grouped.select("project", "yml_count", "yaml_errors", F.struct(*labels).alias("labels"))


def project_levels(facts: DataFrame) -> DataFrame:
    """Distinct (project, source, api_level) of the `levels` arrays."""
    # Of a plain `explode` Spark infers a filter on the size of the array, which works the array out twice.
    return (
        facts.select("project", F.explode_outer("levels").alias("item"))
        .where("item is not null")
        .select("project", "item.source", "item.api_level")
        .distinct()
    )


def project_levels_counted(facts: DataFrame, files: DataFrame) -> DataFrame:
    """The distinct levels of `facts`, each with the count of its project's rows in `files`.

    Counting reads no file content, only paths, and the levels are already distinct, so
    both sides are small next to the input; Spark chooses the join from measured sizes.
    """
    counts = files.groupBy("project").agg(F.count("*").alias("yml_count"))
    return project_levels(facts).join(counts, "project").select("project", "api_level", "source", "yml_count")


def project_rollup(facts: DataFrame, labels: list[str], sources: list[str]) -> DataFrame:
    """Counts, flags and the number of distinct levels per source, in one pass over the files.

    Each file gives one row without a source and one per level. The first aggregate makes
    the levels distinct within (project, source); the second one counts them.
    """
    items = F.concat(
        F.array(F.struct(F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("api_level"))),
        F.col("levels"),
    )
    flags = [c for c in ("uses_matrix", "has_options") if c in facts.columns]
    rows = facts.select(
        "project",
        F.col("error_kind").isNotNull().alias("error"),
        "labels",
        *flags,
        F.explode(items).alias("item"),
    )
    distinct = rows.groupBy("project", "item.source", "item.api_level").agg(
        F.count("*").alias("files"),
        F.count_if("error").alias("errors"),
        *[F.bool_or(c).alias(c) for c in flags],
        *_label_flags(labels),
    )
    of_file = F.col("source").isNull()
    out = distinct.groupBy("project").agg(
        F.sum(F.when(of_file, F.col("files"))).alias("yml_count"),
        F.sum(F.when(of_file, F.col("errors"))).alias("yaml_errors"),
        *[F.count_if(F.col("source") == s).cast("int").alias(f"distinct_{s}") for s in sources],
        *[F.bool_or(c).alias(c) for c in flags],
        *[F.bool_or(F.col(f"`{name}`")).alias(name) for name in labels],
    )
    return out.select(
        "project",
        "yml_count",
        "yaml_errors",
        *[f"distinct_{s}" for s in sources],
        *flags,
        F.struct(*[F.col(f"`{name}`") for name in labels]).alias("labels"),
    )
