"""The four end-to-end reports, from files to project tables.

A `Report` says how a project is named, which rules apply, what is extracted, and what an
unreadable, empty or odd file still contributes. `file_facts` gives one row per file; the
tables are aggregates of those rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cilode.functions import text as T
from cilode.functions.documents import documents
from cilode.functions.extract import (
    ANY_LEVEL,
    FIXED_LEVELS,
    FIXED_STEPS,
    iterated_levels,
    step_options,
    tagged_levels,
)
from cilode.functions.rules import RULES_V1, RULES_V2, Rules, labels_text
from cilode.operators.labelling import with_labels
from cilode.operators.order import numbered
from cilode.operators.rollup import project_flags, project_levels, project_levels_counted, project_rollup

MATRIX_REFERENCE = "matrix.api_level"


@dataclass(frozen=True)
class Report:
    rules: Rules = field(default_factory=lambda: RULES_V2)
    project: Callable[[Column], Column] = T.project_by_position
    strip_comments: bool = True
    fold_keywords: bool = True
    empty_keeps_labels: bool = True  # an empty document is still classified
    empty_is_error: bool = True
    jobs_must_be_map: bool = False  # any other root, or a cycle below `jobs`, is an error
    failed_search_is_error: bool = False  # else what a search found before it failed stays
    patterns: tuple = ()
    levels: Callable[[Column], Column] | None = None  # nodes -> array of (source, api_level)
    options: Callable[[Column], Column] | None = None  # nodes -> array of texts
    sources: tuple = ()
    reference: str | None = None  # raw text whose presence is reported
    level_words: tuple = ()  # lower-cased words without which a file has no level
    option_words: tuple = ()  # the same for options


# Test types by the first rule table; a comment counts, an empty file has no label.
FIRST = Report(rules=RULES_V1, project=T.project_by_prefix, strip_comments=False, empty_keeps_labels=False)
# Test types by the second rule table, comment lines left out.
UNCOMMENTED = Report()
# Levels and options at the fixed path of one job; comments count, empty files are no errors.
FIXED_PATH = Report(
    strip_comments=False,
    empty_is_error=False,
    patterns=(FIXED_LEVELS, FIXED_STEPS),
    levels=lambda nodes: F.transform(
        iterated_levels(nodes, 0), lambda x: F.struct(F.lit("matrix").alias("source"), x.alias("api_level"))
    ),
    options=lambda nodes: step_options(nodes, 1),
    sources=("matrix",),
    reference=MATRIX_REFERENCE,
    level_words=("instrumented-test", "api_level"),
    option_words=("instrumented-test", "emulator-options"),
)
# Levels anywhere below `jobs` with their source. Keywords are compared as written with a
# lower-cased text, so those with capitals never match.
PROVENANCE = Report(
    fold_keywords=False,
    jobs_must_be_map=True,
    failed_search_is_error=True,
    patterns=(ANY_LEVEL,),
    levels=lambda nodes: tagged_levels(nodes, 0),
    sources=("matrix", "hardcoded"),
    level_words=("api-level",),
)


def config_texts(files: DataFrame, on_bad_encoding: str = "error_row", only: tuple = ()) -> DataFrame:
    """(path, text): the accepted files with their normalised text, NULL if undecodable.

    `files` has `path` and either `content` (bytes) or `text`. With `only`, files that cannot
    have these words in their keys are left out; the words hold no white space, so the text
    is looked at as it was read.
    """
    raw = T.decoded(F.col("content")) if "content" in files.columns else F.col("text")
    if on_bad_encoding == "fail":
        raw = F.coalesce(raw, F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("path"))).cast("string"))
    elif on_bad_encoding != "error_row":
        raise ValueError(f"on_bad_encoding: {on_bad_encoding!r}")
    accepted = files.where(T.is_config_file(F.col("path")))
    if only:
        accepted = accepted.where(mentions(raw, only))
    return accepted.select("path", T.normalised(raw).alias("text"))


def mentions(text: Column, words: tuple) -> Column:
    """Whether a YAML text can have all these words in its keys.

    A key shows in the text as it is, in any case, unless it is written with escapes.
    """
    lowered = F.lower(text)
    held = [F.contains(lowered, F.lit(word)) for word in words]
    return reduce(and_, held) | F.contains(text, F.lit("\\"))


def file_facts(
    files: DataFrame, report: Report, on_bad_encoding: str = "error_row", only: tuple = ()
) -> DataFrame:
    """One row per file: path, project, labels, error_kind, message and what was extracted.

    error_kind is NULL, `encoding`, `yaml`, `empty`, `root`, `cycle` or `search`. A file is loaded
    once, and its text does not leave this step. With `only`, files that cannot have these
    words in their keys are left out before they are loaded; that is enough where just
    levels or options are wanted.
    """
    text = F.col("text")
    texts = config_texts(files, on_bad_encoding, only)
    loaded = texts.withColumn("doc", documents(text, report.patterns))
    labelled = with_labels(
        loaded, report.rules, strip_comments=report.strip_comments, fold_keywords=report.fold_keywords
    )
    referred = [] if report.reference is None else [F.contains(text, F.lit(report.reference)).alias("referred")]
    doc = F.col("doc")
    kind = F.when(doc.isNull(), "encoding").when(~doc["ok"], "yaml")
    if report.empty_is_error:
        kind = kind.when(doc["is_empty"], "empty")
    if report.jobs_must_be_map:
        kind = kind.when(doc["root_kind"] != "map", "root").when(doc["has_cycle"], "cycle")
    if report.failed_search_is_error:
        kind = kind.when(doc["extract_failed"], "search")
    read = labelled.select(
        "path",
        report.project(F.col("path")).alias("project"),
        "labels",
        "doc",
        *referred,
    ).withColumn("error_kind", kind)

    sound = F.col("error_kind").isNull()
    classified = sound | (F.col("error_kind") == "empty") if report.empty_keeps_labels else sound
    out = {
        "labels": F.struct(*[(F.col("labels")[n] & F.coalesce(classified, F.lit(False))).alias(n) for n in report.rules]),
        "message": doc["message"],
    }
    if report.reference is not None:
        out["uses_matrix"] = F.coalesce(F.col("referred") & sound, F.lit(False))
    if report.levels is not None:
        found = F.when(sound, report.levels(doc["nodes"]))
        out["levels"] = F.coalesce(found, F.array().cast("array<struct<source:string,api_level:string>>"))
    if report.options is not None:
        found = F.when(sound, report.options(doc["nodes"]))
        out["options"] = F.coalesce(found, F.array().cast("array<string>"))
    return read.select("path", "project", "error_kind", *[c.alias(n) for n, c in out.items()])


def file_audit(facts: DataFrame, report: Report) -> DataFrame:
    """What happened to each file."""
    return facts.select(
        "path",
        "project",
        labels_text(F.col("labels"), report.rules).alias("test_types"),
        F.col("error_kind").isNotNull().alias("error"),
        "error_kind",
        "message",
    )


def instrumentation_test_summary(facts: DataFrame, report: Report) -> DataFrame:
    return project_flags(facts, list(report.rules)).select(
        "project", labels_text(F.col("labels"), report.rules).alias("test_types"), "yaml_errors"
    )


def project_test_summary(facts: DataFrame, report: Report = FIXED_PATH) -> DataFrame:
    with_options = facts.withColumn("has_options", F.size("options") > 0)
    return project_rollup(with_options, list(report.rules), list(report.sources)).select(
        "project",
        "yml_count",
        labels_text(F.col("labels"), report.rules).alias("test_types"),
        F.col("uses_matrix").alias("uses_matrix_api_level"),
        F.col("distinct_matrix").alias("distinct_api_levels"),
        F.col("has_options").alias("has_emulator_options"),
    )


def project_api_levels(facts: DataFrame) -> DataFrame:
    return project_levels(facts).select("project", "api_level")


def project_emulator_options(facts: DataFrame) -> DataFrame:
    """Every option, duplicates kept. Rows move nowhere; see `in_file_order` for an order."""
    return facts.select("project", F.explode("options").alias("emulator_option"))


def options_in_order(facts: DataFrame) -> DataFrame:
    """Every option with its file and its position there. Sorted by path and position, the
    rows of a project are in the order of its scan; nothing is sorted here."""
    # A plain `posexplode` would work the options out twice, as in `project_levels`.
    placed = facts.select("project", "path", F.posexplode_outer("options").alias("position", "emulator_option"))
    return placed.where("position is not null")


def in_file_order(facts: DataFrame) -> DataFrame:
    """number, project, emulator_option: every option with its place in the scan, files in the order of
    their paths and options in that of their steps. Nothing is sorted in one task; rows that
    are written or compared by number are in the order of the scan."""
    return numbered(options_in_order(facts), ["path", "position", "project"]).select("number", "project", "emulator_option")


def projects_first_seen(facts: DataFrame) -> DataFrame:
    """number, project, path: the projects in the order in which the scan comes to them, with the
    file it comes to first. A project is one row before anything is ordered."""
    first = facts.groupBy("project").agg(F.min("path").alias("path"))
    return numbered(first, ["path", "project"]).select("number", "project", "path")


def project_test_types(facts: DataFrame, report: Report = PROVENANCE) -> DataFrame:
    return project_rollup(facts, list(report.rules), list(report.sources)).select(
        "project",
        labels_text(F.col("labels"), report.rules).alias("test_types"),
        F.col("distinct_matrix").alias("distinct_matrix_api_levels"),
        F.col("distinct_hardcoded").alias("distinct_hardcoded_api_levels"),
        "yml_count",
        "yaml_errors",
    )


def project_api_levels_detailed(facts: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """`files` has all rows to count where `facts` holds only those with levels."""
    return project_levels_counted(facts, facts if files is None else files)


def config_projects(files: DataFrame, report: Report) -> DataFrame:
    """(path, project) of the accepted files; reads no content."""
    path = F.col("path")
    return files.where(T.is_config_file(path)).select(path, report.project(path).alias("project"))
