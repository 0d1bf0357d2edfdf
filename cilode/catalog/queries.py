"""The queries of this library on the given tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cilode.catalog import corpora
from cilode.functions import text as T
from cilode.functions.documents import documents
from cilode.functions.extract import (
    ANY_LEVEL,
    FIXED_LEVELS,
    FIXED_STEPS,
    hardcoded_levels,
    iterated_levels,
    matrix_levels,
    step_options,
)
from cilode.functions.rules import RULES_V1, RULES_V2, Rules, labels_text
from cilode.operators.labelling import match_rules, with_labels
from cilode.operators.rollup import project_flags, project_levels, project_rollup
from cilode.operators.rule_sets import label_sets, labels_listed, matched_numbers, numbered_labels, set_labels, set_sizes
from cilode.plans import reports as R
from cilode.sources import json as J
from cilode.sources.config import config_entries, json_fields, settings

Query = Callable[[SparkSession, str], DataFrame]

# Rules for the prose of `documents`; capitals show whether keywords are folded.
PROSE_RULES: Rules = {
    "Licensing": ["license", "licensed under"],
    "Quality": ["Test", "error"],
    "articles": [" the ", " Los ", " DER "],
    "secrets": ["token", "API_KEY"],
}


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return R.config_texts(corpora.workflows(spark, folder))


def _facts(report: R.Report) -> Query:
    return lambda spark, folder: R.file_facts(corpora.workflows(spark, folder), report)


def _joined(values: Column, order: bool = False) -> Column:
    return F.array_join(F.array_sort(values) if order else values, ",")


def _classified(rules: Rules, **how) -> Query:
    """Test types of every accepted file, whether it is valid or not."""
    return lambda spark, folder: with_labels(_texts(spark, folder), rules, **how).select(
        "path", labels_text(F.col("labels"), rules).alias("test_types")
    )


def _notes_facts(spark: SparkSession, folder: str, **how) -> DataFrame:
    labelled = with_labels(corpora.notes(spark, folder), PROSE_RULES, **how)
    return labelled.select("project", "labels", F.lit(None).cast("string").alias("error_kind"))


def scan_inventory(spark, folder):
    files = corpora.workflows(spark, folder).where(T.is_config_file(F.col("path")))
    suffix = F.substring_index(T.base_name(F.col("path")), ".", -1)
    return files.groupBy(suffix.alias("suffix")).agg(F.count("*").alias("files"))


def decode_normalise(spark, folder):
    text = T.normalised(T.decoded(F.col("content")))
    return corpora.encoded(spark, folder).select("doc_id", text.isNotNull().alias("valid"), text.alias("text"))


def project_key_prefix(spark, folder):
    path = F.col("path")
    return corpora.workflows(spark, folder).select(path, T.project_by_prefix(path).alias("project"))


def project_key_positional(spark, folder):
    path = F.col("path")
    return corpora.workflows(spark, folder).select(
        path, T.base_name(path).alias("name"), T.project_by_position(path).alias("project")
    )


def strip_comment_lines(spark, folder):
    return corpora.notes(spark, folder).select("doc_id", T.without_comment_lines(F.col("text")).alias("text"))


def _benchmark_rules(spark, folder):
    return corpora.table(spark, folder, "benchmark").selectExpr("item_id AS label", "text AS keyword")


def classify_rules_join(spark, folder):
    """Rules of any number, those few sent to the texts."""
    docs = corpora.documents(spark, folder)
    return match_rules(docs, _benchmark_rules(spark, folder), "doc_id").withColumnRenamed("label", "item_id")


def classify_rules_equi_join(spark, folder):
    """The same as equi-joins only, as for rule tables that are not sent around."""
    docs = corpora.documents(spark, folder)
    found = match_rules(docs, _benchmark_rules(spark, folder), "doc_id", broadcast_windows=0)
    return found.withColumnRenamed("label", "item_id")


def _phrase_sets(spark, folder):
    """Sets of the phrases of the benchmark that occur in each source, and the phrases by number."""
    rules = corpora.phrase_rules(spark, folder)
    labels = numbered_labels(rules)
    hits = matched_numbers(corpora.documents(spark, folder), rules, labels, "doc_id", "source")
    return label_sets(hits, "source"), labels


def summary_rule_sets(spark, folder):
    return set_sizes(_phrase_sets(spark, folder)[0], "source")


def summary_rule_labels(spark, folder):
    sets, labels = _phrase_sets(spark, folder)
    return labels_listed(set_labels(sets, labels, "source"), "source")


def flag_substring(spark, folder):
    return _texts(spark, folder).select(
        "path", F.contains("text", F.lit(R.MATRIX_REFERENCE)).alias("uses_matrix")
    )


def validate_documents(spark, folder):
    doc = F.col("doc")
    return (
        _texts(spark, folder)
        .select("path", documents(F.col("text")).alias("doc"))
        .select("path", doc["ok"].alias("ok"), doc["is_empty"].alias("is_empty"), doc["root_kind"].alias("root_kind"))
    )


def config_fields_typed(spark, folder):
    return settings(corpora.settings_files(spark, folder))


def config_document(spark, folder):
    return config_entries(corpora.settings_files(spark, folder))


def config_event_fields(spark, folder):
    """The properties of events are JSON, which needs no reader of its own."""
    events = corpora.table(spark, folder, "events").select("event_id", "props")
    return json_fields(events, {("k",): "int"}, text="props")


def levels_fixed_path(spark, folder):
    doc = documents(F.col("text"), [FIXED_LEVELS])
    return (
        _texts(spark, folder)
        .select("path", doc.alias("doc"))
        .select("path", _joined(iterated_levels(F.col("doc.nodes"), 0)).alias("api_levels"))
    )


def levels_recursive(spark, folder):
    nodes = F.col("doc.nodes")
    return (
        _texts(spark, folder)
        .select("path", documents(F.col("text"), [ANY_LEVEL]).alias("doc"))
        .select(
            "path",
            _joined(matrix_levels(nodes, 0), order=True).alias("matrix_levels"),
            _joined(hardcoded_levels(nodes, 0), order=True).alias("hardcoded_levels"),
        )
    )


def options_extract(spark, folder):
    return (
        _texts(spark, folder)
        .select("path", documents(F.col("text"), [FIXED_STEPS]).alias("doc"))
        .select("path", F.array_join(step_options(F.col("doc.nodes"), 0), "|").alias("options"))
    )


def levels_json_recursive(spark, folder):
    return J.deep_levels(corpora.json_workflows(spark, folder))


def levels_json_fixed_path(spark, folder):
    return J.fixed_levels(corpora.json_workflows(spark, folder))


def options_json(spark, folder):
    return J.step_options(corpora.json_workflows(spark, folder))


def options_numbered(spark, folder):
    files = corpora.workflows(spark, folder)
    return R.in_file_order(R.file_facts(files, R.FIXED_PATH, only=R.FIXED_PATH.option_words))


def projects_first_seen(spark, folder):
    return R.projects_first_seen(R.config_projects(corpora.workflows(spark, folder), R.PROVENANCE))


def summary_counts(spark, folder):
    facts = _facts(R.UNCOMMENTED)(spark, folder)
    return project_flags(facts, list(RULES_V2)).select("project", "yml_count", "yaml_errors")


def summary_labels(spark, folder):
    return project_flags(_notes_facts(spark, folder), list(PROSE_RULES)).select(
        "project", labels_text(F.col("labels"), PROSE_RULES).alias("labels"), "yml_count"
    )


def summary_labels_unfolded(spark, folder):
    facts = _notes_facts(spark, folder, strip_comments=False, fold_keywords=False)
    return project_flags(facts, list(PROSE_RULES)).select(
        "project", labels_text(F.col("labels"), PROSE_RULES).alias("labels"), "yml_count"
    )


def summary_levels(spark, folder):
    facts = _facts(R.PROVENANCE)(spark, folder)
    return project_rollup(facts, list(RULES_V2), list(R.PROVENANCE.sources)).select(
        "project", "distinct_matrix", "distinct_hardcoded"
    )


def summary_flags(spark, folder):
    facts = _facts(R.FIXED_PATH)(spark, folder)
    return facts.groupBy("project").agg(F.bool_or("uses_matrix").alias("uses_matrix"))


def summary_options(spark, folder):
    facts = _facts(R.FIXED_PATH)(spark, folder)
    return facts.groupBy("project").agg(
        F.bool_or(F.size("options") > 0).alias("has_options"),
        F.sum(F.size("options")).alias("options"),
    )


def options_in_order(spark, folder):
    files = corpora.workflows(spark, folder)
    return R.options_in_order(R.file_facts(files, R.FIXED_PATH, only=R.FIXED_PATH.option_words))


def levels_long(spark, folder):
    files = corpora.workflows(spark, folder)
    return R.project_api_levels(R.file_facts(files, R.FIXED_PATH, only=R.FIXED_PATH.level_words))


def levels_tagged(spark, folder):
    files = corpora.workflows(spark, folder)
    return project_levels(R.file_facts(files, R.PROVENANCE, only=R.PROVENANCE.level_words))


def levels_detailed(spark, folder):
    files = corpora.workflows(spark, folder)
    facts = R.file_facts(files, R.PROVENANCE, only=R.PROVENANCE.level_words)
    return R.project_api_levels_detailed(facts, R.config_projects(files, R.PROVENANCE))


def options_long(spark, folder):
    files = corpora.workflows(spark, folder)
    return R.project_emulator_options(R.file_facts(files, R.FIXED_PATH, only=R.FIXED_PATH.option_words))


def project_test_summary(spark, folder):
    return R.project_test_summary(_facts(R.FIXED_PATH)(spark, folder))


def project_test_types(spark, folder):
    return R.project_test_types(_facts(R.PROVENANCE)(spark, folder))


def _summary(report: R.Report) -> Query:
    return lambda spark, folder: R.instrumentation_test_summary(_facts(report)(spark, folder), report)


def _audit(report: R.Report) -> Query:
    return lambda spark, folder: R.file_audit(_facts(report)(spark, folder), report).drop("message")


QUERIES: dict[str, Query] = {
    "scan_inventory": scan_inventory,
    "decode_normalise": decode_normalise,
    "project_key_prefix": project_key_prefix,
    "project_key_positional": project_key_positional,
    "strip_comment_lines": strip_comment_lines,
    "classify_basic": _classified(RULES_V1, strip_comments=False),
    "classify_uncommented": _classified(RULES_V2),
    "classify_folded": _classified(RULES_V2, strip_comments=False),
    "classify_unfolded_keywords": _classified(RULES_V2, fold_keywords=False),
    "classify_rules_join": classify_rules_join,
    "classify_rules_equi_join": classify_rules_equi_join,
    "summary_rule_sets": summary_rule_sets,
    "summary_rule_labels": summary_rule_labels,
    "flag_substring": flag_substring,
    "validate_documents": validate_documents,
    "config_fields": config_fields_typed,
    "config_document": config_document,
    "config_event_fields": config_event_fields,
    "levels_fixed_path": levels_fixed_path,
    "levels_recursive": levels_recursive,
    "options_extract": options_extract,
    "options_long": options_long,
    "options_in_order": options_in_order,
    "levels_long": levels_long,
    "levels_tagged": levels_tagged,
    "levels_detailed": levels_detailed,
    "levels_json_recursive": levels_json_recursive,
    "levels_json_fixed_path": levels_json_fixed_path,
    "options_json": options_json,
    "options_numbered": options_numbered,
    "projects_first_seen": projects_first_seen,
    "summary_counts": summary_counts,
    "summary_labels": summary_labels,
    "summary_labels_unfolded": summary_labels_unfolded,
    "summary_levels": summary_levels,
    "summary_flags": summary_flags,
    "summary_options": summary_options,
    "instrumentation_summary_v1": _summary(R.FIRST),
    "instrumentation_summary_v2": _summary(R.UNCOMMENTED),
    "project_test_summary": project_test_summary,
    "project_test_types": project_test_types,
    "file_audit_v1": _audit(R.FIRST),
    "file_audit_v2": _audit(R.UNCOMMENTED),
    "file_audit_fixed_path": _audit(R.FIXED_PATH),
    "file_audit_provenance": _audit(R.PROVENANCE),
}
