"""The reports on invented files: what each kind of file contributes to each of them."""

import random

import pytest
from pyspark.sql import functions as F

from cilode.functions.rules import labels_text
from cilode.plans import reports as R

FILES = {
    "empty": b"",
    "only_comment": b"# emulator create avd",
    "broken": b"run: create avd\njobs: [1, 2",
    "two_documents": b"a: create avd\n---\nb: adb",
    "leading_mark": b"---\na: create avd adb",
    "list_root": b"- create avd\n- adb",
    "text_root": b"create avd adb",
    "null_jobs": b"name: create avd adb\njobs:",
    "bad_bytes": b"\xff\xfecreate avd adb",
    "tab": b"a:\n\tb: create avd adb",
    "cycle": b"name: create avd adb\njobs: &a [*a]",
    "case": b"run: ./gradlew connectedAndroidTest",
    "flag_in_comment": b"# ${{ matrix.api_level }}\na: 1",
    "crlf": b"a: 1\r\n# create avd\r\nb: 2",
    "false_root": b"false # create avd adb",
}
MANUAL, GRADLE, CI = "GitHub_emulator_manual", "GitHub_gradle", "emulator_ci"
# file -> (types, error kind) for FIRST, UNCOMMENTED, FIXED_PATH and PROVENANCE
EXPECTED = {
    "empty": [("none", "empty"), ("none", "empty"), ("none", None), ("none", "empty")],
    "only_comment": [("none", "empty"), ("none", "empty"), (MANUAL, None), ("none", "empty")],
    "broken": [("none", "yaml")] * 4,
    "two_documents": [("none", "yaml")] * 4,
    "leading_mark": [(CI, None), (MANUAL, None), (MANUAL, None), (MANUAL, None)],
    "list_root": [(CI, None), (MANUAL, None), (MANUAL, None), ("none", "root")],
    "text_root": [(CI, None), (MANUAL, None), (MANUAL, None), ("none", "root")],
    "null_jobs": [(CI, None), (MANUAL, None), (MANUAL, None), (MANUAL, None)],
    "bad_bytes": [("none", "encoding")] * 4,
    "tab": [(CI, None), (MANUAL, None), (MANUAL, None), (MANUAL, None)],
    "cycle": [(CI, None), (MANUAL, None), (MANUAL, None), ("none", "cycle")],
    "case": [("none", None), (GRADLE, None), (GRADLE, None), ("none", None)],
    "flag_in_comment": [("none", None)] * 4,
    "crlf": [("none", None), ("none", None), (MANUAL, None), ("none", None)],
    "false_root": [("none", "empty"), (MANUAL, "empty"), (MANUAL, None), (MANUAL, "empty")],
}
REPORTS = [R.FIRST, R.UNCOMMENTED, R.FIXED_PATH, R.PROVENANCE]


def files(spark, contents, project="proj"):
    rows = [(f"/c/own.{project}.GitHub_Actions.{name}.yml", bytearray(c)) for name, c in contents.items()]
    return spark.createDataFrame(rows, "path string, content binary")


@pytest.mark.parametrize("number", range(4))
def test_every_kind_of_file(spark, number):
    report = REPORTS[number]
    audit = R.file_audit(R.file_facts(files(spark, FILES), report), report)
    got = {r.path.split(".")[-2]: (r.test_types, r.error_kind, r.error, r.message) for r in audit.collect()}
    for name, expected in EXPECTED.items():
        types, kind, error, message = got[name]
        assert (types, kind) == expected[number], name
        assert error == (kind is not None) and (message is not None) == (kind == "yaml"), name


def test_summaries_count_errors(spark):
    for report, errors in zip(REPORTS, (6, 6, None, 9)):
        facts = R.file_facts(files(spark, FILES), report)
        if errors is not None:
            [row] = R.instrumentation_test_summary(facts, report).collect()
            assert row.yaml_errors == errors
            assert row.project == ("own.proj" if report is R.FIRST else "proj")


def test_bad_encoding_can_stop_the_run(spark):
    with pytest.raises(Exception, match="not UTF-8"):
        R.file_facts(files(spark, FILES), R.FIXED_PATH, on_bad_encoding="fail").collect()
    with pytest.raises(ValueError):
        R.file_facts(files(spark, FILES), R.FIXED_PATH, on_bad_encoding="x")


def test_raw_flag_sees_comments(spark):
    facts = R.file_facts(files(spark, FILES), R.FIXED_PATH)
    assert [r.path for r in facts.where("uses_matrix").collect()] == ["/c/own.proj.GitHub_Actions.flag_in_comment.yml"]
    broken = {"x": b"a: [1 # matrix.api_level"}
    assert not R.file_facts(files(spark, broken), R.FIXED_PATH).first().uses_matrix


LEVEL_FILES = {
    "list": b"jobs: {t: {api-level: [29, 30]}}",
    "scalar": b"jobs: {t: {api-level: 29}, u: {api-level: 21}}",
    "both": b"jobs: {t: {api-level: [33]}, u: {api-level: 33}}",
    "broken": b"jobs: [",
    "none": b"a: 1",
    "cycle": b"jobs: &a {api-level: 99, b: *a}",
}


def test_levels_are_subtracted_per_file(spark):
    facts = R.file_facts(files(spark, LEVEL_FILES), R.PROVENANCE)
    rows = sorted(map(tuple, R.project_api_levels_detailed(facts).collect()))
    assert rows == [
        ("proj", "21", "hardcoded", 6), ("proj", "29", "hardcoded", 6), ("proj", "29", "matrix", 6),
        ("proj", "30", "matrix", 6), ("proj", "33", "matrix", 6)]
    assert list(map(tuple, R.project_test_types(facts).collect())) == [("proj", "none", 3, 2, 6, 2)]


OPTION_FILES = {
    "b": b"jobs: {instrumented-test: {strategy: {matrix: {api_level: [21, 29]}}, "
    b"steps: [{with: {emulator-options: x}}, {with: {emulator-options: x}}]}}",
    "a": b"jobs: {instrumented-test: {strategy: {matrix: {api_level: [29]}}, steps: [{with: {emulator-options: y}}]}}",
    "c": b"# matrix.api_level\nx: create avd",
}


def test_fixed_path_tables(spark):
    data = files(spark, OPTION_FILES).union(files(spark, {"d": b"a: 1"}, "other"))
    facts = R.file_facts(data, R.FIXED_PATH)
    assert sorted(map(tuple, R.project_test_summary(facts).collect())) == [
        ("other", 1, "none", False, 0, False), ("proj", 3, MANUAL, True, 2, True)]
    assert sorted(map(tuple, R.project_api_levels(facts).collect())) == [("proj", "21"), ("proj", "29")]
    placed = sorted(map(tuple, R.in_file_order(facts).collect()))
    assert placed == [(0, "proj", "y"), (1, "proj", "x"), (2, "proj", "x")]
    assert sorted(map(tuple, R.project_emulator_options(facts).collect())) == [("proj", "x"), ("proj", "x"), ("proj", "y")]


def test_owners_collide_and_copies_count(spark):
    rows = [(f"/c/{owner}.proj.GitHub_Actions.ci.yml", "jobs: {t: {api-level: 30}}") for owner in ("a", "b", "b")]
    facts = R.file_facts(spark.createDataFrame(rows, "path string, text string"), R.PROVENANCE)
    assert list(map(tuple, R.project_api_levels_detailed(facts).collect())) == [("proj", "30", "hardcoded", 3)]


def test_results_do_not_depend_on_partitions(spark):
    rng = random.Random(5)
    contents = [rng.choice(list({**FILES, **LEVEL_FILES, **OPTION_FILES}.values())) for _ in range(300)]
    # One project holds a third of all files.
    names = [f"o.p{0 if i % 3 == 0 else rng.randint(1, 40)}.GitHub_Actions.{i}.yml" for i in range(300)]
    data = spark.createDataFrame([(n, bytearray(c)) for n, c in zip(names, contents)], "path string, content binary")
    results = []
    for parts in (1, 13):
        spread = data.repartition(parts)
        provenance, fixed = R.file_facts(spread, R.PROVENANCE), R.file_facts(spread, R.FIXED_PATH)
        tables = [
            R.project_test_types(provenance), R.project_api_levels_detailed(provenance),
            R.project_test_summary(fixed), R.project_api_levels(fixed), R.project_emulator_options(fixed),
        ]
        results.append([sorted(map(repr, t.collect())) for t in tables])
    assert results[0] == results[1]
    # The one-pass rollup against separate aggregates.
    facts = R.file_facts(data, R.PROVENANCE)
    levels = facts.select("project", F.explode("levels").alias("x"))
    for source in ("matrix", "hardcoded"):
        want = dict(levels.where(F.col("x.source") == source).groupBy("project").agg(F.count_distinct("x.api_level")).collect())
        got = {r["project"]: r[f"distinct_{source}_api_levels"] for r in R.project_test_types(facts).collect()}
        assert got == {p: want.get(p, 0) for p in got}
    union = facts.select("project", F.explode(F.split(labels_text(F.col("labels"), R.PROVENANCE.rules), ", ")).alias("t"))
    want = {r.project: r.t for r in union.where("t <> 'none'").groupBy("project").agg(F.array_join(F.array_sort(F.collect_set("t")), ", ").alias("t")).collect()}
    for row in R.project_test_types(facts).collect():
        assert row.test_types == want.get(row.project, "none")


def test_files_without_the_words_need_no_load(spark):
    contents = {
        **LEVEL_FILES, **OPTION_FILES, **FILES,
        "escaped": b'jobs: {t: {"api\\x2dlevel": 44}, "instrumented-\\u0074est": {strategy: {matrix: {"api\\x5flevel": [5]}},'
        b' steps: [{with: {"emulator\\x2doptions": z}}]}}',
        "capitals": b"jobs: {t: {API-Level: 45}}",
    }
    data = files(spark, contents)
    for report, table in ((R.PROVENANCE, R.project_levels), (R.FIXED_PATH, R.project_api_levels)):
        want = sorted(map(tuple, table(R.file_facts(data, report)).collect()))
        got = sorted(map(tuple, table(R.file_facts(data, report, only=report.level_words)).collect()))
        assert got == want and ("44" in str(got) or "'5'" in str(got))
    facts = R.file_facts(data, R.FIXED_PATH, only=R.FIXED_PATH.option_words)
    assert sorted(r.emulator_option for r in R.project_emulator_options(facts).collect()) == ["x", "x", "y", "z"]
    narrow = R.file_facts(data, R.PROVENANCE, only=R.PROVENANCE.level_words)
    counted = R.project_api_levels_detailed(narrow, R.config_projects(data, R.PROVENANCE))
    assert sorted(map(tuple, counted.collect())) == sorted(
        map(tuple, R.project_api_levels_detailed(R.file_facts(data, R.PROVENANCE)).collect()))
    assert narrow.count() < data.count()


LONG = b"0x1" + b"0" * 5000
SEARCH_FILES = {
    "levels": b"name: create avd\njobs: {instrumented-test: {strategy: {matrix: {api_level: [29, " + LONG + b"]}}}}",
    "input": b"jobs: {instrumented-test: {steps: [{with: {emulator-options: x, other: " + LONG + b"}}]}}",
    "depth": b"name: create avd\njobs: {t: {api-level: [30, " + LONG + b"]}}",
}


@pytest.mark.parametrize("number", range(4))
def test_a_failed_search_is_no_failed_load(spark, number):
    report = REPORTS[number]
    rows = {r.path.split(".")[-2]: r for r in R.file_facts(files(spark, SEARCH_FILES), report).collect()}
    kinds = {name: r.error_kind for name, r in rows.items()}
    assert kinds == {"levels": None, "input": None, "depth": "search" if report is R.PROVENANCE else None}
    if report is not R.FIRST:
        assert rows["levels"].labels[MANUAL] and rows["depth"].labels[MANUAL] == (report is not R.PROVENANCE)
    if report is R.FIXED_PATH:
        assert [x.api_level for x in rows["levels"].levels] == ["29"] and rows["input"].options == ["x"]
    if report is R.PROVENANCE:
        assert rows["depth"].levels == []


def test_options_carry_their_order(spark):
    facts = R.file_facts(files(spark, OPTION_FILES), R.FIXED_PATH)
    rows = sorted((r.path.split(".")[-2], r.position, r.emulator_option) for r in R.options_in_order(facts).collect())
    assert rows == [("a", 0, "y"), ("b", 0, "x"), ("b", 1, "x")]
