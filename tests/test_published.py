"""Tables that are switched together, or not at all."""

import os

import pytest
from pyspark.sql import functions as F

from cilode.sinks import published as P
from cilode.sinks.tables import publish_reports
from cilode.plans import reports as R

FILES = [
    ("/a/own.p.GitHub_Actions.ci.yml", "jobs: {t: {api-level: [30]}}\n# create avd"),
    ("/a/own.q.GitHub_Actions.ci.yml", "run: create avd"),
    ("/a/own.p.GitHub_Actions.bad.yml", "a: ["),
]


def values(spark, n):
    return {"one": spark.range(n), "two": spark.range(n).select(F.lit(n).alias("n"))}


def state(spark, out):
    paths = P.published(spark, out)
    return {name: sorted(map(tuple, spark.read.parquet(path).collect())) for name, path in paths.items()}


def test_a_failing_table_leaves_the_old_set(spark, tmp_path):
    out = str(tmp_path / "out")
    assert P.published(spark, out) == {}
    first = P.publish(spark, out, values(spark, 2))
    before = state(spark, out)
    assert before == {"one": [(0,), (1,)], "two": [(2,), (2,)]}
    broken = values(spark, 3)
    broken["two"] = spark.range(3).select(F.raise_error(F.lit("second table")).cast("int").alias("n"))
    with pytest.raises(Exception, match="second table"):
        P.publish(spark, out, broken)
    assert state(spark, out) == before and len(os.listdir(f"{out}/runs")) == 2
    assert {first} == {path.split("/")[-2] for path in P.published(spark, out).values()}
    P.publish(spark, out, values(spark, 1))
    assert state(spark, out) == {"one": [(0,)], "two": [(1,)]}
    assert P.read(spark, out, "two").columns == ["n"]


def test_names_of_earlier_runs_are_gone(spark, tmp_path):
    out = str(tmp_path / "out")
    P.publish(spark, out, values(spark, 1))
    P.publish(spark, out, {"three": spark.range(4)})
    assert set(P.published(spark, out)) == {"three"}
    with pytest.raises(KeyError):
        P.read(spark, out, "one")


def test_older_runs_can_be_removed(spark, tmp_path):
    out = str(tmp_path / "out")
    assert P.forget_older(spark, out) == 0
    for n in (1, 2, 3):
        P.publish(spark, out, values(spark, n))
    assert P.forget_older(spark, out) == 2 and len(os.listdir(f"{out}/runs")) == 1
    assert len(state(spark, out)["one"]) == 3


def test_reports_are_published_together(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    files = spark.createDataFrame(FILES, "path string, text string")
    publish_reports(spark, files, out)
    tables = P.published(spark, out)
    assert set(tables) == {
        "instrumentation_test_summary", "project_test_summary", "project_api_levels", "project_emulator_options",
        "project_test_types", "project_api_levels_detailed", "file_audit_uncommented", "file_audit_fixed_path",
        "file_audit_provenance",
    }
    levels = P.read(spark, out, "project_api_levels_detailed").collect()
    assert list(map(tuple, levels)) == [("p", "30", "matrix", "2")]
    audit = {r.path: r.error_kind for r in P.read(spark, out, "file_audit_uncommented").collect()}
    assert audit[FILES[2][0]] == "yaml"

    def failing(facts, report):
        return facts.select(F.raise_error(F.lit("lost")).cast("string").alias("project"))

    monkeypatch.setattr(R, "project_test_types", failing)
    with pytest.raises(Exception, match="lost"):
        publish_reports(spark, files.limit(1), out)
    assert P.published(spark, out) == tables
    assert list(map(tuple, P.read(spark, out, "project_api_levels_detailed").collect())) == list(map(tuple, levels))
    with pytest.raises(ValueError, match="instrumentation_test_summary"):
        publish_reports(spark, files, out, ("first", "uncommented"))
