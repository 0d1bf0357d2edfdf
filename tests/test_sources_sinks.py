"""Files in, tables out."""

import csv
import glob
import os

import pytest
from pyspark.sql import functions as F

from cilode.plans import reports as R
from cilode.sinks.tables import TABLES, write_csv, write_report
from cilode.sources import files as S
from cilode.sources.config import config_fields, json_fields, settings
from cilode.sources.files import compact, config_files

TREE = {
    "1 - x/own.proj.GitHub_Actions.ci.yml": "jobs: {t: {api-level: [30]}}",
    "own.proj.Travis_CI..travis.yml": "a: 1",
    "deep/er/est/other.proj.GitHub_Actions.ci.yaml": "# create avd\n'no': emulator",
    "practice.yaml": "- 1",
    "UP.YML": "a: 1",
    "a.yml.bak": "a: 1",
    "a.json": "{}",
    "sp ace/100% ü.p.q.yml": "x: ü",
}
HIDDEN = {".travis.yml": "b: 2", ".github/workflows/a.yml": "c: 3", "empty.yml": "", "_u.yml": "d: 4"}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for name, text in {**TREE, **HIDDEN}.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    os.symlink(root / "gone", root / "dangling.yml")
    return str(root)


def names(df, root):
    return sorted(r.path.replace("file:", "").removeprefix(root + "/") for r in df.select("path").collect())


def test_scan(spark, tree):
    accepted = sorted(n for n in TREE if n.endswith((".yml", ".yaml")))
    assert names(config_files(spark, tree, exact=False), tree) == accepted
    exact = config_files(spark, tree, on_unreadable="error_row")
    assert names(exact, tree) == sorted(accepted + list(HIDDEN) + ["dangling.yml"])
    for row in exact.collect():
        name = row.path.removeprefix(tree + "/")
        if name == "dangling.yml":
            assert row.content is None
        else:
            assert bytes(row.content).decode() == {**TREE, **HIDDEN}[name]
            assert row.length == len(row.content)
    assert exact.columns == config_files(spark, tree, exact=False).columns
    assert names(config_files(spark, f"file://{tree}", on_unreadable="error_row"), tree) == names(exact, tree)


def test_missing_and_unreadable_raise(spark, tree, tmp_path):
    with pytest.raises(Exception, match="no such folder"):
        config_files(spark, str(tmp_path / "none")).collect()
    with pytest.raises(Exception, match="dangling"):
        config_files(spark, tree).collect()
    with pytest.raises(ValueError):
        config_files(spark, tree, on_unreadable="x")
    assert config_files(spark, str(tmp_path), on_unreadable="error_row").count() == 10


def test_unreadable_folder(spark, tree, monkeypatch):
    entries = S._entries

    def locked(store, folder):
        if folder == f"{tree}/.github":
            raise PermissionError(folder)
        return entries(store, folder)

    monkeypatch.setattr(S, "_entries", locked)
    with pytest.raises(Exception, match="PermissionError"):
        S.listed(spark, tree, lenient=False)
    found = {r.path: r.length for r in S.listed(spark, tree, lenient=True).collect()}
    assert found[f"{tree}/.github"] is None and found[f"{tree}/empty.yml"] == 0


@pytest.mark.parametrize("entries, folders", [(1, 1), (7, 2), (1000, 1000)])
def test_listing_in_rounds(spark, tmp_path, entries, folders):
    """A deep chain, a wide folder and empty ones; each round goes on with the folders left."""
    wanted, at = set(), tmp_path
    for i in range(12):
        at = at / f"d{i}"
        at.mkdir()
        for name in (f"{i}.yml", f"{i}.txt", ".hid.yaml"):
            (at / name).write_text("x" * i)
        wanted |= {f"{at}/{i}.yml", f"{at}/.hid.yaml"}
        (at / "empty").mkdir()
    for i in range(40):
        (tmp_path / "wide" / f"w{i}").mkdir(parents=True)
        (tmp_path / "wide" / f"w{i}" / "a.yml").write_text("y")
        wanted.add(f"{tmp_path}/wide/w{i}/a.yml")
    os.symlink(tmp_path, tmp_path / "wide" / "loop")
    found = S.listed(spark, str(tmp_path), False, entries, folders)
    rows = found.collect()
    assert len(rows) == len(wanted) and {r.path for r in rows} == wanted
    assert {r.path: r.length for r in rows} == {p: os.path.getsize(p) for p in wanted}
    files = config_files(spark, str(tmp_path), split_files=5, list_entries=entries, list_folders=folders)
    assert {r.path for r in files.collect()} == wanted
    assert max(files.groupBy(F.spark_partition_id()).count().toDF("p", "n").agg(F.max("n")).first()) <= 5


def test_an_empty_folder(spark, tmp_path):
    assert config_files(spark, str(tmp_path)).collect() == []


def test_splits_follow_the_bytes(spark, tmp_path):
    for i in range(20):
        (tmp_path / f"{i}.yml").write_text("a" * 1000)
    assert config_files(spark, str(tmp_path)).rdd.getNumPartitions() == 1
    assert config_files(spark, str(tmp_path), split_bytes=4000).rdd.getNumPartitions() == 5
    assert config_files(spark, str(tmp_path), split_files=2).rdd.getNumPartitions() == 10
    assert config_files(spark, str(tmp_path), split_bytes=10).count() == 20


def test_exact_scan_counts_hidden_and_empty_files(spark, tree):
    facts = R.file_facts(config_files(spark, tree, on_unreadable="error_row", split_files=3), R.UNCOMMENTED)
    rows = {r.project: (r.test_types, r.yaml_errors) for r in R.instrumentation_test_summary(facts, R.UNCOMMENTED).collect()}
    assert rows["empty"] == ("none", 1) and rows["dangling"] == ("none", 1)
    assert rows["travis"] == ("none", 0) and rows["a"] == ("none", 0) and rows["_u"] == ("none", 0)


def test_compacted_tree_gives_the_same(spark, tree, tmp_path):
    files = config_files(spark, tree, exact=False)
    table = compact(files, str(tmp_path / "table"))
    for df in (files, table):
        facts = R.file_facts(df, R.PROVENANCE)
        rows = sorted(map(tuple, R.project_api_levels_detailed(facts).collect()))
        assert rows == [("proj", "30", "matrix", 3)]


def read_csv(folder):
    rows = []
    for part in sorted(glob.glob(f"{folder}/part-*.csv")):
        with open(part, newline="", encoding="utf-8") as file:
            header, *below = list(csv.reader(file))
            rows += [dict(zip(header, r)) for r in below]
    return rows


def test_csv_keeps_values(spark, tmp_path):
    values = ["plain", 'say "x"', "a, b", "two\nlines", " edge ", "", "#x", "\\", "é", "'q'", '"', "back\\\"slash"]
    df = spark.createDataFrame([(str(i), v, i % 2 == 0) for i, v in enumerate(values)], "i string, v string, b boolean")
    write_csv(df, str(tmp_path / "t"), parts=1)
    rows = read_csv(tmp_path / "t")
    assert [r["v"] for r in sorted(rows, key=lambda r: int(r["i"]))] == values
    assert {r["b"] for r in rows} == {"True", "False"}
    [part] = glob.glob(f"{tmp_path}/t/part-*.csv")
    with open(part, encoding="utf-8") as file:
        lines = file.read().split("\n")
    assert lines[0] == "i,v,b" and "0,plain,True" in lines and '2,"a, b",True' in lines and "5,,False" in lines


@pytest.mark.parametrize("name", TABLES)
def test_reports_are_written(spark, tree, tmp_path, name):
    out = str(tmp_path / "out")
    frames = write_report(spark, config_files(spark, tree, on_unreadable="error_row"), out, name)
    for table in TABLES[name][1]:
        written = read_csv(f"{out}/{table}")
        expected = frames[table].collect()
        assert sorted(tuple(r.values()) for r in written) == sorted(tuple(map(str, r)) for r in expected)
        assert not written or list(written[0]) == frames[table].columns
    audit = frames["file_audit"]
    assert audit.columns == ["path", "project", "test_types", "error", "error_kind", "message"]
    assert audit.count() == 10
    # Running again replaces the tables.
    write_report(spark, config_files(spark, tree, exact=False), out, name, parts=1)
    stored = spark.read.parquet(f"{out}/file_audit_{name}")
    assert stored.count() == 5 and set(audit.columns) <= set(stored.columns)


def test_settings(spark):
    text = "{{guesses: 12, mode: {}, range: {{max: 70, min: 40}}}}"
    rows = [(i, text.format(m)) for i, m in enumerate(["single", "multi", "team"])]
    rows += [(3, "range: 8\nguesses: many"), (4, "{")]
    got = settings(spark.createDataFrame(rows, "id int, text string")).orderBy("id").collect()
    assert tuple(got[0]) == (0, 40, 70, 12, "single", "draw")
    assert [r.branch for r in got] == ["draw", "ask", "invalid", "invalid", "invalid"]
    assert tuple(got[3])[1:5] == (None, None, None, None) and tuple(got[4])[1:5] == (None,) * 4


def test_typed_fields(spark):
    """A harbour log: every kind of value, a value used twice, a map that takes over another."""
    text = """
tide: {level: -0.25, rising: no}
berths:
- &first {length: 88, crane: yes}
- <<: *first
  length: 120
notes: |
  fog until noon
   wind from the west
signal: >-
  two long
  blasts
arrived: 1987-11-30T04:05:06
master:
"""
    fields = {
        ("tide", "level"): "double", ("tide", "rising"): "boolean", ("notes",): "string", ("signal",): "string",
        ("arrived",): "timestamp", ("master",): "string", ("tide", "none"): "int", ("berths",): "int",
    }
    row = config_fields(spark.createDataFrame([(text,)], "text string"), fields).select(
        "*", F.date_format("arrived", "yyyy-MM-dd HH:mm:ss").alias("when")
    ).drop("arrived").first()
    assert row.asDict() == {
        "tide_level": -0.25, "tide_rising": False, "notes": "fog until noon\n wind from the west\n",
        "signal": "two long blasts", "master": None, "tide_none": None, "berths": None, "when": "1987-11-30 04:05:06",
    }


def test_json_fields_need_no_python(spark):
    rows = [(1, '{"a": {"b c": 3}, "d": "7"}'), (2, '{"a": 5, "d": "x"}'), (3, "{"), (4, None)]
    got = json_fields(spark.createDataFrame(rows, "id int, text string"), {("a", "b c"): "int", ("d",): "int"})
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(1, 3, 7), (2, None, None), (3, None, None), (4, None, None)]
