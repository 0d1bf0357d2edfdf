"""Text operators against Python's own string functions, and the table of path fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from cilode.functions import text as T

SEPARATORS = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", chr(0x2028), chr(0x2029)]
BLANKS = [" ", "\t", "\x1f", "\xa0", chr(0x1680), chr(0x2003), chr(0x202F), chr(0x205F), chr(0x3000)]


def column(spark, values, expression, type_="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {type_}")
    got = rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()
    return [row.y for row in got]


def test_comment_lines_like_python(spark):
    rng = random.Random(7)
    pieces = SEPARATORS + BLANKS + ["#", "# c", "a", "b # c", "é", chr(0x1F600), "\u200b", ""]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    want = ["\n".join(x for x in t.splitlines() if not x.strip().startswith("#")) for t in texts]
    got = column(spark, texts, T.without_comment_lines)
    assert [(t, g) for t, g, w in zip(texts, got, want) if g != w] == []


def test_comment_lines_are_idempotent(spark):
    texts = ["a\n# b\n\n", "#\n#", "", "  # x\na\r\n\t# y\r\nb", "a\n\n\n"]
    once = column(spark, texts, T.without_comment_lines)
    twice = column(spark, texts, lambda x: T.without_comment_lines(T.without_comment_lines(x)))
    assert once == ["a\n", "", "", "a\nb", "a\n\n"]
    assert twice == ["\n".join(x for x in t.splitlines() if not x.strip().startswith("#")) for t in once]


def test_normalised(spark):
    assert column(spark, ["a\r\nb\rc\n\td", None], T.normalised) == ["a\nb\nc\n d", None]


def test_decoded(spark):
    values = [b"\xff\xfe", "é\n".encode(), b"", b"\xed\xa0\x80", b"\xc0\xaf", "\ufeffa".encode()]
    assert column(spark, values, T.decoded, "binary") == [None, "é\n", "", None, None, "\ufeffa"]


@pytest.mark.parametrize(
    "path, prefix, position",
    [
        ("1 - x/own.proj.GitHub_Actions.ci.yml", "own.proj", "proj"),
        ("own.proj.Travis_CI..travis.yml", "own.proj", "proj"),
        ("own.proj.CircleCI.config.yml", "own.proj.CircleCI.config.yml", "proj"),
        ("own.proj.GitLab..gitlab-ci.yml", "own.proj.GitLab..gitlab-ci.yml", "proj"),
        ("other.proj.GitHub_Actions.ci.yaml", "other.proj", "proj"),
        ("practice.yaml", "practice.yaml", "practice"),
        ("/r/.travis.yml", ".travis.yml", "travis"),
        (".github/workflows/a.yml", "a.yml", "a"),
        ("a.GitHub_Actions.Travis_CI.GitHub_Actions.yml", "a", "GitHub_Actions"),
        ("file:/c/a b%20c/x.Travis_CI.y.GitHub_Actions.z.yml", "x", "Travis_CI"),
    ],
)
def test_project_keys(spark, path, prefix, position):
    assert column(spark, [path], T.project_by_prefix) == [prefix]
    assert column(spark, [path], T.project_by_position) == [position]


def test_suffix(spark):
    names = ["a.yml", "a.yaml", "UP.YML", "a.yml.bak", "a.json", "yml", ".yml"]
    assert column(spark, names, T.is_config_file) == [True, True, False, False, False, False, True]
