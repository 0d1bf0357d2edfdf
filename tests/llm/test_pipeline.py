"""The pipeline: each stage's decisions take effect, and the entry works without the subpackage."""

import random
import shutil
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from cilode.llm import packing, quality

ROOT = Path(__file__).parents[2]


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def test_near_copies_of_the_stage(spark):
    """Two edits in a hundred words: 0.811 by five words, a copy; 0.848 by four, which op 3 keeps. Three are 0.73."""
    held = words(100, 7).split()
    twice, thrice = list(held), list(held)
    twice[30] = twice[70] = thrice[20] = thrice[50] = thrice[80] = "edited"
    rows = [(1, " ".join(held)), (2, " ".join(twice)), (3, " ".join(thrice))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 3]


def test_stages(spark, tmp_path):
    leaked = words(30, 99)
    clean = [(i, words(80, i), "en", "s", 0) for i in range(20)]
    rows = clean + [
        (100, "too short", "en", "s", 0),
        (101, None, "en", "s", 0),
        (102, clean[3][1], "en", "s", 0),
        (103, clean[4][1] + " more", "en", "s", 0),
        (104, words(40, 50) + " " + leaked.upper() + " " + words(40, 51), "en", "s", 0),
        (105, words(60, 52) + " password=hunter2hunter2 " + words(30, 53), "en", "s", 0),
        (106, "same again and again here now then " * 20, "en", "s", 0),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leaked)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns
        after.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    good = {i for i, *_ in clean}
    assert set(kept["quality_rules"]) == good | {102, 103, 104, 105}
    assert set(kept["ngram_jaccard_join"]) == good | {104, 105}
    assert set(kept["benchmark_decontamination"]) == good | {105}
    assert {i: t for i, t in kept["secret_scans"].items() if i != 105} == {i: t for i, t, *_ in clean}
    assert "hunter2" not in kept["secret_scans"][105] and "[SECRET]" in kept["secret_scans"][105]
    want = sorted(map(tuple, packing.packed(docs).collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == want
    assert {w[0] for w in want} == good | {105}


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_empty_tables_go_through_all_stages(spark, tmp_path):
    spark.createDataFrame([], DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_nulls_repeats_and_other_columns(spark, tmp_path):
    """Rows with NULLs, rows that repeat, an empty benchmark, and columns with the operators' own names."""
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, words(80, 1), None, None, None), (1, words(80, 1), None, None, None), (None, words(80, 2), "en", "s", 1), (3, None, "en", "s", 2)]
    rows += [(4, words(25_000, 4), "en", "s", 3)]
    docs = spark.createDataFrame(rows, DOCUMENTS).selectExpr("*", "1 AS key", "'x' AS node", "2 AS spans", "3 AS matches", "4 AS row", "5 AS part")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns
        after.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        # Both rows of a document that stays are kept; a text of no words is no good.
        assert sorted((r.doc_id or 0) for r in docs.collect()) == [0, 1, 1, 4]
    packed = corpus_pipeline.packed_sequences(spark, docs, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == {None, 1, 4}


def test_entry_without_a_library(tmp_path):
    """The other queries stay where a library of the operators is not installed."""
    code = (
        "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); "
        "assert q and 'pipeline' not in q and set(e.oracle_sql()) == set(q)"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env={"PATH": "/usr/bin:/bin"})


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() for n in q); assert set(e.oracle_sql()) == set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env={"PATH": "/usr/bin:/bin"})


def test_all_operators_are_registered():
    import __spark_entry__ as entry

    names = {n.split("_")[0] for n in entry.queries() if n[:2] == "op" and n[2].isdigit()}
    assert names == {f"op{n}" for n in range(1, 14)} and "pipeline" in entry.queries()
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality_rules" and quality.good
