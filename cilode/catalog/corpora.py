"""Corpora that Spark derives from the given tables, with known answers.

The tables hold no YAML, so one file is written per row: what a file contains follows from
the columns of its row, and the expected results can be computed from the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


PHRASE_WORDS = 6


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _lines(*parts: str) -> str:
    return "concat_ws('\\n', " + ", ".join(parts) + ")"


# One workflow per order. Status P gives the odd documents, one kind per priority; the
# others are workflows whose parts vary with the priority. A third of all files belongs to
# one project. Files of the oldest year have no accepted suffix.
WORKFLOW_PATH = """
    concat('/corpus/', o_orderstatus, '/', lower(o_orderstatus), '-org.',
           if(o_orderstatus = 'O', 'monorepo', concat('cust', o_custkey)),
           element_at(array('.GitHub_Actions.ci', '.Travis_CI..travis', '.CircleCI.config',
                            '.GitLab..gitlab-ci', '.GitHub_Actions.test'), p),
           '-', k,
           if(y = 25, '.yml.bak', if(p = 4, '.yaml', '.yml')))
"""
WORKFLOW_TEXT = (
    "CASE o_orderstatus WHEN 'P' THEN CASE p "
    "WHEN 1 THEN " + _lines("'on: push'", "concat('jobs: [1, ', k)", "'run: adb connectedCheck'") + " "
    "WHEN 2 THEN concat('# create avd for the emulator ', k) "
    "WHEN 3 THEN " + _lines("'- adb shell create avd'", "concat('- api-level: ', d)") + " "
    "WHEN 4 THEN " + _lines("concat('name: firebase test ', k)", "'jobs:'") + " "
    "ELSE " + _lines("'---'", "'a: adb create avd'", "'---'", "concat('b: ', k)") + " END "
    "ELSE " + _lines(
        "concat('name: build ', k)",
        "if(p = 3, 'on: push\\t', 'on: push')",
        "'jobs:'",
        "if(o_orderstatus = 'F', '  instrumented-test:', '  device:')",
        "'    strategy:'",
        "'      matrix:'",
        "concat('        api_level: ', CASE p"
        " WHEN 3 THEN cast(y AS string)"
        " WHEN 4 THEN concat('{', y, ': a, ', d, ': b}')"
        " WHEN 5 THEN concat('\"', d, '\"')"
        " ELSE concat('[', y, ', ', d, ', ', y, ', null]') END)",
        "if(p <= 2, concat('        api-level: [', y, ', \"', m, '\", ', d, '.5, x]'), NULL)",
        "'        exclude:'",
        "concat('          - api-level: ', m)",
        "'    steps:'",
        "if(p = 3, '      # - run: create AVD', NULL)",
    "if(p = 2 AND o_orderstatus = 'O', '      - uses: Malinskiy/action-android/emulator-run-cmd@main', NULL)",
        "element_at(array('      - uses: reactivecircus/android-emulator-runner@v2',"
        " '      - run: ./gradlew connectedAndroidTest',"
        " '      - uses: browserstack/github-actions@master',"
        " '      - run: gcloud firebase test android run',"
        " '      - run: make # appcenter test run'), p)",
        "'        with:'",
        "concat('          API-Level: ', d)",
        "concat('          Emulator-Options: -port ', k)",
        "concat('      - with: ', element_at(array("
        "'{emulator-options: -no-window, API-Level: \"${{ matrix.api_level }}\"}',"
        " 'null', '{7: x, emulator-options: lost}', '{emulator-options: [a, 1]}', 'plain'), p))",
        "'      - with: {emulator-options: tail}'",
    ) + " END"
)


# The same in JSON, with lists in lists and deeper maps.
JSON_TEXT = (
    "CASE o_orderstatus WHEN 'P' THEN CASE p "
    "WHEN 1 THEN concat('{\"jobs\": {\"a\": {\"api-level\": ', d, '}}') "
    "WHEN 2 THEN '' "
    "WHEN 3 THEN concat('[{\"jobs\": {\"api-level\": ', d, '}}]') "
    "WHEN 4 THEN concat('{\"jobs\": null, \"api-level\": ', d, '}') "
    "ELSE concat('\"api-level ', d, '\"') END "
    "ELSE concat('{\"name\": \"build ', k, '\", \"jobs\": {\"',"
    " if(o_orderstatus = 'F', 'instrumented-test', 'device'), '\": {\"strategy\": {\"matrix\": {\"api_level\": ',"
    " CASE p WHEN 3 THEN cast(y AS string)"
    " WHEN 4 THEN concat('{\"', y, '\": \"a\", \"d', d, '\": \"b\"}')"
    " WHEN 5 THEN concat('\"', d, '\"')"
    " ELSE concat('[', y, ', \"', d, '\", ', y, ', null, true]') END,"
    " if(p <= 2, concat(', \"api-level\": [', y, ', \"', m, '\", ', d, '.5, \"x\", [', d, ']]'), ''),"
    " ', \"exclude\": [[[{\"at\": {\"API-Level\": \"', m, '\"}}]]]}}, \"steps\": ["
    "{\"run\": \"make\"}, {\"with\": {\"API-Level\": ', d, ', \"Emulator-Options\": \"-port ', k, '\"}}, {\"with\": ',"
    " element_at(array('{\"Emulator-options\": false, \"my-emulator-options\": 7}', 'null',"
    " '{\"7\": \"x\", \"emulator-options\": null}', '{\"emulator-options\": [\"a\", 1]}', '\"plain\"'), p),"
    " '}, {\"with\": {\"emulator-options\": \"tail\"}}]}}}') END"
)


def json_workflows(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text), one JSON document per order."""
    path = "concat('/json/', o_orderkey, '.json')"
    return _orders(spark, folder).select(F.expr(path).alias("path"), _made_once(JSON_TEXT).alias("text"))


def workflows(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text), one file per order."""
    return _orders(spark, folder).select(F.expr(WORKFLOW_PATH).alias("path"), _made_once(WORKFLOW_TEXT).alias("text"))


def _made_once(text: str) -> Column:
    """The text, in an expression that Spark takes to depend on the partition. Else a filter on texts would move below
    the dealing of rows, into the one task that reads a row group, and make each text again there."""
    return F.expr(f"if(spark_partition_id() < 0, NULL, {text})")


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    """The orders with the numbers that the texts are made of."""
    # The rows are dealt out while they are some numbers each, before they become texts: a small
    # table is one row group and would be one task, and adaptive execution would join its
    # partitions again, as it cannot know what the texts will cost.
    orders = (
        table(spark, folder, "orders")
        .select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
        .repartition(2 * spark.sparkContext.defaultParallelism, "o_orderkey")
    )
    return orders.selectExpr(
        "*",
        "o_orderkey AS k",
        "cast(left(o_orderpriority, 1) AS int) AS p",
        "year(o_orderdate) - 1970 AS y",
        "month(o_orderdate) + 15 AS m",
        "dayofmonth(o_orderdate) + 10 AS d",
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text, lang, source)."""
    return table(spark, folder, "documents").select("doc_id", "text", "lang", "source")


def phrase_rules(spark: SparkSession, folder: str) -> DataFrame:
    """(label, keyword): a rule per run of PHRASE_WORDS words of every benchmark text."""
    words = table(spark, folder, "benchmark").select("item_id", F.split("text", " ").alias("words"))
    starts = words.select("item_id", "words", F.explode(F.sequence(F.lit(1), F.size("words") - PHRASE_WORDS + 1)).alias("i"))
    return starts.where(F.size("words") >= PHRASE_WORDS).select(
        F.format_string("%05d-%04d", "item_id", "i").alias("label"),
        F.array_join(F.slice("words", F.col("i"), PHRASE_WORDS), " ").alias("keyword"),
    )


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, project, text): every document, lines that open with a vowel commented out."""
    return documents(spark, folder).select(
        "doc_id",
        F.col("source").alias("project"),
        F.regexp_replace("text", r"(?m)^([AEIOU])", "  # $1").alias("text"),
    )


def encoded(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, content): every document as bytes, with all kinds of line ends and tabs.

    French ones start with a byte that UTF-8 does not have.
    """
    text = F.replace(
        F.replace(F.col("text"), F.lit(". "), F.lit(".\t\r\n")), F.lit(", "), F.lit(",\r")
    )
    prefix = F.when(F.col("lang") == "fr", F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    return documents(spark, folder).select(
        "doc_id", F.concat(prefix, text.cast("binary")).alias("content")
    )


def settings_files(spark: SparkSession, folder: str) -> DataFrame:
    """(p_partkey, text): a settings document per part."""
    return table(spark, folder, "part").selectExpr(
        "p_partkey",
        "concat('mode: ', CASE WHEN p_type = 'SMALL' THEN 'single' WHEN p_type = 'ECONOMY' THEN 'multi' "
        "ELSE p_brand END, '\\nrange: {max: ', p_size + 100, ', min: ', p_size, '}\\nguesses: ', p_size) AS text",
    )
