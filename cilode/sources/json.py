"""Levels and options out of JSON documents, with Spark's own functions: no Python runs here.

A JSON text becomes a VARIANT; documents are then searched by rounds. The frontier of a round
holds the containers reached so far; one generator opens each of them into its entries, and
an entry is a hit, a container to go into, or nothing. Several levels are opened in one pass,
each level's hits going through the next as they are; the containers left are stored and are
the next round's frontier, until there are none. Depth is bounded by the data only.

Documents mean what they mean to the YAML reader, with these differences of JSON: keys are
always strings and an object keeps them sorted, so options of one step come in the order of
their keys; a key that is there twice makes a document invalid; numbers have one form only,
so 29.0 is a number that is no whole one; a whole number beyond 64 bits counts as such too;
objects and arrays that stand as an option are written as JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cilode.functions.extract import FIXED_LEVELS, FIXED_STEPS, OPTIONS
from cilode.operators.stored import stored

LEVEL_KEY = "api-level"
# Levels of a document that are opened in one pass.
LEVELS_A_PASS = 4

_ARRAY = "array<variant>"
_OBJECT = "map<string,variant>"


def parsed(df: DataFrame, text: str = "text", into: str = "doc") -> DataFrame:
    """Replace a text column by its VARIANT; NULL where the text is no JSON document."""
    return df.withColumn(into, F.try_parse_json(F.col(text))).drop(text)


def at(doc: Column, *keys: str) -> Column:
    """What stands at a path of keys; NULL where there is none."""
    path = "$" + "".join("['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']" for key in keys)
    return F.try_variant_get(doc, path, "variant")


def _kind(value: Column) -> Column:
    """BIGINT, STRING, BOOLEAN, VOID, DECIMAL..., DOUBLE of a scalar, and more than that of others."""
    return F.schema_of_variant(value)


def _is_array(value: Column) -> Column:
    """Whether it is an array with items; looks at the first one only."""
    return F.try_variant_get(value, "$[0]", "variant").isNotNull()


def _is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", _OBJECT).isNotNull()


def plain_text(value: Column) -> Column:
    """The text of a value as a Python program prints it."""
    kind = _kind(value)
    return (
        F.when(kind == "VOID", "None")
        .when(kind == "BOOLEAN", F.initcap(value.try_cast("string")))
        .when(F.startswith(kind, F.lit("ARRAY")) | F.startswith(kind, F.lit("OBJECT")), F.to_json(value))
        .otherwise(value.try_cast("string"))
    )


def digits(value: Column) -> Column:
    """The text of a whole number or a string that is digits only, else NULL."""
    text = value.try_cast("string")
    return F.when(_kind(value).isin("BIGINT", "STRING") & text.rlike("^[0-9]+$"), text)


def _opened(frontier: DataFrame, keep: list[str]) -> DataFrame:
    """One level further: entries of the nodes; rows that are hits already stay as they are.

    An entry whose key is the wanted one is a hit and is not gone into; a list there is a hit
    of its own kind, whose items follow one level later."""
    spark = frontier.sparkSession
    entries = frontier.lateralJoin(spark.tvf.variant_explode_outer(F.col("node").outer()))
    done = F.col("source").isNotNull() & F.col("node").isNull()
    item = F.col("source").isNotNull() & F.col("node").isNotNull()  # of a list that was hit
    hit = F.coalesce(F.lower("key") == LEVEL_KEY, F.lit(False))
    value = F.col("value")
    lists, scalar = hit & _is_array(value), hit & ~_is_array(value)
    source = (
        F.when(done | item, F.col("source")).when(lists, "matrix").when(scalar, "hardcoded")
    )
    level = F.when(done, F.col("api_level")).when(item | scalar, digits(value))
    inside = _is_array(value) | _is_object(value)
    node = F.when(~done & ~item & (lists | (~hit & inside)), value)
    opened = entries.select(*keep, source.alias("source"), level.alias("api_level"), node.alias("node"))
    return opened.where("node is not null or api_level is not null")


def deep_levels(docs: DataFrame, key: str = "path", text: str = "text", levels: int = LEVELS_A_PASS) -> DataFrame:
    """Distinct (key, source, api_level): levels anywhere below `jobs`, those of a list as `matrix`, of a
    single value as `hardcoded`; what a document has in a list is not also hardcoded.

    Rows with the same key are one document; a NULL text has no level. Texts that cannot have
    the wanted key are left out before they are parsed.
    """
    can = F.contains(F.lower(F.col(text)), F.lit(LEVEL_KEY)) | F.contains(F.col(text), F.lit("\\"))
    jobs = at(F.col("doc"), "jobs")
    frontier = (
        parsed(docs.where(can).select(F.col(key).alias("key_"), F.col(text).alias("text")))
        .select("key_", F.when(_is_array(jobs) | _is_object(jobs), jobs).alias("node"))
        .where("node is not null")
        .select("key_", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("api_level"), "node")
    )
    rounds = []
    while True:
        for _ in range(levels):
            frontier = _opened(frontier, ["key_"])
        rounds.append(stored(frontier, "opened"))
        frontier = rounds[-1].where("node is not null")
        if frontier.isEmpty():
            break
    found = rounds[0]
    for more in rounds[1:]:
        found = found.unionByName(more)
    # A level of a document that is in one of its lists counts there.
    distinct = (
        found.where("api_level is not null").groupBy("key_", "api_level").agg(F.bool_or(F.col("source") == "matrix").alias("listed"))
    )
    source = F.when(F.col("listed"), "matrix").otherwise("hardcoded")
    return distinct.select(F.col("key_").alias(key), source.alias("source"), "api_level")


def fixed_levels(docs: DataFrame, key: str = "path", text: str = "text", path: tuple = FIXED_LEVELS) -> DataFrame:
    """Distinct (key, api_level): what iterating over the value at a fixed path gives: items of an array,
    keys of an object, characters of a string; nothing for other values."""
    value = at(F.col("doc"), *path)
    items = (
        F.when(_is_array(value), F.transform(F.try_variant_get(value, "$", _ARRAY), plain_text))
        .when(_is_object(value), F.map_keys(F.try_variant_get(value, "$", _OBJECT)))
        .when((_kind(value) == "STRING") & (value.try_cast("string") != ""), F.split(value.try_cast("string"), ""))
    )
    rows = parsed(docs.select(F.col(key), F.col(text).alias("text")))
    return rows.select(key, F.explode(items).alias("api_level")).distinct()


def step_options(docs: DataFrame, key: str = "path", text: str = "text", name: str = OPTIONS) -> DataFrame:
    """(key, step, position, emulator_option): inputs of the steps of the fixed job whose lower-cased key
    contains `name`, duplicates kept. Steps count up to the first whose inputs are there but
    are no object."""
    steps = F.try_variant_get(at(F.col("doc"), *FIXED_STEPS[:3]), "$", _ARRAY)
    inputs = F.transform(steps, lambda step: at(step, "with"))
    # The first step whose inputs stop the scan, counted from 1; none is 0.
    stop = F.array_position(F.transform(inputs, lambda w: F.coalesce(w.isNotNull() & ~_is_object(w), F.lit(False))), True)
    rows = parsed(docs.select(F.col(key).alias("key_"), F.col(text).alias("text")))
    opened = (
        rows.select("key_", inputs.alias("inputs"), stop.alias("stop"))
        .select("key_", "stop", F.posexplode("inputs").alias("step", "with"))
        .where("with is not null and (stop = 0 or step + 1 < stop)")
    )
    entries = opened.lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("with").outer()))
    return entries.where(F.contains(F.lower("key"), F.lit(name))).select(
        F.col("key_").alias(key), "step", F.col("pos").alias("position"), plain_text(F.col("value")).alias("emulator_option")
    )
