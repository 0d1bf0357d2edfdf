"""One known document to typed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cilode.functions.documents import documents
from cilode.functions.extract import scalar_at

# The fields of the settings document, with the type each one has.
SETTINGS = {
    ("range", "min"): "int",
    ("range", "max"): "int",
    ("guesses",): "int",
    ("mode",): "string",
}


def config_fields(df: DataFrame, fields: dict = SETTINGS, text: str = "text") -> DataFrame:
    """Replace a text column by one typed column per path, named after the path.

    A field that is missing, or has another type, is NULL.
    """
    kept = [c for c in df.columns if c != text]
    read = df.select(*kept, documents(F.col(text), fields).alias("doc"))
    return read.select(
        *kept,
        *[
            scalar_at(F.col("doc")["nodes"], i).try_cast(type_).alias("_".join(path))
            for i, (path, type_) in enumerate(fields.items())
        ],
    )


def json_fields(df: DataFrame, fields: dict, text: str = "text") -> DataFrame:
    """`config_fields` for JSON texts, with Spark's own functions."""
    kept = [c for c in df.columns if c != text]
    parsed = df.select(*kept, F.try_parse_json(F.col(text)).alias("doc"))
    return parsed.select(
        *kept,
        *[
            F.try_variant_get("doc", "$" + "".join(f"['{key}']" for key in path), type_).alias("_".join(path))
            for path, type_ in fields.items()
        ],
    )


def config_entries(df: DataFrame, text: str = "text") -> DataFrame:
    """The whole document, one row per entry at its top: key, kind and Python text."""
    kept = [c for c in df.columns if c != text]
    nodes = df.select(*kept, F.explode(documents(F.col(text), [()])["nodes"]).alias("node"))
    return nodes.where("node.is_child").select(*kept, "node.key", "node.kind", "node.value")


def settings(df: DataFrame, text: str = "text") -> DataFrame:
    """The settings document, with the branch its mode selects.

    `single` draws a number from the range, `multi` asks a player for one.
    """
    mode = F.col("mode")
    branch = F.when(mode == "single", "draw").when(mode == "multi", "ask").otherwise("invalid")
    return config_fields(df, text=text).withColumn("branch", branch)
