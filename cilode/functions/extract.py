"""Spark expressions on the nodes of `documents`: no Python runs here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cilode.functions.documents import DEEP, EACH, LIKE

FIXED_LEVELS = ("jobs", "instrumented-test", "strategy", "matrix", "api_level")
OPTIONS = "emulator-options"
FIXED_STEPS = ("jobs", "instrumented-test", "steps", EACH, "with", LIKE + OPTIONS)
ANY_LEVEL = ("jobs", DEEP, "api-level")


def _values(nodes: Column, keep) -> Column:
    return F.transform(F.filter(nodes, keep), lambda n: n["value"])


def scalar_at(nodes: Column, pattern: int) -> Column:
    """Text of the scalar at a fixed path; NULL where there is none, or a null."""
    return F.get(
        _values(nodes, lambda n: (n["pattern"] == pattern) & ~n["is_child"] & (n["kind"] != "null")), F.lit(0)
    )


def matrix_levels(nodes: Column, pattern: int) -> Column:
    """Digit-only items of lists that stand at a matched key."""
    return F.array_distinct(
        _values(nodes, lambda n: (n["pattern"] == pattern) & (n["parent_kind"] == "list") & n["is_digit"])
    )


def hardcoded_levels(nodes: Column, pattern: int) -> Column:
    """Digit-only scalars that stand at a matched key; floats and dates do not count."""
    return F.array_distinct(
        _values(
            nodes,
            lambda n: (n["pattern"] == pattern)
            & ~n["is_child"]
            & n["kind"].isin("int", "str", "bool")
            & n["is_digit"],
        )
    )


def tagged_levels(nodes: Column, pattern: int) -> Column:
    """Levels of one file with their source; a level of its matrix is not also hardcoded."""
    matrix = matrix_levels(nodes, pattern)

    def tag(levels: Column, source: str) -> Column:
        return F.transform(levels, lambda x: F.struct(F.lit(source).alias("source"), x.alias("api_level")))

    return F.concat(
        tag(matrix, "matrix"),
        tag(F.array_except(hardcoded_levels(nodes, pattern), matrix), "hardcoded"),
    )


def iterated_levels(nodes: Column, pattern: int) -> Column:
    """Sorted distinct texts that iterating over the matched value gives.

    Items of a list, keys of a map, characters of a string; nothing for other scalars.
    No digit filter.
    """
    def items(n: Column) -> Column:
        return (
            F.when(n["is_child"] & (n["parent_kind"] == "map"), F.array(n["key"]))
            .when(n["is_child"], F.array(n["value"]))
            .when((n["kind"] == "str") & (n["value"] != ""), F.split(n["value"], ""))
            .otherwise(F.array().cast("array<string>"))
        )

    matched = F.filter(nodes, lambda n: n["pattern"] == pattern)
    return F.array_sort(F.array_distinct(F.flatten(F.transform(matched, items))))


def step_options(nodes: Column, pattern: int, name: str = OPTIONS) -> Column:
    """Texts of the step inputs whose lower-cased key contains `name`, in file order.

    The scan of a file ends at the first step whose inputs are no map and at the first key
    that is no string; what came before stays.
    """
    mine = F.filter(nodes, lambda n: n["pattern"] == pattern)
    stops = F.filter(
        mine,
        lambda n: (~n["is_child"] & (n["kind"] != "map")) | (n["is_child"] & ~n["key_is_text"]),
    )
    stop = F.array_min(F.transform(stops, lambda n: n["seq"]))
    return _values(
        mine,
        lambda n: n["is_child"]
        & F.contains(F.lower(n["key"]), F.lit(name))
        & (stop.isNull() | (n["seq"] < stop)),
    )
