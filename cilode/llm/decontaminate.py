"""Finding benchmark passages in documents with one Aho-Corasick automaton.

Questions and answers are normalised to lower-case words with single spaces between them;
every run of WINDOW words of an item is a pattern (the whole item, if it is shorter). Each
text is normalised alike and scanned once; the end of a match tells its words, and the words
their place in the original text.

The benchmark goes to the executors, so its size is checked. Up to BLOCK_CHARS characters it is one
automaton. A larger one is cut into blocks of that size, which come through the driver one
after the other: each is an automaton of its own and a pass over the stored texts that writes
what it finds, and the passes are put together by row. So a task holds one automaton at a
time, and the driver one block.

NULL and empty texts have no words. Rows are independent: repeated rows give repeated
results; an item that occurs twice in the benchmark counts under each of its ids once. A text
of any length is scanned once, as a whole. An empty benchmark finds nothing; an empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cilode.llm.common import stored

WINDOW = 10
# A block's automaton takes some hundred bytes per character.
BLOCK_CHARS = 1_000_000

_PLAIN = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
# One byte each: separators to a space, A-Z to lower case.
_NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def normal_words(text: str | bytes | None) -> list[bytes]:
    data = text.encode() if isinstance(text, str) else text or b""
    return data.translate(_NORMAL).split()


def windows(text: str | None, width: int = WINDOW) -> set[str]:
    """Patterns of an item. Bytes stand as single characters; spaces mark the word ends."""
    held = [w.decode("latin-1") for w in normal_words(text)]
    width = min(width, len(held))
    return {f" {' '.join(held[i : i + width])} " for i in range(len(held) - width + 1 if held else 0)}


def automaton(items: list[tuple[str, str | None]], width: int = WINDOW):
    """Automaton whose values are (number of words, numbers of the items with the window)."""
    owners: dict[str, list[int]] = {}
    for number, (_, text) in enumerate(items):
        for window in windows(text, width):
            owners.setdefault(window, []).append(number)
    machine = ahocorasick.Automaton()
    for window, numbers in owners.items():
        machine.add_word(window, (window.count(" ") - 1, tuple(numbers)))
    if owners:
        machine.make_automaton()
    return machine


def scan(machine, data: bytes) -> tuple[int, set[int], list[tuple[int, int]]]:
    """Number of words, items found, and the merged runs of hit words (first, last)."""
    held = data.translate(_NORMAL).split()
    if not held or not len(machine):
        return len(held), set(), []
    found: set[int] = set()
    ends: list[tuple[int, int]] = []
    for at, (size, numbers) in machine.iter(f" {b' '.join(held).decode('latin-1')} "):
        found.update(numbers)
        ends.append((at, size))
    if not ends:
        return len(held), found, []
    # A match ends at the space after its last word.
    spaces = np.cumsum(np.fromiter((len(w) + 1 for w in held), np.int64, len(held)))
    last = np.searchsorted(spaces, [at for at, _ in ends])
    runs: list[tuple[int, int]] = []
    for end, size in sorted(zip(last.tolist(), (s for _, s in ends)), key=lambda m: (m[0] - m[1], m[0])):
        start = end - size + 1
        if runs and start <= runs[-1][1] + 1:
            runs[-1] = (runs[-1][0], max(runs[-1][1], end))
        else:
            runs.append((start, end))
    return len(held), found, runs


def original_offsets(data: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point offsets (end exclusive) of runs of words in the original text."""
    if not runs:
        return []
    places = [m.span() for m in _PLAIN.finditer(data)]
    marks = np.array([(places[a][0], places[b][1]) for a, b in runs])
    # Bytes that do not continue a character, counted up to each mark.
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
    return [tuple(p) for p in chars[marks].tolist()]


MATCH_TYPE = pa.struct(
    [("n_words", pa.int64()), ("items", pa.list_(pa.string()))]
    + [(name, pa.list_(pa.int64())) for name in ("firsts", "lasts", "starts", "ends")]
)
MATCH = "struct<n_words:long,items:array<string>,firsts:array<long>,lasts:array<long>,starts:array<long>,ends:array<long>>"


def _matches(items: list[tuple[str, str | None]], width: int):
    """A column function: what `scan` and `original_offsets` find in a text."""

    @F.arrow_udf(MATCH)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = automaton(items, width)
        for texts in batches:
            rows = []
            for data in texts.cast(pa.binary()).to_pylist():
                count, numbers, runs = scan(machine, data or b"")
                spans = original_offsets(data or b"", runs)
                rows.append(
                    {
                        "n_words": count,
                        "items": sorted({items[i][0] for i in numbers}),
                        "firsts": [a for a, _ in runs],
                        "lasts": [b for _, b in runs],
                        "starts": [a for a, _ in spans],
                        "ends": [b for _, b in spans],
                    }
                )
            yield pa.array(rows, MATCH_TYPE)

    return found


def blocks(benchmark: DataFrame, item: str, texts: list[str], chars: int = BLOCK_CHARS):
    """The items (id as text, texts joined by a line end) in blocks of bounded size."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.concat_ws("\n", *texts).alias("text"))
    block, size = [], 0
    for row in rows.toLocalIterator():
        if block and size + len(row["text"]) > chars:
            yield block
            block, size = [], 0
        block.append((row["item"], row["text"]))
        size += len(row["text"])
    yield block


def matched(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    texts: tuple[str, ...] = ("text",),
    width: int = WINDOW,
    chars: int = BLOCK_CHARS,
    into: str = "matches",
) -> DataFrame:
    """Add an array with one struct per benchmark block that found something, and the first in any case:
    number of words, ids of the items found, first and last word of each hit run, and its start
    and end in the text."""
    held = blocks(benchmark, item, list(texts), chars)
    first, second = next(held), next(held, None)
    if second is None:
        return docs.withColumn(into, F.array(_matches(first, width)(F.col(text))))
    rows = stored(docs.withColumn("__llm_row", F.monotonically_increasing_id()), "texts")
    passes = []
    for number, block in enumerate(chain([first, second], held)):
        match = _matches(block, width)(F.col(text))
        hits = rows.select("__llm_row", F.struct(F.lit(number).alias("block"), match.alias("match")).alias("hit"))
        passes.append(stored(hits.where((F.size("hit.match.items") > 0) | F.lit(number == 0)), "hits"))
    every = reduce(DataFrame.unionByName, passes)
    # As many as there are blocks, for a text that all of them found something in.
    together = every.groupBy("__llm_row").agg(F.sort_array(F.collect_list("hit")).alias("__llm_hits"))
    joined = rows.join(together, "__llm_row")
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*kept, F.transform("__llm_hits", lambda h: h["match"]).alias(into))


def _hit_words(runs: Column) -> Column:
    """Number of words in sorted runs (first, last) that may overlap."""
    step = F.aggregate(
        runs,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("to")),
        lambda a, r: F.struct(
            (a["n"] + F.greatest(F.lit(0), r["last"] - F.greatest(r["first"] - 1, a["to"]))).cast("long").alias("n"),
            F.greatest(a["to"], r["last"]).alias("to"),
        ),
    )
    return step["n"]


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; a row per row of `docs`."""
    found = matched(docs.select("doc_id", "text"), benchmark, into="__m").select("doc_id", "__m")
    runs = F.flatten(
        F.transform(
            "__m",
            lambda m: F.zip_with(m["firsts"], m["lasts"], lambda a, b: F.struct(a.alias("first"), b.alias("last"))),
        )
    )
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("__m", lambda m: m["items"]))))
    return found.select(
        "doc_id", F.col("__m")[0]["n_words"].alias("n_words"), F.array_sort(runs).alias("runs"), items.alias("items")
    ).select(
        "doc_id",
        "n_words",
        _hit_words(F.col("runs")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` in which no window of the benchmark occurs, with their columns."""
    found = matched(docs, benchmark, into="__llm_matches")
    return found.where(~F.exists("__llm_matches", lambda m: F.size(m["items"]) > 0)).drop("__llm_matches")

