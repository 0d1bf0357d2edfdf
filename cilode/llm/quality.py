"""Quality rules as a short-circuit cascade.

Every rule is a Spark expression on the text. Its cost and selectivity are estimated on a
sample, and the rules are applied in the order of rejections per second of cost: CASE WHEN
evaluates a rule only for the rows that all earlier ones let pass. The order changes the
time, never the verdict.

NULL counts as an empty text, which has no words and fails. Copies of a row are judged
alike, and columns other than the text are not looked at.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cilode.llm.common import WORD, let, total, words

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
MAX_SYMBOL_PERCENT = 5
MAX_DUP_LINE_PERCENT = 30
MAX_CAPITAL_PERCENT = 50
MAX_DIGIT_PERCENT = 30

SYMBOLS = r"[#*$%&|<>]+"
# The sample: so many rows with texts of up to so many bytes. It decides an order only.
SAMPLE_ROWS = 1000
SAMPLE_BYTES = 1 << 16
SAMPLE_RUNS = 2


@dataclass(frozen=True)
class Rule:
    """`rejects` is true for a text (never NULL) that the rule throws out."""

    name: str
    rejects: Column


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


def symbols(text: Column) -> Column:
    """Number of characters in SYMBOLS."""
    return (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long")


def _lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n", -1), lambda line: F.rlike(line, F.lit(WORD)))


def _repeats(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Number of lines with a word that equal an earlier line."""
    return let(_lines(text), _repeats)


def repeated_words(held: Column, width: int = WINDOW) -> Column:
    """Number of words in windows of `width` words that occur at least twice in the array.

    Windows are told apart by a hash first; only where two hashes are equal are they sorted
    and compared by their words. Cost and memory are those of a sort of one text's windows.
    """

    def marked(positions: Column) -> Column:
        step = F.transform(
            positions, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(positions, k + 1) - p, F.lit(width)))
        )
        return total(step)

    def same(a: Column, b: Column) -> Column:
        return F.coalesce((a["h"] == b["h"]) & (a["words"] == b["words"]), F.lit(False))

    def found(order: Column) -> Column:
        twice = F.filter(order, lambda x, k: same(x, F.get(order, k - 1)) | same(x, F.get(order, k + 1)))
        return let(F.sort_array(F.transform(twice, lambda x: x["at"])), marked)

    def exact(hashes: Column) -> Column:
        order = F.sort_array(
            F.transform(
                hashes,
                lambda h, i: F.struct(h.alias("h"), F.slice(held, i + 1, width).alias("words"), i.alias("at")),
            )
        )
        distinct = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(distinct, F.lit(0).cast("long")).otherwise(let(order, found))

    starts = F.sequence(F.lit(0), F.size(held) - width)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(held, i + k) for k in range(width)]))
    return F.when(F.size(held) <= width, F.lit(0).cast("long")).otherwise(let(hashes, exact))


def statistics(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    text = F.coalesce(text, F.lit(""))
    return let(
        words(text),
        lambda held: F.struct(
            F.size(held).cast("long").alias("n_words"),
            F.length(F.array_join(held, "")).cast("long").alias("word_chars"),
            symbols(text).alias("n_symbols"),
            duplicate_lines(text).alias("n_dup_lines"),
            repeated_words(held).alias("n_repeat_words"),
        ),
    )


def _percent(part: Column, whole: Column, most: int) -> Column:
    return F.lit(100) * part > F.lit(most) * whole


def _matched(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def base_rules(text: Column) -> list[Rule]:
    """The two rules that decide `base_failed`."""
    text = F.coalesce(text, F.lit(""))
    return [
        Rule("few_words", F.size(words(text)) < MIN_WORDS),
        Rule(
            "repeated_words",
            let(words(text), lambda held: _percent(repeated_words(held), F.size(held), MAX_REPEAT_PERCENT)),
        ),
    ]


def further_rules(text: Column) -> list[Rule]:
    """Rules of the cascade besides the base; clean prose stays far from their bounds."""
    text = F.coalesce(text, F.lit(""))
    return [
        Rule("symbols", _percent(symbols(text), F.length(text), MAX_SYMBOL_PERCENT)),
        Rule(
            "duplicate_lines",
            let(_lines(text), lambda lines: _percent(_repeats(lines), F.size(lines), MAX_DUP_LINE_PERCENT)),
        ),
        Rule("capitals", _percent(_matched(text, "[A-Z]+"), F.length(text), MAX_CAPITAL_PERCENT)),
        Rule("digits", _percent(_matched(text, "[0-9]+"), F.length(text), MAX_DIGIT_PERCENT)),
    ]


def estimate(
    docs: DataFrame, rules: list[Rule], text: str = "text", rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES
) -> list[Estimate]:
    """Seconds and share of rejected rows of each rule on a sample.

    The sample is the first `rows` rows with texts of up to `size` bytes: however large the
    input, only a few partitions are read for it. The best of several runs counts, less what
    a run takes without any rule.
    """
    taken = docs.select(text).where(F.octet_length(text) <= size).take(rows)
    sample = docs.sparkSession.createDataFrame(taken, docs.select(text).schema).coalesce(1)

    def run(rejects: Column) -> tuple[float, float]:
        begun = time.perf_counter()
        row = sample.agg(F.count_if(rejects).alias("n"), F.count("*").alias("all")).first()
        return time.perf_counter() - begun, row["n"] / max(row["all"], 1)

    idle = min(run(F.col(text).isNull())[0] for _ in range(SAMPLE_RUNS))
    found = []
    for rule in rules:
        runs = [run(rule.rejects) for _ in range(SAMPLE_RUNS)]
        found.append(Estimate(rule, max(min(r[0] for r in runs) - idle, 1e-3), runs[0][1]))
    return found


def cascade_order(estimates: list[Estimate]) -> list[Rule]:
    """Most rejections per second first; cheap before dear among rules that reject nothing."""
    return [e.rule for e in sorted(estimates, key=lambda e: (-e.worth, e.seconds, e.rule.name))]


def rejected_by(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects a text; NULL if none does."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.rejects, F.lit(rule.name)).otherwise(verdict)
    return verdict


def judged(docs: DataFrame, text: str = "text", into: str = "rejected_by") -> DataFrame:
    """Add the name of the rule that rejects a row, by the cascade over all rules."""
    column = F.col(text)
    rules = cascade_order(estimate(docs, base_rules(column) + further_rules(column), text))
    return docs.withColumn(into, rejected_by(rules))


def report(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, base statistics, base_failed and kept; one row per row of `docs`."""
    column = F.col(text)
    rules = cascade_order(estimate(docs, further_rules(column), text))
    counted = docs.select("doc_id", text, statistics(column).alias("__s"))
    failed = (F.col("n_words") < MIN_WORDS) | _percent(F.col("n_repeat_words"), F.col("n_words"), MAX_REPEAT_PERCENT)
    return counted.select("doc_id", text, "__s.*").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        F.when(failed, F.lit(False)).otherwise(rejected_by(rules).isNull()).alias("kept"),
    )


def good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that no rule rejects, with their columns."""
    column = F.col("text")
    rules = cascade_order(estimate(docs, base_rules(column) + further_rules(column)))
    return docs.where(rejected_by(rules).isNull())
