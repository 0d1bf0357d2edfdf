"""Label sets of groups for rule tables of any size.

A struct of flags holds a fixed rule table. Here labels get dense numbers, and a set is a bitmap cut
into words of WORD_BITS labels, one row per group and word: its state in an aggregate is one
number, OR is its union, and it merges before the shuffle like any sum. A group with a third of
all hits is as many rows per task as its labels have words. Sets of files, projects or
whole corpora are united the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cilode.operators.labelling import match_rules
from cilode.operators.order import numbered

WORD_BITS = 32


def numbered_labels(rules: DataFrame) -> DataFrame:
    """(label, number): the distinct labels of a rule table, numbered from 0 in their order."""
    return numbered(rules.select("label").where("label is not null and keyword is not null").distinct(), ["label"])


def matched_numbers(docs: DataFrame, rules: DataFrame, labels: DataFrame, key: str, group: str, text: str = "text") -> DataFrame:
    """(group, number) of the rules that match, a row per text and label. Texts may share a key only within a group."""
    keyed = docs.select(F.struct(F.col(group).alias("group"), F.col(key).alias("key")).alias("__text"), text)
    # Few rows, before anything is matched.
    by_number = rules.join(labels, "label").select(F.col("number").alias("label"), "keyword")
    hits = match_rules(keyed, by_number, "__text", text)
    return hits.select(F.col("__text.group").alias(group), F.col("label").alias("number"))


def label_sets(hits: DataFrame, group: str) -> DataFrame:
    """(group, word, bits): the set of label numbers of each group."""
    word, bit = F.floor(F.col("number") / WORD_BITS), F.expr(f"shiftleft(1L, cast(number % {WORD_BITS} AS int))")
    return hits.groupBy(group, word.alias("word")).agg(F.bit_or(bit).alias("bits"))


def united(sets: DataFrame, group: str) -> DataFrame:
    """The union of sets over larger groups, which are in the column `group`."""
    return sets.groupBy(group, "word").agg(F.bit_or("bits").alias("bits"))


def set_sizes(sets: DataFrame, group: str) -> DataFrame:
    """(group, n_labels): the number of labels in each set."""
    return sets.groupBy(group).agg(F.sum(F.bit_count("bits")).alias("n_labels"))


def set_labels(sets: DataFrame, labels: DataFrame, group: str) -> DataFrame:
    """(group, label): the members of the sets."""
    inside = F.filter(F.sequence(F.lit(0), F.lit(WORD_BITS - 1)), lambda b: F.getbit("bits", b) == 1)
    members = sets.select(group, "word", F.explode(inside).alias("bit"))
    numbers = members.select(group, (F.col("word") * WORD_BITS + F.col("bit")).alias("number"))
    return numbers.join(labels, "number").select(group, "label")


def labels_listed(members: DataFrame, group: str) -> DataFrame:
    """(group, labels): the distinct labels of each group, sorted and joined by ', '. They are made distinct
    before they are shuffled, so a group's list is as long as its set, not as its hits."""
    distinct = members.select(group, F.col("label").cast("string").alias("label")).distinct()
    return distinct.groupBy(group).agg(F.expr("listagg(label, ', ') WITHIN GROUP (ORDER BY label)").alias("labels"))
