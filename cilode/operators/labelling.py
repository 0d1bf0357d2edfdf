"""Attach rule labels to texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cilode.functions.rules import Rules, effective_keywords, label_hits
from cilode.functions.text import OTHER_ENDS, outside_comment_lines
from cilode.operators.stored import stored

# A rule list that becomes a constant of a query holds at most so many rules and letters.
MAX_CONSTANT_RULES = 1000
MAX_CONSTANT_LETTERS = 1 << 20

# Windows of keywords that are sent to all tasks, some 30 MB of them.
BROADCAST_WINDOWS = 200_000

# Length of the windows that keywords and texts are joined on.
ANCHOR = 12
# Kinds of windows: the pieces between spaces, which are found by a plain split, and windows at inner words; other
# kinds are window lengths.
PIECE, INNER = -2, -1
KINDS = [PIECE, INNER, *range(ANCHOR + 1)]
INNER_WORD = rf"(?s)(?<=[^\p{{L}}\p{{N}}])(?=([\p{{L}}\p{{N}}].{{{ANCHOR - 1}}}))"


def with_labels(
    df: DataFrame,
    rules: Rules,
    text: str = "text",
    strip_comments: bool = True,
    fold_keywords: bool = True,
    into: str = "labels",
) -> DataFrame:
    """Add a struct of one flag per label; a NULL text has no label.

    A fixed-width struct keeps the later union over files a plain hash aggregate. No
    keyword spans a line, so leaving comment lines out means that some line which is no
    comment holds a keyword; only labels whose keywords occur at all are looked at again.
    """
    if any(end in word for words in rules.values() for word in words for end in "\n" + OTHER_ENDS):
        raise ValueError("a keyword must not span lines")
    lowered = "__lowered"
    flags = {}
    for label, hit in label_hits(F.col(lowered), rules, fold_keywords).items():
        words = effective_keywords(rules[label], fold_keywords)
        if strip_comments and words not in ([], [""]):
            commented = F.contains(F.col(lowered), F.lit("#"))
            hit = hit & (~commented | outside_comment_lines(F.col(lowered), words))
        flags[label] = F.coalesce(hit, F.lit(False))
    out = df.withColumn(lowered, F.lower(F.col(text)))
    keep = [F.col(f"`{c}`") for c in df.columns]
    return out.select(*keep, F.struct(*[flag.alias(label) for label, flag in flags.items()]).alias(into))


def rule_list(rules: DataFrame) -> list[tuple]:
    """The rows (label, keyword) of a rule table that is known to be short, NULLs left out.

    A longer one is refused, not cut: it is a case for `match_rules`.
    """
    sound = rules.select("label", "keyword").where("label is not null and keyword is not null")
    held = [tuple(row) for row in sound.limit(MAX_CONSTANT_RULES + 1).collect()]
    if len(held) > MAX_CONSTANT_RULES or sum(len(word) for _, word in held) > MAX_CONSTANT_LETTERS:
        raise ValueError("too many rules for a constant; use match_rules")
    return held


def match_rules_constant(
    docs: DataFrame, rules: list[tuple], key: str, text: str = "text", label_type="string"
) -> DataFrame:
    """`match_rules` for a short list of (label, keyword): no row moves before the result."""
    words: dict[object, set[str]] = {}
    for label, word in rules:
        words.setdefault(label, set()).add(word)
    if not words:
        return docs.select(key, F.lit(None).cast(label_type).alias("label")).where("false")
    table = F.array(
        *[
            F.struct(F.lit(label).cast(label_type).alias("label"), F.array(*map(F.lit, sorted(held))).alias("keywords"))
            for label, held in words.items()
        ]
    )
    held = F.filter(table, lambda r: F.exists(r["keywords"], lambda w: F.contains(F.col(text), w)))
    return docs.select(key, F.explode(F.transform(held, lambda r: r["label"])).alias("label")).distinct()


def _kind_bit(kind: int) -> int:
    return 1 << kind - PIECE


def _windows(text: str, kinds, within: bool = False) -> Column:
    """Distinct pieces between spaces (kind PIECE), substrings of ANCHOR characters that open an inner word (kind INNER),
    and all substrings of the other kinds, which are lengths.

    `kinds` tells of each kind whether it is wanted; a text is only cut in those ways. `within` a text
    are the pieces with a space on both sides, which are whole wherever the text stands."""
    none = F.array().cast("array<string>")

    def cut(n: int) -> Column:
        if n == 0:
            return F.array(F.lit(""))
        if n == PIECE:
            pieces = F.split(F.col(text), " ")
            return F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 2, F.lit(0))) if within else pieces
        pattern = INNER_WORD if n == INNER else f"(?s)(?=(.{{{n}}}))"
        return F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))

    return F.array_distinct(F.concat(*[F.when(kinds(n), cut(n)).otherwise(none) for n in KINDS]))


def _around_anchors(docs: DataFrame, anchors: DataFrame, key: str, text: str) -> DataFrame:
    """(key, keyword) of the keywords that stand around their anchor in a text, all of them kept that do so twice.

    Anchors are pieces between spaces. The pieces beside one are compared first, then all of the keyword's
    inner ones, of its first piece the end and of its last one the start."""
    pieces, place, pos = F.split("keyword", " "), F.col("place"), F.col("pos")
    inner = F.slice(pieces, F.lit(2), F.size(pieces) - 2)
    known = anchors.select("keyword", "window", pieces.alias("of_keyword"), inner.alias("inner")).select(
        "*", F.array_position("inner", F.col("window")).cast("int").alias("place")
    )
    known = known.select(
        "*",
        F.get("inner", place - 2).alias("before"),
        F.get("inner", place).alias("after"),
        F.get("of_keyword", F.lit(0)).alias("opening"),
        F.get("of_keyword", F.size("of_keyword") - 1).alias("closing"),
        F.size("inner").alias("n"),
    ).drop("of_keyword")
    cut = docs.select(key, F.split(F.col(text), " ").alias("pieces"))
    met = cut.select(key, "pieces", F.posexplode("pieces").alias("pos", "window")).join(F.broadcast(known), "window")
    first = pos - place
    beside = (F.col("before").isNull() | (F.get("pieces", pos - 1) == F.col("before"))) & (
        F.col("after").isNull() | (F.get("pieces", pos + 1) == F.col("after"))
    )
    stands = F.when(
        (first >= 0) & beside,
        (F.slice("pieces", F.greatest(first + 2, F.lit(1)), F.col("n")) == F.col("inner"))
        & F.endswith(F.get("pieces", first), F.col("opening"))
        & F.startswith(F.get("pieces", first + F.col("n") + 1), F.col("closing")),
    )
    return met.where(stands).select(key, "keyword")


def match_rules(
    docs: DataFrame, rules: DataFrame, key: str, text: str = "text", broadcast_windows: int = BROADCAST_WINDOWS
) -> DataFrame:
    """Distinct (key, label) pairs where a text of the key contains a keyword of the label.

    `rules` is a table (label, keyword) of any size; rows with a NULL are left out. Keys may
    repeat and may be NULL.

    A text that contains a keyword also contains every window of the keyword. Windows
    are the pieces that stand between two spaces in the keyword, so they do in the text as well.
    Those of a keyword with less than two such pieces start at the words inside it: they have a character before
    them in the keyword, so they start at a word in the text as well. A keyword without such a word
    is cut at every character, and one shorter than a window is its own window. Each keyword is
    anchored at that of its windows which the fewest texts hold, so common wording costs
    nothing.

    The windows of the keywords are stored first, so their number is known. Up to
    `broadcast_windows` of them are sent around: one pass over the texts counts which texts
    hold them, another one meets the anchors and looks for the keyword in the row of the
    text, for pieces just around the anchor, and no text moves. Of more windows, the texts' own are filtered by a join before
    they are counted, and texts with an anchor are fetched by their key. Both give the same rows.
    """
    rules = rules.select("label", "keyword").where("label is not null and keyword is not null").distinct()
    inner = F.size(F.regexp_extract_all("keyword", F.lit(INNER_WORD), F.lit(1))) > 0
    length = F.least(F.length("keyword"), F.lit(ANCHOR))
    kind = F.when(F.size(F.split("keyword", " ")) > 3, PIECE).when(inner, INNER).otherwise(length)
    sized = rules.select("keyword").distinct().withColumn("kind", kind)
    cut_keywords = _windows("keyword", lambda n: F.col("kind") == n, within=True)
    keyword_windows = stored(sized.select("keyword", "kind", F.explode(cut_keywords).alias("window")), "windows")
    known = keyword_windows.agg(F.count("*").alias("n"), F.bit_or(F.expr(f"shiftleft(1, kind - ({PIECE}))")).alias("kinds")).first()
    # A session that forbids broadcasts has none.
    allowed = not docs.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").startswith("-")
    small = allowed and known.n <= broadcast_windows

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    # The kinds of windows to cut texts into, a bit for each of KINDS.
    cut = _windows(text, lambda n: F.lit(bool((known.kinds or 0) & _kind_bit(n))))
    windows = sent(keyword_windows.select("window").distinct())
    held = docs.select(key, cut.alias("cut")).select(key, F.explode("cut").alias("window"))
    held = held.join(windows, "window", "left_semi")
    if not small:
        held = stored(held, "held")
    spread = held.groupBy("window").agg(F.count("*").alias("texts"))
    anchors = (
        keyword_windows.select("keyword", "window")
        .join(spread, "window")
        .groupBy("keyword")
        .agg(F.min_by("window", F.struct("texts", "window")).alias("window"))
    )
    if small:
        # A plan of its own for the counts, so that the second pass starts when they are known.
        anchors = stored(anchors.join(sized, "keyword"), "anchors")
        ways = []
        if (known.kinds or 0) & _kind_bit(PIECE):
            ways.append(_around_anchors(docs, anchors.where(F.col("kind") == PIECE), key, text))
        if not ways or known.kinds != _kind_bit(PIECE):
            others = _windows(text, lambda n: F.lit(n != PIECE and bool((known.kinds or 0) & _kind_bit(n))))
            opened = docs.select(key, text, others.alias("cut")).select(key, text, F.explode("cut").alias("window"))
            met = opened.join(F.broadcast(anchors.where(F.col("kind") != PIECE).select("keyword", "window")), "window")
            ways.append(met.where(F.contains(F.col(text), F.col("keyword"))).select(key, "keyword"))
        hits = reduce(DataFrame.unionAll, ways).distinct()
        return hits.join(rules, "keyword").select(key, "label").distinct()
    found = held.join(anchors, "window").select(F.col(key).alias("__key"), "keyword").distinct()
    texts = docs.select(key, text).join(found, F.col(key).eqNullSafe(F.col("__key")))
    hits = texts.where(F.contains(F.col(text), F.col("keyword"))).select(key, "keyword").distinct()
    return hits.join(rules, "keyword").select(key, "label").distinct()
