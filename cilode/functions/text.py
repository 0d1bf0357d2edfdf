"""Column functions on file paths and raw texts. All of them are built-in expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters at which Python's `splitlines` breaks a text, and the
# characters that `str.strip` removes and that do not break a line.
ENDS = r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
OTHER_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85" + chr(0x2028) + chr(0x2029)
LINE_BREAK = rf"\r\n|{ENDS}"
BLANK = r"[\t\x1f \xa0\u1680\u2000-\u200a\u202f\u205f\u3000]"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_config_file(path: Column) -> Column:
    """The two accepted suffixes, case-sensitive."""
    return path.endswith(".yml") | path.endswith(".yaml")


def project_by_prefix(path: Column) -> Column:
    """Base name up to the service marker; the owner stays part of the key."""
    name = F.substring_index(base_name(path), ".GitHub_Actions", 1)
    return F.substring_index(name, ".Travis_CI", 1)


def project_by_position(path: Column) -> Column:
    """Second dotted part of the base name if there are more than two parts, else the first."""
    parts = F.split(base_name(path), r"\.")
    return F.when(F.size(parts) > 2, parts[1]).otherwise(parts[0])


def decoded(content: Column) -> Column:
    """Strict UTF-8: NULL when the bytes are not valid."""
    return F.try_validate_utf8(content.cast("string"))


def normalised(text: Column) -> Column:
    """Universal newlines, then every tab becomes one space."""
    newlines = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.replace(newlines, F.lit("\t"), F.lit(" "))


def lines_of(text: Column) -> Column:
    """Split at every line break; most texts only have `\\n`, for which it costs little."""
    others = reduce(or_, [F.contains(text, F.lit(c)) for c in OTHER_ENDS])
    return F.when(others, F.split(text, LINE_BREAK)).otherwise(F.split(text, "\n"))


def without_comment_lines(text: Column) -> Column:
    """Drop the lines whose first non-blank character is `#`; join the others with `\\n`.

    A break at the very end of a text opens no further line.
    """
    kept = F.array_join(
        F.filter(
            lines_of(text),
            lambda line: ~(F.contains(line, F.lit("#")) & line.rlike(f"^{BLANK}*#")),
        ),
        "\n",
    )
    ends_with_break = F.right(text, F.lit(1)).rlike(LINE_BREAK)
    return F.when(ends_with_break, F.regexp_replace(kept, r"\n\z", "")).otherwise(kept)


def outside_comment_lines(text: Column, words: list[str]) -> Column:
    """Whether a line that is no comment holds one of the words; no word holds a line break.

    The texts are split at `\\n`, which costs little; the expression that knows all line
    breaks only sees the pieces that hold a word.
    """
    quoted = "|".join("".join(c if c.isalnum() else f"\\{c}" for c in word) for word in words)
    proper = f"(?:^|{ENDS})(?!{BLANK}*+#)[^{ENDS[1:-1]}]*?(?:{quoted})"

    def holds(line: Column) -> Column:
        return reduce(or_, [F.contains(line, F.lit(word)) for word in words]) & line.rlike(proper)

    return F.exists(F.split(text, "\n"), holds)
