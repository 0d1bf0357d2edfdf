"""Fill-in-the-middle texts by rotations in place.

Two cuts make prefix, middle and suffix of a text. Its UTF-8 bytes are put into a bytearray
and scanned once for the places of the cuts; a sentinel is inserted before each part, and
the parts are exchanged where they lie: a rotation is three reversals, of the one block, of
the other and of both. The same rotation the other way round, and the sentinels taken out
again, give back the text, byte by byte.

    psm   <P>prefix<S>suffix<M>middle     middle and suffix exchanged
    spm   <S>suffix<P>prefix<M>middle     (prefix middle) and suffix exchanged
    plain the text as it is

A text that is empty or holds a sentinel stays plain, and so do a number of others that its
id draws. No part can make a sentinel together with its neighbour, so the sentinels are found
again. Form and cuts depend on the id and the number of code points alone, which Spark
computes; Python only moves bytes.

NULL texts are empty, that is plain. Rows with a NULL id draw as if the id had no digits.
Repeated rows are changed alike. A text of any length is held once, and changed in blocks. An
empty table gives no rows. Of the input only the id and the text are read, so other columns
may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cilode.llm.common import given_back, slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = [s.decode() for s in (PREFIX, SUFFIX, MIDDLE)]
SEED = 1
# Of 100 texts, those that stay plain; of 100 others, those with the suffix first.
PLAIN_PERCENT = 10
SUFFIX_FIRST_PERCENT = 20
# Bytes that are exchanged or scanned at a time.
BLOCK = 1 << 16


def reverse(buffer: bytearray, start: int, end: int) -> None:
    """buffer[start:end] backwards, in place."""
    while end - start > 1:
        n = min(BLOCK, (end - start) // 2)
        left = buffer[start : start + n]
        left.reverse()
        right = buffer[end - n : end]
        right.reverse()
        buffer[start : start + n], buffer[end - n : end] = right, left
        start, end = start + n, end - n


def rotate(buffer: bytearray, start: int, middle: int, end: int) -> None:
    """Exchange the neighbours buffer[start:middle] and buffer[middle:end], in place."""
    reverse(buffer, start, middle)
    reverse(buffer, middle, end)
    reverse(buffer, start, end)


def places(text: bytes, first: int, second: int) -> tuple[int, int]:
    """Bytes before the code points `first` <= `second` of a UTF-8 text, found in one scan."""
    if text.isascii():
        return first, second
    found, seen = [], 0
    for start in range(0, len(text), BLOCK):
        heads = np.flatnonzero(np.frombuffer(text[start : start + BLOCK], np.uint8) & 0xC0 != 0x80)
        while len(found) < 2 and (wanted := (first, second)[len(found)]) < seen + len(heads):
            found.append(start + int(heads[wanted - seen]))
        if len(found) == 2:
            break
        seen += len(heads)
    found += [len(text)] * (2 - len(found))
    return found[0], found[1]


def transform(text: bytes, form: str, first: int, second: int) -> bytes:
    """A text in one of the three forms, with its cuts in code points."""
    if form == "plain":
        return text
    a, b = places(text, first, second)
    buffer = bytearray(text)
    buffer[b:b] = SUFFIX
    buffer[a:a] = MIDDLE
    buffer[0:0] = PREFIX
    a += len(PREFIX)
    b += len(PREFIX) + len(MIDDLE)
    rotate(buffer, a if form == "psm" else 0, b, len(buffer))
    return bytes(buffer)


def restore(output: bytes, form: str) -> bytes:
    """The text that `transform` was given."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    if form == "psm":
        start, middle = buffer.find(SUFFIX), buffer.find(MIDDLE)
    else:
        start, middle = 0, buffer.find(PREFIX)
    rotate(buffer, start, middle, len(buffer))
    for sentinel in (SUFFIX, MIDDLE, PREFIX):
        at = buffer.find(sentinel)
        del buffer[at : at + len(sentinel)]
    return bytes(buffer)


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def _mapped(df: DataFrame, *changes: tuple) -> DataFrame:
    """Replace the bytes of columns, one change (name, function, inputs) after the other, by what the function makes
    of the inputs. All changes are one step, so the bytes between them stay in the worker."""

    def run(batches):
        for batch in slices(batches):
            for name, change, inputs in changes:
                made = [change(*row) for row in zip(*[_column(batch, i) for i in inputs])]
                batch = batch.set_column(batch.schema.get_field_index(name), name, pa.array(made, pa.binary()))
            yield batch
        given_back()

    return df.mapInArrow(run, df.schema)


def _draw(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits that follow from the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def planned(
    docs: DataFrame,
    seed: int = SEED,
    plain_percent: int = PLAIN_PERCENT,
    suffix_first_percent: int = SUFFIX_FIRST_PERCENT,
) -> DataFrame:
    """doc_id, n, form, first, second, output: form and cuts of every text, its bytes as the output yet."""
    text = F.coalesce(F.col("text"), F.lit(""))
    h1, h2, h3, h4 = _draw(F.col("doc_id"), seed)
    plain = (text == "") | (h3 % 100 >= 100 - plain_percent)
    for sentinel in SENTINELS:
        plain = plain | F.contains(text, F.lit(sentinel))
    n = F.length(text).cast("long")
    cuts = (h1 % (n + 1), h2 % (n + 1))
    return docs.select(
        "doc_id",
        n.alias("n"),
        F.when(plain, "plain").when(h4 % 100 < suffix_first_percent, "spm").otherwise("psm").alias("form"),
        F.least(*cuts).alias("first"),
        F.greatest(*cuts).alias("second"),
        text.cast("binary").alias("output"),
    )


TRANSFORM = ("output", transform, ["output", "form", "first", "second"])
RESTORE = ("restored", restore, ["output", "form"])


def _told(made: DataFrame, *columns: str) -> DataFrame:
    cut = F.col("form") != "plain"
    return made.select(
        "doc_id",
        "n",
        "form",
        F.when(cut, F.col("first")).alias("prefix_chars"),
        F.when(cut, F.col("second") - F.col("first")).alias("middle_chars"),
        *columns,
    )


def transformed(docs: DataFrame, **parameters: int) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output (UTF-8): one row per row of `docs`."""
    return _told(_mapped(planned(docs, **parameters), TRANSFORM), "output")


def _to_restore(made: DataFrame) -> DataFrame:
    return made.withColumn("restored", F.lit(None).cast("binary"))


def restored(made: DataFrame) -> DataFrame:
    """The rows with the texts rebuilt from output and form, as `restored` (UTF-8)."""
    return _mapped(_to_restore(made), RESTORE)


def there_and_back(docs: DataFrame, **parameters: int) -> DataFrame:
    """`restored(transformed(docs))` as one step: each text is sent to one worker, once."""
    return _told(_mapped(_to_restore(planned(docs, **parameters)), TRANSFORM, RESTORE), "output", "restored")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    return there_and_back(docs).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )
