"""Scoring texts with a hierarchical Pitman-Yor model, trained on the texts of a fold.

Tokens are seated in restaurants, one for every preceding word. All of them share a parent, the
restaurant of single words, whose customers are their tables; its base is uniform over the
vocabulary and one unknown token. Given the others, the number of tables at which the
customers of a pair of words sit has a distribution that generalised Stirling numbers,
the other tables of the restaurant and the word's probability in the parent make up; a Gibbs
step draws it anew from there. Numbers of tables are carried from turn to turn. Scores use
predictive probabilities averaged over the last turns.

All words and all pairs of words of all training texts count, whatever their number. Texts are
turned into chunks with lists of their distinct pairs, cut into cells of a grid: by the hash
of the word and by that of the preceding one. So neither a frequent word nor a frequent
context is in one task as a whole. A cell's pairs are merged once and written bucketed by
cell, together with the places that each chunk's pairs have among them; they do not move
again. In a turn a cell seats its pairs, and sends the tables of its words and contexts to
buckets, of which there are as many as cells; buckets add them up, seat the words in the
parent, and answer. Only these sums travel, and tables that a turn replaces are removed.
Nothing but a few totals reaches the driver.

Pairs are seated in parallel: the sums they look at are those of the turn before, without
their own tables. Numbers up to EXACT customers have exact Stirling numbers; beyond, the
distribution of the number of tables scales with a power of the customers. A draw looks at
up to WINDOW numbers of tables around the present one, at a random place.

NULL and empty texts are one end token. A NULL id counts as an empty text for the fold.
Repeated rows are trained and scored as often as they occur. A text of any length is in one
chunk, as numbers of its words. Words are told apart by 64 bits of their hash. An empty
table gives no rows; without training texts all words are unknown. Only the id and the text are
read, so other columns may have any name.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cilode.llm.common import LARGE_ROWS, given_back, per_worker, removed, shared_folder, slices, small_batches, stored_at

FOLDS, HELD_OUT = 7, 2
CHUNK_BYTES = 6 << 20
# Bytes of text whose pairs are one cell, on average.
CELL_BYTES = 3 << 20
# Turns before the first sample.
PASSES = 2
SAMPLES = 4
# Strength of a restaurant; discounts are estimated from the counts.
STRENGTH = 1.0
EXACT, WINDOW = 1024, 64
# Pairs that are drawn at a time.
_ROWS = 1 << 10
# Bytes of payload that are one Arrow batch, from a row on: a buffer is held whole outside the heap.
_BATCH_BYTES = 1 << 20
# The token that ends a text; no word has a blank.
END = b" "

# Sides of the grid, and a cell's own numbers of tables.
WORD, CONTEXT, TABLES = 0, 1, 2
# A bucket's own row, among those for cells.
OWN = -1

ROW = "cell int, chunk long, ids array<long>, sizes array<int>, payload binary"
_TYPES = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
_NAMES = ["cell", "chunk", "ids", "sizes", "payload"]


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_OUT


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes; `unpacked` needs their types. First bytes of all numbers stand together, then
    all second ones, and so on: most of the later ones are alike."""
    head = struct.pack(f"<{len(arrays)}q", *map(len, arrays))
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def unpacked(data: bytes, *types) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes = struct.unpack_from(f"<{len(types)}q", raw)
    out, at = [], 8 * len(types)
    for size, kind in zip(sizes, types):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += size * width
    return out


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = number = len(self)
        return number


class Chunk:
    """Some texts as numbers of their words."""

    def __init__(self):
        self.numbers = _Numbers()
        self.ids, self.tokens, self.sizes, self.bytes = [], [], [], 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        words = text.lower().split()
        words.append(END)
        self.tokens.append(np.fromiter(map(self.numbers.__getitem__, words), np.uint32, len(words)))
        self.ids.append(doc_id)
        self.sizes.append(len(words))
        self.bytes += len(text)

    def finish(self):
        """Word hashes in order, and the tokens as places in that order."""
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.numbers), np.uint64, len(self.numbers))
        order = np.argsort(hashes)
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        return hashes[order], place[np.concatenate(self.tokens)]


def pair_numbers(tokens: np.ndarray, sizes: np.ndarray, words: int) -> np.ndarray:
    """place * (words + 1) + context of every token: 0 at the start of a text, or 1 + place of the word before."""
    contexts = np.zeros(len(tokens), np.int64)
    contexts[1:] = tokens[:-1].astype(np.int64) + 1
    contexts[np.cumsum(sizes)[:-1]] = 0
    return tokens.astype(np.int64) * (words + 1) + contexts


def _top(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _batch(rows: list[tuple], types, names) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)


def _batches(rows, types, names):
    """Rows, whose last value is their payload, as batches of bounded bytes; at least one."""
    some, held = [], 0
    for row in rows:
        if some and held + len(row[-1]) > _BATCH_BYTES:
            yield _batch(some, types, names)
            some, held = [], 0
        some.append(row)
        held += len(row[-1])
    yield _batch(some, types, names)


def _table(rows: list[tuple], types, names) -> pa.Table:
    return pa.Table.from_batches(list(_batches(rows, types, names)))


def _chunks(bits: int, chunk_bytes: int):
    """For each chunk one row with its tokens as places of their pairs (a negative cell), and one per
    cell with its pairs: hashes of words, number of contexts, keys of contexts, contexts, and
    training counts."""

    def rows(chunk: Chunk, number: int):
        hashes, tokens = chunk.finish()
        sizes, keys = np.array(chunk.sizes), np.concatenate(([np.uint64(0)], hashes))
        pairs, which = np.unique(pair_numbers(tokens, sizes, len(hashes)), return_inverse=True)
        trained = np.repeat([not held_out(i) for i in chunk.ids], sizes)
        counts = np.bincount(which, weights=trained, minlength=len(pairs)).astype(np.uint32)
        words, contexts = pairs // len(keys), pairs % len(keys)
        cells = _top(hashes, bits - bits // 2)[words] << bits // 2 | _top(keys, bits // 2)[contexts]
        order = np.argsort(cells, kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        yield -1 - (number & (1 << bits) - 1), number, chunk.ids, chunk.sizes, packed(place[which])
        words, contexts, counts, cells = words[order], contexts[order], counts[order], cells[order]
        found, starts = np.unique(cells, return_index=True)
        for cell, a, b in zip(found.tolist(), starts, [*starts[1:], len(cells)]):
            mine, held = np.unique(words[a:b], return_counts=True)
            before, at = np.unique(contexts[a:b], return_inverse=True)
            yield cell, number, None, None, packed(
                hashes[mine], held.astype(np.uint32), keys[before], at.astype(np.uint32), counts[a:b]
            )

    def run(batches):
        number, chunk = TaskContext.get().partitionId() << 24, Chunk()
        for texts in slices(batches):
            for doc_id, text in zip(texts.column(0).to_pylist(), texts.column(1).cast(pa.binary()).to_pylist()):
                if chunk.ids and chunk.bytes + len(text or b"") > chunk_bytes:
                    yield from _batches(rows(chunk, number), _TYPES, _NAMES)
                    number, chunk = number + 1, Chunk()
                    given_back()
                chunk.add(doc_id, text or b"")
        if chunk.ids:
            yield from _batches(rows(chunk, number), _TYPES, _NAMES)
        given_back()

    return run


PAIRS = (np.uint64, np.uint32, np.uint64, np.uint32, np.uint32)


def _merged(rows: pa.Table) -> pa.Table:
    """A cell's pairs over all chunks, with their training counts; and for each chunk the places of its
    pairs among them, as steps from one to the next. Rows of tokens stay as they are."""
    cell = rows.column("cell")[0].as_py()
    if cell < 0:
        return rows
    parts = [unpacked(p, *PAIRS) for p in rows.column("payload").to_pylist()]
    words, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    contexts, places = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
    at = np.repeat(which, np.concatenate([p[1] for p in parts]))
    starts = np.cumsum([0] + [len(p[2]) for p in parts])
    before = places[np.concatenate([p[3] + start for p, start in zip(parts, starts)])]
    pairs, places = np.unique(at * len(contexts) + before, return_inverse=True)
    counts = np.bincount(places, weights=np.concatenate([p[4] for p in parts]), minlength=len(pairs)).astype(np.uint32)
    held = np.bincount(pairs // len(contexts), minlength=len(words)).astype(np.uint32)
    payload = packed(words, held, contexts, (pairs % len(contexts)).astype(np.uint32), counts)
    out = [(cell, None, None, None, payload)]
    ends = np.cumsum([len(p[3]) for p in parts])
    for chunk, part, end in zip(rows.column("chunk").to_pylist(), parts, ends):
        asked = places[end - len(part[3]) : end]
        out.append((cell, chunk, None, None, packed(np.diff(asked, prepend=0).astype(np.uint32))))
    del parts, at, before, places, pairs
    given_back()
    return _table(out, _TYPES, _NAMES)


class Cell:
    """The pairs of a cell: places of their words and contexts, and training counts."""

    def __init__(self, payload: bytes, bits: int):
        self.words, held, self.contexts, self.before, counts = unpacked(payload, *PAIRS)
        self.at, self.counts = np.repeat(np.arange(len(held)), held), counts.astype(np.int64)
        self.bits = bits

    def sums(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By word and by context."""
        return (
            np.bincount(self.at, weights=values, minlength=len(self.words)).astype(np.int64),
            np.bincount(self.before, weights=values, minlength=len(self.contexts)).astype(np.int64),
        )

    def messages(self, number: int, of_words: tuple, of_contexts: tuple) -> list[tuple]:
        """Arrays along the words and contexts, cut into rows for the buckets of their hashes."""
        out = []
        for side, keys, arrays in ((WORD, self.words, of_words), (CONTEXT, self.contexts, of_contexts)):
            found, starts = np.unique(_top(keys, self.bits), return_index=True)
            for bucket, a, b in zip(found.tolist(), starts, [*starts[1:], len(keys)]):
                out.append((side, bucket, number, packed(*[x[a:b] for x in arrays])))
        return out


class Totals:
    """Customers and tables of the parent; words, tokens, and the discounts of parent and contexts (leaf)."""

    def __init__(self):
        self.customers = self.tables = 0.0
        self.discount = self.leaf_discount = 0.5
        self.tokens = self.words = 0.0
        # Words and pairs with one and with two customers.
        self.once = self.twice = self.leaf_once = self.leaf_twice = 0.0

    def base(self) -> float:
        return 1.0 / (self.words + 1)

    def fresh(self) -> float:
        """Weight of a new table in the parent."""
        return (STRENGTH + self.discount * self.tables) * self.base()

    def parent(self, customers, tables):
        """Probability of a word in the parent, with its customers and tables there."""
        return (np.maximum(customers - self.discount * tables, 0.0) + self.fresh()) / (STRENGTH + self.customers)


class Stirling:
    """Logarithms of generalised Stirling numbers, up to a factor for each number of customers."""

    def __init__(self, discount: float):
        self.discount = discount
        table = np.full((EXACT + 1, EXACT + 2), -np.inf)
        table[1, 1] = 0.0
        tables = np.arange(EXACT + 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            for c in range(1, EXACT):
                stay = table[c] + np.log(np.maximum(c - discount * tables, 0.0))
                table[c + 1, 1:] = np.logaddexp(stay[1:], table[c, :-1])
        self.table = table
        # Probabilities of the numbers of tables after EXACT customers, at strength 0.
        steps = np.log(discount * np.arange(1, EXACT))
        self.law = table[EXACT, 1 : EXACT + 1] + np.concatenate(([0.0], np.cumsum(steps))) - math.lgamma(EXACT)

    def rows(self, counts: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """For customers (rows) and tables (rows, columns); impossible numbers are -inf."""
        if counts.max() <= EXACT:
            return self.table[counts[:, None], np.clip(tables, 0, EXACT + 1)]
        large = counts[:, None].astype(np.float64)
        scale = (EXACT / large) ** self.discount
        at = tables * scale
        few = -math.lgamma(1 - self.discount) - self.discount * np.log(large)  # of the first numbers
        law = np.where(at < 1, few, np.interp(at, np.arange(1, EXACT + 1), self.law) + np.log(scale))
        steps = np.cumsum(np.log(self.discount * np.maximum(tables - 1, 1)), axis=1)
        return np.where((tables < 1) | (tables > large) | (at > EXACT), -np.inf, law - steps)


def stirling_numbers(discount: float) -> Stirling:
    """Made once per worker and discount."""
    return per_worker(("stirling", discount), lambda: Stirling(discount))


def draw(
    counts: np.ndarray,
    tables: np.ndarray,
    others: np.ndarray,
    first: np.ndarray,
    later: np.ndarray,
    slope: float,
    strength: float,
    stirling: Stirling,
    random: np.random.Generator,
) -> np.ndarray:
    """New numbers of tables for customers of one dish, each from its distribution given the rest.

    `others` are the tables of other dishes in the restaurant. The parent serves the dish at the first
    of the tables with a probability in proportion to `first`, at the k-th after it to `later + slope * k`.
    """
    out = np.minimum(counts, 1).astype(np.int64)
    widths = np.where(counts <= WINDOW, 1 << np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64), WINDOW)
    # Beyond the exact numbers another formula holds.
    kinds = np.where(counts > EXACT, 2 * WINDOW, widths)
    for kind in np.unique(kinds[counts > 1]):
        width = min(int(kind), WINDOW)
        chosen = np.flatnonzero((kinds == kind) & (counts > 1))
        for at in range(0, len(chosen), _ROWS):
            some = chosen[at : at + _ROWS]
            held, now = counts[some], tables[some]
            # A window that holds the present number, at a random place, whatever the number.
            low = np.where(held <= width, 1, now - random.integers(0, width, len(some)))
            t = low[:, None] + np.arange(width)
            k = np.maximum(t - 1, 0)
            parent = np.where(k == 0, first[some, None], later[some, None] + slope * k)
            opened = strength + stirling.discount * (others[some, None] + k)
            steps = np.cumsum(np.where(t < 1, 0.0, np.log(opened * parent)), axis=1)
            weights = stirling.rows(held, t) + steps
            weights = np.exp(weights - weights.max(axis=1, keepdims=True))
            ends = np.cumsum(weights, axis=1)
            drawn = (ends < random.random(len(some))[:, None] * ends[:, -1:]).sum(axis=1)
            out[some] = low + np.minimum(drawn, width - 1)
    return out


def seat_pairs(cell: Cell, tables, of_word, of_context, totals: Totals, stirling: Stirling, random) -> np.ndarray:
    """New tables of a cell's pairs, given customers and tables of the words in the parent and the tables
    of the restaurants, from which a pair's own are taken first."""
    customers, parent_tables = of_word
    away = np.maximum(customers[cell.at] - tables, 0)
    at_tables = np.minimum(parent_tables[cell.at], away)
    fresh, whole = totals.fresh(), STRENGTH + totals.customers
    known = away > 0
    left = np.where(known, away - totals.discount * at_tables, -totals.discount) + fresh
    first = np.where(known, left, fresh) / whole
    others = np.maximum(of_context[cell.before] - tables, 0)
    return draw(cell.counts, tables, others, first, left / whole, 1.0 / whole, STRENGTH, stirling, random)


# Between cells, words and restaurants: rows of a side's bucket and a cell, or of one of them alone (OWN).
MESSAGE = "side int, bucket int, cell int, payload binary"
_MESSAGE_TYPES, _MESSAGE_NAMES = [pa.int32()] * 3 + [pa.binary()], ["side", "bucket", "cell", "payload"]
# Of the words of a bucket: training counts, customers and tables in the parent; cells, number and places of their words.
STATE = (np.int64, np.int64, np.int64, np.int32, np.int64, np.uint32)
# Of the restaurants of a bucket: customers; cells, number and places of their contexts.
PLACES = (np.int64, np.int32, np.int64, np.uint32)
REPLY = {WORD: (np.int64, np.int64, np.int64), CONTEXT: (np.int64, np.int64), TABLES: (np.uint32,)}


def _messages(rows: list[tuple]) -> pa.Table:
    return _table(rows, _MESSAGE_TYPES, _MESSAGE_NAMES)


def _asked(bits: int):
    """What a cell has of its words and restaurants, with every pair at one table."""

    def run(batches):
        for batch in batches:
            for number, payload in zip(batch.column("cell").to_pylist(), batch.column("payload").to_pylist()):
                cell = Cell(payload, bits)
                tables = np.minimum(cell.counts, 1)
                tokens, customers = cell.sums(cell.counts)
                by_word, by_context = cell.sums(tables)
                rows = cell.messages(number, (cell.words, tokens, by_word), (cell.contexts, customers, by_context))
                yield from _messages([*rows, (TABLES, OWN, number, packed(tables.astype(np.uint32)))]).to_batches()
                del cell, tables, tokens, customers, by_word, by_context, rows
        given_back()

    return run


def _layout(rows: pa.Table):
    """Of a bucket's first messages: distinct keys, their summed values, tables, cells, sizes and places."""
    rows = rows.sort_by("cell")
    cells = np.array(rows.column("cell").to_pylist(), np.int32)
    parts = [unpacked(p, np.uint64, np.int64, np.int64) for p in rows.column("payload").to_pylist()]
    sizes = np.array([len(p[0]) for p in parts], np.int64)
    keys, values, tables = (np.concatenate([p[k] for p in parts]) for k in range(3))
    found, places = np.unique(keys, return_inverse=True)
    values = np.bincount(places, weights=values, minlength=len(found)).astype(np.int64)
    return values, tables, cells, sizes, places.astype(np.uint32)


def _first_sums(rows: pa.Table) -> pa.Table:
    """The sums of a bucket's words, or of its restaurants, over the cells; a word is at one table in the parent."""
    side, bucket = rows.column("side")[0].as_py(), rows.column("bucket")[0].as_py()
    values, tables, *layout = _layout(rows)
    own = packed(values, *layout)
    if side == WORD:
        customers = np.bincount(layout[-1], weights=tables, minlength=len(values)).astype(np.int64)
        own = packed(values, customers, np.minimum(customers, 1), *layout)
    given_back()
    return _messages([(side, bucket, OWN, own), *_replies(side, bucket, own, tables)])


def _replies(side: int, bucket: int, own: bytes, tables: np.ndarray) -> list[tuple]:
    """To each cell the sums of its words (tables over all contexts, tables in the parent, training counts) or
    restaurants (tables, customers)."""
    if side == WORD:
        counts, _, parent_tables, cells, sizes, places = unpacked(own, *STATE)
        known = (parent_tables, counts)
    else:
        customers, cells, sizes, places = unpacked(own, *PLACES)
        known = (customers,)
    summed = np.bincount(places, weights=tables, minlength=len(known[0])).astype(np.int64)
    ends = np.cumsum(sizes)
    return [
        (side, bucket, cell, packed(*[x[places[a:b]] for x in (summed, *known)]))
        for cell, a, b in zip(cells.tolist(), ends - sizes, ends)
    ]


def _sums(totals: Totals, turn: int):
    """The sums of the cells' new tables; words are then seated anew in the parent."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("cell")
        side, bucket = rows.column("side")[0].as_py(), rows.column("bucket")[0].as_py()
        own, *payloads = rows.column("payload").to_pylist()
        new = np.concatenate([unpacked(p, np.int64)[0] for p in payloads])
        if side == WORD:
            counts, _, parent_tables, *layout = unpacked(own, *STATE)
            customers = np.bincount(layout[-1], weights=new, minlength=len(counts)).astype(np.int64)
            base = np.full(len(counts), totals.base())
            now = np.clip(parent_tables, np.minimum(customers, 1), customers)
            others = np.maximum(totals.tables - now, 0)
            random, stirling = np.random.default_rng([turn, bucket, 1]), stirling_numbers(totals.discount)
            parent_tables = draw(customers, now, others, base, base, 0.0, STRENGTH, stirling, random)
            own = packed(counts, customers, parent_tables, *layout)
        given_back()
        return _messages([(side, bucket, OWN, own), *_replies(side, bucket, own, new)])

    return run


STATS = "name string, value double"


def _stats(values: dict[str, float]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(values)), pa.array([float(v) for v in values.values()], pa.float64())], names=["name", "value"]
    )


def _pair_stats(batches):
    """Pairs with one and two customers."""
    for batch in batches:
        for payload in batch.column("payload").to_pylist():
            counts = unpacked(payload, *PAIRS)[4]
            yield _stats({"leaf_once": (counts == 1).sum(), "leaf_twice": (counts == 2).sum()})


def _word_stats(batches):
    """Words and tokens; customers and tables of the parent, and its words with one and two customers."""
    for batch in batches:
        for own in batch.column("payload").to_pylist():
            counts, customers, tables, *_ = unpacked(own, *STATE)
            yield _stats(
                {
                    "words": (counts > 0).sum(),
                    "tokens": counts.sum(),
                    "customers": customers.sum(),
                    "tables": tables.sum(),
                    "once": (customers == 1).sum(),
                    "twice": (customers == 2).sum(),
                }
            )


def _update(totals: Totals, stats: DataFrame) -> Totals:
    """The totals brought up to date; `stats` has a few rows per task."""
    new = Totals()
    vars(new).update(vars(totals))
    for row in stats.groupBy("name").agg(F.sum("value").alias("value")).collect():
        setattr(new, row["name"], row["value"])
    return new


def _discount(once: float, twice: float) -> float:
    return min(max(once / (once + 2 * twice), 0.05), 0.95) if once else 0.5


def _replied(rows: pa.Table) -> dict:
    """Arrays for a cell by turn and side, the buckets' parts one after the other."""
    out: dict = {}
    rows = rows.sort_by("bucket")
    for turn, side, payload in zip(*[rows.column(name).to_pylist() for name in ("turn", "side", "payload")]):
        out.setdefault((turn, side), []).append(unpacked(payload, *REPLY[side]))
    return {key: [np.concatenate(column) for column in zip(*parts)] for key, parts in out.items()}


def _seated(totals: Totals, turn: int, bits: int):
    """A turn of a cell: new tables, summed by word and by context."""

    def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
        number = rows.column("cell")[0].as_py()
        cell, held = Cell(rows.column("payload")[0].as_py(), bits), _replied(replies)
        random = np.random.default_rng([turn, number])
        tables = held[turn - 1, TABLES][0].astype(np.int64)
        customers, parent_tables, _ = held[turn - 1, WORD]
        of_context = held[turn - 1, CONTEXT][0]
        tables = seat_pairs(
            cell, tables, (customers, parent_tables), of_context, totals, stirling_numbers(totals.leaf_discount), random
        )
        by_word, by_context = cell.sums(tables)
        out = [*cell.messages(number, (by_word,), (by_context,)), (TABLES, OWN, number, packed(tables.astype(np.uint32)))]
        del cell, held, tables, customers, parent_tables, of_context
        given_back()
        return _messages(out)

    return run


def predicted(counts, tables, of_context, shared, totals: Totals):
    """Probabilities of words after contexts, from counts and tables of their pairs, tables and customers of
    the contexts' restaurants, and probabilities of the words in the parent."""
    all_tables, customers = of_context
    left = np.maximum(counts - totals.leaf_discount * tables, 0.0)
    return (left + (STRENGTH + totals.leaf_discount * all_tables) * shared) / (STRENGTH + customers)


ANSWER = (np.float32, np.int64)


def _answers(samples: dict[int, Totals], bits: int):
    """For each chunk of a cell: logarithms of its pairs' mean probabilities, counts of their words."""

    def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
        chunks, payloads = rows.column("chunk").to_pylist(), rows.column("payload").to_pylist()
        own = chunks.index(None)
        number, cell, held = rows.column("cell")[0].as_py(), Cell(payloads[own], bits), _replied(replies)
        chance = np.zeros(len(cell.counts))
        for turn, totals in samples.items():
            customers, parent_tables, counts = held[turn, WORD]
            shared = totals.parent(customers, parent_tables)[cell.at]
            of_context = [x[cell.before] for x in held[turn, CONTEXT]]
            chance += predicted(cell.counts, held[turn, TABLES][0], of_context, shared, totals) / len(samples)
        logs, counts = np.log10(chance).astype(np.float32), counts[cell.at]
        out = []
        for chunk, payload in zip(chunks, payloads):
            if chunk is not None:
                places = np.cumsum(unpacked(payload, np.uint32)[0], dtype=np.int64)
                out.append((number, chunk, None, None, packed(logs[places], counts[places])))
        del cell, held, chance, logs, counts
        given_back()
        return _table(out, _TYPES, _NAMES)

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(totals: Totals):
    """Scores of a chunk's texts, from its tokens (a negative cell) and its answers in order of cells."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("cell")
        payloads = rows.column("payload").to_pylist()
        ids, sizes = rows.column("ids")[0].as_py(), np.array(rows.column("sizes")[0].as_py())
        [tokens] = unpacked(payloads[0], np.uint32)
        answers = [unpacked(payload, *ANSWER) for payload in payloads[1:]]
        model, counts = (np.concatenate([a[k] for a in answers]) for k in range(2))
        base = np.log10((counts.astype(np.float64) + 1) / (totals.tokens + totals.words + 1))
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        del payloads, answers
        given_back()
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "held_out": pa.array([held_out(i) for i in ids], pa.bool_()),
                "n_tokens": pa.array(sizes, pa.int64()),
                "n_known": pa.array(np.add.reduceat((counts > 0).astype(np.int64)[tokens], starts)),
                "train_tokens": pa.array(np.full(len(ids), int(totals.tokens))),
                "base_score": pa.array(np.add.reduceat(base[tokens], starts)),
                "score": pa.array(np.add.reduceat(model.astype(np.float64)[tokens], starts)),
            }
        )

    return run


def _bucketed(df: DataFrame, name: str) -> tuple[str, str]:
    """Write rows bucketed by cell as a table of the session. Gives the table's name and its path."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{table}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.options(**LARGE_ROWS).bucketBy(buckets, "cell").option("path", path).saveAsTable(table)
    return table, path


def scored(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; a row per row of `docs`.

    Texts whose fold is not the held-out one train the model.
    """
    with small_batches(docs.sparkSession):
        return _scored(docs, chunk_bytes, cell_bytes)


def _scored(docs: DataFrame, chunk_bytes: int, cell_bytes: int) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = max(2, (size // cell_bytes).bit_length())
    grouped = texts.mapInArrow(_chunks(bits, chunk_bytes), ROW).groupBy("cell").applyInArrow(_merged, ROW)
    table, table_path = _bucketed(grouped, "lm_cells")
    del grouped
    removed(spark)  # what was shuffled for it
    cells = spark.table(table).where("cell >= 0")
    pairs = cells.where("chunk is null").select("cell", "payload")

    up, up_path = stored_at(pairs.mapInArrow(_asked(bits), MESSAGE), "lm-up", **LARGE_ROWS)
    summed = up.where(F.col("side") != TABLES).groupBy("side", "bucket").applyInArrow(_first_sums, MESSAGE)
    sums, sums_path = stored_at(summed, "lm-sums", **LARGE_ROWS)
    del summed

    def stats() -> DataFrame:
        return sums.where((F.col("side") == WORD) & (F.col("cell") == OWN)).mapInArrow(_word_stats, STATS)

    def replies(turn: int) -> DataFrame:
        """What cells know after a turn."""
        down = sums.where(F.col("cell") != OWN).unionByName(up.where(F.col("side") == TABLES))
        return down.select("cell", F.lit(turn).alias("turn"), "side", "bucket", "payload")

    totals = _update(Totals(), stats().unionByName(pairs.mapInArrow(_pair_stats, STATS)))
    totals.leaf_discount = _discount(totals.leaf_once, totals.leaf_twice)
    totals.discount = _discount(totals.once, totals.twice)
    samples, kept, paths = {}, [], []
    for turn in range(1, PASSES + SAMPLES + 1):
        seats = pairs.groupBy("cell").cogroup(replies(turn - 1).groupBy("cell")).applyInArrow(_seated(totals, turn, bits), MESSAGE)
        new_up, new_up_path = stored_at(seats, "lm-up", **LARGE_ROWS)
        moved = new_up.where(F.col("side") != TABLES).unionByName(sums.where(F.col("cell") == OWN))
        summed = moved.groupBy("side", "bucket").applyInArrow(_sums(totals, turn), MESSAGE)
        new_sums, new_sums_path = stored_at(summed, "lm-sums", **LARGE_ROWS)
        del seats, moved, summed
        removed(spark, up_path, sums_path)
        up, up_path, sums, sums_path = new_up, new_up_path, new_sums, new_sums_path
        totals = _update(totals, stats())
        if turn > PASSES:
            samples[turn] = totals
            sample, path = stored_at(replies(turn), "lm-sample", **LARGE_ROWS)
            kept.append(sample)
            paths.append(path)
    # The samples are all that is asked of the turns from here on.
    del up, sums
    removed(spark, up_path, sums_path)
    known = kept[0]
    for more in kept[1:]:
        known = known.unionByName(more)
    answers = cells.groupBy("cell").cogroup(known.groupBy("cell")).applyInArrow(_answers(samples, bits), ROW)
    rows = spark.table(table).where("cell < 0").unionByName(answers)
    scores, _ = stored_at(rows.groupBy("chunk").applyInArrow(_scores(totals), SCORES), "lm-scores")
    spark.sql(f"DROP TABLE {table}")
    removed(spark, table_path, *paths)
    return scores


def perplexity(scores: DataFrame) -> DataFrame:
    """held_out, tokens, perplexity: of the texts the model was trained on, and of the others."""
    mean = F.sum("score") / F.sum("n_tokens")
    return scores.groupBy("held_out").agg(F.sum("n_tokens").alias("tokens"), F.pow(F.lit(10.0), -mean).alias("perplexity"))
