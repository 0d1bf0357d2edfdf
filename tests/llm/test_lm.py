"""The language model: base score against plain Python, probabilities that sum to one, and a
better score than the base on held-out texts."""

import math
import os
import random
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cilode.llm import common
from cilode.llm import lm as M

SCHEMA = "doc_id long, text string, score string, bucket int"


def tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + ["<end>"]


def fixture(n=400):
    """Two kinds of text, whose words depend on the preceding one."""
    rng = random.Random(7)
    rows = []
    for i in range(n):
        words, kind = [], rng.choice("ab")
        for _ in range(rng.randint(0, 60)):
            words.append(f"{rng.choice(['the', 'of', 'No', 'é'])}{kind}" if rng.random() < 0.5 else f"{kind}{int(rng.paretovariate(0.7))}z{kind}")
        rows.append((i, "\n ".join(words), "s", 0))
    return rows + [(n, None, "s", 0), (n + 1, "", "s", 0), (n + 2, " \t", "s", 0), (None, "the of", None, None), rows[0], rows[0]]


def plain(rows):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for i, t, *_ in rows if not held(i) for w in tokens(t))
    total, words = sum(counts.values()), len(counts)
    return sorted(
        (
            (i, held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), total, round(sum(log10((counts[w] + 1) / (total + words + 1)) for w in tokens(t)), 6))
            for i, t, *_ in rows
        ),
        key=repr,
    )


@pytest.mark.parametrize("chunk,cell", [(1 << 20, 1 << 20), (500, 1500)])
def test_scores(spark, chunk, cell):
    rows = fixture()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = M.scored(docs, chunk, cell).collect()
    found = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got]
    assert sorted(found, key=repr) == plain(rows)
    held = [r for r in got if r.held_out]
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    per_token = lambda name: sum(r[name] for r in held) / sum(r.n_tokens for r in held)
    assert per_token("score") > per_token("base_score") + 0.05


def test_probabilities_sum_to_one():
    """Over the vocabulary and the unknown token, in the parent and in every restaurant."""
    rng = np.random.default_rng(3)
    words, contexts, totals = 300, 5, M.Totals()
    keys = np.unique(rng.integers(0, words, 900) * contexts + rng.integers(0, contexts, 900))
    _, at = np.unique(keys // contexts, return_inverse=True)
    before, words = keys % contexts, at.max() + 1
    counts = rng.integers(1, 50, len(at))
    tables = np.minimum(counts, rng.integers(1, 9, len(at)))
    customers = np.bincount(at, weights=tables, minlength=words)
    parent_tables = np.minimum(customers, 2)
    totals.words, totals.customers, totals.tables = words, customers.sum(), parent_tables.sum()
    totals.discount, totals.leaf_discount = 0.3, 0.6
    shared, unknown = totals.parent(customers, parent_tables), totals.parent(0, 0)
    assert abs(shared.sum() + unknown - 1) < 1e-9
    for c in range(contexts):
        mine = before == c
        held, seated = np.zeros(words), np.zeros(words)
        held[at[mine]], seated[at[mine]] = counts[mine], tables[mine]
        of_context = (seated.sum(), held.sum())
        known = M.predicted(held, seated, of_context, shared, totals)
        assert abs(known.sum() + M.predicted(0, 0, of_context, unknown, totals) - 1) < 1e-9


def log_stirling(count, tables, discount):
    """A row of generalised Stirling numbers by their recursion."""
    row = [-math.inf] * (tables + 2)
    row[1] = 0.0
    for c in range(1, count):
        new = [-math.inf] * (tables + 2)
        for t in range(1, tables + 1):
            stay = row[t] + math.log(c - discount * t) if c > discount * t and row[t] > -math.inf else -math.inf
            new[t] = np.logaddexp(stay, row[t - 1])
        row = new
    return row


@pytest.mark.parametrize(
    "count, discount, others, base", [(2, 0.5, 0, 0.3), (5, 0.3, 2, 0.5), (20, 0.6, 100, 0.01), (60, 0.7, 500, 0.02), (150, 0.5, 900, 0.05), (1500, 0.6, 50, 0.01)]
)
def test_tables_follow_their_distribution(count, discount, others, base):
    """Means of drawn numbers of tables against the exact distribution, by Stirling numbers."""
    most = min(count, 140)
    logs = np.array(log_stirling(count, most, discount)[1 : most + 1])
    logs += np.cumsum([math.log((M.STRENGTH + discount * (others + i)) * base) for i in range(most)])
    chances = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
    exact = (chances * np.arange(1, most + 1)).sum()
    rng, stirling, n = np.random.default_rng(1), M.Stirling(discount), 6000
    same, tables = np.full(n, base), np.ones(n, np.int64)
    for _ in range(20):
        tables = M.draw(np.full(n, count), tables, np.full(n, others), same, same, 0.0, M.STRENGTH, stirling, rng)
        assert (tables >= 1).all() and (tables <= count).all()
    assert abs(tables.mean() - exact) < 0.05 * exact


class PlainModel:
    """The model with one customer moved at a time, in lists of table sizes."""

    def __init__(self, pairs, discount, leaf_discount, words, seed=1):
        self.random, self.d0, self.d1, self.base = random.Random(seed), discount, leaf_discount, 1 / (words + 1)
        self.leaf, self.parent = {}, {}
        self.open, self.total, self.parent_open, self.parent_total = Counter(), Counter(), 0, 0
        self.pairs = pairs
        for pair in pairs:
            self.add(*pair)

    def shared(self, w):
        held = self.parent.get(w, [])
        return (sum(held) - self.d0 * len(held) + (1 + self.d0 * self.parent_open) * self.base) / (1 + self.parent_total)

    def chance(self, u, w):
        held = self.leaf.get((u, w), [])
        return (sum(held) - self.d1 * len(held) + (1 + self.d1 * self.open[u]) * self.shared(w)) / (1 + self.total[u])

    def _sit(self, held, discount, new):
        at = self.random.uniform(0, sum(held) - discount * len(held) + new)
        for k, size in enumerate(held):
            at -= size - discount
            if at < 0:
                held[k] += 1
                return False
        held.append(1)
        return True

    def add(self, u, w):
        held = self.leaf.setdefault((u, w), [])
        self.total[u] += 1
        if self._sit(held, self.d1, (1 + self.d1 * self.open[u]) * self.shared(w)):
            self.open[u] += 1
            above = self.parent.setdefault(w, [])
            self.parent_total += 1
            self.parent_open += self._sit(above, self.d0, (1 + self.d0 * self.parent_open) * self.base)

    def _leave(self, held):
        k = self.random.choices(range(len(held)), held)[0]
        held[k] -= 1
        if held[k]:
            return False
        held.pop(k)
        return True

    def remove(self, u, w):
        self.total[u] -= 1
        if self._leave(self.leaf[u, w]):
            self.open[u] -= 1
            self.parent_total -= 1
            self.parent_open -= self._leave(self.parent[w])

    def sweep(self):
        for pair in self.pairs:
            self.remove(*pair)
            self.add(*pair)


def test_scores_are_those_of_the_plain_model(spark):
    """Mean log probabilities of held-out texts, and perplexity, against single customers moved one by one."""
    rows = [r for r in fixture(250) if r[0] is not None]
    held = {r[0]: M.held_out(r[0]) for r in rows}
    pairs_of = lambda text: list(zip(["<start>", *tokens(text)], tokens(text)))
    pairs = [pair for i, text, *_ in rows if not held[i] for pair in pairs_of(text)]
    counts, contexts = Counter(pairs), Counter(w for _, w in set(pairs))
    once = lambda c, n: sum(v == n for v in c.values())
    plain_model = PlainModel(
        pairs, M._discount(once(contexts, 1), once(contexts, 2)), M._discount(once(counts, 1), once(counts, 2)), len(contexts)
    )
    chances, asked = Counter(), {pair for i, text, *_ in rows if held[i] for pair in pairs_of(text)}
    for turn in range(14):
        plain_model.sweep()
        if turn >= 6:
            chances.update({pair: plain_model.chance(*pair) / 8 for pair in asked})
    want = {i: sum(log10(chances[pair]) for pair in pairs_of(text)) for i, text, *_ in rows if held[i]}
    scores = M.scored(spark.createDataFrame(rows, SCHEMA))
    got = {r.doc_id: r.score for r in scores.collect() if r.held_out}
    # Each text's mean is near, and that of all together nearer still.
    n = {i: len(tokens(text)) for i, text, *_ in rows}
    assert set(got) == set(want)
    assert all(abs(got[i] - want[i]) < 0.05 * n[i] + 0.1 for i in want)
    assert abs(sum(got.values()) - sum(want.values())) < 0.01 * sum(n[i] for i in want)
    # Repeated rows are scored as often as they occur.
    repeated = [r for r in rows if held[r[0]]]
    expected = 10 ** (-sum(want[r[0]] for r in repeated) / sum(n[r[0]] for r in repeated))
    [row] = M.perplexity(scores).where("held_out").collect()
    assert abs(row.perplexity - expected) < 0.05 * expected and row.tokens == sum(n[r[0]] for r in repeated)


def test_words_and_chunks():
    arrays = np.arange(5, dtype=np.uint64), np.array([], np.uint8), np.array([1.5], np.float32)
    for a, b in zip(M.unpacked(M.packed(*arrays), np.uint64, np.uint8, np.float32), arrays):
        assert a.tolist() == b.tolist()


def test_large_rows_go_in_small_pages_and_batches(spark, tmp_path, monkeypatch):
    """Pages and batches are held whole outside the heap; one of 100 rows was a hundred MB."""
    monkeypatch.setattr(common, "shared_folder", lambda spark: f"file://{tmp_path}")
    rows = [(i, random.Random(i).randbytes(1 << 18)) for i in range(40)]
    df = spark.createDataFrame(rows, "cell int, payload binary").coalesce(1)
    _, path = common.stored_at(df, "large", compression="none", **common.LARGE_ROWS)
    [name] = [n for n in os.listdir(path.removeprefix("file://")) if n.endswith(".parquet")]
    file = open(os.path.join(path.removeprefix("file://"), name), "rb").read()
    column = pq.ParquetFile(pa.BufferReader(file)).metadata.row_group(0).column(1)
    # Rows of a page stand side by side, and its head before the first of them.
    ends = [file.index(data) + len(data) for _, data in rows]
    together = [ends[i + 1] - ends[i] == len(rows[i][1]) + 4 for i in range(39)]
    assert column.num_values == 40 and sum(not t for t in together) >= 5
    batches = list(M._batches([(1, data) for _, data in rows], [pa.int32(), pa.binary()], ["cell", "payload"]))
    assert len(batches) == 10 and sum(b.num_rows for b in batches) == 40
    assert [b.num_rows for b in M._batches([], [pa.int32()], ["cell"])] == [0]


def test_batches_to_python_are_small_while_it_runs(spark):
    df = spark.range(64).select(F.repeat(F.lit("x"), 1 << 16).alias("t")).coalesce(1)

    def largest():
        rows = lambda batches: (pa.record_batch({"n": pa.array([b.num_rows], pa.int32())}) for b in batches)
        return max(r.n for r in df.mapInArrow(rows, "n int").collect())

    before = largest()
    with common.small_batches(spark, 1 << 19):
        assert largest() < 16 < before
    assert largest() == before


def test_a_very_long_text_and_clashing_columns(spark):
    text = "one two three " * 200_000
    docs = spark.createDataFrame([(1, text, "s", 0), (2, "two three", "s", 0)], SCHEMA)
    docs = docs.withColumns({"cell": F.lit(1), "payload": F.lit("x"), "side": F.lit(None)})
    got = {r.doc_id: r for r in M.scored(docs).collect()}
    assert got[1].n_tokens == 600_001 and got[2].n_tokens == 3 and np.isfinite(got[1].score)


def test_nothing_is_left_behind(spark, tmp_path, monkeypatch):
    for module in (M, common):
        monkeypatch.setattr(module, "shared_folder", lambda spark: f"file://{tmp_path}")
    assert M.scored(spark.createDataFrame(fixture(30), SCHEMA)).count() == 36
    assert [name.split("-")[1] for name in os.listdir(tmp_path)] == ["scores"]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lm_cells")]


def test_empty_and_untrained(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert M.scored(docs).collect() == []
    only = next(i for i in range(100) if M.held_out(i))
    [row] = M.scored(spark.createDataFrame([(only, "a b", "", 0)], SCHEMA)).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and np.isfinite(row.score)


def test_words_are_contexts_of_their_own(spark):
    """What follows a word is not what follows another one."""
    trained = [i for i in range(400) if not M.held_out(i)]
    rows = [(i, ["north one", "south two"][n % 2], "", 0) for n, i in enumerate(trained)]
    held = [i for i in range(400, 500) if M.held_out(i)][:4]
    rows += [(i, text, "", 0) for i, text in zip(held, ["north one", "north two", "south one", "south two"])]
    got = {r.doc_id: r.score for r in M.scored(spark.createDataFrame(rows, SCHEMA)).collect()}
    right, wrong, wrong_too, right_too = (got[i] for i in held)
    assert right > wrong + 1 and right_too > wrong_too + 1
