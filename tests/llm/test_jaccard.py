"""The n-gram Jaccard join against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from cilode.llm import jaccard as J
from cilode.llm.components import components
from cilode.llm.hashing import shingles, word_hashes


def plain(rows):
    sets = []
    for _, text in rows:
        held = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(held[i : i + 4]) for i in range(max(1, len(held) - 3))} if held else set())
    part = list(range(len(rows)))

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    links = 0
    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if a and 100 * shared >= 85 * (len(a) + len(sets[j]) - shared):
                links += 1
                part[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))), links


def near_copies():
    """Groups of copies with few and many edits, around the threshold, and a shared passage."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for size in (1, 3, 4, 5, 8, 10, 11, 13, 20, 40, 90, 200, 700):
        for _ in range(3):
            base = [rng.choice(vocabulary) for _ in range(size)]
            for _ in range(6):
                held = list(base)
                for _ in range(rng.choice([0, 0, 1, 1, 2, 3]) * max(1, size // 60)):
                    at = rng.randrange(len(held))
                    held[at : at + rng.choice([0, 1])] = [rng.choice(vocabulary)]
                texts.append(" ".join(held).upper() if rng.random() < 0.2 else "\n".join(held))
    # Many texts that are mostly one passage, and a chain of copies of copies.
    texts += [" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))]) for _ in range(60)]
    held = [rng.choice(vocabulary) for _ in range(150)]
    for _ in range(60):
        held = list(held)
        held[rng.randrange(150)] = rng.choice(vocabulary)
        texts.append(" ".join(held))
    texts += [None, "", " \t\n", None]
    return [(i, t) for i, t in enumerate(texts)]


def test_all_links_are_found(spark):
    rows = near_copies()
    want, links = plain(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, J.classes(docs).collect())) == want
    assert links > 150 and len({w[2] for w in want}) > 50


@pytest.mark.parametrize("crowd", [0, 2])
def test_links_in_crowds_are_found(spark, crowd):
    """Nearly every segment is crowded; those that are not are looked at as always."""
    rows = near_copies()
    want, _ = plain(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, J.classes(docs, crowd=crowd).collect())) == want


@pytest.mark.parametrize("percent", [50, 85])
def test_rare_members_meet(percent):
    """Two alike sets share one of the first members of each, in any order of members."""
    rng = random.Random(percent)
    for _ in range(500):
        common = rng.sample(range(200), rng.randint(1, 60))
        a, b = (sorted({*common, *rng.sample(range(200, 300), rng.randint(0, 30))}, key=lambda m: m * 7919 % 301) for _ in range(2))
        a, b = sorted((a, b), key=len)
        shared = len(set(a) & set(b))
        if 100 * shared >= percent * (len(a) + len(b) - shared):
            first = len(a) - (2 * percent * len(a) + 99 + percent) // (100 + percent) + 1
            assert set(a[:first]) & set(b[: len(b) - (percent * len(b) + 99) // 100 + 1])


def forms(n, seed=3):
    """One form of a hundred words with three fields, filled in at random: 0.79 alike; a few pairs are nearer."""
    rng = random.Random(seed)
    form = [f"form{i}" for i in range(100)]
    rows = []
    for i in range(n):
        held = list(form)
        for at in (20, 50, 80):
            held[at] = f"field{rng.randrange(10**9)}"
        rows.append((i, " ".join(held)))
    for i in range(0, n, 100):
        held = rows[i][1].split(" ")
        held[20] = "nearly"
        rows.append((n + i, " ".join(held)))
    return rows


def test_filled_in_forms_do_not_meet(spark, monkeypatch):
    """The pairs that are compared grow with the texts, not with their square; the near ones are found."""
    met, sharing = [], J._sharing_rare

    def counted(sets, fragments, percent):
        pairs = sharing(sets, fragments, percent)
        met.append((sets.count(), pairs.count()))
        return pairs

    monkeypatch.setattr(J, "_sharing_rare", counted)
    for n in (500, 2000):
        met.clear()
        got = {r.doc_id: r.component_id for r in J.classes(spark.createDataFrame(forms(n), "doc_id long, text string")).collect()}
        assert got == {i: i - n if i >= n else i for i in got} and len(got) == n + n // 100
        [(sets, pairs)] = met
        assert sets > 0.9 * n and pairs < 10 * n


def test_hot_group_costs_its_size(spark):
    """Hundreds of near copies, most of them not linked with each other."""
    rng = random.Random(2)
    base = [f"b{rng.randrange(300)}" for _ in range(150)]
    rows = []
    for i in range(250):
        held = list(base)
        for _ in range(rng.randint(1, 9)):
            held[rng.randrange(150)] = f"e{rng.randrange(10_000)}"
        rows.append((i, " ".join(held)))
    want, _ = plain(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, J.classes(docs).collect())) == want


@pytest.mark.parametrize("percent", [50, 85, 95])
def test_segments_meet(percent):
    """Every pair that reaches the threshold shares more segments than both may leave out."""
    rng = np.random.default_rng(percent)
    met = 0
    for _ in range(400):
        size = int(rng.integers(1, 400))
        common = rng.integers(0, 2**63, size, np.uint64) * np.uint64(2)
        extra = [rng.integers(0, 2**63, int(rng.integers(0, 1 + size * (100 - percent) // 100)), np.uint64) for _ in range(2)]
        a, b = (np.unique(np.concatenate([common, e])) for e in extra)
        shared = len(np.intersect1d(a, b))
        if 100 * shared < percent * (len(a) + len(b) - shared) or np.array_equal(a, b):
            continue
        met += 1
        (ka, ia), (kb, ib) = J.segment_rows(a, percent), J.segment_rows(b, percent)
        assert ((J.parity(a) ^ J.parity(b)) & (2**64 - 1)).bit_count() <= len(a) + len(b) - 2 * shared
        large, info = (ka, ia) if len(a) >= len(b) else (kb, ib)
        own = set(large[(info & 1) == 0].tolist())
        both = own & set((kb if large is ka else ka).tolist())
        spare = lambda i: int(((i >> 1) & ((1 << J._FIELD) - 1)).max())
        level = int((info[(info & 1) == 0] >> (J._FIELD + 1))[0])
        other = ib if large is ka else ia
        same = other[(other >> (J._FIELD + 1)) == level]
        assert len(both) > max(spare(info[(info & 1) == 0]), spare(same))
    assert met > 50


def test_words_are_those_between_white_space():
    rng = random.Random(1)
    for _ in range(300):
        data = "".join(rng.choice(["a", "b", "é", " ", "\n", "\x0b", "\x0c", "\r", "\t", "\x1c", " "]) for _ in range(rng.randint(0, 30))).encode()
        held = data.split()
        found = word_hashes(data)
        assert len(found) == len(held)
        assert len(set(found.tolist())) == len(set(held))
    long = b"x" * 3_000_000 + b" y " + b"z " * 10
    assert len(word_hashes(long)) == 12 and len(shingles(long, 4)) == 3


def test_odd_rows(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(5, text, "x", 1), (5, text, "y", 2), (2, text, "z", 3), (None, text, "n", 4), (9, None, "", 5), (9, "", "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, n_shingles int")
    got = sorted(map(tuple, J.classes(docs).collect()), key=repr)
    assert got == sorted([(5, 7, 2), (5, 7, 2), (2, 7, 2), (None, 7, 2), (9, 0, 9), (9, 0, 9)], key=repr)
    kept = J.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.n_shingles for r in kept.collect()) == [3, 4, 5, 6]
    empty = docs.where("false")
    assert J.classes(empty).collect() == [] and J.representatives(empty).collect() == []


def test_rows_without_id_link_others(spark):
    """A - N - B: only N links A with B, and N has no id."""
    held = [f"n{i}" for i in range(100)]
    a, b = list(held), list(held)
    a[30] = b[70] = "edited"
    rows = [(1, " ".join(a)), (None, " ".join(held)), (2, " ".join(b)), (None, "other words without a link at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert J.classes(docs.where("doc_id is not null")).select("component_id").distinct().count() == 2
    got = sorted(map(tuple, J.classes(docs).collect()), key=repr)
    assert got == sorted([(1, 97, 1), (2, 97, 1), (None, 97, 1), (None, 4, None)], key=repr)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1100)]
    part = {}

    def find(i):
        while part.setdefault(i, i) != i:
            i = part[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        part[max(x, y)] = min(x, y)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: find(i) for a, b in edges for i in (a, b) if find(i) != i}
