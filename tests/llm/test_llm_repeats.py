import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import sentence

from tessera.llm import neardup, substring
from tessera.llm.components import components
from tessera.llm.fmindex import FmIndex
from tessera.llm.words import Words


def words(text, lower=False):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]


def brute_removed(rows, window=13):
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        if i is not None:
            for a in range(len(w) - window + 1):
                g = tuple(w[a:a + window])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t, *_ in rows:
        w = words(t)
        gone = set()
        for a in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[a:a + window])] < i:
                gone.update(range(a, a + window))
        kept = " ".join(x for a, x in enumerate(w) if a not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def brute_components(rows, percent=75):
    sets, out = [], []
    for i, t, *_ in rows:
        w = words(t, True)
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[a:a + 5]) for a in range(len(w) - 4)})
    label = {i: i for i, *_ in rows if i is not None}
    while True:
        before = dict(label)
        for a in range(len(rows)):
            for b in range(a):
                i, j = rows[a][0], rows[b][0]
                if i is None or j is None or not sets[a] or not sets[b]:
                    continue
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    for (i, *_), s in zip(rows, sets, strict=True):
        c = None if i is None else label[i]
        out.append((i, len(s), c, i is None or i == c))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def copies(vocabulary):
    """Chains of near copies, large groups, common passages, edits at borders."""
    rng = random.Random(8)
    rows, i = [], 0
    common = sentence(rng, 30, vocabulary)
    for _ in range(6):
        text = sentence(rng, rng.randint(20, 120), vocabulary).split()
        for _ in range(rng.randint(2, 30)):
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            i += rng.randint(1, 4)
            rows.append((i, rng.choice([" ", "\n", "  "]).join(text[rng.randint(0, 2):])))
    for _ in range(60):
        i += 1
        rows.append((i, sentence(rng, rng.randint(0, 25), vocabulary) + " " + common[rng.randint(0, 9):] + " " + sentence(rng, rng.randint(0, 25), vocabulary)))
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(r[0], r[1], "clash") for r in rows], "doc_id long, text string, id string").repartition(3)


def test_word_hashes_follow_words():
    import pyarrow as pa

    texts = ["a b  c", None, "", "x", "é é \x0b b", "tail ", " lead", "a"]
    w = Words(pa.array(texts))
    assert np.diff(w.first).tolist() == [len(words(t)) for t in texts]
    flat = [x for t in texts for x in words(t)]
    assert len(set(flat)) == len(set(w.hash.tolist()))
    assert w.hash[flat.index("a")] == w.hash[-1] and w.joined(np.ones(len(flat), bool)) == [" ".join(words(t)).encode() for t in texts]
    assert len(Words(pa.array([], pa.string())).hash) == 0 and len(Words(pa.array([None], pa.string())).hash) == 0


def test_fm_index_counts_patterns():
    rng = np.random.default_rng(4)
    for size in (2, 7, 300):
        seq = rng.integers(1, size, 800) if size > 2 else np.ones(800, np.int64)
        seq[::37] = 0
        seq[-1] = 0
        index = FmIndex(seq, size)
        patterns = np.stack([*(seq[a:a + 13] for a in range(0, 780, 11)), rng.integers(0, size, 13)])
        low, high = index.search(patterns)
        text = seq.tolist()
        assert (high - low).tolist() == [sum(text[a:a + 13] == p for a in range(len(text) - 12)) for p in patterns.tolist()]
        for p, lo, hi in zip(patterns, low, high, strict=True):
            assert all(text[a:a + 13] == p.tolist() for a in index.places[lo:hi])
    assert index.matching_lengths(seq[1:30], 16)[0] == 16


def test_repeats_of_messy_rows(messy, messy_rows, nothing):
    assert sorted(map(tuple, substring.remove_repeats(messy).collect()), key=str) == brute_removed(messy_rows)
    assert substring.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("hot", [1000, 3])
def test_repeats_of_copies(spark, copies, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    monkeypatch.setattr(substring, "SHARD_WORDS", 500)
    assert sorted(map(tuple, substring.remove_repeats(frame(spark, copies)).collect()), key=str) == brute_removed(copies)


def test_near_duplicates_of_messy_rows(messy, messy_rows, nothing):
    rows = [r for r in messy_rows if r[0] != 20]  # two texts under one id are one node
    assert sorted(map(tuple, neardup.near_duplicates(messy.where("doc_id IS NULL OR doc_id <> 20")).collect()), key=str) == brute_components(rows)
    assert neardup.near_duplicates(nothing).count() == 0
    assert neardup.near_duplicates(messy).count() == len(messy_rows)


def test_near_duplicates_of_copies(spark, copies, monkeypatch):
    want = brute_components(copies)
    assert len({r[2] for r in want}) < len(want)
    assert sorted(map(tuple, neardup.near_duplicates(frame(spark, copies)).collect()), key=str) == want
    monkeypatch.setattr(neardup, "BLOCK", 4)  # large buckets in blocks
    assert sorted(map(tuple, neardup.near_duplicates(frame(spark, copies)).collect()), key=str) == want


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    for shared in (0, 500, 900, 1000):
        a, b = pool[:1000], pool[1000 - shared:2000 - shared]
        ra, rb = (neardup.registers(x, np.zeros(len(x), int), 1) for x in (a, b))
        union = np.union1d(a, b)
        assert (neardup.merged(ra, rb) == neardup.registers(union, np.zeros(len(union), int), 1)).all()
        est = neardup.estimated(ra, rb, np.array([1000]), np.array([1000]))[0]
        assert abs(est - shared / (2000 - shared)) < 0.12


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 400) if i % 100 != 50] + [(1000, 5), (7, 7)]
    random.Random(1).shuffle(edges)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long").repartition(4), "test").collect()))
    start = lambda i: 0 if i <= 50 or i == 1000 else (i - 51) // 100 * 100 + 51
    assert got == {i: start(i) for i in [*range(401), 1000]}
    assert components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


def test_copy_under_the_id_of_another_text(spark, vocabulary):
    """(5, A) is a copy of (3, A), although id 5 is the first of B."""
    rng = random.Random(9)
    a, b, c = (sentence(rng, 40, vocabulary) for _ in range(3))
    rows = [(3, a), (5, a), (5, b), (7, c + " " + b), (None, a), (5, "few words")]
    got = sorted(map(tuple, substring.remove_repeats(frame(spark, rows)).collect()), key=str)
    assert got == brute_removed(rows)
    assert sorted(r[2] for r in got if r[0] == 5) == [0, 0, 40]
