import hashlib
import random
import re

import numpy as np
import pytest
from conftest import sentence

from tessera.llm import decontam as dc


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(rows, items, window=10):
    windows = {}
    for i, t in items:
        w = words(t)
        k = min(len(w), window)
        for a in range(len(w) - k + 1) if w else ():
            windows.setdefault(tuple(w[a:a + k]), set()).add(i)
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for k in {len(g) for g in windows}:
            for a in range(len(w) - k + 1):
                if (own := windows.get(tuple(w[a:a + k]))) is not None:
                    hit.update(range(a, a + k))
                    found |= own
        found = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(vocabulary, messy_rows):
    rng = random.Random(11)
    text = messy_rows[0][1].split()
    long = words(next(r[1] for r in messy_rows if r[0] == 15))
    return [
        (1, " ".join(text[5:40])), (2, " ".join(text[5:40]).upper()), (2, " ".join(text[50:70])), (3, None), (4, ""), (5, " -- !"), (None, " ".join(text[90:104])),
        (None, None), (6, "one, two"), (7, "É"), (8, "é"), (9, "spam " * 12), (10, sentence(rng, 30, vocabulary)), (10, sentence(rng, 30, vocabulary)),
        (11, ". ".join(long[100:8000])), (12, " ".join(long[20_000:20_009])), (13, " ".join([*long[29_000:29_010], "zzz", *long[40:52]])), (1, " ".join(text[5:40])),
        (14, " ".join(text[40:45] + text[70:90])), (15, "123"),
    ]


@pytest.fixture(scope="module")
def tests(spark, items):
    return spark.createDataFrame([(*r, "clash") for r in items], "item_id long, text string, item string").repartition(2)


def test_messy_rows(messy, messy_rows, items, tests, nothing):
    rows = [r[:2] for r in messy_rows]
    got = sorted(map(tuple, dc.contamination(messy, tests).collect()), key=str)
    assert got == brute(rows, items) and {r[3] for r in got} >= {0, 1, 3}
    assert dc.contamination(nothing, tests).count() == 0
    assert sorted(map(tuple, dc.contamination(messy, tests.where("false")).collect()), key=str) == brute(rows, [])


@pytest.mark.parametrize("window", [1, 3, 16])
def test_other_windows(messy, messy_rows, items, tests, window):
    assert sorted(map(tuple, dc.contamination(messy, tests, window=window).collect()), key=str) == brute([r[:2] for r in messy_rows], items, window)


def test_blocks_and_small_shards(messy, messy_rows, items, tests, monkeypatch):
    """Several blocks of tests and pieces of items give the same rows."""
    monkeypatch.setattr(dc, "BLOCK_WORDS", 3000)
    monkeypatch.setattr(dc, "PIECE_WORDS", 40)
    monkeypatch.setattr(dc, "SHARD_BYTES", 2000)
    assert dc.Tests(tests, "item_id", "text", 10).blocks > 2
    assert sorted(map(tuple, dc.contamination(messy, tests).collect()), key=str) == brute([r[:2] for r in messy_rows], items)


def test_affected_documents_go(messy, messy_rows, items, tests):
    hit = {(r[0], r[1]) for r in brute([r[:2] for r in messy_rows], items) if r[5]}
    left = dc.decontaminate(messy, tests)
    assert left.columns == messy.columns
    want = sorted((r for r in messy_rows if (r[0], len(words(r[1]))) not in hit), key=str)
    assert sorted((tuple(r)[:4] for r in left.collect()), key=str) == want and 0 < len(want) < len(messy_rows)


def test_longest_matches(spark, messy, messy_rows, items, tests):
    texts = {}
    for i, t, *_ in messy_rows:
        texts.setdefault(i, set()).add(t)
    got = dc.matches(messy, tests).collect()
    assert (1, "1", 5, 0, 35) in set(map(tuple, got)) and (1, "2", 50, 0, 20) in set(map(tuple, got))
    own = {}
    for i, t in items:
        own.setdefault(str(i), []).append(words(t))
    for r in got:
        if r["item_id"] is None:
            continue
        a, n, p = r["doc_word"], r["n_words"], r["item_word"]
        ok = False
        for w in map(words, texts[r["doc_id"]]):
            for x in own[r["item_id"]]:
                if w[a:a + n] != x[p:p + n] or len(x[p:p + n]) < n:
                    continue
                left = a == 0 or p == 0 or w[a - 1] != x[p - 1]
                right = a + n >= len(w) or p + n >= len(x) or w[a + n] != x[p + n]
                ok |= left and right and n >= min(10, len(x))
            # pieces end a match early
        assert ok or n >= dc.PIECE_WORDS - 10 or r["item_id"] == "11"
    # the distinct texts of every hit row have matches that cover the hit words
    spans = {}
    for r in got:
        spans.setdefault(r["doc_id"], set()).update(range(r["doc_word"], r["doc_word"] + r["n_words"]))
    for i, _, n_hit, *_ in brute([r[:2] for r in messy_rows if r[0] not in (None, 11, 20)], items):
        assert len(spans.get(i, ())) == n_hit


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(3)
    number = rng.integers(0, 4, 500).astype(np.int32)
    row = np.sort(rng.integers(0, 20, 500))
    shard = dc.ShardSuffixes(number, row, 3)
    text = shard.text.tolist()
    keys = [tuple(text[p:p + 16]) for p in shard.array]
    assert keys == sorted(keys)
    runs = {p for p in range(498) if row[p] == row[p + 2] and number[p:p + 3].all()}
    assert runs <= set(shard.word[shard.array].tolist())
