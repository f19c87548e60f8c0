import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import phrases as ph


def pieces(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", text)]


def counts(rows, longest=3):
    f = {}
    for text, lang in rows:
        own = f.setdefault("und" if lang is None else lang, Counter())
        for w in pieces(text):
            for k in range(1, longest + 1):
                for a in range(len(w) - k + 1):
                    own[tuple(w[a:a + k])] += 1
    return f


def brute(rows, least=10, top=2000, longest=3, share=50):
    out = []
    for lang, f in counts(rows, longest).items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        best = []
        for g, a in f.items():
            if len(g) < 2 or a < least:
                continue
            score, k = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            inside = any(len(x) > len(g) and c >= least and 100 * c >= share * a and any(x[i:i + len(g)] == g for i in range(len(x) - len(g) + 1)) for x, c in f.items())
            if not inside:
                best.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(13)
    words = ["the", "The", "of", "new", "york", "city", "é", "été", "a\x00b", "日本", "x" * 300, "to", "be", "or", "not", "-", "\x0e", " ", "🙂"]
    seps = [" ", " ", " ", " ", " ", "  ", "\t", ". ", ", ", "\n", " \x0b", "; ", "!?", "\r\n", "\x0c"]
    rows = []
    for i in range(300):
        text = "".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(0, 60)))
        rows.append((text, rng.choice(["en", "en", "en", "fr", None, "und", ""])))
    rows += [("new york city " * 50, "en"), ("spam " * 20_000, "en"), (None, "en"), ("", "fr"), (" . ", None), ("one two three. " * 9, "de"), ("rare " + "a b " * 10, "de")]
    return rows + rows[:20]


@pytest.fixture(scope="module")
def corpus_df(spark, corpus):
    df = spark.createDataFrame(corpus, "text string, lang string")
    return df.select("*", *(F.lit("clash").alias(c) for c in ("phrase", "k", "f", "a", "l", "r", "n", "score", "rank", "words", "bwt"))).repartition(4)


def test_collocations(spark, corpus, corpus_df, monkeypatch):
    want = brute(corpus)
    got = ph.collocations(corpus_df)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == want and {r[0] for r in want} >= {"en", "fr", "und", "", "de"}
    assert ph.collocations(corpus_df.where("false")).count() == 0
    # small shards, wide counts
    monkeypatch.setattr(ph, "SHARD_BYTES", 500)
    monkeypatch.setattr(ph, "WIDE", 4)
    assert sorted(map(tuple, ph.collocations(corpus_df).collect())) == want


def test_other_parameters(corpus, corpus_df):
    assert sorted(map(tuple, ph.collocations(corpus_df, longest=2, least=3, top=7, share=20).collect())) == brute(corpus, 3, 7, 2, 20)
    assert sorted(map(tuple, ph.collocations(corpus_df, least=1, top=10**6, share=100).collect())) == brute(corpus, 1, 10**6, 3, 100)


def test_ties_and_top(spark):
    rows = [(" ".join(f"w{i:02} v{i:02}." for i in range(60)), "en")] * 12
    df = spark.createDataFrame(rows, "text string, lang string")
    got = sorted(map(tuple, ph.collocations(df, top=50).collect()))
    assert got == brute(rows, top=50) and [r[2] for r in got] == [f"w{i:02} v{i:02}" for i in range(50)]


def test_index_extends_both_ways(corpus):
    """Counts and neighbours of every phrase of one shard."""
    texts, langs = zip(*[(t, "und" if g is None else g) for t, g in corpus], strict=True)
    shard = ph.Shard.build(pa.array(texts), pa.array(langs))
    names, got = shard.texts().to_pylist(), {}
    for i in ph.enumerate_phrases(shard.bwt):
        for j in range(len(i.first)):
            w = [c[j] - 1 for c in i.words]
            key = shard.langs[shard.lang[w[0]]], tuple(names[x] for x in w)
            assert key not in got
            got[key] = int(i.count[j]), int(i.left[j]), int(i.right[j])
    want = Counter()
    before, after = Counter(), Counter()
    for t, g in zip(texts, langs, strict=True):
        for w in pieces(t):
            for k in (1, 2, 3):
                for a in range(len(w) - k + 1):
                    key = g, tuple(w[a:a + k])
                    want[key] += 1
                    before[key] += a > 0
                    after[key] += a + k < len(w)
    assert got == {k: (c, before[k], after[k]) for k, c in want.items()}


def test_transform_of_large_vocabularies():
    """Numbers too large to be packed give the order of the same small ones."""
    small = np.array([3, 2, 0, 3, 2, 4, 0, 5, 2, 0])
    large = np.where(small == 5, 1 << 22, small)
    got = ph.transform(large)
    assert (np.where(got == 1 << 22, 5, got) == ph.transform(small)).all()


def test_counts_add_up(spark, corpus, corpus_df):
    index = ph._stored(ph.shards(corpus_df, "text", "lang"))
    got = {(r["lang"], r["phrase"]): r["f"] for r in ph.counted(index, least=2).collect()}
    assert got == {(g, " ".join(p)): c for g, f in counts(corpus).items() for p, c in f.items() if c >= 2}


def test_packed_numbers():
    for numbers in ([], [0, 1, 70_000, (1 << 24) - 1], [5, 1 << 24, 3]):
        assert ph.unpacked_numbers(ph.packed_numbers(np.array(numbers, np.int64))).tolist() == numbers


def test_word_hashes_hold_little_memory():
    """The powers that a worker keeps, and the products, don't grow with the text."""
    import tracemalloc

    from tessera.llm import words as W

    text = pa.array([" ".join(f"w{i * 7919 % 5000}" for i in range(600_000))])
    W._powers.cache_clear()
    tracemalloc.start()
    hashes = W.Words(text).hash
    kept = tracemalloc.get_traced_memory()[0] - 8 * len(hashes)
    tracemalloc.stop()
    assert len(hashes) == 600_000 and kept < 8 << 20
    assert (hashes[:5000] == W.Words(pa.array([" ".join(f"w{i * 7919 % 5000}" for i in range(5000))])).hash).all()
