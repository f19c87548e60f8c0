"""The automaton finds what a chain of ``contains`` finds, for any number of slices."""

import pytest

from tessera.operators import relational as R
from tessera.operators.phrase_table import match_phrase_table


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("slice_bytes", [1 << 20, 12])
def test_equals_the_chain(spark, slice_bytes):
    texts = ["Show TOTAL sales by region", "total", "sales", "", None, "she sells", "région totale", "Show TOTAL sales by region"]
    left = spark.createDataFrame([(i % 7, t) for i, t in enumerate(texts)], "id long, text string")
    phrases = spark.createDataFrame(
        [(5, "total sales", "a"), (3, "sales by", "b"), (9, "total", "c"), (1, "she", "d"), (2, "he", "e"),
         (7, "région", "f"), (4, None, "g")], "ord long, phrase string, intent string")
    want = _rows(R.match_phrases(left, "text", phrases, "phrase", "ord", ["intent"]))
    assert _rows(match_phrase_table(left, "text", phrases, "phrase", "ord", ["intent"], slice_bytes)) == want


def test_ties_empty_phrase_and_clashing_names(spark):
    left = spark.createDataFrame([("x", "one two", 1), ("x", None, 2)], "best string, text string, ord long")
    phrases = spark.createDataFrame([(4, "two", "p"), (4, "one", "q"), (4, "one", "o"), (6, "", "r")],
                                    "ord long, phrase string, intent string")
    got = _rows(match_phrase_table(left, "text", phrases, "phrase", "ord", ["intent"]))
    assert got == [("x", "one two", 1, "o"), ("x", None, 2, None)]
    only = phrases.where("phrase = ''")
    assert _rows(match_phrase_table(left, "text", only, "phrase", "ord", ["intent"]))[0][3] == "r"
    none = _rows(match_phrase_table(left, "text", phrases.where("false"), "phrase", "ord", ["intent"]))
    assert [r[3] for r in none] == [None, None]


def test_hundred_thousand_phrases(spark):
    phrases = spark.range(100_000).selectExpr("id AS ord", "concat('key', lpad(id, 6, '0'), ';') AS phrase", "id * 2 AS v")
    left = spark.range(3000).selectExpr("id", "concat('a Key', lpad(id * 33 + 5, 6, '0'), '; key', lpad(id * 7, 6, '0'), ';') AS text")
    got = match_phrase_table(left, "text", phrases, "phrase", "ord", ["v"])
    assert all(r.v == 2 * min(r.id * 33 + 5, r.id * 7) for r in got.collect())


def test_a_worker_lets_an_automaton_go_before_the_next(monkeypatch):
    """Two slices are never held together."""
    from types import SimpleNamespace

    import ahocorasick

    from tessera.operators import phrase_table as PT

    held = []
    new = ahocorasick.Automaton

    def made():
        held.append(len(PT._HELD))
        return new()

    monkeypatch.setattr(ahocorasick, "Automaton", made)
    PT._HELD.clear()
    one, two = (SimpleNamespace(value=([7], [w])) for w in ("ab", "cd"))
    assert PT._automaton(one)[0] is PT._automaton(one)[0]
    a, ranks, words = PT._automaton(two)
    assert held == [0, 0] and ranks == [7] and [v for _, v in a.iter("xcd")] == [0]
    PT._HELD.clear()


def test_texts_are_written_once_whatever_the_slices(spark, monkeypatch):
    """Slices add the numbers of rows; before, every slice but the first wrote the texts anew."""
    from tessera.operators import phrase_table as PT

    left = spark.createDataFrame([(i, f"say {i:05d} the long phrase") for i in range(40)] + [(7, None)], "id long, text string")
    phrases = spark.createDataFrame([(i, f"{i:05d} the long", i * 3) for i in range(0, 80, 2)] + [(90, "say", 1)], "ord long, phrase string, v long")
    written, write = [], PT.write_staged
    monkeypatch.setattr(PT, "write_staged", lambda df, *a: written.append(df.columns) or write(df, *a))
    got = _rows(match_phrase_table(left, "text", phrases, "phrase", "ord", ["v"], 150))
    assert got == sorted([(i, f"say {i:05d} the long phrase", 1 if i % 2 else i * 3) for i in range(40)] + [(7, None, None)], key=repr)
    assert len(written) > 4 and sum("c1" in c for c in written) == 1
    written.clear()
    assert _rows(match_phrase_table(left, "text", phrases, "phrase", "ord", ["v"])) == got
    assert not any("c1" in c for c in written)


def test_index_finds_what_contains_finds(monkeypatch):
    """Phrases of all lengths, at the edges of texts and of the places tested together, and among equal hashes."""
    import random

    import numpy as np
    import pyarrow as pa

    from tessera.operators import phrase_table as PT

    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("abé 語") for _ in range(n))
    texts = [make(rng.randrange(0, 60)) for _ in range(300)] + [None, "", make(2000)]
    known = [t for t in texts if t and len(t.encode()) > 70][:1] + [t[a:a + rng.randrange(4, 30)] for t in texts if t for a in (0, 3, 11)]
    phrases = list(dict.fromkeys(p for p in known + [make(rng.randrange(5, 20)) for _ in range(200)] if len(p.encode()) >= PT.SHORT))
    want = [next((i for i, p in enumerate(phrases) if t and p in t), -1) for t in texts]
    column = pa.array(["not this one"] + texts)[1:]   # a slice
    table = pa.table({"ord": list(range(len(phrases))), "phrase": phrases})
    for places, pairs in ((1 << 18, 1 << 20), (7, 5)):
        monkeypatch.setattr(PT, "PLACES", places)
        monkeypatch.setattr(PT, "PAIRS", pairs)
        short, (ranks, index) = PT._slice(table)
        assert short is None and index.first(*PT._bytes_of(column, 24)).tolist() == want
    hashes = PT._hashes
    monkeypatch.setattr(PT, "_hashes", lambda e, at, length: hashes(e, at, length) & np.uint64(15))
    assert PT._slice(table)[1][1].first(*PT._bytes_of(column, 24)).tolist() == want
