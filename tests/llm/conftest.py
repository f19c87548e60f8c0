import random

import pytest

CLASHES = ["id", "n_tokens", "n_bytes", "over_limit", "digest", "anchor", "hash", "words", "regs", "n", "comp", "kept", "rest", "segments",
           "masks", "own", "score", "lang_pred", "held_out", "mix_slot", "mix_key", "fp_text", "fingerprint", "n_chars_", "component_id", "salt"]


def sentence(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def vocabulary():
    rng = random.Random(1)
    return ["".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 8))) for _ in range(3000)]


@pytest.fixture(scope="session")
def messy_rows(vocabulary):
    """(doc_id, text, lang, source): nulls everywhere, empty and very long
    texts, ties, repeated rows, near and exact copies, a hot source."""
    rng = random.Random(2)
    base = sentence(rng, 120, vocabulary)
    near = base.split()
    near[60] = "changed"
    passage = sentence(rng, 60, vocabulary)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), "en", "a"), (4, base.upper(), "de", "a"),
        (5, None, "en", "b"), (6, "", "de", "b"), (7, " \t\n ", None, None), (8, "one two", "en", "c"), (9, "ONE  two", "en", "c"),
        (None, base, "en", "a"), (None, None, None, None), (10, "123 456 !!!", "en", "a"), (11, "é", "fr", "a"), (11, "é", "fr", "a"),
        (12, sentence(rng, 40, vocabulary) + " " + passage + " " + sentence(rng, 30, vocabulary), "en", "a"),
        (13, passage + "\n" + sentence(rng, 50, vocabulary), None, "a"), (14, sentence(rng, 9, vocabulary) + " " + passage, "de", "b"),
        (15, sentence(rng, 30_000, vocabulary), "en", "a"), (16, "x" * 50_000, "en", "a"), (17, "spam " * 3000, "en", "a"),
        (18, "a\x00b 日本語 🙂 <|endoftext|> ▁", "fr", "b"), (20, passage, "en", "a"), (20, "other words under the same id", "en", "a"),
    ]
    rows += [(i, sentence(rng, rng.randint(1, 80), vocabulary), rng.choice(["en", "de", None]), "a" if i % 3 else f"s{i % 5}") for i in range(30, 90)]
    rows += [rows[0], rows[5]]
    return rows


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    """The rows with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in messy_rows],
                               "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASHES)).repartition(3)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.where("1 = 0")
