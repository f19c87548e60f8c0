import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import language
from tessera.tables import load


def test_held_out_accuracy(spark):
    docs = load(spark, "/root/testdata/sf0.001", "documents")
    r = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL") \
        .agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.count("*").alias("n")).first()
    assert r["n"] > 20 and r["a"] > 0.98


def test_prediction_reads_the_text_alone(spark):
    docs = load(spark, "/root/testdata/sf0.001", "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    changed = docs.withColumn("lang", F.when(held, F.lit("en")).otherwise(F.col("lang"))).withColumn("source", F.lit("x"))
    assert sorted(map(str, language.identify(docs).collect())) == sorted(map(str, language.identify(changed).collect()))


def test_messy_rows(messy, messy_rows, nothing):
    got = language.identify(messy).collect()
    assert len(got) == len(messy_rows)
    texts = {}
    for i, t, *_ in messy_rows:
        texts.setdefault(i, []).append(t)
    for r in got:
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if all(t is None or not any(c.isalpha() for c in t) for t in texts[r["doc_id"]]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        if all(t and any(c.isalpha() for c in t) for t in texts[r["doc_id"]]):
            assert r["lang_pred"] != "und" and r["score"] > 0
    assert language.identify(nothing).count() == 0
    assert {r["lang_pred"] for r in language.identify(messy.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_long_texts_are_counted_in_parts(monkeypatch):
    text = "some words, more 12 words\tand éàü more " * 300
    whole = language.bucket_counts(text)
    monkeypatch.setattr(language, "PART", 100)
    part = language.bucket_counts(text)
    assert (whole[0] == part[0]).all() and (whole[1] == part[1]).all()


def test_proportions_of_a_mixed_text():
    a, b = "alpha beta gamma delta epsilon " * 40, "uno dos tres cuatro cinco seis " * 40
    model = np.full((3, 1 << language.BITS), 0.1)
    for k, t in enumerate((a, b, "zzz qqq www yyy " * 40)):
        at, n = language.bucket_counts(t)
        model[k, at] += n
    model /= model.sum(1, keepdims=True)
    pi = language.proportions([a, a + b, "", a + a + a + b], model)
    assert pi[:, 0].tolist() == [1, 0, 0] and pi[:, 2].tolist() == [0, 0, 0]
    assert abs(pi[0, 1] - 0.5) < 0.1 and pi[2, 1] == 0 and abs(pi[0, 3] - 0.75) < 0.1
