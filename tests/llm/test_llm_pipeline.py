from collections import Counter

import corpus_pipeline as cp
from pyspark.sql import functions as F

from tessera.llm.common import staged
from tessera.tables import load


def stages(spark, docs):
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(staged(stage(spark, out[-1], ""), f"test-{name}"))
    return out


def test_stage_names():
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_duplicates", "repeated_passages", "mix_sources", "sentencepiece"]


def test_brute_force(spark):
    """Each stage against a plain version on its own input."""
    import hashlib

    import public_tokenizers
    import sentencepiece
    from test_llm_repeats import brute_components, brute_removed

    docs = load(spark, "/root/testdata/sf0.001", "documents").limit(150)
    s = stages(spark, docs)
    rows = [sorted(map(tuple, x.collect())) for x in s]
    assert all(x.columns == docs.columns for x in s[:5])
    assert set(rows[1]) <= set(rows[0]) and len(rows[1]) >= 0.98 * len(rows[0])
    kept = {r[0] for r in brute_components(rows[1]) if r[3]}
    assert rows[2] == [r for r in rows[1] if r[0] in kept]
    want = {r[0]: r for r in brute_removed(rows[2])}
    for before, after in zip(rows[2], rows[3], strict=True):
        i, n, gone, sha = want[after[0]]
        assert hashlib.sha256(" ".join(after[1].split()).encode()).hexdigest() == sha and after[4] == len(after[1])
        assert gone or before == after
    assert set(rows[4]) == set(rows[3])
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = Counter((r[0], len(lib.encode(r[1])) + 1) for r in rows[4])
    assert Counter((r["doc_id"], r["n_tokens"]) for r in s[5].collect()) == ids


def test_messy_rows(spark, messy, nothing):
    s = stages(spark, messy)
    assert all(x.columns == messy.columns for x in s[:5])
    texts = {r["doc_id"]: r["text"] for r in s[2].collect()}
    assert 5 not in texts and 6 not in texts and 10 not in texts and 2 not in texts and 3 not in texts and 1 in texts
    assert [x.count() for x in stages(spark, nothing)] == [0] * 6


def test_run(spark, tmp_path):
    path = tmp_path / "documents.parquet"
    load(spark, "/root/testdata/sf0.001", "documents").where(F.col("doc_id") < 60).write.parquet(str(path))
    assert cp.run(spark, str(tmp_path)).where("round_trip").count() > 40


def test_every_text_with_a_letter_has_passed_language_id(spark):
    """Texts of many languages in equal parts, and tables without a learned
    language, lose only texts without a letter."""
    words = {"en": "the house and water", "de": "das haus und wasser", "fr": "cette maison avec leau", "es": "aquella casa junto agua"}
    rows = [(i, " ".join([w] * 30), k) for i, (k, w) in enumerate(list(words.items()) * 3)]
    rows += [(100, " ".join(words.values()), None), (101, "12 - 34", "en"), (102, "", "en"), (103, None, "en"), (104, "日本", None)]
    docs = spark.createDataFrame([(i, t, k, "a", None if t is None else len(t)) for i, t, k in rows],
                                 "doc_id long, text string, lang string, source string, n_chars int")
    want = {i for i, *_ in rows} - {101, 102, 103}
    stage = dict(cp.STAGES)["language_id"]
    assert {r.doc_id for r in stage(spark, docs, "").collect()} == want
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in stage(spark, unlabelled, "").collect()} == want
