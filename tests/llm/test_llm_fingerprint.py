import hashlib
import re

from pyspark.sql import functions as F

from tessera.llm import fingerprint as fp


def shingles(text, k=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_messy_rows(messy, messy_rows, nothing):
    got = {(r["doc_id"], r["n_chars"]): r for r in fp.fingerprints(messy).collect()}
    assert fp.fingerprints(messy).count() == len(messy_rows)
    order = sorted(messy_rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    for at, (i, text, *_) in enumerate(order):
        text, after = text or "", order[(at + 1) % len(order)][1] or ""
        n = len(text) // 4
        edited = text[:len(text) - n] + after[:n]
        r = got[i, len(text)]
        if sum((x[0], len(x[1] or "")) == (i, len(text)) for x in order) == 1:
            assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert abs(r["near_edited"] - jaccard(shingles(text), shingles(edited))) < 0.2
            assert abs(r["near_next"] - jaccard(shingles(text), shingles(after))) < 0.2
        if len(shingles(text)) < fp.K:
            assert r["n_distinct"] == len(shingles(text))
    assert got[1, got[1, order[2][1] and len(order[2][1])]["n_chars"]]["fingerprint"] == got[2, len(order[2][1])]["fingerprint"]
    assert fp.fingerprints(nothing).count() == 0


def test_runs_of_neighbours(spark, monkeypatch):
    monkeypatch.setattr(fp, "RUN_ROWS", 7)
    df = spark.range(100).select((F.col("id") * F.col("id") * 3).alias("doc_id"), F.concat(F.lit("t"), "id").alias("text")).repartition(5)
    rows = sorted(map(tuple, fp.with_next(df, "doc_id", ["text"]).collect()))
    assert [r[2] for r in rows] == [f"t{(i + 1) % 100}" for i in range(100)]


def test_sketches_merge(spark):
    k = 16
    words = [f"w{i}" for i in range(400)]
    text = " ".join(words)
    parts = [" ".join(words[a:a + 104]) for a in range(0, 400, 100)]  # parts overlap by four words
    df = spark.createDataFrame([(text, parts)], "text string, parts array<string>")
    whole = df.select(fp.sketch(F.col("text"), k).alias("s")).first()["s"]
    rows = df.select(F.explode("parts").alias("p")).select(F.lit(1).alias("g"), fp.sketch(F.col("p"), k).alias("s"))
    assert fp.merged(rows, ["g"], "s", k).first()["s"] == whole
    first, rest = rows.limit(1).first()["s"], [r["s"] for r in rows.collect()]
    two = spark.createDataFrame([(first, rest[1], whole)], "a array<long>, b array<long>, w array<long>")
    out = two.select(fp.merge(F.col("a"), F.col("b"), k).alias("m"), fp.containment(F.col("a"), F.col("w"), k).alias("c"),
                     fp.distinct_count(F.col("w"), k).alias("d")).first()
    assert out["m"] == sorted({*first, *rest[1]})[:k]
    assert out["c"] > 0.4 and 200 < out["d"] < 800


def test_repeated_shingles_fall_back_to_all(spark):
    text = " ".join(["a b c d e f g"] * 500 + [f"x{i}" for i in range(300)])
    r = spark.createDataFrame([(text,)], "text string").select(fp.sketch(F.col("text")).alias("s"), fp.shingle_hashes(F.col("text")).alias("h")).first()
    assert r["s"] == sorted(set(r["h"]))[:fp.K]


def test_plan_has_no_python(messy):
    plan = fp.fingerprints(messy)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
