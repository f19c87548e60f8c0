"""Vector search paths agree with brute force."""

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import search as SR


def _brute(vecs, ids, k, exclude_self=True):
    m = np.asarray(vecs, dtype=np.float64)
    n = np.linalg.norm(m, axis=1)
    sims = np.round(m @ m.T / (np.outer(n, n) + 1e-12), 9)
    out = {}
    for i, q in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if not (exclude_self and j == i)),
                       key=lambda j: (-sims[i, j], ids[j]))[:k]
        out[q] = [ids[j] for j in order]
    return out


def _vectors(spark, n=300, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)).astype(np.float32)
    v[5] = v[6]  # an exact tie
    rows = [(i, v[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, vec array<float>"), v, list(range(n))


def _as_map(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.item_id)
    return got


def test_knn_paths_match_brute_force(spark):
    df, v, ids = _vectors(spark)
    want = _brute(v, ids, 5)
    broadcast = SR.knn(df, df, 5, "id", "vec", "id", "vec", exclude_self=True)
    blocked = SR.knn(df, df, 5, "id", "vec", "id", "vec", exclude_self=True, query_block=64)
    small = SR.knn(df, df, 5, "id", "vec", "id", "vec", exclude_self=True, small_items=1000)
    assert _as_map(broadcast) == want
    assert _as_map(blocked) == want
    assert _as_map(small) == want


def test_chunked_topk_equals_unchunked(monkeypatch):
    rng = np.random.default_rng(1)
    q, i = rng.normal(size=(50, 8)), rng.normal(size=(40, 8))
    qi, ii = np.arange(50, dtype=np.int64), np.arange(100, 140, dtype=np.int64)
    args = (qi, q, np.linalg.norm(q, axis=1), ii, i, np.linalg.norm(i, axis=1), 5, False)
    full = SR._local_topk(*args)
    monkeypatch.setattr(SR, "MAX_CELLS", 120)  # three queries per slice
    chunked = SR._topk_chunked(*args)
    assert full.equals(chunked)


def test_null_and_empty_vectors_skipped(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 1.0])], "id long, vec array<float>")
    hits = SR.knn(df, df, 3, "id", "vec", "id", "vec").collect()
    assert {r.query_id for r in hits} == {1, 4} and {r.item_id for r in hits} == {1, 4}


def test_ann_recall(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    exact = SR.knn(e, e, 10, "vec_id", "embedding", "vec_id", "embedding", exclude_self=True)
    approx = SR.ann(e, e, 10, "vec_id", "embedding", "vec_id", "embedding", exclude_self=True)
    r = SR.recall(approx, exact).first().recall
    assert r >= 0.8


def test_cosine_and_codecs(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<double>, b array<double>")
    r = df.select(V.cosine("a", "b").alias("c"), V.norm(V.l2_normalize("a")).alias("n"),
                  F.size(V.decode_f32_bytes(V.encode_f32_bytes("a"))).alias("d"),
                  V.decode_json_vector(V.encode_json_vector("a")).alias("j")).first()
    assert abs(r.c - 0.96) < 1e-9 and abs(r.n - 1.0) < 1e-6 and r.d == 2 and r.j == [3.0, 4.0]


def test_hash_embed_is_unit_and_sparse(spark):
    df = spark.createDataFrame([("hello hello world",), ("",), ("!!!",)], "t string")
    rows = df.select(V.hash_embed("t").alias("v")).collect()
    v = np.asarray(rows[0].v)
    assert len(v) == V.HASH_DIM and abs(np.linalg.norm(v) - 1) < 1e-6 and (v > 0).sum() <= 2
    assert rows[1].v is None and rows[2].v is None


def test_arrow_and_jvm_embeddings_agree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select(V.hash_embed("text").alias("a"), V.hash_embed_jvm("text").alias("b")).collect()
    assert all((r.a is None and r.b is None) or (r.a is not None and r.b is not None and r.a == r.b) for r in rows)


def test_blocked_knn_many_cells_equals_broadcast(spark):
    """Many (item block, query block) cells: the cogroup keys must co-locate."""
    df, v, ids = _vectors(spark, n=600, dim=12, seed=9)
    a = SR.knn(df, df, 7, "id", "vec", "id", "vec", exclude_self=True)
    b = SR.knn(df, df, 7, "id", "vec", "id", "vec", exclude_self=True, query_block=24)
    assert _as_map(a) == _as_map(b) == _brute(v, ids, 7)


def test_ann_on_clusters_probes_a_tenth(spark):
    """On clustered vectors a tenth of the cells finds 85 % of the neighbours;
    small parts on both sides of a cell don't change the answer."""
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(40, 16)) * 3
    rows = [(i, (centers[i % 40] + rng.normal(size=16) * 0.3).astype(np.float32).tolist()) for i in range(1600)]
    df = spark.createDataFrame(rows, "id long, vec array<float>")
    exact = SR.knn(df, df, 10, "id", "vec", "id", "vec", exclude_self=True)
    approx = SR.ann(df, df, 10, "id", "vec", "id", "vec", exclude_self=True, probe_fraction=0.1)
    assert SR.recall(approx, exact).first().recall >= 0.85
    split = SR.ann(df, df, 10, "id", "vec", "id", "vec", exclude_self=True, probe_fraction=0.1, block_rows=7)
    assert _as_map(split) == _as_map(approx)


def test_blocks_share_passes_over_the_items(spark, monkeypatch):
    """Many small blocks of queries are answered by a few passes, not one each."""
    df, v, ids = _vectors(spark, n=600, dim=12, seed=9)
    passes = []
    scored = SR._knn_broadcast
    monkeypatch.setattr(SR, "_knn_broadcast", lambda *a: passes.append(1) or scored(*a))
    hits = SR.knn(df, df, 7, "id", "vec", "id", "vec", exclude_self=True, query_block=10)
    assert _as_map(hits) == _brute(v, ids, 7) and len(passes) == 1
    monkeypatch.setattr(SR, "PASS_BYTES", 200 * (8 * 12 + 120 * 7))
    passes.clear()
    hits = SR.knn(df, df, 7, "id", "vec", "id", "vec", exclude_self=True, query_block=10)
    assert _as_map(hits) == _brute(v, ids, 7) and len(passes) == 3


def test_running_best_on_odd_vectors():
    """Copies, zeros, tiny, huge and non-finite vectors rank as by full float64 scores."""
    rng = np.random.default_rng(2)
    m = rng.normal(size=(300, 16))
    m[rng.integers(0, 300, 150)] = m[0]
    m[10:14], m[20], m[21], m[22, 0], m[23, 1] = 0, m[20] * 1e-8, m[21] * 1e30, np.nan, np.inf
    ids = rng.permutation(300).astype(np.int64)
    with np.errstate(all="ignore"):
        norm = np.linalg.norm(m, axis=1)
        for exclude_self in (True, False):
            want = SR._local_topk(ids, m, norm, ids, m, norm, 5, exclude_self)
            for block, batch in ((7, 300), (300, 40), (64, 6)):
                best = SR.Best(ids, m, norm, 5, exclude_self, block)
                for s in range(0, 300, batch):
                    best.add(ids[s:s + batch], m[s:s + batch], norm[s:s + batch])
                key = ["query_id", "rank"]
                got, full = (x.sort_values(key).reset_index(drop=True) for x in (best.hits(), want))
                assert got[["query_id", "item_id", "rank"]].equals(full[["query_id", "item_id", "rank"]])
                assert np.allclose(got["score"], full["score"], rtol=0, atol=2e-9)


def test_ann_sends_a_query_once_to_a_group_of_cells(spark):
    """Rows that queries become grow with the groups of cells, not with the cells probed."""
    sizes = np.full(700, 1000)
    assert len(set(SR._grouped(sizes, 32_768))) == 22
    assert list(SR._grouped(np.array([5, 0, 90_000, 3, 3]), 10)) == [0, 0, 0, 1, 1]
    df, v, ids = _vectors(spark, n=600, dim=12, seed=9)
    asked = SR.ann(df, df, 7, "id", "vec", "id", "vec", exclude_self=True, n_cells=24, n_probe=24)
    assert _as_map(asked) == _brute(v, ids, 7)
    split = SR.ann(df, df, 7, "id", "vec", "id", "vec", exclude_self=True, n_cells=24, n_probe=24, block_rows=4)
    assert _as_map(split) == _brute(v, ids, 7)
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    assert "probed" in plan and "grp" in plan


def test_few_items_are_searched_where_the_text_is_embedded(spark):
    texts = [(0, "alpha beta"), (1, None), (2, "..."), (3, "gamma"), (3, "gamma"), (4, "beta beta alpha delta")]
    q = spark.createDataFrame(texts, "query_id long, t string").select("query_id", V.hash_embed("t").alias("vec"))
    items = spark.createDataFrame([(7, "alpha"), (5, "beta"), (9, "beta")], "item_id long, t string").select("item_id", V.hash_embed("t").alias("vec"))
    few = SR.knn(q, items, 2, small_items=10, embedded=True)
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "item_id", "score", "rank", "best_score").collect())
    assert sorted(set(rows(few))) == rows(SR.knn(q.dropDuplicates(["query_id"]), items, 2)) and len(rows(few)) == 8
    assert [r[:2] for r in rows(few) if r[0] in (0, 3)] == [(0, 5), (0, 7), (3, 5), (3, 5), (3, 7), (3, 7)]
    own = SR.knn(items.withColumnRenamed("item_id", "query_id"), items, 5, small_items=10, exclude_self=True, embedded=True)
    assert sorted((r.query_id, r.item_id, r.rank) for r in own.collect()) == [(5, 7, 2), (5, 9, 1), (7, 5, 1), (7, 9, 2), (9, 5, 1), (9, 7, 2)]
    unnamed = q.where("query_id = 0").withColumn("query_id", F.lit(None).cast("long"))
    assert {r.query_id for r in SR.knn(unnamed, items, 2, small_items=10, embedded=True).collect()} == {-2 ** 63}
    # one Python step, not a worker that embeds beside one that searches
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "MapInPandas" not in plan


def test_candidates_dont_grow_with_the_files_of_items(spark, monkeypatch):
    """A task returns its best for every query, so a pass has few tasks however many files the items fill."""
    df, v, ids = _vectors(spark, n=600, dim=12, seed=9)
    cores, folders, write = spark.sparkContext.defaultParallelism, {}, SR.write_staged
    monkeypatch.setattr(SR, "write_staged", lambda d, s, name, *a: folders.setdefault(name, write(d, s, name, *a)))
    monkeypatch.setattr(SR, "spread", lambda d: d.repartition(6 * cores))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        hits = SR.knn(df, df, 7, "id", "vec", "id", "vec", exclude_self=True, query_block=64)
        assert _as_map(hits) == _brute(v, ids, 7)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    written = spark.read.parquet(folders["knn-candidates-0"]).count()
    print("candidates", written, 600 * 7 * 2 * cores)
    assert written <= 600 * 7 * 2 * cores
