import math
import random

import numpy as np

from tessera.llm.topk import Blocks, top_k


def brute(rows, queries, k):
    q = lambda v: [math.floor(256 * x) for x in v]
    ok = [(i, q(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {(i, tuple(q(v))) for i, v in queries if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, v in asked:
        s = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != i)[:k]
        out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


def test_brute_force_with_ties_and_bad_vectors(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.25, 0.5]) for _ in range(6)]) for i in range(200)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] + [0.0] * 5), (None, [1.0] * 6),
             (304, []), (350, [0.5, 0.5]), rows[7], rows[50], rows[50]]
    df = spark.createDataFrame([(i, v, "clash", 5, 5) for i, v in rows], "vec_id long, embedding array<float>, v string, shard int, score int")
    want = brute(rows, [r for r in rows if r[0] is not None and r[0] % 50 == 0], 5)
    for sizes in ((16384, 2048, 256), (40, 2, 8)):
        got = top_k(df, df.where("vec_id % 50 = 0"), 5, shard_rows=sizes[0], query_rows=sizes[1], block_rows=sizes[2])
        assert sorted(map(tuple, got.collect())) == want
    assert top_k(df.where("1 = 0"), df, 5).count() == 0 and top_k(df, df.where("1 = 0"), 5).count() == 0
    assert top_k(df.limit(2), df.limit(2), 5).count() <= 2


def test_blocks_are_pruned_where_bounds_allow():
    rng = np.random.default_rng(0)
    centers = rng.integers(-200, 200, (20, 16))
    rows = np.concatenate([c + rng.integers(-3, 4, (64, 16)) for c in centers])
    b = Blocks(np.arange(len(rows)), rows, 210, 64)
    score, found, hits, read = b.search(np.arange(0, len(rows), 64), rows[::64], 5)
    full = rows[::64] @ rows.T
    full[np.arange(20), np.arange(0, len(rows), 64)] = -10 ** 9
    assert (score == -np.sort(-full, axis=1)[:, :5]).all()
    assert read.mean() < 10 and (hits == 5).all()


def test_large_components_stay_exact():
    rows = np.array([[2 ** 30, 1], [2 ** 30, 2], [-2 ** 30, 3]], np.int64)
    score, found, _, _ = Blocks(np.arange(3), rows, 2 ** 30, 2).search(np.array([9]), np.array([[2 ** 30, 1]]), 2)
    assert score.tolist() == [[2 ** 60 + 2, 2 ** 60 + 1]] and found.tolist() == [[1, 0]]
