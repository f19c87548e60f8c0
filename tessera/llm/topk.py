"""Exact top-k inner products by block-at-a-time pruning.

Vectors are cut into shards, and a shard into blocks of neighbouring ids.  A
block keeps, for each component ("term"), the largest and the smallest value it
holds, and its rows as a dense forward index.  For a query, the sum over terms
of the larger of the two possible products bounds every score in the block;
blocks are taken in descending order of that bound until it falls below the
query's k-th score so far.  A block whose bound equals the k-th score is still
read, as it may hold a tie with a smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: rows of a block, of a shard and of a group of queries
BLOCK, SHARD, QUERIES = 256, 16384, 2048


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """``floor(scale * x)`` of each component, or null for a vector that is
    null, empty of numbers, or holds a null or non-finite component."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)),
                  F.transform(x, lambda v: F.floor(F.lit(scale) * v).cast("bigint")))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; shorter vectors end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lens = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(lens), width), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lens)), lens)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


class Blocks:
    """The blocks of one shard, rows in ascending order of id.

    Products are integers.  They are taken in floating point, which is exact,
    unless ``largest`` (of a query's component) lets a sum pass 2**53.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, largest: int, size: int = BLOCK):
        order = np.argsort(ids, kind="stable")
        exact = float(np.abs(rows).max(initial=0)) * float(largest) * rows.shape[1] < 2.0 ** 53
        self.kind = np.float64 if exact else np.int64
        self.ids, self.rows = ids[order], rows[order].astype(self.kind)
        self.starts = np.arange(0, len(ids), size)
        self.ends = np.minimum(self.starts + size, len(ids))
        self.top = np.maximum.reduceat(self.rows, self.starts)
        self.low = np.minimum.reduceat(self.rows, self.starts)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Queries x blocks: no score of the block is above it."""
        return np.maximum(q, 0) @ self.top.T + np.minimum(q, 0) @ self.low.T

    def search(self, qids: np.ndarray, q: np.ndarray, k: int):
        """(scores, ids, number of hits) per query, best first, and the number
        of blocks read per query."""
        q = q.astype(self.kind)
        n, least, no_id = len(q), np.iinfo(np.int64).min, np.iinfo(np.int64).max
        score, found = np.full((n, k), least, np.int64), np.full((n, k), no_id, np.int64)
        hits, read = np.zeros(n, np.int64), np.zeros(n, np.int64)
        bound = self.bounds(q)
        order = np.argsort(-bound, axis=1, kind="stable")
        active = np.arange(n)
        for step in range(len(self.starts)):
            block = order[active, step]
            go_on = (hits[active] < k) | (bound[active, block] >= score[active, -1])
            active, block = active[go_on], block[go_on]
            if not len(active):
                break
            read[active] += 1
            by_block = np.argsort(block, kind="stable")
            for part in np.split(by_block, np.flatnonzero(np.diff(block[by_block])) + 1):
                rows, b = active[part], block[part[0]]
                ids = self.ids[self.starts[b]:self.ends[b]]
                s = (q[rows] @ self.rows[self.starts[b]:self.ends[b]].T).astype(np.int64)
                s[qids[rows][:, None] == ids[None, :]] = least
                least_gain = np.maximum(score[rows, -1], least + 1)
                some = s.max(1) >= least_gain
                if not some.any():
                    continue
                rows, s, least_gain = rows[some], s[some], least_gain[some]
                if len(ids) > k:  # of this block, only its own k best (and ties) can matter
                    least_gain = np.maximum(least_gain, np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k])
                at, col = np.nonzero(s >= least_gain[:, None])
                old_at, old_col = np.nonzero(np.arange(k)[None, :] < hits[rows][:, None])
                r = np.r_[at, old_at]
                v = np.r_[s[at, col], score[rows[old_at], old_col]]
                i = np.r_[ids[col], found[rows[old_at], old_col]]
                best = np.lexsort((i, -v, r))
                r, v, i = r[best], v[best], i[best]
                place = np.arange(len(r)) - np.searchsorted(r, r)
                keep = place < k
                r, v, i, place = r[keep], v[keep], i[keep], place[keep]
                score[rows[r], place], found[rows[r], place] = v, i
                hits[rows] = np.bincount(r, minlength=len(rows))
        return score, found, hits, read


def top_k(items: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          shard_rows: int = SHARD, query_rows: int = QUERIES, block_rows: int = BLOCK) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the ``k`` best
    rows of ``items`` for each row of ``queries`` by integer inner product of
    the quantised vectors, ties to the smaller id.

    Items go to shards and queries to groups, both of bounded size; each pair
    of a group and a shard is one task's work and returns at most ``k`` rows
    per query, so the queries are set against all rows in blocks and no table
    is held whole.  Rows that carry the query's own id are no candidates.  Rows
    with a null id, and vectors that are null or hold a null or non-finite
    component, take no part; an empty vector scores 0 with everything; a
    shorter vector counts as ending in zeros.  A repeated query row with the
    same vector is one query; repeated item rows each count.  Fewer candidates
    than ``k`` give fewer rows; an empty table gives none; other columns are
    not read.
    """
    def usable(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("bigint").alias("vec_id"), quantised(F.col(vector_col)).alias("v")) \
            .where("vec_id IS NOT NULL AND v IS NOT NULL")

    x, q = usable(items), usable(queries).distinct()
    shards = max(1, -(-x.count() // shard_rows))
    groups = max(1, -(-q.count() // query_rows))
    x = x.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))) \
         .withColumn("grp", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))))
    q = q.withColumn("grp", F.pmod(F.xxhash64("vec_id", "v"), F.lit(groups))) \
         .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        width = max(np.diff(t.column("v").combine_chunks().offsets.to_numpy()).max() for t in (left, right))
        qids = left.column("vec_id").to_numpy()
        q_rows = matrix(left.column("v"), width)
        b = Blocks(right.column("vec_id").to_numpy(), matrix(right.column("v"), width), int(np.abs(q_rows).max(initial=0)), block_rows)
        score, found, hits, read = b.search(qids, q_rows, k)
        row, place = np.nonzero(np.arange(k)[None, :] < hits[:, None])
        return pa.table([pa.array(qids[row]), left.column("v").take(pa.array(row)).combine_chunks(), pa.array(found[row, place]), pa.array(score[row, place]),
                         pa.array(read[row])], schema=schema)

    schema = pa.schema([("query_id", pa.int64()), ("v", pa.list_(pa.int64())), ("vec_id", pa.int64()), ("score", pa.int64()), ("blocks", pa.int64())])
    hits = q.groupBy("grp", "shard").cogroup(x.groupBy("grp", "shard")) \
        .applyInArrow(search, "query_id long, v array<long>, vec_id long, score long, blocks long")
    best = Window.partitionBy("query_id", "v").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL of the registered query over a table ``embeddings``.
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
t AS (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, sum(a.x * b.x)::BIGINT AS score
  FROM t a JOIN t b ON a.i = b.i AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 GROUP BY ALL)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
