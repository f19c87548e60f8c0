"""Vector search: exact top-k, best match, thresholded search, approximate search.

Exact k-nearest neighbours sets the queries against all items in blocks and
moves no item: queries, of bounded size, are broadcast; every item partition
scores its rows against a block of them after another and keeps one running
top-k per query, so a task returns at most ``k`` rows per query however many
batches it reads.  Products in float32 tell which pairs can be among the best,
by an error bound; only those are scored in float64.  A final ``row_number() <=
k`` per query (partial WindowGroupLimit before the shuffle) merges the
partitions' candidates.  Query sets of more than one block are written once, as
are the items; as many blocks as ``PASS_BYTES`` holds share a pass over the
items, and the candidates are written pass by pass.

Scores are cosine similarities accumulated in float64, rounded to 9 places
before ranking so that equal vectors tie exactly; ties go to the smaller
item id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.vectors import EPS, valid_vectors
from tessera.session import spread
from tessera.sources.writes import write_staged

QUERY_BLOCK = 8_192               # queries that are scored together
PASS_BYTES = 128 << 20            # queries of a pass over the items and their candidates, in a worker
MAX_BROADCAST_BYTES = 256 << 20   # float64 matrix held by every executor
BLOCK_ROWS = 4_096                # rows per side of an approximate-search block
GROUP_BLOCKS = 8                  # blocks per side of an approximate-search group
GROUP_BYTES = 64 << 20            # float32 vectors per side of a group, whatever their dimension

HIT_SCHEMA = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("item_id", T.LongType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("rank", T.IntegerType()),
])


def _matrix(vecs) -> np.ndarray:
    m = np.vstack([np.asarray(v, dtype=np.float64) for v in vecs])
    n = np.linalg.norm(m, axis=1)
    return m, n


def _collect_side(df: DataFrame, id_col: str, vec_col: str, max_rows: int, limit_bytes: bool = True,
                  as_given: bool = False):
    """Collect a side proven small as Arrow (ids, float64 matrix, norms), or
    None when it has more than ``max_rows`` rows or its matrix would exceed
    ``MAX_BROADCAST_BYTES``.  At most ``max_rows + 1`` rows are read.  The matrix
    of float32 vectors stays float32 with ``as_given``."""
    tbl = df.limit(max_rows + 1).toArrow()
    if tbl.num_rows > max_rows:
        return None
    if tbl.num_rows == 0:
        return np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0)
    ids = tbl.column(id_col).to_numpy()
    lists = tbl.column(vec_col).combine_chunks()
    lens = np.diff(lists.offsets.to_numpy())
    if lens.min() == lens.max():
        vals = lists.values.to_numpy(zero_copy_only=False)
        start = lists.offsets.to_numpy()[0]
        m = vals[start:start + lens.sum()].reshape(len(lens), int(lens[0]))
        if not (as_given and m.dtype == np.float32):
            m = m.astype(np.float64)
    else:
        m = np.vstack([np.asarray(v, dtype=np.float64) for v in lists.to_pylist()])
    if limit_bytes and m.nbytes > MAX_BROADCAST_BYTES:
        return None
    return ids.astype(np.int64), m, _norms(m)


def _norms(m: np.ndarray) -> np.ndarray:
    """Norms in float64, some rows at a time."""
    step = max(1, MAX_CELLS // 8 // max(1, m.shape[1]))
    return np.concatenate([np.linalg.norm(m[s:s + step].astype(np.float64), axis=1)
                           for s in range(0, len(m), step)] or [np.zeros(0)])


def _empty_hits() -> pd.DataFrame:
    return pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "item_id": pd.Series([], dtype="int64"),
                         "score": pd.Series([], dtype="float64"), "rank": pd.Series([], dtype="int32")})


def _local_topk(q_ids, q_mat, q_norm, i_ids, i_mat, i_norm, k, exclude_self, q_names=None):
    """Top-k per query of one block, vectorised; exact at the k-th place
    (rows with ties across the cut are resolved one by one by item id).
    Returns query_id (of ``q_names`` if given), item_id, score and the in-block rank."""
    sims = np.round((q_mat @ i_mat.T) / (np.outer(q_norm, i_norm) + EPS), 9)
    if exclude_self:
        sims[q_ids[:, None] == i_ids[None, :]] = -np.inf
    nq, ni = sims.shape
    kk = min(k, ni)
    if nq == 0 or kk == 0:
        return _empty_hits()
    ids2 = np.broadcast_to(i_ids, sims.shape)
    if ni <= 4 * kk or ni <= 64:
        sel = np.lexsort((ids2, -sims), axis=1)[:, :kk]
    else:
        part = np.argpartition(-sims, kk - 1, axis=1)[:, :kk]
        ps = np.take_along_axis(sims, part, 1)
        order = np.lexsort((np.take_along_axis(ids2, part, 1), -ps), axis=1)
        sel = np.take_along_axis(part, order, 1)
        kth = np.take_along_axis(sims, sel[:, -1:], 1)[:, 0]
        tied = np.nonzero((sims >= kth[:, None]).sum(axis=1) > kk)[0]
        for r in tied:  # ties straddle the cut: pick the smallest ids among equals
            cand = np.nonzero(sims[r] >= kth[r])[0]
            sel[r] = cand[np.lexsort((i_ids[cand], -sims[r, cand]))[:kk]]
    sc = np.take_along_axis(sims, sel, 1)
    keep = np.isfinite(sc).reshape(-1)
    return pd.DataFrame({"query_id": np.repeat(q_ids if q_names is None else q_names, kk)[keep],
                         "item_id": i_ids[sel].reshape(-1)[keep],
                         "score": sc.reshape(-1)[keep],
                         "rank": np.tile(np.arange(1, kk + 1, dtype=np.int32), nq)[keep]})


MAX_CELLS = 16_000_000   # similarity cells per matrix product (128 MB of float64)
ITEM_CELLS = 1_000_000   # similarities held at a time where few items are broadcast


def _topk_chunked(q_ids, q_mat, q_norm, i_ids, i_mat, i_norm, k, exclude_self) -> pd.DataFrame:
    """:func:`_local_topk` over query slices so one similarity matrix never
    exceeds ``MAX_CELLS`` (memory per task stays bounded whatever the
    broadcast and Arrow batch sizes)."""
    step = max(1, MAX_CELLS // max(1, len(i_ids)))
    if len(q_ids) <= step:
        return _local_topk(q_ids, q_mat, q_norm, i_ids, i_mat, i_norm, k, exclude_self)
    parts = [_local_topk(q_ids[s:s + step], q_mat[s:s + step], q_norm[s:s + step], i_ids, i_mat, i_norm, k,
                         exclude_self) for s in range(0, len(q_ids), step)]
    return pd.concat(parts, ignore_index=True)


SLICE_CELLS = 4_000_000   # float32 similarities held at a time
PAIRS = 16_384            # pairs scored in float64 at a time


def _tame(norm: np.ndarray) -> np.ndarray:
    """Vectors whose float32 similarity is within :attr:`Best.margin` of the score:
    those without length, and those whose norms ``EPS`` changes by 1e-6 at most."""
    return (norm == 0) | ((norm >= 1e-3) & (norm <= 1e100))


def _unit(m: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """float32 unit vectors; zero for vectors without length and others that aren't tame."""
    good = _tame(norm) & (norm > 0)
    out = np.zeros(m.shape, np.float32)
    np.divide(m, np.where(good, norm, 1.0)[:, None], out=out, where=good[:, None], casting="unsafe")
    return out


class Best:
    """The running ``k`` best items of each query.

    ``least`` is what a pair's float32 similarity must reach to be scored: the
    query's k-th best score so far, or the k-th similarity of a batch, less the
    error bound.  Pairs that can't be told apart (many ties) and vectors that
    aren't tame go through :func:`_local_topk`."""

    def __init__(self, q_ids, q_mat, q_norm, k: int, exclude_self: bool, block: int = QUERY_BLOCK):
        order = np.argsort(q_ids, kind="stable")
        if (order[1:] < order[:-1]).any():
            q_ids, q_mat, q_norm = q_ids[order], q_mat[order], q_norm[order]
        self.ids, self.mat, self.norm = q_ids, q_mat, q_norm
        self.k, self.exclude_self, self.block = k, exclude_self, block
        self.unit = _unit(q_mat, q_norm)
        self.rough = np.flatnonzero(~_tame(q_norm))
        self.margin = (q_mat.shape[1] + 8) * 2.0 ** -23 + 1.1e-6
        self.least = np.full(len(q_ids), -2.0, np.float32)
        self.least[self.rough] = np.inf
        self.held, self.size = [], 0

    def add(self, i_ids, i_mat, i_norm, rows: np.ndarray | None = None) -> None:
        """Score items against all queries, or those at ``rows`` (ascending)."""
        tame = _tame(i_norm)
        if not tame.all():
            self._scored(np.arange(len(self.ids)) if rows is None else rows, i_ids[~tame], i_mat[~tame], i_norm[~tame])
            i_ids, i_mat, i_norm = i_ids[tame], i_mat[tame], i_norm[tame]
        if not len(i_ids):
            return
        rough = self.rough if rows is None else np.intersect1d(self.rough, rows)
        if len(rough):
            self._scored(rough, i_ids, i_mat, i_norm)
        unit = _unit(i_mat, i_norm)
        n = len(self.ids) if rows is None else len(rows)
        step = max(1, min(self.block, SLICE_CELLS // len(i_ids)))
        for s in range(0, n, step):
            part = slice(s, min(n, s + step)) if rows is None else rows[s:s + step]
            self._slice(part, i_ids, i_mat, i_norm, unit)
            if self.size > 2 * self.k * len(self.ids) + PAIRS:
                self._merge()

    def _slice(self, part, i_ids, i_mat, i_norm, i_unit) -> None:
        k, q_ids, least = self.k, self.ids[part], self.least[part]
        sims = self.unit[part] @ i_unit.T
        rows, n = sims.shape
        if self.exclude_self:  # q_ids ascend
            low = np.searchsorted(q_ids, i_ids, "left")
            size = np.searchsorted(q_ids, i_ids, "right") - low
            at = np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)
            sims[at, np.repeat(np.arange(n), size)] = -np.inf
        hit = sims >= least[:, None]
        many = np.count_nonzero(hit)
        if n > k and many > 2 * k * rows:
            kth = np.partition(sims, n - k, axis=1)[:, n - k]
            least = np.maximum(least, kth - np.float32(2 * self.margin))
            self.least[part] = least
            hit = sims >= least[:, None]
            many = np.count_nonzero(hit)
        number = np.arange(part.start, part.stop) if isinstance(part, slice) else part
        if many > 64 * rows and many > hit.size // 16:
            self._scored(number[np.isfinite(least)], i_ids, i_mat, i_norm)
            return
        at = np.flatnonzero(hit)
        row, col = number[at // n], at % n
        for s in range(0, len(row), PAIRS):
            r, c = row[s:s + PAIRS], col[s:s + PAIRS]
            dots = np.einsum("ij,ij->i", self.mat[r].astype(np.float64), i_mat[c].astype(np.float64))
            self._hold(r, i_ids[c], np.round(dots / (self.norm[r] * i_norm[c] + EPS), 9))

    def _scored(self, rows, i_ids, i_mat, i_norm) -> None:
        """Every pair in float64."""
        step = max(1, MAX_CELLS // len(i_ids))
        for s in range(0, len(rows), step):
            r = rows[s:s + step]
            # of repeated query ids each row is answered: rows stand for them
            found = _local_topk(self.ids[r], self.mat[r], self.norm[r], i_ids, i_mat, i_norm, self.k, self.exclude_self, r)
            self._hold(found["query_id"].to_numpy(), found["item_id"].to_numpy(), found["score"].to_numpy())

    def _hold(self, row, ids, score) -> None:
        self.held.append((row, ids, score))
        self.size += len(row)

    def _merge(self) -> None:
        row, ids, score = (np.concatenate(c) for c in zip(*self.held))
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = place == self.k - 1
        self.least[row[last]] = np.maximum(self.least[row[last]], (score[last] - self.margin).astype(np.float32))
        good = place < self.k
        self.held, self.size = [(row[good], ids[good], score[good])], int(good.sum())

    def hits(self) -> pd.DataFrame:
        """Rows of :data:`HIT_SCHEMA`."""
        if not self.held:
            return _empty_hits()
        self._merge()
        row, ids, score = self.held[0]
        rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
        return pd.DataFrame({"query_id": self.ids[row], "item_id": ids, "score": score, "rank": rank.astype(np.int32)})


def _final_topk(cands: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("item_id"))
    return (cands.drop("rank").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                 .withColumn("best_score", F.max("score").over(Window.partitionBy("query_id"))))


def knn(queries: DataFrame, items: DataFrame, k: int, q_id: str = "query_id", q_vec: str = "vec",
        i_id: str = "item_id", i_vec: str = "vec", exclude_self: bool = False,
        query_block: int = QUERY_BLOCK, small_items: int = 0, embedded: bool = False) -> DataFrame:
    """Exact top-``k`` items per query by cosine similarity.

    Returns ``query_id, item_id, score, rank`` (rank 1 = most similar).
    Null/empty vectors on either side are skipped.  Ids must be integers.
    With ``small_items > 0`` and an item side proven that small (a template
    or intent table), the items are broadcast instead and every query row is
    answered where it lies: no shuffle at all; with ``embedded``, where the
    query vectors are a Python embedder's column, in the worker that embeds.
    """
    given = queries.select(F.col(q_id).cast("long").alias("qid"), F.col(q_vec).alias("qv"))
    q = valid_vectors(given, "qv")
    it = valid_vectors(items, i_vec).select(F.col(i_id).cast("long").alias("iid"),
                                            F.col(i_vec).alias("iv"))
    if small_items:
        side = _collect_side(it, "iid", "iv", small_items)
        if side is not None:
            if embedded:
                return _knn_items_embedded(given, side, k, exclude_self)
            return _knn_items_broadcast(q, side, k, exclude_self)
    side = _collect_side(q, "qid", "qv", query_block)
    if side is not None:
        cands = _knn_broadcast(q.sparkSession, side, it, k, exclude_self, query_block)
    else:
        cands = _knn_blocks(q, it, k, exclude_self, query_block)
    return _final_topk(cands, k)


def _knn_broadcast(spark: SparkSession, side, it: DataFrame, k: int, exclude_self: bool,
                   block: int = QUERY_BLOCK) -> DataFrame:
    """``side``: (ids, matrix, norms) of the queries, proven within budget."""
    q_ids, q_mat, q_norm = side
    if len(q_ids) == 0:
        return spark.createDataFrame([], HIT_SCHEMA)
    bc = spark.sparkContext.broadcast((q_ids, q_mat, q_norm))

    def score(batches):
        best = None
        for pdf in batches:
            if pdf.empty:
                continue
            best = best or Best(*bc.value, k, exclude_self, block)
            best.add(pdf["iid"].to_numpy(np.int64), *_matrix(pdf["iv"]))
        if best:
            yield best.hits()

    return it.mapInPandas(score, HIT_SCHEMA)


RANKED_SCHEMA = T.StructType(HIT_SCHEMA.fields + [T.StructField("best_score", T.DoubleType())])


def _knn_items_broadcast(q: DataFrame, side, k: int, exclude_self: bool) -> DataFrame:
    """``side``: (ids, matrix, norms) of the items, proven small.  Every
    query row is answered completely where it lies (no shuffle)."""
    spark = q.sparkSession
    i_ids, i_mat, i_norm = side
    if len(i_ids) == 0:
        return spark.createDataFrame([], RANKED_SCHEMA)
    bc = spark.sparkContext.broadcast((i_ids, i_mat, i_norm))

    def score(batches):
        ii, im, inn = bc.value
        for pdf in batches:
            if pdf.empty:
                continue
            q_mat, q_norm = _matrix(pdf["qv"])
            out = _topk_chunked(pdf["qid"].to_numpy(np.int64), q_mat, q_norm, ii, im, inn, k, exclude_self)
            out["best_score"] = out.groupby("query_id", sort=False)["score"].transform("max")
            yield out

    return q.mapInPandas(score, RANKED_SCHEMA)


def _knn_items_embedded(q: DataFrame, side, k: int, exclude_self: bool) -> DataFrame:
    """:func:`_knn_items_broadcast` of vectors that Python embeds.  A search takes
    the vectors alone where it can: Spark runs it in the worker that embeds the
    text, and neither a second worker nor the vectors' way to it is needed."""
    spark = q.sparkSession
    i_ids, i_mat, i_norm = side
    if len(i_ids) == 0:
        return spark.createDataFrame([], RANKED_SCHEMA)
    bc = spark.sparkContext.broadcast((i_ids, i_mat, i_norm))

    def score(vecs: pa.Array, ids: np.ndarray) -> pa.Array:
        ii, im, inn = bc.value
        valid = np.flatnonzero(pc.fill_null(pc.greater(pc.list_value_length(vecs), 0), False).to_numpy(zero_copy_only=False))
        size, parts = np.zeros(len(vecs), np.int64), [_empty_hits()]
        step = max(1, ITEM_CELLS // len(ii))
        for s in range(0, len(valid), step):
            at = valid[s:s + step]
            q_mat, q_norm = _matrix(vecs.take(pa.array(at)).to_numpy(zero_copy_only=False))
            parts.append(_local_topk(ids[at], q_mat, q_norm, ii, im, inn, k, exclude_self, at))
            size += np.bincount(parts[-1]["query_id"], minlength=len(vecs))
        out = pd.concat(parts[1:] or parts, ignore_index=True)
        best = out.groupby("query_id", sort=False)["score"].transform("max")
        names = [f.name for f in RANKED_SCHEMA.fields[1:]]
        rows = pa.StructArray.from_arrays([pa.array(c) for c in (out["item_id"], out["score"], out["rank"], best)], names)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), rows)

    hits = T.ArrayType(T.StructType(RANKED_SCHEMA.fields[1:]))
    if exclude_self:
        @F.arrow_udf(hits)
        def near(vecs: pa.Array, ids: pa.Array) -> pa.Array:
            return score(vecs, ids.to_numpy(zero_copy_only=False))
        found = near.asNondeterministic()("qv", F.coalesce("qid", F.lit(-2 ** 63)))
    else:
        @F.arrow_udf(hits)
        def near(vecs: pa.Array) -> pa.Array:
            return score(vecs, np.arange(len(vecs)))
        found = near.asNondeterministic()("qv")
    # not deterministic: else a filter on the hits would search a second time
    # a query without an id goes by the smallest long, as ids travel as integers
    return q.select(F.coalesce("qid", F.lit(-2 ** 63)).alias("query_id"), found.alias("hits")).select("query_id", F.inline("hits"))


def _knn_blocks(q: DataFrame, it: DataFrame, k: int, exclude_self: bool, query_block: int) -> DataFrame:
    """Candidates for more queries than one block: both sides are evaluated
    once, into written tables; as many blocks of queries as ``PASS_BYTES`` holds
    pass over the items together, and their candidates are written before the
    next are broadcast."""
    spark = q.sparkSession
    q = spark.read.schema(q.schema).parquet(write_staged(q, spark, "knn-queries"))
    items = spark.read.schema(it.schema).parquet(write_staged(spread(it), spark, "knn-items"))
    # every task has candidates for every query: as many tasks as keep the cores busy, not one for each file
    items = items.coalesce(2 * spark.sparkContext.defaultParallelism)
    first = q.select(F.max(F.size("qv"))).first()[0] or 1
    # the vectors as given and as float32 units, and up to five times k candidates of 24 bytes
    given = 4 if q.schema["qv"].dataType.elementType == T.FloatType() else 8
    rows = max(1, PASS_BYTES // ((given + 4) * first + 120 * k))
    passes = max(1, math.ceil(q.count() / rows))
    dealt = q.repartition(passes).withColumn("blk", F.spark_partition_id())
    path = write_staged(dealt, spark, "knn-blocks", ["blk"])
    out = None
    for i in range(passes):
        # dealt round robin, a pass has its share of the rows and a few more
        part = spark.read.schema(dealt.schema).parquet(path).where(F.col("blk") == i).drop("blk")
        side = _collect_side(part, "qid", "qv", 2 * rows + 1000, limit_bytes=False, as_given=True)
        cands = write_staged(_knn_broadcast(spark, side, items, k, exclude_self, query_block), spark, f"knn-candidates-{i}")
        found = spark.read.schema(HIT_SCHEMA).parquet(cands)
        out = found if out is None else out.unionByName(found)
    return out


def best_match(queries: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """Single most similar item per query."""
    return knn(queries, items, 1, **kw).drop("rank")


def threshold(hits: DataFrame, min_similarity: float | None = None,
              max_distance: float | None = None) -> DataFrame:
    c = F.lit(True)
    if min_similarity is not None:
        c = c & (F.col("score") >= min_similarity)
    if max_distance is not None:
        c = c & ((F.lit(1.0) - F.col("score")) < max_distance)
    return hits.where(c)


# ---------------------------------------------------------------------------
# Approximate search: inverted-file cells (k-means), probed cells re-scored exactly
# ---------------------------------------------------------------------------

PROBE_SCHEMA = T.StructType([T.StructField("qid", T.LongType()), T.StructField("qv", T.ArrayType(T.FloatType())),
                             T.StructField("probed", T.BinaryType()), T.StructField("groups", T.ArrayType(T.IntegerType()))])


def _grouped(sizes: np.ndarray, rows: int) -> np.ndarray:
    """A group for each cell: neighbouring cells of about ``rows`` items together."""
    before = np.cumsum(sizes) - sizes
    return np.unique(before // max(1, rows), return_inverse=True)[1].reshape(-1).astype(np.int32)


def ann(queries: DataFrame, items: DataFrame, k: int, q_id: str = "query_id", q_vec: str = "vec",
        i_id: str = "item_id", i_vec: str = "vec", exclude_self: bool = False, n_cells: int | None = None,
        n_probe: int | None = None, probe_fraction: float = 0.6, block_rows: int = BLOCK_ROWS,
        seed: int = 7, max_iter: int = 10, train_rows: int = 200_000) -> DataFrame:
    """Approximate top-``k`` by cosine (re-aim of an HNSW index).

    Items are clustered into ``n_cells`` cells with MLlib k-means (cosine
    distance), fitted on at most ``train_rows`` items; every item is assigned.
    The number of cells grows as the square root of the items (up to what
    ``MAX_BROADCAST_BYTES`` of centres holds).  Each query probes its
    ``n_probe`` nearest cell centres and is scored exactly against the items of
    those cells only.  Cells travel in groups of some blocks of ``block_rows``
    items, so a query is sent once to a group, with a bit for each cell it probes,
    and not once to each cell.  Both sides of a group are split by hash into parts
    of that size, so neither a cell with many items nor one that many queries
    probe lands in one task, and a task's similarity matrix is cut to
    ``SLICE_CELLS``.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = queries.sparkSession
    q = valid_vectors(queries, q_vec).select(F.col(q_id).cast("long").alias("qid"), F.col(q_vec).alias("qv"))
    it = valid_vectors(items, i_vec).select(F.col(i_id).cast("long").alias("iid"), F.col(i_vec).alias("iv"))
    n_items = it.count()
    if n_items == 0:
        return _final_topk(spark.createDataFrame([], HIT_SCHEMA), k)
    dim = it.select(F.max(F.size("iv"))).first()[0]
    cells = n_cells or max(1, min(int(math.sqrt(n_items)), MAX_BROADCAST_BYTES // (8 * dim)))
    feats = it.withColumn("features", array_to_vector("iv"))
    # centres are trained on a bounded sample (all items are still assigned
    # and searched); k-means iterations then cost O(train_rows), not O(items)
    train = feats if n_items <= train_rows else feats.sample(fraction=train_rows / n_items, seed=seed)
    model = KMeans(k=cells, seed=seed, maxIter=max_iter, distanceMeasure="cosine",
                   featuresCol="features", predictionCol="cell").fit(train)
    centers = np.vstack(model.clusterCenters())
    centers = centers / (np.linalg.norm(centers, axis=1, keepdims=True) + EPS)
    bc = spark.sparkContext.broadcast(centers)
    # probes: explicit count, else a share of the cells (vectors without
    # cluster structure need a large share for good recall)
    probe = min(n_probe or max(1, math.ceil(probe_fraction * centers.shape[0])), centers.shape[0])

    assigned = model.transform(feats).select("iid", "iv", F.col("cell").cast("int").alias("cell"))
    # one number per cell, of which there are no more than the centres
    sizes = np.zeros(centers.shape[0], np.int64)
    for cell, n in assigned.groupBy("cell").count().collect():
        sizes[cell] = n
    side = max(1, min(GROUP_BLOCKS * block_rows, GROUP_BYTES // (4 * dim)))
    group = _grouped(sizes, side)
    n_groups = int(group.max()) + 1
    i_split = np.maximum(1, np.ceil(np.bincount(group, sizes) / side)).astype(int)
    cores = spark.sparkContext.defaultParallelism
    q_split = max(1, math.ceil(q.count() / side), math.ceil(cores / int(i_split.sum())))
    place = spark.sparkContext.broadcast(group)

    def nearest_cells(batches):
        c, g = bc.value, place.value
        step = max(1, BLOCK_ROWS // n_groups)   # rows that a batch becomes once they are sent to their groups
        for pdf in batches:
            for s in range(0, len(pdf), step):
                part = pdf.iloc[s:s + step]
                m = np.vstack([np.asarray(v, dtype=np.float64) for v in part["qv"]])
                m = m / (np.linalg.norm(m, axis=1, keepdims=True) + EPS)
                top = np.argsort(-(m @ c.T), axis=1)[:, :probe]
                probed = np.zeros((len(m), len(c)), bool)
                probed[np.arange(len(m))[:, None], top] = True
                yield pd.DataFrame({"qid": part["qid"].to_numpy(np.int64), "qv": part["qv"].to_numpy(),
                                    "probed": [x.tobytes() for x in np.packbits(probed, axis=1)],
                                    "groups": [np.unique(g[t]) for t in top]})

    numbers = lambda values: F.array(*[F.lit(int(x)) for x in values])
    of_cell, splits = numbers(group), numbers(i_split)
    i_parts = assigned.withColumn("grp", F.get(of_cell, F.col("cell"))) \
        .withColumn("ip", F.pmod(F.xxhash64("iid", "iv"), F.get(splits, F.col("grp"))).cast("int")) \
        .select("grp", "ip", F.explode(F.sequence(F.lit(0), F.lit(q_split - 1))).alias("qp"), "cell", "iid", "iv")
    q_parts = q.mapInPandas(nearest_cells, PROBE_SCHEMA) \
        .withColumn("qp", F.pmod(F.xxhash64("qid", "qv"), F.lit(q_split)).cast("int")) \
        .select("qid", "qv", "probed", "qp", F.explode("groups").alias("grp")) \
        .withColumn("ip", F.explode(F.sequence(F.lit(0), F.get(splits, F.col("grp")) - 1)))

    def cells_of_group(ipdf: pd.DataFrame, qpdf: pd.DataFrame) -> pd.DataFrame:
        if ipdf.empty or qpdf.empty:
            return _empty_hits()
        q_mat, q_norm = _matrix(qpdf["qv"])
        order = np.argsort(qpdf["qid"].to_numpy(np.int64), kind="stable")
        bits = np.frombuffer(b"".join(qpdf["probed"]), np.uint8).reshape(len(order), -1)[order]
        best = Best(qpdf["qid"].to_numpy(np.int64)[order], q_mat[order], q_norm[order], k, exclude_self)
        for cell, items in ipdf.groupby("cell"):
            rows = np.flatnonzero(bits[:, cell >> 3] >> (7 - (cell & 7)) & 1)
            if len(rows):
                best.add(items["iid"].to_numpy(np.int64), *_matrix(items["iv"]), rows)
        return best.hits()

    cands = (i_parts.groupBy("grp", "ip", "qp").cogroup(q_parts.groupBy("grp", "ip", "qp"))
             .applyInPandas(cells_of_group, HIT_SCHEMA))
    return _final_topk(cands, k)


def recall(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of exact (query, item) hits the approximate search found."""
    hit = exact.select("query_id", "item_id").join(approx.select("query_id", "item_id", F.lit(1).alias("f")),
                                                   ["query_id", "item_id"], "left")
    return hit.agg(F.avg(F.coalesce("f", F.lit(0))).alias("recall"))
