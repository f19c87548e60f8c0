"""Registered vector-search queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.operators import graph_index as GI
from tessera.operators import search as SR
from tessera.plans.q_text import hash_vectors_sql, smart_chunks_sql
from tessera.plans.registry import query
from tessera.session import scratch_path, spread
from tessera.tables import load

_KNN_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
                  sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS nrm
           FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0),
s AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id,
             ROUND(list_dot_product(q.e, i.e) / (q.nrm * i.nrm + 1e-12), 9) AS sim
      FROM v q JOIN v i ON q.vec_id <> i.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, item_id) AS rank FROM s)
SELECT query_id, item_id, sim AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""


def _emb(spark, d):
    return load(spark, d, "embeddings").select("vec_id", "embedding")


def _out(hits):
    return hits.select("query_id", "item_id", F.col("score"), "rank")


@query("knn_exact", _KNN_SQL)
def q_knn_exact(spark, d):
    """Ten nearest other vectors of every vector (broadcast query path)."""
    e = _emb(spark, d)
    return _out(SR.knn(e, e, 10, "vec_id", "embedding", "vec_id", "embedding", exclude_self=True))


@query("knn_exact_blocked", _KNN_SQL)
def q_knn_blocked(spark, d):
    """Same answer with the queries in several blocks (of 128 here), the path of
    query sets of more than one block."""
    e = _emb(spark, d)
    return _out(SR.knn(e, e, 10, "vec_id", "embedding", "vec_id", "embedding", exclude_self=True,
                       query_block=128))


@query("knn_threshold", """
SELECT query_id, item_id, score, rank FROM (""" + _KNN_SQL.replace("rank <= 10", "rank <= 10 AND 1 - sim < 0.8") + ")")
def q_knn_threshold(spark, d):
    e = _emb(spark, d)
    hits = SR.knn(e, e, 10, "vec_id", "embedding", "vec_id", "embedding", exclude_self=True)
    return _out(SR.threshold(hits, max_distance=0.8))


_SPARSE_SIM = """
{q}_n AS (SELECT id, sqrt(SUM(weight * weight)) AS nrm FROM {q} GROUP BY id),
{i}_n AS (SELECT id, sqrt(SUM(weight * weight)) AS nrm FROM {i} GROUP BY id),
dots AS (SELECT a.id AS query_id, b.id AS item_id, SUM(a.weight * b.weight) AS dp
         FROM {q} a JOIN {i} b ON a.bucket = b.bucket GROUP BY ALL),
sims AS (SELECT d.query_id, d.item_id, ROUND(d.dp / (qn.nrm * inn.nrm + 1e-12), 9) AS sim
         FROM dots d JOIN {q}_n qn ON qn.id = d.query_id JOIN {i}_n inn ON inn.id = d.item_id)"""


def _rename_hv(sql: str, name: str) -> str:
    return sql.replace("tok AS", f"{name}_tok AS").replace("FROM tok", f"FROM {name}_tok") \
              .replace("cnt AS", f"{name}_cnt AS").replace("FROM cnt", f"FROM {name}_cnt") \
              .replace("hv AS", f"{name} AS")


@query("knn_best", "WITH " + _rename_hv(hash_vectors_sql("benchmark", "item_id", "text"), "qv") + ","
       + _rename_hv(hash_vectors_sql("documents", "doc_id", "text"), "dv") + ","
       + _SPARSE_SIM.format(q="qv", i="dv") + """
SELECT query_id AS item_id, item_id AS doc_id, sim AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, item_id) AS rk FROM sims) WHERE rk = 1""")
def q_knn_best(spark, d):
    """Best-matching document of every benchmark passage (hashed embeddings)."""
    b = load(spark, d, "benchmark").select("item_id", V.hash_embed("text").alias("vec"))
    docs = spread(load(spark, d, "documents")).select("doc_id", V.hash_embed("text").alias("vec"))
    best = SR.best_match(b, docs, q_id="item_id", q_vec="vec", i_id="doc_id", i_vec="vec")
    return best.select(F.col("query_id").alias("item_id"), F.col("item_id").alias("doc_id"),
                       F.col("score"))


def chunk_vectors(spark, d):
    """Document chunks with a numeric chunk key and hashed embedding."""
    ch = X.smart_chunks(load(spark, d, "documents"), "text", 350, 40, True, ("doc_id",))
    return ch.select("doc_id", "chunk_ix", "content",
                     (F.col("doc_id") * 1_000_000 + F.col("chunk_ix")).alias("chunk_uid"),
                     V.hash_embed("content").alias("vec"))


def user_prompts(spark, d):
    c = load(spark, d, "conversations").where(F.col("role") == "user")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("prompt_id"), F.col("text").alias("prompt"))


def rag_search(spark, d, k: int = 8, max_distance: float = 0.8):
    """Top-k chunks per user prompt with distance below the threshold, with
    the owning document's title."""
    prompts = user_prompts(spark, d).select("prompt_id", V.hash_embed("prompt").alias("vec"))
    chunks = chunk_vectors(spark, d)
    hits = SR.threshold(SR.knn(prompts, chunks, k, "prompt_id", "vec", "chunk_uid", "vec"),
                        max_distance=max_distance)
    docs = load(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("title"))
    return (hits.withColumn("doc_id", F.expr("item_id div 1000000"))
                .join(docs, "doc_id")
                .select(F.col("query_id").alias("prompt_id"), F.col("item_id").alias("chunk_uid"),
                        "title", F.col("score"), "rank"))


@query("rag_search", "WITH RECURSIVE " + smart_chunks_sql() + ","
       + "prompts AS (SELECT conv_id * 1000 + turn AS prompt_id, text FROM conversations WHERE role = 'user'),"
       + "chunk_src AS (SELECT doc_id * 1000000 + chunk_ix AS chunk_uid, content FROM chunks),"
       + _rename_hv(hash_vectors_sql("prompts", "prompt_id", "text"), "qv") + ","
       + _rename_hv(hash_vectors_sql("chunk_src", "chunk_uid", "content"), "cv") + ","
       + _SPARSE_SIM.format(q="qv", i="cv") + """
SELECT query_id AS prompt_id, item_id AS chunk_uid, dd.source || '/' || dd.lang AS title, sim AS score,
       CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, item_id) AS rank FROM sims) r
JOIN documents dd ON dd.doc_id = r.item_id // 1000000
WHERE rank <= 8 AND 1 - sim < 0.8""")
def q_rag_search(spark, d):
    return rag_search(spark, d)


@query("vec_decode", """
SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim,
       ROUND(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm
FROM embeddings""")
def q_vec_decode(spark, d):
    """JSON text and float32 bytes round trips of every stored vector."""
    e = load(spark, d, "embeddings")
    j = e.select("vec_id", V.decode_json_vector(V.encode_json_vector("embedding")).alias("vj"),
                 V.decode_f32_bytes(V.encode_f32_bytes("embedding")).alias("vb"))
    # dim from the JSON round trip, norm from the byte round trip
    return j.select("vec_id", F.size("vj").alias("dim"), F.round(V.norm("vb"), 6).alias("norm"))


@query("vec_encode", "SELECT vec_id, CAST(4 * len(embedding) AS INTEGER) AS n_bytes FROM embeddings")
def q_vec_encode(spark, d):
    e = load(spark, d, "embeddings")
    return e.select("vec_id", F.length(V.encode_f32_bytes("embedding")).alias("n_bytes"))


@query("ann_search")
def q_ann(spark, d):
    """Approximate ten nearest vectors of every vector (IVF cells, exact re-score)."""
    e = _emb(spark, d)
    return _out(SR.ann(e, e, 10, "vec_id", "embedding", "vec_id", "embedding", exclude_self=True))


def graph_index(spark, d):
    """Index of the vectors with an odd id, and the others inserted afterwards."""
    e = _emb(spark, d)
    path = scratch_path(spark, f"graph-{uuid.uuid4().hex[:12]}")
    even = F.pmod("vec_id", F.lit(2)) == 0
    GI.build(e.where(~even), path, "vec_id", "embedding")
    return GI.insert(e.where(even), path, "even", "vec_id", "embedding")


@query("graph_search")
def q_graph_search(spark, d):
    """Approximate ten nearest vectors of every vector by walks over a graph index,
    and the number of vectors that each was compared with."""
    e = _emb(spark, d)
    index = GI.build(e, scratch_path(spark, f"graph-{uuid.uuid4().hex[:12]}"), "vec_id", "embedding")
    return GI.search(e, index, 10, "vec_id", "embedding", exclude_self=True)


@query("graph_recall", """
WITH n AS (SELECT COUNT(*) AS n FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0)
SELECT n AS n_queries, n * LEAST(n - 1, 10) AS n_hits, TRUE AS reached FROM n""")
def q_graph_recall(spark, d):
    """Hits of the graph search of every vector in an index made by an insert, and
    whether 95 % of the exact search's hits are among them."""
    e = _emb(spark, d)
    exact = SR.knn(e, e, 10, "vec_id", "embedding", "vec_id", "embedding", exclude_self=True)
    hits = (GI.search(e, graph_index(spark, d), 10, "vec_id", "embedding", exclude_self=True)
            .select("query_id", "item_id", F.lit(1).alias("found")))
    return (exact.select("query_id", "item_id", F.lit(1).alias("wanted"))
            .join(hits, ["query_id", "item_id"], "full")
            .agg(F.countDistinct("query_id").alias("n_queries"), F.count("found").alias("n_hits"),
                 (F.sum(F.when(F.col("wanted") == 1, F.coalesce("found", F.lit(0)))) / F.count("wanted") >= 0.95)
                 .alias("reached")))
