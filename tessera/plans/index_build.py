"""Catalog → cards → documents → chunks → vectors (the offline index)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.operators import catalog as C
from tessera.operators.relational import union_all
from tessera.plans import sqlviews
from tessera.sources.writes import append_new_docs
from tessera.tables import load

CATALOG_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

# Descriptions of the indexed tables and a few columns (one
# column deliberately without a description).
COMMENTS = [
    ("lineitem", None, "Order lines: one row per ordered part"),
    ("orders", None, "Customer orders"),
    ("customer", None, "Customers and their market segment"),
    ("part", None, "Parts sold, with list price"),
    ("supplier", None, "Suppliers of parts"),
    ("nation", None, "Nations"),
    ("lineitem", "l_quantity", "Units ordered"),
    ("lineitem", "l_extendedprice", "Quantity times list price"),
    ("lineitem", "l_shipdate", "Date the line shipped"),
    ("orders", "o_orderpriority", "Priority class of the order"),
    ("customer", "c_mktsegment", "Market segment"),
    ("part", "p_retailprice", None),
]

# Candidate foreign keys (child table, column, parent table, column).
FK_CANDIDATES = [
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"),
]


def frames(spark: SparkSession, sf_dir: str, names=CATALOG_TABLES) -> dict[str, DataFrame]:
    return {t: load(spark, sf_dir, t) for t in names}


def comments_table(spark: SparkSession, owner: str = C.OWNER) -> DataFrame:
    return spark.createDataFrame([(owner, t, c, d) for t, c, d in COMMENTS], C.COMMENT_SCHEMA)


def inferred_constraints(spark: SparkSession, fr: dict[str, DataFrame], owner: str = C.OWNER) -> DataFrame:
    """Primary keys = columns found unique and complete; foreign keys = the
    candidates whose inclusion test finds no orphan."""
    keys = C.key_candidates(fr)
    pk = (keys
              .select(F.lit(owner).alias("owner"), "table_name",
                      F.concat(F.lit("PK_"), F.upper("table_name")).alias("constraint_name"),
                      F.lit("P").alias("constraint_type"), "column_name", F.lit(1).alias("position"),
                      F.lit(None).cast("string").alias("r_constraint_name")))
    fks = []
    for child, ccol, parent, pcol in FK_CANDIDATES:
        if child in fr and parent in fr:
            o = C.infer_fk(fr[child], ccol, fr[parent], pcol)
            fks.append(o.where(F.col("orphans") == 0).select(
                F.lit(owner).alias("owner"), F.lit(child).alias("table_name"),
                F.lit(f"FK_{child.upper()}_{ccol.upper()}").alias("constraint_name"),
                F.lit("R").alias("constraint_type"), F.lit(ccol).alias("column_name"),
                F.lit(1).alias("position"), F.lit(f"PK_{parent.upper()}").alias("r_constraint_name")))
    return union_all(pk, *fks)


def views_table(spark: SparkSession, owner: str = C.OWNER) -> DataFrame:
    rows = [(owner, "SALES", "Sales star: one row per order line", sqlviews.SALES_CTE.strip()),
            (owner, "RISK_SENSITIVITIES", None, sqlviews.RISK_CTE.strip())]
    return spark.createDataFrame(rows, "owner string, view_name string, view_comment string, view_text string")


def snapshot(spark: SparkSession, sf_dir: str, names=CATALOG_TABLES) -> dict[str, DataFrame]:
    fr = frames(spark, sf_dir, names)
    comments = comments_table(spark)
    cols = C.catalog_columns(C.measured_columns(spark, fr), comments)
    samples = union_all(*[C.top_values(df, 50).select(F.lit(C.OWNER).alias("owner"), F.lit(t).alias("table_name"),
                                                        "column_name", "value", "cnt", "rank")
                          for t, df in fr.items()])
    return {
        "tables": C.catalog_tables(C.table_counts(fr), comments),
        "columns": cols,
        "constraints": inferred_constraints(spark, fr),
        "indexes": spark.createDataFrame([], C.INDEX_SCHEMA),
        "views": views_table(spark),
        "samples": samples,
    }


def documents(spark: SparkSession, snap: dict[str, DataFrame]) -> DataFrame:
    """TABLE, VIEW and REL documents, unioned."""
    t = C.table_cards(snap["tables"], snap["columns"], snap["constraints"], snap["indexes"], snap["samples"])
    v = C.view_cards(snap["views"])
    r = C.rel_cards(snap["constraints"])
    def tag(df, kind):
        return df.select(F.lit(kind).alias("doc_type"), F.col("owner").alias("source_owner"),
                         F.col("table_name").alias("source_name"), F.lit(None).cast("string").alias("source_part"),
                         "title", "body")
    return union_all(tag(t, "TABLE"), tag(v, "VIEW"), tag(r, "REL"))


def build_index(spark: SparkSession, sf_dir: str, existing: DataFrame | None = None,
                max_tokens: int = 350, overlap: int = 40) -> DataFrame:
    """Cards → hash dedupe against ``existing`` documents (only new hashes are
    chunked: D4) → sentence chunks → hashed embeddings.  Returns the chunk
    table ``doc_id, doc_type, source_name, title, chunk_ix, content, tokens,
    embedding``; ``doc_id`` is the body hash."""
    docs = documents(spark, snapshot(spark, sf_dir)).withColumn("doc_id", F.sha2("body", 256))
    if existing is None:
        existing = spark.createDataFrame([], "hash string")
    new = append_new_docs(existing, docs, "doc_id", "body")
    ch = X.smart_chunks(new, "body", max_tokens, overlap, True, ("doc_id", "doc_type", "source_name", "title"))
    return ch.withColumn("embedding", V.hash_embed("content"))
