"""Physical-plan properties the operators rely on at scale."""

from tessera.functions import vectors as V
from tessera.operators import catalog as C
from tessera.operators import relational as R
from tessera.operators import search as SR


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_topk_has_partial_group_limit(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        knn = _plan(SR.knn(e, e, 10, "vec_id", "embedding", "vec_id", "embedding"))
        tv = _plan(C.top_values(spark.read.parquet(f"{sf}/lineitem.parquet"), 50))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for p in (knn, tv):
        assert "WindowGroupLimit" in p and "Partial" in p
        # the partial limit sits below the exchange
        assert p.index("Exchange hashpartitioning") < p.rindex("Partial")


def test_small_item_knn_has_no_shuffle(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", V.hash_embed("text").alias("v"))
    tpl = spark.createDataFrame([(1, "show sales"), (2, "top customers")], "id long, t string") \
               .select("id", V.hash_embed("t").alias("v"))
    p = _plan(SR.knn(docs, tpl, 1, "doc_id", "v", "id", "v", small_items=100))
    assert "Exchange" not in p and ("MapInArrow" in p or "MapInPandas" in p)


def test_star_broadcasts_fixed_dimensions(spark, sf):
    p = _plan(R.sales_view(spark, sf))
    assert p.count("BroadcastExchange") >= 2
    # only the four lineitem columns the star needs are read
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in p


def _jobs_while_planning(spark, name, sf, monkeypatch):
    """Jobs that building a query starts, without those that read the schema
    of a Parquet table (one per table that is opened)."""
    import __spark_entry__ as entry
    from pyspark.sql.readwriter import DataFrameReader

    opened, parquet = [], DataFrameReader.parquet
    monkeypatch.setattr(DataFrameReader, "parquet", lambda self, *a, **k: opened.append(a) or parquet(self, *a, **k))
    group = f"plan-{name}"
    spark.sparkContext.setJobGroup(group, name)
    try:
        entry.queries()[name](spark, sf)
        return max(0, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) - len(opened))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        monkeypatch.undo()


def test_planning_starts_no_job(spark, sf, monkeypatch):
    """Building these queries runs nothing; the index build stays small."""
    for name in ("sales_view", "risk_concentration", "risk_corr", "table_cards", "catalog_columns", "ddl_docs", "schema_context",
                 "gen_questions", "infer_keys", "union_docs", "column_docs", "smart_chunks", "page_text", "hash_embed", "compare_results"):
        assert _jobs_while_planning(spark, name, sf, monkeypatch) == 0, name
    assert _jobs_while_planning(spark, "index_build", sf, monkeypatch) < 10


def _scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_star_is_read_once(spark, sf):
    from tessera.operators import risk as K

    r = K.risk_view(spark, sf)
    assert _scans(K.concentration(r, ["counterparty", "desk"])) == _scans(r)


def test_values_of_a_column_are_counted_once_for_profile_key_and_inclusion(spark, tmp_path):
    for name, keys in (("child", [1, 1, 2, None, None, 9]), ("parent", [1, 2, 2, None])):
        spark.createDataFrame([(k,) for k in keys], "k long").write.parquet(f"{tmp_path}/{name}")
    child, parent = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("child", "parent"))
    top, key, orphans = C.top_values(child, 2), C.infer_keys(child, "child"), C.infer_fk(child, "k", parent, "k")
    assert [(r.value, r.cnt, r.rank) for r in top.orderBy("rank").collect()] == [("1", 2, 1), ("2", 1, 2)]
    assert [tuple(r)[2:] for r in key.collect()] == [(6, 4, 3, False)]
    assert orphans.first().orphans == 1
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = _plan(top.selectExpr("cnt AS n").union(key.select("n_non_null")).union(orphans))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert p.count("/child]") == 1 and p.count("ReusedExchange") == 2
