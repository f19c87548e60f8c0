"""Catalog, questions, evaluation, flagship path and the driver contract."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import catalog as C
from tessera.operators import evaluate as E
from tessera.plans import index_build as IB
from tessera.plans import nl_answer as N
from tessera.plans import questions as Q


def test_top_values_one_pass(spark):
    df = spark.createDataFrame([("a", 1, 1.5), ("a", 2, 2.5), ("b", 2, None), (None, 2, 0.0)],
                               "s string, i int, f double")
    got = {(r.column_name, r.value): (r.cnt, r.rank) for r in C.top_values(df, 1).collect()}
    assert got == {("s", "a"): (2, 1), ("i", "2"): (3, 1)}


def test_keys_and_cards(spark, sf):
    fr = IB.frames(spark, sf, ("orders", "customer"))
    keys = {r.column_name: r.is_unique for r in C.infer_keys(fr["orders"], "orders").collect()}
    assert keys["o_orderkey"] and not keys["o_custkey"]
    assert C.infer_fk(fr["orders"], "o_custkey", fr["customer"], "c_custkey").first().orphans == 0
    snap = IB.snapshot(spark, sf, ("orders", "customer", "nation"))
    cards = {r.table_name: r.body for r in C.table_cards(snap["tables"], snap["columns"], snap["constraints"],
                                                         snap["indexes"], snap["samples"]).collect()}
    body = cards["orders"]
    assert body.startswith("Table: orders (Owner: TPCH)\nRows (stats): ")
    assert "Comment: Customer orders" in body and "- PK_ORDERS (o_orderkey)" in body
    assert "FK_ORDERS_O_CUSTKEY (o_custkey) → ref PK_CUSTOMER" in body
    assert "top values:" in body


def test_questions_and_ground_sql(spark, sf):
    qs = Q.ground_sql(Q.generate_questions(Q.table_columns(spark, sf, ("orders",)))).orderBy("question_id").collect()
    assert [q.question for q in qs][:2] == [
        "List all orders with their o_orderkey, o_custkey, o_orderstatus, o_totalprice.",
        "How many orders are there?"]
    assert qs[1].ground_sql == "SELECT COUNT(*) AS CNT FROM orders"
    assert qs[2].ground_sql.endswith("ORDER BY o_orderkey LIMIT 10")


def test_compare_results_and_failed_sides(spark):
    a = spark.createDataFrame([(1,), (2,)], "v int")
    b = spark.createDataFrame([(2,), (1,)], "v int")
    r = E.compare_results(a, b).first()
    assert r.same_shape and not r.same_sample and r.same_multiset  # the order of results counts in the sample
    named = spark.createDataFrame([(1, None), (2, None)], "total int, x string")
    r = E.compare_results(named, named.toDF("cnt", "y")).first()
    assert r.same_shape and r.same_sample and r.same_multiset
    r = E.compare_results(named, named.withColumn("x", F.lit("v"))).first()
    assert r.same_shape and not r.same_sample and (r.only_left, r.only_right) == (2, 2)
    r = E.compare_results(a, named).first()
    assert not r.same_shape and not r.same_multiset and r.only_left is None
    long = spark.range(3000)
    r = E.compare_results(long, long.where("id <> 2000").unionByName(long.where("id = 5"))).first()
    assert r.same_sample and not r.same_multiset and (r.only_left, r.only_right) == (1, 1)
    cases = spark.createDataFrame([(None, None, None, None, None, None, None, None)],
                                  "g_ok boolean, c_ok boolean, g_n_cols int, c_n_cols int, g_sample array<string>, "
                                  "c_sample array<string>, g_n_rows long, c_n_rows long") \
        .withColumn("g_mhash", F.lit(0).cast("long")).withColumn("c_mhash", F.lit(0).cast("long"))
    strict = cases.select(*E.compare_signatures()).first()
    compat = cases.select(*E.compare_signatures(compat=True)).first()
    assert strict.same_sample == "N" and compat.same_sample == "Y"


def test_safe_exec_never_raises(spark):
    ok = E.safe_exec(spark, "SELECT 1 AS a UNION ALL SELECT 2;", cap=1)
    bad = E.safe_exec(spark, "SELECT * FROM no_such_table")
    assert ok[1] and ok[3] == 1 and not bad[1] and bad[6]


def test_flagship_and_fallback(spark, sf):
    rows = N.flagship(spark, sf).collect()
    assert 0 < len(rows) <= 3
    assert rows == sorted(rows, key=lambda r: (-r.total_revenue, r.customer_id))
    with pytest.raises(N.NoMatch) as e:
        N.answer(spark, "hello world", sf, asof=dt.date(2001, 1, 1))
    assert len(e.value.suggestions) == 3


def test_named_query(spark, sf):
    assert N.run_named(spark, sf, "all_products", {}).count() == spark.read.parquet(f"{sf}/part.parquet").count()
    with pytest.raises(KeyError):
        N.run_named(spark, sf, "customer_sales", {})
    with pytest.raises(KeyError):
        N.run_named(spark, sf, "customer_sales_july", {"customer_id": 1})


def test_entry_contract(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.columns == ["customer_id", "total_revenue"] and df.count() >= 0
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 100


def test_batch_answers_equal_single_prompt_answers(spark, sf):
    """Answering a prompt table at once gives what each prompt gets alone."""
    asof = dt.date(2001, 12, 31)
    prompts = ["top 3 customers by revenue in 2000", "show total sales for each region in 2001",
               "top 4 products by revenue between 2000-03-01 and 2000-03-20", "hello world"]
    table = spark.createDataFrame(list(enumerate(prompts)), "prompt_id long, prompt string")
    batch = N.answer_batch(spark, table, sf, asof)
    for i, p in enumerate(prompts):
        got = [(r.answer_key, round(r.total_revenue, 2)) for r in
               batch.where(F.col("prompt_id") == i).orderBy("rank").collect()]
        try:
            single = N.answer(spark, p, sf, asof=asof).collect()
        except N.NoMatch:
            assert got == []
            continue
        want = [(str(r[0]), round(float(r[1]), 2)) for r in single]
        assert got == want, p


def test_signatures_pass_through_files(spark):
    """Signatures are read from the shared folder, not built from a driver
    list, and evaluation leaves the joins to the planner."""
    from tessera.operators import evaluate as E
    from tessera.plans import questions as Q

    def plan(df):
        return df._jdf.queryExecution().analyzed().toString()

    texts = spark.createDataFrame([("SELECT 1 AS a",), ("SELECT 2 AS a",), ("SELECT nothing",), (None,), ("SELECT 1 AS a",)], "sql_text string")
    sig = E.execute_all(spark, texts)
    assert "parquet" in plan(sig) and "LogicalRDD" not in plan(sig)
    assert sorted((r.sql_text, r.ok, r.n_rows) for r in sig.collect()) == [("SELECT 1 AS a", True, 1), ("SELECT 2 AS a", True, 1), ("SELECT nothing", False, 0)]
    assert E.execute_all(spark, texts.where("1 = 0")).count() == 0
    questions = spark.createDataFrame([(1, "SELECT 1 AS a"), (2, "SELECT 2 AS a")], "question_id long, ground_sql string")
    synonyms = spark.createDataFrame([(1, 7)], "question_id long, synonym_id long")
    candidates = spark.createDataFrame([(1, "SELECT 1 AS a"), (2, "SELECT nothing")], "question_id long, llm_sql string")
    cases = Q.run_evaluation(spark, questions, synonyms, candidates)
    assert "ResolvedHint" not in plan(cases) and "broadcast" not in plan(cases)
    assert sorted((r.question_id, r.llm_ok, r.same_sample) for r in cases.collect()) == [(1, "Y", "Y"), (1, "Y", "Y"), (2, "N", "N")]


def test_compared_results_are_counted_unsorted_in_bounded_parts(spark, tmp_path, monkeypatch):
    spark.range(4000).selectExpr("id", "id % 7 AS v").write.parquet(str(tmp_path / "a"))
    rows = spark.read.parquet(str(tmp_path / "a"))
    a = rows.orderBy("id")
    b = rows.where("id <> 17").unionByName(rows.where("id = 20")).orderBy(F.col("id").desc())
    sides = E.compare_results(a, b)
    assert "rangepartitioning" not in sides._jdf.queryExecution().executedPlan().toString()  # no result is sorted whole
    assert sides.first().asDict() | {"same_sample": None} == {"same_shape": True, "same_sample": None, "only_left": 1, "only_right": 1, "same_multiset": False}
    monkeypatch.setattr(E, "PART_BYTES", 1024)
    parts = E.count_parts(a, b)
    assert parts > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert E.count_parts(a.limit(0)) is None
    r = E.compare_results(a, b).first()
    assert (r.only_left, r.only_right) == (1, 1) and f", {parts})" in E.compare_results(a, b)._jdf.queryExecution().executedPlan().toString()
