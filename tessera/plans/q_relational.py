"""Registered relational queries over the sales star and the TPC-H tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.operators import relational as R
from tessera.plans.registry import portable, query
from tessera.plans.sqlviews import with_sales
from tessera.sources import readers
from tessera.tables import load, register_views


def _sales(spark, d):
    return R.sales_view(spark, d)


@query("sales_view", with_sales("""
SELECT customer_id, product_id, CAST(sale_date AS VARCHAR) AS sale_date,
       CAST(quantity AS DOUBLE) AS quantity, CAST(unit_price AS DOUBLE) AS unit_price,
       CAST(total_amount AS DOUBLE) AS total_amount, region
FROM sales"""))
def q_sales_view(spark: SparkSession, d: str):
    return portable(_sales(spark, d))


@query("star_join", with_sales("""
SELECT s.customer_id, s.product_id, CAST(s.sale_date AS VARCHAR) AS sale_date,
       CAST(s.total_amount AS DOUBLE) AS total_amount, s.region,
       c.c_name AS customer_name, p.p_name AS product_name
FROM sales s JOIN customer c ON s.customer_id = c.c_custkey
JOIN part p ON s.product_id = p.p_partkey"""))
def q_star_join(spark, d):
    return portable(R.star_join(spark, d).select(
        "customer_id", "product_id", "sale_date", "total_amount", "region",
        "customer_name", "product_name"))


@query("sum_by_region", with_sales("""
SELECT region, CAST(SUM(total_amount) AS DOUBLE) AS total_revenue
FROM sales GROUP BY region"""))
def q_sum_by_region(spark, d):
    return portable(R.group_sum(_sales(spark, d), "region", "total_amount", "total_revenue"))


@query("sum_filtered", with_sales("""
SELECT CAST(SUM(total_amount) AS DOUBLE) AS total_revenue, COUNT(*) AS n_sales
FROM sales WHERE region = 'EUROPE'
  AND sale_date BETWEEN DATE '2000-01-01' AND DATE '2000-06-30'"""))
def q_sum_filtered(spark, d):
    s = _sales(spark, d)
    f = s.where((F.col("region") == "EUROPE")
                & F.col("sale_date").between(F.to_date(F.lit("2000-01-01")), F.to_date(F.lit("2000-06-30"))))
    return portable(f.agg(F.sum("total_amount").alias("total_revenue"), F.count("*").alias("n_sales")))


@query("distinct_vals", """
SELECT DISTINCT l_partkey AS product_id FROM lineitem""")
def q_distinct(spark, d):
    return load(spark, d, "lineitem").select(F.col("l_partkey").alias("product_id")).distinct()


@query("count_all", """
SELECT (SELECT COUNT(*) FROM lineitem) AS lineitem_rows, (SELECT COUNT(*) FROM orders) AS order_rows""")
def q_count_all(spark, d):
    li = load(spark, d, "lineitem").agg(F.count("*").alias("lineitem_rows"))
    o = load(spark, d, "orders").agg(F.count("*").alias("order_rows"))
    # the second count is a scalar subquery: one value, no join
    return li.select("lineitem_rows", o.scalar().alias("order_rows"))


@query("group_count", """
SELECT o_orderstatus, COUNT(*) AS cnt, COUNT(o_orderpriority) AS n_priority
FROM orders GROUP BY o_orderstatus""")
def q_group_count(spark, d):
    return (load(spark, d, "orders").groupBy("o_orderstatus")
            .agg(F.count("*").alias("cnt"), F.count("o_orderpriority").alias("n_priority")))


@query("top_products", with_sales("""
SELECT product_id, CAST(SUM(total_amount) AS DOUBLE) AS total_revenue
FROM sales GROUP BY product_id
ORDER BY SUM(total_amount) DESC, product_id LIMIT 3"""))
def q_top_products(spark, d):
    return portable(R.top_groups(_sales(spark, d), "product_id", "total_amount", 3, "total_revenue"))


@query("top_rows", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer
ORDER BY c_custkey LIMIT 10""")
def q_top_rows(spark, d):
    c = R.first_columns(load(spark, d, "customer"), 4)
    return c.orderBy("c_custkey").limit(10)


@query("filter_not_null", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE c_custkey IS NOT NULL""")
def q_not_null(spark, d):
    return R.not_null(R.first_columns(load(spark, d, "customer"), 4), "c_custkey")


@query("project_first4", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem""")
def q_first4(spark, d):
    return R.first_columns(load(spark, d, "lineitem"), 4)


@query("filter_bind", with_sales("""
SELECT customer_id, product_id, CAST(sale_date AS VARCHAR) AS sale_date,
       CAST(total_amount AS DOUBLE) AS total_amount, region
FROM sales WHERE region = 'ASIA' AND sale_date = DATE '1998-03-15'"""))
def q_filter_bind(spark, d):
    R.register_sales(spark, d)
    df = spark.sql(
        "SELECT customer_id, product_id, sale_date, total_amount, region FROM sales "
        "WHERE region = :region AND sale_date = to_date(:day, 'yyyy-MM-dd')",
        args={"region": "ASIA", "day": "1998-03-15"})
    return portable(df)


@query("filter_between", with_sales("""
SELECT product_id, CAST(SUM(total_amount) AS DOUBLE) AS total_revenue, COUNT(*) AS n_sales
FROM sales WHERE sale_date BETWEEN DATE '1999-01-01' AND DATE '1999-03-31'
GROUP BY product_id"""))
def q_filter_between(spark, d):
    s = _sales(spark, d).where(F.col("sale_date").between(F.to_date(F.lit("1999-01-01")),
                                                          F.to_date(F.lit("1999-03-31"))))
    return portable(s.groupBy("product_id").agg(F.sum("total_amount").alias("total_revenue"),
                                                F.count("*").alias("n_sales")))


@query("filter_year_min", with_sales("""
SELECT customer_id, CAST(SUM(total_amount) AS DOUBLE) AS total_revenue
FROM sales WHERE strftime(sale_date, '%Y') = '2000' AND total_amount >= 10000
GROUP BY customer_id"""))
def q_filter_year_min(spark, d):
    s = R.year_filter(_sales(spark, d), "sale_date", 2000).where(F.col("total_amount") >= 10000)
    return portable(s.groupBy("customer_id").agg(F.sum("total_amount").alias("total_revenue")))


@query("filter_trailing", """
SELECT event_id, user_id, event_type, value FROM events
WHERE CAST(ts AS DATE) >= DATE '2024-01-31' - INTERVAL 7 DAY""")
def q_filter_trailing(spark, d):
    e = load(spark, d, "events").withColumn("day", F.to_date("ts"))
    return R.last_n_days(e, "day", 7, "2024-01-31").select("event_id", "user_id", "event_type", "value")


@query("oracle_fns", """
SELECT o_orderkey, strftime(o_orderdate, '%Y') AS order_year,
       COALESCE(o_orderpriority, 'n/a') AS priority, substr(o_orderpriority, 1, 1) AS priority_code
FROM orders WHERE CAST(o_orderdate AS DATE) = CAST('1996-02-29' AS DATE)""")
def q_oracle_fns(spark, d):
    """TO_CHAR / NVL / SUBSTR / TO_DATE as Spark SQL functions."""
    o = load(spark, d, "orders")
    return (o.where(F.to_date("o_orderdate") == F.to_date(F.lit("1996-02-29"), "yyyy-MM-dd"))
             .select("o_orderkey", F.date_format("o_orderdate", "yyyy").alias("order_year"),
                     F.coalesce("o_orderpriority", F.lit("n/a")).alias("priority"),
                     F.substring("o_orderpriority", 1, 1).alias("priority_code")))


@query("src_sql", """
SELECT l_returnflag, l_linestatus, CAST(SUM(l_quantity) AS DOUBLE) AS sum_qty, COUNT(*) AS n
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def q_src_sql(spark, d):
    register_views(spark, d, ["lineitem"])
    return readers.read_sql(spark, "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, "
                                   "COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")


@query("src_parquet", "SELECT * FROM part")
def q_src_parquet(spark, d):
    return readers.read_parquet(spark, f"{d}/part.parquet")


@query("source_registry", "SELECT * FROM supplier")
def q_source_registry(spark, d):
    reg = readers.demo_registry(spark, d)
    return readers.load_source(spark, reg, "parquet")


@query("self_union", """
SELECT o_orderstatus, COUNT(*) AS cnt FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders)
GROUP BY o_orderstatus""")
def q_self_union(spark, d):
    o = load(spark, d, "orders")
    return R.scale_up(o, 1).groupBy("o_orderstatus").agg(F.count("*").alias("cnt"))


@query("join_last_wins", """
SELECT c.c_custkey, x.o_orderkey AS last_orderkey, x.o_totalprice AS last_totalprice
FROM customer c LEFT JOIN (
  SELECT o_custkey, max_by(o_orderkey, o_orderkey) AS o_orderkey, max_by(o_totalprice, o_orderkey) AS o_totalprice
  FROM orders GROUP BY o_custkey) x ON c.c_custkey = x.o_custkey""")
def q_join_last_wins(spark, d):
    c = load(spark, d, "customer").select("c_custkey")
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    out = R.lookup_last(c, o, "c_custkey", "o_orderkey")
    return out.select("c_custkey", F.col("o_orderkey").alias("last_orderkey"),
                      F.col("o_totalprice").alias("last_totalprice"))


@query("join_one_to_many", """
SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey""")
def q_join_one_to_many(spark, d):
    c = load(spark, d, "customer").select("c_custkey")
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return c.join(o, "c_custkey", "left")


@query("anti_missing", """
SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def q_anti_missing(spark, d):
    docs = load(spark, d, "documents").select("doc_id")
    return R.missing_in(docs, load(spark, d, "labels"), "doc_id")


@query("anti_distinct", """
SELECT p_partkey FROM part WHERE p_partkey NOT IN (
  SELECT DISTINCT l_partkey FROM lineitem
  WHERE l_partkey IS NOT NULL AND l_shipdate >= TIMESTAMP '2000-01-01' AND l_shipdate < TIMESTAMP '2001-01-01')""")
def q_anti_distinct(spark, d):
    """Parts with no line shipped in 2000: anti join against a distinct subquery."""
    parts = load(spark, d, "part").select("p_partkey")
    sold = (load(spark, d, "lineitem")
            .where((F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz"))
                   & (F.col("l_shipdate") < F.lit("2001-01-01").cast("timestamp_ntz")))
            .select("l_partkey").distinct())
    return R.missing_in(parts, sold, "p_partkey", "l_partkey")


@query("first_n", """
SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, CAST(row_ix AS INTEGER) AS row_ix FROM (
  SELECT o_custkey, o_orderkey, o_orderdate,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS row_ix
  FROM orders) WHERE row_ix <= 3""")
def q_first_n(spark, d):
    o = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return portable(R.first_n(o, 3, [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()],
                              ["o_custkey"]))


@query("latest_rows", """
SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 100""")
def q_latest(spark, d):
    return R.latest(load(spark, d, "events").select("event_id", "user_id", "event_type"), "event_id", 100)


@query("result_diff", """
(SELECT l_orderkey, l_linenumber, 'only_left' AS side FROM lineitem WHERE l_returnflag = 'R'
 EXCEPT ALL SELECT l_orderkey, l_linenumber, 'only_left' FROM lineitem WHERE l_linestatus = 'O')
UNION ALL
(SELECT l_orderkey, l_linenumber, 'only_right' FROM lineitem WHERE l_linestatus = 'O'
 EXCEPT ALL SELECT l_orderkey, l_linenumber, 'only_right' FROM lineitem WHERE l_returnflag = 'R')""")
def q_result_diff(spark, d):
    li = load(spark, d, "lineitem")
    a = li.where(F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber")
    b = li.where(F.col("l_linestatus") == "O").select("l_orderkey", "l_linenumber")
    return R.diff_results(a, b)


@query("dyn_filter", with_sales("""
SELECT customer_id, product_id, CAST(sale_date AS VARCHAR) AS sale_date,
       CAST(total_amount AS DOUBLE) AS total_amount, region FROM sales
WHERE lower(region) <> 'europe' AND lower(CAST(sale_date AS VARCHAR)) LIKE '%1997-%'
  AND TRY_CAST(CAST(total_amount AS VARCHAR) AS DOUBLE) > 40000"""))
def q_dyn_filter(spark, d):
    s = portable(_sales(spark, d)).select("customer_id", "product_id", "sale_date", "total_amount", "region")
    return R.apply_filters(s, [
        {"column": "region", "operator": "not-equals", "value": "Europe"},
        {"column": "sale_date", "operator": "contains", "value": "1997-"},
        {"column": "total_amount", "operator": "greater-than", "value": "40000"},
        {"column": "region", "operator": "equals", "value": ""},          # empty value: passes
        {"column": "no_such_column", "operator": "equals", "value": "x"},  # unknown column: passes
        {"column": "region", "operator": "between", "value": "x"},         # unknown operator: passes
    ])
