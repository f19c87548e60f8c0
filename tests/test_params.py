"""Prompt parameters, binding and defaults."""

from pyspark.sql import functions as F

from tessera.functions import params as P


def test_extract_params(spark):
    df = spark.createDataFrame([("top 3 customers by revenue in 2024",),
                                ("sales between 2000-01-01 and 2000-06-30",),
                                ("sales by region last year",)], "p string")
    rows = [r.m for r in df.select(P.extract_params("p", 2001).alias("m")).collect()]
    assert rows[0] == {"year": "2024", "limit": "3"}
    assert rows[1] == {"year": "2000", "start_date": "2000-01-01", "end_date": "2000-06-30", "date": "2000-01-01"}
    assert rows[2] == {"year": "2000"}


def test_named_params_last_wins(spark):
    df = spark.createDataFrame([("{region=ASIA} {year = 2000} {min_revenue=10.5} {year=2001}",)], "p string")
    e = df.select(F.explode(P.named_param_entries("p")).alias("e")).select("e.*").collect()
    assert [(r.name, r.value, r.kind) for r in e] == [("region", "ASIA", "text"), ("min_revenue", "10.5", "float"),
                                                     ("year", "2001", "int")]
    assert P.typed_args([(r.name, r.value, r.kind) for r in e]) == {"region": "ASIA", "min_revenue": 10.5,
                                                                     "year": 2001}


def test_bind_and_defaults(spark):
    df = spark.createDataFrame([("SELECT * FROM s WHERE a = {A} AND b = {b}",)], "sql string")
    m = F.create_map(F.lit("a"), F.lit("1"))
    b = df.select(P.bind_template("sql", m).alias("b")).first().b
    assert b.sql == "SELECT * FROM s WHERE a = :a AND b = :b" and b.missing == ["b"]
    f = df.select(P.fill_defaults(F.create_map(F.lit("year"), F.lit("2000")),
                                  F.create_map(F.lit("limit"), F.lit("10")),
                                  F.array(F.lit("year"), F.lit("date"))).alias("f")).first().f
    assert f.params == {"limit": "10", "year": "2000"} and f.missing == ["date"] and not f.ok


def test_param_hits(spark):
    df = spark.createDataFrame([("show sales for customer_id 3 on sale_date x",)], "p string")
    n = df.select(P.param_hits("p", F.array(F.lit("customer_id"), F.lit("sale_date"), F.lit("sale_id")))
                  .alias("n")).first().n
    assert n == 2
