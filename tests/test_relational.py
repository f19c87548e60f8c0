"""Relational operators on the reference seed rows and on the test tables."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tessera.operators import relational as R
from tessera.operators import results as RS


def _seed_sales(spark):
    rows = [(1, 101, dt.date(2025, 7, 1), Decimal("2.00"), Decimal("1200.00"), "North America"),
            (2, 103, dt.date(2025, 7, 2), Decimal("1.00"), Decimal("200.00"), "North America"),
            (3, 104, dt.date(2025, 7, 3), Decimal("3.00"), Decimal("50.00"), "Latin America"),
            (4, 102, dt.date(2025, 7, 4), Decimal("1.00"), Decimal("900.00"), "North America"),
            (5, 105, dt.date(2025, 7, 5), Decimal("2.00"), Decimal("350.00"), "Europe")]
    df = spark.createDataFrame(rows, "customer_id long, product_id long, sale_date date, "
                                     "quantity decimal(10,2), unit_price decimal(10,2), region string")
    return df.withColumn("total_amount", (F.col("quantity") * F.col("unit_price")).cast("decimal(12,2)"))


def test_seed_sums(spark):
    s = _seed_sales(spark)
    by_region = {r.region: float(r.total) for r in R.group_sum(s, "region", "total_amount").collect()}
    assert by_region == {"North America": 3500.0, "Europe": 700.0, "Latin America": 150.0}
    top = R.top_groups(s, "product_id", "total_amount", 1).first()
    assert (top.product_id, float(top.total)) == (101, 2400.0)


def test_dynamic_filters(spark):
    s = _seed_sales(spark)
    f = [{"column": "region", "operator": "contains", "value": "AMERICA"},
         {"column": "total_amount", "operator": "greater-than", "value": "300"},
         {"column": "nope", "operator": "equals", "value": "x"},
         {"column": "region", "operator": "weird", "value": "x"}]
    assert sorted(r.customer_id for r in R.apply_filters(s, f).collect()) == [1, 4]
    nulls = spark.createDataFrame([(None,), ("5",), ("abc",)], "v string")
    got = R.apply_filters(nulls, [{"column": "v", "operator": "less-than", "value": "10"}]).collect()
    assert [r.v for r in got] == ["5"]


def test_chart_agg_rules(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", None, 2), ("a", None, 3), ("a", 4.0, 4), (None, 2.0, 5)],
                               "x string, y double, o int")
    r = {x.label: x for x in RS.chart_agg(df, "x", "y", order_col="o").collect()}
    a = r["a"]
    assert (a["count"], a["sum"], a["average"], a["minimum"], a["maximum"], a["first_seen"]) == \
        (4, 5.0, 1.25, 0.0, 4.0, 1)
    assert r[None]["sum"] == 2.0
    assert RS.auto_chart(df) == ("x", "y", "sum")
    assert RS.auto_chart(df.select("x")) == ("x", "x", "count")


def test_lookup_last_and_anti(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    right = spark.createDataFrame([(1, 10, "a"), (1, 20, "b"), (2, 5, "c")], "k long, ord long, v string")
    got = {r.k: r.v for r in R.lookup_last(left, right, "k", "ord").collect()}
    assert got == {1: "b", 2: "c", 3: None}
    nulls = spark.createDataFrame([(1,), (None,)], "k long")
    assert sorted(r.k for r in R.missing_in(left, nulls, "k").collect()) == [2, 3]


def test_diff_and_scale(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "v int")
    b = spark.createDataFrame([(1,), (3,)], "v int")
    d = sorted((r.v, r.side) for r in R.diff_results(a, b).collect())
    assert d == [(1, "only_left"), (2, "only_left"), (3, "only_right")]
    assert R.scale_up(a, 2).count() == 12


def test_sales_view_counts(spark, sf):
    s = R.sales_view(spark, sf)
    assert s.count() == spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert dict(s.dtypes)["total_amount"] == "decimal(12,2)"


def test_year_filter_pushdown(spark, sf):
    """The year predicate reaches the parquet scan as a range filter."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("d", F.to_date("l_shipdate"))
    plan = R.year_filter(li.select("l_orderkey", "l_shipdate", "d"), "d", 2000)._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PushedFilters" in plan and "l_shipdate" in plan


def test_phrases_by_any_number(spark):
    """The same rows with 10 and 2000 phrases; equal rows stay separate."""
    left = spark.createDataFrame([("please LIST p7 now",), ("please LIST p7 now",), ("nothing",), (None,)], "t string")
    got = []
    for n in (10, 2000):
        phrases = spark.createDataFrame([(i, f"list p{i}", f"s{i}") for i in range(n)], "ord int, phrase string, sql string")
        got.append(sorted(map(str, R.match_phrases(left, "t", phrases, "phrase", "ord", ["phrase", "sql"]).collect())))
    assert got[0] == got[1] and len(got[0]) == 4 and sum("s7" in x for x in got[0]) == 2
    assert R.match_phrases(left, "t", phrases.limit(0), "phrase", "ord", ["phrase"]).count() == 4


def test_factor_correlation_of_every_pair(spark):
    """Factors that never share a day, a constant one and days of nulls have
    their rows; a missing day counts as 0."""
    from math import sqrt

    from tessera.operators.risk import factor_correlation

    days = [dt.date(2025, 1, d) for d in range(1, 7)]
    totals = {"hot": [5, 7, 1, 4, 9, 2], "rare1": [3, 0, 0, 0, 0, 0], "rare2": [0, 4, 8, 0, 0, 0],
              "flat": [0.1] * 6, "nulls": [0, 0, None, 6, 0, 0], "zero": [0, None, 0, 0, 0, 0]}
    rows = [(f, d, None if v is None else Decimal(str(v))) for f, vs in totals.items() for d, v in zip(days, vs) if v != 0 or f == "zero"]
    r = spark.createDataFrame(rows + [(None, days[0], Decimal(1))], "risk_factor string, valuation_date date, value decimal(14,2)")
    found = factor_correlation(r).collect()
    got = {(x.factor_a, x.factor_b): x.correlation for x in found}
    names = sorted(totals)
    assert len(found) == len(got) and set(got) == {(a, b) for i, a in enumerate(names) for b in names[i + 1:]}
    for (a, b), c in got.items():
        if {a, b} & {"flat", "zero"}:
            assert c is None, (a, b)
            continue
        xs, ys = ([float(v or 0) for v in totals[f]] for f in (a, b))
        mx, my = sum(xs) / 6, sum(ys) / 6
        want = sum((x - mx) * (y - my) for x, y in zip(xs, ys)) / sqrt(sum((x - mx) ** 2 for x in xs) * sum((y - my) ** 2 for y in ys))
        assert abs(c - want) < 2e-6, (a, b)
    assert got["rare1", "rare2"] < 0
