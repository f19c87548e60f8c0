"""Analytic question pack over a sensitivity table.

Columns: deal, book, counterparty, desk, measure, measure_point, risk_factor,
scenario, currency, valuation_date, value.  Every question is one or two
aggregations with partial (map-side) combine; windows only run over already
aggregated rows (dates × keys), never over raw rows of a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.relational import customer_region
from tessera.tables import load

# The five order priorities used as scenarios, in their natural order,
# and the output column names they map to.
SCENARIOS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
SCENARIO_COLUMNS = ("urgent", "high", "medium", "not_specified", "low")


def risk_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag",
                                                  "l_linestatus", "l_shipdate", "l_extendedprice")
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    p = load(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_type")
    c = customer_region(spark, sf_dir).select("c_custkey", "c_name", "c_mktsegment", "n_name")
    amount = F.col("l_extendedprice").cast("decimal(14,2)")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
              .join(c, o.o_custkey == c.c_custkey)
              .join(p, li.l_partkey == p.p_partkey)
              .select(F.col("o_orderkey").alias("deal"), F.col("p_brand").alias("book"),
                      F.col("c_name").alias("counterparty"), F.col("c_mktsegment").alias("desk"),
                      F.col("l_returnflag").alias("measure"), F.col("p_size").alias("measure_point"),
                      F.col("p_type").alias("risk_factor"), F.col("o_orderpriority").alias("scenario"),
                      F.col("n_name").alias("currency"),
                      F.to_date("l_shipdate").alias("valuation_date"),
                      F.when(F.col("l_linestatus") == "O", -amount).otherwise(amount).alias("value")))


def by_dimensions(r: DataFrame, dims=("measure", "risk_factor", "book")) -> DataFrame:
    """Total value per measure, per risk factor and per book in one pass
    (GROUPING SETS: one Expand, one shuffle)."""
    g = r.groupingSets([[d] for d in dims], *dims).agg(
        F.sum("value").alias("total_value"), F.grouping_id().alias("_gid"))
    n = len(dims)
    dim_name = F.lit(None).cast("string")
    for i, d in enumerate(dims):
        # grouping_id bit is 0 for the column that is grouped
        mask = ((1 << n) - 1) ^ (1 << (n - 1 - i))
        dim_name = F.when(F.col("_gid") == mask, F.lit(d)).otherwise(dim_name)
    key = F.coalesce(*[F.col(d).cast("string") for d in dims])
    return g.select(dim_name.alias("dim"), key.alias("key"), F.col("total_value").cast("double").alias("total_value"))


def uniques(r: DataFrame) -> DataFrame:
    return r.groupBy("measure").agg(F.count_distinct("deal").alias("n_deals"),
                                    F.count_distinct("book").alias("n_books"))


def concentration(r: DataFrame, keys: list[str]) -> DataFrame:
    """Share of gross (absolute) value per value of each key.  One pass: the
    keys and the grand total are grouping sets of one aggregation; its rows,
    one per key value, are then set against the total's single row."""
    n = len(keys)
    g = r.groupingSets([*([k] for k in keys), []], *keys).agg(F.sum(F.abs(F.col("value"))).alias("gross"), F.grouping_id().alias("gid"))
    every = (1 << n) - 1
    dim, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, k in enumerate(keys):
        own = F.col("gid") == every ^ (1 << (n - 1 - i))
        dim, key = F.when(own, F.lit(k)).otherwise(dim), F.when(own, F.col(k).cast("string")).otherwise(key)
    # the total reaches the rows of a key through a window over that key's few aggregated rows
    rows = g.select(F.explode(F.when(F.col("gid") == every, F.array(*map(F.lit, keys))).otherwise(F.array(dim))).alias("dim"),
                    key.alias("key"), "gross", (F.col("gid") == every).alias("is_total"))
    total = F.max(F.when(F.col("is_total"), F.col("gross"))).over(Window.partitionBy("dim"))
    return rows.withColumn("total", total).where(~F.col("is_total")).select(
        "dim", "key", F.col("gross").cast("double").alias("gross_value"), F.round(F.col("gross") / F.col("total"), 6).cast("double").alias("share"))


def currency_scenario_matrix(r: DataFrame) -> DataFrame:
    """Currency × scenario pivot with the fixed scenario list (conditional sums:
    one aggregation, no extra job to discover pivot values)."""
    aggs = [F.sum(F.when(F.col("scenario") == s, F.col("value"))).cast("double").alias(c)
            for s, c in zip(SCENARIOS, SCENARIO_COLUMNS)]
    return r.groupBy("currency").agg(*aggs)


def top_measure_points(r: DataFrame, n: int = 5) -> DataFrame:
    g = r.groupBy("measure_point").agg(F.sum(F.abs("value")).alias("gross_value"))
    return (g.orderBy(F.col("gross_value").desc(), F.col("measure_point"))
             .limit(n).select("measure_point", F.col("gross_value").cast("double").alias("gross_value")))


def top_deals(r: DataFrame, n: int = 5) -> DataFrame:
    g = r.groupBy("measure", "deal").agg(F.sum("value").alias("net_value"))
    w = Window.partitionBy("measure").orderBy(F.col("net_value").desc(), F.col("deal"))
    return (g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
             .select("measure", "deal", F.col("net_value").cast("double").alias("net_value"), "rank"))


def monthly_trend(r: DataFrame) -> DataFrame:
    m = (r.groupBy("measure", F.trunc("valuation_date", "month").alias("month"))
          .agg(F.sum("value").alias("total")))
    w = Window.partitionBy("measure").orderBy("month")
    prev = F.lag("total").over(w)
    return m.select("measure", F.date_format("month", "yyyy-MM").alias("month"),
                    F.col("total").cast("double").alias("total_value"),
                    (F.col("total") - prev).cast("double").alias("change"))


def daily_totals(r: DataFrame, key: str) -> DataFrame:
    return r.groupBy(key, "valuation_date").agg(F.sum("value").cast("double").alias("daily"))


def outliers(r: DataFrame, key: str = "risk_factor", z: float = 3.0) -> DataFrame:
    """Days whose total for ``key`` is more than ``z`` standard deviations from
    that key's mean.  Statistics per key are a small aggregate joined back."""
    d = daily_totals(r, key)
    st = d.groupBy(key).agg(F.avg("daily").alias("mu"), F.stddev_samp("daily").alias("sd"))
    zc = (F.col("daily") - F.col("mu")) / F.col("sd")
    return (d.join(st, key).where(F.abs(zc) > z)
             .select(key, F.date_format("valuation_date", "yyyy-MM-dd").alias("valuation_date"),
                     F.round("daily", 2).alias("daily_value"), F.round(zc, 4).alias("z_score")))


def stability(r: DataFrame, key: str = "book") -> DataFrame:
    d = daily_totals(r, key)
    return d.groupBy(key).agg(
        F.round(F.avg("daily"), 4).alias("mean_daily"),
        F.round(F.stddev_samp("daily"), 4).alias("sd_daily"),
        F.round(F.stddev_samp("daily") / F.abs(F.avg("daily")), 6).alias("cv"),
        F.count("*").alias("n_days"))


def scenario_compare(r: DataFrame) -> DataFrame:
    per = r.groupBy("measure", "scenario").agg(F.sum("value").alias("total"))
    return per.groupBy("measure").agg(
        F.expr("min_by(scenario, struct(total, scenario))").alias("worst_scenario"),
        F.min("total").cast("double").alias("worst_total"),
        F.expr("min_by(scenario, struct(-total, scenario))").alias("best_scenario"),
        F.max("total").cast("double").alias("best_total"))


def factor_correlation(r: DataFrame) -> DataFrame:
    """Pearson correlation of daily totals for every pair of risk factors; a
    factor without a row (or with null values alone) on a day counts as 0 that
    day.  A factor of one constant daily total has the correlation null.

    The star is aggregated once to (factor, day).  Sums and squares per factor
    and, where two factors meet on a day, products per pair give the
    correlation in closed form, for any number of factors.  The pairs come from
    the table of factors, so two factors that never meet have their row too."""
    x = F.col("daily")
    daily = daily_totals(r.where(F.col("risk_factor").isNotNull()), "risk_factor").withColumn("daily", F.coalesce(x, F.lit(0.0)))
    days = r.agg(F.count_distinct("valuation_date") + F.max(F.col("valuation_date").isNull().cast("int"))).scalar()
    # a constant factor is told by its values: the difference of its sums need not come out as 0
    varies = (F.min(x) < F.max(x)) | ((F.count(x) < days) & (F.max(x) != 0))
    one = daily.groupBy("risk_factor").agg(F.sum(x).alias("s"), F.when(varies, F.sum(x * x)).alias("q"))
    # the factors of a day, as one array, give its products: no join of the daily totals with themselves
    per_day = daily.groupBy("valuation_date").agg(F.array_sort(F.collect_list(F.struct("risk_factor", "daily"))).alias("f"))
    pairs = per_day.select(F.posexplode("f").alias("i", "a"), "f").select("a", F.explode(F.expr("slice(f, i + 2, size(f))")).alias("b"))
    both = pairs.groupBy(F.col("a.risk_factor").alias("factor_a"), F.col("b.risk_factor").alias("factor_b")) \
        .agg(F.sum(F.col("a.daily") * F.col("b.daily")).alias("p"))
    a, b = one.select(F.col("risk_factor").alias("factor_a"), F.col("s").alias("sa"), F.col("q").alias("qa")), \
        one.select(F.col("risk_factor").alias("factor_b"), F.col("s").alias("sb"), F.col("q").alias("qb"))
    cov = days * F.coalesce("p", F.lit(0.0)) - F.col("sa") * F.col("sb")
    spread_a, spread_b = days * F.col("qa") - F.col("sa") * F.col("sa"), days * F.col("qb") - F.col("sb") * F.col("sb")
    # one row per pair, as in the result
    return a.join(b, F.col("factor_a") < F.col("factor_b")).join(both, ["factor_a", "factor_b"], "left").select(
        "factor_a", "factor_b", F.round(F.try_divide(cov, F.sqrt(spread_a) * F.sqrt(spread_b)), 6).alias("correlation"))


def offsets(r: DataFrame, key: str = "deal") -> DataFrame:
    pos = F.sum(F.when(F.col("value") > 0, F.col("value")).otherwise(0))
    neg = F.sum(F.when(F.col("value") < 0, -F.col("value")).otherwise(0))
    g = r.groupBy(key).agg(pos.alias("long_value"), neg.alias("short_value"))
    return g.where((F.col("long_value") > 0) & (F.col("short_value") > 0)).select(
        key, F.col("long_value").cast("double").alias("long_value"),
        F.col("short_value").cast("double").alias("short_value"),
        (F.col("long_value") - F.col("short_value")).cast("double").alias("net_value"),
        F.round(F.least("long_value", "short_value") / F.greatest("long_value", "short_value"), 6)
         .cast("double").alias("offset_ratio"))


def missing_scenarios(r: DataFrame) -> DataFrame:
    """(date, scenario) pairs absent from the data, for every date present.

    Each date's scenario set is collected (bounded by the number of
    scenarios), the full set is one scalar subquery; ``array_except`` lists the
    gaps.  No dates × scenarios cross join."""
    all_sc = r.agg(F.array_sort(F.collect_set("scenario"))).scalar()
    per_day = r.groupBy("valuation_date").agg(F.collect_set("scenario").alias("seen"))
    return per_day.select(F.date_format("valuation_date", "yyyy-MM-dd").alias("valuation_date"),
                          F.explode(F.array_except(all_sc, F.col("seen"))).alias("missing_scenario"))


def update_frequency(r: DataFrame, key: str = "book") -> DataFrame:
    days = r.select(key, "valuation_date").distinct()
    w = Window.partitionBy(key).orderBy("valuation_date")
    gaps = days.withColumn("gap", F.datediff("valuation_date", F.lag("valuation_date").over(w)))
    return gaps.groupBy(key).agg(F.count("*").alias("n_dates"),
                                 F.round(F.avg("gap"), 6).alias("avg_gap_days"),
                                 F.max("gap").alias("max_gap_days"))


def audit(r: DataFrame) -> DataFrame:
    """Totals rolled up over measure and factor; ``ALL`` marks a rolled-up
    column, a null measure or factor stays null."""
    g = r.rollup("measure", "risk_factor").agg(
        F.sum("value").alias("total"), F.count("*").alias("n"), F.grouping_id().alias("level"),
        F.grouping("measure").alias("all_measures"), F.grouping("risk_factor").alias("all_factors"))
    return g.select(F.when(F.col("all_measures") == 1, "ALL").otherwise(F.col("measure")).alias("measure"),
                    F.when(F.col("all_factors") == 1, "ALL").otherwise(F.col("risk_factor")).alias("risk_factor"),
                    F.col("total").cast("double").alias("total_value"), "n", "level")
