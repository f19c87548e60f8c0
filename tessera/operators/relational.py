"""Relational building blocks: derived views, filters, joins, aggregates, top-k, set ops.

Everything here returns a lazy DataFrame; Catalyst decides join strategies,
pushes filters into the parquet scan and prunes columns.  Broadcast hints are
only placed on sides whose size is fixed (TPC-H ``nation``/``region``) or was
configured (templates, intents).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.tables import load

# ---------------------------------------------------------------------------
# Derived views
# ---------------------------------------------------------------------------


def customer_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer → nation → region.  nation (25 rows) and region (5 rows) are
    fixed-size dimension tables, so broadcasting them is always safe."""
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = load(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
             .join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
             .select("c_custkey", "c_name", "c_mktsegment", "n_name", "r_name"))


def sales_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``sales`` star (grain: one row per lineitem) with the computed
    ``total_amount = quantity * unit_price`` column.

    lineitem ⋈ orders shuffles on the order key; the customer and part joins
    are left to Catalyst/AQE (broadcast when the statistics say the side is
    small, sort-merge otherwise, skew splitting on hot customer keys).
    """
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_quantity")
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    p = load(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    cr = customer_region(spark, sf_dir).select("c_custkey", "r_name")
    qty = F.col("l_quantity").cast("decimal(10,2)")
    price = F.col("p_retailprice").cast("decimal(10,2)")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
              .join(cr, o.o_custkey == cr.c_custkey)
              .join(p, li.l_partkey == p.p_partkey)
              .select(F.col("o_custkey").alias("customer_id"),
                      F.col("l_partkey").alias("product_id"),
                      F.to_date("l_shipdate").alias("sale_date"),
                      qty.alias("quantity"),
                      price.alias("unit_price"),
                      (qty * price).cast("decimal(12,2)").alias("total_amount"),
                      F.col("r_name").alias("region")))


def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sales ⋈ customers ⋈ products with the names carried along."""
    s = sales_view(spark, sf_dir)
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"),
                                                  F.col("c_name").alias("customer_name"))
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"),
                                              F.col("p_name").alias("product_name"))
    return s.join(c, "customer_id").join(p, "product_id")


def register_sales(spark: SparkSession, sf_dir: str, name: str = "sales") -> DataFrame:
    df = sales_view(spark, sf_dir)
    df.createOrReplaceTempView(name)
    return df


# ---------------------------------------------------------------------------
# Filters and projections
# ---------------------------------------------------------------------------

_TEXT_OPS = ("equals", "not-equals", "contains")
_NUM_OPS = ("greater-than", "less-than")


def apply_filters(df: DataFrame, filters: list[dict]) -> DataFrame:
    """AND of ``{column, operator, value}`` filters, the browser semantics:

    * equals / not-equals / contains compare the lower-cased text form;
    * greater-than / less-than compare numerically, a non-number never matches
      (and a null never matches: defect D8 resolved);
    * an empty value, an unknown column or an unknown operator passes.
    """
    conds: list[Column] = []
    cols = set(df.columns)
    for f in filters:
        col, op, val = f.get("column"), f.get("operator"), f.get("value")
        if col not in cols or val is None or str(val) == "":
            continue
        text = F.lower(F.col(col).cast("string"))
        v = str(val).lower()
        if op == "equals":
            conds.append(F.coalesce(text == F.lit(v), F.lit(False)))
        elif op == "not-equals":
            conds.append(F.coalesce(text != F.lit(v), F.lit(True)))
        elif op == "contains":
            conds.append(F.coalesce(text.contains(v), F.lit(False)))
        elif op in _NUM_OPS:
            num = F.col(col).cast("string").try_cast("double") if hasattr(Column, "try_cast") \
                else F.expr(f"try_cast(cast(`{col}` as string) as double)")
            try:
                fv = float(val)
            except ValueError:
                conds.append(F.lit(False))
                continue
            c = num > F.lit(fv) if op == "greater-than" else num < F.lit(fv)
            conds.append(F.coalesce(c, F.lit(False)))
    if not conds:
        return df
    return df.where(reduce(lambda a, b: a & b, conds))


def not_null(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull())


def first_columns(df: DataFrame, n: int = 4) -> DataFrame:
    return df.select(*df.columns[:n])


def last_n_days(df: DataFrame, col: str, n: int, asof: str) -> DataFrame:
    """``col >= date_sub(asof, n)``; the as-of date is a parameter so the
    result is reproducible (the reference used ``current_date``)."""
    return df.where(F.col(col) >= F.date_sub(F.to_date(F.lit(asof)), n))


def year_filter(df: DataFrame, col: str, year: int) -> DataFrame:
    """Year predicate written as a half-open date range so parquet min/max
    statistics can skip row groups (``date_format(col,'yyyy') = y`` cannot)."""
    return df.where((F.col(col) >= F.make_date(F.lit(year), F.lit(1), F.lit(1)))
                    & (F.col(col) < F.make_date(F.lit(year + 1), F.lit(1), F.lit(1))))


# ---------------------------------------------------------------------------
# Joins
# ---------------------------------------------------------------------------


def lookup_last(left: DataFrame, right: DataFrame, key: str, order: str,
                right_key: str | None = None) -> DataFrame:
    """1→0..1 lookup where the last ``order`` row of ``right`` wins.

    ``max_by`` is an ordinary partial aggregate, so a hot key is reduced map
    side before the shuffle."""
    rk = right_key or key
    value_cols = [c for c in right.columns if c != rk]
    last = (right.groupBy(rk)
                 .agg(F.max_by(F.struct(*value_cols), F.col(order)).alias("_last"))
                 .select(F.col(rk).alias(key), "_last.*"))
    return left.join(last, key, "left")


def missing_in(left: DataFrame, right: DataFrame, left_key: str, right_key: str | None = None) -> DataFrame:
    """Rows of ``left`` with no partner in ``right`` (null-safe ``NOT IN``)."""
    rk = right_key or left_key
    keys = right.select(F.col(rk).alias("_k")).where(F.col("_k").isNotNull()).distinct()
    return left.join(keys, F.col(left_key) == F.col("_k"), "left_anti")


PHRASES_PER_CASE = 250


def match_phrases(left: DataFrame, text_col: str, phrases: DataFrame, phrase_col: str,
                  ord_col: str, out_cols: list[str]) -> DataFrame:
    """The first declared phrase that each row's lower-cased text contains.

    ``phrases`` is a configuration table.  Its rows become ``CASE`` chains in
    declaration order, ``PHRASES_PER_CASE`` to a chain; the first chain with an
    answer wins.  The same plan at every number of phrases: no join, no shuffle,
    and equal rows of ``left`` stay separate."""
    rows = phrases.orderBy(ord_col).select(phrase_col, *out_cols).collect()
    lt = F.lower(F.col(text_col))
    chains = []
    for i in range(0, len(rows), PHRASES_PER_CASE):
        chain = F
        for r in rows[i:i + PHRASES_PER_CASE]:
            chain = chain.when(lt.contains(r[phrase_col]), F.struct(*[F.lit(r[c]).alias(c) for c in out_cols]))
        chains.append(chain)
    if not chains:
        return left.select("*", *[F.lit(None).cast(phrases.schema[c].dataType).alias(c) for c in out_cols])
    return left.withColumn("_m", F.coalesce(*chains)).select(*left.columns, *[F.col(f"_m.{c}").alias(c) for c in out_cols])


# ---------------------------------------------------------------------------
# Aggregation helpers
# ---------------------------------------------------------------------------


def group_sum(df: DataFrame, key: str | list[str], val: str, alias: str = "total") -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    return df.groupBy(*keys).agg(F.sum(val).alias(alias))


def top_groups(df: DataFrame, key: str, val: str, n: int, alias: str = "total") -> DataFrame:
    """GROUP BY key ORDER BY SUM(val) DESC LIMIT n, ties broken by key."""
    return (group_sum(df, key, val, alias)
            .orderBy(F.col(alias).desc(), F.col(key).asc()).limit(n))


def rank_within(df: DataFrame, part: list[str], order: list[Column], k: int,
                rank_col: str = "rank") -> DataFrame:
    """Keep the first ``k`` rows per partition.  Spark plans the
    ``row_number() <= k`` filter with a partial WindowGroupLimit before the
    shuffle, so even a partition key holding a third of all rows only ships
    ``k`` rows per map task."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def first_n(df: DataFrame, n: int, order: list[Column], part: list[str] | None = None) -> DataFrame:
    if part:
        return rank_within(df, part, order, n, "row_ix")
    return df.orderBy(*order).limit(n)


def latest(df: DataFrame, id_col: str, n: int) -> DataFrame:
    return df.orderBy(F.col(id_col).desc()).limit(n)


# ---------------------------------------------------------------------------
# Set operations
# ---------------------------------------------------------------------------


def union_all(*dfs: DataFrame, allow_missing: bool = True) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), dfs)


def diff_results(a: DataFrame, b: DataFrame) -> DataFrame:
    """Multiset difference both ways with a ``side`` marker."""
    return (a.exceptAll(b).withColumn("side", F.lit("only_left"))
             .unionByName(b.exceptAll(a).withColumn("side", F.lit("only_right"))))


def scale_up(df: DataFrame, times: int = 1) -> DataFrame:
    """The table doubled ``times`` times (``INSERT … SELECT`` self-append)."""
    out = df
    for _ in range(times):
        out = out.unionByName(out)
    return out
