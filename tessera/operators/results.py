"""Result-set tools: chart aggregation, default chart axes, summary tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.writes import write_staged

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
CHART_FUNCTIONS = ("count", "sum", "average", "minimum", "maximum")


def is_numeric(dt: T.DataType) -> bool:
    """Numbers are numeric (decimals included: they are served as floats);
    booleans and dates are not."""
    return isinstance(dt, _NUMERIC)


def chart_agg(df: DataFrame, x: str, y: str, fns=CHART_FUNCTIONS, order_col: str | None = None) -> DataFrame:
    """Aggregate ``y`` by ``x`` for a chart.  A non-numeric or null ``y`` counts
    as 0; a null ``x`` is its own group; ``first_seen`` (the smallest
    ``order_col``) gives the label order of first appearance."""
    ytype = df.schema[y].dataType
    if isinstance(ytype, T.DecimalType):
        yv = F.coalesce(F.col(y), F.lit(0).cast(ytype))  # exact sums for money
    elif is_numeric(ytype):
        yv = F.coalesce(F.col(y).cast("double"), F.lit(0.0))
    else:
        yv = F.lit(0.0)
    aggs = {"count": F.count(F.lit(1)).alias("count"), "sum": F.sum(yv).alias("sum"),
            "average": F.avg(yv).alias("average"), "minimum": F.min(yv).alias("minimum"),
            "maximum": F.max(yv).alias("maximum")}
    cols = [aggs[f] for f in fns]
    if order_col:
        cols.append(F.min(order_col).alias("first_seen"))
    return df.groupBy(F.col(x).alias("label")).agg(*cols)


def auto_chart(df: DataFrame) -> tuple[str, str, str]:
    """Default axes: x = first column; y = first numeric column with ``sum``,
    else the first column with ``count``."""
    fields = df.schema.fields
    x = fields[0].name
    num = next((f.name for f in fields if is_numeric(f.dataType)), None)
    return (x, num, "sum") if num else (x, x, "count")


def auto_chart_agg(df: DataFrame) -> DataFrame:
    x, y, fn = auto_chart(df)
    return chart_agg(df, x, y, [fn]).withColumnRenamed(fn, "value") \
        .withColumn("x_axis", F.lit(x)).withColumn("y_axis", F.lit(y)).withColumn("fn", F.lit(fn))


def ranked(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys``, ``value``, ``rank`` (from 0, ascending within a group) of all
    rows with a value.  The sort is range-partitioned on keys and value, so a
    large group spreads over many tasks; a row's rank is its place within its
    part plus the sizes of the group's earlier parts.  The sorted rows are
    written once, which fixes the parts."""
    spark = df.sparkSession
    tie = F.xxhash64(*df.columns)  # equal values of one group may lie in several parts
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias(value), tie.alias("_tie"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *keys, value, "_tie").drop("_tie") \
        .withColumn("_part", F.spark_partition_id())
    dealt = spark.read.schema(dealt.schema).parquet(write_staged(dealt, spark, "ranked"))
    sizes = dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = _keyed(sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))), keys, F.col("_part").alias("_at"), "_before")
    place = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(value)) - 1
    return dealt.withColumn("_place", place).join(offsets, _same(keys) & (F.col("_part") == F.col("_at"))) \
        .select(*keys, value, (F.col("_place") + F.col("_before")).alias("rank"))


def _keyed(df: DataFrame, keys: list[str], *cols) -> DataFrame:
    """``cols`` with the keys renamed, for a null-safe join by :func:`_same`."""
    return df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *cols)


def _same(keys: list[str]):
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])


def summarize(df: DataFrame, keys: list[str], vals: list[str], pcts=(0.5, 0.95)) -> DataFrame:
    """Pre-aggregated summary: avg, max, min and exact (interpolated)
    percentiles per group.  A percentile needs the one or two rows at its rank,
    found by :func:`ranked`: no group's values are held together."""
    aggs = []
    for v in vals:
        c = F.col(v).cast("double")
        aggs += [F.round(F.avg(c), 6).alias(f"avg_{v}"), F.max(c).alias(f"max_{v}"), F.min(c).alias(f"min_{v}"), F.count(c).alias(f"_n_{v}")]
    out = df.groupBy(*keys).agg(*aggs)
    for v in vals:
        at = {f"p{int(round(p * 100))}_{v}": F.lit(float(p)) * (F.col("_n") - 1) for p in pcts}
        joined = ranked(df, keys, v).join(_keyed(out, keys, F.col(f"_n_{v}").alias("_n")), _same(keys))
        value = lambda r: F.max(F.when(F.col("rank") == r, F.col(v)))
        cols = []
        for name, p in at.items():
            low, part = value(F.floor(p)), F.max(p - F.floor(p))
            cols.append(F.round(low + part * (value(F.ceil(p)) - low), 6).alias(name))
        wanted = reduce(lambda a, b: a | b, [(F.col("rank") == F.floor(p)) | (F.col("rank") == F.ceil(p)) for p in at.values()])
        found = _keyed(joined.where(wanted).groupBy(*keys).agg(*cols), keys, *at)
        out = out.join(found, _same(keys), "left").drop(*[f"_k{i}" for i in range(len(keys))])
    order = [f"{f}_{v}" for v in vals for f in ("avg", "max", "min", *[f"p{int(round(p * 100))}" for p in pcts])]
    return out.select(*keys, *order)
