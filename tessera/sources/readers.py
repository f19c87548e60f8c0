"""Table sources: JDBC query, SQL (Hive/catalog), parquet path, and a registry
that maps a ``source_type`` to one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jdbc(spark: SparkSession, options: dict, query: str | None = None, table: str | None = None,
              partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
              num_partitions: int | None = None) -> DataFrame:
    """Relational source by query.  With ``partition_column`` the read is split
    into ``num_partitions`` range queries executed by the executors in
    parallel (one connection per partition) instead of one cursor."""
    r = spark.read.format("jdbc").options(**options)
    if query is not None and partition_column is None:
        r = r.option("query", query)
    else:
        src = table if table is not None else f"({query}) q"
        r = r.option("dbtable", src)
    if partition_column is not None:
        r = (r.option("partitionColumn", partition_column)
              .option("lowerBound", str(lower)).option("upperBound", str(upper))
              .option("numPartitions", str(num_partitions or 8)))
    return r.load()


def read_sql(spark: SparkSession, sql: str, args: dict | None = None) -> DataFrame:
    """SQL source over the session catalog (Hive metastore tables or views)."""
    return spark.sql(sql, args=args) if args else spark.sql(sql)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


REGISTRY_SCHEMA = "source_type string, query_or_path string"


def demo_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ``data_queries`` registry: parquet path, catalog query, one unknown type."""
    rows = [("parquet", f"{sf_dir.rstrip('/')}/supplier.parquet"),
            ("hive", "SELECT * FROM supplier"),
            ("mongo", "db.sales.find()")]
    return spark.createDataFrame(rows, REGISTRY_SCHEMA)


class SourceError(ValueError):
    pass


def load_source(spark: SparkSession, registry: DataFrame, source_type: str) -> DataFrame:
    """Look up the first registry row of ``source_type`` and dispatch.

    The registry is a small configuration table; only one row is fetched to
    the driver.  Raises :class:`SourceError` when the type has no row or no
    reader.
    """
    row = registry.where(F.col("source_type") == source_type).limit(1).collect()
    if not row:
        raise SourceError(f"no data source registered for {source_type!r}")
    target = row[0]["query_or_path"]
    if source_type == "parquet":
        return read_parquet(spark, target)
    if source_type in ("hive", "sql"):
        return read_sql(spark, target)
    raise SourceError(f"unknown source type {source_type!r}")
