"""Named queries: a Spark callable plus (when SQL can express it) the DuckDB
SQL that must return the same rows.  ``__spark_entry__`` exposes both maps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def attach_oracle(name: str, sql: str) -> None:
    """Give an already registered query its SQL oracle (for SQL that is built
    from pieces defined after the query)."""
    if name not in QUERIES:
        raise KeyError(name)
    ORACLE[name] = sql.strip()


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib

    for mod in MODULES:
        importlib.import_module(f"tessera.plans.{mod}")


MODULES = ("q_relational", "q_risk", "q_text", "q_search", "q_catalog", "q_eval", "q_nlq",
           "q_results", "q_stream")


def portable(df: DataFrame) -> DataFrame:
    """Output form shared with the SQL oracle: decimals as double, dates as
    ``yyyy-MM-dd`` text, timestamps as ``yyyy-MM-dd HH:mm:ss`` text (the same
    serialisation the NDJSON sink uses)."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        cols.append(c.alias(f.name))
    return df.select(*cols)
