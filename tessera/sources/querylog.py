"""Query-log reader: records separated by ``---`` lines, a header
``[ts] IP: …, UA: …, Model: …`` then ``Intent:``/``Prompt:`` and
``SQL:``/``Generated SQL:`` lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD_SEP = "\n---\n"
HEADER_RE = r"\[([^\]]+)\] IP: ([^,]*), UA: (.*), Model: ([^\n]*)"


def parse_log_records(records: DataFrame, col: str = "value") -> DataFrame:
    r = F.col(col)
    return records.where(F.length(F.trim(r)) > 0).select(
        F.to_timestamp(F.regexp_extract(r, HEADER_RE, 1), "yyyy-MM-dd HH:mm:ss").alias("ts"),
        F.regexp_extract(r, HEADER_RE, 2).alias("client_ip"),
        F.regexp_extract(r, HEADER_RE, 3).alias("user_agent"),
        F.regexp_extract(r, HEADER_RE, 4).alias("model"),
        F.nullif(F.regexp_extract(r, r"(?m)^(?:Intent|Prompt): (.*)$", 1), F.lit("")).alias("intent"),
        F.nullif(F.regexp_extract(r, r"(?ms)^(?:Generated SQL|SQL): (.*?)\s*$", 1), F.lit("")).alias("sql"))


def read_query_log(spark: SparkSession, path: str) -> DataFrame:
    """One row per record; the empty lead record before the first separator
    is dropped."""
    raw = spark.read.option("lineSep", RECORD_SEP).text(path)
    return parse_log_records(raw)


def format_log_records(df: DataFrame, ts: str, ip: str, ua: str, model: str, intent: str, sql: str) -> DataFrame:
    """Render rows as log records (the writer side, for producing logs)."""
    return df.select(F.concat(F.lit(RECORD_SEP), F.lit("["), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"),
                              F.lit("] IP: "), F.col(ip), F.lit(", UA: "), F.col(ua), F.lit(", Model: "),
                              F.col(model), F.lit("\nIntent: "), F.col(intent), F.lit("\nSQL: "), F.col(sql))
                     .alias("value"))


def log_usage(log: DataFrame) -> DataFrame:
    """Requests per intent, model and client."""
    return log.groupBy("intent", "model", "client_ip").agg(F.count(F.lit(1)).alias("requests"))
