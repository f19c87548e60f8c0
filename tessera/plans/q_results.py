"""Registered result-tool, sink and log queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import results as RS
from tessera.operators.relational import sales_view
from tessera.operators.risk import risk_view
from tessera.plans.registry import portable, query
from tessera.plans.sqlviews import with_risk, with_sales
from tessera.session import scratch_path
from tessera.sources import ndjson as J
from tessera.sources import querylog as L
from tessera.tables import load


@query("chart_agg", with_sales("""
SELECT region AS label, COUNT(*) AS count, CAST(SUM(total_amount) AS DOUBLE) AS sum,
       ROUND(CAST(AVG(total_amount) AS DOUBLE), 4) AS average, MIN(CAST(total_amount AS DOUBLE)) AS minimum,
       MAX(CAST(total_amount AS DOUBLE)) AS maximum, CAST(MIN(sale_date) AS VARCHAR) AS first_seen
FROM sales GROUP BY region"""))
def q_chart_agg(spark, d):
    """All chart aggregates of sale amount by region, labels ordered by first sale."""
    df = RS.chart_agg(sales_view(spark, d), "region", "total_amount", order_col="sale_date")
    return portable(df).withColumn("average", F.round("average", 4))


@query("auto_chart", """
SELECT event_type AS label, ROUND(SUM(COALESCE(value, 0)), 6) AS value, 'event_type' AS x_axis, 'value' AS y_axis,
       'sum' AS fn
FROM events GROUP BY event_type""")
def q_auto_chart(spark, d):
    """Default chart of an events result: first column by first numeric column."""
    e = load(spark, d, "events").select("event_type", "value", "user_id")
    # double sums depend on summation order in the last bits: 6 places are kept
    return RS.auto_chart_agg(e).withColumn("value", F.round("value", 6))


@query("summary_table", with_risk("""
SELECT desk, ROUND(AVG(CAST(value AS DOUBLE)), 6) AS avg_value, MAX(CAST(value AS DOUBLE)) AS max_value,
       MIN(CAST(value AS DOUBLE)) AS min_value,
       ROUND(quantile_cont(CAST(value AS DOUBLE), 0.5), 6) AS p50_value,
       ROUND(quantile_cont(CAST(value AS DOUBLE), 0.95), 6) AS p95_value
FROM risk GROUP BY desk"""))
def q_summary(spark, d):
    return RS.summarize(risk_view(spark, d), ["desk"], ["value"], (0.5, 0.95))


@query("ndjson_rows", """
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events
WHERE json_valid(props) AND json_type(props) = 'OBJECT'""")
def q_ndjson_rows(spark, d):
    """JSON lines (the events ``props`` column) split into rows."""
    rows, _, _ = J.parse_ndjson(load(spark, d, "events"), "props", keep=("event_id",))
    return rows.select("event_id", F.try_variant_get("row", "$.k", "int").alias("k"))


@query("ndjson_out", with_sales("""
SELECT CAST(to_json({'customer_id': customer_id, 'product_id': product_id, 'sale_date': strftime(sale_date, '%Y-%m-%d'),
                'quantity': CAST(quantity AS DOUBLE), 'unit_price': CAST(unit_price AS DOUBLE),
                'total_amount': CAST(total_amount AS DOUBLE), 'region': region}) AS VARCHAR) AS value
FROM sales"""))
def q_ndjson_out(spark, d):
    """Sales rows serialised as NDJSON (ISO dates, decimals as floats)."""
    return J.ndjson_lines(sales_view(spark, d))


@query("ndjson_events", """
SELECT '{"event_id":' || CAST(event_id AS VARCHAR) || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S')
       || CASE WHEN event_id % 3 = 0 THEN '.' || lpad(CAST(event_id % 999983 + 1 AS VARCHAR), 6, '0') ELSE '' END
       || '","user_id":' || CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE 'null' END || '}' AS value
FROM (SELECT event_id, date_trunc('second', ts) AS ts, user_id FROM events)""")
def q_ndjson_events(spark, d):
    """Events as NDJSON with null fields and fractions of a second."""
    e = load(spark, d, "events").select("event_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"), "user_id")
    micros = F.unix_micros("ts") + F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 999983 + 1).otherwise(0)
    return J.ndjson_lines(e.select("event_id", F.timestamp_micros(micros).alias("ts"),
                                   F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("user_id")))


@query("csv_out", """
SELECT CAST(c_custkey AS VARCHAR) || ',' || COALESCE(to_json(c_name)::VARCHAR, '""') || ',' || CAST(c_nationkey AS VARCHAR)
       || ',' || CAST(c_acctbal AS VARCHAR) || ',' || COALESCE(to_json(c_mktsegment)::VARCHAR, '""') AS value
FROM customer""")
def q_csv_out(spark, d):
    """Customer rows as CSV lines (quoted text, bare numbers)."""
    return J.csv_lines(load(spark, d, "customer"))


def _write_event_log(spark, d) -> str:
    e = load(spark, d, "events").select(
        "ts", F.concat(F.lit("10.0."), (F.col("user_id") % 256).cast("string"), F.lit("."),
                       (F.col("user_id") / 256).cast("long").cast("string")).alias("ip"),
        F.lit("curl/8.5.0").alias("ua"), F.col("event_type").alias("model"),
        F.concat(F.lit("list all "), F.col("event_type")).alias("intent"),
        F.concat(F.lit("SELECT * FROM events WHERE event_id = "), F.col("event_id").cast("string")).alias("sql"))
    path = scratch_path(spark, f"querylog-{uuid.uuid4().hex[:12]}")
    L.format_log_records(e, "ts", "ip", "ua", "model", "intent", "sql").write.text(path)
    return path


@query("query_log", """
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
       '10.0.' || CAST(user_id % 256 AS VARCHAR) || '.' || CAST(user_id // 256 AS VARCHAR) AS client_ip,
       'curl/8.5.0' AS user_agent, event_type AS model, 'list all ' || event_type AS intent,
       'SELECT * FROM events WHERE event_id = ' || CAST(event_id AS VARCHAR) AS sql
FROM events""")
def q_query_log(spark, d):
    """A request log written from the events, read back record by record."""
    return portable(L.read_query_log(spark, _write_event_log(spark, d)))


@query("log_usage", """
SELECT 'list all ' || event_type AS intent, event_type AS model,
       '10.0.' || CAST(user_id % 256 AS VARCHAR) || '.' || CAST(user_id // 256 AS VARCHAR) AS client_ip,
       COUNT(*) AS requests
FROM events GROUP BY ALL""")
def q_log_usage(spark, d):
    """Requests per intent, model and client from the request log."""
    return L.log_usage(L.read_query_log(spark, _write_event_log(spark, d)))
