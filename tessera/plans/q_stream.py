"""Registered queries for the streaming operators (batch forms over the
given tables; the streaming runs are checked against them in tests)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.q_results import _write_event_log
from tessera.plans.registry import portable, query
from tessera.sources import querylog as L
from tessera.streaming import streams as ST
from tessera.tables import load


@query("page_chunks")
def q_page_chunks(spark, d):
    """Page ingest: visible text → 512-character word chunks → ``url__i`` ids → vectors."""
    return ST.page_chunks(load(spark, d, "pages")).select("page_id", "doc_id", "chunk_ix",
                                                          F.length("text_content").alias("n_chars"),
                                                          F.size("embedding").alias("dim"))


@query("log_windows", """
SELECT strftime(time_bucket(INTERVAL '5 minutes', date_trunc('second', ts)), '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(time_bucket(INTERVAL '5 minutes', date_trunc('second', ts)) + INTERVAL '5 minutes', '%Y-%m-%d %H:%M:%S') AS window_end,
       'list all ' || event_type AS intent, COUNT(*) AS requests
FROM events GROUP BY ALL""")
def q_log_windows(spark, d):
    """Requests per intent per 5-minute tumbling window of the request log."""
    return portable(ST.usage_windows(L.read_query_log(spark, _write_event_log(spark, d))))


@query("cache_hits", """
WITH RECURSIVE ev AS (
  SELECT CAST(user_id AS VARCHAR) || '|' || event_type AS key, event_id, ts,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS pos
  FROM events),
walk(key, pos, event_id, ts, last_miss, hit) AS (
  SELECT key, pos, event_id, ts, ts, false FROM ev WHERE pos = 1
  UNION ALL
  SELECT e.key, e.pos, e.event_id, e.ts,
         CASE WHEN e.ts - w.last_miss < INTERVAL 30 MINUTE THEN w.last_miss ELSE e.ts END,
         e.ts - w.last_miss < INTERVAL 30 MINUTE
  FROM walk w JOIN ev e ON e.key = w.key AND e.pos = w.pos + 1)
SELECT key, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, hit FROM walk""")
def q_cache_hits(spark, d):
    """30-minute expiring cache over events keyed by (user, event type):
    hit when the last miss of the key is less than 30 minutes old."""
    return portable(ST.cache_hits(load(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id", 30))
