"""Structured Streaming jobs.

* ``stream_pages``  — new pages → visible text → word chunks → ids → hashed
  vectors, appended per micro-batch under ``epoch=<id>`` with a marker row per
  page; readers resolve the newest epoch per page, so a re-ingested shorter or
  emptied page drops its old chunks (D9) and a replayed epoch overwrites itself.
* ``stream_embed`` — incremental embedding: texts whose id is not yet in the
  output are embedded (anti join per micro-batch).
* ``stream_log_usage`` — request-log records → requests per intent in
  5-minute tumbling windows with a watermark (late records dropped).
* ``stream_cache`` — repeated-request suppression with an expiring cache
  keyed by request: exact hit/miss flags with ``applyInPandasWithState``
  (expiry counts from the last miss; hits do not renew).

Checkpoints live under the shared ``spark.checkpoint.dir`` unless a path is
given, so a restarted driver or lost executor resumes from the last
committed offsets.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.session import path_exists, scratch_path
from tessera.sources import querylog as L
from tessera.streaming.cache_segments import chain

PAGE_SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                            T.StructField("html", T.StringType())])


# ---------------------------------------------------------------------------
# Page ingest
# ---------------------------------------------------------------------------


def page_chunks(pages: DataFrame, max_len: int = 512) -> DataFrame:
    """pages → visible text → word chunks with ``url__i`` ids → vectors."""
    txt = X.page_text(pages)
    ch = X.word_chunks(txt, "text", max_len, ("page_id", "url"))
    return ch.select("page_id", "url", X.chunk_id("url", "chunk_ix").alias("doc_id"), "chunk_ix",
                     F.col("content").alias("text_content"), V.hash_embed("content").alias("embedding"))


def page_versions(batch: DataFrame) -> DataFrame:
    """One version per url of a batch: the one of the largest page id (of
    equals, the html that sorts last)."""
    return batch.groupBy("url").agg(F.max_by(F.struct("page_id", "html"), F.struct("page_id", "html")).alias("v")) \
                .select("v.page_id", "url", "v.html")


def indexed_pages(batch: DataFrame, max_len: int = 512) -> DataFrame:
    """Chunks of a batch plus one marker row per page (``chunk_ix`` null), so a
    page that has become empty still counts as ingested."""
    pages = page_versions(batch)
    marker = pages.select("page_id", "url")
    return page_chunks(pages, max_len).unionByName(marker, allowMissingColumns=True)


def latest_page_chunks(index: DataFrame) -> DataFrame:
    """Chunks of the newest epoch of every page (the upserted view)."""
    newest = index.groupBy("url").agg(F.max("epoch").alias("epoch"))
    return index.join(newest, ["url", "epoch"]).where("chunk_ix IS NOT NULL")


def stream_pages(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str | None = None,
                 available_now: bool = True):
    src = spark.readStream.schema(PAGE_SCHEMA).parquet(in_dir)

    def write_batch(batch: DataFrame, epoch: int) -> None:
        indexed_pages(batch).write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch}")

    w = src.writeStream.foreachBatch(write_batch).option(
        "checkpointLocation", checkpoint or scratch_path(spark, "ckpt-pages"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


# ---------------------------------------------------------------------------
# Incremental embedding
# ---------------------------------------------------------------------------


def stream_embed(spark: SparkSession, in_dir: str, schema: T.StructType, id_col: str, text_col: str,
                 out_dir: str, checkpoint: str | None = None, available_now: bool = True):
    """Embed only texts whose id has no vector from an earlier batch.  A
    replayed batch doesn't see what its first attempt wrote, so it writes the
    same rows again over it."""
    src = spark.readStream.schema(schema).parquet(in_dir)
    written = T.StructType([schema[id_col], T.StructField("epoch", T.LongType())])

    def write_batch(batch: DataFrame, epoch: int) -> None:
        todo = batch.select(id_col, text_col).dropDuplicates([id_col])
        if path_exists(spark, out_dir):
            done = spark.read.schema(written).parquet(out_dir).where(F.col("epoch") < epoch).select(id_col)
            todo = todo.join(done, id_col, "left_anti")
        (todo.select(id_col, V.hash_embed(text_col).alias("embedding"))
             .write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch}"))

    w = src.writeStream.foreachBatch(write_batch).option(
        "checkpointLocation", checkpoint or scratch_path(spark, "ckpt-embed"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


# ---------------------------------------------------------------------------
# Request-log usage per window
# ---------------------------------------------------------------------------


def usage_windows(log: DataFrame, window: str = "5 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Requests per intent per tumbling window (batch or streaming input)."""
    return (log.withWatermark("ts", watermark)
               .groupBy(F.window("ts", window).alias("w"), "intent")
               .agg(F.count(F.lit(1)).alias("requests"))
               .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                       "intent", "requests"))


def stream_log_usage(spark: SparkSession, log_dir: str, out_dir: str, checkpoint: str | None = None,
                     available_now: bool = True):
    raw = spark.readStream.option("lineSep", L.RECORD_SEP).text(log_dir)
    agg = usage_windows(L.parse_log_records(raw))
    w = (agg.writeStream.outputMode("append").format("parquet").option("path", out_dir)
            .option("checkpointLocation", checkpoint or scratch_path(spark, "ckpt-usage")))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


# ---------------------------------------------------------------------------
# Expiring request cache
# ---------------------------------------------------------------------------

CACHE_OUT = T.StructType([T.StructField("key", T.StringType()), T.StructField("event_id", T.LongType()),
                          T.StructField("ts", T.TimestampType()), T.StructField("hit", T.BooleanType())])


def _hits(key: np.ndarray, ts: np.ndarray, ttl_us: int, miss=None) -> tuple[np.ndarray, int]:
    """Hit flags of events sorted by key and time (µs), and the last miss.
    ``miss`` is the last miss of the first key before these events.

    The next possible miss of an event is the first one ``ttl`` later, or the
    next key's first event; misses are the chain of these pointers."""
    run = np.cumsum(np.r_[0, key[1:] != key[:-1]])
    apart = int(ts.max()) - int(ts.min()) + 2 * ttl_us + 1
    line = (ts - ts.min()) + run * apart
    start = 0 if miss is None else int(np.searchsorted(line, miss - int(ts.min()) + ttl_us))
    if start:  # past the first key, its successor's first event is a miss anyway
        start = min(start, int(np.searchsorted(run, 1)))
    missed = chain(np.searchsorted(line, line + ttl_us), start)
    own = np.flatnonzero(missed & (run == run[-1]))
    last = int(ts[own[-1]]) if len(own) else miss
    return ~missed, last


def _to_us(s: pd.Series) -> pd.Series:
    return s.astype("datetime64[us]").astype("int64")


def stream_cache(events: DataFrame, key_cols: list[str], ts_col: str, id_col: str, ttl_minutes: int = 30,
                 watermark: str = "1 hour") -> DataFrame:
    """Streaming hit/miss flags per request key with exact expiry: state is the
    last miss time; it is dropped once the watermark passes miss + ttl."""
    ttl_us = ttl_minutes * 60 * 1_000_000
    # event time must be a session-zone TIMESTAMP for watermarks (UTC sessions:
    # a TIMESTAMP_NTZ column converts to the same instants)
    keyed = events.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, watermark).select(
        F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols]).alias("key"),
        F.col(id_col).cast("long").alias("event_id"), F.col(ts_col).alias("ts"))

    def step(key, pdfs: Iterator[pd.DataFrame], state):
        from pyspark.sql.streaming.state import GroupState  # noqa: F401

        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(pdfs)).sort_values(["ts", "event_id"])
        last = state.get[0] if state.exists else None
        ts = _to_us(pdf["ts"]).to_numpy()
        flags, last = _hits(np.zeros(len(ts), np.int64), ts, ttl_us, last)
        state.update((int(last),))
        state.setTimeoutTimestamp(int(last // 1000) + ttl_us // 1000)
        yield pd.DataFrame({"key": key[0], "event_id": pdf["event_id"].to_numpy(), "ts": pdf["ts"].to_numpy(),
                            "hit": flags})

    return keyed.groupBy("key").applyInPandasWithState(
        step, CACHE_OUT, T.StructType([T.StructField("last_miss_us", T.LongType())]),
        "append", "EventTimeTimeout")


HOT_KEY_ROWS = 1_000_000


def cache_hits(df: DataFrame, key_cols: list[str], ts_col: str, id_col: str, ttl_minutes: int = 30,
               method: str = "auto", segment_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Batch form of :func:`stream_cache`.

    ``method="scan"``: rows are hash-partitioned by key and sorted by time;
    one pass over Arrow batches carries each key's last miss (memory-bounded,
    but a key is scanned by one task).  ``method="segmented"``: range
    partitioning cuts hot keys into bounded segments that are resolved in
    parallel (:mod:`tessera.streaming.cache_segments`).  ``"auto"`` measures
    the largest key (one partial aggregation) and segments only when it
    exceeds ``segment_rows``.
    """
    ttl_us = ttl_minutes * 60 * 1_000_000
    keyed = df.select(F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols]).alias("key"),
                      F.col(id_col).cast("long").alias("event_id"), F.col(ts_col).cast("timestamp").alias("ts"))
    if method == "auto":
        biggest = keyed.groupBy("key").count().agg(F.max("count")).first()[0] or 0
        method = "segmented" if biggest > segment_rows else "scan"
    if method == "segmented":
        from tessera.streaming.cache_segments import segmented_flags

        total = keyed.count()
        segments = max(keyed.sparkSession.sparkContext.defaultParallelism, -(-total // segment_rows))
        us = keyed.select("key", "event_id", F.unix_micros("ts").alias("ts_us"))
        flags = segmented_flags(us, ttl_us, segments, scratch_path(df.sparkSession, f"cache-seg-{uuid.uuid4().hex[:12]}"))
        return flags.select("key", "event_id", F.timestamp_micros("ts_us").alias("ts"), "hit")
    parts = keyed.repartition("key").sortWithinPartitions("key", "ts", "event_id")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur_key, last = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            tsu = _to_us(pdf["ts"]).to_numpy()
            keys = pdf["key"].to_numpy()
            hits, last = _hits(pd.factorize(keys)[0], tsu, ttl_us, last if keys[0] == cur_key else None)
            cur_key = keys[-1]
            yield pd.DataFrame({"key": keys, "event_id": pdf["event_id"].to_numpy(), "ts": pdf["ts"],
                                "hit": hits})

    return parts.mapInPandas(scan, CACHE_OUT)


__all__ = ["page_chunks", "latest_page_chunks", "stream_pages", "stream_embed", "usage_windows",
           "stream_log_usage", "stream_cache", "cache_hits", "indexed_pages"]
