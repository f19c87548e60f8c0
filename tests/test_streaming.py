"""Streaming runs (availableNow) equal their batch forms."""

import datetime as dt
import tempfile

from tessera.plans.q_results import _write_event_log
from tessera.sources import querylog as L
from tessera.streaming import streams as ST


def test_log_usage_stream_equals_batch(spark, sf):
    log_dir = _write_event_log(spark, sf)
    out = tempfile.mkdtemp(prefix="usage-") + "/out"
    q = ST.stream_log_usage(spark, log_dir, out, tempfile.mkdtemp(prefix="ck-"))
    q.awaitTermination(300)
    streamed = {tuple(r) for r in spark.read.parquet(out).collect()}
    batch = {tuple(r) for r in ST.usage_windows(L.read_query_log(spark, log_dir)).collect()}
    # append mode emits windows the watermark has closed; all of them match the batch result
    assert streamed and streamed <= batch


def test_page_stream_equals_batch(spark, sf):
    out = tempfile.mkdtemp(prefix="pages-") + "/idx"
    src = tempfile.mkdtemp(prefix="pages-in-") + "/in"  # a streaming source reads a directory
    spark.read.parquet(f"{sf}/pages.parquet").write.parquet(src)
    q = ST.stream_pages(spark, src, out, tempfile.mkdtemp(prefix="ck-"))
    q.awaitTermination(300)
    streamed = ST.latest_page_chunks(spark.read.parquet(out)).select("doc_id", "text_content")
    batch = ST.page_chunks(spark.read.parquet(f"{sf}/pages.parquet")).select("doc_id", "text_content")
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_cache_hits_rules(spark):
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0)
    mins = [0, 10, 29, 30, 45, 61, 200]
    df = spark.createDataFrame([(i, "u", t0 + dt.timedelta(minutes=m)) for i, m in enumerate(mins)],
                               "event_id long, user string, ts timestamp")
    got = [r.hit for r in ST.cache_hits(df, ["user"], "ts", "event_id", 30).orderBy("event_id").collect()]
    # expiry counts from the last miss; hits do not renew
    assert got == [False, True, True, False, True, False, False]


def test_cache_stream_equals_batch(spark, sf):
    from pyspark.sql import functions as F
    ev = spark.read.parquet(f"{sf}/events.parquet")
    src = tempfile.mkdtemp(prefix="ev-") + "/in"
    ev.write.parquet(src)
    stream = spark.readStream.schema(ev.schema).parquet(src)
    out = ST.stream_cache(stream, ["user_id", "event_type"], "ts", "event_id", 30, watermark="1000 days")
    q = (out.writeStream.format("memory").queryName("cache_out").outputMode("append")
            .option("checkpointLocation", tempfile.mkdtemp(prefix="ck-")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    streamed = spark.table("cache_out").select("event_id", "hit")
    batch = ST.cache_hits(ev, ["user_id", "event_type"], "ts", "event_id", 30).select("event_id", "hit")
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
    assert batch.where(F.col("hit")).count() > 0


def test_incremental_embedding_stream(spark, sf):
    from pyspark.sql import functions as F
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    src = tempfile.mkdtemp(prefix="emb-in-") + "/in"
    out = tempfile.mkdtemp(prefix="emb-out-") + "/out"
    ck = tempfile.mkdtemp(prefix="ck-")
    docs.where(F.col("doc_id") % 2 == 0).write.parquet(src + "/part=a")
    ST.stream_embed(spark, src, docs.schema, "doc_id", "text", out, ck).awaitTermination(300)
    first = spark.read.parquet(out).count()
    assert first == docs.where(F.col("doc_id") % 2 == 0).count()
    # a second file repeats the old ids and adds the odd ones: only new ids are embedded
    docs.write.parquet(src + "/part=b")
    ST.stream_embed(spark, src, docs.schema, "doc_id", "text", out, ck).awaitTermination(300)
    emb = spark.read.parquet(out)
    assert emb.count() == emb.select("doc_id").distinct().count()
    assert emb.select("doc_id").distinct().count() == docs.count()


def test_segmented_cache_equals_scan(spark, sf):
    """Hot keys cut into range segments give exactly the sequential flags."""
    ev = spark.read.parquet(f"{sf}/events.parquet")
    for keys, seg_rows in ((["user_id", "event_type"], 50), (["event_type"], 40)):  # second: few very hot keys
        a = ST.cache_hits(ev, keys, "ts", "event_id", 30, method="scan")
        b = ST.cache_hits(ev, keys, "ts", "event_id", 30, method="segmented", segment_rows=seg_rows)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_segmented_cache_chain_across_segments(spark):
    # one key, an event every 10 minutes: misses at 0, 30, 60, ... minutes; and
    # a denser second key so chains start mid-segment
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, "a", t0 + dt.timedelta(minutes=10 * i)) for i in range(40)]
    rows += [(100 + i, "b", t0 + dt.timedelta(minutes=7 * i)) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, user string, ts timestamp")
    a = ST.cache_hits(df, ["user"], "ts", "event_id", 30, method="scan")
    b = ST.cache_hits(df, ["user"], "ts", "event_id", 30, method="segmented", segment_rows=7)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    misses = sorted(r.event_id for r in b.where("not hit and key = 'a'").collect())
    assert misses == list(range(0, 40, 3))


def test_replayed_embedding_epoch_keeps_its_rows(spark):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "doc_id long, text string")
    src, out = tempfile.mkdtemp(prefix="re-in-") + "/in", tempfile.mkdtemp(prefix="re-out-") + "/out"
    rows.write.parquet(src)
    for _ in range(2):  # a fresh checkpoint: the same input is epoch 0 again
        ST.stream_embed(spark, src, rows.schema, "doc_id", "text", out, tempfile.mkdtemp(prefix="ck-")).awaitTermination(300)
        emb = spark.read.parquet(out)
        assert emb.count() == 5 and emb.select("doc_id").distinct().count() == 5


def test_emptied_and_doubled_pages(spark):
    src, out, ck = (tempfile.mkdtemp(prefix="pv-") + x for x in ("/in", "/out", "/ck"))
    page = "<html><body><p>{}</p></body></html>"
    for rows in ([(1, "http://a", page.format("old words")), (2, "http://b", page.format("kept"))],
                 [(1, "http://a", "<html></html>"), (3, "http://c", page.format("first")), (4, "http://c", page.format("second"))]):
        spark.createDataFrame(rows, ST.PAGE_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        ST.stream_pages(spark, src, out, ck).awaitTermination(300)
    got = sorted((r.url, r.text_content) for r in ST.latest_page_chunks(spark.read.parquet(out)).collect())
    assert got == [("http://b", "kept"), ("http://c", "second")]


def test_hits_equal_a_plain_walk():
    import random

    import numpy as np

    rng = random.Random(3)
    for _ in range(50):
        rows = sorted((rng.randint(0, 3), rng.randint(0, 60)) for _ in range(40))
        miss = rng.choice([None, rng.randint(-20, 0)])
        last, cur, want = miss, rows[0][0], []
        for k, t in rows:
            last = last if k == cur else None
            cur = k
            want.append(last is not None and t - last < 10)
            last = last if want[-1] else t
        got, end = ST._hits(np.array([k for k, _ in rows]), np.array([t for _, t in rows]), 10, miss)
        assert got.tolist() == want and end == last
