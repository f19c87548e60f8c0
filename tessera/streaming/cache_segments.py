"""Exact expiring-cache flags with hot keys split across tasks.

The rule (a request is a hit when the last *miss* of its key is less than
``ttl`` old; hits do not renew) is sequential per key.  To keep a key that
holds a large share of all events from landing in one task:

1. rows are range-partitioned on ``(key, ts, event_id)``, so a hot key is cut
   into bounded segments (``seg`` = partition id);
2. per segment and key, a backward pass computes for every event the next
   miss after it (first event ``>= ts + ttl``) and the last miss of the chain
   starting there; chains from different starts converge, so the segment's
   effect is summarised by a few ranges "first miss in [lo, hi] → exit";
3. per key, a walk over its segment summaries (bounded by the number of
   segments) finds each segment's true entry threshold;
4. each segment replays its chain from that threshold and emits the flags.

Every group in every step is one segment or one key's segment summaries.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUMMARY = T.StructType([T.StructField(n, t) for n, t in [
    ("key", T.StringType()), ("seg", T.IntegerType()), ("first_ts", T.LongType()), ("last_ts", T.LongType()),
    ("lo", T.ArrayType(T.LongType())), ("hi", T.ArrayType(T.LongType())), ("exit", T.ArrayType(T.LongType()))]])
ENTRY = T.StructType([T.StructField("key", T.StringType()), T.StructField("seg", T.IntegerType()),
                      T.StructField("threshold", T.LongType())])
FLAGS = T.StructType([T.StructField("key", T.StringType()), T.StructField("event_id", T.LongType()),
                      T.StructField("ts_us", T.LongType()), T.StructField("hit", T.BooleanType())])


def _runs(pdf: pd.DataFrame):
    pdf = pdf.sort_values(["key", "ts_us", "event_id"], kind="mergesort")
    for key, g in pdf.groupby("key", sort=False):
        yield key, g


def _next_pointers(ts: np.ndarray, ttl: int) -> np.ndarray:
    """Index of the first event at or after ts[i] + ttl (len(ts) when none)."""
    return np.searchsorted(ts, ts + ttl, side="left")


def chain(nxt: np.ndarray, start: int) -> np.ndarray:
    """Which places the chain ``start``, ``nxt[start]``, … visits (pointers lead
    ahead; ``len(nxt)`` ends it), by pointer doubling."""
    n = len(nxt)
    seen = np.zeros(n + 1, bool)
    if start < n:
        seen[start] = True
        jump = np.append(nxt, n)
        while True:
            seen[jump[np.flatnonzero(seen)]] = True
            further = jump[jump]
            if (further == jump).all():
                break
            jump = further
    return seen[:n]


def chain_ends(nxt: np.ndarray) -> np.ndarray:
    """Last place of the chain from each place, by pointer doubling."""
    at = np.arange(len(nxt))
    jump = np.where(nxt < len(nxt), nxt, at)
    while (jump[jump] != jump).any():
        jump = jump[jump]
    return jump


def summarise(pdf: pd.DataFrame, ttl: int) -> pd.DataFrame:
    rows = []
    for key, g in _runs(pdf):
        ts = g["ts_us"].to_numpy(np.int64)
        n = len(ts)
        # possible first misses: events before first_ts + ttl, and the first one after
        h = int(min(n, np.searchsorted(ts, ts[0] + ttl, side="left") + 1))
        ends = ts[chain_ends(_next_pointers(ts, ttl))[:h]]   # last miss of the chain from each
        new = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]])
        lo, hi, ex = ts[new].tolist(), ts[np.r_[new[1:], h] - 1].tolist(), ends[new].tolist()
        rows.append((key, int(g["seg"].iloc[0]), int(ts[0]), int(ts[-1]), lo, hi, ex))
    return pd.DataFrame(rows, columns=[f.name for f in SUMMARY.fields])


def walk(pdf: pd.DataFrame, ttl: int) -> pd.DataFrame:
    """Per key: entry threshold of each segment (None → first event is a miss)."""
    pdf = pdf.sort_values("seg")
    out = []
    last = None
    for r in pdf.itertuples(index=False):
        x = None if last is None or last + ttl <= r.first_ts else last + ttl
        out.append((r.key, int(r.seg), x))
        if x is None:
            last = r.exit[0]
        elif x <= r.last_ts:
            j = bisect.bisect_left(list(r.hi), x)   # first range holding a head >= x
            last = r.exit[j]
        # else: no event reaches the threshold; the previous miss stays current
    return pd.DataFrame(out, columns=["key", "seg", "threshold"]).astype({"threshold": "Int64"})


def replay(events: pd.DataFrame, entries: pd.DataFrame, ttl: int) -> pd.DataFrame:
    thr = {k: (None if pd.isna(t) else int(t)) for k, t in zip(entries["key"], entries["threshold"])}
    parts = []
    for key, g in _runs(events):
        ts = g["ts_us"].to_numpy(np.int64)
        x = thr.get(key)
        start = 0 if x is None else int(np.searchsorted(ts, x, side="left"))
        hit = ~chain(_next_pointers(ts, ttl), start)
        parts.append(pd.DataFrame({"key": key, "event_id": g["event_id"].to_numpy(np.int64), "ts_us": ts,
                                   "hit": hit}))
    if not parts:
        return pd.DataFrame({"key": pd.Series([], dtype=object), "event_id": pd.Series([], dtype="int64"),
                             "ts_us": pd.Series([], dtype="int64"), "hit": pd.Series([], dtype=bool)})
    return pd.concat(parts, ignore_index=True)


def segmented_flags(keyed: DataFrame, ttl_us: int, segments: int, staged_path: str) -> DataFrame:
    """``keyed``: key, event_id, ts_us.  Returns key, event_id, ts_us, hit."""
    spark = keyed.sparkSession
    (keyed.repartitionByRange(segments, "key", "ts_us", "event_id")
          .withColumn("seg", F.spark_partition_id())
          .write.mode("errorifexists").parquet(staged_path))      # fixed segments, lineage cut
    seg = spark.read.parquet(staged_path)
    summ = seg.groupBy("seg").applyInPandas(lambda p: summarise(p, ttl_us), SUMMARY)
    # only keys cut across segments need a walk; a key inside one segment
    # starts fresh there (no entry row → its first event is a miss)
    split = summ.groupBy("key").count().where(F.col("count") > 1).select("key")
    entries = summ.join(split, "key", "left_semi").groupBy("key").applyInPandas(lambda p: walk(p, ttl_us), ENTRY)
    return (seg.groupBy("seg").cogroup(entries.groupBy("seg"))
               .applyInPandas(lambda ev, en: replay(ev, en, ttl_us), FLAGS))
