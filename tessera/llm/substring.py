"""Removal of passages that an earlier document has, with FM-indexes.

A window is ``window`` consecutive words.  Each window is routed by its anchor,
the least hash among its runs of ``ANCHOR`` words: equal windows have equal
anchors, and neighbouring windows share them, so a document becomes a sequence
of short overlapping segments, one per anchor.  Anchors that only one document
has are dropped at once.  The segments of the others go to shards by anchor; a
shard indexes its distinct segments in a compressed FM-index and takes every
window of the streamed documents through backward search.  A window found in a
document with a smaller id is reported; the last step joins reports to texts
and removes the covered words.

Anchors of more than ``HOT`` documents (very common passages) would gather in
one shard; their windows are summed up within each task before the shuffle
instead, and the answers go back to the tasks that asked.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import staged
from tessera.llm.fmindex import ORDER, FmIndex
from tessera.llm.neardup import complete_groups
from tessera.llm.words import Words, mixed

#: words of an anchor; documents that make an anchor hot; windows that a task sums up together
ANCHOR, HOT, FLUSH = 5, 1000, 4_000_000
#: words that are indexed together in a shard
SHARD_WORDS = 200_000
#: rows taken together where texts are read
ROWS = 256


class Segments:
    """Windows, anchors and segments of a text column."""

    def __init__(self, column, window: int):
        self.words = w = Words(column)
        self.window = window
        h = w.hash
        row = w.row_of()
        n = max(0, len(h) - window + 1)
        whole = np.flatnonzero(row[:n] == row[window - 1:]) if n else np.zeros(0, int)
        runs = w.runs(ANCHOR)
        per = window - ANCHOR + 1
        place = np.empty(len(whole), np.int64)
        view = sliding_window_view(runs, per) if n else None
        for a in range(0, len(whole), 1 << 18):
            part = whole[a:a + (1 << 18)]
            place[a:a + len(part)] = part + view[part].argmin(1)
        #: first word of each window, its row, its anchor's place
        self.at, self.row, self.place = whole, row[whole], place
        new = np.ones(len(whole), bool)
        new[1:] = (place[1:] != place[:-1]) | (self.row[1:] != self.row[:-1]) | (whole[1:] != whole[:-1] + 1)
        #: first window of each segment, and the end
        self.first = np.r_[np.flatnonzero(new), len(whole)]
        self.count = np.diff(self.first)
        s = self.first[:-1]
        self.seg_row = self.row[s]
        self.anchor = runs[place[s]].view(np.int64) if len(s) else np.zeros(0, np.int64)
        self.start = self.at[s]
        self.size = self.count + window - 1

    def window_hashes(self) -> np.ndarray:
        return self.words.runs(self.window)[self.at].view(np.int64) if len(self.at) else np.zeros(0, np.int64)

    def seg_hashes(self) -> np.ndarray:
        """64-bit hash of each segment's words (of their 32-bit hashes)."""
        out = np.zeros(len(self.start), np.uint64)
        h = self.words.hash >> np.uint64(32)
        for j in range(int(self.size.max(initial=0))):
            use = self.size > j
            out[use] = mixed(out[use] * np.uint64(0x9E3779B97F4A7C15) + h[self.start[use] + j] + np.uint64(1))
        return out.view(np.int64)

    def seg_words(self, which: np.ndarray) -> pa.Array:
        """Words of segments as binary arrays of 32-bit hashes."""
        size, start = self.size[which], self.start[which]
        ends = np.cumsum(size)
        flat = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(start, size)
        data = (self.words.hash[flat] >> np.uint64(32)).astype(np.uint32)
        offsets = pa.py_buffer(np.r_[0, ends * 4].astype(np.int32).tobytes())
        return pa.Array.from_buffers(pa.binary(), len(which), [None, offsets, pa.py_buffer(data.tobytes())])


def _listed(column: pa.ListArray, rows: int):
    """(row, values) of a list column; a null list has no values."""
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(rows), n), column.flatten()


def _keys(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mixed(value.view(np.uint64) ^ mixed(row.astype(np.uint64) + np.uint64(1)))


def _find(row, value, list_row, list_value):
    """Place of each pair (row, value) among the listed ones, or -1."""
    if not len(list_row) or not len(row):
        return np.full(len(row), -1)
    have = _keys(list_row, list_value)
    order = np.argsort(have, kind="stable")
    want = _keys(row, value)
    at = order[np.minimum(np.searchsorted(have[order], want), len(have) - 1)]
    return np.where(have[at] == want, at, -1)


def binary_hashes(words: pa.Array) -> np.ndarray:
    """``seg_hashes`` of segments given as binary arrays of 32-bit hashes."""
    size = pc.binary_length(words).to_numpy(zero_copy_only=False) // 4
    flat = np.frombuffer(b"".join(words.to_pylist()), np.uint32).astype(np.uint64)
    start = np.cumsum(size) - size
    out = np.zeros(len(size), np.uint64)
    for j in range(int(size.max(initial=0))):
        use = size > j
        out[use] = mixed(out[use] * np.uint64(0x9E3779B97F4A7C15) + flat[start[use] + j] + np.uint64(1))
    return out.view(np.int64)


def earliest(words: list[bytes], doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For the windows of distinct segments (32-bit words, of the smallest
    document that has each): the smallest document that has the window, and the
    place of each segment's first window in that array."""
    size = np.array([len(w) // 4 for w in words])
    flat = np.frombuffer(b"".join(words), np.uint32)
    alphabet, number = np.unique(flat, return_inverse=True)
    # each segment is followed by a separator, 0
    ends = np.cumsum(size + 1)
    begin = ends - size - 1
    seq = np.zeros(int(ends[-1]), np.int64)
    inner = np.arange(len(flat)) + np.repeat(np.arange(len(words)), size)
    seq[inner] = number + 1
    index = FmIndex(seq, len(alphabet) + 1)
    count = size - window + 1
    first = np.r_[0, np.cumsum(count)]
    segment = np.repeat(np.arange(len(words)), count)
    at = np.arange(int(first[-1])) - first[segment] + begin[segment]
    low, high = index.search(seq[at[:, None] + np.arange(window)], cut=1)
    owner = np.repeat(np.arange(len(words)), size + 1)
    holder = doc[owner[index.places]]
    out = doc[segment].copy()
    several = np.flatnonzero(high - low > 1)
    if len(several):
        lo, back = np.unique(low[several], return_inverse=True)
        hi = np.zeros(len(lo), np.int64)
        hi[back] = high[several]
        bounds = np.ravel(np.column_stack([lo, np.minimum(hi, len(holder) - 1)]))
        least = np.minimum.reduceat(holder, bounds)[::2]
        ends_last = hi >= len(holder)
        if ends_last.any():
            least[ends_last] = np.minimum(least[ends_last], holder[-1])
        out[several] = least[back]
    return out, first


def _slices(batches, rows: int = ROWS):
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


class Passages:
    """Repeated passages of one table (see ``remove_repeats``)."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, window: int, keep: list[str]):
        if not ANCHOR <= window <= ORDER:
            raise ValueError(f"a window has {ANCHOR} to {ORDER} words")
        self.window = window
        self.parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                              F.struct(F.lit(1).alias("row"), *keep).alias("rest"))
        # one exchange of the texts, read again by each step that joins to them:
        # every step reads the same columns, else each would shuffle its own
        self.docs = self.rows.repartition(self.parts, "id")
        # the smallest id of each text stands for its copies
        self.firsts = self.rows.where("id IS NOT NULL") \
            .groupBy(F.md5("text").alias("md5"), F.xxhash64("text").alias("digest")).agg(F.min("id").alias("id")).select("digest", "id")

    def anchors(self) -> DataFrame:
        """``id`` (of a text's first document) and its anchors that other texts
        have too: ``cold`` and ``hot`` lists.  A task sends a text's anchors
        once, however many copies it reads."""
        window = self.window

        def run(batches):
            seen: set[int] = set()
            for b in _slices(batches):
                digest = b.column(0).to_numpy()
                new = np.zeros(b.num_rows, bool)
                for i, d in enumerate(digest.tolist()):
                    if d not in seen:
                        new[i] = True
                        seen.add(d)
                if len(seen) > 500_000:
                    seen.clear()
                b = b.filter(pa.array(new))
                s = Segments(b.column(1), window)
                _, once = np.unique(_keys(s.seg_row, s.anchor), return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(s.anchor[once]), pa.array(digest[new][s.seg_row[once]])], ["anchor", "digest"])

        found = self.rows.where("id IS NOT NULL").select(F.xxhash64("text").alias("digest"), "text") \
            .mapInArrow(run, "anchor long, digest long")
        shared = found.groupBy("anchor").agg(F.min("digest").alias("low"), F.max("digest").alias("high"), F.count(F.lit(1)).alias("n")) \
            .where("low < high").select("anchor", (F.col("n") > HOT).alias("hot"))
        lists = found.join(shared, "anchor").groupBy("digest").agg(
            F.collect_set(F.when(~F.col("hot"), F.col("anchor"))).alias("cold"),
            F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))
        return staged(lists.join(self.firsts, "digest").select("id", "cold", "hot"), "passage-anchors")

    def cold_reports(self, anchors: DataFrame) -> DataFrame:
        """``id``, ``segment`` (hash), ``mask``: bit ``j`` is set if window ``j``
        of that segment is in a document with a smaller id."""
        window = self.window

        def cut(batches):
            for b in _slices(batches):
                s = Segments(b.column(1), window)
                row, value = _listed(b.column(2), b.num_rows)
                use = np.flatnonzero(_find(s.seg_row, s.anchor, row, value.to_numpy()) >= 0)
                # a segment that a document repeats is sent once
                _, once = np.unique(_keys(s.seg_row[use], s.seg_hashes()[use]), return_index=True)
                use = use[once]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.anchor[use]), b.column(0).take(pa.array(s.seg_row[use])), s.seg_words(use)], ["anchor", "id", "words"])

        def shards(batches):
            """Whole anchor groups, about SHARD_WORDS words together."""
            held, size = [], 0
            for t, _ in complete_groups(batches, 1):
                held.append(t)
                size += t.num_rows * (window + 4)
                if size >= SHARD_WORDS:
                    yield pa.concat_tables(held).combine_chunks()
                    held, size = [], 0
            if held:
                yield pa.concat_tables(held).combine_chunks()

        def report(batches):
            for t in shards(batches):
                doc = t.column("id").to_numpy()
                words, anchor = t.column("words").combine_chunks(), t.column("anchor").to_numpy()
                seg = binary_hashes(words)
                order = np.lexsort((doc, seg, anchor))
                new = np.ones(len(seg), bool)
                new[1:] = (seg[order][1:] != seg[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])
                kind = np.empty(len(seg), np.int64)
                kind[order] = np.cumsum(new) - 1
                lead = order[new]
                first_doc, start = earliest(words.take(pa.array(lead)).to_pylist(), doc[lead], window)
                count = np.diff(start)
                mask = np.zeros(len(seg), np.int64)
                for j in range(int(count.max(initial=0))):
                    has = np.flatnonzero(count[kind] > j)
                    mask[has] |= (first_doc[start[kind[has]] + j] < doc[has]).astype(np.int64) << j
                hit = np.flatnonzero(mask)
                yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(seg[hit]), pa.array(mask[hit])], ["id", "segment", "mask"])

        rows = self.docs.join(anchors.where(F.size("cold") > 0).select("id", "cold"), "id").select("id", "text", "cold", "rest")
        return rows.mapInArrow(cut, "anchor long, id long, words binary") \
            .repartition(self.parts, "anchor").sortWithinPartitions("anchor") \
            .mapInArrow(report, "id long, segment long, mask long")

    def hot_reports(self, anchors: DataFrame) -> DataFrame:
        """``id``, ``hashes`` of windows of hot anchors that a document with a
        smaller id has.

        A task sums up its own documents first: one row per window, with the
        ids that have it, so a very common window is one row per task.  The
        smallest id per window goes back to those rows, and these return to the
        tasks they came from, which give one row per document."""
        window = self.window

        def cut(batches):
            task = TaskContext.get().partitionId()
            hashes, ids, held = [], [], 0

            def flush():
                h, i = np.concatenate(hashes), np.concatenate(ids)
                order = np.lexsort((i, h))
                h, i = h[order], i[order]
                first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                last = np.r_[first[1:], len(h)]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(h)].astype(np.int32)), pa.array(i))
                return pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(first), task, np.int32)), pa.array(h[first]), pa.array(i[first]), pa.array(i[last - 1]), lists],
                    ["task", "hash", "low", "high", "ids"])

            for b in _slices(batches):
                s = Segments(b.column(1), window)
                row, value = _listed(b.column(2), b.num_rows)
                use = np.repeat(_find(s.seg_row, s.anchor, row, value.to_numpy()) >= 0, s.count)
                rows, h = s.row[use], s.window_hashes()[use]
                _, once = np.unique(_keys(rows, h), return_index=True)
                hashes.append(h[once])
                ids.append(b.column(0).to_numpy()[rows[once]])
                held += len(once)
                if held > FLUSH:
                    yield flush()
                    hashes, ids, held = [], [], 0
            if held:
                yield flush()

        def per_document(batches):
            hashes, ids = [], []
            for b in batches:
                row, values = _listed(b.column("ids"), b.num_rows)
                i = values.to_numpy()
                late = i > b.column("low").to_numpy()[row]
                hashes.append(b.column("hash").to_numpy()[row[late]])
                ids.append(i[late])
            if hashes:
                h, i = np.concatenate(hashes), np.concatenate(ids)
                order = np.argsort(i, kind="stable")
                h, i = h[order], i[order]
                first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, int)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(i)].astype(np.int32)), pa.array(h))
                yield pa.RecordBatch.from_arrays([pa.array(i[first]), lists], ["id", "hashes"])

        found = self.docs.join(anchors.where(F.size("hot") > 0).select("id", "hot"), "id").select("id", "text", "hot", "rest") \
            .mapInArrow(cut, "task int, hash long, low long, high long, ids array<long>")
        least = found.groupBy("hash").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("hash", "low")
        return found.select("task", "hash", "ids").join(least, "hash").repartition(self.parts, "task") \
            .mapInArrow(per_document, "id long, hashes array<long>")

    def run(self, with_text: bool) -> DataFrame:
        window = self.window
        anchors = self.anchors()
        cold = self.cold_reports(anchors).groupBy("id").agg(F.collect_list("segment").alias("segments"), F.collect_list("mask").alias("masks"))
        hot = self.hot_reports(anchors)
        # the texts that an id is the first of: any other text of that id is a copy
        own = self.firsts.groupBy("id").agg(F.collect_set("digest").alias("own"))
        plan = own.join(cold, "id", "left").join(hot, "id", "left")

        def remove(batches):
            for b in _slices(batches):
                s = Segments(b.column(1), window)
                w = s.words
                gone = np.zeros(len(s.at), bool)  # windows
                row, seg = _listed(b.column(2), b.num_rows)
                if len(row):
                    found = _find(s.seg_row, s.seg_hashes(), row, seg.to_numpy())
                    mask = np.where(found >= 0, b.column(3).flatten().to_numpy()[found], 0)
                    place = np.arange(len(s.at)) - np.repeat(s.first[:-1], s.count)
                    gone |= (np.repeat(mask, s.count) >> place) & 1 == 1
                row, h = _listed(b.column(4), b.num_rows)
                if len(row):
                    gone |= _find(s.row, s.window_hashes(), row, h.to_numpy()) >= 0
                ids = b.column(0)
                copy = ids.is_valid().to_numpy(zero_copy_only=False) & ~b.column(5).is_valid().to_numpy(zero_copy_only=False)
                gone |= copy[s.row]
                edge = np.zeros(len(w.hash) + 1, np.int64)
                np.add.at(edge, s.at[gone], 1)
                np.add.at(edge, s.at[gone] + window, -1)
                keep = np.cumsum(edge[:-1]) == 0
                n = np.diff(w.first)
                kept = np.bincount(w.row_of()[keep], minlength=b.num_rows)
                texts = w.joined(keep)
                cols = [ids, pa.array(n, pa.int64()), pa.array(n - kept, pa.int64()),
                        pa.array([sha256(t).hexdigest() for t in texts], pa.string())]
                if with_text:  # a text that loses nothing keeps its white space
                    same = pa.array(n == kept)
                    cols += [pc.if_else(same, b.column(1).cast(pa.string()), pa.array(texts, pa.binary()).cast(pa.string())), b.column(6)]
                yield pa.RecordBatch.from_arrays(cols, schema.names)

        first = F.when(F.array_contains("own", F.xxhash64("text")), F.lit(True)).alias("own")
        read = self.docs.join(plan, "id", "left").select("id", "text", "segments", "masks", "hashes", first, "rest")
        schema = T.StructType().add("doc_id", "long").add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
        if with_text:
            schema = schema.add("kept_text", "string").add("rest", read.schema["rest"].dataType)
        return read.mapInArrow(remove, schema)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, with_text: bool = False,
                   keep: list[str] | None = None) -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` (of the
    kept words joined by one space) and, if ``with_text``, ``kept_text`` (a text
    that loses nothing is returned unchanged) and ``rest``, a struct of the
    columns ``keep``.

    Words are runs of bytes other than ASCII white space, unchanged.  A word is
    removed if a window of ``window`` words that covers it also stands in a
    document with a smaller id.  Windows are judged on the input.

    Null, empty and blank texts have no words and nothing removed.  Rows with a
    null id neither lose words nor make others lose any.  Rows that share an id
    don't remove from each other; repeated rows stay repeated.  An empty table
    gives an empty result; other columns are not read.  Ids are whole numbers.
    Words are compared by 64-bit hashes in anchors and by 32-bit hashes for the
    rest of a window.
    """
    return Passages(df, id_col, text_col, window, keep or []).run(with_text)


#: DuckDB SQL of the same rows over a table ``documents`` (default window).
SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(COALESCE(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS g FROM x),
f AS (SELECT g, min(doc_id) AS m FROM h GROUP BY 1),
c AS (SELECT doc_id, list(i ORDER BY i) AS r FROM h JOIN f USING (g) WHERE m < doc_id GROUP BY 1),
gone AS (SELECT doc_id, list_distinct(flatten(list_transform(r, lambda i: range(i, i + 13)))) AS p FROM c),
k AS (
  SELECT doc_id, w, COALESCE(len(p), 0) AS n,
         CASE WHEN p IS NULL THEN w ELSE list_select(w, list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(p, j))) END AS kept
  FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, n::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
