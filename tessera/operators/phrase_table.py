"""Phrase matching against a large phrase table: the first declared phrase that
a text contains, found in one pass over the text.

The distinct phrases are cut by hash into slices of a bounded size, broadcast one
at a time.  Texts pass a slice in Arrow batches where they lie.  Phrases of eight
bytes and more are looked up by hash: the first 8 or 16 bytes at every place of
the batch's text are tested against those that phrases begin with, the places
that are left are hashed at the lengths of these phrases, and what is found is
compared byte by byte.  Shorter phrases are an Aho-Corasick automaton, built once
per Python worker.  A table of one slice (about a million phrases) needs no
shuffle of the texts; with more, the rows are written once, numbered, and every
slice adds the numbers of the rows it finds something in.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.writes import write_staged

SLICE_BYTES = 32 << 20   # UTF-8 bytes of the phrases in one slice; those in the automaton count SHORT times
SHORT = 8                # bytes from which on phrases are looked up by hash
PLACES = 1 << 18         # places of the text whose first bytes are tested at a time
PAIRS = 1 << 20          # places hashed at one length each at a time

_K1, _K2, _K3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_HALF = np.uint64(29)


_HELD: list = []    # the last slice of a worker: its broadcast, automaton, ranks and phrases


def _automaton(broadcast):
    """The automaton of a slice; a worker keeps its last one, and lets it go
    before it builds the next."""
    import ahocorasick

    if not _HELD or _HELD[0] is not broadcast:
        _HELD.clear()
        a = ahocorasick.Automaton()
        ranks, words = broadcast.value
        for rank, phrase in enumerate(words):
            a.add_word(phrase, rank)
        a.make_automaton()
        _HELD[:] = [broadcast, a, ranks, words]
    return _HELD[1:]


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes at every place of ``data`` as a number, without a copy."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))


def _starts(eights: np.ndarray, at, size: int) -> np.ndarray:
    """A number for the first ``size`` (8 or 16) bytes at the places ``at``, a slice or numbers."""
    h = eights[at] * _K1
    if size == 16:
        h ^= h >> _HALF
        h += eights[slice(at.start + 8, at.stop + 8) if isinstance(at, slice) else at + 8]
        h *= _K2
    return h


def _hashes(eights: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of ``length`` (at least eight) bytes at each of the places ``at``."""
    h = length.astype(np.uint64) * _K3
    for first in range(0, int(length.max(initial=0)), 8):
        more = np.flatnonzero(length > first)
        x = (h[more] ^ eights[at[more] + np.minimum(first, length[more] - 8)]) * _K1
        x ^= x >> _HALF
        h[more] = x * _K2
    return h


def _marks(keys: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    """Which leading bits numbers among ``keys`` have, and how far to shift a number to its bits."""
    bits = min(23, max(12, 4 + int(len(keys)).bit_length()))
    shift = np.uint64(64 - bits)
    known = np.zeros(1 << bits, bool)
    known[(keys >> shift).view(np.int64)] = True
    return known, shift


def _marked(marks, numbers: np.ndarray) -> np.ndarray:
    """Places of the numbers that may be among the marked ones."""
    known, shift = marks
    return np.flatnonzero(known[(numbers >> shift).view(np.int64)])


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``first``, ``first + 1``, … of each span, one span after another."""
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


class Index:
    """Phrases of at least ``SHORT`` bytes, the first declared first."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        """``data``: the phrases' bytes one after another, and 16 more."""
        self.data, self.offsets = data, offsets
        at, length, eights = offsets[:-1], np.diff(offsets), _eights(data)
        found = _hashes(eights, at, length)
        self.order = np.argsort(found, kind="stable").astype(np.int32)
        self.hashes = found[self.order]
        self.begin, self.sides = _marks(np.unique(_starts(eights, at, 8))), []
        for size in (8, 16):
            own = np.flatnonzero((length >= 16) == (size == 16))
            if len(own):
                # the lengths of the phrases that begin alike
                start = _starts(eights, at[own], size)
                by = np.lexsort((length[own], start))
                start, long = start[by], length[own][by]
                new = np.append(True, (start[1:] != start[:-1]) | (long[1:] != long[:-1]))
                start, long = start[new], long[new]
                keys, first, n = np.unique(start, return_index=True, return_counts=True)
                self.sides.append((size, keys, first, n, long, _marks(keys)))

    def first(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of the first phrase in each text, -1 where there is none.
        ``data``: the texts' bytes one after another, and 24 more."""
        best, eights = np.full(len(offsets) - 1, -1, np.int64), _eights(data)
        rows, places, numbers = [], [], []
        for s in range(0, int(offsets[-1]), PLACES):
            begin = s + _marked(self.begin, _starts(eights, slice(s, min(s + PLACES, int(offsets[-1]))), 8))
            for size, keys, first, n, long, marks in self.sides:
                start = _starts(eights, begin, size)
                at = _marked(marks, start)
                key = np.minimum(np.searchsorted(keys, start[at]), len(keys) - 1)
                like = keys[key] == start[at]
                at, key = begin[at[like]], key[like]
                end = offsets[np.searchsorted(offsets, at, "right")]
                ends = np.cumsum(n[key])
                cuts = np.searchsorted(ends, np.arange(PAIRS, ends[-1] if len(ends) else 0, PAIRS), "right")
                for a, b in zip(np.append(0, cuts), np.append(cuts, len(at))):
                    length = long[_spans(first[key[a:b]], n[key[a:b]])]
                    place, most = np.repeat(at[a:b], n[key[a:b]]), np.repeat(end[a:b], n[key[a:b]])
                    fits = place + length <= most
                    place = place[fits]
                    h = _hashes(eights, place, length[fits])
                    low = np.searchsorted(self.hashes, h)
                    hit = np.flatnonzero(self.hashes[np.minimum(low, len(self.hashes) - 1)] == h)
                    more = np.searchsorted(self.hashes, h[hit], "right") - low[hit]
                    numbers.append(self.order[_spans(low[hit], more)])
                    places.append(np.repeat(place[hit], more))
        if not numbers:
            return best
        number, place = np.concatenate(numbers), np.concatenate(places)
        row = np.searchsorted(offsets, place, "right") - 1
        by = np.lexsort((number, row))
        number, place, row = number[by], place[by], row[by]
        for s in np.flatnonzero(np.diff(row, prepend=-1)):
            while s < len(row) and best[row[s]] < 0:
                low, high = self.offsets[number[s]:number[s] + 2]
                if (data[place[s]:place[s] + high - low] == self.data[low:high]).all():
                    best[row[s]] = number[s]
                elif s + 1 < len(row) and row[s + 1] != row[s]:
                    break
                s += 1
        return best


def _bytes_of(texts: pa.Array, room: int) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and ``room`` more, and where each text starts."""
    width, (_, offsets, data) = np.int64 if pa.types.is_large_string(texts.type) else np.int32, texts.buffers()
    offsets = np.frombuffer(offsets, width)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) \
        if len(texts) else np.zeros(1, np.int64)
    given = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.concatenate([given, np.zeros(room, np.uint8)]), offsets - offsets[0]


def _first_in(short, long, found: T.StructType):
    """``short``, ``long``: broadcasts of the orders and phrases of the automaton
    and of the orders and :class:`Index` of the others, or None."""
    @F.arrow_udf(found)
    def first(texts: pa.Array) -> pa.Array:
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        best = [None] * len(texts)
        if long is not None:
            ranks, index = long.value
            number = index.first(*_bytes_of(texts, 24))
            number[texts.is_null().to_numpy(zero_copy_only=False)] = -1
            for i in np.flatnonzero(number >= 0):
                low, high = index.offsets[number[i]:number[i] + 2]
                best[i] = (int(ranks[number[i]]), index.data[low:high].tobytes())
        if short is not None:
            a, ranks, words = _automaton(short)
            for i, t in enumerate(texts.to_pylist()):
                n = min((v for _, v in a.iter(t)), default=None) if t else None
                if n is not None:
                    own = (ranks[n], words[n].encode())
                    best[i] = own if best[i] is None else min(best[i], own)
        return pa.StructArray.from_arrays(
            [pa.array([b and b[0] for b in best], pa.int64()), pa.array([b and b[1] for b in best], pa.binary()).cast(pa.string())],
            ["ord", "phrase"], mask=pa.array([b is None for b in best], pa.bool_()))

    return first


def _slice(part: pa.Table):
    """The two tables of a slice (see :func:`_first_in`) from its rows in order."""
    words = part["phrase"].combine_chunks()
    data, offsets = _bytes_of(words, 0)
    size, ranks = np.diff(offsets), part["ord"].to_numpy()
    few, many = np.flatnonzero(size < SHORT), np.flatnonzero(size >= SHORT)
    short = (ranks[few].tolist(), words.take(pa.array(few)).to_pylist()) if len(few) else None
    if not len(many):
        return short, None
    data, offsets = _bytes_of(words.take(pa.array(many)), 16)
    return short, (ranks[many], Index(data, offsets))


def match_phrase_table(left: DataFrame, text_col: str, phrases: DataFrame, phrase_col: str, ord_col: str,
                       out_cols: list[str], slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``left`` with ``out_cols`` of the first phrase (by ``ord_col``, an integer,
    then by text) that the lower-cased text contains; null where none does or
    the text is null.

    Null phrases and null orders match nothing, the empty phrase every text that
    isn't null.  Of phrase rows alike in order and text, the one with the least
    ``out_cols`` counts.  Rows of ``left`` stay as they are, repeated ones and
    columns of any name included."""
    spark = left.sparkSession
    names = left.columns
    rows = left.toDF(*[f"c{i}" for i in range(len(names))])
    text = F.lower(F.col(f"c{names.index(text_col)}"))
    table = (phrases.select(F.col(ord_col).cast("long").alias("ord"), F.col(phrase_col).alias("phrase"),
                            F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(out_cols)]).alias("out"))
             .where("ord IS NOT NULL AND phrase IS NOT NULL").groupBy("ord", "phrase").agg(F.min("out").alias("out")))
    # worked out once: the slices are cut from it, and the rows found are joined with it
    table = spark.read.schema(table.schema).parquet(write_staged(table, spark, "phrases"))
    # later rows with the same phrase are never first
    words = table.groupBy("phrase").agg(F.min("ord").alias("ord"))
    walked = words.where("phrase <> ''")
    bytes_ = F.octet_length("phrase")
    size = walked.agg(F.sum(F.when(bytes_ < SHORT, bytes_ * SHORT).otherwise(bytes_))).first()[0] or 0
    slices = math.ceil(size / slice_bytes)
    found = T.StructType([T.StructField("ord", T.LongType()), T.StructField("phrase", T.StringType())])
    # the empty phrase is in every text
    empty = words.where("phrase = ''").select("ord").first()
    start = F.struct(F.lit(empty.ord).alias("ord"), F.lit("").alias("phrase")) if empty else F.lit(None)
    rows = rows.withColumn("best", F.when(text.isNotNull(), start.cast(found)))
    if slices > 1:
        rows = rows.withColumn("n", F.monotonically_increasing_id())
        rows = spark.read.schema(rows.schema).parquet(write_staged(rows, spark, "phrases-rows"))
    seen = None
    for i in range(slices):
        part = walked.where(F.pmod(F.xxhash64("phrase"), F.lit(slices)) == i).orderBy("ord", "phrase").select("ord", "phrase").toArrow()
        first = _first_in(*[x if x is None else spark.sparkContext.broadcast(x) for x in _slice(part)], found)
        del part
        if slices == 1:
            rows = rows.withColumn("seen", first(text))
        else:
            hits = rows.select("n", first(text).alias("seen")).where("seen.ord IS NOT NULL")
            hits = spark.read.schema("n long, seen struct<ord: long, phrase: string>").parquet(write_staged(hits, spark, f"phrases-{i}"))
            seen = hits if seen is None else seen.unionByName(hits)
    if slices > 1:
        rows = rows.join(seen.groupBy("n").agg(F.min("seen").alias("seen")), "n", "left")
    if slices:
        rows = rows.withColumn("best", F.least("best", F.when(F.col("seen.ord").isNotNull(), F.col("seen"))))
    # the orders as given: null-safe, as rows without a match stay
    out = table.select(F.struct("ord", "phrase").alias("best"), "out")
    return rows.join(out, "best", "left").select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)],
        *[F.col(f"out.o{i}").alias(c) for i, c in enumerate(out_cols)])
