"""Benchmark decontamination with suffix arrays of the training texts.

Each slice of the documents is a shard with its own word-level suffix array.
The words are numbered by the vocabulary of the test items (0 for any other
word), and the array holds the suffixes that begin with enough test words to
hold a window; all others match nothing.  Every test suffix is then taken
through the array by binary search, one word deeper at a time and all suffixes
together, which gives the interval of the places where its window stands.
Matches are extended from there to their longest form.

The test items are cut into pieces, and the pieces dealt to blocks of a fixed
number of words; a block is what is broadcast.  More than one block takes the
documents past the blocks one after the other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.bytewise import byte_parts, byte_table, translated
from tessera.llm.common import staged
from tessera.llm.fmindex import ORDER, suffix_order
from tessera.llm.words import Words

#: words of a window
WINDOW = 10
#: test words that are broadcast together, and words of a piece of an item
BLOCK_WORDS, PIECE_WORDS = 250_000, 4096
#: bytes of text in a shard
SHARD_BYTES = 8 << 20

#: words are runs of 0-9, a-z (A-Z lower-cased) and bytes from 0x80 on
TABLE = byte_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def plain_words(column) -> Words:
    return Words(translated(column, TABLE))


def pieces(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """``item`` (its id as a string), ``place`` of the piece's first word, and
    ``words``: 64-bit hashes.  Neighbouring pieces of an item share ``window - 1`` words,
    so each window lies in one piece; an item without words has none."""
    step = PIECE_WORDS - window + 1

    def cut(batches):
        for b in byte_parts(batches, 1, SHARD_BYTES):
            w = plain_words(b.column(1))
            row, place, parts = [], [], []
            for r in range(b.num_rows):
                a, z = int(w.first[r]), int(w.first[r + 1])
                for at in range(a, max(a + 1, z - window + 1), step) if z > a else ():
                    row.append(r)
                    place.append(at - a)
                    parts.append(w.hash[at:min(z, at + PIECE_WORDS)].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(place, pa.int64()), pa.array(parts, pa.binary())],
                                             ["item", "place", "words"])

    return items.select(F.col(id_col).cast("string").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text")) \
        .mapInArrow(cut, "item string, place long, words binary")


class TestSuffixes:
    """The distinct windows of a block of pieces, as rows of word numbers with
    zero padding, and the items that have each."""

    __test__ = False

    def __init__(self, table: pa.Table, window: int):
        parts = [np.frombuffer(x, np.uint64) for x in table.column("words").to_pylist()]
        self.item = table.column("item").to_pylist()
        self.place = table.column("place").to_pylist()
        flat = np.concatenate([*parts, np.zeros(0, np.uint64)])
        self.vocabulary, number = np.unique(flat, return_inverse=True)
        bits = self.vocabulary >> np.uint64(48)
        self.seen = np.zeros(1 << 16, bool)
        self.seen[bits.astype(np.int64)] = True
        size = np.array([len(p) for p in parts], np.int64)
        self.begin = np.cumsum(size + 1) - size - 1
        #: all pieces, each followed by 0
        self.text = np.zeros(int((size + 1).sum()) + window, np.int32)
        self.text[np.arange(len(flat)) + np.repeat(np.arange(len(parts)), size)] = number + 1
        # suffixes that begin with a window: the whole piece where it is shorter
        count = np.maximum(size - window + 1, np.minimum(size, 1))
        ends = np.cumsum(count)
        self.owner = np.repeat(np.arange(len(parts)), count)
        self.at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count, count) + self.begin[self.owner]
        depth = np.minimum(size, window)[self.owner]
        rows = self.text[self.at[:, None] + np.arange(window)] * (np.arange(window) < depth[:, None])
        self.windows, self.kind = np.unique(rows.astype(np.int32), axis=0, return_inverse=True) if len(rows) else (np.zeros((0, window), np.int32), np.zeros(0, int))
        self.kind = self.kind.reshape(-1)
        self.depth = (self.windows > 0).sum(1)
        self.least = int(self.depth.min(initial=window))
        # windows with the same items share a set
        order = np.lexsort((self.owner, self.kind))
        sets: dict[tuple, int] = {}
        self.set_of = np.zeros(len(self.windows), np.int64)
        bounds = np.searchsorted(self.kind[order], np.arange(len(self.windows) + 1))
        for k in range(len(self.windows)):
            names = tuple(sorted({n for o in self.owner[order[bounds[k]:bounds[k + 1]]] if (n := self.item[o]) is not None}))
            self.set_of[k] = sets.setdefault(names, len(sets))
        self.sets = list(sets)
        #: suffixes of each window, for the places of matches
        self.suffixes, self.bounds = order, bounds

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary numbers of words, 0 for words that no item has."""
        out = np.zeros(len(hashes), np.int32)
        near = np.flatnonzero(self.seen[(hashes >> np.uint64(48)).astype(np.int64)])
        if len(near):
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[near]), len(self.vocabulary) - 1)
            out[near] = np.where(self.vocabulary[at] == hashes[near], at + 1, 0)
        return out


class ShardSuffixes:
    """Suffix array of a shard: of its runs of at least ``least`` test words."""

    def __init__(self, number: np.ndarray, row: np.ndarray, least: int):
        n = len(number)
        known = number > 0
        edge = np.ones(n, bool)
        edge[1:] = (row[1:] != row[:-1]) | (known[1:] != known[:-1])
        first = np.flatnonzero(edge)
        length = np.diff(np.r_[first, n])
        use = known[first] & (length >= least)
        first, length = first[use], length[use]
        # the runs that are left, each followed by 0
        ends = np.cumsum(length + 1)
        size = int(ends[-1]) if len(ends) else 0
        run = np.repeat(np.arange(len(first)), length)
        inner = np.arange(len(run)) + run
        self.text = np.zeros(size + ORDER + 1, np.int32)
        #: word of the shard at each place
        self.word = np.full(size, -1, np.int64)
        self.word[inner] = np.arange(len(run)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(first, length)
        self.text[inner] = number[self.word[inner]]
        order = suffix_order(self.text[:size]) if size else np.zeros(0, np.int64)
        self.array = order[len(first):]  # after the suffixes of the zeros

    def bound(self, k: int, low, high, want, after: bool) -> np.ndarray:
        """First place from ``low`` on, below ``high``, whose word ``k`` is not
        below ``want`` (not at most, if ``after``)."""
        low, high = low.copy(), high.copy()
        live = np.flatnonzero(low < high)
        while len(live):
            mid = (low[live] + high[live]) >> 1
            word = self.text[self.array[mid] + k]
            go = word <= want[live] if after else word < want[live]
            low[live[go]] = mid[go] + 1
            high[live[~go]] = mid[~go]
            live = live[low[live] < high[live]]
        return low

    def search(self, windows: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of the suffixes that begin with each window."""
        low = np.zeros(len(windows), np.int64)
        high = np.full(len(windows), len(self.array), np.int64)
        for k in range(windows.shape[1]):
            live = np.flatnonzero((depth > k) & (high > low))
            if not len(live):
                break
            want = windows[live, k]
            a = self.bound(k, low[live], high[live], want, False)
            z = self.bound(k, a, high[live], want, True)
            low[live], high[live] = a, z
        return low, high

    def occurrences(self, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every place where a window stands."""
        low, high = self.search(tests.windows, tests.depth)
        count = high - low
        window = np.repeat(np.arange(len(count)), count)
        at = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        return self.word[self.array[at]], window


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


def _found(b: pa.RecordBatch, tests: TestSuffixes):
    """Words, row of each word, and the (word, window) pairs of a shard."""
    w = plain_words(b.column("text"))
    row = w.row_of()
    at, window = ShardSuffixes(tests.numbers(w.hash), row, tests.least).occurrences(tests) if len(tests.windows) else (np.zeros(0, int), np.zeros(0, int))
    return w, row, at, window


def _hits(b: pa.RecordBatch, tests: TestSuffixes, schema: list[str]) -> pa.RecordBatch:
    """Add the hits of a block of tests to those of earlier blocks."""
    w, row, at, window = _found(b, tests)
    edge = np.zeros(len(row) + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + tests.depth[window], -1)
    hit = np.cumsum(edge[:-1]) > 0
    for r, old in enumerate(b.column("spans").to_pylist()):
        for a, z in np.frombuffer(old, np.int32).reshape(-1, 2) if old else ():
            hit[w.first[r] + a:w.first[r] + z] = True
    n_hit = np.bincount(row[hit], minlength=b.num_rows)
    border = np.ones(len(row) + 1, bool)
    border[1:-1] = row[1:] != row[:-1]
    on = np.r_[False, hit, False]
    turn = np.flatnonzero(hit & (border[:-1] | ~on[:-2]))
    stop = np.flatnonzero(hit & (border[1:] | ~on[2:])) + 1
    owner = row[turn]
    flat = np.column_stack([turn - w.first[owner], stop - w.first[owner]]).astype(np.int32)
    cut = np.searchsorted(owner, np.arange(b.num_rows + 1))
    spans = [flat[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:], strict=True)]
    found = np.unique(np.column_stack([row[at], tests.set_of[window]]), axis=0)
    items = [set(x or ()) for x in b.column("items").to_pylist()]
    for r, s in found.tolist():
        items[r].update(tests.sets[s])
    made = {"n_words": pa.array(np.diff(w.first), pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "spans": pa.array(spans, pa.binary()),
            "items": pa.array([sorted(x) for x in items], pa.list_(pa.string()))}
    return pa.RecordBatch.from_arrays([made[c] if c in made else b.column(c) for c in schema], schema)


def _longest(b: pa.RecordBatch, tests: TestSuffixes) -> pa.RecordBatch:
    """Matches that no longer match holds, with their places."""
    w, row, at, window = _found(b, tests)
    count = np.diff(tests.bounds)[window]
    at = np.repeat(at, count)
    test = tests.at[tests.suffixes[_ranges(tests.bounds[window], count)]]
    owner = tests.owner[tests.suffixes[_ranges(tests.bounds[window], count)]]
    number = np.r_[tests.numbers(w.hash), 0].astype(np.int64)
    start = w.first[row[at]] if len(at) else at
    end = w.first[row[at] + 1] if len(at) else at
    before = np.where(at > start, number[np.maximum(at - 1, 0)], -1)
    earlier = np.where(test > tests.begin[owner], tests.text[np.maximum(test - 1, 0)], -2)
    use = before != earlier
    at, test, owner, end = at[use], test[use], owner[use], end[use]
    size = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    while len(live):
        a, t = at[live] + size[live], test[live] + size[live]
        same = (a < end[live]) & (tests.text[np.minimum(t, len(tests.text) - 1)] > 0)
        same &= number[np.minimum(a, len(number) - 1)] == tests.text[np.minimum(t, len(tests.text) - 1)]
        size[live[same]] += 1
        live = live[same]
    r = row[at]
    place = np.array(tests.place, np.int64)[owner] + test - tests.begin[owner]
    return pa.RecordBatch.from_arrays(
        [b.column("id").take(pa.array(r)), pa.array([tests.item[o] for o in owner.tolist()], pa.string()), pa.array(at - w.first[r], pa.int64()),
         pa.array(place, pa.int64()), pa.array(size, pa.int64())], ["doc_id", "item_id", "doc_word", "item_word", "n_words"])


class Tests:
    """The blocks of test suffixes of a table of items."""

    __test__ = False

    def __init__(self, items: DataFrame, id_col: str, text_col: str, window: int):
        if not 1 <= window <= ORDER:
            raise ValueError(f"a window has 1 to {ORDER} words")
        self.window = window
        self.pieces = staged(pieces(items, id_col, text_col, window), "test-pieces")
        words = self.pieces.agg(F.sum(F.length("words"))).first()[0] or 0
        self.blocks = max(1, -(-words // 8 // BLOCK_WORDS))

    def __iter__(self):
        for i in range(self.blocks):
            part = self.pieces.where(F.pmod(F.xxhash64("item", "place"), F.lit(self.blocks)) == i)
            yield self.pieces.sparkSession.sparkContext.broadcast(TestSuffixes(part.toArrow(), self.window))


def _docs(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def _scan(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, window: int, keep: list[str]) -> DataFrame:
    """``id``, ``n_words``, ``n_hit``, ``spans``, ``items`` and ``rest`` (a
    struct of the columns ``keep``) of each row."""
    tests = Tests(items, item_id, item_text, window)
    rest = [F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(keep))).alias("rest")] if keep else []
    out = _docs(docs, id_col, text_col, F.lit(None).cast("binary").alias("spans"), F.lit(None).cast("array<string>").alias("items"), *rest)
    for i, block in enumerate(tests):
        last = i == tests.blocks - 1
        schema = T.StructType().add("id", "long")
        if not last:
            schema = schema.add("text", "string")
        schema = schema.add("n_words", "long").add("n_hit", "long").add("spans", "binary").add("items", T.ArrayType(T.StringType()))
        if keep:
            schema = schema.add("rest", out.schema["rest"].dataType)

        def run(batches, block=block, names=tuple(schema.names)):
            for b in byte_parts(batches, 1, SHARD_BYTES):
                yield _hits(b, block.value, list(names))

        if i:
            out = out.select("id", "text", "spans", "items", *(["rest"] if keep else []))
        out = out.mapInArrow(run, schema)
        if not last:  # the next block starts from files
            out = staged(out, "test-hits")
    return out


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_hit`` (words inside any
    occurrence of a window of an item), ``n_items`` (items with such a window),
    ``items_sha256`` (of their ids as strings, sorted, joined by commas) and
    ``contaminated``.

    Words are runs of ASCII letters (A-Z lower-cased), digits and bytes from 0x80 on.
    A window is ``window`` consecutive words of an item; an item of fewer words,
    but not none, is one window.  Words are compared by 64-bit hashes.

    Null, empty and blank texts have no words: such rows have no hits, such
    items no windows.  A row with a null id is judged like any other.  Rows that
    share an item id are one item; items with a null id hit words but aren't
    counted or listed.  Repeated rows stay repeated, an empty table of documents
    gives an empty result, an empty table of items hits nothing; other columns
    aren't read.  Texts of any length are read whole.  Ids of documents are
    whole numbers.
    """
    found = _scan(docs, items, id_col, text_col, item_id, item_text, window, [])
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without those that hold a window of an item (see
    ``contamination``); all columns stay as they are."""
    found = _scan(docs, items, id_col, text_col, item_id, item_text, window, docs.columns)
    return found.where("n_hit = 0").select(*(F.col(f"rest.c{i}").alias(c) for i, c in enumerate(docs.columns)))


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
            item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The longest verbatim matches that hold a window: ``doc_id``, ``item_id``
    (as a string), ``doc_word`` and ``item_word`` (first word, from 0) and
    ``n_words``.  Within an item, a match is followed to the end of its piece
    (``PIECE_WORDS`` words); a longer one is given in parts that overlap."""
    out = None
    for block in Tests(items, item_id, item_text, window):
        def run(batches, block=block):
            for b in byte_parts(batches, 1, SHARD_BYTES):
                yield _longest(b, block.value)

        part = _docs(docs, id_col, text_col).mapInArrow(run, "doc_id long, item_id string, doc_word long, item_word long, n_words long")
        out = part if out is None else out.unionByName(part)
    return out


#: DuckDB SQL of the same rows over tables ``documents`` and ``benchmark``.
SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
x AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
h AS (SELECT x.doc_id, x.i, x.k, bw.item_id FROM x JOIN bw USING (k, g)),
p AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY 1),
t AS (SELECT doc_id, list(DISTINCT item_id::VARCHAR) AS l FROM h WHERE item_id IS NOT NULL GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, COALESCE(p.n, 0)::BIGINT AS n_hit, COALESCE(len(l), 0)::BIGINT AS n_items,
       sha256(COALESCE(array_to_string(list_sort(l), ','), '')) AS items_sha256, COALESCE(p.n, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
