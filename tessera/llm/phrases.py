"""Phrase collocations from FM-indexes of word sequences.

The texts are cut into shards.  A shard's words are numbered, its pieces joined
with 0 after each, and the Burrows-Wheeler transform of that sequence is stored
with the vocabulary.  Phrases are enumerated on the transform, all intervals of
a depth at once: an interval is extended to the left by the symbols that stand
before its suffixes, which the LF mapping sends to one interval each, and to
the right along the inverse mapping.  Each phrase has its count and how many of
its occurrences have a word before and after them.  Counts add up across shards.

Shards send a hash and a count for each of their phrases, packed by hash range.
The sums of a range are exact; a phrase that reaches the least count is given to
one of the shards that have it, and that shard writes it out as text.  So the
text of a phrase travels once, whatever its count.
"""

from __future__ import annotations

import uuid
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bytewise import byte_parts, byte_table, translated
from tessera.llm.common import staged
from tessera.llm.words import Words, constants, mixed
from tessera.session import scratch_path

#: words of the longest candidates, least count, phrases of a language, share (per cent) at which a longer phrase replaces a part
LONGEST, LEAST, TOP, SHARE = 3, 10, 2000, 50
#: bytes of text in a shard
SHARD_BYTES = 4 << 20
#: bytes of index for each range of hashes that is summed up together, and how many ranges there are (powers of 2)
RANGE_BYTES, RANGES = 8 << 20, (1 << 8, 1 << 16)
#: counts from here on are sent in eight bytes
WIDE = 255
#: parts of a language's phrases that are ranked apart
SALTS = 16

#: A-Z lower-cased; pieces end at any of .,;:!? and 0x0A to 0x0D
TABLE = byte_table(b"", b".,;:!?\x0b\x0c\x0d")


def _language_hash(lang: str) -> int:
    return int.from_bytes(sha256(lang.encode()).digest()[:8], "little")


def _slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bytes of words, a blank after each."""
    size = end - start + 1
    stop = np.cumsum(size)
    out = data[np.minimum(np.arange(int(stop[-1]) if len(stop) else 0) - np.repeat(stop - size, size) + np.repeat(start, size), len(data) - 1)]
    out[stop - 1] = 0x20
    return out


class Shard:
    """FM-index of a shard: ``bwt`` (0 ends a piece), ``words`` (the vocabulary:
    words 1, 2, … with a blank after each) and the language of each word."""

    def __init__(self, bwt: np.ndarray, words: bytes, lang: np.ndarray, langs: list[str]):
        self.bwt, self.words, self.lang, self.langs = bwt, words, lang, langs

    @classmethod
    def build(cls, texts, langs) -> Shard:
        """Of a text column and a language column without nulls."""
        texts = translated(texts, TABLE)
        w = Words(texts)
        names = langs.dictionary_encode() if not pa.types.is_dictionary(langs.type) else langs
        row = w.row_of()
        lang = names.indices.to_numpy().astype(np.int64)[row]
        # the same word of two languages is two words
        salt = np.array([_language_hash(x) for x in names.dictionary.to_pylist()] or [0], np.uint64)
        number = pd.factorize(mixed(w.hash ^ salt[lang]))[0].astype(np.int64) + 1
        most = np.maximum.accumulate(number) if len(number) else number
        first = np.flatnonzero(np.r_[True, most[1:] > most[:-1]]) if len(number) else number
        # a piece ends at a line feed or at the end of a text
        line = np.searchsorted(np.flatnonzero(w.data == 0x0A), w.start)
        ends = np.ones(len(number), bool)
        ends[:-1] = (row[1:] != row[:-1]) | (line[1:] != line[:-1])
        place = np.arange(len(number)) + np.cumsum(ends) - ends
        seq = np.zeros(len(number) + int(ends.sum()), np.int64)
        seq[place] = number
        return cls(transform(seq), _slices(w.data, w.start[first], w.end[first]).tobytes() if len(number) else b"",
                   lang[first].astype(np.int32), names.dictionary.to_pylist())

    def texts(self) -> pa.Array:
        data = np.frombuffer(self.words, np.uint8)
        ends = np.flatnonzero(data == 0x20)
        offsets = np.r_[0, ends - np.arange(len(ends))]
        return pa.Array.from_buffers(pa.large_string(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data[data != 0x20])])

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word with its language."""
        salt = np.array([_language_hash(x) for x in self.langs] or [0], np.uint64)
        return mixed(Words(self.texts()).hash ^ salt[self.lang])


def transform(seq: np.ndarray) -> np.ndarray:
    """Burrows-Wheeler transform by the first ``LONGEST`` symbols of suffixes;
    intervals of patterns of that length are those of the full order."""
    n = len(seq)
    if not n:
        return np.zeros(0, np.int32)
    size = int(seq.max()) + 1
    bits = max(1, (size - 1).bit_length())
    padded = np.r_[seq, np.zeros(LONGEST, np.int64)]
    if bits * LONGEST <= 63:
        key = np.zeros(n, np.int64)
        for j in range(LONGEST):
            key = key << bits | padded[j:j + n]
        order = np.argsort(key)
    else:
        order = np.lexsort([padded[j:j + n] for j in range(LONGEST - 1, -1, -1)])
    return seq[order - 1].astype(np.int32)  # place -1 is the last symbol


class Intervals:
    """Phrases of one depth: ``first`` (where each interval begins), ``count``,
    ``words`` (a column of word numbers for each place), ``left`` and ``right``
    (occurrences with a word before and after)."""

    def __init__(self, first, count, words, left, right):
        self.first, self.count, self.words, self.left, self.right = first, count, words, left, right


def enumerate_phrases(bwt: np.ndarray, depth: int = LONGEST):
    """``Intervals`` of the phrases of 1 to ``depth`` words."""
    n = len(bwt)
    if not n:
        return
    # the j-th suffix follows, in the text, on the suffix at which its first symbol is the transform's
    key = bwt.astype(np.int64) * n + np.arange(n)
    key.sort()
    symbol = key // n
    after = key - symbol * n  # inverse of the LF mapping
    del key
    symbol, after = symbol.astype(np.int32), after.astype(np.int32)
    begin = int(np.searchsorted(symbol, 1))  # suffixes of separators come first
    before = bwt != 0
    # the interval of the rest of each suffix, refined from depth to depth
    rest = np.zeros(n, np.int32)
    valid = np.zeros(n, bool)
    valid[begin:] = True
    follow = after
    for d in range(1, depth + 1):
        new = np.ones(n, bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (rest[1:] != rest[:-1])
        first = np.flatnonzero(new & valid)
        interval = np.cumsum(new, dtype=np.int32)
        size = np.diff(np.r_[np.flatnonzero(new), n])[interval[first] - 1]
        words, at = [symbol[first]], first
        for _ in range(1, d):
            at = after[at]
            words.append(symbol[at])
        if len(first):
            live = valid.astype(np.int64)
            left = np.add.reduceat(live * before, first)
            right = np.add.reduceat(live * (symbol[follow] != 0), first)
        else:
            left = right = np.zeros(0, np.int64)
        yield Intervals(first, size, words, left, right)
        if d < depth:
            # left extension: a suffix is the symbol before the interval of its rest
            rest = interval[after]
            good = valid[after]
            rest[~good] = 0
            valid = valid & good
            follow = after[follow]


def phrase_hashes(words: list[np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of phrases: one tells the range, the other stands for the
    phrase in it (together 64 bits and those of the range)."""
    c = constants()
    one = np.full(len(words[0]), len(words), np.uint64)
    two = one + np.uint64(0x5851F42D4C957F2D)
    for j, w in enumerate(words):
        h = hashes[w - 1]
        one += h * c[j]
        two += (h ^ (h >> np.uint64(29))) * c[j + LONGEST]
    return mixed(one), mixed(two)


def packed_numbers(numbers: np.ndarray) -> bytes:
    """Numbers in three bytes each, or in four if one needs them."""
    data = np.ascontiguousarray(numbers, np.uint32)
    if len(data) and int(data.max()) >> 24:
        return b"4" + data.tobytes()
    return b"3" + np.ascontiguousarray(data.view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


def unpacked_numbers(data: bytes) -> np.ndarray:
    if data[:1] == b"4":
        return np.frombuffer(data, np.uint32, offset=1).astype(np.int32)
    out = np.zeros((len(data) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, 3)
    return out.view(np.uint32).reshape(-1).astype(np.int32)


def shards(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """The FM-index of each shard (``shard`` is its number), and ``totals`` of its
    words by language."""
    def run(batches):
        held, size = [], 0

        def built():
            t = pa.Table.from_batches(held).combine_chunks()
            s = Shard.build(t.column("text"), t.column("lang").combine_chunks())
            total = np.bincount(s.lang[s.bwt[s.bwt > 0] - 1], minlength=len(s.langs)) if len(s.langs) else np.zeros(0, int)
            return pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([packed_numbers(s.bwt)], pa.binary()), pa.array([s.words], pa.binary()), pa.array([s.lang.tobytes()], pa.binary()),
                 pa.array([s.langs], pa.list_(pa.string())), pa.array([total.tolist()], pa.list_(pa.int64()))],
                ["shard", "bwt", "words", "lang", "langs", "totals"])

        for b in byte_parts(batches, 0, SHARD_BYTES):
            held.append(b)
            size += b.column(0).nbytes
            if size >= SHARD_BYTES:
                yield built()
                held, size = [], 0
        if held:
            yield built()

    rows = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    return rows.mapInArrow(run, "shard long, bwt binary, words binary, lang binary, langs array<string>, totals array<long>")


def _stored(index: DataFrame) -> DataFrame:
    """The index in the shared folder, a few shards a file, so that no reader
    holds many of them at once."""
    spark = index.sparkSession
    path = scratch_path(spark, f"llm/phrase-index-{uuid.uuid4().hex}")
    index.write.option("maxRecordsPerFile", 4).parquet(path)
    return spark.read.schema(index.schema).parquet(path)


def _read(b: pa.RecordBatch | pa.Table):
    for shard, bwt, words, lang, langs in zip(*(b.column(c) for c in ("shard", "bwt", "words", "lang", "langs")), strict=True):
        yield shard.as_py(), Shard(unpacked_numbers(bwt.as_py()), words.as_py(), np.frombuffer(lang.as_py(), np.int32), langs.as_py())


def _ranges(index: DataFrame) -> int:
    """Ranges of hashes, from the size of the written index."""
    size = int(index._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(RANGES[1], max(RANGES[0], 1 << (size // RANGE_BYTES).bit_length()))


def _sums(index: DataFrame, longest: int, least: int, parts: int, ranges: int) -> DataFrame:
    """The phrases that reach ``least``: ``shard`` (one that has them), ``range``,
    ``hashes`` and ``sums``."""
    top = np.uint64(65 - ranges.bit_length())

    def send(batches):
        for b in batches:
            for shard, s in _read(b):
                h = s.hashes()
                for i in enumerate_phrases(s.bwt, longest):  # a depth at a time, to hold little
                    if not len(i.first):
                        continue
                    place, hashes = phrase_hashes(i.words, h)
                    order = np.argsort(place)
                    hashes, count = hashes[order], i.count[order]
                    cut = np.searchsorted(place[order] >> top, np.arange(ranges + 1, dtype=np.uint64)).tolist()
                    some = [r for r in range(ranges) if cut[r] < cut[r + 1]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some, pa.int32()), pa.array([shard] * len(some), pa.int64()), pa.array([hashes[cut[r]:cut[r + 1]].tobytes() for r in some], pa.binary()),
                         pa.array([np.minimum(count[cut[r]:cut[r + 1]], WIDE).astype(np.uint8).tobytes() for r in some], pa.binary()),
                         pa.array([(x := count[cut[r]:cut[r + 1]])[x >= WIDE].tobytes() for r in some], pa.binary())], ["range", "shard", "hashes", "counts", "wide"])

    def summed(batches):
        """Sums of each range; ranges follow one another."""
        held, now = [], None

        def total():
            h = np.concatenate([np.frombuffer(x[1], np.uint64) for x in held])
            c = []
            for _, _, few, wide in held:
                few = np.frombuffer(few, np.uint8).astype(np.int64)
                few[few == WIDE] = np.frombuffer(wide, np.int64)
                c.append(few)
            c = np.concatenate(c)
            owner = np.repeat(np.array([x[0] for x in held]), [len(x[2]) for x in held])
            order = np.argsort(h)
            h, c, owner = h[order], c[order], owner[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            f = np.add.reduceat(c, first)
            good = f >= least
            h, f, owner = h[first][good], f[good], owner[first][good]
            order = np.argsort(owner, kind="stable")
            h, f, owner = h[order], f[order], owner[order]
            at = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, int)
            end = np.r_[at[1:], len(owner)] if len(owner) else at
            return pa.RecordBatch.from_arrays(
                [pa.array(owner[at], pa.int64()), pa.array(np.full(len(at), now), pa.int32()), pa.array([h[a:z].tobytes() for a, z in zip(at, end, strict=True)], pa.binary()),
                 pa.array([f[a:z].tobytes() for a, z in zip(at, end, strict=True)], pa.binary())], ["shard", "range", "hashes", "sums"])

        for b in batches:
            for r, *row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if r != now and held:
                    yield total()
                    held = []
                now = r
                held.append(row)
        if held:
            yield total()

    sent = index.mapInArrow(send, "range int, shard long, hashes binary, counts binary, wide binary")
    return sent.repartition(parts, "range").sortWithinPartitions("range").mapInArrow(summed, "shard long, range int, hashes binary, sums binary")


def counted(index: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """``lang``, ``phrase`` (words joined by a blank), ``k`` (words) and ``f``
    (occurrences, at least ``least``) of a written index."""
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = _ranges(index)
    top = np.uint64(65 - ranges.bit_length())

    def write(left: pa.Table, right: pa.Table) -> pa.Table:
        """Texts of the phrases that were given to a shard."""
        out = []
        for _, s in _read(left):
            given = np.repeat(right.column("range").to_numpy().astype(np.uint64), [len(x) // 8 for x in right.column("hashes").to_pylist()])
            keys = np.frombuffer(b"".join(right.column("hashes").to_pylist()), np.uint64)
            sums = np.frombuffer(b"".join(right.column("sums").to_pylist()), np.int64)
            order = np.argsort(keys)
            keys, given, sums = keys[order], given[order], sums[order]
            h, texts, names = s.hashes(), s.texts(), pa.array(s.langs, pa.string())
            for i in enumerate_phrases(s.bwt, longest):
                if not len(keys) or not len(i.first):
                    continue
                place, own = phrase_hashes(i.words, h)
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                # equal hashes of other ranges lie side by side
                for step in range(int(np.bincount(np.unique(keys, return_inverse=True)[1]).max())):
                    near = np.minimum(at + step, len(keys) - 1)
                    use = np.flatnonzero((keys[near] == own) & (given[near] == place >> top) & (at + step < len(keys)))
                    words = [texts.take(pa.array(w[use] - 1)) for w in i.words]
                    phrase = pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())).cast(pa.string())
                    out.append(pa.table({"lang": names.take(pa.array(s.lang[i.words[0][use] - 1])), "phrase": phrase,
                                         "k": pa.array(np.full(len(use), len(words)), pa.int32()), "f": pa.array(sums[near[use]])}))
        return pa.concat_tables(out) if out else EMPTY

    found = _sums(index, longest, least, parts, ranges)
    bodies = index.select("shard", "bwt", "words", "lang", "langs")
    return bodies.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(write, "lang string, phrase string, k int, f long")


EMPTY = pa.table({"lang": pa.array([], pa.string()), "phrase": pa.array([], pa.string()), "k": pa.array([], pa.int32()), "f": pa.array([], pa.int64())})


#: product of counts as whole decimals of up to 38 digits
SCORE = "(CAST(a AS DECIMAL(19, 0)) * CAST(a AS DECIMAL(19, 0)) * 1000000BD) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))"


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP,
                 share: int = SHARE) -> DataFrame:
    """The best phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``
    (its count), ``l`` and ``r`` (counts of the parts at its lowest-scoring
    cut), ``n`` (words of the language), ``score``.

    A-Z are lower-cased; texts are split at ``.,;:!?`` and line ends into pieces,
    and those at blanks and tabs into words.  Phrases are runs of 2 to
    ``longest`` words of a piece with at least ``least`` occurrences (overlaps count).
    The score is ``floor(1000000 a a / (l r))`` in whole decimals, exact for
    counts below 10^16.  A phrase inside a longer one goes if
    the longer has at least ``share`` per cent of its count.

    A null language is ``und``, a null or empty text has no words; repeated rows
    count each time; texts of any length are read whole.  Equal scores follow
    count and then phrase, in byte order.  An empty table gives an empty result;
    other columns aren't read.  Words of a shard are told apart by 64-bit
    hashes, phrases of all shards by 72 bits or more (64 and those of the range).
    """
    if not 2 <= longest <= LONGEST:
        raise ValueError(f"phrases have 2 to {LONGEST} words")
    index = _stored(shards(df, text_col, lang_col))
    total = index.select(F.explode(F.arrays_zip("langs", "totals")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.totals").alias("n"))
    found = staged(counted(index, longest, least), "phrases")
    long = found.where("k > 1").withColumn("w", F.split("phrase", " "))

    def part(first, size):
        return F.array_join(F.slice("w", first, size), " ")

    cuts = long.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))) \
        .select("lang", "phrase", "k", F.col("f").alias("a"), "cut", part(F.lit(1), F.col("cut")).alias("head"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("tail"))
    left = found.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    right = found.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    scored = cuts.join(left, ["lang", "head"]).join(right, ["lang", "tail"]) \
        .withColumn("score", F.expr(SCORE))
    worst = scored.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x"))
    # each phrase with the most frequent one that is a word longer on either side, and so on
    inner = long.where("k > 2").withColumn("first", F.explode(F.sequence(F.lit(1), F.col("k") - 1))) \
        .withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1))).where("first + size - 1 <= k") \
        .groupBy("lang", part(F.col("first"), F.col("size")).alias("phrase")).agg(F.max("f").alias("longer"))
    kept = worst.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share)) \
        .select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    # a language may hold a third of all phrases: each of its parts gives its own
    # best first, so the last task of a language reads at most SALTS * top rows
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    parts = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL of the same rows over a table ``documents``.
SQL = r"""
WITH d AS (
  SELECT COALESCE(lang, 'und') AS lang, doc_id,
         translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+')) AS t FROM d),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, 1 AS k, unnest(w) AS g FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
f AS MATERIALIZED (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS MATERIALIZED (SELECT lang, k, g, f AS a, string_split(g, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
h AS (SELECT lang, k, g, a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:k], ' ') AS tail
      FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
s AS (
  SELECT h.*, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM h JOIN f x ON x.lang = h.lang AND x.g = h.head JOIN f y ON y.lang = h.lang AND y.g = h.tail),
b AS MATERIALIZED (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
o AS (
  SELECT lang, g, max(a) AS m
  FROM (SELECT lang, array_to_string(w[1:2], ' ') AS g, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3) GROUP BY ALL),
e AS (SELECT b.* FROM b LEFT JOIN o ON o.lang = b.lang AND o.g = b.g WHERE m IS NULL OR 100 * m < 50 * a),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM e)
SELECT lang, rank::BIGINT AS rank, g AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM z JOIN n USING (lang) WHERE rank <= 2000
"""
