"""Near-duplicate documents with SetSketch registers.

A document's set is its distinct word shingles.  Its sketch has ``M`` registers
``floor(1 - log_b(x))``, where ``x`` is the least of the elements' exponential
values for that register, truncated to 16 bits; registers merge by maximum and
agree, for ``b`` near 1, about as often as the Jaccard likeness.  Equal sets
form classes; one representative of each is banded.  In each band, members are
set against the least id of their bucket; buckets that still join different
components are then searched for pairs whose likeness, estimated jointly by
maximum likelihood from the registers and the known set sizes, may reach the
threshold.  Every link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged
from tessera.llm.components import components
from tessera.llm.words import Words, mixed

#: registers; bands and registers of a band; base, rate and largest register value.
#: A pair at 0.75 shares no band with probability (1 - 0.75**4)**40 = 2.5e-7.
M, BANDS, ROWS = 160, 40, 4
BASE, RATE, MOST = 1.001, 20.0, (1 << 16) - 1
#: pairs with an estimate more than this below the threshold (5 standard errors) aren't confirmed
MARGIN = 0.17
#: members of a bucket that are set against each other in one step of a task
BLOCK = 1024
SALTS = 16

_rng = np.random.default_rng(20240307)
_MULTIPLY = _rng.integers(0, 1 << 31, M).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_FLIP = _rng.integers(0, 1 << 32, M, dtype=np.uint64).astype(np.uint32)


def distinct_shingles(column, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each row's distinct shingles, by row and hash, A-Z lower-cased."""
    h, row = Words(column, lower=True).shingles(words)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]


def registers(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Registers (rows x M, 16 bits) of sets given as (hash, row) in row order;
    zeros for an empty set.  The least exponential value comes from the least
    uniform one."""
    out = np.zeros((rows, M), np.uint16)
    if len(h):
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        x = (h >> np.uint64(32)).astype(np.uint32)
        low = np.empty((len(starts), M))
        for j in range(M):
            low[:, j] = np.minimum.reduceat((x * _MULTIPLY[j]) ^ _FLIP[j], starts)
        value = -np.log1p(-(low + 0.5) / 2.0 ** 32) / RATE
        out[row[starts]] = np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, MOST).astype(np.uint16)
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def estimated(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard likeness of pairs (rows of ``a`` and ``b``) that maximises the
    likelihood of how many registers are larger, smaller and equal."""
    plus, minus = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - plus - minus
    u = n_a / (n_a + n_b)
    v = 1 - u

    def p(x):
        return -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)

    def value(j):
        up, down = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return plus * np.log(up + tiny) + minus * np.log(down + tiny) + same * np.log(np.maximum(1 - up - down, 0) + tiny)

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(24):
        third = (high - low) / 3
        left = value(low + third) < value(high - third)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    return (low + high) / 2


def complete_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, starts and end) of whole groups of a partition that is sorted by
    its first ``keys`` columns (integers); holds back the last group of a batch."""
    held: list[pa.RecordBatch] = []

    def changes(b) -> np.ndarray:
        new = np.zeros(b.num_rows, bool)
        for c in range(keys):
            k = b.column(c).to_numpy()
            new[1:] |= k[1:] != k[:-1]
        return np.flatnonzero(new)

    def table(parts):
        t = pa.Table.from_batches(parts).combine_chunks()
        return t, np.r_[0, changes(t.to_batches()[0]), t.num_rows]

    for b in batches:
        if not b.num_rows:
            continue
        same = held and all(held[-1].column(c)[-1] == b.column(c)[0] for c in range(keys))
        if held and not same:
            yield table(held)
            held = []
        at = changes(b)
        if len(at):
            yield table([*held, b.slice(0, int(at[-1]))])
            held = [b.slice(int(at[-1]))]
        else:
            held.append(b)
    if held:
        yield table(held)


def _matrix(column) -> np.ndarray:
    """Registers of a fixed-width binary column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, M)


def cross_pairs(k: np.ndarray, size: np.ndarray, comp: np.ndarray, left: np.ndarray, right: np.ndarray,
                band: int, least: float):
    """Pairs (i, j) of members of one bucket, one from ``left`` and one from
    ``right``, of different components, whose first shared band is ``band`` and
    whose estimated likeness is at least ``least``; with the estimates."""
    found = []
    for a in range(0, len(left), 32):
        i = left[a:a + 32]
        equal = (k[i][:, None, :] == k[right][None, :, :]).sum(2, dtype=np.int16)
        near = (equal >= M * (least - 0.08)) & (comp[i][:, None] != comp[right][None, :])
        near &= np.minimum(size[i][:, None], size[right][None, :]) >= least * np.maximum(size[i][:, None], size[right][None, :])
        x, y = np.nonzero(near)
        found.append((i[x], right[y]))
    i, j = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 2
    if left is right or np.array_equal(left, right):
        i, j = i[i < j], j[i < j]
    est = np.zeros(len(i))
    first = np.zeros(len(i), bool)
    for a in range(0, len(i), 20_000):
        p, q = i[a:a + 20_000], j[a:a + 20_000]
        first[a:a + 20_000] = (k[p] == k[q]).reshape(-1, BANDS, ROWS).all(2).argmax(1) == band
        est[a:a + 20_000] = estimated(k[p], k[q], size[p], size[q])
    ok = first & (est >= least)
    return i[ok], j[ok], est[ok]


def linked(n_a, n_b, both, percent: int):
    """The Jaccard likeness of sets of these sizes reaches ``percent`` / 100."""
    return (100 * both >= percent * (n_a + n_b - both)) & (both > 0)


class NearDuplicates:
    """Near-duplicate search over one table (see ``near_duplicates``)."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, words: int, percent: int):
        self.docs = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
        self.words, self.percent = words, percent
        self.least = percent / 100 - MARGIN

    def sketches(self) -> DataFrame:
        """``id``, ``n`` (set size), ``sa``, ``sb`` (128-bit sum of the set), ``regs``."""
        words = self.words

        def run(batches):
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    b = whole.slice(at, 512)
                    h, row = distinct_shingles(b.column(1), words)
                    n = np.bincount(row, minlength=b.num_rows)
                    sums = []
                    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                        s = np.zeros(b.num_rows, np.uint64)
                        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, int)
                        if len(row):
                            s[row[starts]] = np.add.reduceat(mixed(h ^ np.uint64(salt)), starts)
                        sums.append(pa.array(s.view(np.int64)))
                    regs = registers(h, row, b.num_rows)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0), pa.array(n, pa.int64()), *sums, pa.array([r.tobytes() for r in regs], pa.binary())],
                        ["id", "n", "sa", "sb", "regs"])

        return staged(self.docs.mapInArrow(run, "id long, n long, sa long, sb long, regs binary"), "near-sketches")

    def members(self, sketches: DataFrame, classes: DataFrame) -> DataFrame:
        """Members of buckets with at least two representatives: ``band``,
        ``key``, ``id``, ``center`` (the least id of the bucket)."""
        reps = sketches.join(classes.select("sa", "sb", "n", F.col("rep").alias("id")), ["sa", "sb", "n", "id"]) \
            .dropDuplicates(["id", "sa", "sb"]).select("id", "regs")

        def run(batches):
            for b in batches:
                k = _matrix(b.column(1)).astype(np.uint64).reshape(-1, BANDS, ROWS)
                key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), k.shape[:2])
                for j in range(ROWS):
                    key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + k[:, :, j] + np.uint64(1))
                # the band is kept in the low bits of its key
                key = (key & ~np.uint64(63)) | np.arange(BANDS, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))],
                                                 ["key", "id"])

        bands = reps.mapInArrow(run, "key long, id long")
        shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("center"), F.max("id").alias("last")) \
            .where("center < last").select("key", "center")
        return staged(bands.join(shared, "key"), "near-members")

    def texts(self, ids: DataFrame, sketches: DataFrame) -> DataFrame:
        """``id``, ``n``, ``regs``, ``text`` of the documents named by ``ids``."""
        found = self.docs.join(ids, "id", "left_semi")
        words = self.words

        def run(batches):
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    b = whole.slice(at, 512)
                    h, row = distinct_shingles(b.column(1), words)
                    regs = registers(h, row, b.num_rows)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0), pa.array(np.bincount(row, minlength=b.num_rows), pa.int64()),
                         pa.array([r.tobytes() for r in regs], pa.binary()), b.column(1)], ["id", "n", "regs", "text"])

        return staged(found.mapInArrow(run, "id long, n long, regs binary, text string"), "near-texts")

    def confirm(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """Those of ``pairs`` (``a``, ``b``) that are linked; the estimate spares
        texts that can't be."""
        light = texts.select("id", "n", "regs")
        least, words, percent = self.least, self.words, self.percent

        def likely(batches):
            for b in batches:
                c = {x: b.column(x) for x in ("a", "b", "an", "bn", "ar", "br")}
                if not b.num_rows:
                    continue
                est = estimated(_matrix(c["ar"]), _matrix(c["br"]), c["an"].to_numpy(), c["bn"].to_numpy())
                yield pa.RecordBatch.from_arrays([c["a"], c["b"]], ["a", "b"]).filter(pa.array(est >= least))

        def check(batches):
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    b = whole.slice(at, 256)
                    ha, ra = distinct_shingles(b.column(2), words)
                    hb, rb = distinct_shingles(b.column(3), words)
                    h, row = np.r_[ha, hb], np.r_[ra, rb]
                    order = np.lexsort((h, row))
                    h, row = h[order], row[order]
                    twice = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
                    both = np.bincount(row[1:][twice], minlength=b.num_rows)
                    ok = linked(np.bincount(ra, minlength=b.num_rows), np.bincount(rb, minlength=b.num_rows), both, percent)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok))

        a = light.select(F.col("id").alias("a"), F.col("n").alias("an"), F.col("regs").alias("ar"))
        b = light.select(F.col("id").alias("b"), F.col("n").alias("bn"), F.col("regs").alias("br"))
        maybe = staged(pairs.join(a, "a").join(b, "b").mapInArrow(likely, "a long, b long").distinct(), "near-likely")
        ta = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
        tb = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
        return staged(maybe.join(ta, "a").join(tb, "b").select("a", "b", "text_a", "text_b")
                      .mapInArrow(check, "a long, b long"), "near-links")

    def cross_links(self, members: DataFrame, comps: DataFrame, texts: DataFrame) -> DataFrame:
        """Links between different components within a bucket.  Of each large
        bucket, blocks of members are set against each other, so a task holds
        two blocks at most; a pair is looked at in its first shared band only.
        A first pass, on registers, finds the members that any likely pair
        needs; the second brings their texts, takes pairs in descending order of
        the estimate, and confirms those that are still apart."""
        least, words, percent = self.least, self.words, self.percent
        now = members.select("key", "id").join(comps.select(F.col("node").alias("id"), "comp"), "id", "left") \
            .withColumn("comp", F.coalesce("comp", "id"))
        mixed_keys = now.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("size")) \
            .where("low < high").select("key", F.expr(f"(size + {BLOCK - 1}) div {BLOCK}").alias("blocks"))
        spread = now.join(mixed_keys, "key") \
            .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))) \
            .withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))) \
            .select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "comp")

        def pairs(t, s, e, k, n, comp):
            key, x, y = (t.column(c)[s].as_py() for c in ("key", "x", "y"))
            block = t.column("block").to_numpy()[s:e]
            left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
            return cross_pairs(k[s:e], n[s:e], comp[s:e], left, right, key & 63, least)

        def prune(batches):
            for t, ends in complete_groups(batches, 3):
                k, n, comp = _matrix(t.column("regs")), t.column("n").to_numpy(), t.column("comp").to_numpy()
                use = np.zeros(t.num_rows, bool)
                for s, e in zip(ends[:-1], ends[1:], strict=True):
                    i, j, _ = pairs(t, s, e, k, n, comp)
                    use[s + i] = use[s + j] = True
                yield from t.drop_columns(["n", "regs"]).filter(pa.array(use)).to_batches()

        def confirm(batches):
            for t, ends in complete_groups(batches, 3):
                k, n, comp = _matrix(t.column("regs")), t.column("n").to_numpy(), t.column("comp").to_numpy()
                ids, text = t.column("id").to_numpy(), t.column("text").combine_chunks()
                out_a, out_b = [], []
                for s, e in zip(ends[:-1], ends[1:], strict=True):
                    i, j, est = pairs(t, s, e, k, n, comp)
                    if not len(i):
                        continue
                    h, row = distinct_shingles(text.slice(s, e - s), words)
                    at = np.searchsorted(row, np.arange(e - s + 1))
                    parent: dict[int, int] = {}

                    def find(c):
                        while (up := parent.get(c, c)) != c:
                            parent[c] = parent.get(up, up)
                            c = up
                        return c

                    for p in np.argsort(-est, kind="stable"):
                        a, b = i[p], j[p]
                        ca, cb = find(int(comp[s + a])), find(int(comp[s + b]))
                        if ca == cb:
                            continue
                        both = len(np.intersect1d(h[at[a]:at[a + 1]], h[at[b]:at[b + 1]], assume_unique=True))
                        if linked(n[s + a], n[s + b], both, percent):
                            parent[max(ca, cb)] = min(ca, cb)
                            out_a.append(ids[s + a])
                            out_b.append(ids[s + b])
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

        def dealt(rows: DataFrame) -> DataFrame:
            parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            return rows.repartition(parts, "key", "x", "y").sortWithinPartitions("key", "x", "y")

        light = spread.join(texts.select("id", "n", "regs"), "id")
        few = staged(dealt(light.select("key", "x", "y", "block", "id", "comp", "n", "regs"))
                     .mapInArrow(prune, "key long, x long, y long, block long, id long, comp long"), "near-few")
        full = dealt(few.join(texts, "id").select("key", "x", "y", "block", "id", "comp", "n", "regs", "text"))
        return staged(full.mapInArrow(confirm, "a long, b long"), "near-cross")

    def run(self) -> DataFrame:
        sketches = self.sketches()
        classes = sketches.where("n > 0 AND id IS NOT NULL").groupBy("sa", "sb", "n") \
            .agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
        members = self.members(sketches, classes)
        texts = self.texts(members.select("id").distinct(), sketches)
        star = members.where("id <> center").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct()
        links = self.confirm(star, texts)
        comps = components(links, "near-comps")
        more = self.cross_links(members, comps, texts)
        joined = components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(more), "near-comps")
        # a class of many copies is spread over salted keys
        copies = classes.where("copies > 1").select("sa", "sb", "n", "rep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        return sketches.select("id", "n", "sa", "sb", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt")) \
            .join(copies, ["sa", "sb", "n", "salt"], "left") \
            .withColumn("rep", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id"))) \
            .join(joined.select(F.col("node").alias("rep"), "comp"), "rep", "left") \
            .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("comp", "rep").alias("component_id")) \
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, ``component_id`` (the smallest id
    reachable over links, itself included), ``kept`` (it is that id).

    Two documents are linked if 100 times the size of the intersection of their
    sets is at least ``percent`` times that of the union.  Words are runs of
    bytes other than ASCII white space, A-Z lower-cased; a text with fewer than
    ``words`` words has them all as its one shingle.

    Null, empty and blank texts have an empty set and are linked with nothing.
    A row with a null id is linked with nothing and kept, its component is null.
    Rows that share an id are one node; repeated rows stay repeated.  An empty
    table gives an empty result; other columns are not read.  Ids are whole
    numbers.
    """
    return NearDuplicates(df, id_col, text_col, words, percent).run()


#: DuckDB SQL of the same rows over a table ``documents`` (default parameters).
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(
           translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
         lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a, b FROM e2 UNION SELECT r.a, e2.b FROM r JOIN e2 ON r.b = e2.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY 1)
SELECT doc_id, COALESCE(n, 0)::BIGINT AS n_shingles, least(doc_id, COALESCE(m, doc_id)) AS component_id,
       doc_id = least(doc_id, COALESCE(m, doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = doc_id
"""
