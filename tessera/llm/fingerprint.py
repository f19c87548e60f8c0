"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the ascending array of the ``k`` smallest distinct 64-bit hashes of
a document's word shingles.  Sketches of parts merge into the sketch of the
whole, and two sketches estimate resemblance, containment and the number of
distinct shingles.  Everything is SQL expressions on arrays; a value that is
used more than once inside an expression is bound by ``_let`` so that it is
computed once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD_BREAK = r"[\x20\x09-\x0D]+"
#: hashes in a sketch; the standard error of a resemblance of 0.5 is 0.044
K = 128
#: rows that a run of neighbouring ids is cut into, and the most runs
RUN_ROWS, MOST_RUNS = 1024, 4096
_LOWEST = -(1 << 63)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingle_hashes(text: Column, words: int = 5) -> Column:
    """Hashes of the runs of ``words`` words (with repeats); a shorter text is
    one shingle, a text without words (or null) has none."""
    split = F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")
    none = F.array().cast("array<bigint>")

    def runs(h: Column) -> Column:
        run = F.transform(F.slice(h, F.lit(1), F.greatest(F.lit(0), F.size(h) - words + 1)),
                          lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, words))))
        return F.when(F.size(h) == 0, none).when(F.size(h) < words, F.array(F.xxhash64(h))).otherwise(run)

    return _let(F.transform(split, lambda w: F.xxhash64(w)), runs)


def bottom(hashes: Column, k: int = K) -> Column:
    """Sketch of an array of hashes.  Of a long array, only hashes below a bound
    that about ``3 k`` uniform ones stay under are sorted; where repeats leave
    fewer than ``k``, all are."""
    def smallest(h: Column) -> Column:
        return F.slice(F.sort_array(F.array_distinct(h)), 1, k)

    def cut(h: Column) -> Column:
        bound = (F.lit(float(_LOWEST)) + F.lit(3.0 * k * 2.0 ** 64) / F.size(h)).cast("bigint")
        low = _let(bound, lambda b: smallest(F.filter(h, lambda x: x <= b)))
        return F.when(F.size(h) <= 4 * k, smallest(h)).otherwise(
            _let(low, lambda s: F.when(F.size(s) == k, s).otherwise(smallest(h))))

    return _let(hashes, cut)


def sketch(text: Column, k: int = K, words: int = 5) -> Column:
    """Sketch of a text; empty for a text without words."""
    return bottom(shingle_hashes(text, words), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two sets from the sketches of each."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_count(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    share = (F.element_at(s, -1).cast("double") - float(_LOWEST)) / 2.0 ** 64
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / share)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness: the share of the ``k`` smallest hashes of the
    union that both sketches hold.  Two empty sketches have likeness 1."""
    def share(u: Column) -> Column:
        both = F.size(F.filter(F.array_intersect(a, b), lambda x: x <= F.element_at(u, -1)))
        return both / F.size(u)

    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)) \
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)) \
        .when(a == b, F.lit(1.0)).otherwise(_let(merge(a, b, k), share))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first set's shingles that the second set has."""
    shared = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def as_string(s: Column) -> Column:
    """Fixed-width hexadecimal text of a sketch."""
    return F.array_join(F.transform(s, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def merged(df: DataFrame, group_cols: list[str], sketch_col: str, k: int = K) -> DataFrame:
    """One sketch per group from the sketches of its rows.  Each row gives at
    most ``k`` hashes; equal ones are collapsed before the shuffle, and groups
    are first cut into 64 salted parts, so no task sees a whole large group."""
    h = df.select(*group_cols, F.explode(sketch_col).alias("fp_hash")).distinct()
    salt = Window.partitionBy(*group_cols, "fp_salt").orderBy("fp_hash")
    part = h.withColumn("fp_salt", F.pmod(F.xxhash64("fp_hash"), F.lit(64))) \
            .withColumn("fp_rank", F.row_number().over(salt)).where(F.col("fp_rank") <= k)
    return part.groupBy(*group_cols).agg(F.slice(F.sort_array(F.collect_list("fp_hash")), 1, k).alias(sketch_col))


def with_next(df: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    """``df`` with ``next_<col>`` of the row that follows by id (after the last:
    the first).  Rows are dealt into runs of neighbouring ids at cut ids that
    are themselves rows; the first row of each run is also put, as a ghost, at
    the end of the run before, so each run knows all its successors.  The cut
    ids are at most ``MOST_RUNS`` numbers."""
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LOWEST))
    rows = df.select(id_col, *cols, key.alias("fp_key"))
    keys = df.select(key.alias("fp_key"))
    n = keys.count()
    runs = max(1, min(MOST_RUNS, n // RUN_ROWS))
    at = [i / runs for i in range(1, runs)] or [0.5]
    found = keys.agg(F.min("fp_key").alias("low"), F.percentile_approx("fp_key", at, 10 * runs).alias("cuts")).first()
    cuts = sorted({found["low"], *(found["cuts"] or [])}) if n else []
    if runs == 1:
        cuts = cuts[:1]
    starts = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<bigint>")
    run = F.size(F.filter(starts, lambda c: c <= F.col("fp_key")))
    own = rows.withColumn("fp_run", run).withColumn("fp_ghost", F.lit(0))
    ghost = own.where(F.col("fp_key").isin(cuts) if cuts else F.lit(False)) \
               .withColumn("fp_run", F.when(F.col("fp_run") == 1, len(cuts)).otherwise(F.col("fp_run") - 1)) \
               .withColumn("fp_ghost", F.lit(1))
    order = Window.partitionBy("fp_run").orderBy("fp_ghost", "fp_key", cols[0])
    out = own.unionByName(ghost)
    for c in cols:
        out = out.withColumn(f"next_{c}", F.lead(c).over(order))
    return out.where("fp_ghost = 0").drop("fp_key", "fp_run", "fp_ghost")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Per row: id, ``n_chars`` (code points), ``edited_sha256``,
    ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``,
    ``n_distinct`` (estimated distinct shingles).  The edited text has its last
    ``n_chars // 4`` code points replaced by the first as many (or all) of the
    next row's text, by ascending id; the last row's next is the first.

    Null and empty text: the empty text, an empty fingerprint; its likeness to
    another empty one is 1, else 0.  A null id sorts first; rows of one id
    follow each other in the order of their texts; repeated rows stay repeated;
    an only row follows itself; an empty table gives an empty result; other
    columns are not read.  Ids are whole numbers.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = df.select(F.col(id_col), text.alias("fp_text")).withColumn("fp_sketch", sketch(F.col("fp_text"), k))
    both = with_next(base, id_col, ["fp_text", "fp_sketch"]).withColumn("n_chars", F.length("fp_text").cast("bigint"))
    moved = F.expr("int(n_chars div 4)")
    edited = both.withColumn("fp_edited", F.concat(F.substring("fp_text", F.lit(1), F.col("n_chars").cast("int") - moved),
                                                   F.substring("next_fp_text", F.lit(1), moved)))
    done = edited.withColumn("fp_edited_sketch", sketch(F.col("fp_edited"), k))
    own, new, nxt = F.col("fp_sketch"), F.col("fp_edited_sketch"), F.col("next_fp_sketch")
    return done.select(
        id_col, "n_chars", F.sha2(F.col("fp_edited"), 256).alias("edited_sha256"),
        as_string(own).alias("fingerprint"), as_string(new).alias("edited_fingerprint"),
        resemblance(own, new, k).alias("near_edited"), resemblance(own, nxt, k).alias("near_next"),
        distinct_count(own, k).alias("n_distinct"))
