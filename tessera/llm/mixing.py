"""Mixing sources to target weights by Pfair scheduling.

A source with ``a`` parts of a period of ``Q`` slots (``Q`` is the sum of all
parts) has its block ``k`` released at slot ``floor(k*Q/a)`` and due by slot
``ceil((k+1)*Q/a)``.  Earliest deadline first among the released blocks fills
every slot and meets every deadline, so after any number ``t`` of slots each
source has been given within less than one block of ``t*a/Q``.  Releases and
deadlines repeat with the period, so the schedule of one period, as long as the
weights are (never as the data are), places every block of any corpus.

By default the schedule has two levels, so that no weight needs a floor.  The
sources of at least one part of a thousand are scheduled as above.  All rarer
ones are pooled: those of like row counts form a class and take turns in it,
and the classes are joined two by two, the lightest first, into one composite
source, which shares the slots with the first group in the same way.  Where two
sources share ``q`` slots, the first with ``a`` of them gets its block ``k`` at
its release and the other one just before its deadline: both keep all Pfair
windows, and slots follow by arithmetic, at any skew.

Everything is DataFrame expressions: the schedule is folded over the slots of
one period in one small row, documents are numbered by (source, hash bucket),
which splits a large source, and find their slot by arithmetic.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import staged

#: rows per numbering bucket that are aimed at
BUCKET_ROWS = 2048
#: unlisted sources that are scheduled one by one beside given weights
UNLISTED = 1000
#: sources whose plan is broadcast
FEW = 1000
#: integer weight of a source of one row (weights are rounded to whole numbers)
UNIT = 1024
#: row counts with the same so many first binary digits are one class
CLASS_DIGITS = 7


def _key(source: str) -> Column:
    """Null-safe group key: a null source is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))


def schedule(parts: DataFrame) -> DataFrame:
    """``parts`` (``mix_key``, ``mix_parts`` int, ``mix_blocks`` long: one row
    per source) → the same rows with ``mix_period`` (Q) and ``mix_slots`` (slot
    in the period of each of the source's parts)."""
    one = parts.agg(F.sort_array(F.collect_list(F.struct("mix_key", "mix_parts", "mix_blocks"))).alias("s")) \
        .select("s", F.expr("aggregate(s, 0L, (x, y) -> x + y.mix_parts)").alias("q"))
    # fold over the slots: blocks given to each source so far, and the pick of each slot
    one = one.withColumn("picks", F.expr("""
        aggregate(
          sequence(0L, q - 1),
          named_struct('done', transform(s, x -> 0L), 'picks', cast(array() as array<int>)),
          (st, t) -> transform(
            array(array_min(transform(s, (x, i) ->
              IF((st.done[i] * q) div x.mix_parts <= t,
                 named_struct('due', ((st.done[i] + 1) * q + x.mix_parts - 1) div x.mix_parts, 'i', i), NULL)))),
            b -> named_struct('done', transform(st.done, (d, i) -> d + IF(i = b.i, 1L, 0L)),
                              'picks', concat(st.picks, array(b.i))))[0]
        ).picks"""))
    return one.select("q", "picks", F.posexplode("s").alias("i", "x")).select(
        "x.*", F.col("q").alias("mix_period"),
        F.expr("filter(transform(picks, (p, t) -> IF(p = i, t, NULL)), t -> t IS NOT NULL)").alias("mix_slots"))


def _digits(n: int) -> int:
    """Hex digits that make buckets of about ``BUCKET_ROWS`` of ``n`` rows."""
    digits = 0
    while n > BUCKET_ROWS * 16 ** digits and digits < 12:
        digits += 1
    return digits


def _class(n: str) -> Column:
    """Row counts of up to 127 are a class each, larger ones by their first digits."""
    cut = f"greatest(0, length(bin({n})) - {CLASS_DIGITS})"
    return F.expr(f"shiftleft(shiftright({n}, {cut}), {cut})")


def joined(classes: list[tuple[int, int]], others: int) -> list[tuple[int, list[tuple[bool, int, int]]]]:
    """``(class, weight)`` rows → each class's steps from its own slots to
    those of the mix: (whether it is the first of two, its weight, the weight
    of both).  The two lightest are joined until one is left, which then shares
    the mix with ``others``."""
    steps = {c: [] for c, _ in classes}
    heap = [(w, c, [c]) for c, w in classes]
    heapq.heapify(heap)
    while len(heap) > 1:
        (w1, c1, m1), (w2, _, m2) = heapq.heappop(heap), heapq.heappop(heap)
        for first, w, members in ((True, w1, m1), (False, w2, m2)):
            for c in members:
                steps[c].append((first, w, w1 + w2))
        heapq.heappush(heap, (w1 + w2, c1, m1 + m2))
    for w, _, members in heap:
        for c in members if others else []:
            steps[c].append((True, w, w + others))
    return list(steps.items())


STEPS = "array<struct<first: boolean, own: decimal(18,0), both: decimal(18,0)>>"


def _up(slot: str) -> str:
    """A slot of a group as a slot of the mix."""
    return f"""aggregate(mix_steps, {slot}, (x, e) -> IF(e.first, (cast(x as decimal(19,0)) * e.both) div e.own,
        (cast(x + 1 as decimal(19,0)) * e.both + e.own - 1) div e.own - 1))"""


def _down(slots: str) -> str:
    """How many of the first slots of the mix a group has."""
    return f"""aggregate(reverse(mix_steps), {slots}, (x, e) -> IF(e.first,
        (cast(x as decimal(19,0)) * e.own + e.both - 1) div e.both, (cast(x as decimal(19,0)) * e.own) div e.both))"""


def _pooled(spark: SparkSession, rare: DataFrame, n: int, others: int) -> DataFrame:
    """Rows as of ``schedule`` with ``mix_steps`` for ``n`` sources of less than
    one part: a class of ``m`` sources has a period of ``m`` slots, one each."""
    classes = rare.groupBy("mix_class").agg(F.sum("mix_weight").alias("w"), F.count(F.lit(1)).alias("m"))
    found = classes.collect()  # a few thousand rows at most: first digits and length of a row count
    count = {c: m for c, _, m in found}
    steps = staged(spark.createDataFrame([(c, count[c], st) for c, st in joined([(c, w) for c, w, _ in found], others)],
                                         f"mix_class long, mix_period long, mix_steps {STEPS}".replace("decimal(18,0)", "long"))
                   .withColumn("mix_steps", F.col("mix_steps").cast(STEPS)), "mix-classes")
    rare = rare.withColumn("mix_bucket", F.substring(F.md5("mix_key"), 1, _digits(n)))
    before = Window.partitionBy("mix_class").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rare.groupBy("mix_class", "mix_bucket").agg(F.count(F.lit(1)).alias("n")) \
        .select("mix_class", "mix_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("mix_before"))
    turn = F.row_number().over(Window.partitionBy("mix_class", "mix_bucket").orderBy("mix_key"))
    return rare.withColumn("turn", turn).join(offsets, ["mix_class", "mix_bucket"]).join(F.broadcast(steps), "mix_class").select(
        "mix_key", F.lit(1).alias("mix_parts"), "mix_blocks", "mix_period",
        F.array(F.col("mix_before") + F.col("turn") - 1).alias("mix_slots"), "mix_steps")


def plan_of(spark: SparkSession, per_source: DataFrame, weights: dict[str | None, int] | None, alpha: float,
            resolution: int, block_rows: int) -> tuple[DataFrame, int]:
    """``per_source`` (``mix_key``, ``mix_n``) → per source where its blocks
    go: its slots in the period of its group, the group's steps and
    ``mix_runs``, how many of its blocks the mix has; and the number of
    sources.  The mix ends when the last source has been read in full; sources
    that end earlier start again."""
    per_source = staged(per_source.withColumn("mix_blocks", F.expr(f"(mix_n + {block_rows - 1}) div {block_rows}")), "mix-sources")
    n = per_source.count()
    if weights is None:
        share = F.pow(F.col("mix_n").cast("double"), F.lit(float(alpha)))
        target = share / F.lit(per_source.agg(F.sum(share)).first()[0] or 1.0) * resolution
        parts = per_source.withColumn("mix_parts", F.greatest(F.lit(1), F.round(target).cast("int"))) \
            .withColumn("mix_weight", F.greatest(F.lit(1), F.round(share * UNIT)).cast("long")) \
            .withColumn("mix_rare", target < 1).withColumn("mix_class", _class("mix_n"))
    else:
        given = F.create_map(*(F.lit(x) for k, v in weights.items()
                               for x in ("" if k is None else f"={k}", int(v)))) if weights else None
        own = F.lit(None).cast("int") if given is None else F.try_element_at(given, F.col("mix_key"))
        parts = per_source.withColumn("mix_parts", F.greatest(F.lit(1), F.coalesce(own, F.lit(1)))) \
            .withColumn("mix_weight", F.col("mix_parts").cast("long")) \
            .withColumn("mix_rare", own.isNull() & F.lit(n > UNLISTED + len(weights))).withColumn("mix_class", F.lit(1).cast("long"))
    rare, frequent = (F.sum(F.when(c, F.col("mix_weight"))) for c in (F.col("mix_rare"), ~F.col("mix_rare")))
    pool, others = (w or 0 for w in parts.agg(rare, frequent).first())
    own_steps = f"array(named_struct('first', false, 'own', {others}, 'both', {pool + others}))" if pool and others else "array()"
    plan = schedule(parts.where(~F.col("mix_rare")).select("mix_key", "mix_parts", "mix_blocks")) \
        .withColumn("mix_steps", F.expr(f"cast({own_steps} as {STEPS})"))
    if pool:
        plan = plan.unionByName(_pooled(spark, parts.where("mix_rare"), n, others))
    last = "((mix_blocks - 1) div mix_parts) * mix_period + mix_slots[int((mix_blocks - 1) % mix_parts)]"
    end = plan.agg(F.max(F.expr(_up(last)))).first()[0]
    plan = plan.withColumn("mix_end", F.expr(_down(f"{0 if end is None else end + 1}L")))
    return plan.withColumn("mix_runs", F.expr(
        "(mix_end div mix_period) * mix_parts + size(filter(mix_slots, t -> t < mix_end % mix_period))")), n


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source",
        weights: dict[str | None, int] | None = None, alpha: float = 0.9,
        resolution: int = 1000, block_rows: int = 16, in_order: bool = False) -> DataFrame:
    """Every row of ``df`` at its places in the mix.

    ``weights`` gives integer parts per source (a source that is not listed
    gets one part); without it, a source of ``n`` rows gets parts in proportion
    to ``n ** alpha`` at a resolution of ``resolution`` parts.  Sources of less
    than one part are pooled and keep their own weight, exactly up to 127 rows
    and within 0.8 % beyond; each stays within a few blocks of its target.
    Within a source, rows are taken in the order of the MD5 of their id and cut
    into blocks of ``block_rows``.  No row is dropped: the mix goes on until
    each source has been read in full, and sources read faster start again.

    Added columns: ``mix_epoch`` (0 for the first reading of a source),
    ``mix_block``, ``mix_release``, ``mix_deadline``, ``mix_slot`` and
    ``mix_position`` (slot times ``block_rows`` plus the place in the block).
    Columns of ``df`` of these names, or starting with ``mix_``, are replaced.
    With ``in_order`` the rows come range-partitioned and sorted by position.

    A null source is a source of its own; rows with a null id come first in
    it; repeated rows are placed each on their own; an empty table gives an
    empty result.  The slots are folded for the sources of at least one part
    alone, at most ``resolution`` of them by default, and their plan is
    broadcast only if there are at most ``FEW`` sources.
    """
    df = df.drop(*(c for c in df.columns if c.startswith("mix_")))
    n_rows = df.count()
    digits = _digits(n_rows)
    md5 = F.coalesce(F.md5(F.col(id_col).cast("string")), F.lit(""))
    rows = df.withColumn("mix_key", _key(source_col)).withColumn("mix_md5", md5) \
             .withColumn("mix_bucket", F.substring("mix_md5", 1, digits))

    per_bucket = rows.groupBy("mix_key", "mix_bucket").agg(F.count(F.lit(1)).alias("mix_n"))
    before = Window.partitionBy("mix_key").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("mix_key", "mix_bucket",
                                F.coalesce(F.sum("mix_n").over(before), F.lit(0)).alias("mix_before"))
    per_source = per_bucket.groupBy("mix_key").agg(F.sum("mix_n").alias("mix_n"))
    plan, n_sources = plan_of(df.sparkSession, per_source, weights, alpha, resolution, block_rows)

    plan = plan.select("mix_key", "mix_parts", "mix_blocks", "mix_period", "mix_slots", "mix_steps", "mix_runs")
    # few sources are broadcast; many are joined to the buckets, which salt a large source
    offsets = offsets.join(F.broadcast(plan) if n_sources <= FEW else plan, "mix_key")

    in_bucket = Window.partitionBy("mix_key", "mix_bucket").orderBy("mix_md5", id_col)
    placed = (
        rows.withColumn("mix_rank", F.row_number().over(in_bucket))
        .join(offsets, ["mix_key", "mix_bucket"])
        .withColumn("mix_index", F.col("mix_before") + F.col("mix_rank") - 1)
        .withColumn("mix_block", F.expr(f"mix_index div {block_rows}"))
        .withColumn("mix_epoch", F.explode(F.expr("sequence(0L, (mix_runs - 1 - mix_block) div mix_blocks)")))
        .withColumn("mix_run", F.expr("mix_block + mix_epoch * mix_blocks"))
        .withColumn("mix_release", F.expr(_up("(mix_run * mix_period) div mix_parts")))
        .withColumn("mix_deadline", F.expr(_up("((mix_run + 1) * mix_period + mix_parts - 1) div mix_parts - 1") + " + 1"))
        .withColumn("mix_slot", F.expr(_up("(mix_run div mix_parts) * mix_period + mix_slots[int(mix_run % mix_parts)]")))
        .withColumn("mix_position", F.expr(f"mix_slot * {block_rows} + mix_index % {block_rows}"))
        .select(*df.columns, "mix_epoch", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_position")
    )
    if in_order:
        placed = placed.repartitionByRange("mix_position").sortWithinPartitions("mix_position")
    return placed


#: DuckDB SQL of the same rows over a table ``documents`` (default parameters).
SQL = """
WITH RECURSIVE src AS (
  SELECT source, COALESCE('=' || source, '') AS k, count(*) AS n FROM documents GROUP BY ALL),
parts AS (
  SELECT k, greatest(1, round(pow(n, 0.9) / (SELECT sum(pow(n, 0.9)) FROM src) * 1000))::BIGINT AS a,
         (n + 15) // 16 AS b FROM src),
l AS (SELECT list(k ORDER BY k) AS ks, list(a ORDER BY k) AS av, sum(a)::BIGINT AS q, count(*)::BIGINT AS c FROM parts),
sim(t, done, pick) AS (
  SELECT 0::BIGINT, list_transform(av, lambda x: 0::BIGINT), NULL::BIGINT FROM l
  UNION ALL
  SELECT t + 1,
         list_transform(range(1, c + 1), lambda i: done[i] + CASE WHEN i = p THEN 1 ELSE 0 END)::BIGINT[], p
  FROM (SELECT t, done, c, list_sort(list_filter(list_transform(range(1, c + 1), lambda i:
            CASE WHEN (done[i] * q) // av[i] <= t
                 THEN {'due': ((done[i] + 1) * q + av[i] - 1) // av[i], 'i': i} END), lambda x: x IS NOT NULL))[1].i AS p
        FROM sim, l WHERE t < q)),
slots AS (
  SELECT l.ks[pick] AS k, list(t - 1 ORDER BY t) AS s FROM sim, l WHERE pick IS NOT NULL GROUP BY 1),
plan AS (
  SELECT p.k, a, b, q, s,
         max(((b - 1) // a) * q + s[((b - 1) % a) + 1] + 1) OVER () AS e
  FROM parts p JOIN slots USING (k), l),
runs AS (
  SELECT *, (e // q) * a + len(list_filter(s, lambda t: t < e % q)) AS r FROM plan),
idx AS (
  SELECT doc_id, source, COALESCE('=' || source, '') AS k,
         row_number() OVER (PARTITION BY source ORDER BY COALESCE(md5(doc_id::VARCHAR), ''), doc_id) - 1 AS i FROM documents),
x AS (
  SELECT doc_id, source, i, i // 16 AS block, a, b, q, s, unnest(range(0, (r - 1 - i // 16) // b + 1)) AS epoch
  FROM idx JOIN runs USING (k))
SELECT doc_id, source, epoch::BIGINT AS mix_epoch, block::BIGINT AS mix_block,
       ((block + epoch * b) * q // a)::BIGINT AS mix_release,
       (((block + epoch * b + 1) * q + a - 1) // a)::BIGINT AS mix_deadline,
       (((block + epoch * b) // a) * q + s[(block + epoch * b) % a + 1])::BIGINT AS mix_slot,
       ((((block + epoch * b) // a) * q + s[(block + epoch * b) % a + 1]) * 16 + i % 16)::BIGINT AS mix_position
FROM x
"""
