from collections import Counter
from fractions import Fraction

from pyspark.sql import functions as F

from tessera.llm.mixing import mix


def brute_schedule(parts, slots):
    """Earliest deadline first among released blocks, slot by slot."""
    q, done, out = sum(parts.values()), Counter(), []
    for t in range(slots):
        ready = [(-(-(done[s] + 1) * q // a), s) for s, a in sorted(parts.items()) if done[s] * q // a <= t]
        due, s = min(ready)
        assert t < due
        out.append((s, done[s]))
        done[s] += 1
    return out


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_shares_stay_within_one_block(spark):
    sizes = {"hot": 700, "b": 90, "c": 200, "d": 10}
    df = spark.createDataFrame([(i * 10 + k, s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)], "doc_id long, source string")
    parts = {"hot": 3, "b": 2, "c": 5, "d": 1}
    got = rows_of(mix(df, weights=parts, block_rows=4))
    slot = {r["mix_slot"]: r["source"] for r in got}
    assert sorted(slot) == list(range(len(slot)))
    q, given = sum(parts.values()), Counter()
    for t in range(len(slot)):
        given[slot[t]] += 1
        assert all(abs(given[s] - Fraction((t + 1) * a, q)) < 1 for s, a in parts.items())
    assert [slot[t] for t in range(len(slot))] == [s for s, _ in brute_schedule(parts, len(slot))]
    # every row is there, in the first reading of its source once
    assert Counter(r["doc_id"] for r in got if r["mix_epoch"] == 0) == Counter(r["doc_id"] for r in df.collect())
    assert all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in got)
    assert len({r["mix_position"] for r in got}) == len(got)
    # the mix ends with the last source's first reading
    assert max(r["mix_slot"] for r in got if r["mix_epoch"] == 0) == len(slot) - 1


def test_numbering_does_not_depend_on_buckets(spark, monkeypatch):
    from tessera.llm import mixing

    df = spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("source"))
    one = sorted(map(str, mix(df).collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 1)
    assert sorted(map(str, mix(df).collect())) == one


def test_messy_rows(messy, messy_rows, nothing):
    got = rows_of(mix(messy))
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in got if r["mix_epoch"] == 0) == Counter((i, t, s) for i, t, _, s in messy_rows)
    assert {c for c in got[0] if c.startswith("mix_")} == {"mix_epoch", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_position"}
    assert mix(nothing).count() == 0 and mix(nothing, weights={}).count() == 0
    assert mix(messy, weights={"a": 2, None: 3}).where("mix_epoch = 0").count() == len(messy_rows)


def test_in_order(messy):
    place = [r["mix_position"] for r in mix(messy, in_order=True).collect()]
    assert place == sorted(place)


def test_plan_has_no_python(spark, messy):
    plan = mix(messy)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def check_shares(got, sizes, pooled):
    """Every slot is filled once; after any number of slots each pooled source
    is near its target, and has been read as often as its weight says."""
    slot = {r["mix_slot"]: r["source"] for r in got}
    assert sorted(slot) == list(range(len(slot)))
    assert Counter(r["source"] for r in got if r["mix_epoch"] == 0) == Counter(sizes)
    assert all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in got)
    assert len({r["mix_position"] for r in got}) == len(got)
    total = sum(n ** 0.9 for n in sizes.values())
    given = Counter()
    for t in range(len(slot)):
        given[slot[t]] += 1
        for s in pooled if t % 97 == 0 or t == len(slot) - 1 else ():
            assert abs(given[s] - (t + 1) * sizes[s] ** 0.9 / total) < 3, (s, t)


def test_rare_source_beside_a_very_large_one(spark):
    """A source below one part in a thousand gets its own weight, not a floor."""
    sizes = {"hot": 200_000, "rare": 20, "rarer": 3}
    df = spark.range(sum(sizes.values())).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 20, "rare").when(F.col("id") < 23, "rarer").otherwise("hot").alias("source"))
    got = rows_of(mix(df))
    check_shares(got, sizes, ["rare", "rarer"])
    blocks = len({r["mix_slot"] for r in got if r["source"] == "rare"})
    assert abs(blocks - (max(r["mix_slot"] for r in got) + 1) * 20 ** 0.9 / sum(n ** 0.9 for n in sizes.values())) < 2


def test_thousands_of_sources(spark):
    """More rare sources than parts: they keep their own, unequal weights."""
    sizes = {f"s{i}": 1 + i % 40 for i in range(1500)} | {"hot": 20_000}
    df = spark.createDataFrame([(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))], "doc_id long, source string")
    got = rows_of(mix(df, block_rows=4))
    check_shares(got, sizes, [s for s in sizes if s != "hot"])
    few = spark.createDataFrame([(i, f"s{i}") for i in range(1200)], "doc_id long, source string")
    got = rows_of(mix(few, weights={"s1": 3}))
    slots = Counter(r["source"] for r in got)
    assert len(slots) == 1200 and abs(slots["s1"] - 3) <= 1 and sorted(r["mix_slot"] for r in got) == list(range(len(got)))


def test_many_sources_are_not_folded_or_broadcast_together(spark, monkeypatch):
    """The fold sees at most one source per part, and more than ``FEW`` sources
    are joined, with the same rows."""
    from tessera.llm import mixing

    folded, fold = [], mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda parts: folded.append(parts.count()) or fold(parts))
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1500, F.col("id").cast("string")).otherwise("hot").alias("source"))

    def hints(df):
        return df._jdf.queryExecution().analyzed().toString().count("broadcast")

    many = mix(df)
    one = sorted(map(str, many.collect()))
    assert folded == [1]
    monkeypatch.setattr(mixing, "FEW", 10_000)
    few = mix(df)
    assert hints(few) > hints(many)
    assert sorted(map(str, few.collect())) == one
