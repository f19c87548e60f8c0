"""Inclusion dependencies equal a test of every pair of columns."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tessera.operators import catalog as C


def brute(frames):
    values = {}
    for t, df in frames.items():
        rows = df.collect()
        for f in df.schema.fields:
            if f.name in C.key_eligible(df):
                values[t, f.name, C._value_kind(f.dataType)] = [r[f.name] for r in rows if r[f.name] is not None]
    out = set()
    for (t, c, k), a in values.items():
        for (u, e, m), b in values.items():
            if (t, c) != (u, e) and k == m and a and set(map(str, a)) <= set(map(str, b)):
                out.add((t, c, u, e, len(set(a)), len(set(b)), len(set(b)) == len(b)))
    return out


def test_pairs_of_messy_tables(spark):
    rng = random.Random(1)
    day = dt.date(2020, 1, 1)
    a = spark.createDataFrame([(i, rng.choice([1, 2, 3, None]), f"n{i % 7}", day, 1.5, None) for i in range(60)], "id long, kind int, name string, day date, x double, nothing string")
    b = spark.createDataFrame([(i, i % 3 + 1, f"n{i}", f"{i}", day + dt.timedelta(i)) for i in range(9)] + [(None, 1, None, "", None)], "id int, kind long, name string, `odd name` string, day date")
    hot = a.select(F.lit(1).alias("one"), F.lit("n0").alias("name")).union(a.select(F.lit(1), F.lit("n0")))
    frames = {"a": a, "b": b, "hot": hot, "empty": a.where("false")}
    got = set(map(tuple, C.inclusion_dependencies(frames).collect()))
    assert got == brute(frames) and ("hot", "name", "a", "name", 1, 7, False) in got


def test_many_columns_and_none(spark):
    wide = spark.range(20).select(*[(F.col("id") % (i + 1)).alias(f"c{i}") for i in range(70)])
    frames = {"wide": wide, "key": spark.range(25)}
    got = set(map(tuple, C.inclusion_dependencies(frames).collect()))
    assert got == brute(frames) and len(got) > 70 * 69 / 2
    assert C.inclusion_dependencies({"f": spark.range(3).select(F.rand().alias("x"))}).count() == 0
