"""Keyed tables on plain Parquet with commits: merge, insert-if-absent, delete.

A table is a folder of *data* written once and never changed, and of *manifests*,
one a version.  Rows are dealt to a fixed number of buckets by a hash of their
key; a manifest names the folders that hold each bucket.  A change reads and
writes the buckets of its keys only (an insert reads them and adds a folder), and its version exists from the moment its
manifest is complete (``_SUCCESS``, written last):

* a reader is bound to the version it opened, whatever is committed meanwhile;
* a change that is killed leaves the last version as it was, and files that no
  manifest names, which ``vacuum`` removes;
* of two writers that start from one version, the later one's commit fails.

Keys compare null-safe.  A key may have several rows; a merge replaces all rows
of the keys it carries, so a re-ingested page replaces all its chunks.  Updates
are cast to the table's types; columns that the table lacks are added, null in
the present rows.  An empty change commits nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import remove_path
from tessera.sources.writes import write_staged

BUCKETS = 64
BUCKET = "__bucket"
KEY_BYTES = 64 << 20    # keys of a change that are sent to every executor
FILES = 8               # files a bucket, above which a change joins those it rewrites
MANIFEST_SCHEMA = "bucket int, folder string, meta string"


@dataclass(frozen=True)
class Version:
    number: int
    keys: list[str]
    buckets: int
    schema: T.StructType
    folders: dict[int, tuple[str, ...]]     # bucket → folders, buckets without rows left out


def _listed(spark: SparkSession, folder: str) -> list[str]:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(target)] if fs.exists(target) else []


def _numbers(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n[1:]) for n in _listed(spark, f"{path}/manifest") if n.startswith("v"))


def versions(spark: SparkSession, path: str) -> list[int]:
    """The committed versions, oldest first."""
    return [n for n in _numbers(spark, path) if "_SUCCESS" in _listed(spark, f"{path}/manifest/v{n:09d}")]


def version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """The given version, or the last one."""
    known = versions(spark, path)
    if not known or (number is not None and number not in known):
        raise ValueError(f"no version {'' if number is None else number} at {path}")
    number = known[-1] if number is None else number
    rows = spark.read.schema(MANIFEST_SCHEMA).json(f"{path}/manifest/v{number:09d}").collect()
    meta = json.loads(next(r.meta for r in rows if r.meta is not None))
    folders: dict[int, tuple[str, ...]] = {}
    for r in sorted((r.bucket, r.folder) for r in rows if r.meta is None):
        folders[r[0]] = folders.get(r[0], ()) + (r[1],)
    return Version(number, meta["keys"], meta["buckets"], T.StructType.fromJson(meta["schema"]), folders)


def _bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).cast("int")


def _rows(spark: SparkSession, path: str, v: Version, buckets=None) -> DataFrame:
    folders = [f"{path}/{f}" for b, of in sorted(v.folders.items()) if buckets is None or b in buckets for f in of]
    if not folders:
        return spark.createDataFrame([], v.schema)
    return spark.read.schema(v.schema).parquet(*folders)


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The table at a version (default: the last one)."""
    return _rows(spark, path, version(spark, path, number))


def _commit(spark: SparkSession, path: str, rows: DataFrame, base: Version | None, number: int, keys: list[str],
            buckets: int, rewritten=None, present: DataFrame | None = None) -> int:
    """Write ``rows``, the new content of the buckets ``rewritten`` (all of them
    if None), and the manifest.  ``present`` rows of the same columns lie in the
    table's buckets already and are written as they come, without a shuffle."""
    if BUCKET in rows.columns:
        raise ValueError(f"{BUCKET} is the name of the bucket column")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    commit = f"data/{uuid.uuid4().hex}"
    # a bucket is one file or, when large, as many as adaptive execution cuts it into
    dealt = rows.withColumn(BUCKET, _bucket(keys, buckets)).hint("rebalance", BUCKET)
    if present is not None:
        dealt = present.withColumn(BUCKET, _bucket(keys, buckets)).unionByName(dealt)
    dealt.write.partitionBy(BUCKET).parquet(f"{path}/{commit}")
    written = {int(n.split("=")[1]): f"{commit}/{n}" for n in _listed(spark, f"{path}/{commit}") if n.startswith(BUCKET)}
    if rewritten == set() and not written:
        return base.number
    kept = [] if base is None or rewritten is None else [(b, f) for b, of in base.folders.items() if b not in rewritten for f in of]
    meta = json.dumps({"keys": keys, "buckets": buckets, "schema": schema.jsonValue()})
    spark.createDataFrame([(None, None, meta), *((b, f, None) for b, f in sorted([*kept, *written.items()]))], MANIFEST_SCHEMA) \
        .coalesce(1).write.mode("errorifexists").json(f"{path}/manifest/v{number:09d}")
    return number


def create(df: DataFrame, path: str, key: str | list[str], buckets: int = BUCKETS) -> int:
    """Write ``df`` as version 1 of a new table."""
    keys = [key] if isinstance(key, str) else list(key)
    spark = df.sparkSession
    if _numbers(spark, path):
        raise ValueError(f"{path} holds a table already")
    return _commit(spark, path, df, None, 1, keys, buckets)


def _changed(spark: SparkSession, path: str, change: DataFrame, all_columns: bool):
    """What a change starts from: the last version, the number of the next, the
    change cast and written once, its buckets (no more than the table has), and
    where it is written."""
    v = version(spark, path)
    number = v.number + 1
    dead = [n for n in _numbers(spark, path) if n > v.number]
    number = max([number, *(n + 1 for n in dead)])
    types = {f.name: f.dataType for f in v.schema}
    names = change.columns if all_columns else v.keys
    cast = change.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in names])
    staged = write_staged(cast, spark, "merge")
    cast = spark.read.schema(cast.schema).parquet(staged)
    hit = {r[0] for r in cast.select(_bucket(v.keys, v.buckets)).distinct().collect()}
    return v, number, cast, hit, staged


def _without(rows: DataFrame, others: DataFrame, keys: list[str], few: bool = False) -> DataFrame:
    gone = others.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)]).distinct()
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return rows.join(F.broadcast(gone) if few else gone, same, "left_anti")


def _few(change: DataFrame, keys: list[str]) -> bool:
    """Whether the keys of a written change can be sent to every executor."""
    size = sum((F.octet_length(F.col(f"`{k}`").cast("string")) for k in keys), F.lit(64))
    return (change.agg(F.sum(F.coalesce(size, F.lit(64)))).first()[0] or 0) <= KEY_BYTES


def _replace(spark: SparkSession, path: str, v: Version, number: int, cast: DataFrame, hit: set[int], added: DataFrame | None) -> int:
    """Commit the rows of the buckets ``hit`` without the keys of ``cast``, and
    ``added``.  Where these keys are few, the rows that stay aren't shuffled: their
    files are their buckets'.  Files that such commits have made small are joined
    by the next one."""
    rows = _rows(spark, path, v, hit)
    few = _few(cast, v.keys)
    kept = _without(rows, cast, v.keys, few)
    none = kept.where("false")
    new = none if added is None else none.unionByName(added, allowMissingColumns=True)
    if few and len(rows.inputFiles()) <= FILES * v.buckets:
        missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in new.schema.fields[len(kept.columns):]]
        return _commit(spark, path, new, v, number, v.keys, v.buckets, hit, kept.select("*", *missing))
    return _commit(spark, path, kept.unionByName(new, allowMissingColumns=True), v, number, v.keys, v.buckets, hit)


def merge(updates: DataFrame, path: str) -> int:
    """Rows of the updates' keys replaced by ``updates``; the new version."""
    spark = updates.sparkSession
    v, number, cast, hit, staged = _changed(spark, path, updates, True)
    if hit:
        _replace(spark, path, v, number, cast, hit, cast)
    remove_path(spark, staged)
    return number if hit else v.number


def insert_absent(rows: DataFrame, path: str) -> int:
    """One row of every key that the table hasn't got (the least by the columns in
    their order); a repeated attempt changes nothing.  The rows are added to their
    buckets; none that the table has is written again."""
    spark = rows.sparkSession
    v, number, cast, hit, staged = _changed(spark, path, rows, True)
    new = _without(cast, _rows(spark, path, v, hit), v.keys)
    one = new.groupBy(*[F.col(f"`{k}`").alias(f"__g{i}") for i, k in enumerate(v.keys)]) \
        .agg(F.min(F.struct(*[F.col(f"`{c}`") for c in new.columns])).alias("r")).select("r.*")
    out = spark.createDataFrame([], v.schema).unionByName(one, allowMissingColumns=True)
    number = _commit(spark, path, out, v, number, v.keys, v.buckets, set())
    remove_path(spark, staged)
    return number


def delete(keys: DataFrame, path: str) -> int:
    """The table without the rows of these keys."""
    spark = keys.sparkSession
    v, number, cast, hit, staged = _changed(spark, path, keys, False)
    hit &= set(v.folders)
    if hit:
        _replace(spark, path, v, number, cast, hit, None)
    remove_path(spark, staged)
    return number if hit else v.number


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Remove manifests before the last ``keep`` versions and data that no kept
    version names; returns the number of folders removed.  For the table's one
    writer, between changes."""
    known = versions(spark, path)
    kept = known[-keep:]
    used = {f for n in kept for of in version(spark, path, n).folders.values() for f in of}
    gone = [f"{path}/manifest/v{n:09d}" for n in _numbers(spark, path) if n not in kept]
    for commit in _listed(spark, f"{path}/data"):
        inside = [f"data/{commit}/{b}" for b in _listed(spark, f"{path}/data/{commit}") if b.startswith(BUCKET)]
        if not used.intersection(inside):
            gone.append(f"{path}/data/{commit}")
        else:
            gone += [f"{path}/{b}" for b in inside if b not in used]
    for g in gone:
        remove_path(spark, g)
    return len(gone)
