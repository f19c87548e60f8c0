"""Table maintenance on plain parquet: upsert by key, insert-if-absent by
content hash, slice replacement, staged writes.

Parquet has no ``MERGE``: an upsert is ``target ⟕̸ updates ∪ updates`` written
to a *new* location (never overwrite a path that is being read); formats
with ``MERGE INTO`` (Delta, Iceberg) can take the same updates frame.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import content_hash
from tessera.session import scratch_path


def upsert(target: DataFrame, updates: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of ``target`` whose key is not updated, plus all ``updates``."""
    keys = [key] if isinstance(key, str) else key
    kept = target.join(updates.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(updates, allowMissingColumns=True)


def upsert_replacing_groups(target: DataFrame, updates: DataFrame, group: str) -> DataFrame:
    """Upsert where ``updates`` carries the complete new set of rows of each
    group it mentions (a re-ingested page replaces all its chunks: D9)."""
    return upsert(target, updates, group)


def append_new_docs(target: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Insert-if-absent by SHA-256 of the text: documents whose hash is not
    yet in ``target`` (which carries a ``hash`` column), one per hash (the
    smallest id)."""
    hashed = docs.withColumn("hash", content_hash(text_col))
    first = hashed.groupBy("hash").agg(F.min_by(F.struct(*[c for c in hashed.columns if c != "hash"]),
                                                F.col(id_col)).alias("d")).select("hash", "d.*")
    return first.join(target.select("hash").distinct(), "hash", "left_anti")


def write_staged(df: DataFrame, spark: SparkSession, name: str, partition_by: list[str] | None = None) -> str:
    """Write ``df`` to a fresh folder under the shared checkpoint location and
    return its path (lineage is cut: readers of the result see files)."""
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def replace_slice(df: DataFrame, path: str, partition_col: str) -> None:
    """Replace only the partitions of ``partition_col`` present in ``df``
    (delete-then-insert of one owner's rows), leaving the others untouched."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(partition_col).parquet(path))
