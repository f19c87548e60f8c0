"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.session import scratch_path
from tessera.tables import load


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on the machine that asks (executors
    have the package installed; only the file's name travels)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later steps
    start from files that survive a lost executor."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_map(fn: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int = 1024):
    """Turn a batch function into a ``mapInArrow`` function that sees at most
    ``rows`` rows at a time (slices share memory with the incoming batch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, rows):
                yield fn(b.slice(i, rows))

    return run


def in_parts(it, n: int):
    """Lists of up to ``n`` items of an iterator."""
    it = iter(it)
    while part := list(islice(it, n)):
        yield part


class TwoGenerationCache(dict):
    """A dict of bounded size: when the young generation is full it becomes the
    old one, and entries still in use move back on their next lookup.
    ``make(key)`` computes a missing value."""

    def __init__(self, make, limit: int = 200_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def known(self, key) -> bool:
        return key in self or key in self.old
