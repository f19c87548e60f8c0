"""Vector column functions: similarity, normalisation, hashed text embedding,
JSON and float32-byte codecs.

Vectors are stored as ``ARRAY<FLOAT>`` and every similarity is accumulated in
double.  The default text embedder is a hashed bag of words: tokens are
split with RE2 inside an Arrow-native UDF, hashed once per distinct token of the
batch (``md5`` → bucket), and the histograms and L2 norms of the whole batch
are one ``numpy.bincount``.  Model embedders plug in
through :class:`Embedder` as an iterator pandas UDF.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASH_DIM = 256
EPS = 1e-12
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"          # Java regex (JVM path)
ARROW_TOKEN_SPLIT = r"[^\p{L}\p{N}]+"    # RE2 (Arrow path): same classes


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ---------------------------------------------------------------------------
# Similarity
# ---------------------------------------------------------------------------


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0).cast("double"),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str, eps: float = EPS) -> Column:
    """Cosine similarity with ``eps`` added to the norm product."""
    return dot(a, b) / (norm(a) * norm(b) + F.lit(eps))


def cosine_distance(a: Column | str, b: Column | str, eps: float = EPS) -> Column:
    return F.lit(1.0) - cosine(a, b, eps)


def l2_normalize(a: Column | str) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(_c(a), lambda x: (x.cast("double") / n).cast("float"))).otherwise(_c(a))


# ---------------------------------------------------------------------------
# Hashed bag-of-words embedding
# ---------------------------------------------------------------------------


def tokens(text: Column | str) -> Column:
    """Lower-cased letter/digit runs."""
    return F.filter(F.split(F.lower(_c(text)), TOKEN_SPLIT), lambda t: F.length(t) > 0)


def token_buckets(text: Column | str, dim: int = HASH_DIM) -> Column:
    """Bucket of each token: first 32 bits of its MD5, modulo ``dim``."""
    return F.transform(tokens(text), lambda t: F.pmod(
        F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int"))


def _bincount_udf(dim: int):
    """Arrow-native UDF: the whole batch of bucket lists is one flat array
    plus offsets, so the histogram of every row is a single ``bincount``."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def embed(b: pa.Array) -> pa.Array:
        if isinstance(b, pa.ChunkedArray):
            b = b.combine_chunks()
        n = len(b)
        offs = b.offsets.to_numpy()
        vals = b.values.to_numpy(zero_copy_only=False).astype(np.int64)[offs[0]:offs[-1]]
        row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offs))
        h = np.bincount(row * dim + vals, minlength=n * dim).reshape(n, dim).astype(np.float64)
        nrm = np.sqrt((h * h).sum(axis=1))
        ok = nrm > 0
        h[ok] /= nrm[ok, None]
        flat = pa.array(h.astype(np.float32).reshape(-1))
        out_offs = pa.array(np.arange(n + 1, dtype=np.int32) * dim)
        null = ~ok | np.asarray(b.is_null(), dtype=bool)
        return pa.ListArray.from_arrays(out_offs, flat, mask=pa.array(null))
    return embed


def _embed_text_udf(dim: int):
    """Arrow-native embedder over raw text: RE2 lower/split in pyarrow, the
    batch's tokens dictionary-encoded so MD5 runs once per distinct token,
    then one ``bincount`` for the whole batch.  Same buckets as
    :func:`token_buckets` (checked bit-for-bit in the tests)."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pa.Array) -> pa.Array:
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        n = len(texts)
        toks = pc.split_pattern_regex(pc.utf8_lower(texts), ARROW_TOKEN_SPLIT)
        offs = toks.offsets.to_numpy()
        flat = toks.values[offs[0]:offs[-1]]
        row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offs))
        keep = pc.greater(pc.utf8_length(flat), 0).to_numpy(zero_copy_only=False).astype(bool)
        enc = pc.dictionary_encode(flat.filter(pa.array(keep)))
        bucket = np.fromiter((int(hashlib.md5(w.encode("utf-8")).hexdigest()[:8], 16) % dim
                              for w in enc.dictionary.to_pylist()), dtype=np.int64)
        idx = enc.indices.to_numpy(zero_copy_only=False)
        b = bucket[idx] if len(idx) else np.zeros(0, np.int64)
        h = np.bincount(row[keep] * dim + b, minlength=n * dim).reshape(n, dim).astype(np.float64)
        nrm = np.sqrt((h * h).sum(axis=1))
        ok = nrm > 0
        h[ok] /= nrm[ok, None]
        out_offs = pa.array(np.arange(n + 1, dtype=np.int32) * dim)
        null = ~ok | np.asarray(texts.is_null(), dtype=bool)
        return pa.ListArray.from_arrays(out_offs, pa.array(h.astype(np.float32).reshape(-1)), mask=pa.array(null))
    return embed


def hash_embed(text: Column | str, dim: int = HASH_DIM) -> Column:
    """L2-normalised token histogram over ``dim`` hashed buckets (null when the
    text has no token)."""
    return _embed_text_udf(dim)(_c(text))


def hash_embed_jvm(text: Column | str, dim: int = HASH_DIM) -> Column:
    """Same vectors with tokens hashed JVM-side (the SQL-expressible form)."""
    return _bincount_udf(dim)(token_buckets(text, dim))


class Embedder(Protocol):
    """Model back end: fixed ``dim`` and a batch call."""

    dim: int

    def embed_batch(self, texts: list[str]) -> np.ndarray: ...


def model_embed(text: Column | str, embedder_factory) -> Column:
    """Run a model embedder over Arrow batches.  ``embedder_factory`` is called
    once per task (model weights are loaded on the executor, never shipped
    from the driver); batch size follows
    ``spark.sql.execution.arrow.maxRecordsPerBatch``."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = embedder_factory()
        for s in batches:
            texts = [t if isinstance(t, str) else "" for t in s]
            vecs = np.asarray(model.embed_batch(texts), dtype=np.float32)
            yield pd.Series(list(vecs))

    return run(_c(text))


# ---------------------------------------------------------------------------
# Codecs
# ---------------------------------------------------------------------------


def decode_json_vector(col: Column | str) -> Column:
    """JSON text → ``array<double>``; null or malformed text gives null."""
    return F.from_json(_c(col), T.ArrayType(T.DoubleType()), {"mode": "PERMISSIVE"})


def encode_json_vector(col: Column | str) -> Column:
    return F.to_json(_c(col))


@F.pandas_udf(T.BinaryType())
def encode_f32_bytes(v: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else np.asarray(x, dtype=np.float32).tobytes() for x in v])


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_f32_bytes(b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else np.frombuffer(bytes(x), dtype=np.float32).copy() for x in b])


def valid_vectors(df: DataFrame, vec_col: str) -> DataFrame:
    """Drop null and empty vectors (they are skipped by every search)."""
    return df.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0))
