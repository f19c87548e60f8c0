"""Language identification by a mixture of languages.

A document's letter trigrams are drawn from a mixture of the learned
languages' trigram distributions.  Expectation-maximisation estimates the
proportions over all languages; nested sets of the leading languages are then
fitted, and the set of the best penalised likelihood is kept.  The prediction
is the language with the largest proportion, which is also the score.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map

#: trigram hash buckets (2 ** BITS)
BITS = 15
#: rows featurised together
ROWS = 256
#: characters of one text that are featurised at a time
PART = 2_000_000
#: overlapping trigrams repeat evidence; the penalty is scaled by their order
PENALTY = 3.0
STEPS = 25


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((not 0xD800 <= i < 0xE000 and chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(text: str) -> np.ndarray:
    """Bucket of the trigram around each letter of a text; anything that is not
    a letter counts as one space."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    c = np.where(letter, code, 0)[keep].astype(np.uint32)
    mid = np.flatnonzero(c)
    if len(mid) == 0:
        return np.zeros(0, np.int32)
    c = np.r_[c, np.uint32(0)]
    h = c[mid - 1] * np.uint32(0x9E3779B1) ^ c[mid] * np.uint32(0x85EBCA6B) ^ c[mid + 1] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - BITS)).astype(np.int32)


def bucket_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their counts.  Long texts are taken in
    parts that are cut at white space, so no trigram is changed or lost."""
    if len(text) <= PART:
        return np.unique(trigrams(text), return_counts=True)
    total, at = np.zeros(1 << BITS, np.int64), 0
    while at < len(text):
        space = re.compile(r"\s").search(text, min(at + PART, len(text)))
        end = space.start() if space else len(text)
        total += np.bincount(trigrams(text[at:end]), minlength=1 << BITS)
        at = end
    found = np.flatnonzero(total)
    return found.astype(np.int32), total[found]


def _learned(id_col: str):
    return F.crc32(F.col(id_col).cast("string")) % 4 != 2


def learn(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram probabilities (languages x buckets), from
    every row with a language whose id's CRC-32 modulo 4 is not 2.  Each task
    adds up its own rows, so at most languages x buckets numbers per task are
    shuffled; the sum, of a size that does not depend on the rows, comes to the
    driver."""
    def count(batches):
        sums: dict[str, np.ndarray] = {}

        def flush():
            for lang, c in sums.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at])],
                                                 ["lang", "bucket", "n"])
            sums.clear()

        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at, n = bucket_counts(text)
                if len(at):
                    sums.setdefault(lang, np.zeros(1 << BITS, np.int64))[at] += n
                if len(sums) >= 256:
                    yield from flush()
        yield from flush()

    known = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & _learned(id_col))
    rows = known.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")) \
        .mapInArrow(count, "lang string, bucket int, n long") \
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(rows.column("lang").to_pylist()))
    counts = np.zeros((len(langs), 1 << BITS))
    if langs:
        row = pc.index_in(rows.column("lang").combine_chunks(), pa.array(langs)).to_numpy(zero_copy_only=False)
        counts[row, rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    counts += 0.1
    return langs, (counts / counts.sum(1, keepdims=True)).astype(np.float32) if langs else counts


def _fit(p: np.ndarray, c: np.ndarray, starts: np.ndarray, doc: np.ndarray, total: np.ndarray, pi: np.ndarray):
    """EM from ``pi`` (languages x documents); zero proportions stay zero.
    Returns the proportions and each document's log likelihood."""
    for _ in range(STEPS):
        r = c / np.einsum("ij,ij->j", pi[:, doc], p)
        new = pi * np.add.reduceat(p * r, starts, axis=1) / total
        done = np.abs(new - pi).max() < 1e-4
        pi = new
        if done:
            break
    return pi, np.add.reduceat(c * np.log(np.einsum("ij,ij->j", pi[:, doc], p)), starts)


def proportions(texts: list[str], model: np.ndarray) -> np.ndarray:
    """Languages x texts: the selected mixture of each text (zeros if it has no letter)."""
    out = np.zeros((len(model), len(texts)))
    found = [bucket_counts(t) if t else (np.zeros(0, np.int32),) * 2 for t in texts]
    some = np.array([i for i, f in enumerate(found) if len(f[0])], np.int64)
    if not len(some) or not len(model):
        return out
    lens = np.array([len(found[i][0]) for i in some])
    p = model[:, np.concatenate([found[i][0] for i in some])].astype(np.float64)
    c = np.concatenate([found[i][1] for i in some]).astype(np.float64)
    starts, doc = np.r_[0, np.cumsum(lens)[:-1]], np.repeat(np.arange(len(some)), lens)
    total = np.add.reduceat(c, starts)
    langs, docs = len(model), len(some)
    single = np.add.reduceat(c * np.log(p), starts, axis=1)
    best = np.zeros((langs, docs))
    best[single.argmax(0), np.arange(docs)] = 1
    value = single.max(0)
    if langs > 1:
        full, _ = _fit(p, c, starts, doc, total, np.full((langs, docs), 1 / langs))
        order = np.argsort(-full, axis=0, kind="stable")
        active = np.arange(docs)
        for m in range(2, langs + 1):
            use = np.isin(doc, active)
            pos = np.full(docs, -1)
            pos[active] = np.arange(len(active))
            pi = np.zeros((langs, len(active)))
            rows = order[:m, active]
            np.put_along_axis(pi, rows, np.maximum(np.take_along_axis(full[:, active], rows, 0), 1e-6), 0)
            pi /= pi.sum(0)
            n = lens[active]
            pi, ll = _fit(p[:, use], c[use], np.r_[0, np.cumsum(n)[:-1]], pos[doc[use]], total[active], pi)
            ll -= PENALTY * (m - 1) * np.log(total[active] + 1)
            better = ll > value[active]
            value[active[better]], best[:, active[better]] = ll[better], pi[:, better]
            active = active[better]
            if not len(active):
                break
    out[:, some] = best
    return out


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             keep: list[str] | None = None) -> DataFrame:
    """Per row: id, ``held_out`` (the CRC-32 of the id as text is 2 modulo 4),
    ``lang_pred`` and ``score`` (the proportion of that language, 0 to 1); with
    ``keep``, those columns of ``df`` too.

    Languages are learned from rows that are not held out (see ``learn``) and
    predicted from the text alone.  Null text, text without a letter, and any
    text when nothing could be learned give ``und`` with score 0.  A null id is
    neither learned from nor held out.  Equal proportions go to the language
    that sorts first.  Repeated rows stay repeated; an empty table gives an
    empty result; other columns are not read.
    """
    langs, model = learn(df, id_col, text_col, lang_col)
    shared = df.sparkSession.sparkContext.broadcast((langs, model))
    keep = keep or []

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        names, m = shared.value
        pi = proportions(b.column(text_at).to_pylist(), m)
        n = b.num_rows
        top = pi.argmax(0) if len(names) else np.zeros(n, int)
        score = pi[top, np.arange(n)] if len(names) else np.zeros(n)
        pred = [names[k] if s > 0 else "und" for k, s in zip(top, score, strict=True)]
        cols = [b.column(i) for i in range(len(kept.fields))]
        return pa.RecordBatch.from_arrays([*cols, pa.array(pred, pa.string()), pa.array(np.minimum(score, 1.0))], schema.names)

    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
    out = df.select(id_col, *keep, held.alias("held_out"))
    kept = out.schema
    if text_col in keep:
        rows, text_at = out, 1 + keep.index(text_col)
    else:
        rows, text_at = df.select(id_col, *keep, held.alias("held_out"), F.col(text_col).alias("lang_text")), len(kept.fields)
    schema = type(kept)(list(kept.fields)).add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(arrow_map(batch, ROWS), schema)
