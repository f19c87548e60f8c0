"""Token counts with a byte-level BPE vocabulary.

Pre-tokens of a batch are held as one flat symbol array plus sequence starts
(a ragged array).  In each step every sequence applies its lowest-rank pair at
all its places at once; a sequence without a mergeable pair leaves the array,
and the symbols it still has are its tokens.  A merge only makes pairs of a
higher rank, so applying equal ranks together gives what one-by-one merging
gives.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tessera.llm.common import TwoGenerationCache, arrow_map, in_parts, tokenizer_path

NONE = np.iinfo(np.int64).max
#: pre-tokens of one text that are held at a time
PART = 200_000


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable
    Latin-1 bytes stand for themselves, the others for code points from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ByteBpe:
    """Counts of one vocabulary file (``tokenizers`` JSON, byte-level BPE)."""

    def __init__(self, path: str):
        import public_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        self.size = max(vocab.values()) + 1
        self.of_byte = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.cache = TwoGenerationCache(lambda w: int(self.surviving([w.encode()])[0]))

    def pair_ranks(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)

    def surviving(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each non-empty byte string after all merges."""
        out = np.zeros(len(words), np.int64)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        seq = np.repeat(np.arange(len(words)), lens)
        sym = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            rank = np.full(len(sym), NONE, np.int64)
            inner = np.flatnonzero(seq[1:] == seq[:-1])
            rank[inner] = self.pair_ranks(sym[inner] * self.size + sym[inner + 1])
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(sym)])
            over = lowest == NONE
            out[seq[starts[over]]] = sizes[over]
            at = np.flatnonzero((rank == np.repeat(lowest, sizes)) & (rank != NONE))
            # a run of overlapping places (one letter repeated) merges every second one
            first = np.r_[True, np.diff(at) != 1] if len(at) else np.zeros(0, bool)
            run_start = at[first][np.cumsum(first) - 1]
            at = at[(at - run_start) % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.repeat(~over, sizes)
            keep[at + 1] = False
            sym, seq = sym[keep], seq[keep]
        return out

    def pieces_of(self, text: str):
        """(text between special strings, number of special strings)"""
        if self.special is None:
            return [text], 0
        parts = self.special.split(text)
        return [p for p in parts if p], len(parts) - 1

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        pending, held = [], 0
        for i, text in enumerate(texts):
            parts, out[i] = self.pieces_of(text)
            for p in parts:
                for words in in_parts((m.group() for m in self.pattern.finditer(p)), PART) if len(p) > PART else (self.pattern.findall(p),):
                    pending.append((i, words))
                    held += len(words)
                    if held >= PART:
                        self._add(pending, out)
                        pending, held = [], 0
        self._add(pending, out)
        return out

    def _add(self, pending, out) -> None:
        cache = self.cache
        new = [w for w in set().union(*(w for _, w in pending)) if not cache.known(w)] if pending else []
        if new:
            for w, n in zip(new, self.surviving([w.encode() for w in new]).tolist(), strict=True):
                cache.put(w, n)
        for i, words in pending:
            out[i] += sum(map(cache.__getitem__, words))


@lru_cache(maxsize=2)
def bpe(name: str) -> ByteBpe:
    return ByteBpe(tokenizer_path(name))


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 vocabulary: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """Per row: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``
    (``n_tokens > limit``).  No shuffle; memory per task is bounded by one text
    plus a cache of fixed size.

    Null and empty text: 0 bytes, 0 tokens, not over the limit.  A null id stays
    null; repeated rows stay repeated; an empty table gives an empty result;
    other columns are not read, whatever their names.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        text = pc.fill_null(b.column(1).cast(pa.string()), "")
        n = np.array(bpe(vocabulary).counts(text.to_pylist()), np.int64)
        size = pc.binary_length(text).cast(pa.int64())
        return pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n), pa.array(n > limit)],
                                          [id_col, "n_bytes", "n_tokens", "over_limit"])

    return df.select(id_col, text_col).mapInArrow(
        arrow_map(batch, 512), f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
