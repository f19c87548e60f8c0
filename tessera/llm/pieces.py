"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding follows the library: white space becomes U+2581, one is put in front,
and an agenda of adjacent symbol pairs gives the pair of the best score first
(the leftmost of equals).  No piece has a U+2581 after another character and
none joins letters with other characters, so a text falls into parts that never
merge with each other (checked when the vocabulary is read); parts are encoded once and kept in a cache of fixed size.  Every part
that enters the cache is compared, in one batch, with the library's own answer.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache
from hashlib import sha256
from itertools import repeat
from operator import add

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tessera.llm.common import TwoGenerationCache, arrow_map, in_parts, tokenizer_path

SPACE = "▁"
#: parts of one text that are held at a time
PART = 200_000
#: parts in a generation of the cache (two are held)
KEPT = 400_000
#: symbols up to which an agenda is a plain list: taking its least entry is one step of C
SHORT = 48
#: agenda entry of a pair that no piece joins
NEVER = float("inf")


class MergePieces:
    """Encoder and decoder of one ``.model`` file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        if spec.model_type != spec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces \
                or not norm.add_dummy_prefix or not norm.escape_whitespaces or spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with the identity normalizer and a leading space are read")
        kind = model.SentencePiece
        if any(p.type == kind.USER_DEFINED for p in model.pieces) or not spec.byte_fallback:
            raise ValueError("vocabularies with user-defined pieces or without byte pieces are not read")
        self.ids, self.scores = {}, {}
        self.byte_ids, self.raw = [0] * 256, []
        for i, p in enumerate(model.pieces):
            raw = b""
            if p.type == kind.NORMAL:
                self.ids[p.piece], self.scores[p.piece] = i, p.score
                raw = p.piece.replace(SPACE, " ").encode()
            elif p.type == kind.BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_ids[value] = i
                raw = bytes([value])
            elif p.type == kind.UNKNOWN:
                raw = spec.unk_surface.encode()
            self.raw.append(raw)
        self.end = self.library.eos_id()
        self.digits = [*map(str, range(len(self.raw)))]
        self.single = [*zip(self.digits, repeat(1), self.raw)]
        # letters that some piece joins with a non-letter count as non-letters
        letter, border = r"[^\W\d_]", set()
        for p in self.ids:
            border.update(*re.findall(f"({letter})(?=[^{SPACE}])(?!{letter})|(?<=[^{SPACE}])(?<!{letter})({letter})", p))
        odd = "".join(map(re.escape, sorted(border)))
        self.parts = re.compile(f"{SPACE}*[^\\W\\d_{odd}]+|{SPACE}*(?:[^\\w{SPACE}\n]|[\\d_{odd}])+|\n|{SPACE}+")
        if any(len(self.parts.findall(p)) > 1 for p in self.ids):
            raise ValueError("the vocabulary has pieces across parts")
        self.order = {p: -s for p, s in self.scores.items()}
        #: per part: its ids as text, how many they are, the bytes they decode to
        self.cache = TwoGenerationCache(lambda part: self.packed(self.merge(part)), KEPT)

    def packed(self, ids: list[int]) -> tuple[str, int, bytes]:
        if len(ids) == 1:
            return self.single[ids[0]]
        return " ".join([self.digits[i] for i in ids]), len(ids), b"".join([self.raw[i] for i in ids])

    def merge(self, part: str) -> list[int]:
        """Ids of one part, by the agenda."""
        symbols = self.joined(list(part)) if len(part) <= SHORT else self.joined_long(list(part))
        out = [*map(self.ids.get, symbols)]
        if None not in out:
            return out
        out = []
        for s in symbols:
            i = self.ids.get(s)
            if i is not None:
                out.append(i)
            else:
                out.extend(self.byte_ids[b] for b in s.encode())
        return out

    def joined(self, sym: list[str]) -> list[str]:
        """Symbols after all merges; the agenda lists the pairs in text order."""
        order = self.order.get
        agenda = [*map(order, map(add, sym, sym[1:]), repeat(NEVER))]
        while agenda and (best := min(agenda)) != NEVER:
            i = agenda.index(best)  # the leftmost of equals
            made = sym[i] = sym[i] + sym.pop(i + 1)
            del agenda[i]
            if i:
                agenda[i - 1] = order(sym[i - 1] + made, NEVER)
            if i < len(agenda):
                agenda[i] = order(made + sym[i + 1], NEVER)
        return sym

    def joined_long(self, sym: list[str]) -> list[str]:
        """The same with a heap, for many symbols."""
        scores = self.scores
        n = len(sym)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        agenda = []
        for i in range(n - 1):
            s = scores.get(sym[i] + sym[i + 1])
            if s is not None:
                agenda.append((-s, i, sym[i] + sym[i + 1]))
        heapq.heapify(agenda)
        while agenda:
            _, i, made = heapq.heappop(agenda)
            j = after[i]
            if j < 0 or not sym[i] or len(sym[i]) + len(sym[j]) != len(made) or sym[i] + sym[j] != made:
                continue  # one of the two symbols has changed since
            sym[i], sym[j] = made, ""
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                s = scores.get(made + sym[k])
                if s is not None:
                    heapq.heappush(agenda, (-s, i, made + sym[k]))
            h = before[i]
            if h >= 0:
                s = scores.get(sym[h] + made)
                if s is not None:
                    heapq.heappush(agenda, (-s, h, sym[h] + made))
        return [s for s in sym if s]

    def learn(self, parts: set[str]) -> None:
        """Encode parts that are not in the cache, compare them with the library,
        and keep them.  The library puts its own space in front: a line end
        shields parts that have none."""
        new = list(parts.difference(self.cache, self.cache.old))
        if not new:
            return
        plain = self.library.encode([p[1:].replace(SPACE, " ") if p[0] == SPACE and len(p) > 1 else "\n" + p.replace(SPACE, " ")
                                     for p in new], num_threads=1)
        lead = [self.ids[SPACE], self.byte_ids[10]]
        for p, theirs in zip(new, plain, strict=True):
            ids = self.merge(p)
            mine = [*ids] if p[0] == SPACE and len(p) > 1 else [*lead, *ids]
            if mine != theirs:
                raise AssertionError(f"encoding of {p!r}: {mine} here, {theirs} in the library")
            self.cache.put(p, self.packed(ids))

    def packs(self, text: str):
        """What the cache keeps of each part of a text, in order."""
        spaced = SPACE + text.replace(" ", SPACE) if text else ""
        for found in in_parts((m.group() for m in self.parts.finditer(spaced)), PART):
            self.learn(set(found))
            yield from map(self.cache.__getitem__, found)

    def encode(self, text: str) -> list[int]:
        """All ids of a text, without begin or end."""
        return [int(i) for ids, _, _ in self.packs(text) for i in ids.split()]

    def encode_batch(self, texts: list[str]):
        """Ids of each text."""
        for packs in self.packs_batch(texts):
            yield [int(i) for ids, _, _ in packs for i in ids.split()]

    def packs_batch(self, texts: list[str]):
        """``packs`` of each text; new parts of the batch are checked together."""
        found = [self.parts.findall(SPACE + t.replace(" ", SPACE)) if t and len(t) < PART else None for t in texts]
        self.learn(set().union(*(f for f in found if f)))
        for t, f in zip(texts, found, strict=True):
            yield list(self.packs(t)) if f is None else list(map(self.cache.__getitem__, f))

    def decoded(self, ids: tuple[str, ...], raw: tuple[bytes, ...]) -> bytes:
        """``decode`` of the ids of parts, in UTF-8."""
        out = b"".join(raw)
        if out[:1] == b" " and ids[0].split(" ", 1)[0] != str(self.byte_ids[32]):
            out = out[1:]
        return out.decode("utf-8", errors="replace").encode()

    def decode(self, ids: list[int]) -> str:
        """Text of ids; control ids vanish, as does the space put in front."""
        raw = self.raw
        first = next((i for i in ids if raw[i]), None)
        out = b"".join([raw[i] for i in ids])
        if first is not None and out[:1] == b" " and self.byte_ids[32] != first:
            out = out[1:]
        return out.decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def model(name: str) -> MergePieces:
    return MergePieces(tokenizer_path(name))


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     vocabulary: str = "piece_bpe_32k.model", with_ids: bool = False) -> DataFrame:
    """Per row: id, ``n_tokens`` (all ids, the end id included), ``ids_sha256``
    (decimal ids joined by one space), ``decoded_sha256`` (text of the ids),
    ``round_trip`` (the decoded text equals the text) and, if ``with_ids``,
    ``ids``.  No shuffle; memory per task is one Arrow batch plus a cache of
    fixed size.  Vocabularies without byte pieces are refused.

    Null and empty text: the end id alone, decoded as the empty text
    (``round_trip`` is true).  A null id stays null; repeated rows stay
    repeated; an empty table gives an empty result; other columns are not read.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        m = model(vocabulary)
        texts = pc.fill_null(b.column(1).cast(pa.string()), "").to_pylist()
        n, ids_sha, text_sha, same, kept = [], [], [], [], []
        for text, packs in zip(texts, m.packs_batch(texts), strict=True):
            parts, counts, raw = zip(*packs, strict=True) if packs else ((), (), ())
            ids = " ".join([*parts, str(m.end)])
            back = m.decoded(parts, raw)
            n.append(sum(counts) + 1)
            ids_sha.append(sha256(ids.encode()).hexdigest())
            text_sha.append(sha256(back).hexdigest())
            same.append(back == text.encode())
            if with_ids:
                kept.append([int(i) for i in ids.split()])
        cols = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()),
                pa.array(text_sha, pa.string()), pa.array(same, pa.bool_())]
        names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
        if with_ids:
            cols.append(pa.array(kept, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(cols, names)

    schema = f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    return df.select(id_col, text_col).mapInArrow(arrow_map(batch, 256), schema + ", ids array<int>" * with_ids)
