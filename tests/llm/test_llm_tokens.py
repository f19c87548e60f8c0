import hashlib

import pytest

from tessera.llm.pieces import MergePieces, encode_documents, model
from tessera.llm.tokens import bpe, count_tokens

P = pytest.importorskip("public_tokenizers")

ODD = ["", " ", "  a", "\n\n x \t y", "<|endoftext|>a<|endoftext|>", "aaaaaaaaa" * 50, "x'll we've  DON'T", "日本語🙂 ▁▁ a", "<s> </s> <0x41>",
       "   z", "a\x00b", "  \n  ", "é" * 1000, "1234 56\r\n7", "²5 x². m²", " 　 x", "ab" * 3 + "‍"]


def test_counts_equal_the_library():
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode_batch(ODD, add_special_tokens=False)
    assert bpe("byte_bpe_50k.json").counts(ODD) == [len(t.ids) for t in theirs]


def test_long_texts_are_counted_in_parts(monkeypatch):
    from tessera.llm import tokens

    text = "some words, and <|endoftext|> more of them " * 200
    whole = bpe("byte_bpe_50k.json").counts([text])
    monkeypatch.setattr(tokens, "PART", 50)
    assert bpe("byte_bpe_50k.json").counts([text]) == whole


def test_count_tokens_of_messy_rows(messy, messy_rows, nothing):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = sorted(map(tuple, count_tokens(messy).collect()), key=str)
    want = []
    for i, t, *_ in messy_rows:
        t = t or ""
        n = len(lib.encode(t, add_special_tokens=False).ids)
        want.append((i, len(t.encode()), n, n > 1024))
    assert got == sorted(want, key=str)
    assert count_tokens(nothing).count() == 0


def test_ids_and_text_equal_the_library():
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    m = model("piece_bpe_32k.model")
    for text, ids in zip(ODD, m.encode_batch(ODD), strict=True):
        assert ids == lib.encode(text), text
        assert m.decode(ids + [m.end]) == lib.decode(ids + [m.end])


def test_a_disagreement_with_the_library_is_an_error(monkeypatch):
    m = MergePieces(P.path("piece_bpe_32k.model"))
    monkeypatch.setattr(m, "merge", lambda part: (5,))
    with pytest.raises(AssertionError):
        list(m.encode_batch(["some text"]))


def test_encode_documents_of_messy_rows(messy, messy_rows, nothing):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = sorted((tuple(r)[:4] for r in encode_documents(messy).collect()), key=str)
    want = []
    for i, t, *_ in messy_rows:
        ids = lib.encode(t or "") + [lib.eos_id()]
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids))))
    assert got == sorted(want, key=str)
    assert encode_documents(nothing, with_ids=True).count() == 0


def test_parts_in_the_cache_outlast_many_new_ones(monkeypatch):
    from tessera.llm import pieces

    m = pieces.MergePieces(pieces.tokenizer_path("piece_bpe_32k.model"))
    ids = m.encode("kept part")
    for i in range(450_000):
        m.cache.put(i, m.single[0])
    monkeypatch.setattr(m, "merge", lambda part: pytest.fail(f"{part!r} is encoded again"))
    assert m.encode("kept part") == ids == m.library.encode("kept part")
    assert m.packed(ids) == (" ".join(map(str, ids)), len(ids), b" kept part")
