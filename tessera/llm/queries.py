"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontam, mixing, neardup, phrases, substring, topk, warc
from tessera.llm.common import documents
from tessera.llm.extract import extract
from tessera.llm.fingerprint import fingerprints
from tessera.llm.language import identify
from tessera.llm.pieces import encode_documents
from tessera.llm.repair import repair_damaged
from tessera.llm.tokens import count_tokens
from tessera.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


@query("op1_mix_sources", mixing.SQL)
def op1_mix_sources(spark, sf_dir):
    """Every document at its slots in a mix of all sources."""
    return mixing.mix(documents(spark, sf_dir).select("doc_id", "source"))


@query("op2_token_counts")
def op2_token_counts(spark, sf_dir):
    """Byte-level BPE token counts of every whole text."""
    return count_tokens(documents(spark, sf_dir))


@query("op3_sentencepiece")
def op3_sentencepiece(spark, sf_dir):
    """SentencePiece ids (as a digest) and decoded text of every whole text."""
    return encode_documents(documents(spark, sf_dir))


@query("op4_fingerprints")
def op4_fingerprints(spark, sf_dir):
    """Bottom-k sketches of every whole text and of its edited text."""
    return fingerprints(documents(spark, sf_dir))


@query("op5_top_k", topk.SQL)
def op5_top_k(spark, sf_dir):
    """Five best inner products of every fiftieth vector among all others."""
    e = load(spark, sf_dir, "embeddings")
    return topk.top_k(e, e.where("vec_id % 50 = 0"), 5)


@query("op6_warc", warc.SQL)
def op6_warc(spark, sf_dir):
    """Every page as a WARC record, read back from normalised archives."""
    return warc.round_trip(load(spark, sf_dir, "pages")).drop("target_uri")


@query("op7_language_id")
def op7_language_id(spark, sf_dir):
    """Language of every whole text, learned from the rows that are not held out."""
    return identify(documents(spark, sf_dir))


@query("op8_main_text")
def op8_main_text(spark, sf_dir):
    """Main text of every whole page."""
    return extract(load(spark, sf_dir, "pages"))


@query("op9_repeated_passages", substring.SQL)
def op9_repeated_passages(spark, sf_dir):
    """Words of every whole text that are left when repeated passages go."""
    return substring.remove_repeats(documents(spark, sf_dir))


@query("op10_near_duplicates", neardup.SQL)
def op10_near_duplicates(spark, sf_dir):
    """Near-duplicate components of all whole texts."""
    return neardup.near_duplicates(documents(spark, sf_dir))


@query("op11_decontaminate", decontam.SQL)
def op11_decontaminate(spark, sf_dir):
    """Words of every whole text that stand in passages of benchmark items."""
    return decontam.contamination(documents(spark, sf_dir), load(spark, sf_dir, "benchmark"))


@query("op12_conversation_repair")
def op12_conversation_repair(spark, sf_dir):
    """Every conversation, damaged and then repaired at the least cost."""
    return repair_damaged(load(spark, sf_dir, "conversations"))


@query("op13_collocations", phrases.SQL)
def op13_collocations(spark, sf_dir):
    """Best phrases of two and three words of each language, over all whole texts."""
    return phrases.collocations(documents(spark, sf_dir))
