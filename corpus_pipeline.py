"""A training-data pipeline over the table ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``.  All stages but
the last return the columns of their ``docs``; decisions show in the rows and
texts that go on.  Columns are numbered while an operator works, so columns of
any name pass through.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, staged
from tessera.llm.language import identify
from tessera.llm.mixing import mix
from tessera.llm.neardup import near_duplicates
from tessera.llm.pieces import encode_documents
from tessera.llm.substring import remove_repeats
from tessera.session import configure



def _stage(fn):
    """A stage applies the session defaults and ships the package first, so it
    also works when it is called on its own."""
    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return fn(configure(spark), docs, sf_dir)

    return run_stage


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns renamed to ``c0``, ``c1``, …, and their names."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language go on; texts without a letter (``und``) are
    rejected.  A text of several languages goes on, however equal their parts,
    and where no language could be learned every text with a letter does."""
    rows, names = _numbered(docs)
    id_col = names["doc_id"]
    found = identify(rows, id_col, names["text"], names["lang"], keep=[c for c in rows.columns if c != id_col])
    return found.where((F.col("lang_pred") != "und") | F.col(names["text"]).rlike(r"\p{L}")) \
        .select(*(F.col(n).alias(c) for c, n in names.items()))


@_stage
def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group goes on; documents without
    an id are in no group."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].cast("bigint").eqNullSafe(kept["kept_id"]), "left_semi")


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has leave the texts; every
    document goes on, ``n_chars`` follows its text."""
    rows, names = _numbered(docs)
    cut = remove_repeats(rows, names["doc_id"], names["text"], with_text=True, keep=[n for c, n in names.items() if c != "text"])

    def column(c: str):
        if c == "text":
            return F.col("kept_text").alias(c)
        own = F.col(f"rest.{names[c]}")
        if c == "n_chars":
            own = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema[c].dataType)).otherwise(own)
        return own.alias(c)

    return cut.select(*map(column, docs.columns))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mix; sources below their target share are
    read again, so the shares of the output are the targets."""
    rows, names = _numbered(docs)
    placed = mix(rows, names["doc_id"], names["source"], in_order=True)
    return placed.select(*(F.col(n).alias(c) for c, n in names.items()))


@_stage
def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids (as a digest) and decoded text of every document of the mix."""
    return encode_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicate_groups),
    ("repeated_passages", repeated_passages),
    ("mix_sources", mix_sources),
    ("sentencepiece", sentencepiece),
]

#: The stages train, sketch and tokenize: SQL can't express their rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
