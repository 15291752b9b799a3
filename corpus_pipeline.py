"""From raw documents to packed sequences: five stages, each written as Parquet and read by the next.

Every stage works on all rows the one before has kept; all but the last return the columns of ``documents``.

1. language ID: rows without a word in any language of the corpus (no letters, or nothing to learn from) go; texts that switch stay;
2. near-dedup: of every group of near copies one document stays;
3. secret scan: every row stays, secrets in it become a mark, ``n_chars`` follows;
4. mixing: documents are repeated or left out so that the sources get their weights;
5. packing: pieces of documents, their token ids and their places in windows of 1024 tokens.

Nulls in any column pass through. Null and empty texts have no letters and go in the first stage; a table of them, or an empty one, gives no
rows. Very long texts are read whole by every stage. Repeated rows are near copies: one stays, the first of those with the
smallest id (ties in anything but the text are broken by the place in the file). Further columns of any name stay up to the packing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docnest.llm import language_id, mixing, neardup, packing, secret_scan
from docnest.llm.frames import discard, stored, table


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a language of the corpus; the model learns from the rows that say theirs."""
    model = language_id.fit(docs.select("doc_id", "text", "lang"), F.lit(True))
    found = language_id.labelled(docs, model)
    return found.where(F.col("lang_pred") != language_id.UNKNOWN).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near copies."""
    return neardup.deduplicated(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, its secrets replaced by a mark."""
    clean = secret_scan.without_secrets(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every row and their places in sequences."""
    return packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_languages),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Models, signatures and a tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = stored(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
