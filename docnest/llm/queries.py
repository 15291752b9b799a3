"""One query per operator over the whole sample tables: the operator's result in the columns agreed for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docnest.llm import (
    fingerprints,
    html_text,
    language_id,
    manifest,
    mixing,
    neardup,
    packing,
    quality,
    secret_scan,
    sharding,
    toxicity,
    url_rules,
    vector_codes,
)
from docnest.llm.frames import stored, table

SHARDS = 40


def fold(n: int) -> Column:
    """The fold of a document: checksum of its printed id modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 40 shards of near equal bytes."""
    placed = sharding.shard(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two thirds of them."""
    held = fold(3) == 1
    found = language_id.identify(table(spark, sf_dir, "documents"), ~held)
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shingle count and the component of its near copies."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from three quarters of the labels."""
    held = fold(4) == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), ~held)
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.TOXIC).cast("int").alias("predicted")
    )


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every document and of its edited text."""
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    mix = mixing.mix(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents")).drop("ids")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    rows = quality.quality(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "level"
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of every vector, its error and its label's."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = vector_codes.fit(vectors)
    if books is None:
        none = vectors.where("false").select("vec_id", F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")])
        return none.withColumn("codebooks_sha256", F.lit(""))
    coded = vector_codes.with_group_error(stored(vector_codes.encode(vectors, books), "codes"), "label", "label_error")
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in the hash tree of its source and the root over all."""
    return manifest.manifest(table(spark, sf_dir, "documents"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rule judges the URL of every page, and how."""
    judged = url_rules.judge(table(spark, sf_dir, "pages"), url_rules.production_rules(spark))
    return judged.select("page_id", "host", "path", F.when(F.col("rank") == 1, F.col("rule")).alias("rule"), "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_sharding, op2_language, op3_neardup, op4_toxicity, op5_html, op6_fingerprints, op7_mixing, op8_packing, op9_secrets,
        op10_quality, op11_vector_codes, op12_manifest, op13_url_filter,
    )
}
