"""Document fingerprints: bottom-k sketches of word shingles.

The sketch of a text is the ``k`` smallest distinct 64-bit hashes of its runs of five words (of all its words if they are
fewer). Sketches of parts merge into the sketch of the whole, and estimate resemblance, containment and
the number of distinct shingles. All expressions are Spark's own.

Defined results: null and empty texts, and texts of white space, have the empty sketch; two empty sketches are alike (1),
an empty and another one are not (0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docnest.llm.frames import stored, words_of

K = 64
WIDTH = 5


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """array<bigint>, ascending."""

    def shingles(words: Column) -> Column:
        hashes = F.transform(words, lambda w: F.xxhash64(w))
        run = lambda h: lambda i: F.xxhash64(*[F.get(h, i + n) for n in range(width)])
        many = F.transform(F.array(hashes), lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - width), run(h)))[0]
        few = F.when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(words) >= width, many).otherwise(few)

    # the one-element array binds the words to a name, so they are split once
    every = F.transform(F.array(words_of(text)), shingles)[0]
    return F.slice(F.sort_array(F.array_distinct(every)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(rows: DataFrame, group: str, sketches: str, k: int = K) -> DataFrame:
    """``group``, ``sketches``: one sketch per group. Each of some random lanes keeps k hashes, then the lanes merge, so no task
    holds more than k hashes a lane of a group."""
    one = rows.select(F.col(group), F.explode(sketches).alias("h"), F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(32)).alias("lane")).distinct()
    part = W.partitionBy(group, "lane").orderBy("h")
    least = one.withColumn("n", F.row_number().over(part)).where(F.col("n") <= k)
    return least.groupBy(group).agg(F.slice(F.sort_array(F.collect_set("h")), 1, k).alias(sketches))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of shared shingles over all shingles of both texts."""
    least = merge(a, b, k)
    both = F.transform(F.array(least), lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))[0]
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(F.coalesce(both, F.lit(0.0)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles; exact below k."""
    span = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / span)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the part of a's shingles that b has too."""
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def printed(a: Column) -> Column:
    """The sketch as text: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


#: Quantiles of the ids that bound the coarse ranges, and documents a fine range should hold.
COARSE = 128
RANGE_ROWS = 20_000


def _ranged(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, text and ``range``, which grows with the id (null ids lowest); and the ranges that occur.

    Coarse ranges come from approximate quantiles (at most COARSE numbers reach the driver), each cut
    into equal widths so that a range has about RANGE_ROWS documents.
    """
    share = [i / COARSE for i in range(COARSE + 1)]
    found = docs.agg(F.percentile_approx("doc_id", share, 10_000).alias("q"), F.count("*").alias("n")).first()
    bounds = sorted(set(found["q"] or [0]))
    fine = max(1, -(-found["n"] // (RANGE_ROWS * COARSE)))
    steps = F.array(*[F.lit(int(b)).cast("long") for b in bounds])
    coarse = F.greatest(F.size(F.filter(steps, lambda b: b <= F.col("doc_id"))), F.lit(1))
    low, high = F.element_at(steps, coarse), F.element_at(steps, F.least(coarse + 1, F.lit(len(bounds))))
    within = F.least(F.greatest(F.floor((F.col("doc_id") - low) / F.greatest(high - low, F.lit(1)) * fine), F.lit(0)), F.lit(fine - 1))
    number = F.coalesce(coarse.cast("long") * fine + within if fine > 1 else coarse.cast("long"), F.lit(-1))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), number.alias("range"))
    return rows, stored(rows.groupBy("range").agg(F.max("doc_id").alias("top")).coalesce(1), "ranges")


def with_next(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, text, sketch, next_text, next_sketch: the next document in descending id, the first after the last.

    Ids are dealt out by ranges; each range also gets a copy of the first document of the range below it, so the
    neighbour of every row is in its own range. Rows of one id follow by text, null ids come last.
    """
    rows, ranges = _ranged(docs)
    rows = rows.withColumn("sketch", sketch(F.col("text"), k))
    # one row per range: RANGE_ROWS times fewer than documents
    above = F.coalesce(F.lead("range").over(W.orderBy("range")), F.first("range").over(W.orderBy("range")))
    ranges = ranges.select("range", "top", above.alias("reader"))
    heads = rows.join(ranges, (rows["range"] == ranges["range"]) & rows["doc_id"].eqNullSafe(ranges["top"]))
    heads = heads.groupBy("reader").agg(F.min(F.struct("text", "sketch")).alias("head"))
    guards = heads.select(
        F.lit(None).cast("long").alias("doc_id"), F.col("head.text").alias("text"), F.col("reader").alias("range"),
        F.col("head.sketch").alias("sketch"), F.lit(1).alias("guard"),
    )
    order = W.partitionBy("range").orderBy("guard", F.col("doc_id").desc_nulls_last(), "text")
    both = rows.withColumn("guard", F.lit(0)).unionByName(guards)
    return both.select(
        "doc_id", "text", "sketch", "guard", F.lead("text").over(order).alias("next_text"), F.lead("sketch").over(order).alias("next_sketch")
    ).where("guard = 0").drop("guard")


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars, the sketch of the text and of its edited text, and what they say about each other.

    The edited text has the last third of its characters replaced by as many (or all) of the next document's first ones.
    """
    near = with_next(docs, k)
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.substring("next_text", 1, third))
    near = near.withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited"), k))
    return near.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("sketch")).alias("fingerprint"),
        printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("n_shingles_estimate"),
        containment(F.col("sketch"), F.col("edited_sketch"), k).alias("kept_estimate"),
    )
