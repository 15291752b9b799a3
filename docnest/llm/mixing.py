"""Mixing sources to target weights by hash thresholds.

Sizes are added up by source and by the leading bits of a hash of the id. The cumulated histogram names the one
bucket in which a source's budget ends; only that bucket is looked at again by the next bits, until single hash values
are left. Everything under the threshold is taken, so nothing is sorted, and a smaller budget takes a subset of
what a larger one takes.

Defined results: a null text has no words, a null source is a source of its own, last in order; a null id hashes by
its text. Rows with one id are taken or left together. Without any words every target is 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docnest.llm.frames import stored, words_of

#: Bits of the hash, and how many of them one pass refines.
HASH_BITS = 48
STEP = 12


def _hashes() -> list[Column]:
    """source_key (sorts by code point, null last), size and hash of a document."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.coalesce("text", F.lit(""))))
    digits = F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4)
    return [
        F.coalesce(F.concat(F.lit("a"), F.col("source")), F.lit("b")).alias("source_key"),
        F.size(words_of(F.col("text"))).cast("long").alias("size"),
        F.conv(digits, 16, 10).cast("long").alias("hash"),
    ]


def _bucket(level: int) -> Column:
    return F.shiftright(F.col("hash"), HASH_BITS - STEP * level)


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """source_key, source_size, target from one row per source.

    A source stops at ``most`` times its size, and what is too much goes to the others by weight. Ordered by
    size per weight, the sources that stop are a prefix, so one pass over the sources (not the rows) settles it.
    """
    order = W.orderBy("source_key")
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.select("source_key", "source_size", cycle.alias("weight"), (F.col("source_size") * most).alias("cap"))
    ranked = ranked.withColumn("level", F.col("cap") / F.col("weight"))
    upto = W.orderBy("level", "source_key").rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.partitionBy()
    filled = (
        ranked.withColumn("capped", F.sum("cap").over(upto))
        .withColumn("open", F.sum("weight").over(every) - F.sum("weight").over(upto))
        .withColumn("total", F.sum("source_size").over(every) * share)
        .withColumn("stops", F.col("capped") + F.col("level") * F.col("open") <= F.col("total"))
    )
    stopped = F.sum(F.when(F.col("stops"), F.col("cap")).otherwise(0.0)).over(every)
    open_weight = F.sum(F.when(F.col("stops"), 0.0).otherwise(F.col("weight"))).over(every)
    level = (F.col("total") - stopped) / open_weight
    return filled.select(
        "source_key", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(level * F.col("weight")).alias("target")
    )


def thresholds(rows: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """source_key, source_size, target, rounds, threshold: a row is taken ``rounds`` times, and once more if its hash is under the threshold."""
    first = stored(rows.groupBy("source_key", _bucket(1).alias("bucket")).agg(F.sum("size").alias("words")), "mix-histogram")
    sizes = first.groupBy("source_key").agg(F.sum("words").alias("source_size"))
    goal = targets(sizes, weights, share, most)
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = goal.select(
        "*", rounds.alias("rounds"), (F.col("target") - rounds * F.col("source_size")).alias("want"),
        F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"),
    )
    state = stored(state.coalesce(1), "mix-state")
    histogram = first
    for level in range(1, HASH_BITS // STEP + 1):
        if level > 1:
            inside = rows.join(state.select("source_key", "prefix"), "source_key").where(_bucket(level - 1) == F.col("prefix"))
            histogram = inside.groupBy("source_key", _bucket(level).alias("bucket")).agg(F.sum("size").alias("words"))
        # at most 2**STEP buckets a source
        upto = W.partitionBy("source_key").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
        reach = F.col("below") + F.sum("words").over(upto)
        ends = (
            histogram.join(state, "source_key")
            .withColumn("reach", reach)
            .where("reach >= want")
            .withColumn("nth", F.row_number().over(W.partitionBy("source_key").orderBy("bucket")))
            .where("nth = 1")
        )
        found = ends.select("source_key", F.col("bucket").alias("prefix"), (F.col("reach") - F.col("words")).alias("below"), "reach")
        kept = state.select("source_key", "source_size", "target", "rounds", "want")
        state = stored(kept.join(found, "source_key").coalesce(1), "mix-state")
    nearer = F.col("reach") - F.col("want") < F.col("want") - F.col("below")
    return state.select("source_key", "source_size", "target", "rounds", (F.col("prefix") + F.when(nearer, 1).otherwise(0)).alias("threshold"))


def _copies() -> Column:
    return F.col("rounds") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, source_key, size, source_size, target, copies of every row; ``copies`` is how often the mix takes it.

    ``weights`` go to the sources in order, over and over; together they get ``share`` of all words. The table of
    sources is read from files, so Spark knows its size when it picks the join.
    """
    rows = stored(docs.select("doc_id", *_hashes()), "mix-rows")
    limits = thresholds(rows, weights, share, most)
    return rows.join(limits, "source_key").select(
        "doc_id", "source_key", "size", "source_size", "target", _copies().alias("copies")
    )


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix itself: every row of ``docs``, all its columns, as often as it is taken."""
    limits = thresholds(stored(docs.select("doc_id", *_hashes()), "mix-rows"), weights, share, most)
    whole = docs.select(F.struct(*docs.columns).alias("doc"), *_hashes()).join(limits, "source_key")
    times = F.array_repeat(F.lit(1), _copies().cast("int"))
    return whole.select("doc", F.explode(times).alias("nth")).select("doc.*")
