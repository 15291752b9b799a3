"""Quality rules with thresholds learned from the corpus.

Each text is measured; the measures go into quantile sketches per language and source, which are merged to
sketches per language and of the whole corpus. Fences from those sketches take the place of fixed cut-offs, and a join
brings them to the documents.

The sketch is a histogram over log-linear buckets of whole numbers: its counts merge by adding, it does not depend on the
order of rows, and a quantile read from it is at most 1/64 too small. A measure has fewer than 2000 buckets, so a group
is bounded whatever its rows.

A fence is the upper quartile plus ``reach`` times the distance to the lower one (downwards alike); the distance counts as
``share`` of the upper quartile and ``floor`` at least, so a group of nearly equal documents does not lose its edge. Every measure has its
own reach, share and floor, and ends for its fences (``least`` of the lower quartile, ``most`` in thousandths), so that each fence
lies where values can pass it. Groups with fewer than ``ENOUGH`` documents use their language's fences, small languages those of the corpus.

Defined results: null and empty texts have no words and fail the base rules; null languages and sources are values of their own. Documents that
fail the base rules stay in the sketches. A value on a fence is inside. Repeated rows count and are returned as often as they are there; texts are
measured whole, whatever their length; an empty table has no fences and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docnest.llm.frames import SPACES, WordHashes, byte_values, mapped, shingle_hashes, stored

SYMBOLS = b"#*$%&|<>"
ENOUGH = 200


@dataclass(frozen=True)
class Measure:
    """How far from its group a measure may be; ``least``: the low fence is at least so much of the lower quartile (None: no low fence);
    ``most``: the highest the high fence may be."""

    reach: float
    share: float
    floor: float
    least: float | None = None
    most: float = 1e9


#: Measures in thousandths. Documents of which a fifth of the words repeat fail the base rules, so that fence ends below.
MEASURES = {
    "mean_word": Measure(reach=4, share=0.1, floor=0, least=0.4),
    "symbols": Measure(reach=6, share=0.25, floor=25),
    "dup_lines": Measure(reach=6, share=0.25, floor=60, most=900),
    "repeats": Measure(reach=6, share=0.25, floor=30, most=195),
}
SUB_BITS = 6

_SPACE_BYTES = SPACES.encode()
_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
_COUNT_NAMES = [c.split()[0] for c in _COUNTS.split(", ")]


def repeated_words(hashes: np.ndarray, width: int = 5) -> int:
    """Words inside runs of ``width`` words that occur twice or more, the first one included."""
    if len(hashes) < width:
        return 0
    runs = shingle_hashes(hashes, width)
    _, inverse, counts = np.unique(runs, return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[inverse] > 1)
    if not len(again):
        return 0
    edges = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + width, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def repeated_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE_BYTES)]
    return len(lines), len(lines) - len(set(lines))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        texts = byte_values(batch.column("text"))
        chars = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()
        out = []
        for text, length in zip(texts, chars, strict=True):
            words = text.split()
            n_lines, dup_lines = repeated_lines(text)
            spaces = len(text) - len(text.translate(None, _SPACE_BYTES))
            symbols = len(text) - len(text.translate(None, SYMBOLS))
            out.append((len(words), length - spaces, symbols, dup_lines, repeated_words(hashes.of(words)), n_lines))
        counts = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 6
        names = ["doc_id", "lang", "source"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, names), *counts], names=[*names, *_COUNT_NAMES])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = [F.col(c).cast("string") for c in ("lang", "source", "text")]
    return mapped(docs.select("doc_id", *named), _measured, f"doc_id {kind}, lang string, source string, {_COUNTS}")


def _per_thousand(part: str, whole: str) -> Column:
    return F.expr(f"coalesce({part} * 1000 div nullif({whole}, 0), 0)")


def _with_measures(rows: DataFrame) -> DataFrame:
    return rows.select(
        "*",
        _per_thousand("word_chars", "n_words").alias("mean_word"),
        _per_thousand("n_symbols", "n_words").alias("symbols"),
        _per_thousand("n_dup_lines", "n_lines").alias("dup_lines"),
        _per_thousand("n_repeat_words", "n_words").alias("repeats"),
    )


def _bucket(value: Column) -> Column:
    """The value with all but its leading bits cleared."""
    low = F.greatest(F.length(F.bin(value)) - (SUB_BITS + 1), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n: the quantile sketches of every measure."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), _bucket(F.col(m)).alias("bucket")) for m in MEASURES]))
    return (
        _with_measures(rows).where("n_words > 0").select("lang", "source", pairs.alias("p"))
        .groupBy("lang", "source", "p.measure", "p.bucket").agg(F.count("*").alias("n"))
    )


def merged(sketch: DataFrame, *by: str) -> DataFrame:
    """Sketches of coarser groups."""
    return sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """``by``, measure, n and one column per named quantile: the smallest bucket that so much of the group does not exceed."""
    group = W.partitionBy(*by, "measure")
    upto = F.sum("n").over(group.orderBy("bucket")) / F.sum("n").over(group)
    ranked = sketch.withColumn("upto", upto)
    return ranked.groupBy(*by, "measure").agg(F.sum("n").alias("n"), *[F.min(F.when(F.col("upto") >= s, F.col("bucket"))).alias(c) for c, s in shares.items()])


def fences(sketch: DataFrame, by: list[str], reach: float = 1) -> DataFrame:
    """``by``, group_rows and ``<measure>_low`` / ``<measure>_high``, one row per group; ``reach`` is a factor of every measure's."""
    q = quantiles(sketch, by, {"q1": 0.25, "q3": 0.75})
    ends = []
    for name, m in MEASURES.items():
        spread = F.greatest(F.col("q3") - F.col("q1"), F.col("q3") * m.share, F.lit(float(m.floor))) * (m.reach * reach)
        low = F.greatest(F.col("q1") - spread, F.col("q1") * m.least) if m.least is not None else F.lit(None).cast("double")
        high = F.least(F.col("q3") + spread, F.lit(float(m.most)))
        ends += [F.max(F.when(F.col("measure") == name, e)).alias(f"{name}_{side}") for side, e in (("low", low), ("high", high))]
    return q.groupBy(*by).agg(F.max("n").alias("group_rows"), *ends)


def verdicts(rows: DataFrame, sketch: DataFrame, reach: float = 1, enough: int = ENOUGH) -> DataFrame:
    """``rows`` with base_failed, kept and the level (source, language, corpus) whose fences were used.

    The fences are read from files, so Spark knows their size when it picks the join.
    """
    by_lang = merged(sketch, "lang")
    ends = [f"{m}_{e}" for m in MEASURES for e in ("low", "high")]
    named = lambda df, level: df.select(*[c for c in df.columns if c not in ends], *[F.col(c).alias(f"{level}_{c}") for c in ends])
    fine = named(fences(sketch, ["lang", "source"], reach), "s").withColumnRenamed("group_rows", "s_rows")
    mid = named(fences(by_lang, ["lang"], reach), "l").withColumnRenamed("group_rows", "l_rows").withColumnRenamed("lang", "l_lang")
    all_ = named(fences(merged(by_lang.withColumn("one", F.lit(1)), "one"), ["one"], reach), "c").drop("group_rows")
    limits = fine.withColumn("one", F.lit(1)).join(mid, fine["lang"].eqNullSafe(mid["l_lang"])).join(all_, "one")
    level = F.when(F.col("s_rows") >= enough, "source").when(F.col("l_rows") >= enough, "language").otherwise("corpus")
    pick = lambda c: F.when(level == "source", F.col(f"s_{c}")).when(level == "language", F.col(f"l_{c}")).otherwise(F.col(f"c_{c}"))
    limits = limits.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), level.alias("level"), *[pick(c).alias(c) for c in ends])
    limits = stored(limits.coalesce(1), "fences")
    joined = _with_measures(rows).join(limits, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    outside = F.lit(False)
    for m in MEASURES:
        outside = outside | F.coalesce(F.col(m) < F.col(f"{m}_low"), F.lit(False)) | F.coalesce(F.col(m) > F.col(f"{m}_high"), F.lit(False))
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return joined.select(*rows.columns, failed.alias("base_failed"), (~failed & ~outside).alias("kept"), "level")


def quality(docs: DataFrame, reach: float = 1, enough: int = ENOUGH) -> DataFrame:
    """Counts and verdict of every document."""
    rows = stored(measured(docs), "quality")
    return verdicts(rows, sketches(rows), reach, enough)
