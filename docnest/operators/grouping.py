"""One row per parent key out of a child table, and the left join that attaches it.

Every summary filters null keys first (they match nothing and would all meet in one task), and is
grouped *before* the join, so the join sees at most one row per key on the child side.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docnest.functions.columns import (
    as_type,
    column,
    common_key_type,
    document,
    empty_array,
    find_name,
    orderable,
    orderable_names,
    without,
)
from docnest.functions.numbers import Total, aggregates, prepared
from docnest.functions.ranking import BEFORE, RANK, ranked
from docnest.plans.model import PlanError
from docnest.session import written

KEY = "__parent_key"
DOCS = "__docs"
CHUNK = "__chunk"
WEIGHT = "__weight"
HOT = "__hot_key"

# A key with more rows than this is split over several tasks before its last rows are picked.
HOT_KEY_ROWS = 1_000_000
# Chunks of a hot key that meet its parent in one task, about.
SALT_CHUNKS = 100
# Up to this many rows per key, the pre-shuffle group limit alone keeps hot keys small.
PRUNED_ROWS = 16


def field_type(df: DataFrame, name: str) -> T.DataType:
    found = find_name(df, name)
    if found is None:
        raise PlanError(f"no column {name}; have {', '.join(df.columns)}")
    return df.schema[found].dataType


def key_type(parent: DataFrame, pk: str, child: DataFrame, fk: str) -> T.DataType:
    return common_key_type(field_type(parent, pk), field_type(child, fk))


def keyed(child: DataFrame, fk: str, wanted: T.DataType) -> DataFrame:
    """Child rows that can match a parent, with their key in the compared type."""
    return child.filter(column(fk).isNotNull()).withColumn(KEY, as_type(column(fk), field_type(child, fk), wanted))


def sort_names(child: DataFrame, child_pk: Sequence[str], docs: Sequence[str]) -> list[str]:
    """Primary key first, then everything comparable, so that equal keys still order the same."""
    first = [n for n in child_pk if find_name(child, n)]
    rest = [n for n in docs if n.lower() not in {p.lower() for p in first}]
    return orderable_names(child, [*first, *rest])


def _sorted_docs(order: Column, doc: Column, comparable: bool) -> Column:
    """The documents of a group in ascending order, as an aggregate."""
    pairs = F.collect_list(F.struct(order.alias("order"), doc.alias("doc")))
    if comparable:
        return F.sort_array(pairs).getField("doc")

    def compare(a: Column, b: Column) -> Column:
        left, right = a.getField("order"), b.getField("order")
        return F.when(left < right, -1).when(left > right, 1).otherwise(0)

    return F.array_sort(pairs, compare).getField("doc")


def all_docs(
    rows: DataFrame,
    fk: str,
    child_pk: Sequence[str],
    docs: Sequence[str],
    totals: Sequence[Total] = (),
) -> DataFrame:
    """All child documents per key in primary-key order, plus the aggregates of any totals.

    Only for edges whose largest group is known to be within the nesting limit. Rows are shuffled
    flat and grouped after the shuffle: collecting before it would not shrink anything. What the totals
    read is worked out after it too, so it is not shuffled beside the columns it comes from.
    """
    comparable = all(orderable(rows.schema[find_name(rows, n)].dataType) for n in docs)
    others = without([n for n in child_pk if find_name(rows, n)], [fk])
    # Comparable documents break ties between equal keys themselves.
    leading = others if comparable else sort_names(rows, others, docs)
    order = document(leading) if leading else F.lit(0)
    dealt = prepared(rows.repartition(KEY), totals)
    return dealt.groupBy(KEY).agg(_sorted_docs(order, document(docs), comparable).alias(DOCS), *aggregates(totals))


def weight_of(docs: Sequence[str]) -> Column:
    """The size of a document in bytes, as JSON."""
    return F.octet_length(F.to_json(document(docs))).cast("bigint")


def hot_keys(rows: DataFrame) -> DataFrame:
    """(HOT, __n) of the keys with more than HOT_KEY_ROWS rows: one in so many rows at most, so they fit every task."""
    return rows.groupBy(F.col(KEY).alias(HOT)).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > HOT_KEY_ROWS)


def _bucketed(rows: DataFrame, max_bytes: int, size: int) -> DataFrame:
    """Rows (RANK, BEFORE, WEIGHT) with __bucket and __sub, which ascend with the rank; rows alike in both are one chunk.

    A bucket takes the rows that start in one half of ``max_bytes``; a row above half of it is alone, and always the last of its half.
    """
    half = max(1, max_bytes // 2)
    large = (F.col(WEIGHT) > half).cast("bigint")
    bucketed = rows.withColumn("__bucket", F.floor(F.col(BEFORE) / half) * 2 + large)
    within = W.partitionBy(KEY, "__bucket").orderBy(RANK)  # no more rows than bytes
    return bucketed.withColumn("__sub", F.floor((F.row_number().over(within) - 1) / size))


def _chunks_of_hot_keys(rows: DataFrame, names: Sequence[str], size: int, max_bytes: int | None) -> DataFrame:
    """Rows with RANK and CHUNK, ranked over ranges: no task sorts a key whole."""
    if max_bytes is None:
        return ranked(rows, [KEY], names).withColumn(CHUNK, F.floor(F.col(RANK) / size))
    cut = written(_bucketed(ranked(rows, [KEY], names, F.col(WEIGHT)), max_bytes, size), "cut")
    chunk = [KEY, "__bucket", "__sub"]
    numbered = ranked(cut.select(*chunk).distinct(), [KEY], chunk[1:]).withColumnRenamed(RANK, CHUNK)
    return cut.join(numbered, chunk).drop("__bucket", "__sub")


def _chunks(rows: DataFrame, names: Sequence[str], size: int, max_bytes: int | None) -> DataFrame:
    """The same where no key has more than HOT_KEY_ROWS rows: a window per key."""
    each = W.partitionBy(KEY).orderBy(*([column(c).asc() for c in names] or [F.lit(0).asc()]))
    numbered = rows.withColumn(RANK, (F.row_number().over(each) - 1).cast("bigint"))
    if max_bytes is None:
        return numbered.withColumn(CHUNK, F.floor(F.col(RANK) / size))
    order = W.partitionBy(KEY).orderBy(RANK)
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    cut = _bucketed(numbered.withColumn(BEFORE, F.coalesce(F.sum(WEIGHT).over(earlier), F.lit(0))), max_bytes, size)
    same = (F.col("__bucket") == F.lag("__bucket").over(order)) & (F.col("__sub") == F.lag("__sub").over(order))
    starts = F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    return cut.withColumn("__starts", starts).withColumn(CHUNK, F.sum("__starts").over(upto) - 1).drop("__bucket", "__sub", "__starts")


def chunked_docs(
    rows: DataFrame,
    child_pk: Sequence[str],
    docs: Sequence[str],
    size: int,
    hot: DataFrame | None,
    max_bytes: int | None = None,
    parts: tuple[Sequence[str], str] | None = None,
) -> DataFrame:
    """All child documents per key in primary-key order, in arrays of at most ``size``: one row per key and chunk, counted from 0.

    With ``max_bytes``, an array of several documents also stays within so many bytes as JSON. ``hot`` (see :func:`hot_keys`)
    are the keys to be ranked over ranges instead of by a window; the result is the same. ``parts``: (key columns, array field) of
    children that come in parts themselves; parts of one child that meet in a chunk become one document, their arrays joined.
    """
    names = sort_names(rows, child_pk, docs)
    if max_bytes is not None:
        rows = rows.withColumn(WEIGHT, weight_of(docs))
    if hot is None:
        numbered = _chunks(rows, names, size, max_bytes)
    else:
        is_hot = F.col(KEY) == F.col(HOT)
        few = F.broadcast(hot.select(HOT))
        slow = _chunks_of_hot_keys(rows.join(few, is_hot, "left_semi"), names, size, max_bytes)
        numbered = _chunks(rows.join(few, is_hot, "left_anti"), names, size, max_bytes).unionByName(slow)
    comparable = all(orderable(rows.schema[find_name(rows, c)].dataType) for c in docs)
    if parts is None:
        return numbered.groupBy(KEY, CHUNK).agg(_sorted_docs(F.col(RANK), document(docs), comparable).alias(DOCS))
    keys, field = parts
    inner = numbered.groupBy(KEY, CHUNK, *[column(k).alias(f"__key_{i}") for i, k in enumerate(keys)]).agg(
        F.min(RANK).alias(RANK),
        F.min_by(document(docs), F.col(RANK)).alias("__doc"),
        F.flatten(_sorted_docs(F.col(RANK), column(field), comparable)).alias("__joined"),
    )
    doc = F.struct(*[F.col("__joined").alias(d) if d.lower() == field.lower() else F.col("__doc").getField(d).alias(d) for d in docs])
    return inner.groupBy(KEY, CHUNK).agg(_sorted_docs(F.col(RANK), doc, comparable).alias(DOCS))


def attach_chunks(
    parent: DataFrame, pk: str, wanted: T.DataType, summary: DataFrame, fields: Mapping[str, Column], hot: DataFrame | None, size: int
) -> DataFrame:
    """Like :func:`attach` for several rows a key. A hot parent is repeated for every SALT_CHUNKS chunks, which it meets in as many tasks."""
    if hot is None:
        return attach(parent, pk, wanted, summary, fields)
    few = F.broadcast(hot.select(HOT, F.greatest(F.lit(1), F.floor(F.col("__n") / (size * SALT_CHUNKS))).cast("bigint").alias("__salts")))
    salts = F.coalesce(F.col("__salts"), F.lit(1).cast("bigint"))
    salted = summary.join(few, F.col(KEY) == F.col(HOT), "left").withColumn("__salt", F.pmod(CHUNK, salts)).drop(HOT, "__salts")
    key = as_type(column(pk), field_type(parent, pk), wanted)
    repeated = parent.join(few, key == F.col(HOT), "left").withColumn("__its", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)))
    joined = repeated.join(salted, (key == F.col(KEY)) & (F.col("__its") == F.col("__salt")), "left").drop(KEY, HOT, "__salts", "__its", "__salt")
    hidden = [n for n in summary.columns if n != KEY]
    return joined.withColumns({find_name(parent, f) or f: v for f, v in fields.items()}).drop(*hidden)


def first_doc(rows: DataFrame, child_pk: Sequence[str], docs: Sequence[str], proven_unique: bool) -> DataFrame:
    """One child document per key: the one with the smallest primary key."""
    if proven_unique:
        return rows.select(KEY, document(docs).alias(DOCS))
    names = sort_names(rows, child_pk, docs)
    order = document(names) if names else F.lit(0)
    return rows.groupBy(KEY).agg(F.min_by(document(docs), order).alias(DOCS))


def spread_for(widest: int | None, n: int) -> int:
    """Over how many tasks to spread a key: balances rows per first pass and per last pass."""
    if not widest or widest <= HOT_KEY_ROWS:
        return 1
    return max(2, math.ceil(math.sqrt(widest / max(n, 1))))


def last_docs(rows: DataFrame, child_pk: Sequence[str], docs: Sequence[str], n: int, spread: int = 1) -> DataFrame:
    """The ``n`` child documents per key with the largest primary key, largest first.

    With ``spread`` > 1 a first pass picks the last ``n`` of every (key, slice), so that no task
    ever sorts a hot key whole; the second pass sees at most ``n * spread`` rows of it.
    """
    names = sort_names(rows, child_pk, docs)
    descending = [column(c).desc() for c in names] or [F.lit(0).asc()]
    if spread > 1:
        # The input partition is part of the slice so that exact copies do not meet in one slice.
        mixed = F.xxhash64(F.spark_partition_id(), *[column(c) for c in names])
        sliced = rows.withColumn("__slice", F.pmod(mixed, F.lit(spread)))
        within = W.partitionBy(KEY, "__slice").orderBy(*descending)
        rows = sliced.withColumn("__rank", F.row_number().over(within)).filter(F.col("__rank") <= n)
    ranked = rows.withColumn("__rank", F.row_number().over(W.partitionBy(KEY).orderBy(*descending)))
    kept = ranked.filter(F.col("__rank") <= n)
    comparable = all(orderable(kept.schema[find_name(kept, c)].dataType) for c in docs)
    return kept.groupBy(KEY).agg(_sorted_docs(F.col("__rank"), document(docs), comparable).alias(DOCS))


def rows_under(levels: Sequence[tuple[DataFrame, str, Sequence[str]]], links: Sequence[tuple[str, str]]) -> int:
    """The largest number of rows, of all levels together, under one row of the last level. Reads key columns only."""
    below: DataFrame | None = None
    inner: str | None = None
    for i, (fk, pk) in enumerate(links):
        child, parent = levels[i][0], levels[i + 1][0]
        weight = F.lit(1).cast("bigint")
        if below is not None:
            kind = key_type(child, inner, levels[i - 1][0], links[i - 1][0])
            child = child.join(below, as_type(column(inner), field_type(child, inner), kind) == F.col(KEY), "left").drop(KEY)
            weight = weight + F.coalesce(F.col("__n"), F.lit(0))
        rows = keyed(child, fk, key_type(parent, pk, levels[i][0], fk))
        below = rows.groupBy(KEY).agg(F.sum(weight).alias("__n"))
        inner = pk
    return below.agg(F.coalesce(F.max("__n"), F.lit(0))).first()[0] if below is not None else 0


def fan_out(child: DataFrame, fk: str) -> DataFrame:
    """One row: the largest number of rows sharing one non-null key."""
    counted = child.filter(column(fk).isNotNull()).groupBy(column(fk).alias(KEY)).agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(F.coalesce(F.max("n"), F.lit(0)).alias("max_children"))


def measured_fan_out(child: DataFrame, fk: str) -> int:
    """The same, measured now by a job that reads the one key column."""
    return fan_out(child, fk).first()["max_children"]


def attach(
    parent: DataFrame,
    pk: str,
    wanted: T.DataType,
    summary: DataFrame,
    fields: Mapping[str, Column],
) -> DataFrame:
    """Left-join a per-key summary; ``fields`` maps each field to set to an expression over the
    summary's columns (named ``__...``). A field that exists is replaced in place."""
    hidden = [n for n in summary.columns if n != KEY]
    left_key = as_type(column(pk), field_type(parent, pk), wanted)
    joined = parent.join(summary, left_key == F.col(KEY), "left").drop(KEY)
    return joined.withColumns({find_name(parent, f) or f: v for f, v in fields.items()}).drop(*hidden)


def array_or_empty(name: str, dtype: T.ArrayType) -> Column:
    return F.coalesce(F.col(name), empty_array(dtype))


def payload(child: DataFrame, dropped: Sequence[str]) -> list[str]:
    return without([c for c in child.columns if c != KEY], dropped)
