"""Nesting children into their parents: one-to-one, one-to-many, junction rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docnest.functions.columns import find_name, has_column, without
from docnest.functions.numbers import finished
from docnest.operators import grouping as g
from docnest.operators.patterns import Computed, total_of
from docnest.plans.model import DEFAULT_MAX_CHILDREN, PlanError
from docnest.session import written

def _set(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.withColumn(find_name(df, name) or name, value)


def _docs_or_fail(child: DataFrame, dropped: Sequence[str], what: str) -> list[str]:
    docs = g.payload(child, dropped)
    if not docs:
        raise PlanError(f"{what}: nothing is left to nest once the keys are removed")
    return docs


def _check_limit(widest: int, field: str, max_children: int) -> None:
    if widest > max_children:
        raise PlanError(f"{field}: {widest} rows under one parent, over {max_children}: nest in chunks or leave a reference")


def embed_one(
    parent: DataFrame,
    child: DataFrame,
    *,
    pk: str,
    fk: str,
    field: str,
    child_pk: Sequence[str] = (),
    proven_unique: bool = False,
) -> DataFrame:
    """Nest at most one child as a struct without its foreign key; no child gives null.

    With several matches the one with the smallest primary key is taken. ``proven_unique`` skips
    that pick when the key is known to occur once.
    """
    docs = _docs_or_fail(child, [fk], field)
    if not has_column(child, fk):
        doc_type = T.StructType([child.schema[find_name(child, n)] for n in docs])
        return _set(parent, field, F.lit(None).cast(doc_type))
    wanted = g.key_type(parent, pk, child, fk)
    summary = g.first_doc(g.keyed(child, fk, wanted), child_pk, docs, proven_unique)
    return g.attach(parent, pk, wanted, summary, {field: F.col(g.DOCS)})


def embed_many(
    parent: DataFrame,
    child: DataFrame,
    *,
    pk: str,
    fk: str,
    field: str,
    child_pk: Sequence[str] = (),
    drop: Sequence[str] = (),
    totals: Sequence[Computed] = (),
    max_children: int | None = DEFAULT_MAX_CHILDREN,
    measured: int | None = None,
) -> DataFrame:
    """Nest all children as an array of structs without the foreign key, in primary-key order.

    No children gives an empty array. A parent with more than ``max_children`` rows is an error, as
    a document of any size cannot be promised to fit; :func:`embed_chunks` takes any number. ``None``
    nests without measuring. ``totals`` are counts and sums over the same rows, computed in the same aggregate.
    """
    docs = _docs_or_fail(child, [fk, *drop], field)
    array_type = T.ArrayType(T.StructType([child.schema[find_name(child, n)] for n in docs]))
    if not has_column(child, fk):
        return _set(parent, field, F.array().cast(array_type))
    if max_children is not None:
        _check_limit(g.measured_fan_out(child, fk) if measured is None else measured, field, max_children)
    wanted = g.key_type(parent, pk, child, fk)
    made = {p.field: total_of(p, child, f"__total_{i}") for i, p in enumerate(totals)}
    sums = [total for total, _ in made.values()]
    summary = finished(g.all_docs(g.keyed(child, fk, wanted), fk, child_pk, docs, sums), sums)
    fields = {field: g.array_or_empty(g.DOCS, array_type)}
    fields |= {name: F.coalesce(F.col(total.name), zero) for name, (total, zero) in made.items()}
    return g.attach(parent, pk, wanted, summary, fields)


def embed_chunks(
    parent: DataFrame,
    child: DataFrame,
    *,
    pk: str,
    fk: str,
    field: str,
    child_pk: Sequence[str] = (),
    drop: Sequence[str] = (),
    size: int = DEFAULT_MAX_CHILDREN,
    max_bytes: int | None = None,
    chunk_field: str = "chunk",
    measured: int | None = None,
    parts: tuple[Sequence[str], str] | None = None,
) -> DataFrame:
    """Nest all children in primary-key order, at most ``size`` a document: a parent with more has several rows, numbered by
    ``chunk_field`` from 0. Every child of a parent is in exactly one of them, and the schema does not depend on the data.

    With ``max_bytes``, children that together pass so many bytes as JSON are cut as well: only a child above half of it may, alone.
    However wide a parent is, no task sorts or joins all its children, and its chunks and those of others are the same as if it were
    narrow. ``parts``: (key, array field) of children cut into chunks themselves; the parts of a child in one chunk become one again.
    """
    if size < 1 or max_bytes is not None and max_bytes < 1:
        raise PlanError("a chunk holds at least one row and one byte")
    if has_column(parent, chunk_field):
        raise PlanError(f"{field}: the parent has a column {chunk_field}; name another with chunk_field")
    docs = _docs_or_fail(child, [fk, *drop], field)
    array_type = T.ArrayType(T.StructType([child.schema[find_name(child, n)] for n in docs]))
    if not has_column(child, fk):
        return _set(parent, field, F.array().cast(array_type)).withColumn(chunk_field, F.lit(0).cast("bigint"))
    wanted = g.key_type(parent, pk, child, fk)
    rows = g.keyed(child, fk, wanted)
    widest = g.measured_fan_out(child, fk) if measured is None else measured
    hot = written(g.hot_keys(rows), "hot_keys") if widest > g.HOT_KEY_ROWS else None
    summary = g.chunked_docs(rows, child_pk, docs, size, hot, max_bytes, parts)
    fields = {field: g.array_or_empty(g.DOCS, array_type), chunk_field: F.coalesce(F.col(g.CHUNK), F.lit(0)).cast("bigint")}
    return g.attach_chunks(parent, pk, wanted, summary, fields, hot, size)


def junction_payload(junction: DataFrame, fk: str, other_fks: Sequence[str]) -> list[str]:
    """The columns to drop so that only a junction row's own data is left. A junction without
    data of its own keeps its partner keys instead, as an empty struct cannot be stored."""
    own = without(junction.columns, [fk, *other_fks])
    return [fk, *other_fks] if own else [fk]


def embed_junction(
    parent: DataFrame,
    junction: DataFrame,
    *,
    pk: str,
    fk: str,
    other_fks: Sequence[str],
    field: str,
    child_pk: Sequence[str] = (),
    max_children: int | None = DEFAULT_MAX_CHILDREN,
    measured: int | None = None,
    chunk: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """Nest the payload of a junction's rows: neither this parent's key nor the partners' keys. ``chunk``: at most so
    many a document, and within ``max_bytes``, see :func:`embed_chunks`."""
    if chunk is not None:
        dropped = junction_payload(junction, fk, other_fks)
        return embed_chunks(
            parent, junction, pk=pk, fk=fk, field=field, child_pk=child_pk, drop=dropped, size=chunk, max_bytes=max_bytes, measured=measured
        )
    return embed_many(
        parent,
        junction,
        pk=pk,
        fk=fk,
        field=field,
        child_pk=child_pk,
        drop=junction_payload(junction, fk, other_fks),
        max_children=max_children,
        measured=measured,
    )


def embed_levels(
    levels: Sequence[tuple[DataFrame, str, Sequence[str]]],
    links: Sequence[tuple[str, str]],
    *,
    max_children: int | None = DEFAULT_MAX_CHILDREN,
    chunk: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """Nest a chain of tables, deepest first. ``levels`` lists (frame, name, primary key) from the
    deepest to the root; ``links[i]`` is (foreign key in level i, key in level i + 1).

    ``max_children`` bounds all rows under one root, over all levels together; more is an error. With ``chunk`` every level is
    nested in chunks of so many, and of at most ``max_bytes`` as JSON, instead, and nothing is too wide. A row of an inner level is then
    in a document once, with all its children that are in this document; ``chunk`` in it counts its own chunks and is above 0 where an earlier
    document of the root has the start of it.
    """
    if len(links) != len(levels) - 1:
        raise PlanError("a chain needs one link between each pair of levels")
    nested, name, keys = levels[0]
    if chunk is None and max_children is not None:
        _check_limit(g.rows_under(levels, links), levels[-1][1], max_children)
    below: str | None = None
    for (fk, pk), (parent, parent_name, parent_keys) in zip(links, levels[1:], strict=True):
        if chunk is None:
            nested = embed_many(parent, nested, pk=pk, fk=fk, field=name, child_pk=keys, max_children=None)
        else:
            order = [*keys, "chunk"] if below else keys
            parts = (keys, below) if below and keys else None
            nested = embed_chunks(parent, nested, pk=pk, fk=fk, field=name, child_pk=order, size=chunk, max_bytes=max_bytes, parts=parts)
            below = name
        name, keys = parent_name, parent_keys
    return nested
