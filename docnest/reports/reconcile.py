"""Whether the written documents hold the very rows of the tables: per place, a digest of the rows expected against those found.

A place is a dataset of a table, or a nested field on the way from a dataset down; nested rows are taken out again and get their foreign
key back from the parent. A digest is the number of rows and the sum of a hash of each, so the order does not matter and a
changed, lost or doubled row shows. Only columns that no nest or pattern of the table replaces are compared.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docnest.functions.columns import as_type, column, find_name, hashable, without
from docnest.functions.values import stored_type
from docnest.operators import grouping as g
from docnest.plans.migrate import Migration, nest_field, touched_columns
from docnest.plans.model import EMBED, ONE_TO_ONE, Edge
from docnest.sources.tables import union_all

EXPECTED, FOUND = "expected", "found"


@dataclass(frozen=True)
class Place:
    """Where a table's rows are: the frame found in the documents, and the plain rows expected there."""

    name: str
    found: DataFrame
    expected: DataFrame


def digest(columns: Sequence[Column]) -> list[Column]:
    """Number of rows, and the sum of their hashes. A column's position is part of its hash, so a null is not skipped."""
    row = F.xxhash64(*[F.xxhash64(F.lit(i), c) for i, c in enumerate(columns)]) if columns else F.lit(0)
    return [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row.cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias("digest")]


def _unnested(migration: Migration, edge: Edge, parent: Place) -> Place:
    """The rows of a nested edge, out of the documents of its parent."""
    catalogue, raw = migration.plan.catalogue, migration.raw
    field = column(find_name(parent.found, nest_field(catalogue, edge)))
    pk, fk = find_name(parent.found, edge.pk), find_name(raw[edge.child], edge.fk)
    one = catalogue.cardinality(edge) == ONE_TO_ONE
    rows = parent.found.select(column(pk).alias("__pk"), (field if one else F.explode(field)).alias("__doc")).filter(F.col("__doc").isNotNull())
    inside = without(rows.schema["__doc"].dataType.names, [fk])
    found = rows.select(F.col("__pk").alias(fk), *[F.col("__doc").getField(c).alias(c) for c in inside])
    wanted = g.key_type(parent.expected, edge.pk, raw[edge.child], edge.fk)
    keys = parent.expected.select(as_type(column(edge.pk), g.field_type(parent.expected, edge.pk), wanted).alias("__key")).filter("__key IS NOT NULL").distinct()
    mine = as_type(column(fk), g.field_type(raw[edge.child], edge.fk), wanted)
    return Place(edge.label, found, raw[edge.child].join(keys, mine == F.col("__key"), "left_semi"))


def places(migration: Migration, written: Mapping[str, DataFrame], table: str) -> list[Place]:
    """All places of a table's rows: its dataset, and each of its nested edges (in the first place of the parent)."""
    plan = migration.plan
    out = [Place(table, written[table], migration.raw[table])] if table in written else []
    for edge in plan.catalogue.outgoing(table):
        if plan.strategies[edge] == EMBED:
            above = places(migration, written, edge.parent)
            out += [_unnested(migration, edge, above[0])] if above else []
    return out


def _compared(migration: Migration, table: str, place: Place) -> list[tuple[str, str, T.DataType]]:
    """(raw name, found name, type) of the columns that must be the same on both sides."""
    changed = touched_columns(migration.plan, table)
    if changed is None:
        return []
    out = []
    for f in migration.raw[table].schema.fields:
        name = find_name(place.found, f.name)
        if name and f.name.lower() not in changed and hashable(f.dataType):
            out.append((f.name, name, stored_type(f.dataType)))
    return out


def reconciled(migration: Migration, written: Mapping[str, DataFrame]) -> DataFrame:
    """Per table and place: rows expected and found, columns compared, and whether they hold the same rows.

    ``written`` holds the datasets as read back. Rows that no parent takes are expected nowhere but in a dataset of their own; of a
    one-to-one edge with several rows a key, the rows that are not nested count as lost. With a custom pattern on a table
    only its rows are counted.
    """
    frames = []
    for table in migration.raw:
        for place in places(migration, written, table):
            columns = _compared(migration, table, place)
            told = [F.lit(table).alias("table_name"), F.lit(place.name).alias("place"), F.lit(len(columns)).alias("columns_compared")]
            plain = [as_type(column(c), place.expected.schema[c].dataType, kind) for c, _, kind in columns]
            back = [column(c).cast(kind) for _, c, kind in columns]
            frames.append(place.expected.agg(*digest(plain)).select(*told, F.lit(EXPECTED).alias("side"), "n", "digest"))
            frames.append(place.found.agg(*digest(back)).select(*told, F.lit(FOUND).alias("side"), "n", "digest"))
    sides = union_all(frames)
    value = lambda name, side: F.max(F.when(F.col("side") == side, F.col(name)))
    same = (value("n", EXPECTED) == value("n", FOUND)) & (value("digest", EXPECTED) == value("digest", FOUND))
    return sides.groupBy("table_name", "place", "columns_compared").agg(
        value("n", EXPECTED).alias("rows_expected"), value("n", FOUND).alias("rows_found"), same.alias("same")
    )
