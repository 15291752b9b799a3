"""Keys found in the data: which columns identify rows, and which refer to them.

A lake has no catalogue to ask. Candidate keys are the unique columns without nulls. A column can refer to a key of the same kind of type if every
one of its values is there, an inclusion. Most pairs are ruled out by bottom-k sketches of the distinct values: the key's sketch
holds all its hashes up to its largest one, so a hash of the column below that which is not in it proves a value without a
partner. What is left is decided exactly, by a join of distinct values. Small whole numbers are included in almost
any key by chance, so an inclusion counts as a reference if the names agree, up to the prefix of each table; what a domain calls
by another name (``user_id`` for a customer's key) is told by ``names``. Where ``by_name`` is off, an inclusion that reaches nearly all
rows of the parent counts as well.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docnest.functions.columns import as_type, column, common_key_type
from docnest.operators.profile import column_profile
from docnest.plans.model import Catalogue, Edge, TableSpec
from docnest.session import written
from docnest.sources.tables import union_all

#: Hashes in a sketch.
SKETCH = 256
#: A reference whose name says nothing reaches at least this share of the parent's rows.
REACHED = 0.9

REFERENCE_SCHEMA = "child string, fk string, parent string, pk string, same_name boolean, distinct_keys bigint, parent_rows bigint"


@dataclass(frozen=True)
class Candidate:
    """A column that may be a key or refer to one."""

    table: str
    name: str
    kind: T.DataType
    unique: bool


def _family(kind: T.DataType) -> str | None:
    """Types whose values can be keys of each other."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) or isinstance(kind, T.DecimalType) and not kind.scale:
        return "whole"
    if isinstance(kind, T.StringType):
        return "text"
    return "date" if isinstance(kind, (T.DateType,)) else None


def stem(name: str, others: list[str]) -> str:
    """A column's name without the prefix that all columns of its table share (``o_`` of ``o_orderkey``)."""
    head = re.match(r"[A-Za-z0-9]+_", name)
    shared = head and len(others) > 1 and all(o.lower().startswith(head[0].lower()) for o in others)
    return name[head.end() :].lower() if shared else name.lower()


def _values(tables: Mapping[str, DataFrame], c: Candidate) -> DataFrame:
    """The distinct non-null values of a column."""
    return tables[c.table].select(column(c.name).alias("v")).filter(F.col("v").isNotNull()).distinct()


def _sketches(tables: Mapping[str, DataFrame], columns: list[Candidate]) -> dict[Candidate, list[int]]:
    """The SKETCH smallest hashes of the distinct values of each column; a pass over each, of which SKETCH numbers leave."""
    frames = []
    for i, c in enumerate(columns):
        # in one type per family, so that the same value has the same hash in every column
        wide = {"whole": "decimal(38,0)"}.get(_family(c.kind), "string")
        hashes = tables[c.table].filter(column(c.name).isNotNull()).select(F.xxhash64(column(c.name).cast(wide)).alias("h")).distinct()
        frames.append(hashes.orderBy("h").limit(SKETCH).select(F.lit(i).alias("i"), "h"))
    found: dict[Candidate, list[int]] = {c: [] for c in columns}
    for r in union_all(frames).collect() if frames else []:  # SKETCH longs a column
        found[columns[r["i"]]].append(r["h"])
    return {c: sorted(h) for c, h in found.items()}


def may_include(key: list[int], other: list[int]) -> bool:
    """False if the sketches prove that ``other`` has a value that ``key`` has not."""
    if not key:
        return not other
    every = set(key)
    return all(h in every for h in other if h <= key[-1] or len(key) < SKETCH)


def candidate_keys(spark: SparkSession, tables: Mapping[str, DataFrame], only: Callable[[str, str], bool] = lambda table, name: True) -> list[Candidate]:
    """All columns that can be keys or refer to one, of those ``only`` lets through; ``unique`` where values are neither repeated nor missing."""
    asked = {t: [f for f in df.schema.fields if _family(f.dataType) and only(t, f.name)] for t, df in tables.items()}
    asked = {t: found for t, found in asked.items() if found}
    if not asked:
        return []
    narrow = {t: tables[t].select(*[column(f.name) for f in found]) for t, found in asked.items()}
    nothing = Catalogue.of([TableSpec(t, df.columns[0]) for t, df in narrow.items()])
    profile = {(r["table_name"], r["column_name"]): r for r in column_profile(spark, narrow, nothing).collect()}  # one row per column
    measured = [(t, f, profile[t, f.name]) for t, found in asked.items() for f in found]
    return [Candidate(t, f.name, f.dataType, bool(r["is_unique"]) and not r["is_nullable"]) for t, f, r in measured if r["value_count"]]


def _stems(tables: Mapping[str, DataFrame], names: Mapping[str, str]) -> dict[tuple[str, str], str]:
    return {(t, c): names.get(c, stem(c, df.columns)) for t, df in tables.items() for c in df.columns}


def _pairs(tables: Mapping[str, DataFrame], columns: list[Candidate], stems: Mapping[tuple[str, str], str], by_name: bool) -> list[tuple[Candidate, Candidate, bool]]:
    """(column, key, whether their names agree) of every inclusion the sketches do not rule out."""
    of = {c: stems[c.table, c.name] for c in columns}
    if by_name:  # the others need no sketch
        known = {of[c] for c in columns if c.unique}
        columns = [c for c in columns if of[c] in known]
    sketches = _sketches(tables, columns)
    out = []
    for key in (c for c in columns if c.unique):
        for c in columns:
            same = of[c] == of[key]
            # a unique column that refers to a key is a one-to-one reference, or chance: its name has to tell
            likely = same or not (by_name or c.unique)
            if likely and c.table != key.table and _family(c.kind) == _family(key.kind) and may_include(sketches[key], sketches[c]):
                out.append((c, key, same))
    return out


def _counted(tables: Mapping[str, DataFrame], i: int, c: Candidate, key: Candidate) -> DataFrame:
    """One row: distinct values, those without a partner, and rows of the parent."""
    wanted = common_key_type(key.kind, c.kind)
    mine = _values(tables, c).select(as_type(F.col("v"), c.kind, wanted).alias("v"))
    theirs = tables[key.table].select(as_type(column(key.name), key.kind, wanted).alias("k"))
    met = mine.join(theirs, F.col("v") == F.col("k"), "full_outer")
    counts = {"distinct_keys": F.col("v").isNotNull(), "missing": F.col("v").isNotNull() & F.col("k").isNull(), "parent_rows": F.col("k").isNotNull()}
    return met.agg(*[F.count(F.when(w, 1)).alias(n) for n, w in counts.items()]).select(F.lit(i).alias("i"), *counts)


def references(spark: SparkSession, tables: Mapping[str, DataFrame], names: Mapping[str, str] | None = None, by_name: bool = True) -> DataFrame:
    """Per reference found: child, fk, parent, pk, whether the names agree, distinct keys and rows of the parent.

    A column refers to one key: one of its own name if there is one, else the one of whose rows it reaches most; between equals the
    smaller parent, then the first name. ``names``: column names and the prefixless key names they stand for. Of two one-to-one tables the smaller one is the child; of equals the one of the later name.
    """
    stems = _stems(tables, names or {})
    used = Counter(stems.values())  # a name of one column only is no reference by name
    columns = candidate_keys(spark, tables, lambda t, c: not by_name or used[stems[t, c]] > 1)
    pairs = _pairs(tables, columns, stems, by_name)
    frames = [_counted(tables, i, c, key) for i, (c, key, _) in enumerate(pairs)]
    measured = written(union_all(frames), "inclusions").filter("missing = 0").collect() if frames else []  # one row per pair
    best: dict[tuple[str, str], tuple] = {}
    for r in measured:
        c, key, same = pairs[r["i"]]
        share = r["distinct_keys"] / r["parent_rows"]
        if not same and share < REACHED:
            continue
        if c.unique and share == 1 and (c.table, c.name) < (key.table, key.name):
            continue  # the same keys on both sides: the first table is the parent
        rank = (same, share, -r["parent_rows"], [-ord(x) for x in key.table])
        if rank > best.get((c.table, c.name), ((False, -1.0),))[0]:
            best[c.table, c.name] = (rank, (c.table, c.name, key.table, key.name, same, r["distinct_keys"], r["parent_rows"]))
    return spark.createDataFrame(sorted(row for _, row in best.values()), REFERENCE_SCHEMA)


def discovered(spark: SparkSession, tables: Mapping[str, DataFrame], names: Mapping[str, str] | None = None, by_name: bool = True) -> Catalogue:
    """A catalogue made from the data alone: the referenced keys, and the edges to them.

    A table that nothing refers to has its first unique column as key, or else all its columns.
    """
    edges = [Edge(r["child"], r["fk"], r["parent"], r["pk"]) for r in references(spark, tables, names, by_name).collect()]  # one row per edge
    keys = {e.parent: (e.pk,) for e in edges}
    for c in candidate_keys(spark, tables):
        if c.unique:
            keys.setdefault(c.table, (c.name,))
    return Catalogue.of([TableSpec(t, keys.get(t, tuple(df.columns))) for t, df in tables.items()], edges)
