"""The five document patterns, and custom ones, as DataFrame -> DataFrame steps."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docnest.functions.columns import column, find_name, has_column
from docnest.functions.numbers import Total, aggregates, exact_total, finished, nearest_multiple, prepared
from docnest.operators import grouping as g
from docnest.plans.model import PlanError

log = logging.getLogger(__name__)

# Fixed order in which the kinds of pattern are applied to a table; custom kinds follow.
ATTRIBUTE, COMPUTED, SUBSET, OUTLIER, APPROXIMATION = "attribute", "computed", "subset", "outlier", "approximation"
PATTERN_ORDER = (ATTRIBUTE, COMPUTED, SUBSET, OUTLIER, APPROXIMATION)

FUNCTIONS = ("COUNT", "SUM")


def _whole(value: Any, what: str) -> int:
    """A non-negative whole number, also from text; anything else is a plan error."""
    try:
        number = int(str(value).strip())
    except ValueError:
        number = -1
    if isinstance(value, bool) or number < 0:
        raise PlanError(f"{what} must be a whole number of at least 0, not {value!r}")
    return number


@dataclass(frozen=True)
class Pattern:
    """Common base: which child tables are read, and which columns may change."""

    @property
    def kind(self) -> str:
        raise NotImplementedError

    def capped_children(self) -> list[str]:
        return []

    def touched(self) -> set[str] | None:
        """Columns this pattern may add, change or remove; ``None`` when unknown."""
        return None


@dataclass(frozen=True)
class Attribute(Pattern):
    """Fold columns into one array of {key, value}; nulls leave no entry."""

    name: str
    mapping: Any
    value_type: str | None = None
    kind = ATTRIBUTE

    def pairs(self) -> list[tuple[str, str]]:
        items = self.mapping.items() if isinstance(self.mapping, Mapping) else self.mapping
        good, seen = [], set()
        for item in items:
            parts = tuple(item) if isinstance(item, (tuple, list)) else ()
            if len(parts) != 2 or not all(isinstance(p, str) and p.strip() for p in parts):
                log.warning("attribute %s: skipping malformed mapping %r", self.name, item)
                continue
            source, key = parts[0].strip(), parts[1].strip()
            if source.lower() not in seen:
                seen.add(source.lower())
                good.append((source, key))
        return good

    def touched(self) -> set[str]:
        return {self.name.lower(), *(c.lower() for c, _ in self.pairs())}


@dataclass(frozen=True)
class Computed(Pattern):
    """A COUNT or exact SUM over a table's child rows."""

    field: str
    function: str
    child: str
    column: str | None = None
    fk: str | None = None
    scale: int | None = None
    wide: bool = False
    kind = COMPUTED

    def __post_init__(self) -> None:
        if self.function.upper() not in FUNCTIONS:
            raise PlanError(f"unknown function {self.function}; use one of {', '.join(FUNCTIONS)}")
        if self.function.upper() == "SUM" and not self.column:
            raise PlanError(f"{self.field}: SUM needs a column")

    def touched(self) -> set[str]:
        return {self.field.lower()}


@dataclass(frozen=True)
class Subset(Pattern):
    """The latest N children, by descending primary key, as ``recent_<child>``."""

    child: str
    limit: int
    fk: str | None = None
    field: str | None = None
    kind = SUBSET

    def __post_init__(self) -> None:
        object.__setattr__(self, "limit", _whole(self.limit, f"the limit of subset {self.child}"))

    @property
    def name(self) -> str:
        return self.field or f"recent_{self.child}"

    def touched(self) -> set[str]:
        return {self.name.lower()}


@dataclass(frozen=True)
class Outlier(Pattern):
    """A capped array of children with a ``has_extras`` flag; the child table stays referenced."""

    child: str
    threshold: int
    fk: str | None = None
    field: str | None = None
    flag: str = "has_extras"
    kind = OUTLIER

    def __post_init__(self) -> None:
        object.__setattr__(self, "threshold", _whole(self.threshold, f"the threshold of outlier {self.child}"))

    @property
    def name(self) -> str:
        return self.field or self.child

    def capped_children(self) -> list[str]:
        return [self.child]

    def touched(self) -> set[str]:
        return {self.name.lower(), self.flag.lower()}


@dataclass(frozen=True)
class Approximation(Pattern):
    """Round top-level numeric fields to the nearest multiple of a granularity."""

    fields: Any
    wide: bool = False
    kind = APPROXIMATION

    def granularities(self) -> dict[str, int]:
        items = self.fields.items() if isinstance(self.fields, Mapping) else self.fields
        wanted: dict[str, int] = {}
        for item in items:
            parts = tuple(item) if isinstance(item, (tuple, list)) else ()
            try:
                name, step = str(parts[0]).strip(), int(str(parts[1]).strip())
            except (IndexError, ValueError):
                name, step = "", 0
            if len(parts) != 2 or not name or not 0 < step <= 2**31 - 1:
                log.warning("approximation: skipping malformed entry %r", item)
                continue
            wanted[name] = step
        return wanted

    def touched(self) -> set[str]:
        return {n.lower() for n in self.granularities()}


# --- single patterns -------------------------------------------------------------------------


def attribute(df: DataFrame, pattern: Attribute) -> DataFrame:
    present = [(find_name(df, c), k) for c, k in pattern.pairs() if has_column(df, c)]
    sources = [df.schema[c].dataType for c, _ in present]
    if pattern.value_type:
        value_type = T.DataType.fromDDL(pattern.value_type)
    elif not sources:
        value_type = T.StringType()
    else:
        value_type = sources[0] if all(t == sources[0] for t in sources) else T.VariantType()

    def value(name: str, dtype: T.DataType) -> Column:
        if isinstance(value_type, T.VariantType) and isinstance(dtype, (T.StructType, T.MapType, T.ArrayType)):
            return F.to_variant_object(column(name))
        return column(name) if dtype == value_type else column(name).cast(value_type)

    entry_type = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", value_type)])
    empty = F.array().cast(T.ArrayType(entry_type))
    entries = [
        F.when(
            column(c).isNotNull(),
            F.array(F.struct(F.lit(k).alias("key"), value(c, t).alias("value"))),
        ).otherwise(empty)
        for (c, k), t in zip(present, sources, strict=True)
    ]
    built = F.concat(*entries) if entries else empty
    rest = df.select(
        *[column(c) for c in df.columns if c not in {p for p, _ in present}], built.alias("__attribute_array")
    )
    existing = find_name(rest, pattern.name)
    if existing:
        return rest.withColumn(existing, F.col("__attribute_array")).drop("__attribute_array")
    return rest.withColumnRenamed("__attribute_array", pattern.name)


def approximation(df: DataFrame, pattern: Approximation) -> DataFrame:
    rounded = {}
    for name, step in pattern.granularities().items():
        found = find_name(df, name)
        if found is None:
            continue
        value = nearest_multiple(column(found), df.schema[found].dataType, step, pattern.wide)
        if value is not None:
            rounded[found] = value
    return df.withColumns(rounded) if rounded else df


def total_of(pattern: Computed, child: DataFrame, name: str) -> tuple[Total, Column]:
    """The total of a Computed pattern as column ``name``, and its value for a parent without children."""
    none = F.lit(0).cast("bigint")
    if pattern.function.upper() == "COUNT":
        return Total(name, T.LongType(), {name: F.count(F.lit(1))}), none
    source = find_name(child, pattern.column)
    if source is None:
        raise PlanError(f"{pattern.field}: {pattern.child} has no column {pattern.column}")
    made = exact_total(name, column(source), child.schema[source].dataType, pattern.field, pattern.scale, pattern.wide)
    if made is None:
        return Total(name, T.LongType(), {name: F.sum(none)}), none
    return made, F.lit(0).cast(made.dtype)


# --- patterns that read a child table --------------------------------------------------------


@dataclass
class ChildReader:
    """All patterns of one table that read the same child by the same key, planned together:
    the counts and sums share one aggregate, the subset and the capped array share one top-N."""

    child: DataFrame
    fk: str
    pk: str
    child_pk: Sequence[str]
    patterns: list[Pattern] = field(default_factory=list)
    widest: int | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        computed = [p for p in self.patterns if p.kind == COMPUTED]
        arrays = [p for p in self.patterns if p.kind in (SUBSET, OUTLIER)]
        matched = has_column(self.child, self.fk) and has_column(df, self.pk)
        if computed:
            df = self._totals(df, computed, matched)
        if arrays:
            df = self._arrays(df, arrays, matched)
        return df

    def _totals(self, df: DataFrame, computed: list[Computed], matched: bool) -> DataFrame:
        made = {p.field: total_of(p, self.child, f"__total_{i}") for i, p in enumerate(computed)}
        if not matched:
            return df.withColumns({find_name(df, f) or f: zero for f, (_, zero) in made.items()})
        wanted = g.key_type(df, self.pk, self.child, self.fk)
        totals = [total for total, _ in made.values()]
        rows = prepared(g.keyed(self.child, self.fk, wanted), totals)
        summary = finished(rows.groupBy(g.KEY).agg(*aggregates(totals)), totals)
        values = {f: F.coalesce(F.col(total.name), zero) for f, (total, zero) in made.items()}
        return g.attach(df, self.pk, wanted, summary, values)

    def _arrays(self, df: DataFrame, arrays: list[Subset | Outlier], matched: bool) -> DataFrame:
        docs = g.payload(self.child, [self.fk])
        if not docs:
            raise PlanError(f"nothing is left to nest once {self.fk} is removed")
        doc_type = T.StructType([self.child.schema[find_name(self.child, n)] for n in docs])
        array_type = T.ArrayType(doc_type)
        most = max(p.limit if p.kind == SUBSET else p.threshold + 1 for p in arrays)
        if not matched or most == 0:
            return df.withColumns(self._array_fields(df, arrays, F.array().cast(array_type), most))
        wanted = g.key_type(df, self.pk, self.child, self.fk)
        rows = g.keyed(self.child, self.fk, wanted)
        summary = g.last_docs(rows, self.child_pk, docs, most, self._spread(most))
        found = g.array_or_empty(g.DOCS, array_type)
        return g.attach(df, self.pk, wanted, summary, self._array_fields(df, arrays, found, most))

    def _array_fields(self, df: DataFrame, arrays: list, found: Column, most: int) -> dict[str, Column]:
        fields: dict[str, Column] = {}
        for p in arrays:
            if p.kind == SUBSET:
                fields[p.name] = found if p.limit == most else F.slice(found, 1, p.limit)
            else:
                fields[p.name] = F.slice(found, 1, p.threshold)
                fields[p.flag] = F.size(found) > p.threshold
        return fields

    def _spread(self, most: int) -> int:
        limit = int(self.child.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
        if most <= min(g.PRUNED_ROWS, limit):
            return 1
        widest = g.measured_fan_out(self.child, self.fk) if self.widest is None else self.widest
        return g.spread_for(widest, most)


# --- custom patterns -------------------------------------------------------------------------


@dataclass(frozen=True)
class Custom(Pattern):
    """A registered pattern by name, with its arguments."""

    name: str
    args: Mapping[str, Any] = field(default_factory=dict)

    @property
    def kind(self) -> str:
        return self.name


_registered: dict[str, Callable[..., DataFrame]] = {}


def register_pattern(name: str, apply: Callable[..., DataFrame]) -> None:
    """Make ``Custom(name, args)`` call ``apply(df, context, **args)`` after the built-in kinds."""
    if name in PATTERN_ORDER:
        raise PlanError(f"{name} is a built-in pattern")
    _registered[name] = apply


@dataclass
class PatternContext:
    """What a pattern may read besides the documents: raw tables, the catalogue, fan-outs."""

    table: str
    raw: Mapping[str, DataFrame]
    catalogue: Any
    fan_out: Mapping[Any, int] = field(default_factory=dict)

    def reader(self, child: str, fk: str | None) -> ChildReader:
        if child not in self.raw:
            raise PlanError(f"{self.table}: unknown child table {child}")
        edge = self.catalogue.between(child, self.table, fk)
        spec = self.catalogue.tables.get(child)
        return ChildReader(self.raw[child], edge.fk, edge.pk, spec.pk if spec else (), [], self.fan_out.get(edge))


def _readers(patterns: Sequence[Pattern], context: PatternContext) -> list[ChildReader]:
    grouped: dict[tuple[str, str], ChildReader] = {}
    for p in patterns:
        made = context.reader(p.child, p.fk)
        grouped.setdefault((p.child, made.fk), made).patterns.append(p)
    return list(grouped.values())


def apply_patterns(df: DataFrame, patterns: Iterable[Pattern], context: PatternContext) -> DataFrame:
    """Attribute, Computed, Subset, Outlier, Approximation, then custom kinds, in that order.

    Patterns that read the same child are joined once; their fields are then put in pattern order.
    """
    patterns = list(patterns)
    by_kind = {kind: [p for p in patterns if p.kind == kind] for kind in PATTERN_ORDER}
    for p in by_kind[ATTRIBUTE]:
        df = attribute(df, p)
    readers = [*by_kind[COMPUTED], *by_kind[SUBSET], *by_kind[OUTLIER]]
    for reader in _readers(readers, context):
        df = reader.apply(df)
    for p in by_kind[APPROXIMATION]:
        df = approximation(df, p)
    for p in patterns:
        if p.kind not in PATTERN_ORDER:
            if p.kind not in _registered:
                raise PlanError(f"no pattern registered as {p.kind}")
            df = _registered[p.kind](df, context, **p.args)
    return df


# --- the same patterns without a catalogue ---------------------------------------------------


def computed(
    parent: DataFrame, child: DataFrame, *, pk: str, fk: str, field: str, function: str,
    column: str | None = None, scale: int | None = None, wide: bool = False,
) -> DataFrame:
    """COUNT or SUM of child rows per parent."""
    pattern = Computed(field, function, "", column, fk, scale, wide)
    return ChildReader(child, fk, pk, (), [pattern]).apply(parent)


def subset(
    parent: DataFrame, child: DataFrame, *, pk: str, fk: str, child_pk: Sequence[str], limit: int, field: str,
    widest: int | None = None,
) -> DataFrame:
    """The latest ``limit`` children per parent."""
    return ChildReader(child, fk, pk, child_pk, [Subset("", limit, fk, field)], widest).apply(parent)


def outlier(
    parent: DataFrame, child: DataFrame, *, pk: str, fk: str, child_pk: Sequence[str], threshold: int, field: str,
    flag: str = "has_extras", widest: int | None = None,
) -> DataFrame:
    """The latest ``threshold`` children per parent, and whether there are more."""
    return ChildReader(child, fk, pk, child_pk, [Outlier("", threshold, fk, field, flag)], widest).apply(parent)
