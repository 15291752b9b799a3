"""Declared tables and edges, and the per-run settings. Plain driver-side descriptions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

EMBED = "EMBED"
REFERENCE = "REFERENCE"

ONE_TO_ONE = "ONE_TO_ONE"
ONE_TO_MANY = "ONE_TO_MANY"
MANY_TO_MANY = "MANY_TO_MANY"

PRIMARY_ENTITY = "PRIMARY_ENTITY"
CHILD_ENTITY = "CHILD_ENTITY"
JUNCTION_TABLE = "JUNCTION_TABLE"

DEFAULT_MAX_CHILDREN = 1000


class PlanError(ValueError):
    """A request that cannot be planned; raised before any data is touched."""


@dataclass(frozen=True)
class TableSpec:
    """A table's keys: the primary key columns in order, and the single columns declared unique."""

    name: str
    pk: tuple[str, ...]
    unique: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not self.name or not self.name.strip():
            raise PlanError("a table needs a name")
        keys = (self.pk,) if isinstance(self.pk, str) else tuple(self.pk)
        if not keys:
            raise PlanError(f"table {self.name} needs a primary key")
        object.__setattr__(self, "pk", keys)
        object.__setattr__(self, "unique", (self.unique,) if isinstance(self.unique, str) else tuple(self.unique))


@dataclass(frozen=True)
class Edge:
    """One foreign-key column of a child table and the parent column it points to. ``field`` names the nested
    field, where the usual name is taken."""

    child: str
    fk: str
    parent: str
    pk: str
    cardinality: str | None = None
    field: str | None = None

    @property
    def is_self(self) -> bool:
        return self.child == self.parent

    @property
    def label(self) -> str:
        return f"{self.child}.{self.fk}->{self.parent}.{self.pk}"


@dataclass
class Catalogue:
    tables: dict[str, TableSpec]
    edges: list[Edge]

    @classmethod
    def of(cls, tables: Iterable[TableSpec], edges: Iterable[Edge] = ()) -> Catalogue:
        made = cls({t.name: t for t in tables}, list(edges))
        for e in made.edges:
            for name in (e.child, e.parent):
                if name not in made.tables:
                    raise PlanError(f"edge {e.label} names an unknown table {name}")
        return made

    def spec(self, table: str) -> TableSpec:
        try:
            return self.tables[table]
        except KeyError:
            raise PlanError(f"unknown table {table}") from None

    def incoming(self, parent: str) -> list[Edge]:
        return [e for e in self.edges if e.parent == parent]

    def outgoing(self, child: str) -> list[Edge]:
        return [e for e in self.edges if e.child == child]

    def cardinality(self, edge: Edge) -> str:
        """Declared: 1:1 when the foreign key alone is unique or is the whole primary key."""
        if edge.cardinality:
            return edge.cardinality
        child = self.spec(edge.child)
        alone = edge.fk in child.unique or child.pk == (edge.fk,)
        return ONE_TO_ONE if alone else ONE_TO_MANY

    def table_class(self, table: str) -> str:
        targets = {e.parent for e in self.outgoing(table)}
        if not targets:
            return PRIMARY_ENTITY
        return JUNCTION_TABLE if len(targets) > 1 else CHILD_ENTITY

    def nest_field(self, edge: Edge) -> str:
        """The field a child is nested under: the child's name, or with its key when several
        keys of that child point to the same parent."""
        rivals = [e for e in self.incoming(edge.parent) if e.child == edge.child]
        return f"{edge.child}_by_{edge.fk}" if len(rivals) > 1 else edge.child

    def between(self, child: str, parent: str, fk: str | None = None) -> Edge:
        """The edge a pattern reads. ``fk`` is needed when the child has several keys to the
        parent; with no declared edge the key defaults to ``<parent>_id``."""
        found = [e for e in self.edges if e.child == child and e.parent == parent]
        if fk is not None:
            named = [e for e in found if e.fk == fk]
            return named[0] if named else Edge(child, fk, parent, self.spec(parent).pk[0])
        if len(found) > 1:
            raise PlanError(f"{child} has several keys to {parent}: name one with fk=")
        if found:
            return found[0]
        return Edge(child, f"{parent.lower()}_id", parent, self.spec(parent).pk[0])


def _pair(key: Any) -> tuple[str, str]:
    if isinstance(key, str):
        left, dot, right = key.partition(".")
        if not dot:
            raise PlanError(f"a strategy key reads 'child.parent', not {key!r}")
        return left, right
    return tuple(key)


@dataclass
class Settings:
    """What to nest, what to reference, and which patterns to apply to which table."""

    strategies: Mapping[Any, str] = field(default_factory=dict)
    default_strategy: str = EMBED
    max_children: int = DEFAULT_MAX_CHILDREN
    patterns: Mapping[str, Sequence[Any]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.strategies = {_pair(k): v for k, v in dict(self.strategies).items()}
        for value in (*self.strategies.values(), self.default_strategy):
            if value not in (EMBED, REFERENCE):
                raise PlanError(f"unknown strategy {value!r}")
        if self.max_children < 0:
            raise PlanError("max_children must not be negative")
