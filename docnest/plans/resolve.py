"""Decides, per edge, whether children are nested or referenced, and in which order.

Works on a handful of table names on the driver. The only data it needs is the largest number of
children per parent of each edge, which a Spark job measures.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from docnest.plans.model import EMBED, ONE_TO_ONE, REFERENCE, Catalogue, Edge, PlanError, Settings


@dataclass
class NestingPlan:
    catalogue: Catalogue
    settings: Settings
    strategies: dict[Edge, str]
    order: list[str]
    fan_out: dict[Edge, int]
    notes: list[str] = field(default_factory=list)

    def embedded_into(self, parent: str) -> list[Edge]:
        return [e for e in self.catalogue.incoming(parent) if self.strategies[e] == EMBED]

    def is_written(self, table: str) -> bool:
        """A table keeps its own dataset unless every one of its edges is nested elsewhere."""
        edges = self.catalogue.outgoing(table)
        return not edges or any(self.strategies[e] == REFERENCE for e in edges)

    @property
    def written(self) -> list[str]:
        return [t for t in self.catalogue.tables if self.is_written(t)]


class _Choices:
    """Strategy per (child, parent), looked up in either direction."""

    def __init__(self, settings: Settings) -> None:
        self.chosen = dict(settings.strategies)
        self.default = settings.default_strategy

    def get(self, child: str, parent: str) -> str:
        for key in ((child, parent), (parent, child)):
            if key in self.chosen:
                return self.chosen[key]
        return self.default

    def reference(self, child: str, parent: str) -> None:
        self.chosen[(child, parent)] = REFERENCE


def _nested_cycle(catalogue: Catalogue, choices: _Choices) -> list[str] | None:
    """The first cycle met along nested edges, starting at the table where it closes."""
    finished: set[str] = set()

    def walk(table: str, trail: list[str]) -> list[str] | None:
        for edge in catalogue.outgoing(table):
            if choices.get(edge.child, edge.parent) == REFERENCE or edge.parent in finished:
                continue
            if edge.parent in trail:
                return trail[trail.index(edge.parent) :]
            found = walk(edge.parent, [*trail, edge.parent])
            if found:
                return found
        finished.add(table)
        return None

    for table in catalogue.tables:
        if table not in finished:
            found = walk(table, [table])
            if found:
                return found
    return None


def _children_first(catalogue: Catalogue, nested: list[Edge]) -> list[str]:
    waiting = {t: {e.child for e in nested if e.parent == t and not e.is_self} for t in catalogue.tables}
    order: list[str] = []
    while waiting:
        ready = [t for t, children in waiting.items() if not children]
        if not ready:
            raise PlanError("nested edges still form a cycle")
        order += ready
        waiting = {t: children - set(ready) for t, children in waiting.items() if t not in ready}
    return order


def _before_limit(catalogue: Catalogue, settings: Settings) -> tuple[_Choices, list[str]]:
    """Configured strategies, with self references and cycles made references."""
    choices = _Choices(settings)
    notes: list[str] = []
    for edge in catalogue.edges:
        if edge.is_self:
            choices.reference(edge.child, edge.parent)
    while cycle := _nested_cycle(catalogue, choices):
        closed = [*cycle, cycle[0]]
        choices.reference(closed[0], closed[1])
        notes.append(f"cycle {' -> '.join(closed)}: {closed[0]}.{closed[1]} becomes {REFERENCE}")
    return choices, notes


def edges_to_measure(catalogue: Catalogue, settings: Settings) -> list[Edge]:
    """The edges that would be nested, and so need their fan-out checked."""
    choices, _ = _before_limit(catalogue, settings)
    return [e for e in catalogue.edges if choices.get(e.child, e.parent) == EMBED]


def resolve(catalogue: Catalogue, settings: Settings, fan_out: Mapping[Edge, int]) -> NestingPlan:
    """One resolved plan that both nesting and writing follow. ``fan_out`` covers at least the
    edges of :func:`edges_to_measure`."""
    choices, notes = _before_limit(catalogue, settings)

    for edge in edges_to_measure(catalogue, settings):
        if catalogue.cardinality(edge) == ONE_TO_ONE:
            continue
        if fan_out[edge] > settings.max_children:
            choices.reference(edge.child, edge.parent)
            notes.append(f"{edge.label}: {fan_out[edge]} children under one parent, becomes {REFERENCE}")

    for table, patterns in settings.patterns.items():
        catalogue.spec(table)
        for pattern in patterns:
            for child in pattern.capped_children():
                if choices.get(child, table) == EMBED:
                    raise PlanError(f"a capped array of {child} in {table} needs strategy {child}.{table}=REFERENCE")

    strategies = {e: choices.get(e.child, e.parent) for e in catalogue.edges}
    order = _children_first(catalogue, [e for e, s in strategies.items() if s == EMBED])
    return NestingPlan(catalogue, settings, strategies, order, dict(fan_out), notes)
