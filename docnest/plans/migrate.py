"""From tables and settings to one lazy document frame per table, and on to written datasets."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from docnest.functions.columns import has_column
from docnest.functions.naming import dataset_name
from docnest.operators.nest import embed_junction, embed_many, embed_one
from docnest.operators.patterns import ATTRIBUTE, COMPUTED, OUTLIER, PATTERN_ORDER, Computed, PatternContext, apply_patterns
from docnest.operators.profile import fan_outs
from docnest.plans.model import MANY_TO_MANY, ONE_TO_MANY, ONE_TO_ONE, Catalogue, Edge, PlanError, Settings
from docnest.plans.resolve import NestingPlan, edges_to_measure, resolve
from docnest.session import size_shuffles
from docnest.sinks.documents import dataset_path, remove_folder, write_documents
from docnest.sinks.versions import Version, replace_documents
from docnest.sources.normalise import normalise_all


@dataclass
class Migration:
    """The resolved plan, the normalised tables, and every table's documents (lazy)."""

    plan: NestingPlan
    raw: dict[str, DataFrame]
    documents: dict[str, DataFrame]

    @property
    def datasets(self) -> dict[str, DataFrame]:
        """Documents of the tables that get a dataset of their own."""
        return {t: self.documents[t] for t in self.plan.written}

    def _plain(self) -> dict[str, DataFrame]:
        # a custom pattern may add or drop documents; without one the plain table is empty when they are
        custom = {t for t, ps in self.plan.settings.patterns.items() if any(p.kind not in PATTERN_ORDER for p in ps)}
        return {t: self.documents[t] if t in custom else self.raw[t] for t in self.raw}

    def write(
        self, spark: SparkSession, folder: str, source: str = "json", options: Mapping[str, str] | None = None
    ) -> list[str]:
        """Replace the datasets in ``folder`` one by one; those of tables that are only nested now are removed."""
        written = write_documents(spark, self.datasets, folder, source, self._plain(), options)
        kept = {dataset_name(t) for t in written}
        for table in self.raw:
            if dataset_name(table) not in kept:
                remove_folder(spark, dataset_path(folder, table))
        return written

    def replace(
        self, spark: SparkSession, folder: str, source: str = "json", options: Mapping[str, str] | None = None, keep: int = 1
    ) -> Version:
        """Replace the set in ``folder`` as a whole, see :func:`docnest.sinks.versions.replace_documents`."""
        return replace_documents(spark, self.datasets, folder, source, self._plain(), options, keep)


def nest_field(catalogue: Catalogue, edge: Edge) -> str:
    """Junction rows go under the parent's own name, other children under theirs, unless the edge names a field."""
    if edge.field:
        return edge.field
    return edge.parent if catalogue.cardinality(edge) == MANY_TO_MANY else catalogue.nest_field(edge)


def touched_columns(plan: NestingPlan, table: str) -> set[str] | None:
    """Raw columns of a table that its own nests and patterns may replace; ``None`` if unknown."""
    names = {nest_field(plan.catalogue, e).lower() for e in plan.embedded_into(table)}
    for p in plan.settings.patterns.get(table, ()):
        changed = p.touched()
        if changed is None:
            return None
        names |= changed
    return names


def _shared_totals(plan: NestingPlan, edge: Edge, df: DataFrame) -> list[Computed]:
    """Counts and sums over the very rows this edge nests: they ride along in its aggregate, so
    the child is shuffled once. Only where nesting and the raw table agree on the columns read,
    and where the order of fields set cannot show."""
    child_changes = touched_columns(plan, edge.child)
    if child_changes is None or edge.fk.lower() in child_changes:
        return []
    patterns = plan.settings.patterns.get(edge.parent, ())
    busy = {nest_field(plan.catalogue, e).lower() for e in plan.embedded_into(edge.parent)}
    for p in patterns:
        if p.kind == ATTRIBUTE:
            busy |= p.touched()
    shared = []
    for p in patterns:
        if p.kind != COMPUTED or p.child != edge.child or edge.pk.lower() in busy:
            continue
        if plan.catalogue.between(p.child, edge.parent, p.fk) != edge:
            continue
        if (p.column or "").lower() in child_changes and p.function.upper() != "COUNT":
            continue
        if p.field.lower() not in busy and not has_column(df, p.field):
            shared.append(p)
    fields = [p.field.lower() for p in shared]
    return shared if len(set(fields)) == len(fields) else []


def _nest(plan: NestingPlan, edge: Edge, df: DataFrame, child: DataFrame, shared: list[Computed]) -> DataFrame:
    catalogue = plan.catalogue
    child_pk = catalogue.spec(edge.child).pk
    cardinality = catalogue.cardinality(edge)
    field = nest_field(catalogue, edge)
    changes = touched_columns(plan, edge.child)
    same_keys = changes is not None and edge.fk.lower() not in changes
    measured = plan.fan_out.get(edge) if same_keys else None
    if cardinality == ONE_TO_ONE:
        unique = measured is not None and measured <= 1
        return embed_one(df, child, pk=edge.pk, fk=edge.fk, field=field, child_pk=child_pk, proven_unique=unique)
    limits = {"max_children": plan.settings.max_children, "measured": measured}
    if cardinality == MANY_TO_MANY:
        others = [e.fk for e in catalogue.outgoing(edge.child) if e != edge and not e.is_self]
        return embed_junction(
            df, child, pk=edge.pk, fk=edge.fk, other_fks=others, field=field, child_pk=child_pk, **limits
        )
    return embed_many(df, child, pk=edge.pk, fk=edge.fk, field=field, child_pk=child_pk, totals=shared, **limits)


def _check_fields(plan: NestingPlan, raw: Mapping[str, DataFrame], table: str) -> None:
    """Every nest has a field of its own: not a column of the table, not another nest's, and no two flags are one."""
    fields: dict[str, str] = {}
    for edge in plan.embedded_into(table):
        field = nest_field(plan.catalogue, edge).lower()
        if has_column(raw[table], field):
            raise PlanError(f"{edge.label} would replace the column {field} of {table}: name a field for the edge")
        if field in fields:
            raise PlanError(f"{edge.label} and {fields[field]} would both be {field} of {table}: name a field for one of the edges")
        fields[field] = edge.label
    flags = [p.flag.lower() for p in plan.settings.patterns.get(table, ()) if p.kind == OUTLIER]
    if len(set(flags)) < len(flags):
        raise PlanError(f"two capped arrays of {table} share a flag: name another with flag")


def _documents(plan: NestingPlan, raw: Mapping[str, DataFrame], stage_folder: str | None) -> dict[str, DataFrame]:
    documents: dict[str, DataFrame] = {}
    for table in plan.order:
        _check_fields(plan, raw, table)
        df = raw[table]
        patterns = list(plan.settings.patterns.get(table, ()))
        nests = plan.embedded_into(table)
        for edge in nests:
            shared = []
            if plan.catalogue.cardinality(edge) == ONE_TO_MANY:
                shared = _shared_totals(plan, edge, df)
            df = _nest(plan, edge, df, documents[edge.child], shared)
            patterns = [p for p in patterns if p not in shared]
        df = apply_patterns(df, patterns, PatternContext(table, raw, plan.catalogue, plan.fan_out))
        uses = sum(plan.strategies[e] == "EMBED" for e in plan.catalogue.outgoing(table)) + plan.is_written(table)
        if stage_folder and uses > 1 and (nests or patterns):
            df = _staged(df, f"{stage_folder.rstrip('/')}/{table}")
        documents[table] = df
    return documents


def _staged(df: DataFrame, path: str) -> DataFrame:
    """A table written once and read by each of its users; also cuts the lineage."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plan_for(tables: Mapping[str, DataFrame], catalogue: Catalogue, settings: Settings) -> NestingPlan:
    """Measure the fan-out of the edges to nest, in one job, and resolve the strategies."""
    missing = [t for t in catalogue.tables if t not in tables]
    if missing:
        raise PlanError(f"no data for {', '.join(missing)}")
    lost = [e.label for e in catalogue.edges if not has_column(tables[e.child], e.fk) or not has_column(tables[e.parent], e.pk)]
    if lost:
        raise PlanError(f"no such key column: {', '.join(lost)}")
    return resolve(catalogue, settings, fan_outs(tables, edges_to_measure(catalogue, settings)))


def migrate(
    tables: Mapping[str, DataFrame],
    catalogue: Catalogue,
    settings: Settings | None = None,
    json_columns: Mapping[str, Mapping[str, object]] | None = None,
    stage_folder: str | None = None,
) -> Migration:
    """Plan the documents of every table of the catalogue.

    ``stage_folder`` (in storage all executors share) makes a transformed table that is needed
    more than once - nested into several parents, or nested and written - be computed once. The session's initial
    number of shuffle partitions is raised to fit the largest table (:func:`docnest.session.size_shuffles`).
    """
    settings = settings or Settings()
    for frame in list(tables.values())[:1]:
        size_shuffles(frame.sparkSession, tables.values())
    raw = normalise_all({t: tables[t] for t in catalogue.tables if t in tables}, json_columns)
    plan = plan_for(raw, catalogue, settings)
    return Migration(plan, raw, _documents(plan, raw, stage_folder))
