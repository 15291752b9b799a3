"""Reconciliation and overviews, each as a small frame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docnest.functions.columns import column, find_name
from docnest.functions.naming import dataset_name
from docnest.operators.profile import column_profile, edge_cardinality, edge_profile
from docnest.plans.migrate import Migration
from docnest.plans.model import EMBED, Catalogue
from docnest.plans.resolve import NestingPlan
from docnest.sources.tables import as_json, row_counts, shortened, union_all


def migration_summary(migration: Migration, written: Mapping[str, DataFrame]) -> DataFrame:
    """Per table: rows read, rows nested into parents, rows no parent takes, documents written.

    Nested and orphaned rows are summed over the table's nested edges; ``written`` holds the
    datasets as read back. Documents are null for a table without a dataset of its own.
    """
    plan = migration.plan
    read = row_counts(migration.raw).withColumnRenamed("row_count", "rows_read")
    counted = union_all(
        [
            row_counts({t: written[t]}).withColumnRenamed("row_count", "docs_written")
            if t in written
            else row_counts({t: migration.raw[t].limit(0)}).select("table_name", F.lit(None).cast("bigint").alias("docs_written"))
            for t in migration.raw
        ]
    )
    summary = read.join(counted, "table_name")
    nested = [e for e in plan.catalogue.edges if plan.strategies[e] == EMBED]
    if not nested:
        return summary.select(
            "table_name", "rows_read", F.lit(0).cast("bigint").alias("rows_nested"),
            F.lit(0).cast("bigint").alias("rows_orphaned"), "docs_written",
        )
    edges = edge_profile(migration.raw, Catalogue(plan.catalogue.tables, nested))
    orphaned = F.col("null_key_rows") + F.col("orphan_rows")
    per_child = edges.groupBy(F.col("child").alias("table_name")).agg(
        F.sum(F.col("child_rows") - orphaned).alias("rows_nested"), F.sum(orphaned).alias("rows_orphaned")
    )
    return summary.join(per_child, "table_name", "left").select(
        "table_name",
        "rows_read",
        F.coalesce("rows_nested", F.lit(0)).alias("rows_nested"),
        F.coalesce("rows_orphaned", F.lit(0)).alias("rows_orphaned"),
        "docs_written",
    )


def source_overview(tables: Mapping[str, DataFrame], catalogue: Catalogue) -> DataFrame:
    """Per table: class, rows, columns, foreign keys."""
    frames = [
        row_counts({t: tables[t]}).select(
            "table_name",
            F.lit(catalogue.table_class(t)).alias("table_class"),
            "row_count",
            F.lit(len(tables[t].columns)).alias("column_count"),
            F.lit(len(catalogue.outgoing(t))).alias("fk_count"),
        )
        for t in catalogue.tables
    ]
    return union_all(frames)


def column_overview(spark: SparkSession, tables: Mapping[str, DataFrame], catalogue: Catalogue) -> DataFrame:
    """Per column: type, primary key, nullable."""
    profile = column_profile(spark, tables, catalogue)
    return profile.select("table_name", "position", "column_name", "type", "is_pk", "is_nullable")


def relationship_map(tables: Mapping[str, DataFrame], plan: NestingPlan) -> DataFrame:
    """Per key: declared and observed cardinality, and the resolved strategy."""
    edges = plan.catalogue.edges
    strategy = F.lit(None).cast("string")
    for e in edges:
        same = (F.col("child") == e.child) & (F.col("parent") == e.parent) & (F.col("fk") == e.fk)
        strategy = F.when(same, F.lit(plan.strategies[e])).otherwise(strategy)
    profile = edge_cardinality(tables, Catalogue(plan.catalogue.tables, edges))
    return profile.select("child", "fk", "parent", "declared", "observed", "max_children", strategy.alias("strategy"))


def target_overview(
    spark: SparkSession, written: Mapping[str, DataFrame], n: int = 5, keys: Mapping[str, Sequence[str]] | None = None, max_bytes: int | None = None
) -> DataFrame:
    """Per written dataset: its documents and up to ``n`` of them as JSON, each of at most ``max_bytes``.

    The samples are the first by ``keys`` (per table; columns that are not there do not count), or any without. Nothing goes through the driver.
    """
    frames = []
    for table, frame in written.items():
        order = [column(found) for k in (keys or {}).get(table, ()) if (found := find_name(frame, k))]
        first = (frame.orderBy(*order) if order else frame).limit(n)
        rows = first.select(*[c.alias(f"__key_{i}") for i, c in enumerate(order)], *shortened(as_json(frame), max_bytes))
        sorted_rows = F.sort_array(F.collect_list(F.struct(*[c for c in rows.columns if c != "n_bytes"])))
        samples = rows.agg(F.transform(sorted_rows, lambda r: r["row_json"]).alias("samples"))
        name = F.lit(dataset_name(table)).alias("dataset")
        total = frame.agg(F.count(F.lit(1)).alias("documents"))
        frames.append(total.select(name, "documents").join(samples.select(name, "samples"), "dataset"))
    return union_all(frames)
