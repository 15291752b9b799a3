"""Relational databases through Spark's JDBC source, and their catalogue."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docnest.plans.model import Catalogue, Edge, PlanError, TableSpec

# Name prefixes and names of system tables that are never migrated.
SYSTEM_PREFIXES = ("pg_", "sql_")
SYSTEM_TABLES = ("system_columns",)


def jdbc_options(
    url: str,
    table: str | None = None,
    query: str | None = None,
    column: str | None = None,
    bounds: tuple[Any, Any] | None = None,
    partitions: int | None = None,
    properties: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Reader options; ``column``, ``bounds`` and ``partitions`` split the scan over the cluster."""
    if (table is None) == (query is None):
        raise PlanError("name a table or a query, not both")
    options = {"url": url, **({"dbtable": table} if table else {"query": query}), **(properties or {})}
    split = (column, bounds, partitions)
    if any(s is not None for s in split):
        if any(s is None for s in split) or query is not None:
            raise PlanError("a split scan needs a table, a column, bounds and a number of partitions")
        options |= {
            "partitionColumn": column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def read_jdbc(spark: SparkSession, **kwargs: Any) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(**kwargs)).load()


def user_tables(tables: DataFrame) -> DataFrame:
    """``information_schema.tables`` (table_name, table_type) without system tables and views."""
    kept = F.upper("table_type").isin("BASE TABLE", "TABLE")
    for prefix in SYSTEM_PREFIXES:
        kept &= ~F.col("table_name").startswith(prefix)
    return tables.filter(kept & ~F.col("table_name").isin(*SYSTEM_TABLES)).select("table_name")


def catalogue_of(table_names: Iterable[str], keys: DataFrame, references: DataFrame) -> Catalogue:
    """Keys and edges out of two catalogue frames; both hold one row per key column.

    ``keys``: table_name, constraint_name, constraint_type, column_name, ordinal_position.
    ``references``: table_name, column_name, parent_table, parent_column, ordinal_position.
    """
    names = list(table_names)
    grouped = (
        keys.filter(F.col("constraint_type").isin("PRIMARY KEY", "UNIQUE"))
        .groupBy("table_name", "constraint_name", "constraint_type")
        .agg(F.sort_array(F.collect_list(F.struct("ordinal_position", "column_name"))).alias("columns"))
        .orderBy("table_name", "constraint_name")
    )
    primary: dict[str, tuple[str, ...]] = {}
    unique: dict[str, list[str]] = {}
    for row in grouped.collect():  # one row per declared key of the database
        columns = tuple(c["column_name"] for c in row["columns"])
        if row["constraint_type"] == "PRIMARY KEY":
            primary[row["table_name"]] = columns
        elif len(columns) == 1:
            unique.setdefault(row["table_name"], []).append(columns[0])
    missing = [n for n in names if n not in primary]
    if missing:
        raise PlanError(f"no primary key declared for {', '.join(missing)}")
    specs = [TableSpec(n, primary[n], tuple(unique.get(n, ()))) for n in names]
    found = references.filter(F.col("table_name").isin(names) & F.col("parent_table").isin(names))
    by_table: dict[str, list[Edge]] = {}
    for r in found.orderBy("ordinal_position").collect():  # one row per foreign-key column
        by_table.setdefault(r["table_name"], []).append(
            Edge(r["table_name"], r["column_name"], r["parent_table"], r["parent_column"])
        )
    return Catalogue.of(specs, [e for n in names for e in by_table.get(n, [])])


# Standard information-schema queries behind the two catalogue frames.
KEYS_QUERY = """
SELECT c.table_name, c.constraint_name, c.constraint_type, k.column_name, k.ordinal_position
FROM information_schema.table_constraints c
JOIN information_schema.key_column_usage k
  ON k.constraint_schema = c.constraint_schema AND k.constraint_name = c.constraint_name
 AND k.table_name = c.table_name
WHERE c.constraint_type IN ('PRIMARY KEY', 'UNIQUE') AND c.table_schema = '{schema}'
"""

REFERENCES_QUERY = """
SELECT f.table_name, f.column_name, p.table_name AS parent_table, p.column_name AS parent_column,
       col.ordinal_position
FROM information_schema.referential_constraints r
JOIN information_schema.key_column_usage f
  ON f.constraint_schema = r.constraint_schema AND f.constraint_name = r.constraint_name
JOIN information_schema.key_column_usage p
  ON p.constraint_schema = r.unique_constraint_schema AND p.constraint_name = r.unique_constraint_name
 AND p.ordinal_position = f.position_in_unique_constraint
JOIN information_schema.columns col
  ON col.table_schema = f.table_schema AND col.table_name = f.table_name AND col.column_name = f.column_name
WHERE f.table_schema = '{schema}'
"""


def read_database(
    spark: SparkSession,
    url: str,
    schema: str,
    splits: Mapping[str, tuple[str, tuple[Any, Any], int]] | None = None,
    properties: Mapping[str, str] | None = None,
) -> tuple[dict[str, DataFrame], Catalogue]:
    """Every user table of a schema and its declared keys. ``splits`` maps a table to the column,
    bounds and partitions of a parallel scan."""

    def ask(query: str) -> DataFrame:
        return read_jdbc(spark, url=url, query=query, properties=properties)

    listed = ask(f"SELECT table_name, table_type FROM information_schema.tables WHERE table_schema = '{schema}'")
    names = sorted(r["table_name"] for r in user_tables(listed).collect())
    catalogue = catalogue_of(
        names, ask(KEYS_QUERY.format(schema=schema)), ask(REFERENCES_QUERY.format(schema=schema))
    )
    tables = {}
    for name in names:
        column, bounds, partitions = (splits or {}).get(name, (None, None, None))
        tables[name] = read_jdbc(
            spark, url=url, table=f"{schema}.{name}", column=column, bounds=bounds, partitions=partitions,
            properties=properties,
        )
    return tables, catalogue
