"""The sample tables: how to load them, their columns, keys and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docnest import Catalogue, Edge, TableSpec
from docnest.session import size_shuffles
from docnest.sources.tables import read_tables

COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
        " o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
        " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
        " l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    ),
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

KEYS = {
    "region": "r_regionkey",
    "nation": "n_nationkey",
    "customer": "c_custkey",
    "supplier": "s_suppkey",
    "part": "p_partkey",
    "orders": "o_orderkey",
    "lineitem": ("l_orderkey", "l_linenumber"),
    "events": "event_id",
    "documents": "doc_id",
    "labels": "doc_id",
    "embeddings": "vec_id",
    "pages": "page_id",
    "benchmark": "item_id",
    "conversations": ("conv_id", "turn"),
}

#: Lines repeat a number within an order; these keys tell all rows apart.
WHOLE_KEYS = {**KEYS, "lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")}

EDGES = (
    Edge("nation", "n_regionkey", "region", "r_regionkey"),
    Edge("customer", "c_nationkey", "nation", "n_nationkey"),
    Edge("supplier", "s_nationkey", "nation", "n_nationkey"),
    Edge("orders", "o_custkey", "customer", "c_custkey"),
    Edge("lineitem", "l_orderkey", "orders", "o_orderkey"),
    Edge("lineitem", "l_partkey", "part", "p_partkey"),
    Edge("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    Edge("labels", "doc_id", "documents", "doc_id"),
    Edge("events", "user_id", "customer", "c_custkey"),
)

CATALOGUE = Catalogue.of([TableSpec(t, k) for t, k in KEYS.items()], EDGES)


def columns_of(table: str) -> list[tuple[str, str]]:
    return [tuple(c.strip().split(" ", 1)) for c in COLUMNS[table].split(", ")]


def load(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    """Lazy frames of the named tables (all of them by default), with zone-less times read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    tables = read_tables(spark, folder, names or tuple(COLUMNS))
    size_shuffles(spark, tables.values())
    return tables


def part_of(*names: str) -> Catalogue:
    """The catalogue restricted to some tables and the edges between them."""
    kept = [e for e in EDGES if e.child in names and e.parent in names]
    return Catalogue.of([CATALOGUE.tables[n] for n in names], kept)
