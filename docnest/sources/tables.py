"""Table scans, caller SQL, row counts and samples."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docnest.functions.columns import column
from docnest.plans.model import Catalogue


def read_tables(
    spark: SparkSession, folder: str, names: Iterable[str], source: str = "parquet", suffix: str = ".parquet"
) -> dict[str, DataFrame]:
    """One lazy frame per table file or folder under ``folder``."""
    return {n: spark.read.format(source).load(f"{folder.rstrip('/')}/{n}{suffix}") for n in names}


def sql_rows(spark: SparkSession, tables: Mapping[str, DataFrame], query: str) -> DataFrame:
    """A caller's SQL over the tables, by their names; column aliases are kept."""
    mine = {n.lower() for n in tables}
    views = {v.name for v in spark.catalog.listTables() if v.isTemporary and v.name in mine}
    before = {n: spark.table(n) for n in tables if n.lower() in views}
    for name, frame in tables.items():
        frame.createOrReplaceTempView(name)
    try:
        return spark.sql(query)
    finally:  # the query is resolved; the caller's own views come back
        for name in tables:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table; Parquet answers these from its footers."""
    return union_all(
        t.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
        for n, t in tables.items()
    )


def _up_to_nth(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The rows that can be among the first ``n``. The n-th key comes from a scan of the key
    columns alone; the filter then lets the full scan skip most row groups."""
    first = df.select(*[column(k) for k in keys]).orderBy(*[column(k) for k in keys]).limit(n).tail(1)
    bound = first[0][0] if first else None
    return df if bound is None else df.filter(column(keys[0]).isNull() | (column(keys[0]) <= F.lit(bound)))


def as_json(frame: DataFrame) -> Column:
    """A row as JSON, with explicit nulls."""
    return F.to_json(F.struct(*[column(c) for c in frame.columns]), {"ignoreNullFields": "false"})


def shortened(text: Column, max_bytes: int | None) -> list[Column]:
    """row_json, at most so many bytes of it (``max_bytes`` None: all), and n_bytes: how many there are."""
    size = F.octet_length(text).cast("bigint")
    # a character has at most four bytes
    kept = text if max_bytes is None else F.when(size > max_bytes, F.substr(text, F.lit(1), F.lit(max(1, max_bytes // 4)))).otherwise(text)
    return [kept.alias("row_json"), size.alias("n_bytes")]


def sample_rows(tables: Mapping[str, DataFrame], catalogue: Catalogue, n: int = 5, max_bytes: int | None = None) -> DataFrame:
    """The first ``n`` rows of each table in primary-key order, as JSON with explicit nulls: table_name, row_json, n_bytes.

    ``max_bytes`` bounds what is returned of a row; n_bytes tells its whole size.
    """
    frames = []
    for name, frame in tables.items():
        keys = catalogue.spec(name).pk
        first = _up_to_nth(frame, keys, n).orderBy(*[column(k) for k in keys]).limit(n)
        frames.append(first.select(F.lit(name).alias("table_name"), *shortened(as_json(frame), max_bytes)))
    return union_all(frames)
