"""Writing document datasets, one folder per dataset, and reading them back."""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from docnest.functions.columns import as_type, column
from docnest.functions.naming import dataset_name
from docnest.functions.values import stored_type
from docnest.plans.model import PlanError


#: Datasets written at the same time.
SIDE_BY_SIDE = 4
# JSON repeats every field name in every nested row, which the fastest level takes out at little cost; Parquet is compressed anyway.
JSON_OPTIONS = {"ignoreNullFields": "false", "compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def stored(df: DataFrame) -> DataFrame:
    """The frame in its stored types: decimals become doubles at every depth."""
    return df.select(
        *[as_type(column(f.name), f.dataType, stored_type(f.dataType)).alias(f.name) for f in df.schema.fields]
    )


def dataset_path(folder: str, table: str) -> str:
    return f"{folder.rstrip('/')}/{dataset_name(table)}"


def remove_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def check_names(tables: Mapping[str, DataFrame]) -> None:
    taken: dict[str, str] = {}
    for table in tables:
        other = taken.setdefault(dataset_name(table), table)
        if other != table:
            raise PlanError(f"{table} and {other} would both be written as {dataset_name(table)}")


def write_documents(
    spark: SparkSession,
    documents: Mapping[str, DataFrame],
    folder: str,
    source: str = "json",
    sources: Mapping[str, DataFrame] | None = None,
    options: Mapping[str, str] | None = None,
) -> list[str]:
    """Replace one dataset per table and return the tables written.

    A table without rows leaves no dataset. Nulls are written out, and JSON is compressed with gzip: Spark's readers take it as it
    is, ``options={"compression": "none"}`` leaves plain text. ``sources`` gives, per table, a
    cheaper frame that is empty exactly when the documents are (the plain table).
    """
    check_names(documents)

    def write(table: str) -> bool:
        path = dataset_path(folder, table)
        if (sources or documents)[table].isEmpty():
            remove_folder(spark, path)
            return False
        writer = stored(documents[table]).write.mode("overwrite").format(source)
        if source == "json":
            writer = writer.options(**JSON_OPTIONS)
        writer.options(**(options or {})).save(path)
        return True

    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:  # each dataset is a job of its own
        return [table for table, done in zip(documents, list(pool.map(write, documents)), strict=True) if done]


def write_collections(documents: Mapping[str, DataFrame], database: str, options: Mapping[str, str]) -> None:
    """The same through the MongoDB Spark connector, where its jar is on the class path."""
    check_names(documents)
    for table, frame in documents.items():
        if frame.isEmpty():
            continue
        writer = stored(frame).write.format("mongodb").mode("overwrite").options(**options)
        writer.option("database", database).option("collection", dataset_name(table)).save()


def read_documents(
    spark: SparkSession, folder: str, documents: Mapping[str, DataFrame], source: str = "json"
) -> dict[str, DataFrame]:
    """Written datasets by table, in the schema they were written with."""
    found = {}
    for table, frame in documents.items():
        reader = spark.read.schema(stored(frame).schema).format(source)
        found[table] = reader.load(dataset_path(folder, table))
    return found
