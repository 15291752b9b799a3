"""Replacing a whole set of datasets at once: versions side by side, and a manifest that says which one counts.

Every write goes to a folder of its own. Only when all its datasets are there a manifest is added under the next number, and readers
follow the highest one that is complete, so they see all of the old set or all of the new one; a failed write leaves the old one.
Datasets that the new set does not have are gone with it. Manifests are only ever added (never replaced), which is enough on
stores without a rename; of two writers at once the later one fails and leaves nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from docnest.functions.naming import dataset_name
from docnest.plans.model import PlanError
from docnest.sinks.documents import dataset_path, remove_folder, stored, write_documents

MANIFESTS = "_versions"


@dataclass(frozen=True)
class Version:
    """A committed set: its number, folder (under the target), format, and the schema of each table's dataset."""

    number: int
    folder: str
    source: str
    schemas: dict[str, T.StructType]

    def text(self) -> str:
        schemas = {t: s.jsonValue() for t, s in self.schemas.items()}
        return json.dumps({"number": self.number, "folder": self.folder, "source": self.source, "schemas": schemas})

    @classmethod
    def of(cls, text: str) -> Version | None:
        """None for a manifest whose writer did not come to its end."""
        try:
            made = json.loads(text)
            return cls(made["number"], made["folder"], made["source"], {t: T.StructType.fromJson(s) for t, s in made["schemas"].items()})
        except (ValueError, KeyError):
            return None


class _Store:
    """The target folder through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm = spark._jvm
        self.root = folder.rstrip("/")
        self.files = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.files.listStatus(self.path(name))) if self.files.exists(self.path(name)) else []

    def read(self, name: str) -> str:
        stream = self.files.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def add(self, name: str, text: str) -> None:
        """A new file; an error if there is one of this name."""
        out = self.files.create(self.path(name), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def remove(self, name: str) -> None:
        self.files.delete(self.path(name), True)


def _manifests(store: _Store) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in store.names(MANIFESTS) if n.endswith(".json"))


def current(spark: SparkSession, folder: str) -> Version | None:
    """The newest complete version; None before the first."""
    store = _Store(spark, folder)
    for number in reversed(_manifests(store)):
        found = Version.of(store.read(f"{MANIFESTS}/{number:012d}.json"))
        if found:
            return found
    return None


def replace_documents(
    spark: SparkSession,
    documents: Mapping[str, DataFrame],
    folder: str,
    source: str = "json",
    sources: Mapping[str, DataFrame] | None = None,
    options: Mapping[str, str] | None = None,
    keep: int = 1,
) -> Version:
    """Write a set of datasets and let it take the place of the one before; ``keep`` earlier versions stay for those who read them.

    Arguments as of :func:`docnest.sinks.documents.write_documents`; a table without rows has no dataset.
    """
    store = _Store(spark, folder)
    number = max(_manifests(store), default=0) + 1
    mine = f"data-{number:012d}-{uuid.uuid4().hex}"
    try:
        written = write_documents(spark, documents, f"{store.root}/{mine}", source, sources, options)
        version = Version(number, mine, source, {t: stored(documents[t]).schema for t in written})
        try:
            store.add(f"{MANIFESTS}/{number:012d}.json", version.text())
        except Exception as error:  # the file systems have exceptions of their own
            raise PlanError(f"{folder}: another writer has committed version {number}") from error
    except BaseException:
        remove_folder(spark, f"{store.root}/{mine}")
        raise
    for name in store.names(""):
        if name.startswith("data-") and int(name.split("-")[1]) < number - keep:
            store.remove(name)
    for old in _manifests(store):
        if old < number - keep:
            store.remove(f"{MANIFESTS}/{old:012d}.json")
    return version


def dataset_folder(version: Version, folder: str, table: str) -> str:
    return dataset_path(f"{folder.rstrip('/')}/{version.folder}", table)


def read_current(spark: SparkSession, folder: str, version: Version | None = None) -> dict[str, DataFrame]:
    """The datasets of the current (or a given) version by table, in the schema they were written with."""
    version = version or current(spark, folder)
    if version is None:
        raise PlanError(f"{folder}: nothing has been committed")
    return {t: spark.read.schema(s).format(version.source).load(dataset_folder(version, folder, t)) for t, s in version.schemas.items()}


def dataset_names(version: Version) -> list[str]:
    return sorted(dataset_name(t) for t in version.schemas)
