"""Helpers the operators share: written tables between jobs, words, and the hash of words and shingles."""

from __future__ import annotations

import ctypes
import gc
import io
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docnest.session import shared_folder, size_shuffles, tasks_for

#: White space between words; a word is a longest run of anything else.
SPACES = " \t\n\x0b\x0c\r"
#: The same as a regular expression of Java.
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


#: Spark's own limit.
MOST_BUCKETS = 100_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later jobs start from files, not from lineage.

    The folder goes when the driver's JVM ends, or earlier with :func:`discard`.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    df.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)


def bucketed(df: DataFrame, column: str, name: str) -> DataFrame:
    """Like :func:`stored`, and dealt out by ``column``: later joins on it do not shuffle the table again. There are as many buckets as the
    session has shuffle partitions, or as the planner's size of ``df`` asks for."""
    spark = df.sparkSession
    folder, n = shared_folder(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(n, min(MOST_BUCKETS, tasks_for([df])))
    entry = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    df.repartition(n, column).write.format("parquet").option("path", folder).bucketBy(n, column).saveAsTable(entry)
    table = spark.table(entry).select("*")
    spark.sql(f"DROP TABLE {entry}")  # the catalogue forgets it; the files stay until the end, and the plan has them
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`stored` that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def _ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, by way of the shared folder."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_folder(spark, "code"), "docnest.zip")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(path)
    out.write(bytearray(data.getvalue()))
    out.close()
    files.deleteOnExit(path.getParent())
    context.addPyFile(files.makeQualified(path).toString())
    _SHIPPED.add(context.applicationId)


#: What Spark sends to Python at once, in bytes, where the session has nothing else set: rows of any size make small batches.
BATCH_BYTES = 4 << 20
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


class _Tidy:
    """A function over the batches of a task. Python workers are used again, so what the task held goes back to the system at its end."""

    def __init__(self, function: Callable):
        self.function = function

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from self.function(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass


def mapped(df: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` on executors that know this package, in batches of about BATCH_BYTES."""
    spark = df.sparkSession
    _ship(spark)
    if spark.conf.get(_BATCH_SETTING) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(_Tidy(function), schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A sample table; the session's shuffles are sized to fit it."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size_shuffles(spark, [df])
    return df


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def byte_values(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; empty for a null."""
    return [v or b"" for v in column.cast(pa.large_binary()).to_pylist()]


class WordHashes(dict):
    """64-bit hash by word, remembered; the memory is emptied when ``most`` words are in it."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)


def shingle_hashes(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Hash of every run of ``width`` words, in order; of the whole if it is shorter; none without words."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    last = len(hashes) - width + 1
    with np.errstate(over="ignore"):
        out = hashes[:last].copy()
        for i in range(1, width):
            out *= _ODD
            out += hashes[i : i + last]
        out += np.uint64(width)
        for _ in range(2):
            out ^= out >> _HALF
            out *= _MIX
        out ^= out >> _HALF
    return out


LETTER = re.compile(r"[^\W\d_]")
