"""Codes of vectors: whole-number k-means per part, exact to the last digit.

Components become whole numbers, floor(scale * x). Nearest entries come out of |c|^2 - 2 x.c, whose dot products are matrix
products of float64 (BLAS). To keep those exact, both sides are broken into limbs so small that no sum of products passes 2^53;
the products of limbs are put together again in int64, and the first smallest entry wins. Sums for the next entries are
products too, of the one-hot assignments with the vectors.

Defined results:

* Rows whose vector is null or holds a null, NaN or infinite component are dropped. An empty table, or one without kept rows,
  gives no codebooks and no rows.
* Vectors of different length, or of a length the parts don't divide, count as ending in zeros, up to the longest one's length.
* The first entries are the vectors of the smallest distinct keys, null last; of rows with one key the smallest vector counts. With
  fewer keys than entries there are fewer entries. Repeated rows count as often as they are there.
* Components too large for int64 distances (above about 32 000 for 64 dimensions) go through Python's whole numbers: slow,
  and as exact; an error above the largest long is returned as that.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docnest.llm.frames import mapped, stored

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096  # a power of two, so that scaling a float64 is exact
_LARGEST = 2**63 - 1
#: Sums leave the tasks in pieces of so many bits, so that Spark adds them as longs without overflow.
_PIECE_BITS = 31
#: A group with more than one in so many rows is joined by broadcast; there are fewer than so many of them, whatever the data.
_HOT_PARTS = 1000


@dataclass(frozen=True)
class Codebooks:
    """``entries[part][entry][position]``: whole numbers; ``scale`` and the padded length they were made for."""

    entries: tuple[tuple[tuple[int, ...], ...], ...]
    scale: int

    @property
    def width(self) -> int:
        return len(self.entries[0][0])

    @property
    def length(self) -> int:
        return len(self.entries) * self.width

    def digest(self) -> str:
        """SHA-256 of all components in order, joined by commas."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for e in part for x in e).encode()).hexdigest()

    def arrays(self) -> list[np.ndarray]:
        """One array of (entry, position) per part: int64, or Python's numbers if they are too large for it."""
        bound = int64_bound(self.length)
        small = all(abs(x) <= bound for part in self.entries for e in part for x in e)
        return [np.array(part, dtype=np.int64 if small else object).reshape(len(part), self.width) for part in self.entries]


def int64_bound(length: int) -> int:
    """The largest component whose squared distances, over a whole vector, still fit an int64."""
    return math.isqrt(_LARGEST // max(length, 1)) // 2


def limbs(a: np.ndarray, bits: int) -> list[np.ndarray]:
    """``a`` (int64) as float64 limbs, lowest first, each between -2^(bits-1) and 2^(bits-1)."""
    half, out = np.int64(1 << (bits - 1)), []
    while True:
        low = ((a + half) & np.int64((1 << bits) - 1)) - half
        out.append(low.astype(np.float64))
        a = (a - low) >> np.int64(bits)
        if not a.any():
            return out


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of whole numbers, exact: by limbs in float64 and int64, or by Python's numbers for object arrays."""
    if a.dtype == object or b.dtype == object:
        return a.astype(object) @ b.astype(object).T
    # A product of two limbs is at most 2^(2 * bits - 2); so many of them must stay below 2^53.
    bits = (54 - max(a.shape[1] - 1, 0).bit_length()) // 2
    out = np.zeros((len(a), len(b)), np.int64)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(limbs(b, bits)):
            out += (x @ y.T).astype(np.int64) << np.int64(bits * (i + j))
    return out


def nearest(vectors: np.ndarray, books: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of each part of (row, part, position), and the squared distances summed over the parts."""
    codes = np.zeros((len(vectors), len(books)), np.uint8)
    error = np.zeros(len(vectors), vectors.dtype if books[0].dtype != object else object)
    rows = np.arange(len(vectors))
    for p, book in enumerate(books):
        x = vectors[:, p]
        scores = (book * book).sum(1)[None, :] - 2 * exact_product(x, book)
        codes[:, p] = scores.argmin(1)
        error = error + (x * x).sum(1) + scores[rows, codes[:, p]]
    return codes, error


def _floats(column: pa.Array, length: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the kept rows and their float64 components, shorter vectors filled with zeros."""
    sizes = np.array([-1 if n is None else n for n in column.value_lengths().to_pylist()], np.int64)
    flat = np.asarray(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)
    held = np.maximum(sizes, 0)
    owner = np.repeat(np.arange(len(sizes)), held)
    keep = sizes >= 0
    keep[owner[~np.isfinite(flat)]] = False
    if length is None:
        length = int(sizes[keep].max(initial=0))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(held) - held, held)
    used = keep[owner]
    out = np.zeros((len(sizes), length))
    out[owner[used], place[used]] = flat[used]
    return np.flatnonzero(keep), out[keep]


def _wholes(values: np.ndarray, books: Codebooks) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and whole numbers as (row, part, position): one array for int64 and one for the rows too large for it."""
    shape = (len(books.entries), books.width)
    with np.errstate(over="ignore"):
        scaled = np.floor(values * float(books.scale))
    large = (np.abs(scaled) > int64_bound(books.length)).any(1)
    small = np.flatnonzero(~large)
    if len(small):
        yield small, scaled[small].astype(np.int64).reshape(len(small), *shape)
    if large.any():
        exact = [[math.floor(x * books.scale) if abs(x) < 2.0**52 else int(x) * books.scale for x in row] for row in values[large].tolist()]
        yield np.flatnonzero(large), np.array(exact, dtype=object).reshape(len(exact), *shape)


def _first_vectors(most: int):
    """Per task: the ``most`` smallest keys, each with its smallest vector, and the greatest length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        longest, kind = -1, None
        for batch in batches:
            kind = batch.schema.field(0).type
            rows, values = _floats(batch.column(1), None)
            if not len(rows):
                continue
            longest = max(longest, values.shape[1])
            ids = batch.column(0).take(pa.array(rows)).to_pylist()
            distinct = {*ids, *found}
            wanted = set(heapq.nsmallest(most, distinct - {None}))
            if len(wanted) < most and None in distinct:
                wanted.add(None)
            found = {k: v for k, v in found.items() if k in wanted}
            for i, key in enumerate(ids):
                if key in wanted:
                    vector = values[i].tolist()
                    while vector and not vector[-1]:
                        vector.pop()
                    found[key] = min(found.get(key, vector), vector, key=lambda v: v + [0.0] * (longest - len(v)))
        if longest >= 0:
            yield pa.record_batch(
                [pa.array(list(found), kind), pa.array(list(found.values()), pa.list_(pa.float64())), pa.array([longest] * len(found), pa.int32())],
                ["key", "vector", "longest"],
            )

    return run


def _sums(books: Codebooks):
    """Per task: count and component sums of what each entry is nearest to, cut into pieces of _PIECE_BITS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = books.arrays()
        n, k, width = len(arrays), len(arrays[0]), books.width
        total = np.zeros((n, k, width + 1), object)
        for batch in batches:
            _, values = _floats(batch.column(0), books.length)
            for _, vectors in _wholes(values, books):
                codes, _ = nearest(vectors, arrays)
                for p in range(n):
                    chosen = (codes[:, p][None, :] == np.arange(k)[:, None]).astype(np.int64)
                    total[p, :, :width] += exact_product(chosen, np.ascontiguousarray(vectors[:, p].T)).astype(object)
                    total[p, :, width] += chosen.sum(1).astype(object)
        cells, places, pieces = [], [], []
        for cell, value in enumerate(total.reshape(-1).tolist()):
            sign, value, place = (1 if value >= 0 else -1), abs(int(value)), 0
            while value:
                cells.append(cell)
                places.append(place)
                pieces.append(sign * (value & ((1 << _PIECE_BITS) - 1)))
                value, place = value >> _PIECE_BITS, place + 1
        yield pa.record_batch([pa.array(cells, pa.int64()), pa.array(places, pa.int32()), pa.array(pieces, pa.int64())], ["cell", "place", "piece"])

    return run


def _first_codebooks(df: DataFrame, key: str, vector: str, parts: int, entries: int, scale: int) -> Codebooks | None:
    kind = df.schema[key].dataType
    shape = T.StructType([T.StructField("key", kind), T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("longest", T.IntegerType())])
    found = stored(mapped(df.select(key, vector), _first_vectors(entries), shape), "first_vectors")
    longest = found.agg(F.max("longest")).first()[0]
    if longest is None:
        return None
    width = -(-longest // parts)
    padded = F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("vector")))
    seeds = found.groupBy("key").agg(F.min(padded).alias("vector")).orderBy(F.col("key").asc_nulls_last()).limit(entries).collect()
    books: list[list[tuple[int, ...]]] = [[] for _ in range(parts)]
    for row in sorted(seeds, key=lambda r: (r.key is None, r.key if r.key is not None else 0)):
        whole = [int(x) * scale if abs(x) >= 2.0**52 else math.floor(x * scale) for x in row.vector] + [0] * (width * parts - longest)
        for p in range(parts):
            books[p].append(tuple(whole[p * width : (p + 1) * width]))
    return Codebooks(tuple(map(tuple, books)), scale)


def fit(
    df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> Codebooks | None:
    """Codebooks learned from all kept rows; None without such rows.

    A round is one pass over the vectors. The driver gets parts * entries * (width + 1) sums of it, however many rows there are.
    """
    if not 1 <= entries <= 256 or parts < 1 or rounds < 0 or scale < 1 or scale & (scale - 1):
        raise ValueError("entries from 1 to 256, one part or more, no negative rounds, and a power of two as scale")
    books = _first_codebooks(df, key, vector, parts, entries, scale)
    for _ in range(rounds if books else 0):
        pieces = mapped(df.select(vector), _sums(books), "cell long, place int, piece long")
        total: dict[int, int] = {}
        for r in pieces.groupBy("cell", "place").agg(F.sum("piece").alias("piece")).collect():
            total[r.cell] = total.get(r.cell, 0) + (r.piece << (_PIECE_BITS * r.place))
        width, k = books.width, len(books.entries[0])
        moved = []
        for p, part in enumerate(books.entries):
            rows = []
            for e, old in enumerate(part):
                at = (p * k + e) * (width + 1)
                n = total.get(at + width, 0)
                rows.append(tuple(total.get(at + i, 0) // n for i in range(width)) if n else old)
            moved.append(tuple(rows))
        books = Codebooks(tuple(moved), scale)
    return books


def encode(df: DataFrame, books: Codebooks, keep: Sequence[str] = ("vec_id", "label"), vector: str = "embedding") -> DataFrame:
    """The columns ``keep`` of every kept row with ``code`` (binary, a byte a part) and ``error`` (long)."""
    kept = [df.schema[c] for c in keep]
    shape = T.StructType([*kept, T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = books.arrays()
        for batch in batches:
            rows, values = _floats(batch.column(len(kept)), books.length)
            codes = np.zeros((len(rows), len(arrays)), np.uint8)
            error = np.zeros(len(rows), np.int64)
            for at, vectors in _wholes(values, books):
                codes[at], found = nearest(vectors, arrays)
                error[at] = found if found.dtype == np.int64 else [min(int(e), _LARGEST) for e in found]
            columns = [batch.column(i).take(pa.array(rows)) for i in range(len(kept))]
            made = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)]
            yield pa.record_batch([*columns, *made], [*[f.name for f in kept], "code", "error"])

    return mapped(df.select(*keep, vector), run, shape)


def with_group_error(coded: DataFrame, group: str, name: str) -> DataFrame:
    """``coded`` (a written table) with the sum of ``error`` over rows equal in ``group``, nulls together, at most the largest long.

    Frequent groups, fewer than _HOT_PARTS whatever the data, are joined by broadcast, so no task gets all rows of one;
    the others meet their sums by a shuffle.
    """
    exact = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LARGEST).cast("decimal(38,0)")).cast("long")
    sums = stored(coded.groupBy(F.col(group).alias("__group")).agg(exact.alias(name), F.count(F.lit(1)).alias("__n")), "group_errors")
    hot = sums.where(F.col("__n") * _HOT_PARTS > coded.count())
    same = F.col(group).eqNullSafe(F.col("__group"))
    often = coded.join(F.broadcast(hot), same)
    rest = coded.join(F.broadcast(hot), same, "left_anti").join(sums, same)
    return often.unionByName(rest).drop("__group", "__n")
