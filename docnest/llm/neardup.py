"""MinHash near-dedup with sequential Bayesian verification.

1. Every text becomes the set of its 5-word shingles (lower-cased A-Z; shorter texts are one shingle), a signature of
   BANDS * ROWS min-hashes and one key per band. Equal sets are one node from here on.
2. Nodes that share a band key are candidates. A bucket does not emit its pairs: members are paired with two of its
   nodes picked by hash. Batches of signature positions are compared, and a pair is dropped as soon as the posterior
   probability of a similarity of 0.75 or more, given the matches so far, falls under MISS.
3. Survivors are verified on their full shingle sets: each node with its likeliest partner first, then pairs whose
   ends are still in different components.
4. What is left in a bucket are pairs between its largest component and strays, and between strays. They go block by block
   through the same comparison and verification inside a task, which reports only links that join components.

A pair of similarity 0.75 shares no band with probability (1 - 0.75**ROWS)**BANDS = 2e-5, less for likelier pairs.

Defined results: null and empty texts have no shingles and no links. Rows are documents: rows of one id with different
texts are linked only by their texts. A null id never names a component unless all its ids are null. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docnest.llm.components import components
from docnest.llm.frames import WordHashes, bucketed, byte_values, discard, mapped, shingle_hashes, stored

BANDS = 40
ROWS = 5
#: Positions of a signature compared before the next look at the posterior.
BATCH = 20
#: Similarity of a link, in hundredths.
SIMILAR = 75
#: A pair goes on while a link is at least this likely.
MISS = 1e-5
#: Members of a block when what is left of a bucket is compared.
BLOCK = 512
#: Shingles hashed at once.
_CHUNK = 4096

_SEEDS = np.random.default_rng(20240229)
_TIMES = _SEEDS.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_PLUS = _SEEDS.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def shingle_set(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(hashes.of(text.lower().split())))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(low), _CHUNK):
            np.minimum(out, (low[at : at + _CHUNK, None] * _TIMES + _PLUS).min(axis=0), out=out)
    return out


def band_keys(sign: Column) -> Column:
    """One key per band of a stored signature; the last six bits of a key are its band."""
    width = 2 * ROWS
    part = lambda b: F.xxhash64(F.substring(sign, width * b + 1, width), F.lit(b))
    return F.array(*[F.expr("~63L").bitwiseAND(part(b)).bitwiseOR(F.lit(b)) for b in range(BANDS)])


_HASHED = "n_shingles long, set_key binary, sign binary"


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        sizes, keys, signs = [], [], []
        for text in byte_values(batch.column("doc").field("text")):
            shingles = shingle_set(text, hashes)
            sizes.append(len(shingles))
            keys.append(xxhash.xxh3_128_digest(shingles.tobytes()))
            signs.append(signature(shingles).astype(np.uint16).tobytes() if len(shingles) else None)
        made = [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), *made], names=["doc", "n_shingles", "set_key", "sign"])


@cache
def least_matches(threshold: float = SIMILAR / 100, miss: float = MISS) -> list[tuple[int, int]]:
    """(positions, matches) after each batch: with fewer matches the posterior of a link is under ``miss``.

    Prior: every similarity equally likely. With m of n matches the similarity is then Beta(m + 1, n - m + 1),
    and it exceeds t with the probability that n + 1 draws of chance t have at most m hits.
    """
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def bayes(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of rows (signatures) that no batch prunes, and their matches."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int32)
    done = 0
    for n, need in least_matches():
        matches[alive] += (left[alive, done:n] == right[alive, done:n]).sum(axis=1, dtype=np.int32)
        alive = alive[matches[alive] >= need]
        done = n
        if not len(alive):
            break
    return alive, matches[alive]


def _signs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BANDS * ROWS)


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            kept, matches = bayes(_signs(batch.column("sign_u")), _signs(batch.column("sign_v")))
            ends = [batch.column(c).take(pa.array(kept)) for c in ("u", "v")]
            yield pa.RecordBatch.from_arrays([*ends, pa.array(matches, pa.int32())], names=["u", "v", "matches"])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets are similar enough, exactly."""
    if 100 * min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= SIMILAR * (len(a) + len(b) - shared)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        keep = []
        for left, right in zip(byte_values(batch.column("text_u")), byte_values(batch.column("text_v")), strict=True):
            keep.append(linked(shingle_set(left, hashes), shingle_set(right, hashes)))
        ends = [batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("u", "v")]
        yield pa.RecordBatch.from_arrays(ends, names=["u", "v"])


def _with_ends(pairs: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """Pairs (u, v) with a column of both nodes."""
    side = lambda end: nodes.select(F.col("node").alias(end), F.col(column).alias(f"{column}_{end}"))
    return pairs.join(side("u"), "u").join(side("v"), "v")


def verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (u, v) that are links, by their full sets."""
    return stored(mapped(_with_ends(pairs.select("u", "v"), nodes, "text"), _linked, "u long, v long"), "links")


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    for end in ("u", "v"):
        root = roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        pairs = pairs.join(root, end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    return pairs.where("root_u <> root_v")


def _links_between(rows: list[tuple], key: int, hashes: WordHashes) -> list[tuple[int, int]]:
    """Links that join components, among the rows (node, root, side, sign, text) of a group of bucket ``key``.

    Side 0 is a block of members, side 1 a block of strays. A pair counts in the first bucket its ends share only; once
    two components are joined, no more of their pairs are looked at.
    """
    node = np.array([r[0] for r in rows], np.int64)
    root = np.array([r[1] for r in rows], np.int64)
    side = np.array([r[2] for r in rows], np.int8)
    sign = np.frombuffer(b"".join(r[3] for r in rows), np.uint16).reshape(-1, BANDS * ROWS)
    bands = sign.reshape(-1, BANDS, ROWS)
    band = key & 63
    sets: dict[int, np.ndarray] = {}
    joined: dict[int, int] = {}

    def set_of(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingle_set((rows[i][4] or "").encode("utf-8", "replace"), hashes)
        return sets[i]

    def top(r: int) -> int:
        while r in joined:
            r = joined[r]
        return r

    out = []
    left = np.flatnonzero(side == 0)
    for i in np.flatnonzero(side == 1):
        others = left[root[left] != root[i]]
        kept, matches = bayes(np.broadcast_to(sign[i], (len(others), BANDS * ROWS)), sign[others])
        others = others[kept]
        mine = (bands[others] == bands[i]).all(axis=2).argmax(axis=1) == band
        others, matches = others[mine], matches[mine]
        for j in others[np.argsort(-matches, kind="stable")].tolist():
            a, b = top(int(root[i])), top(int(root[j]))
            if a != b and linked(set_of(int(i)), set_of(j)):
                joined[max(a, b)] = min(a, b)
                out.append((int(node[i]), int(node[j])))
    return out


def _grouped_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of every group; the rows of a group arrive one after another."""

    def out(key: int, rows: list[tuple]) -> pa.RecordBatch:
        found = _links_between(rows, key, hashes)
        ends = [pa.array([f[e] for f in found], pa.int64()) for e in (0, 1)]
        return pa.RecordBatch.from_arrays(ends, names=["u", "v"])

    hashes = WordHashes()
    held, rows = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "low", "high", "node", "root", "side", "sign", "text")]
        for key, low, high, *row in zip(*columns, strict=True):
            if (key, low, high) != held:
                if rows:
                    yield out(held[0], rows)
                held, rows = (key, low, high), []
            rows.append(tuple(row))
    if rows:
        yield out(held[0], rows)


def leftover_links(members: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (u, v) between the components that share a bucket.

    Strays are the members outside the largest component of their bucket. Members and strays are dealt into blocks of
    about BLOCK / 2, and a block of members with a block of strays is one group: a bucket of n members with s strays
    makes about n * s comparisons in groups of bounded size, whatever n is.
    """
    now = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    shares = now.groupBy("key", "root").agg(F.count("*").alias("n"))
    half = BLOCK // 2
    open_ = (
        shares.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"))
        .where("most < n")
        .select("key", "main", F.ceil(F.col("n") / half).cast("int").alias("lows"), F.ceil((F.col("n") - F.col("most")) / half).cast("int").alias("highs"))
    )
    dealt = now.join(open_, "key").withColumn("turn", F.xxhash64("node", F.lit(7)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt.select("key", F.pmod("turn", "lows").cast("int").alias("low"), every("highs").alias("high"), "node", "root", F.lit(0).alias("side"))
    strays = dealt.where("root <> main")
    right = strays.select("key", every("lows").alias("low"), F.pmod("turn", "highs").cast("int").alias("high"), "node", "root", F.lit(1).alias("side"))
    rows = left.unionByName(right).join(nodes.select("node", "sign", "text"), "node")
    grouped = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    asked = grouped.select("key", "low", "high", "node", "root", "side", "sign", "text")
    return mapped(asked, _grouped_links, "u long, v long")


def likeliest(pairs: DataFrame) -> DataFrame:
    """Of the pairs (u, v, matches) of every node, the one with most matches."""
    ends = pairs.select("u", "v", "matches", F.explode(F.array("u", "v")).alias("node"))
    best = ends.groupBy("node").agg(F.max_by(F.struct("u", "v"), F.struct("matches", "v")).alias("p"))
    return best.select("p.u", "p.v").distinct()


def row_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, sets): ``rows`` are the documents with row number, set_key, n_shingles and the whole row as ``doc``;
    ``sets`` has set_key, component_id and ``first_row``, the one row of its component that stays."""
    asked = docs.select(F.struct(*docs.columns).alias("doc"))
    hashed = mapped(asked, _hashed, StructType([asked.schema["doc"], *StructType.fromDDL(_HASHED)]))
    rows = bucketed(hashed.withColumn("row", F.monotonically_increasing_id()), "row", "shingled")
    return rows, set_components(rows.select("row", "doc.doc_id", "doc.text", "n_shingles", "set_key", "sign"))


def set_components(rows: DataFrame) -> DataFrame:
    """set_key, component_id, first_row of every distinct non-empty set."""
    whole = rows.where("n_shingles > 0")
    sets = stored(whole.groupBy("set_key").agg(F.min("row").alias("node"), F.min("doc_id").alias("doc_id")), "sets")
    bands = rows.join(sets.select(F.col("node").alias("row")), "row").select(F.col("row").alias("node"), F.explode(band_keys(F.col("sign"))).alias("key"))
    bands = stored(bands, "bands")
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = stored(bands.join(shared, "key"), "buckets")
    discard(bands)
    among = members.select(F.col("node").alias("row")).distinct()
    nodes = stored(rows.join(among, "row").select(F.col("row").alias("node"), "text", "sign"), "candidates")

    # two nodes of a bucket, picked by hash; the few seeds let buckets of one group pick the same ones
    turn = lambda n: F.xxhash64("node", F.pmod(F.col("key"), F.lit(2)) + n)
    centres = members.groupBy("key").agg(F.min_by("node", turn(10)).alias("a"), F.min_by("node", turn(20)).alias("b"))
    pairs = members.join(centres, "key").select("node", F.explode(F.array("a", "b")).alias("centre")).where("node <> centre")
    pairs = pairs.select(F.least("node", "centre").alias("u"), F.greatest("node", "centre").alias("v")).distinct()
    likely = stored(mapped(_with_ends(pairs, nodes, "sign"), _likely, "u long, v long, matches int"), "likely")

    best = likeliest(likely)
    links = verified(best, nodes)
    roots = stored(components(links), "roots")
    rest = likely.select("u", "v").join(best, ["u", "v"], "left_anti")
    links = links.unionByName(verified(_rooted(rest, roots), nodes))
    roots = stored(components(links), "roots")
    links = links.unionByName(stored(leftover_links(members, roots, nodes), "links"))
    roots = stored(components(links), "roots")

    named = sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # the row that stays is the first of those with the component's id
    ids = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = stored(named.join(ids, "root").select("set_key", "root", "component_id"), "named")
    mine = whole.join(named, "set_key").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = mine.groupBy("root").agg(F.min("row").alias("first_row"))
    return named.join(first, "root").select("set_key", "component_id", "first_row")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), kept, per row."""
    rows, sets = row_components(docs.select("doc_id", "text"))
    joined = rows.select("set_key", "n_shingles", "doc.doc_id").join(sets.drop("first_row"), "set_key", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all their columns: one of each component, and every row without words."""
    rows, sets = row_components(docs)
    stay = sets.select(F.col("first_row").alias("row")).distinct().unionByName(rows.where("n_shingles = 0").select("row"))
    return rows.join(stay, "row").select("doc.*")
