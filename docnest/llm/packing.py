"""Packing documents into fixed windows by multiway differencing.

A document is its token ids and an end id. Full windows of CAPACITY tokens stand alone. The tails are packed in blocks of
BLOCK: n tails go into m near-equal windows by Karmarkar and Karp's differencing. Every tail starts as a partition of its own (one filled
window, the others empty); the two partitions with the largest spread are merged, the fullest window of one with the
emptiest of the other, until one is left. m starts at the least number the tokens need and rises as long as a window exceeds
CAPACITY, by as many windows as the excess fills. One tail in STRIP_EVERY is cut into strips of STRIP tokens: merged
last, they level what larger tails leave uneven.

Blocks are filled in the order rows arrive in a task, so nothing is shuffled, no group grows with a key, and a task holds one
block besides its Arrow batch. Pieces are written once, with their token ids; a second pass over them numbers the sequences of all
tasks without gaps. The pieces of one sequence_id by offset, ids joined, are a training sequence.

Tokenizer: the vocabulary and merges of the given ``tokenizers`` file. Texts of characters up to U+024F run through tiktoken's merge loop over
the same ranks, several times faster than ``tokenizers``; any other text, any with a special token in it, and any with a run of
LONG_RUN white-space characters, on which tiktoken's pattern runs out of stack, runs through ``tokenizers`` itself. Both give
the same ids (tested).

Defined results: null and empty texts are the end id alone. Equal rows and null ids are packed one by one, equal sizes in the order they arrive;
texts of any length are encoded whole and cut into as many windows as they need; an empty table has no pieces.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docnest.llm.frames import mapped, stored

CAPACITY = 1024
BLOCK = 128
STRIP = 64
STRIP_EVERY = 16
END = 0
_FAR = re.compile("[^\x00-ɏ]")
#: White space that tiktoken is not asked to split; looked for from the start of each run only.
LONG_RUN = 100_000
_LONG_RUN = re.compile(rf"(?<!\s)\s{{{LONG_RUN}}}")
#: The pattern that splits text before merges, fixed for byte-level files.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level file: itself if printable, the next free one from U+0100 otherwise."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """text -> ids, for the byte-level file at ``path``."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters = _byte_letters()
    special = [t["content"] for t in spec["added_tokens"]]
    vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
    ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items()}
    fast = tiktoken.Encoding("byte-level", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    @cache
    def full():  # not every worker meets a text that needs it
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    def encode(text: str) -> np.ndarray:
        if _FAR.search(text) or any(s in text for s in special) or len(text) >= LONG_RUN and _LONG_RUN.search(text):
            return np.array(full().encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return encode


def differenced(sizes: list[int], m: int) -> list[list[int]]:
    """Indices of ``sizes`` in m windows of near-equal sums."""
    if not sizes:
        return [[] for _ in range(m)]
    joined: list[tuple[int, int]] = []  # what each node past the items was made of
    n = len(sizes)
    heap = []
    for i, size in enumerate(sizes):
        loads = np.zeros(m, np.int64)
        nodes = np.full(m, -1, np.int64)
        loads[0], nodes[0] = size, i  # windows by descending load
        heap.append((-size if m > 1 else 0, i, loads, nodes))
    heapq.heapify(heap)
    tie = n
    while len(heap) > 1:
        _, _, a, a_nodes = heapq.heappop(heap)
        _, _, b, b_nodes = heapq.heappop(heap)
        loads, other = a + b[::-1], b_nodes[::-1]
        nodes = np.maximum(a_nodes, other)
        both = np.flatnonzero((a_nodes >= 0) & (other >= 0))
        nodes[both] = np.arange(len(both)) + n + len(joined)
        joined += zip(a_nodes[both].tolist(), other[both].tolist(), strict=True)
        order = np.argsort(-loads, kind="stable")
        loads, nodes = loads[order], nodes[order]
        loads -= loads[-1]
        heapq.heappush(heap, (-int(loads[0]), tie, loads, nodes))
        tie += 1
    out = []
    for node in heap[0][3].tolist():
        window, todo = [], [node] if node >= 0 else []
        while todo:
            x = todo.pop()
            if x < n:
                window.append(x)
            else:
                todo += joined[x - n]
        out.append(window)
    return out


def packed(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most ``capacity``: as many as differencing needs."""
    m = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = differenced(sizes, m)
        excess = sum(max(0, sum(sizes[i] for i in w) - capacity) for w in windows)
        if not excess:
            return [sorted(w) for w in windows if w]
        m += -(-excess // capacity)


def cuts(n: int, capacity: int, strips: bool) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full windows, and the tail whole or in strips."""
    full = n - n % capacity
    pieces = [(at, capacity) for at in range(0, full, capacity)]
    step = STRIP if strips else capacity
    return pieces + [(at, min(step, n - at)) for at in range(full, n, step)]


#: Token ids a written batch holds, give or take a document.
_BATCH_IDS = 1 << 19
_PIECE = "start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, task int, nth long, offset long"


def _pieces(path: str, capacity: int, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [c.split()[0] for c in _PIECE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        task = TaskContext.get().partitionId()
        windows = tails = 0
        waiting: list[tuple] = []
        keys: pa.Array | None = None

        def close(rows: list[tuple]) -> list[tuple]:
            nonlocal windows
            out = []
            for window in packed([r[2] for r in rows], capacity):
                offset = 0
                for i in window:
                    out.append((*rows[i], task, windows, offset))
                    offset += rows[i][2]
                windows += 1
            return out

        def batch_of(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * 9
            ends = np.cumsum([0, *columns[2]], dtype=np.int32)
            flat = np.concatenate(columns[3]).astype(np.int32, copy=False) if rows else np.array([], np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            types = [kind, *[pa.int64()] * 4, pa.int32(), pa.int64(), pa.int64()]
            made = [pa.array(c, t) for c, t in zip(columns[:3] + columns[4:], types, strict=True)]
            return pa.RecordBatch.from_arrays([*made[:3], ids, *made[3:]], names=["doc_id", *names])

        for batch in batches:
            keys = batch.column("doc_id")
            done, held = [], 0
            for key, text in zip(keys.to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(END)).astype("<u4", copy=False)
                for start, length in cuts(len(ids), capacity, tails % STRIP_EVERY == 0):
                    piece = ids[start : start + length]
                    row = (key, start, length, piece, zlib.crc32(piece.tobytes()), len(ids))
                    if length == capacity:
                        done.append((*row, task, windows, 0))
                        windows += 1
                    else:
                        waiting.append((*row[:3], piece.copy(), *row[4:]))  # a view would keep the whole document
                tails += len(ids) % capacity > 0
                if tails == block:
                    done += close(waiting)
                    waiting, tails = [], 0
                held += len(ids)
                if held >= _BATCH_IDS:
                    yield batch_of(done, keys.type)
                    done, held = [], 0
            yield batch_of(done, keys.type)
        if waiting:
            yield batch_of(close(waiting), keys.type)

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    asked = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    run = _pieces(tokenizer or default_tokenizer(), capacity, block)
    pieces = stored(mapped(asked, run, f"doc_id {kind}, {_PIECE}"), "pieces")
    # one row per task
    tasks = pieces.groupBy("task").agg((F.max("nth") + 1).alias("n"))
    upto = W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    first = stored(tasks.select("task", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("first")).coalesce(1), "sequences")
    return pieces.join(first, "task").select(
        "doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", (F.col("first") + F.col("nth")).alias("sequence_id"), "offset"
    )
