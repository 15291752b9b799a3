"""Toxicity by averaged subword embeddings and a linear softmax.

A word is the mean of the vectors of its hashed byte n-grams (and of the word itself), a text the mean of its words, and a linear softmax
over that mean gives the two classes. Vectors and softmax are trained together by Adam, so a misspelling that was never seen
shares the vectors of the n-grams that are left of the word.

Training: at most SAMPLE labelled documents of each class, picked by a hash of the id, SAMPLE_CHARS of each, from all over the text; the bias is moved to
the classes' real shares afterwards. Prediction reads whole texts. As everything after the lookup is linear, a word's part in the
score is one number, which is kept by word.

Defined results: null and empty texts have the mean of no words, and so the score of the bias; without labelled rows of both
classes every score is the share of toxic ones (0 without any). Equal texts have equal scores, whatever their length; an id labelled both ways is
toxic, and one that is there often is learned from once; an empty table has no scores.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docnest.llm.frames import mapped, stored
from docnest.llm.language_id import sampled
from docnest.llm.subwords import WordTable, grams

SAMPLE = {1: 1600, 0: 4800}
SAMPLE_CHARS = 20_000
#: Pieces of a longer text.
WINDOWS = 10
BUCKETS = 1 << 16
DIM = 8
#: Batches of training, whatever the number of documents.
STEPS = 400
BATCH = 128
RATE = 0.05
#: Vectors start almost at zero, and shrink a little whenever they are used: an n-gram that was never seen, or says nothing, adds next to nothing.
INIT = 0.003
DECAY = 0.15
#: So many silent words are averaged in per text, counted against its distinct words: ten words said over and over prove less than a page.
SILENT = 60
#: The mean is scaled so that few telling words among many can be heard from the first step.
SCALE = 100.0
TOXIC = 0.3
_SIZES = (3, 4, 5)
_EDGES = b".,;:!?\"'()[]{}<>*_-#%&$|"


@dataclass
class Model:
    vectors: np.ndarray | None  # a row per bucket
    out: np.ndarray | None  # DIM, toxic minus clean
    bias: float

    def word_scores(self, new: list[bytes]) -> np.ndarray:
        """What each word adds, before the mean over the text."""
        if self.vectors is None:
            return np.zeros((len(new), 1))
        owner, bucket = _features(new)
        parts = self.vectors @ self.out
        count = np.maximum(np.bincount(owner, minlength=len(new)), 1)
        return (np.bincount(owner, parts[bucket], len(new)) / count * SCALE)[:, None]


def _features(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) of the n-grams of every word, lower-cased and freed of marks around it, and of the word itself."""
    plain = [(w.strip(_EDGES) or w).decode("utf-8", "replace").lower().encode() for w in raw]
    owner, bucket = grams(plain, _SIZES, BUCKETS // 2)
    data = np.fromiter((zlib.crc32(w) for w in plain), np.int64, len(plain))
    whole = (data % (BUCKETS // 2) + BUCKETS // 2).astype(np.int32)
    return np.concatenate([owner, np.arange(len(plain), dtype=np.int32)]), np.concatenate([bucket, whole])


def heard(distinct: int) -> float:
    """What the silent words leave of the mean."""
    return distinct / (distinct + SILENT)


def _bags(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of texts over buckets: (first entry of each text, bucket, weight)."""
    firsts, buckets, weights, at = [], [], [], 0
    for text in texts:
        counts = Counter(text.split())
        owner, bucket = _features(list(counts)) if counts else (np.empty(0, np.int32), np.empty(0, np.int32))
        times = np.fromiter(counts.values(), np.float64, len(counts))
        share = times / max(times.sum(), 1) / np.maximum(np.bincount(owner, minlength=len(counts)), 1) * heard(len(counts)) if len(counts) else times
        found, inverse = np.unique(bucket, return_inverse=True)
        firsts.append(at)
        buckets.append(found)
        weights.append(np.bincount(inverse, share[owner], len(found)).astype(np.float32))
        at += len(found)
    return np.array([*firsts, at]), np.concatenate(buckets), np.concatenate(weights)


def train(rows: list[tuple[int, str]], prior: float) -> Model:
    """A model from (label, text); ``prior`` is the real share of label 1."""
    prior = min(max(prior, 0.0), 1.0)
    given = np.array([label for label, _ in rows])
    if len(set(given.tolist())) < 2:
        share = min(max(prior, 1e-9), 1 - 1e-9)
        return Model(None, None, float(np.log(share / (1 - share))))
    firsts, buckets, weights = _bags([text.encode("utf-8", "replace") for _, text in rows])
    rng = np.random.default_rng(11)
    vectors = rng.normal(0, INIT, (BUCKETS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.5, DIM).astype(np.float32)
    bias = np.zeros(1, np.float32)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (vectors, out, bias)]
    step = 0
    while step < STEPS:
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            rate = RATE * max(0.02, 1 - step / STEPS)
            batch = order[at : at + BATCH]
            size = firsts[batch + 1] - firsts[batch]
            text_of = np.repeat(np.arange(len(batch)), size)
            entry = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(firsts[batch], size)
            which, weight = buckets[entry], weights[entry] * np.float32(SCALE)
            used, inverse = np.unique(which, return_inverse=True)
            own = vectors[used]
            mean = np.stack([np.bincount(text_of, own[inverse, d] * weight, len(batch)) for d in range(DIM)], axis=1).astype(np.float32)
            chance = 1 / (1 + np.exp(-(mean @ out + bias)))
            wrong = ((chance - given[batch]) / len(batch)).astype(np.float32)
            pull = wrong[text_of] * weight
            slope = np.bincount(inverse, pull, len(used)).astype(np.float32)[:, None] * out
            step += 1
            for p, g, (m, v), rows_ in ((vectors, slope, moments[0], used), (out, mean.T @ wrong, moments[1], slice(None)), (bias, wrong.sum(keepdims=True), moments[2], slice(None))):
                m[rows_] += 0.1 * (g - m[rows_])
                v[rows_] += 0.01 * (g * g - v[rows_])
                p[rows_] *= 1 - rate * DECAY
                p[rows_] -= rate * (m[rows_] / (1 - 0.9**step)) / (np.sqrt(v[rows_] / (1 - 0.99**step)) + 1e-8)
    sample = given.mean()
    share = min(max(prior, 1e-6), 1 - 1e-6)
    moved = float(bias[0]) + np.log(share / (1 - share)) - np.log(sample / (1 - sample))
    return Model(vectors, out, float(moved))


def sampled_text(text: Column) -> Column:
    """A text to learn from: the whole, or WINDOWS pieces spread evenly over it, SAMPLE_CHARS together, if it is longer."""
    size = SAMPLE_CHARS // WINDOWS
    places = [F.floor((F.length(text) - size) * (i / (WINDOWS - 1))).cast("int") + 1 for i in range(WINDOWS)]
    return F.when(F.length(text) <= SAMPLE_CHARS, text).otherwise(F.concat_ws(" ", *[F.substr(text, p, F.lit(size)) for p in places]))


def fit(docs: DataFrame, labels: DataFrame, learn: Column) -> Model:
    """A model from the labelled rows (doc_id, toxic 0 or 1) for which ``learn`` holds and their texts."""
    known = labels.where(learn & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows at most
    each = [sampled(known.where(F.col("toxic") == label), "toxic", most) for label, most in SAMPLE.items()]
    picked = stored(each[0].unionByName(each[1]).coalesce(1), "toxicity-sample")
    texts = docs.select("doc_id", sampled_text(F.coalesce("text", F.lit(""))).alias("text"))
    # one row per sampled id, however often it is there
    found = texts.join(picked, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows = [(r["toxic"], r["text"]) for r in sorted(found, key=lambda r: (r["doc_id"], r["text"]))]
    return train(rows, counts.get(1, 0) / max(1, sum(counts.values())))


class Scorer:
    """Texts to scores, in batches; keeps the parts of words it has seen."""

    #: Words looked up at once.
    most = 60_000

    def __init__(self, model: Model):
        self.model = model
        self.table = WordTable(model.word_scores, 1)

    def _means(self, lists: list[list[bytes]]) -> np.ndarray:
        numbers = self.table.numbers([w for ws in lists for w in ws])
        parts = self.table.settle()[numbers, 0]
        lengths = np.array([len(ws) for ws in lists])
        sums = np.bincount(np.repeat(np.arange(len(lists)), lengths), parts, len(lists))
        self.table.forget()
        return sums / np.maximum(lengths, 1) * np.array([heard(len(set(ws))) for ws in lists])

    def score(self, texts: list[str | None]) -> np.ndarray:
        logits: list[np.ndarray] = []
        waiting: list[list[bytes]] = []
        size = 0
        for text in texts:
            ws = text.encode("utf-8", "replace").split() if text else []
            waiting.append(ws)
            size += len(ws)
            if size >= self.most:
                logits.append(self._means(waiting))
                waiting, size = [], 0
        if waiting:
            logits.append(self._means(waiting))
        every = np.concatenate(logits) if logits else np.empty(0)
        return 1 / (1 + np.exp(-np.clip(every + self.model.bias, -700, 700)))


def _scored(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            made = pa.array(scorer.score(batch.column("text").to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), made], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    asked = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return mapped(asked, _scored(model), f"doc_id {kind}, score double")
