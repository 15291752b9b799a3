"""Language ID by a linear-chain conditional random field.

Every word of a text is labelled with a language. A word speaks for a language through hashed features: its first and last bytes,
its byte n-grams, and whether a learned lexicon of a language has it; learned transitions tie neighbouring words.
Forward-backward gives each word a probability per language, and a text's score for a language is the mean over its words, so
text that switches languages has a share of each.

Training: windows of at most SAMPLE_DOCS labelled documents per language, picked by a hash of the id, cut into segments. Segments of different
documents are put one after another, so that the transitions learn switches. Log-likelihood by Adam in numpy.

A chain is a run of up to CHAIN words of one text; longer texts are several chains, all of which count.

Defined results: null texts and texts without a letter are ``und`` with score 0; without labelled rows every text is. Of equal shares the first
language by name wins; repeated rows and null ids are rows like any other, an id that is there often is learned from once a language; an empty
table has no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docnest.llm.frames import LETTER, mapped, stored
from docnest.llm.subwords import WordTable, affixes, grams

SAMPLE_DOCS = 300
SAMPLE_CHARS = 3000
SEQUENCES = 2000
SEQUENCE_WORDS = 40
EPOCHS = 30
BUCKETS = 1 << 15
LEXICON = 4000
CHAIN = 64
UNKNOWN = "und"
#: ASCII bytes that are no letters become spaces.
_PLAIN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    """Lower-case runs of letters; characters beyond ASCII count as letters."""
    return text.lower().encode("utf-8", "replace").translate(_PLAIN).split()


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # buckets of n-grams, of affixes, one row per lexicon; a column per label
    between: np.ndarray  # log scores: from label, to label
    start: np.ndarray
    lexicon: dict[bytes, int]

    def emissions(self, new: list[bytes]) -> np.ndarray:
        return _emissions(new, self.weights, self.lexicon)


def _features(new: list[bytes], lexicon: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, row of the weights) of every feature."""
    owner_g, gram = grams(new, (2, 3, 4), BUCKETS)
    owner_a, affix = affixes(new, 4, BUCKETS)
    known = np.fromiter((lexicon.get(w, -1) for w in new), np.int32, len(new))
    owner_l = np.flatnonzero(known >= 0).astype(np.int32)
    rows = np.concatenate([gram, affix + BUCKETS, known[owner_l] + 2 * BUCKETS])
    return np.concatenate([owner_g, owner_a, owner_l]), rows


def _emissions(new: list[bytes], weights: np.ndarray, lexicon: dict[bytes, int]) -> np.ndarray:
    owner, rows = _features(new, lexicon)
    scale = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=len(new)), 1))
    return np.stack([np.bincount(owner, weights[rows, k], len(new)) * scale for k in range(weights.shape[1])], axis=1)


def forward_backward(scores: np.ndarray, there: np.ndarray, between: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of chains (n, t, labels), expected transitions (labels, labels) and log-partition (n).

    ``there`` marks the positions that exist; padding is at the end. Each position is scaled to sum to one, so nothing underflows.
    """
    n, t, _ = scores.shape
    top = scores.max(axis=2, keepdims=True)
    emit = np.exp(scores - top)
    step, first = np.exp(between), np.exp(start)
    alpha, scale = np.empty_like(emit), np.ones((n, t), emit.dtype)
    now = first * emit[:, 0]
    for i in range(t):
        if i:
            now = (alpha[:, i - 1] @ step) * emit[:, i]
        scale[:, i] = now.sum(axis=1)
        alpha[:, i] = now / scale[:, i, None]
    beta = np.ones_like(emit)
    pairs = np.zeros_like(step)
    for i in range(t - 2, -1, -1):
        ahead = beta[:, i + 1] * emit[:, i + 1] / scale[:, i + 1, None]
        real = there[:, i + 1, None]
        beta[:, i] = np.where(real, ahead @ step.T, 1)
        pairs += (alpha[:, i] * real).T @ ahead
    marginal = alpha * beta
    marginal /= marginal.sum(axis=2, keepdims=True)
    logs = ((np.log(scale) + top[..., 0]) * there).sum(axis=1)
    return marginal, pairs * step, logs


def _lexicon(texts: list[list[bytes]], tags: list[int], labels: int) -> dict[bytes, int]:
    """Words mostly of one language, the most frequent LEXICON of each."""
    counts = [Counter() for _ in range(labels)]
    for ws, tag in zip(texts, tags, strict=True):
        counts[tag].update(ws)
    total: Counter = Counter()
    for c in counts:
        total.update(c)
    return {w: k for k, c in enumerate(counts) for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON] if n >= 3 and n >= 0.8 * total[w]}


def train(rows: list[tuple[str, str]]) -> Model | None:
    """A model from (language, text)."""
    rows = [(lang, ws) for lang, text in rows if len(ws := words(text)) > 0]
    labels = sorted({lang for lang, _ in rows})
    if not labels:
        return None
    tags = [labels.index(lang) for lang, _ in rows]
    texts = [ws for _, ws in rows]
    lexicon = _lexicon(texts, tags, len(labels))
    rng = np.random.default_rng(7)
    by_tag = [[i for i, t in enumerate(tags) if t == k] for k in range(len(labels))]
    flat: list[bytes] = []
    gold = np.zeros((SEQUENCES, SEQUENCE_WORDS), np.int64)
    for s in range(SEQUENCES):
        at = 0
        while at < SEQUENCE_WORDS:
            k = int(rng.integers(len(labels)))
            ws = texts[by_tag[k][int(rng.integers(len(by_tag[k])))]]
            length = min(int(rng.integers(4, 25)), SEQUENCE_WORDS - at, len(ws))
            first = int(rng.integers(len(ws) - length + 1))
            flat += ws[first : first + length]
            gold[s, at : at + length] = k
            at += length
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    index = np.array([vocabulary[w] for w in flat]).reshape(gold.shape)
    # half of the lexicon's hits are hidden in training, so that the other features learn too
    hidden = {w: k for w, k in lexicon.items() if rng.random() < 0.5}
    owner, feature = _features(list(vocabulary), hidden)
    size, n_labels = 2 * BUCKETS + len(labels), len(labels)
    scale = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=len(vocabulary)), 1))
    parameters = [np.zeros((size, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    there = np.ones(gold.shape, bool)
    observed = np.eye(n_labels)[gold]
    seen_pairs = np.zeros((n_labels, n_labels))
    np.add.at(seen_pairs, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    for epoch in range(1, EPOCHS + 1):
        weights, between, start = parameters
        emit = np.stack([np.bincount(owner, weights[feature, k], len(vocabulary)) * scale for k in range(n_labels)], axis=1)
        marginal, pairs, _ = forward_backward(emit[index], there, between, start)
        wrong = (marginal - observed) / len(gold)
        by_word = np.stack([np.bincount(index.ravel(), wrong[..., k].ravel(), len(vocabulary)) * scale for k in range(n_labels)], axis=1)
        slope = np.stack([np.bincount(feature, by_word[owner, k], size) for k in range(n_labels)], axis=1) + 1e-5 * weights
        slopes = [slope, (pairs - seen_pairs) / len(gold) + 1e-4 * between, wrong[:, 0].sum(axis=0)]
        for p, g, (m, v) in zip(parameters, slopes, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= 0.1 * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
    weights, between, start = parameters
    return Model(labels, weights.astype(np.float32), between, start, lexicon)


def sampled(rows: DataFrame, by: str, most: int) -> DataFrame:
    """doc_id and ``by`` of at most ``most`` rows per value, those with the smallest hash of the id. Spark
    cuts every group to ``most`` in each task before it shuffles."""
    nth = F.row_number().over(W.partitionBy(by).orderBy(F.xxhash64("doc_id"), "doc_id"))
    return rows.select("doc_id", by).distinct().withColumn("nth", nth).where(F.col("nth") <= most).select("doc_id", by)


def fit(docs: DataFrame, learn: Column) -> Model | None:
    """A model from the rows of ``docs`` (doc_id, text, lang) for which ``learn`` holds."""
    labelled = docs.where(learn & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    picked = stored(sampled(labelled, "lang", SAMPLE_DOCS).coalesce(1), "language-sample")
    # a window of the text, at a place picked by hash
    place = f"pmod(xxhash64(doc_id), greatest(length(text) - {SAMPLE_CHARS}, 0) + 1) + 1"
    window = F.expr(f"substring(text, cast({place} as int), {SAMPLE_CHARS})")
    # one row per sampled id and language, however often it is there
    rows = labelled.select("doc_id", "lang", window.alias("text")).join(picked, ["doc_id", "lang"])
    found = rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    return train([(r["lang"], r["text"]) for r in sorted(found, key=lambda r: (r["lang"], r["doc_id"], r["text"]))])


class Labeller:
    """Texts to (label, score), in batches; keeps the scores of words it has seen."""

    #: Words labelled at once.
    most = 40_000

    def __init__(self, model: Model):
        self.model = model
        self.table = WordTable(model.emissions, len(model.labels))

    def _shares(self, lists: list[list[bytes]]) -> np.ndarray:
        """Mean probability of each label, a row per text."""
        numbers = self.table.numbers([w for ws in lists for w in ws])
        emit = self.table.settle()
        lengths = np.array([len(ws) for ws in lists])
        chains = -(-lengths // CHAIN)
        text_of = np.repeat(np.arange(len(lists)), chains)
        nth = np.arange(len(text_of)) - np.repeat(np.cumsum(chains) - chains, chains)
        first = np.repeat(np.cumsum(lengths) - lengths, chains) + nth * CHAIN
        left = np.minimum(np.repeat(lengths, chains) - nth * CHAIN, CHAIN)
        there = np.arange(CHAIN) < left[:, None]
        at = np.where(there, first[:, None] + np.arange(CHAIN), 0)
        scores = emit[numbers[at]]
        marginal, _, _ = forward_backward(scores, there, self.model.between.astype(np.float32), self.model.start.astype(np.float32))
        sums = (marginal * there[..., None]).sum(axis=1)
        totals = np.stack([np.bincount(text_of, sums[:, k], len(lists)) for k in range(sums.shape[1])], axis=1)
        return totals / lengths[:, None]

    def label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [(UNKNOWN, 0.0)] * len(texts)
        waiting: list[tuple[int, list[bytes]]] = []
        size = 0

        def close() -> None:
            nonlocal size
            if waiting:
                shares = self._shares([ws for _, ws in waiting])
                for (i, _), share in zip(waiting, shares, strict=True):
                    k = int(share.argmax())
                    out[i] = (self.model.labels[k], float(min(1.0, share[k])))
            waiting.clear()
            self.table.forget()
            size = 0

        for i, text in enumerate(texts):
            if text and LETTER.search(text) and (ws := words(text)):
                waiting.append((i, ws))
                size += len(ws)
                if size >= self.most:
                    close()
        close()
        return out


def _predicted(model: Model | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model) if model else None
        for batch in batches:
            texts = batch.column("row").field("text").to_pylist()
            found = labeller.label(texts) if labeller else [(UNKNOWN, 0.0)] * len(texts)
            made = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *made], names=["row", "lang_pred", "score"])

    return run


def labelled(docs: DataFrame, model: Model | None) -> DataFrame:
    """Every row of ``docs`` as ``row``, with lang_pred and score of its text."""
    asked = docs.select(F.struct(*docs.columns).alias("row"))
    return mapped(asked, _predicted(model), StructType([asked.schema["row"], *StructType.fromDDL("lang_pred string, score double")]))


def identify(docs: DataFrame, learn: Column) -> DataFrame:
    """doc_id, lang_pred, score of every row; the model learns from the rows for which ``learn`` holds."""
    model = fit(docs, learn)
    return labelled(docs.select("doc_id", "text"), model).select("row.doc_id", "lang_pred", "score")
