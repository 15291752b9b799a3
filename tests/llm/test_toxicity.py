import numpy as np
import pytest
from pyspark.sql import functions as F

from docnest.llm import toxicity
from tests.llm.texts import bag, frame, odd_rows, prose

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=400):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(n):
        words = prose(i, 60, 200, "word").split()
        if i % 4 == 0:
            for w in rng.choice(["idiot", "worthless", "moronic"], 3):
                words.insert(int(rng.integers(len(words))), str(w))
        rows.append((i, " ".join(words), "en", "a", 0))
        labels.append((i, 1, int(i % 4 == 0)))
    return rows, labels


@pytest.fixture(scope="module")
def model():
    rows, labels = corpus()
    return toxicity.train([(label[2], r[1]) for r, label in zip(rows, labels, strict=True)][:300], 0.25)


def test_held_out_and_misspelt(model):
    rows, labels = corpus()
    scores = toxicity.Scorer(model).score([r[1] for r in rows[300:]])
    wrong = sum((s >= 0.3) != (label[2] == 1) for s, label in zip(scores, labels[300:], strict=True))
    assert wrong <= 3
    clean = prose(1000, 60, 200, "word")
    bad = toxicity.Scorer(model).score([clean, clean + " idiotz wworthless moronicc"])
    assert bad[0] < 0.3 < bad[1]


def test_a_words_part_is_the_linear_softmax_of_its_mean_vector(model):
    words = [b"idiot", b"plain"]
    owner, bucket = toxicity._features(words)
    mean = np.stack([model.vectors[bucket[owner == i]].mean(axis=0) for i in range(2)])
    assert np.allclose(model.word_scores(words)[:, 0], mean @ model.out * toxicity.SCALE, rtol=1e-4, atol=1e-4)


def test_odd_rows_missing_labels_and_clashing_columns(spark):
    rows, labels = corpus(120)
    docs = frame(spark, odd_rows() + [(1000 + r[0], *r[1:]) for r in rows])
    marks = spark.createDataFrame([(1000 + x[0], *x[1:]) for x in labels] + [(None, 1, 1), (1, 0, None), (2, 0, 1), (2, 0, 0)], LABELS)
    made = toxicity.fit(docs, marks, F.lit(True))
    got = toxicity.score(docs, made).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    more = frame(spark, odd_rows() + [(1000 + r[0], *r[1:]) for r in rows], clashing=True)
    assert bag(toxicity.score(more, made)) == bag(toxicity.score(docs, made))
    none = toxicity.fit(docs, marks, F.lit(False))
    assert {round(r.score, 6) for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(frame(spark, []), made).collect() == []


def test_long_texts_are_learned_from_all_over(spark):
    size = toxicity.SAMPLE_CHARS // toxicity.WINDOWS
    long = "".join(f"{i:07d}" for i in range(30_000))
    got = frame(spark, [(1, long, "en", "a", 0), (2, long[: toxicity.SAMPLE_CHARS], "en", "a", 0), (3, "", "en", "a", 0)])
    one, two, three = (r.t for r in got.select("doc_id", toxicity.sampled_text(F.col("text")).alias("t")).orderBy("doc_id").collect())
    pieces = one.split(" ")
    assert len(pieces) == toxicity.WINDOWS and all(len(p) == size and p in long for p in pieces)
    assert pieces[0] == long[:size] and pieces[-1] == long[-size:]
    assert two == long[: toxicity.SAMPLE_CHARS] and three == ""


def test_an_id_that_is_there_often_counts_once(spark):
    rows, labels = corpus(60)
    docs, known = frame(spark, rows), spark.createDataFrame(labels, LABELS)
    often = frame(spark, rows + [rows[0]] * 300)
    first, again = (toxicity.fit(d, known, F.lit(True)) for d in (docs, often))
    assert bag(toxicity.score(docs, first)) == bag(toxicity.score(docs, again))
