import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from docnest.llm import language_id
from docnest.llm.queries import QUERIES
from tests.llm.texts import bag, frame, odd_rows

SF = "/root/testdata/sf0.01"
ENGLISH = "the quick brown fox jumps over the lazy dog and then the children went home with their mother while it was raining in the street".split()
GERMAN = "der schnelle braune fuchs springt über den faulen hund und dann gingen die kinder mit ihrer mutter nach hause weil es regnete".split()


def corpus():
    rng = np.random.default_rng(3)
    return [
        (i, " ".join(rng.choice(ENGLISH if i % 2 else GERMAN, 30)), "en" if i % 2 else "de", "a", 0) for i in range(120)
    ]


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(5)
    scores, between, start = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    there = np.array([[True] * 4, [True, True, False, False]])
    marginal, pairs, logs = language_id.forward_backward(scores, there, between, start)
    want_pairs = np.zeros((3, 3))
    for c in range(2):
        n = there[c].sum()
        total, marks = 0.0, np.zeros((n, 3))
        both = np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = np.exp(start[path[0]] + sum(scores[c, i, k] for i, k in enumerate(path)) + sum(between[a, b] for a, b in itertools.pairwise(path)))
            total += w
            for i, k in enumerate(path):
                marks[i, k] += w
            for a, b in itertools.pairwise(path):
                both[a, b] += w
        assert np.allclose(marginal[c, :n], marks / total) and np.isclose(logs[c], np.log(total))
        want_pairs += both / total
    assert np.allclose(pairs, want_pairs)


def test_words_of_switched_text_get_their_own_language():
    model = language_id.train([(r[2], r[1]) for r in corpus()])
    mixed = " ".join(ENGLISH[:12] + GERMAN[:12])
    label, score = language_id.Labeller(model).label([mixed])[0]
    assert 0.35 < score < 0.75
    assert [x[0] for x in language_id.Labeller(model).label([" ".join(ENGLISH), " ".join(GERMAN)])] == ["en", "de"]
    assert model.between[0, 0] > model.between[0, 1] and model.between[1, 1] > model.between[1, 0]


def test_odd_rows_and_no_labels(spark):
    docs = frame(spark, odd_rows() + [(900, "1234 5678 --", "en", "a", 0), (901, "— “”", "en", "a", 0)] + [(1000 + r[0], *r[1:]) for r in corpus()])
    got = language_id.identify(docs, F.lit(True)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert {1, 2, 3, 900, 901} <= und and all(r.score == 0 for r in got if r.lang_pred == "und") and not any(i in und for i in range(1000, 1120))
    nothing = language_id.identify(docs, F.lit(False)).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert language_id.identify(frame(spark, []), F.lit(True)).collect() == []


def test_clashing_columns(spark):
    rows = [(1000 + r[0], *r[1:]) for r in corpus()]
    assert bag(language_id.identify(frame(spark, rows, clashing=True), F.lit(True))) == bag(language_id.identify(frame(spark, rows), F.lit(True)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")
def test_held_out_accuracy(spark):
    got = QUERIES["op2_language"](spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    good = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert good > 0.98
