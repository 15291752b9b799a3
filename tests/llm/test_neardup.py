import random

import numpy as np

from docnest.llm import neardup
from docnest.llm.components import components
from tests.llm.texts import bag, frame, odd_rows, prose


def sets_of(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    """(doc_id, set size, component) per row; rows of one id meet only by their texts, and components take their smallest id."""
    sets = [sets_of(r[1]) for r in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            shared = len(a & b)
            if shared and 100 * shared >= 75 * (len(a) + len(b) - shared):
                top[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least.setdefault(find(i), []).append(r[0])
    out = []
    for i, r in enumerate(rows):
        ids = [x for x in least[find(i)] if x is not None]
        component = min(ids, default=None) if sets[i] else r[0]
        out.append((r[0], len(sets[i]), component, r[0] == component))
    return sorted(out, key=repr)


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join(f"new{r.randrange(10**6)}" if r.random() < share else w for w in text.split())


def family(first, base, n, share):
    return [(first + i, edited(base, first + i, share), "en", "a", 0) for i in range(n)]


def test_against_brute_force(spark):
    rows = odd_rows() + [(200 + i, prose(i, 120), "en", "a", 0) for i in range(60)]
    rows += family(1000, prose(77, 150), 120, 0.02) + family(2000, prose(78, 90), 60, 0.04) + [(3000 + i, prose(5, 120).upper(), "en", "b", 0) for i in range(40)]
    passage = prose(99, 60)
    rows += [(4000 + i, prose(300 + i, 40) + " " + passage, "en", "a", 0) for i in range(60)]
    got = neardup.near_duplicates(frame(spark, rows))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_one_row_of_each_group_stays(spark):
    rows = odd_rows() + family(1000, prose(77, 150), 30, 0.01)
    docs = frame(spark, rows, clashing=True)
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    blank = sum(not sets_of(r[1]) for r in rows)
    groups = {c for _, n, c, _ in brute(rows) if n}
    assert len(ids) == blank + len(groups) and ids.count(1000) == 1


def test_empty_table_and_clashing_columns(spark):
    assert neardup.near_duplicates(frame(spark, [])).collect() == []
    assert neardup.deduplicated(frame(spark, [])).collect() == []
    assert bag(neardup.near_duplicates(frame(spark, odd_rows(), clashing=True))) == bag(neardup.near_duplicates(frame(spark, odd_rows())))


def test_posterior_bounds():
    limits = neardup.least_matches()
    assert limits[0][0] == neardup.BATCH and limits[-1][0] == neardup.BANDS * neardup.ROWS
    rng = np.random.default_rng(1)
    a = rng.integers(0, 60000, (4000, neardup.BANDS * neardup.ROWS), dtype=np.uint16)
    for similarity, most, least in ((0.8, 4000, 3995), (0.4, 5, 0)):
        b = np.where(rng.random(a.shape) < similarity, a, a + 1).astype(np.uint16)
        kept, matches = neardup.bayes(a, b)
        assert least <= len(kept) <= most and (matches == (a[kept] == b[kept]).sum(axis=1)).all()


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(500, 500 + i) for i in range(1, 300)] + [(600, 600), (500, 501)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain + star, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[500 + i] == 500 for i in range(300)) and len(got) == 361
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
