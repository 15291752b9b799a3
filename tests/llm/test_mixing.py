import re
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from docnest.llm import mixing
from tests.llm.texts import bag, frame, odd_rows, prose


def shared_out(sizes, weights, share, most):
    """Targets by sharing out again and again."""
    left, capped = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in sizes if s not in capped]
        unit = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / unit > most * sizes[s]] if unit else []
        if not over:
            return capped | {s: left * weights[s] / unit for s in open_}
        for s in over:
            capped[s] = most * sizes[s]
            left -= capped[s]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(1, 10_000), min_size=1, max_size=12))
def test_targets_equal_repeated_sharing(spark, sizes):
    rows = [(f"a{i:02}", n) for i, n in enumerate(sizes)]
    got = {r.source_key: r.target for r in mixing.targets(spark.createDataFrame(rows, "source_key string, source_size long"), (5, 2, 1), 1.5, 2.0).collect()}
    want = shared_out(dict(rows), {k: (5, 2, 1)[i % 3] for i, (k, _) in enumerate(rows)}, 1.5, 2.0)
    assert all(abs(got[k] - want[k]) <= 1e-9 * max(1, want[k]) for k in want)


def test_each_source_is_near_its_target_and_reruns_agree(spark):
    docs = frame(spark, [(i, prose(i, 5 + i % 90), "en", "hot" if i % 3 == 0 else f"s{i % 7}", 0) for i in range(3000)])
    taken, target, largest = Counter(), {}, defaultdict(int)
    for r in mixing.mix(docs).collect():
        assert 0 <= r.copies <= 2
        taken[r.source_key] += r.copies * r["size"]
        target[r.source_key] = r.target
        largest[r.source_key] = max(largest[r.source_key], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    assert bag(mixing.mix(docs)) == bag(mixing.mix(docs.repartition(7)))


def test_a_smaller_share_is_a_subset(spark):
    docs = frame(spark, [(i, prose(i, 10), "en", f"s{i % 4}", 0) for i in range(400)])
    small = {r.doc_id for r in mixing.mix(docs, (1,), 0.3).collect() if r.copies}
    large = {r.doc_id for r in mixing.mix(docs, (1,), 0.6).collect() if r.copies}
    assert small < large


def test_odd_rows(spark):
    got = mixing.mix(frame(spark, odd_rows())).collect()
    want = Counter((r[0], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in odd_rows())
    assert Counter((r.doc_id, r["size"]) for r in got) == want
    assert {r.source_key for r in got} == {"aa", "ab", "ac", "b"}
    assert mixing.mix(frame(spark, [])).collect() == []
    only_null = frame(spark, [(1, None, None, None, None)])
    assert [(r.target, r.copies) for r in mixing.mix(only_null).collect()] == [(0.0, 0)]


def test_mixed_rows_keep_their_columns(spark):
    docs = frame(spark, odd_rows(), clashing=True)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    want = Counter()
    for r in mixing.mix(frame(spark, odd_rows())).collect():
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in out.collect()) == +want
