import random
import re
from collections import Counter

from pyspark.sql import functions as F

from docnest.llm import quality
from tests.llm.texts import bag, frame, odd_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(runs)
    covered = {p for i, r in enumerate(runs) if seen[r] > 1 for p in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def rows():
    more = [(100 + i, "\n".join([prose(i % 9, 12, 6)] * (1 + i % 3)) + " #*$ | <b> a&b", "en", f"s{i % 3}", 0) for i in range(60)]
    return odd_rows() + more


def test_counts_against_brute_force(spark):
    got = quality.quality(frame(spark, rows())).collect()
    want = Counter((r[0], *counts(r[1])) for r in rows())
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter(tuple(r[n] for n in names) for r in got) == want
    for r in got:
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)


def test_fences_follow_the_group(spark):
    plain = [(i, prose(i, 40), "en", "plain", 0) for i in range(300)]
    marked = [(1000 + i, prose(i, 40).replace(" ", " ## "), "en", "marked", 0) for i in range(300)]
    stray = [(5000, prose(1, 40).replace(" ", " ## "), "en", "plain", 0)]
    kept = {r.doc_id: r.kept for r in quality.quality(frame(spark, plain + marked + stray)).collect()}
    assert not kept[5000] and all(kept[i] for i in range(300)) and all(kept[1000 + i] for i in range(300))


def strays():
    """One document per fence that only this fence catches, in a group of even texts."""
    words = prose(77, 60).split()
    runs = [f"u{i}" for i in range(85)] + words[:5] * 2 + ["x1", "x2", "x3"]  # ten words of 98 in runs seen twice: 10 %
    more = [f"u{i}" for i in range(100)] + [w for i in range(2) for w in words[:10]] + [f"v{i}" for i in range(4)]  # 20 of 124: 16 %
    near = [f"u{i}" for i in range(90)] + words[:9] * 2 + ["y"]  # 18 of 109: 16 %
    most = [f"u{i}" for i in range(82)] + words[:10] * 2 + ["y"]  # 20 of 103: 19 %
    lines = "\n".join(x for i in range(8) for x in ("more", prose(50 + i, 9)))  # seven of sixteen lines
    return {
        "short_words": " ".join(random.Random(4).choices("abcdefghijklmnopqrstuvwxyz", k=60)), "long_words": " ".join(f"{'x' * 15}{i}" for i in range(60)),
        "symbols": " ".join(w + "#" * (i % 3 == 0) for i, w in enumerate(prose(3, 60).split())), "dup_lines": lines, "repeats": " ".join(most),
    }, {"some": " ".join(runs), "more": " ".join(more), "near": " ".join(near)}


def test_every_fence_can_fire(spark):
    caught, fine = strays()
    docs = [(i, "\n".join(prose(1000 * i + j, 12) for j in range(4)), "en", "even", 0) for i in range(400)]
    docs += [(9000 + i, t, "en", "even", 0) for i, t in enumerate([*caught.values(), *fine.values()])]
    got = {r.doc_id: r for r in quality.quality(frame(spark, docs)).collect()}
    assert all(got[i].kept for i in range(400))
    for i, name in enumerate(caught):
        r = got[9000 + i]
        assert not r.base_failed and not r.kept, name
    assert all(got[9000 + len(caught) + i].kept for i in range(len(fine)))


def test_verdicts_against_brute_force(spark):
    """Every document's verdict from exact quartiles read off the same buckets."""
    docs = rows() + [(2000 + i, prose(i, 30 + i % 9) + " &" * (i % 7), "de", "x", 0) for i in range(300)] + [(2900, "a b c d e f g h i j k l", "de", "x", 0)]
    bucket = lambda v: v >> max(v.bit_length() - 7, 0) << max(v.bit_length() - 7, 0)
    measured = []
    for r in docs:
        n, chars, symbols, dup, repeats = counts(r[1])
        lines = sum(1 for x in (r[1] or "").split("\n") if WORD.search(x))
        measured.append((r, n, {"mean_word": chars * 1000 // n if n else 0, "symbols": symbols * 1000 // n if n else 0,
                                "dup_lines": dup * 1000 // lines if lines else 0, "repeats": repeats * 1000 // n if n else 0}, repeats))

    def limits(members, m):
        values = sorted(bucket(x[2][m]) for x in members)
        quartile = lambda share: next(v for i, v in enumerate(values) if sum(w <= v for w in values) / len(values) >= share)
        k, q1, q3 = quality.MEASURES[m], quartile(0.25), quartile(0.75)
        spread = max(q3 - q1, q3 * k.share, k.floor) * k.reach
        return (max(q1 - spread, q1 * k.least) if k.least is not None else None), min(q3 + spread, k.most)

    worded = [x for x in measured if x[1]]
    groups = [lambda a, b: (a[2], a[3]) == (b[2], b[3]), lambda a, b: a[2] == b[2], lambda a, b: True]
    cache, want = {}, Counter()
    for r, n, values, repeats in measured:
        failed = n < 10 or 100 * repeats > 20 * n
        kept = not failed
        if n:
            chosen = next((g for g in range(2) if sum(groups[g](r, x[0]) for x in worded) >= quality.ENOUGH), 2)
            key = (chosen, *((r[2], r[3]), (r[2],), ())[chosen])
            if key not in cache:
                cache[key] = {m: limits([x for x in worded if groups[chosen](r, x[0])], m) for m in quality.MEASURES}
            for m, (low, high) in cache[key].items():
                kept &= (low is None or values[m] >= low) and values[m] <= high
        want[r[0], failed, kept] += 1
    assert Counter((r.doc_id, r.base_failed, r.kept) for r in quality.quality(frame(spark, docs)).collect()) == want


def test_small_groups_use_coarser_fences(spark):
    docs = [(i, prose(i, 40), "en", f"s{i % 100}", 0) for i in range(400)] + [(900, prose(1, 40).replace(" ", " ## "), "xx", "lone", 0)]
    got = {r.doc_id: r for r in quality.quality(frame(spark, docs)).collect()}
    assert got[1].level == "language" and got[900].level == "corpus" and not got[900].kept


def test_sketches_merge_and_quantiles_are_close(spark):
    values = [(i * 37) % 5000 for i in range(5000)]
    sketch = (
        spark.createDataFrame([(v % 3, v) for v in values], "g int, v long")
        .select("g", quality._bucket(F.col("v")).alias("bucket"), F.lit("m").alias("measure"))
        .groupBy("g", "measure", "bucket").agg(F.count("*").alias("n"))
    )
    q = quality.quantiles(quality.merged(sketch.withColumn("one", F.lit(1)), "one"), ["one"], {"mid": 0.5}).first()
    assert q.n == 5000 and 2499 * (1 - 1 / 64) <= q.mid <= 2499


def test_empty_table_and_clashing_columns(spark):
    assert quality.quality(frame(spark, [])).collect() == []
    assert bag(quality.quality(frame(spark, rows(), clashing=True))) == bag(quality.quality(frame(spark, rows())))
