import hashlib
import math
import random

import numpy as np
import pytest

from docnest.llm import vector_codes as v
from tests.llm.texts import CLASHING

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=v.PARTS, entries=v.ENTRIES, rounds=v.ROUNDS):
    """The whole operator in Python's whole numbers, one row at a time."""
    kept = [(i, x, l) for i, x, l in rows if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    if not kept:
        return [], None
    width = -(-max(len(x) for _, x, _ in kept) // parts)
    kept = [(i, list(x) + [0.0] * (width * parts - len(x)), l) for i, x, l in kept]
    whole = [[math.floor(c * 4096) if abs(c) < 1e12 else int(c) * 4096 for c in x] for _, x, _ in kept]
    cut = [[w[p * width : (p + 1) * width] for p in range(parts)] for w in whole]
    ids = sorted({i for i, _, _ in kept if i is not None})
    ids += [None] if any(i is None for i, _, _ in kept) else []
    seeds = [min((x, n) for n, (k, x, _) in enumerate(kept) if k == i)[1] for i in ids[:entries]]
    books = [[cut[s][p] for s in seeds] for p in range(parts)]

    def near(x, book):
        far = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for w in cut:
                groups.setdefault(near(w[p], books[p])[0], []).append(w[p])
            books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e], strict=True)] if e in groups else old for e, old in enumerate(books[p])]
    found = [[near(w[p], books[p]) for p in range(parts)] for w in cut]
    errors = [sum(d for _, d in f) for f in found]
    by_label = {}
    for (_, _, l), e in zip(kept, errors, strict=True):
        by_label[l] = by_label.get(l, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    most = 2**63 - 1
    out = [(i, bytes(c for c, _ in f).hex(), min(e, most), min(by_label[l], most)) for (i, _, l), f, e in zip(kept, found, errors, strict=True)]
    return sorted(map(repr, out)), digest


def run(spark, rows, clashing=False, schema=SCHEMA):
    from pyspark.sql import functions as F

    from docnest.llm.frames import stored

    df = spark.createDataFrame(rows, schema)
    if clashing:
        df = df.select("*", *[F.lit("x").alias(c) for c in (*CLASHING, "code", "error", "cell", "vector")])
    books = v.fit(df)
    if books is None:
        return [], None
    coded = v.with_group_error(stored(v.encode(df, books), "codes"), "label", "label_error")
    return sorted(repr((r.vec_id, r.code.hex(), r.error, r.label_error)) for r in coded.collect()), books.digest()


def vectors(seed, n, length, spread=1.0):
    r = random.Random(seed)
    return [(i, [r.gauss(0, spread) for _ in range(length)], r.choice([0, 1, 1, None])) for i in range(n)]


@pytest.mark.parametrize("spread", [0.3, 20_000.0])
def test_equals_brute_force(spark, spread):
    rows = vectors(1, 300, 16, spread)
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = vectors(2, 60, 16)
    rows += [(3, None, 1), (70, [None] + [0.1] * 15, 2), (71, [math.nan] * 16, 1), (72, [0.1] * 15 + [-math.inf], 1)]
    rows += [rows[5]] * 4 + [(2, [0.5] * 16, None), (None, [0.25] * 16, 3), (90, [], 1), (91, [1.0] * 19, 1)]
    assert run(spark, rows, clashing=True) == brute(rows)
    assert run(spark, rows[:7] + rows[-3:]) == brute(rows[:7] + rows[-3:])


def test_ties_take_the_first_entry(spark):
    rows = [(i, [float(i % 3)] * 8, 0) for i in range(40)]
    assert run(spark, rows) == brute(rows)


def test_components_beyond_int64(spark):
    rows = vectors(3, 40, 8) + [(50, [1e30, -1e25] + [0.5] * 6, 1), (7, [3e9] * 8, 1)]
    assert run(spark, rows) == brute(rows)


def test_nothing_kept(spark):
    assert run(spark, []) == ([], None)
    assert run(spark, [(1, None, 1), (2, [math.nan], 1)]) == ([], None)
    assert run(spark, [(1, [], 1), (2, [], None)])[0] == ["(1, '0000000000000000', 0, 0)", "(2, '0000000000000000', 0, 0)"]


def test_products_by_limbs_are_exact():
    r = np.random.default_rng(4)
    for high, width in ((2**12, 8), (2**27, 8), (2**20, 5000), (2**29, 3)):
        a, b = (r.integers(-high, high, (6, width)) for _ in range(2))
        assert (v.exact_product(a, b) == a.astype(object) @ b.astype(object).T).all()
        bits = (54 - (width - 1).bit_length()) // 2
        assert all(np.abs(x).max() <= 2 ** (bits - 1) for x in v.limbs(a, bits))
        assert (sum(x.astype(np.int64) << (bits * i) for i, x in enumerate(v.limbs(a, bits))) == a).all()


def test_bad_settings_fail(spark):
    df = spark.createDataFrame([], SCHEMA)
    for bad in ({"entries": 257}, {"scale": 1000}, {"parts": 0}, {"rounds": -1}):
        with pytest.raises(ValueError):
            v.fit(df, **bad)


def test_frequent_and_rare_groups_get_the_same_sums(spark):
    from pyspark.sql import functions as F

    df = spark.range(5000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(-1).alias("label"), F.lit(2).cast("long").alias("error"))
    found = {r.label: r.total for r in v.with_group_error(df, "label", "total").collect()}
    assert found[-1] == 2 * 1667 and found[4] == 2 and len(found) == 3334
