import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from docnest.llm import fingerprints as fp
from tests.llm.texts import bag, frame, odd_rows, prose

K = fp.K


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def fold(values):
    """Spark's xxhash64 over columns: each hash seeds the next."""
    seed = 42
    for v in values:
        data = v if isinstance(v, bytes) else (v & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little")
        seed = xxhash.xxh64_intdigest(data, seed)
    return signed(seed)


def brute(text, k=K):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return []
    if len(words) < 5:
        return [fold([w.encode() for w in words])]
    hashes = [fold([w.encode()]) for w in words]
    return sorted({fold(hashes[i : i + 5]) for i in range(len(hashes) - 4)})[:k]


def printed(a):
    return "".join(f"{h & 0xFFFFFFFFFFFFFFFF:016x}" for h in a)


def like(a, b, k=K):
    least = sorted(set(a) | set(b))[:k]
    return sum(h in set(a) and h in set(b) for h in least) / len(least) if least else 1.0


def test_against_brute_force(spark):
    rows = [r for r in odd_rows() if r[0] is not None] + [(100 + i, prose(i % 20, 5 + i % 70, 30), "en", "a", 0) for i in range(150)]
    texts = sorted(((r[0], r[1] or "") for r in rows), key=lambda x: (-x[0], x[1].encode()))
    want = []
    for i, (doc_id, text) in enumerate(texts):
        after = texts[(i + 1) % len(texts)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        a, b, c = brute(text), brute(edited), brute(after)
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), printed(a), printed(b), like(a, b), like(a, c)))
    columns = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    got = [tuple(r[c] for c in columns) for r in fp.fingerprints(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(want)


def test_many_ranges_give_the_same_neighbours(spark, monkeypatch):
    monkeypatch.setattr(fp, "COARSE", 5)
    monkeypatch.setattr(fp, "RANGE_ROWS", 10)
    rows = [(i * i, f"text number {i} of them all", "en", "a", 0) for i in range(300)]
    after = {r.doc_id: r.next_text for r in fp.with_next(frame(spark, rows)).collect()}
    assert all(after[i * i] == f"text number {(i - 1) % 300} of them all" for i in range(300))


def test_sketches_of_parts_merge(spark):
    whole = prose(9, 800)
    words = whole.split()
    parts = [" ".join(words[:404]), " ".join(words[400:])]
    df = spark.createDataFrame([("d", p) for p in parts], "d string, t string").select("d", fp.sketch(F.col("t")).alias("s")).repartition(2)
    assert fp.merge_all(df, "d", "s").first()["s"] == brute(whole)


def test_estimates(spark):
    a, b = prose(3, 4000, 100_000), prose(4, 4000, 100_000)
    one = spark.createDataFrame([(a, a + " " + b, "tiny text")], "a string, ab string, t string")
    s = one.select(*[fp.sketch(F.col(c), 512).alias(c) for c in ("a", "ab", "t")])
    got = s.select(
        fp.resemblance(F.col("a"), F.col("ab"), 512).alias("r"), fp.containment(F.col("a"), F.col("ab"), 512).alias("c"),
        fp.distinct_shingles(F.col("ab"), 512).alias("n"), fp.distinct_shingles(F.col("t"), 512).alias("t"),
    ).first()
    assert abs(got.r - 0.5) < 0.08 and got.c > 0.85 and abs(got.n / 8000 - 1) < 0.15 and got.t == 1


def test_null_ids_empty_tables_and_clashing_columns(spark):
    assert fp.fingerprints(frame(spark, [])).collect() == []
    plain, more = fp.fingerprints(frame(spark, odd_rows())), fp.fingerprints(frame(spark, odd_rows(), clashing=True))
    assert bag(plain) == bag(more) and plain.count() == len(odd_rows())
    alone = fp.fingerprints(frame(spark, [(1, "a b c d e f", None, None, None)])).first()
    assert alone.near_next == 1.0
