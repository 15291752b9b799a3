import hashlib
import random
import zlib

from docnest.llm import manifest as m
from tests.llm.texts import bag, frame, odd_rows, prose


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    doc_id, _, lang, source, n = row
    return sha("".join(map(field, (doc_id, source, lang, n, text))))


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        at = levels[-1]
        levels.append([sha("".join(at[i : i + m.FANOUT])) for i in range(0, len(at), m.FANOUT)])
    return levels


def path(levels, i):
    steps = []
    for at in levels[:-1]:
        run = at[i - i % m.FANOUT : i - i % m.FANOUT + m.FANOUT]
        steps.append(("".join(run[: i % m.FANOUT]), "".join(run[i % m.FANOUT + 1 :])))
        i //= m.FANOUT
    return steps


def brute(rows):
    groups = {}
    for row in rows:
        text = row[1]
        own = leaf(row, text)
        hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and text is not None
        other = leaf(row, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if hit else own
        groups.setdefault(row[3], []).append((row[0] is not None, row[0] or 0, own, other))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort()
        trees[name] = climb([g[2] for g in groups[name]])
    upper = climb([trees[n][-1][0] for n in names])
    out = []
    for k, name in enumerate(names):
        for i, (has, doc_id, own, other) in enumerate(groups[name]):
            steps = path(trees[name], i) + path(upper, k)
            folded = other
            for before, after in steps:
                folded = sha(before + folded + after)
            out.append((doc_id if has else None, own, trees[name][-1][0], upper[-1][0], sha("".join(b + a for b, a in steps)), folded, folded == upper[-1][0]))
    return sorted(map(repr, out))


def found(df):
    return sorted(repr(tuple(r)) for r in m.manifest(df).collect())


def test_equals_brute_force(spark):
    r = random.Random(3)
    rows = [(i, prose(i, r.randrange(1, 9)).title(), "en", r.choice(["hot", "hot", "a", "b", "é", None]), i) for i in range(700)]
    rows += [(900 + i, "Lone", "en", f"s{i}", None) for i in range(20)]
    got = found(frame(spark, rows).repartition(6))
    assert got == brute(rows) and any("False" in g for g in got) and any("True" in g for g in got)


def test_odd_rows_and_clashing_columns(spark):
    rows = odd_rows()
    rows += [rows[4]] * 40
    assert found(frame(spark, rows, clashing=True)) == brute(rows)


def test_one_row_one_group_and_none(spark):
    for rows in ([], [(10, "Text", "en", None, 4)], [(i, "X", "en", "a", 1) for i in range(16)], [(i, "X", "en", "a", 1) for i in range(17)]):
        assert found(frame(spark, rows)) == brute(rows)


def test_reruns_agree_and_a_changed_text_shows(spark):
    rows = [(i, f"Text {i}", "en", "ab"[i % 2], 5) for i in range(40)]
    first = m.Manifest(m.document_leaves(frame(spark, rows)))
    again = m.Manifest(m.document_leaves(frame(spark, rows[::-1]).repartition(5)))
    changed = m.Manifest(m.document_leaves(frame(spark, [*rows[:-1], (39, "Text 39.", "en", "b", 5)])))
    assert first.root == again.root != changed.root
    assert bag(first.rows()) == bag(again.rows())


def test_the_order_of_sources_is_by_bytes(spark):
    rows = [(i, "x", "en", s, 1) for i, s in enumerate(["￼", "𝄞", "Z", "a", None, ""])]
    assert found(frame(spark, rows)) == brute(rows)
