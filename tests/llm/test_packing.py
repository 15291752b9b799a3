import zlib
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docnest.llm import packing
from tests.llm.texts import bag, frame, odd_rows, prose

PATH = packing.default_tokenizer()


@pytest.fixture(scope="module")
def slow():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=60) | st.text(st.characters(max_codepoint=0x24F), max_size=80) | st.text("ab 'st\n\t<|endoftext|>é", max_size=60))
def test_ids_are_those_of_tokenizers(slow, text):
    text = text.encode("utf-8", "replace").decode()
    assert packing.encoder(PATH)(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_ids_of_every_character_of_the_fast_path(slow):
    for c in map(chr, range(0x250)):
        text = f"a{c}b {c} {c}{c} 1{c}2"
        assert packing.encoder(PATH)(text).tolist() == slow.encode(text, add_special_tokens=False).ids, hex(ord(c))


@pytest.mark.parametrize("space", [" ", "\n", "\u00a0", "\r\n"])
def test_ids_of_long_white_space(slow, space):
    for n in (packing.LONG_RUN - 1, packing.LONG_RUN, 2_000_000):
        text = f"a b{space * n}c d"
        assert packing.encoder(PATH)(text).tolist() == slow.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1023), min_size=1, max_size=60))
def test_windows_hold_every_piece_once(sizes):
    windows = packing.packed(sizes)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= packing.CAPACITY for w in windows)


def test_differencing_is_near_equal():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 100, 200).tolist()
    loads = [sum(sizes[i] for i in w) for w in packing.differenced(sizes, 7)]
    assert max(loads) - min(loads) <= 5


def check(got, rows, slow):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id, r.doc_tokens].append(r)
        by_sequence[r.sequence_id].append(r)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    want = defaultdict(list)
    for row in rows:
        ids = np.array([*slow.encode(row[1] or "", add_special_tokens=False).ids, 0], "<u4")
        want[row[0], len(ids)].append(ids)
    assert set(want) == set(by_doc)
    for key, docs in want.items():
        copies = len(docs)
        if copies == 1:
            at = 0
            for r in sorted(by_doc[key], key=lambda r: r.start):
                assert r.start == at and r.ids_crc32 == zlib.crc32(docs[0][at : at + r.length].tobytes())
                at += r.length
            assert at == key[1]
        else:
            assert sum(r.length for r in by_doc[key]) == copies * key[1]
    return 1024 * len(by_sequence) / sum(r.length for r in got) - 1


def test_round_trip_of_odd_rows(spark, slow):
    check(packing.pack(frame(spark, odd_rows())).collect(), odd_rows(), slow)
    assert packing.pack(frame(spark, [])).collect() == []
    one = frame(spark, odd_rows()).coalesce(1)
    assert bag(packing.pack(one)) == bag(packing.pack(frame(spark, odd_rows(), clashing=True).coalesce(1)))


def test_little_padding(spark, slow):
    rows = [(i, prose(i, 20 + (i * 37) % 900), "en", "a", 0) for i in range(600)]
    assert check(packing.pack(frame(spark, rows).coalesce(2)).collect(), rows, slow) < 0.04


def test_pieces_hold_their_ids(spark, slow):
    rows = [(i, prose(i, (i * 97) % 3000), "en", "a", 0) for i in range(60)]
    got = packing.pack(frame(spark, rows).coalesce(1)).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in got)
    for key, text, *_ in rows:
        pieces = sorted((r for r in got if r.doc_id == key), key=lambda r: r.start)
        assert [i for r in pieces for i in r.ids] == [*slow.encode(text, add_special_tokens=False).ids, packing.END]


def test_written_batches_are_bounded(monkeypatch):
    texts = [prose(i, 2000) for i in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array(texts)], names=["doc_id", "text"])
    monkeypatch.setattr(packing.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    whole = list(packing._pieces(PATH, 1024, 4)(iter([batch])))
    monkeypatch.setattr(packing, "_BATCH_IDS", 10_000)
    parts = list(packing._pieces(PATH, 1024, 4)(iter([batch])))
    assert len(parts) > len(whole) and pa.Table.from_batches(parts).equals(pa.Table.from_batches(whole))
