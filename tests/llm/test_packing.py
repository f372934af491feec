import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seriesmith.llm import packing

SCHEMA = "doc_id long, text string, length long, rank long"
TOKENIZER = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0]


def brute_pieces(rows, size):
    out = []
    for doc, text in rows:
        ids = ids_of(text)
        for k in range(0, len(ids), size):
            part = ids[k:k + size]
            out.append((doc, k // size, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out, key=str)


def check_places(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


ROWS = [(i, " ".join(["Hello", "wörld,", "don't", "stop!?", "123"] * (i % 23))) for i in range(150)] + [
    (200, None), (201, ""), (202, " \n\x1c "), (203, "a<|endoftext|>b \x01 c\x01d"), (None, "null id"), (None, "null id"),
    (5, "same id, other text"), (204, "very long " * 4000), (205, "é  x y İ 日本語 😀")]


@pytest.mark.parametrize("size", [2048, 17])
def test_pieces_and_places(spark, size):
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in ROWS], SCHEMA).repartition(3)
    out = packing.pack(df, length=size).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=str) == brute_pieces(ROWS, size)
    n = check_places(out, size)
    assert n <= 1.2 * sum(r.length for r in out) / size + 1


def test_ids_are_kept(spark):
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in ROWS], SCHEMA)
    out = packing.pack(df, length=64, keep_ids=True).orderBy("doc_id", "start").collect()
    long = [r for r in out if r.doc_id == 204]
    assert b"".join(r.ids for r in long) == np.array(ids_of(dict(ROWS)[204]), "<u4").tobytes()


def test_table_fills_its_sequences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = packing.pack(docs).collect()
    assert check_places(out, 2048) <= -(-sum(r.length for r in out) // 2048) + 2


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=120))
def test_plan_places_every_item_once(lengths):
    size = 24
    histogram = np.bincount(np.array(lengths, int), minlength=size + 1)
    runs = packing.plan(histogram, rounds=50)
    space = {}
    for length, rank, count, sequence, offset in runs.tolist():
        assert rank + count <= histogram[length]
        for i in range(count):
            cells = space.setdefault(sequence + i, set())
            own = set(range(offset, offset + length))
            assert not cells & own and max(own) < size
            cells |= own
    for length in range(1, size + 1):
        ranks = sorted((r, c) for n, r, c, _, _ in runs.tolist() if n == length)
        assert [r for r, _ in ranks] == np.cumsum([0, *[c for _, c in ranks]])[:-1].tolist()
        assert sum(c for _, c in ranks) == histogram[length]
    assert all(cells == set(range(len(cells))) for cells in space.values())


def test_patterns_fill_exactly():
    found = packing.patterns(np.arange(1, 13), 12)
    assert (found.sum(1) == 12).all() and len(found) == len({tuple(p) for p in found.tolist()})
    assert len(found) == sum(1 for a in range(1, 13) for b in range(a + 1) for c in range(b + 1) if a + b + c == 12)


def test_fit_recovers_repeats():
    rows = np.array([[7, 5, 0], [4, 4, 4], [6, 3, 3]])
    histogram = np.zeros(13)
    for row, n in zip(rows, (40, 25, 10)):
        for v in row[row > 0]:
            histogram[v] += n
    assert np.allclose(packing.fit_repeats(rows, histogram, 800), [40, 25, 10], atol=0.1)
