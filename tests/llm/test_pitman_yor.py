import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from seriesmith.llm import pitman_yor as py

SCHEMA = "doc_id long, text string, score string"


def words(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def held(doc):
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % 7 == 2


def brute(rows):
    count = Counter(w for d, t in rows if not held(d) for w in words(t))
    n, v = sum(count.values()), len(count)
    out = []
    for d, t in rows:
        ws = words(t)
        out.append((d, held(d), len(ws), sum(count[w] > 0 for w in ws), n,
                    sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)))
    return sorted(out, key=str)


def compare(got, rows):
    got = sorted(map(tuple, got), key=lambda r: str(r[:6]))
    want = brute(rows)
    assert sorted(r[:5] for r in got if r[0] is not None) == sorted(r[:5] for r in want if r[0] is not None)
    assert len(got) == len(want)
    by_id = {(r[0], r[2], r[3]): r[5] for r in want}
    for r in got:
        assert math.isclose(r[5], by_id[r[0], r[2], r[3]], rel_tol=1e-9, abs_tol=1e-9)
        assert math.isfinite(r[6]) and r[6] <= 0


ROWS = [(i, f"the Cat sat on the mat {i % 5}\tand\nthe dog {'ate ' * (i % 4)}É é") for i in range(60)] + [
    (100, None), (101, ""), (102, " \n "), (None, "the cat"), (None, "the cat"), (3, "the other text"), (104, "x " * 5000)]


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 100, "sample_part": 1}])
def test_counts_and_base_equal_brute_force(spark, options):
    df = spark.createDataFrame([(d, t, "s") for d, t in ROWS], SCHEMA).repartition(3)
    out = py.scores(df, **options)
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    compare(out.collect(), ROWS)


def test_table_is_scored_better_than_by_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = py.scores(docs).collect()
    compare(got, rows)
    own = [r for r in got if r.held_out]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)
    assert got and sorted(got) == sorted(py.scores(docs).collect())


def test_empty_table(spark):
    assert py.scores(spark.createDataFrame([], SCHEMA)).collect() == []


def test_probabilities_of_a_context_sum_to_one():
    """Over all words and the unknown one, after any seating."""
    rng = np.random.default_rng(0)
    words_, contexts = 40, 3
    count = rng.integers(0, 6, (words_, contexts))
    count[:, 0] += 1
    code = np.sort(rng.integers(0, 1 << 60, words_).astype(np.uint64))
    context = np.tile(np.arange(contexts), words_).astype("<u2")
    blob = py.pack_arrays(code, np.full(words_, contexts, "<u4"), context, count.ravel().astype("<i8"))
    none, nothing = np.zeros(0, np.uint64), np.zeros(0)
    by_context = np.bincount(context, count.ravel(), py.CONTEXTS)
    g = py.Shared(by_context, by_context / 2, int(count.sum()), words_, 0.0, 0.0, 0.6, 0.5, none, nothing, nothing,
                  nothing, none, nothing, nothing)
    s = py.Settings()
    seating = py.Seating(blob, g, s, 0, 0)
    seating.sweep()
    g.tables = np.bincount(context, seating.t, py.CONTEXTS)
    g.customers, g.parent_tables = float(seating.t.sum()), float(seating.parent.sum())
    seating.back = (s.strength + g.discount * g.tables)[context]
    uniform = (s.parent_strength + g.parent_discount * g.parent_tables) / (g.words + 1)
    seating.p = (seating.served - g.parent_discount * seating.parent + uniform) / (s.parent_strength + g.customers)
    p = seating.predictive().reshape(words_, contexts)
    unknown = uniform / (s.parent_strength + g.customers)
    for c in range(contexts):
        back = (s.strength + g.discount * g.tables[c]) / (s.strength + by_context[c])
        assert math.isclose(p[:, c].sum() + back * unknown, 1.0, rel_tol=1e-9)


def test_tables_follow_the_restaurant():
    rng = np.random.default_rng(1)
    for n, odds, d in ((2, 0.5, 0.5), (10, 1.0, 0.7), (300, 3.0, 0.6)):
        t = py.tables(np.full(4000, n), np.full(4000, odds), d, rng)
        seats = np.ones(4000)
        for i in range(1, n):
            seats += rng.random(4000) < odds / (odds + i - d * seats)
        assert abs(t.mean() - seats.mean()) < 5 * seats.std() / 60 + 0.02 * seats.mean()


def peak(work):
    """Bytes held at once while ``work`` runs, and its result."""
    tracemalloc.start()
    try:
        out = work()
        return tracemalloc.get_traced_memory()[1], out
    finally:
        tracemalloc.stop()


def test_packing_arrays_makes_no_copy_of_all():
    arrays = np.arange(500_000), np.zeros((1000, 300), "u1"), np.zeros(0, "<u4"), np.arange(20, dtype="<u4")[::2]
    most, blob = peak(lambda: py.pack_arrays(*arrays))
    assert most < sum(a.nbytes for a in arrays)
    for a, b in zip(arrays, py.unpack_arrays(blob, "<i8", "u1", "<u4", "<u4"), strict=True):
        assert np.array_equal(a.ravel(), b)


def test_a_shard_is_gathered_with_few_bytes_a_posting():
    rng = np.random.default_rng(4)
    chunks, each, words_ = 6, 100_000, 30_000
    code, blobs = np.sort(rng.integers(0, 1 << 60, words_).astype(np.uint64)), []
    for _ in range(chunks):
        runs = np.bincount(rng.integers(0, words_, each), minlength=words_).astype("<u4")
        blobs.append(py.pack_arrays(code, runs, rng.integers(0, 50, each).astype("<u2"),
                                    rng.integers(0, 900, each).astype("<u4"), np.ones(each, "<u4"), np.ones(900, "u1")))
    table = pa.table({"kind": pa.array([0] * chunks, pa.int32()), "key": pa.array([7] * chunks, pa.int64()),
                      "chunk": pa.array(range(chunks), pa.int64()), "blob": pa.array(blobs, pa.binary())})
    none = np.zeros(0, np.uint64)
    most, out = peak(lambda: py._gather(none, none)(table))
    assert most < 64 * chunks * each
    _, _, _, count = py.unpack_arrays(out.column("rows")[0].as_py(), "<u8", "<u4", "<u2", "<i8")
    assert count.sum() == chunks * each


def test_seatings_of_shards_are_not_held_together(monkeypatch):
    """When the places of a shard are read, its seating and that of the shard before are gone."""
    live = []

    class Watched(py.Seating):
        def __init__(self, *args):
            assert not live
            live.append(1)
            super().__init__(*args)

        def __del__(self):
            live.clear()

    monkeypatch.setattr(py, "Seating", Watched)
    none, nothing = np.zeros(0, np.uint64), np.zeros(0)
    g = py.Shared(np.full(py.CONTEXTS, 2), np.ones(py.CONTEXTS), 4, 2, 4.0, 2.0, 0.6, 0.5, none, nothing, nothing, nothing,
                  none, nothing, nothing)
    blob = py.pack_arrays(np.array([3, 9], "<u8"), np.ones(2, "<u4"), np.zeros(2, "<u2"), np.array([2, 2], "<i8"))
    places = py.pack_arrays(np.array([0], "<i8"), *(np.array(x, "<u4") for x in ([0, 0], [0, 1], [2, 2], [0, 1])))
    for key in range(3):
        out = py._document_sums(key, blob, places, g, py.Settings())
        assert not live and out.num_rows == 1
        known, base, total = py.unpack_arrays(out.column("blob")[0].as_py(), "<i8", "<f8", "<f8")
        assert known.tolist() == [2, 2] and np.allclose(base, 2 * math.log10(3 / 7)) and (total < 0).all()
        py._table_sums(key, blob, g, py.Settings(), 0)
        assert not live
