import random

import numpy as np
import pytest

import __spark_entry__ as se
from seriesmith.llm import rtree

SCHEMA = "vec_id long, embedding array<double>, label long, code string, wid int, found string"
TEST_SF = "/root/testdata/sf0.001"


def brute(rows, every=100, positives=5, negatives=10, low=30, high=90):
    valid = {(i, tuple(v), k) for i, v, k in rows if i is not None and v and k is not None
             and all(c is not None and np.isfinite(c) for c in v)}
    coded = [(i, [int(np.floor(256.0 * c)) for c in v], k) for i, v, k in valid]
    out = []
    for a, x, k in coded:
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, label) for i, y, label in coded)
        same = [(i, -s) for s, i, label in scored if label == k and i != a][:positives]
        for p, p_score in same:
            near = [(i, -s) for s, i, label in scored if label != k and low * p_score <= -100 * s <= high * p_score]
            out += [(a, p, r + 1, i, p_score, s) for r, (i, s) in enumerate(near[:negatives])]
    return sorted(out)


def rows_of(df):
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[c] for c in names) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(i, v, k, "x", 1, "y") for i, v, k in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("shard_rows,leaf_rows,labels", [(8192, 128, 4), (60, 8, 4), (25, 4, 200), (50, 16, 1)])
def test_equals_brute_force(spark, shard_rows, leaf_rows, labels):
    rng = random.Random(shard_rows)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(600):
        c = rng.choice(centres)
        rows.append((i, [round(x + rng.gauss(0, 0.4), 1) for x in c], rng.randrange(labels)))  # many ties
    rows += [(1000 + i, rows[100][1], rows[100][2]) for i in range(0, 300)]  # a hot vector, of one label and another
    rows += [(2000 + i, rows[100][1], 1) for i in range(40)]
    rows += [(3000, None, 1), (3100, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (3200, [float("nan")] * 6, 1), (3300, [], 1),
             (3400, [1.0] * 6, None), (None, [1.0] * 6, 1), (3500, [0.0] * 6, 1), (3600, [float("inf")] * 6, 0),
             rows[0], rows[0]]
    found = rtree.hard_negatives(table(spark, rows), shard_rows=shard_rows, leaf_rows=leaf_rows)
    assert rows_of(found) == brute(rows)


def test_large_numbers_stay_exact(spark):
    rng = random.Random(2)
    rows = [(i * 20, [rng.uniform(-1, 1) * (10.0 ** rng.choice([0, 5])) for _ in range(3)], i % 2) for i in range(120)]
    assert rows_of(rtree.hard_negatives(table(spark, rows), shard_rows=20, leaf_rows=4)) == brute(rows)


def test_empty_and_single(spark):
    assert rtree.hard_negatives(table(spark, [])).collect() == []
    assert rtree.hard_negatives(table(spark, [(100, [1.0], 1)])).collect() == []


def test_windows_of_a_tree_against_all_rows():
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.integers(0, 3, (500, 1)), rng.integers(-20, 20, (500, 4))], 1)
    tree = rtree.Tree(rows, [[i, i + 1000] for i in range(500)], 8)
    for q in rows[:20]:
        scores = rows[:, 1:] @ q[1:]
        windows = [(True, -50, 300, 7, -rtree.NEVER, 0), (False, 10, 90, 5, -rtree.NEVER, 0), (False, 0, 400, 6, 120, -40)]
        for (same, low, high, keep, floor, floor_id), got in zip(windows, tree.search(q, windows)):
            want = sorted(((int(s), -v) for i, s in enumerate(scores) if (rows[i, 0] == q[0]) == same and low <= s <= high
                           for v in (i, i + 1000) if (s, -v) > (floor, floor_id)), reverse=True)[:keep]
            assert sorted(got, reverse=True) == want


def test_boxes_leave_nodes_out():
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, (4096, 2))
    tree = rtree.Tree(np.concatenate([np.zeros((4096, 1), int), x], 1), [[i] for i in range(4096)], 32)
    seen = []
    scores_of = lambda leaf: (seen.append(leaf), tree.rows[slice(*tree.span[leaf])] @ np.array([1, 2]))[1]
    most = np.maximum(tree.low, tree.high) @ np.array([1, 2])
    least = tree.low @ np.array([1, 2])
    got = tree._window(1, most, least, np.ones(len(most), bool), False, scores_of, 100, 200, 10, -rtree.NEVER, 0)
    assert len(got) == 10 and len(set(seen)) < tree.leaves / 2


def test_query_flips_labels(spark):
    rows = [(r.vec_id, [float(v) for v in r.embedding], (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label)
            for r in spark.read.parquet(f"{TEST_SF}/embeddings.parquet").collect()]
    assert rows_of(se.queries()["op11_hard_negatives"](spark, TEST_SF)) == brute(rows)
