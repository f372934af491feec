import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmith.llm import common, quality, toxicity

SCHEMA = "doc_id long, text string, score string, label string"
BAD = ["trash", "idiots", "pathetic"]


def corpus(n=1500, seed=1):
    rng = random.Random(seed)
    parts = ["the", "an", "tion", "er", "ou", "ing", "be", "st", "ré", "ly"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))
    rows, labels = [], []
    for i in range(n):
        ws = [word() for _ in range(rng.randint(5, 60))]
        toxic, good = i % 5 == 0, i % 7 != 0
        if toxic:
            for _ in range(1 + len(ws) // 10):
                ws[rng.randrange(len(ws))] = rng.choice(BAD)
        if not good:
            ws = [w.upper() + "!!" for w in ws] if i % 2 else [w for w in ws for _ in range(5)]
        rows.append((i, " ".join(ws)))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


def frames(spark, rows, labels):
    return (spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA).repartition(3),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


ODD = [(5000, None), (5001, ""), (5002, " \n "), (None, "trash trash idiots"), (3, "a repeated id"), (3, "a repeated id"),
       (5003, "Word " * 50_000), (5004, "\x00 � 日本 !!! 12")]


def held(doc):
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % 5 == 0


def accuracy(out, truth):
    own = [(r.predicted, truth[r.doc_id]) for r in out if r.held_out and r.doc_id in truth]
    return np.mean([p == t for p, t in own])


def test_toxicity(spark):
    rows, labels = corpus()
    docs, marks = frames(spark, rows + ODD, labels + [(None, 1, 1), (0, 1, None), (99999, 0, 1)])
    out = toxicity.toxicity(docs, marks).collect()
    assert len(out) == len(rows) + len(ODD)
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    truth = {d: t for d, _, t in labels if d != 3}
    assert accuracy(out, truth) > 0.95
    again = toxicity.toxicity(docs.repartition(5), marks).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_misspellings_share_subwords(spark):
    docs, marks = frames(spark, *corpus())
    model, bias = toxicity.fit(docs, marks)
    probe = spark.createDataFrame([(1, "the ing traash idiotss an", "x", "y"), (2, "the ing an er ou", "x", "y")], SCHEMA)
    by_id = {r.doc_id: r.score for r in toxicity.score(probe, model, bias).collect()}
    assert by_id[1] > 0.5 > by_id[2]


def test_clean_documents_keep_columns(spark):
    rows, labels = corpus(600)
    docs, marks = frames(spark, rows + ODD, labels)
    kept = toxicity.clean_documents(docs, marks)
    assert kept.schema == docs.schema
    ids = [r.doc_id for r in kept.collect()]
    toxic = {d for d, _, t in labels if t}
    assert sum(d in toxic for d in ids) < 0.1 * len(toxic) and sum(d not in toxic for d in ids) > 0.95 * 480


def test_held_out_labels_do_not_matter(spark):
    rows, labels = corpus(300)
    docs, marks = frames(spark, rows, labels)
    _, turned = frames(spark, rows, [(d, 1 - q, 1 - t) if held(d) else (d, q, t) for d, q, t in labels])
    for run in (toxicity.toxicity, quality.quality):
        assert sorted(run(docs, marks).collect()) == sorted(run(docs, turned).collect())


def test_quality(spark):
    rows, labels = corpus()
    docs, marks = frames(spark, rows + ODD, labels + [(None, 1, 1), (0, None, 0)])
    out = quality.quality(docs, marks).collect()
    assert len(out) == len(rows) + len(ODD)
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert accuracy(out, {d: q for d, q, _ in labels if d != 3}) > 0.95


@pytest.mark.parametrize("run", [toxicity.toxicity, quality.quality])
def test_without_labels_or_documents(spark, run):
    docs, marks = frames(spark, [(1, "a"), (2, None)], [(1, 1, 1)])
    none = marks.filter(F.lit(False))
    assert [r.score for r in run(docs, none).collect()] == [0.5, 0.5]
    assert run(docs.filter(F.lit(False)), marks).collect() == []


def test_context_vectors_equal_a_loop():
    s = quality.Settings(words=20, shapes=4, size=8, marks=2)
    index, rng = quality.index_vectors(s), np.random.default_rng(1)
    found = rng.integers(0, s.rows, 60).astype(np.int32)
    found[20:22] = -1
    total = np.zeros((s.rows, s.size + 1), np.int64)
    quality._add_contexts(total, found, index, 2)
    want = np.zeros_like(total)
    for i, w in enumerate(found):
        if w >= 0:
            want[w, -1] += 1
            for j in range(max(0, i - 2), min(len(found), i + 3)):
                if j != i and found[j] >= 0:
                    want[w, :-1] += index[found[j]]
    assert (total == want).all()
    assert ((index != 0).sum(1) == 2).all()


def test_temperature_minimises_the_loss():
    rng = np.random.default_rng(2)
    z = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(float)
    assert abs(quality.temperature(3 * z, y) - 3) < 0.4


@pytest.mark.parametrize("even", [False, True])
def test_sample_is_bounded_when_an_id_repeats(spark, even):
    rows = [(1, "a copy")] * 2000 + [(1, f"text {i}") for i in range(2000)] + [(i, f"own {i}") for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, toxic int")
    found = common.labelled_sample(docs, labels, "toxic", 60, even=even).collect()
    assert 30 <= len(found) <= 60 and len({(r.doc_id, r.text) for r in found}) == len(found)
    assert {(r.doc_id, r.text) for r in found} <= set(rows) and all(r.label == r.doc_id % 2 for r in found)
