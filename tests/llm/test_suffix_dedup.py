import hashlib
import random

import pytest

from seriesmith.llm import common
from seriesmith.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, rank string"


def brute(rows, length=50):
    none = float("inf")
    first = {}
    for doc, text in rows:
        data = (text or "").encode()
        for p in range(len(data) - length + 1):
            s = data[p:p + length]
            first[s] = min(first.get(s, none), none if doc is None else doc)
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if first[data[p:p + length]] < (none if doc is None else doc):
                gone[p:p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
    out = sd.suffix_dedup(df, **options)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted(map(tuple, out.collect()), key=str)


def sample(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "of", "ander", "tion", "é", "größe", "a", "in", "thereof", "|", "日本"]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages = [text(rng.randint(8, 40)) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.4 else text(rng.randint(0, 60)) for _ in range(4)]
        rows.append((i, rng.choice(["", " ", "\n"]).join(parts)))
    rows += [(n + 1, rows[3][1]), (n + 2, rows[3][1][:-1]), (None, rows[5][1]), (None, rows[5][1]), (n + 3, None),
             (n + 4, ""), (7, rows[7][1]), (8, rows[9][1]), (n + 5, "a" * 500), (n + 6, "a" * 49), (n + 7, "b" + "a" * 120),
             (n + 8, "ab" * 3000), (n + 9, "ba" * 40)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"hot_documents": 2}, {"block_bytes": 2000}])
def test_equals_brute_force(spark, options):
    rows = sample(1)
    assert found(spark, rows, **options) == brute(rows)


@pytest.mark.parametrize("hot_documents", [2, 20_000])
def test_openings_inside_other_documents(spark, hot_documents):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    rows = []
    for i in range(400):
        opening = text(rng.choice([50, 51, 70]))
        whole, inside = opening + text(40), text(rng.randint(1, 60)) + opening + text(rng.randint(0, 40))
        rows += [(2 * i, whole), (2 * i + 1, inside)] if i % 2 else [(2 * i, inside), (2 * i + 1, whole)]
        if i % 10 == 0:
            rows += [(1000 + 3 * i + k, text(k) + opening) for k in range(3)]
    assert found(spark, rows, hot_documents=hot_documents, block_bytes=3000) == brute(rows)


def test_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, sd.suffix_dedup(docs).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_documents_keep_their_columns(spark):
    rows = sample(2)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
    out = sd.deduplicated_documents(df)
    assert out.schema == df.schema
    kept = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None}
    assert "" in kept.values() and max(kept) >= 60
    digests = {r[0]: r for r in brute(rows)}
    for doc, text in kept.items():
        if doc not in (7, 8) and digests[doc][2] == 0:
            assert hashlib.sha256((text or "").encode()).hexdigest() == digests[doc][4]


def test_merge_yields_prefixes_in_order():
    rng = random.Random(3)
    runs = [sorted("".join(rng.choice("ab") for _ in range(12)).encode() for _ in range(rng.randint(0, 30)))
            for _ in range(7)]
    share = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), 12)
    coded = [(r, [0] + [share(a, b) for a, b in zip(r, r[1:])]) for r in runs]
    got = list(sd.merge_runs([(r, p[:len(r)]) for r, p in coded]))
    strings = [runs[r][i] for _, r, i in got]
    assert strings == sorted(s for r in runs for s in r)
    assert [p for p, _, _ in got][1:] == [share(a, b) for a, b in zip(strings, strings[1:])]


def test_documents_are_cut_and_decoded_by_one_worker(spark):
    """Two Python steps in one stage keep two workers for each core, each with its own memory."""
    same = "é shared passage of well over fifty bytes, seen in two documents é"
    rows = [(1, same), (2, "own " + same), (3, same), (4, None), (5, ""), (6, "short")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
    out = sd.deduplicated_documents(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.doc_id != 4) == [(1, same), (2, "own "), (5, ""), (6, "short")]
    assert [r.text for r in out.collect() if r.doc_id == 4] == [None]


def test_freed_memory_is_given_back_at_the_end(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    batches = common.tidy(lambda left, right: left + right), common.tidy(lambda table: table)

    @common.tidy
    def many(parts):
        yield from parts

    assert [batches[0](1, 2), batches[1](3), *many([4, 5])] == [3, 3, 4, 5] and len(calls) == 3
