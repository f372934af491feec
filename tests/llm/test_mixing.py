import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from seriesmith.llm import mixing
from seriesmith.llm.common import prefix_sums

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string"


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), 7, "k") for d, t, s in rows], SCHEMA).repartition(3)


def sample(seed=1, n=200):
    rng = random.Random(seed)
    sources = ["b", "a", None, "ä", "z", "B"]
    rows = [(i, " \n".join(["w\tx"] * rng.randint(0, 20)), rng.choice(sources + ["b"] * 6)) for i in range(n)]
    return rows + [(n, None, "a"), (n + 1, "", "a"), (None, "null id", "b"), (5, rows[5][1], rows[5][2]),
                   (5, rows[5][1], rows[5][2]), (n + 2, "y " * 3000, "a"), (n + 3, "", "empty source")]


def targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped, level = sum(sizes.values()), set(), None
    while True:
        rest = sum(weight[s] for s in names if s not in capped)
        if not rest:
            return {s: float(cap * sizes[s]) for s in names}
        level = (total - sum(cap * sizes[s] for s in capped)) / rest
        now = {s for s in names if cap * sizes[s] <= level * weight[s]}
        if now == capped:
            return {s: float(cap * sizes[s]) if s in capped else level * weight[s] for s in names}
        capped = now


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_and_budgets(spark):
    rows = sample()
    out = mixing.mix(table(spark, rows)).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    want, taken = targets(sizes), defaultdict(int)
    assert sorted((r.doc_id or -1, r.size) for r in out) == sorted((d or -1, words(t)) for d, t, _ in rows)
    for r in out:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert {s: taken[s] for s in sizes} == {s: math.floor(want[s] + 1e-9) for s in sizes}


def test_reruns_agree_whatever_the_partitions(spark):
    df = table(spark, sample(2))
    first = sorted(map(str, mixing.mix(df).collect()))
    assert first == sorted(map(str, mixing.mix(df.repartition(7)).collect()))


def test_mixed_documents_hold_the_taken_words(spark):
    rows = sample(3)
    df = table(spark, rows)
    out = mixing.mixed_documents(df)
    assert out.schema == df.schema
    got = Counter()
    for r in out.collect():
        got[r.source] += words(r.text)
        assert r.n_chars == len(r.text) and words(r.text) > 0
    want = Counter()
    for r in mixing.mix(df).collect():
        want[r.source] += r.taken
    assert got == +want
    texts = {(d, s): t for d, t, s in rows}
    assert all((texts[r.doc_id, r.source] or "").startswith(r.text) for r in out.collect())


def test_empty_table(spark):
    assert mixing.mix(table(spark, [])).collect() == []
    assert mixing.mixed_documents(table(spark, [])).collect() == []


@pytest.mark.parametrize("partitions", [1, 5])
def test_prefix_sums_equal_a_loop(spark, partitions):
    rng = random.Random(4)
    rows = [(rng.choice([None, "a", "b", "b", "b"]), i, rng.randint(0, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o long, v long").repartition(4)
    got = {(r.k, r.o): r.before for r in prefix_sums(df, ["k"], [F.col("o")], "v", "before", partitions).collect()}
    sums = Counter()
    for k, o, v in rows:
        assert got[k, o] == sums[k]
        sums[k] += v
