import random
import re
import zlib
from collections import Counter

import pytest

from seriesmith.llm import spelling

SCHEMA = "doc_id long, text string, word long, n string, key int"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_vocabulary(rows, least_count=5):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= least_count}


def brute(vocabulary):
    near = {w: [v for v in vocabulary if v != w and one_edit(v, w)] for w in vocabulary}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-vocabulary[v], v), default=None)
        form[w] = best if best is not None and vocabulary[best] >= 5 * vocabulary[w] else None
    out = []
    for w in vocabulary:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, vocabulary[w], len(near[w]), form[w], None if form[w] is None else vocabulary[form[w]], root))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


def family(rng, letters, words):
    """Random words with some of their neighbours, and neighbours of those."""
    out = set()
    for _ in range(words):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(6, 14)))
        for _ in range(rng.randint(1, 6)):
            out.add(w)
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1:]])
    return sorted(w for w in out if len(w) >= 6)


@pytest.mark.parametrize("letters,limit", [("abc", 4), ("abcdefghéñ", 20_000), ("ab", 1)])
def test_variants_equal_brute_force(spark, letters, limit):
    rng = random.Random(len(letters))
    words = {w: rng.choice([5, 6, 25, 30, 125, 700]) for w in family(rng, letters, 60)}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert rows_of(spelling.variants(df, partition_words=limit)) == brute(words)


def test_long_words_and_one_hot_prefix(spark):
    long = "z" * 1500
    words = dict.fromkeys([long, long[:700] + "y" + long[701:], long + "z", *(f"prefix{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20))], 9)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows_of(spelling.variants(df, partition_words=50)) == brute(words)


def test_documents_equal_brute_force(spark):
    rng = random.Random(4)
    common = family(rng, "aberstü", 40)
    rows = [(i, " ".join(rng.choice(common).title() + rng.choice([",", "-", "1", "×", ""]) for _ in range(120)))
            for i in range(120)]
    rows += [(200, None), (201, ""), (202, " 123 中文 "), (None, rows[3][1]), (5, rows[4][1]), (5, rows[4][1]),
             (203, "Verylong " * 30_000)]
    df = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], SCHEMA).repartition(5)
    assert rows_of(spelling.spelling_variants(df)) == brute(brute_vocabulary(rows))


def test_acceptor_is_minimal_and_exact():
    words = sorted({"tap", "taps", "top", "tops", "stop", "stops", ""})
    acceptor = spelling.Acceptor(words)

    def language(state):
        return ({""} if acceptor.accepts[state] else set()) | {
            a + w for a, q in acceptor.next[state].items() for w in language(q)}

    assert language(acceptor.start) == set(words)
    assert len({frozenset(language(s)) for s in range(len(acceptor.next))}) == len(acceptor.next)
    assert {tuple(sorted(p)) for p in acceptor.pairs()} == {
        (a, b) for a in words for b in words if a < b and one_edit(a, b)}


def test_empty_table(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []
