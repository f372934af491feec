import random

import pytest
import xxhash

from seriesmith.llm import simhash
from seriesmith.llm.components import connected_components

SCHEMA = "doc_id long, text string, fp string, component_id string"


def fingerprint(text):
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    shingles = [b" ".join(ws[i:i + 3]) for i in range(max(1, len(ws) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((sum(h >> i & 1 for h in hashes) * 2 > len(hashes)) << i for i in range(64))


def classes(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def brute(rows):
    fps = [fingerprint(t) for _, t in rows]
    of = classes(sorted(set(fps)), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (d, _), f in zip(rows, fps):
        if d is not None:
            least[of[f]] = min(d, least.get(of[f], d))
    return sorted(((d, f"{f:016x}", least.get(of[f])) for (d, _), f in zip(rows, fps)), key=str)


def sample(seed=1):
    rng = random.Random(seed)
    ws = ["the", "Of", "and", "é", "x|", "tion"]
    base = [" ".join(rng.choice(ws) + str(rng.randint(0, 30)) for _ in range(rng.randint(60, 300))) for _ in range(20)]
    rows = []
    for i in range(150):
        t = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(ws)
        rows.append((i, "\n\t ".join(t) if i % 2 else " ".join(t).upper().replace("É", "é")))
    rows += [(200, None), (201, ""), (202, " \x0b "), (203, "one"), (204, "ONE"), (205, "one two"), (None, rows[3][1]),
             (None, "only null"), (7, rows[7][1]), (7, rows[7][1]), (8, "another text with id eight"),
             (206, "again " * 200_000)]
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    rows = sample()
    df = spark.createDataFrame([(d, t, "f", "c") for d, t in rows], SCHEMA).repartition(3)
    out = simhash.near_duplicates(df)
    got = [(r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in out.collect()]
    assert sorted(got, key=str) == brute(rows)
    text = out.select(simhash.hexadecimal(out.fp).alias("h")).collect()
    assert sorted(r.h for r in text) == sorted(h for _, h, _ in got)


def test_kept_documents(spark):
    rows = sample(2)
    df = spark.createDataFrame([(d, t, "f", "c") for d, t in rows], SCHEMA)
    kept = simhash.kept_documents(df)
    assert kept.schema == df.schema
    found = [(r.doc_id, fingerprint(r.text)) for r in kept.collect()]
    of = classes(sorted({fingerprint(t) for _, t in rows}), lambda a, b: (a ^ b).bit_count() <= 2)
    assert sorted(of[f] for _, f in found) == sorted(set(of.values()))
    least = {f: c for _, f, c in brute(rows)}
    assert all(d == least[f"{f:016x}"] for d, f in found)


def test_planted_distances(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(30)]
    for f in list(fps):
        a = f ^ 1 << rng.randrange(64)
        fps += [a, a ^ 1 << rng.randrange(64), f ^ 0b111 << rng.randrange(60)]
    fps = sorted(set(fps) | {0, 1, 3, (1 << 64) - 1, (1 << 63)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r.node: r.component for r in connected_components(simhash.links(df)).collect()}
    want = classes(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    assert {n: got.get(n, n) for n in signed} == want


def test_odd_radius_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 3)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(df).collect() == [] and simhash.kept_documents(df).collect() == []


def test_components_of_paths_stars_and_noise(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(500, 500), (None, 3)]
    links += [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "x long, y long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    nodes = sorted({n for link in real for n in link})
    pairs = set(real)
    assert got == classes(nodes, lambda a, b: (a, b) in pairs)
