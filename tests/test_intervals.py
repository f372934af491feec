import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmith.operators import intervals


def painted(incidents, horizon):
    """Plain second-by-second painting, one incident after the other."""
    label = np.zeros(horizon, dtype=int)

    def write(lo, hi, value):
        for t in range(lo, hi + 1):
            if t < horizon and label[t] != 2:
                label[t] = value

    for sc, ec, se, ee, kind in incidents:
        if kind == 0:
            continue
        if sc == 0 and ec == 0:
            write(se, ee, 2)
            if kind == 3:
                write(0, 0, 1)
        elif sc == 0:
            write(sc, ec, 1)
            write(se, ee, 2)
        if se == 0 or ee == 0:
            write(sc, ec, 1)
        if sc and ec and se and ee:
            write(sc, ec, 1)
            write(se, ec, 2)
            write(max(ec, se), ee, 3)
    return label


@pytest.mark.parametrize("max_rows", [15, 100_000])
def test_incident_labels_match_painting(spark, max_rows):
    rng = np.random.default_rng(8)
    horizon, rows, want = 120, [], {}
    for e in range(25):
        incidents = []
        for _ in range(rng.integers(0, 7)):
            times = [0 if rng.random() < 0.25 else int(rng.integers(1, horizon)) for _ in range(4)]
            incidents.append((*times, int(rng.integers(0, 4))))
        rows += [(e, i, *inc) for i, inc in enumerate(incidents)]
        want[e] = painted(incidents, horizon)
    inc = spark.createDataFrame(rows, "e int, i int, sc int, ec int, se int, ee int, kind int")
    grid = spark.range(25).select(F.col("id").cast("int").alias("e"),
                                  F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("t"))
    rules = intervals.incident_rules(inc, "sc", "ec", "se", "ee", "kind", "i")
    got = intervals.label_incidents(grid, rules, ["e"], "t", ["i"], max_rows=max_rows).toPandas()
    assert len(got) == 25 * horizon
    for e, g in got.groupby("e"):
        assert (g.sort_values("t")["label"].to_numpy() == want[e]).all(), e


def test_negative_times(spark):
    spans = [(lo, lo + n) for lo in range(-40, 10, 3) for n in (0, 3, 17)]
    iv = spark.createDataFrame([(1, lo, hi, i) for i, (lo, hi) in enumerate(spans)], "e int, lo int, hi int, w int")
    rows = spark.range(-60, 60).select(F.lit(1).alias("e"), F.col("id").alias("t"))
    got = intervals.last_writer(rows, iv, ["e"], "t", "lo", "hi", ["w"], "w", "w").collect()
    for r in got:
        assert r["w"] == max((i for i, (lo, hi) in enumerate(spans) if lo <= r["t"] <= hi), default=None), r


@pytest.mark.parametrize("max_rows", [40, 100_000])
def test_last_writer_with_many_overlaps(spark, max_rows):
    rng = np.random.default_rng(9)
    spans = [("a", int(lo), int(lo + rng.integers(0, 5000)), i) for i, lo in enumerate(rng.integers(0, 4000, 300))]
    times = rng.integers(0, 10_000, 500)
    rows = spark.createDataFrame([("a", j, int(t)) for j, t in enumerate(times)], "e string, j int, t int")
    iv = spark.createDataFrame(spans, "e string, lo int, hi int, w int")
    got = intervals.last_writer(rows, iv, ["e"], "t", "lo", "hi", ["w"], "w", "w", max_rows).toPandas().sort_values("j")
    for t, w in zip(times, got["w"]):
        cover = [i for _, lo, hi, i in spans if lo <= t <= hi]
        assert (max(cover) if cover else None) == (None if np.isnan(w) else int(w))


def test_pieces_cover_exactly(spark):
    spans = [(i, lo, hi) for i, (lo, hi) in enumerate([(0, 0), (0, 7), (3, 3), (1, 30), (5, 64), (63, 64)])]
    df = spark.createDataFrame(spans, "i int, lo int, hi int")
    seg = intervals.segments(df, ["i"], "lo", "hi", ["lo"], ["lo"])
    got = {(r["i"], r["start"]): r["winner"] is not None for r in seg.collect()}
    assert got == {**{(i, lo): True for i, lo, _ in spans}, **{(i, hi + 1): False for i, _, hi in spans}}


def test_placeholder_for_dropped_incidents(spark):
    inc = spark.createDataFrame([("a", " noise", 1), ("b", "leak", 2)], "e string, d string, kind int")
    exps = spark.createDataFrame([("a",), ("b",), ("c",)], "e string")
    got = {r["e"]: r["kind"] for r in intervals.drop_incidents(inc, exps, ["e"], "d", "kind", ["noise"]).collect()}
    assert got == {"a": 0, "b": 2, "c": 0}


def test_patches_overwrite_inclusive_ranges(spark):
    rows = spark.createDataFrame([("e", t, 1.0, 2.0) for t in range(6)], "e string, t int, x double, y double")
    patch = spark.createDataFrame([("e", "x", 1, 3, 9.0, 0), ("e", "x", 3, 4, 8.0, 1), ("e", "y", 0, 0, 7.0, 2)],
                                  "e string, feature string, start int, end int, value double, patch_order int")
    got = intervals.patch_ranges(rows, patch, ["e"], "t", ["x", "y"]).orderBy("t").collect()
    assert [r["x"] for r in got] == [1, 9, 9, 8, 8, 1] and [r["y"] for r in got] == [7, 2, 2, 2, 2, 2]


def test_label_grid_of_long_spans(spark):
    rows = [("a", 5), ("a", 5 + 3 * 9000), ("b", -7), ("c", 0), ("c", 50_000_001), (None, 1), (None, 4), ("d", None)]
    df = spark.createDataFrame(rows, "k string, t long")
    grid = intervals.label_grid(df, ["k"], "t", "at", step=3)
    found = {r["k"]: (r["n"], r["lo"], r["hi"], r["d"]) for r in grid.groupBy("k").agg(
        F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.countDistinct("at").alias("d")).collect()}
    assert found == {"a": (9001, 5, 27005, 9001), "b": (1, -7, -7, 1), None: (2, 1, 4, 2),
                     "c": (16_666_668, 0, 50_000_001, 16_666_668)}
    bad = spark.createDataFrame([("x", -(1 << 62)), ("x", 1 << 62)], "k string, t long")
    with pytest.raises(Exception, match="has more than"):
        intervals.label_grid(bad, ["k"], "t").count()


def test_sweep_equals_cells_and_painting(spark):
    """Null keys, null priorities, nested and touching intervals, keys that span Arrow batches."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(1500):
        lo = int(rng.integers(-50, 400))
        key = None if i % 5 == 0 else "a" if i % 2 else f"k{i % 7}"
        rows.append((key, i % 3, lo, lo + int(rng.choice([-1, 0, 1, 7, 90])), None if i == 7 else i))
    df = spark.createDataFrame(rows, "k string, f int, lo int, hi int, p int")
    want = {}
    for k, f, lo, hi, p in rows:
        for t in range(lo, hi + 1):
            want[k, f, t] = max(want.get((k, f, t), -1), -1 if p is None else p)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        for limit in (10, 200, 10_000):
            large = intervals.find_large_keys(df, ["k"], limit)
            assert (large.marks is None) == (limit == 10_000)
            got, points = {}, {}
            for r in intervals.segments(df, ["k", "f"], "lo", "hi", ["p"], ["p", "lo"], large, ["k"]).collect():
                points.setdefault((r["k"], r["f"]), []).append((r["start"], r["winner"]))
            for (k, f), found in points.items():
                found.sort(key=lambda x: x[0])
                assert len({s for s, _ in found}) == len(found) and found[-1][1] is None
                for (s, w), (e, _) in zip(found, found[1:]):
                    got.update({(k, f, t): -1 if w["p"] is None else w["p"] for t in range(s, e) if w is not None})
            assert got == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_no_intervals(spark):
    df = spark.createDataFrame([], "k string, lo int, hi int")
    assert intervals.segments(df, ["k"], "lo", "hi", ["lo"], ["lo"]).collect() == []
    rows = spark.createDataFrame([("x", 1)], "k string, t int")
    assert intervals.last_writer(rows, df, ["k"], "t", "lo", "hi", ["lo"], "hi", "v").first()["v"] is None
