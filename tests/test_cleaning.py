import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmith.functions import expressions as ex
from seriesmith.operators import cleaning, joins, series


def test_scale_repair(spark):
    df = spark.createDataFrame([(78300.0, 0.9), (400.0, 1.1), (None, -1500.0)], "big double, small double")
    got = cleaning.repair_scales(df, {"big": 500, "small": 1}).collect()
    assert [r["big"] for r in got] == [78.3, 400.0, None]
    assert [r["small"] for r in got] == [0.9, 1.1 / 1000, -1500.0]
    assert cleaning.repair_scales(df, {"small": 1}, use_abs=True).collect()[2]["small"] == -1.5


@pytest.mark.parametrize("max_rows", [3, 1000])
def test_elapsed_time_clamps_the_named_entity_only(spark, max_rows):
    times = [10, 12, 15, 5, 6, 9]
    rows = [(e, i, t) for e in ("bad", "ok") for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "e string, i int, t int")
    out = series.elapsed_time(df, ["e"], ["i"], F.col("t"), F.col("e") == "bad", max_rows=max_rows)
    got = {e: [r["elapsed_time"] for r in out.filter(F.col("e") == e).orderBy("i").collect()] for e in ("bad", "ok")}
    assert got == {"bad": [0, 2, 5, 5, 6, 9], "ok": [0, 2, 5, -5, -4, -1]}


@pytest.mark.parametrize("max_rows", [2, 1000])
def test_resample(spark, max_rows):
    rows = [("a", 0, 10.0, None), ("a", 4, 22.0, 1.0), ("a", 6, None, 3.0), ("a", 7, None, None)]
    df = spark.createDataFrame(rows, "e string, t long, x double, y double")
    out = cleaning.resample_interpolate(df, ["e"], "t", ["x", "y"], max_rows=max_rows).orderBy("t").collect()
    assert [r["t"] for r in out] == list(range(8))
    assert [r["x"] for r in out] == [10, 13, 16, 19, 22, 22, 22, 22]
    assert [r["y"] for r in out] == [None, None, None, None, 1, 2, 3, 3]
    assert [r["quality"] for r in out] == [1, 2, 2, 2, 1, 2, 1, 1]


def test_resample_long_gap_is_chunked(spark):
    df = spark.createDataFrame([("a", 0, 0.0), ("a", 10000, 10000.0)], "e string, t long, x double")
    out = cleaning.resample_interpolate(df, ["e"], "t", ["x"])
    assert out.count() == 10001
    assert out.filter("abs(x - t) > 1e-6").count() == 0


@pytest.mark.parametrize("max_rows", [20, 10_000])
def test_runs_longer_than_fifty(spark, max_rows):
    mask = [1] * 50 + [0] * 3 + [1] * 51 + [0]
    df = spark.createDataFrame([("a", i, m) for i, m in enumerate(mask)], "e string, i int, m int")
    runs = cleaning.long_runs(df, ["e"], ["i"], F.col("m") == 1, 50, max_rows).collect()
    assert [(r["first_position"], r["run_length"]) for r in runs] == [(53, 51)]


@pytest.mark.parametrize("max_rows", [20, 10_000])
def test_phases_share_their_boundary_rows(spark, max_rows):
    heat = [0] * 5 + [1] * 95 + [0] * 10
    flow = [0] * 20 + [1] * 80 + [0] * 10
    rows = [("a", i, h, f) for i, (h, f) in enumerate(zip(heat, flow))] + [("idle", i, 0, 1) for i in range(60)]
    df = spark.createDataFrame(rows, "e string, i int, h int, f int")
    out = cleaning.split_phases(df, ["e"], ["i"], F.col("h") > 0, F.col("f") > 0, 50, max_rows)
    got = {r["phase"]: (r["a"], r["b"]) for r in out.groupBy("phase").agg(F.min("i").alias("a"), F.max("i").alias("b")).collect()}
    assert got == {"Startup": (5, 20), "Operation": (20, 97), "Shutdown": (97, 109)}
    assert out.filter("e = 'idle'").count() == 0


def test_every_key_has_a_phase_status(spark):
    rows = [("a", i, 1, 1) for i in range(60)] + [("idle", i, 0, 1) for i in range(60)] + [("short", i, 1, i % 2) for i in range(60)] \
        + [(None, i, None, None) for i in range(3)]
    df = spark.createDataFrame(rows, "e string, position int, h int, f int")
    out = cleaning.phase_status(df, ["e"], ["position"], F.col("h") > 0, F.col("f") > 0, 50)
    assert {r["e"]: (r["n_rows"], r["status"], r["operation_position"]) for r in out.collect()} == {
        "a": (60, "split", 0), "idle": (60, "never active", 0), "short": (60, "no long run", None), None: (3, "never active", None)}
    empty = cleaning.phase_status(df.limit(0), ["e"], ["position"], F.col("h") > 0, F.col("f") > 0, 50)
    assert empty.count() == 0


def test_uncertainty_rules(spark):
    rows = [("Pt100 class 1/3", "-", 100.0, 0.27), ("Pt100 class A", "-", 100.0, 0.35), ("Pt100 class B", "-", 100.0, 0.80),
            ("flow", "2", -100.0, 2.0), ("flow", "-", 5.0, 0.0), ("flow", "abc", 5.0, 0.0), (None, None, 5.0, None)]
    df = spark.createDataFrame(rows, "k string, p string, x double, want double")
    for r in df.withColumn("got", ex.uncertainty(F.col("k"), F.col("p"), F.col("x"))).collect():
        assert r["got"] == (None if r["want"] is None else pytest.approx(r["want"]))


def test_time_text(spark):
    df = spark.createDataFrame([("08:01:02",), ("2024-05-01 23:59:59",), (" ",), ("x",), (None,)], "t string")
    got = [r[0] for r in df.select(ex.normalize_time(F.col("t"))).collect()]
    assert got == ["08:01:02", "23:59:59", None, None, None]
    assert df.select(ex.seconds_of_day(F.lit("01:02:03"))).first()[0] == 3723
    assert df.select(ex.seconds_to_time(F.lit(3723))).first()[0] == "01:02:03"


def test_rounding_to_seconds_is_half_even(spark):
    df = spark.sql("SELECT timestamp_micros(x) AS t FROM VALUES (500000), (1500000), (1499999), (2500001) AS v(x)")
    got = [r[0] for r in df.select(F.unix_seconds(ex.round_to_second(F.col("t")))).collect()]
    assert got == [0, 2, 1, 3]


def test_keep_first_is_by_order(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, None), (2, 5, "x")], "k int, o int, v string")
    assert sorted((r["k"], r["o"], r["v"]) for r in cleaning.keep_first(df, ["k"], ["o"]).collect()) == [
        (1, 1, None), (2, 5, "x")]


def test_word_match(spark):
    keys = spark.createDataFrame([("T701",), ("t70",), ("P 3",), ("a.b",)], "key string")
    titles = spark.createDataFrame([(1, "Sensor xT701"), (2, "Sensor t701, top"), (3, "T701"), (4, "p 3 pump"), (5, "a-b"),
                                    (6, "has a.b inside")], "id int, title string")
    got = {r["key"]: r["id"] for r in joins.match_word(keys, titles, "key", "title", "id").collect()}
    assert got == {"T701": 2, "P 3": 4, "a.b": 6}


def test_checked_join_contracts(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    many = spark.createDataFrame([(1, "c"), (1, "d")], "k int, y string")
    assert joins.checked_join(many, one, ["k"], validate="many_to_one").count() == 2
    with pytest.raises(ValueError, match="duplicate keys"):
        joins.checked_join(one, many, ["k"], validate="one_to_one")


def test_split_lookup_overrides_the_default(spark):
    e = spark.createDataFrame([("a", "train_normal"), ("b", "train_normal"), ("c", "test_anormal")],
                              "identifier string, experiment_type string")
    t = spark.createDataFrame([("b", "excluded")], "identifier string, split string")
    got = {r["identifier"]: r["split"] for r in joins.assign_split(e, t).collect()}
    assert got == {"a": "train", "b": "excluded", "c": None}


def test_random_resample_against_numpy(spark):
    rng = np.random.default_rng(4)
    t = np.sort(rng.choice(300, 40, replace=False))
    x = rng.normal(size=40)
    df = spark.createDataFrame([("a", int(i), float(v)) for i, v in zip(t, x)], "e string, t long, x double")
    out = cleaning.resample_interpolate(df, ["e"], "t", ["x"], max_rows=9).orderBy("t").toPandas()
    np.testing.assert_allclose(out["x"], np.interp(np.arange(t[0], t[-1] + 1), t, x))
