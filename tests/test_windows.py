import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmith.functions.expressions import binary_target
from seriesmith.operators import features as ft
from seriesmith.operators import series


def make(spark, windows):
    """windows: {(entity, window): list of values}"""
    rows = [(e, w, i, float(i), None if v is None else float(v), 1.0) for (e, w), vals in windows.items() for i, v in enumerate(vals)]
    return spark.createDataFrame(rows, "entity string, window int, position long, t double, x double, c double")


def test_only_complete_windows_stay(spark):
    df = make(spark, {("a", 0): [1.0] * 59, ("a", 1): [1.0, 2.0] * 30, ("a", 2): [1.0] * 61})
    for max_rows in (None, 60):
        full = series.complete_windows(df, ["entity"], 60, max_rows=max_rows)
        assert {r["window"] for r in full.select("window").distinct().collect()} == {1} and full.count() == 60
    assert {r["window"] for r in ft.window_stats(df, ["entity"], ["x"], 60).collect()} == {1}


def test_constant_signal(spark):
    df = make(spark, {("a", 0): list(np.arange(60.0))})
    s = ft.window_stats(df, ["entity"], ["c"], 60, constants=True).first()
    assert (s["std"], s["slope"], s["constant"]) == (0.0, 0.0, 1)
    assert ft.window_correlations(df, ["entity"], ["x", "c"], 60).first()["corr"] is None
    f = ft.frequency_features(df, ["entity"], ["c"], 60).first()
    assert (f["total_power"], f["dominant_power_ratio"], f["spectral_entropy"]) == (0.0, None, 0.0)


def test_missing_value_in_window(spark):
    vals = [float(i) for i in range(60)]
    vals[10] = None
    df = make(spark, {("a", 0): vals})
    s = ft.window_stats(df, ["entity"], ["x"], 60).first()
    assert s["slope"] is None and s["mean"] == pytest.approx((sum(range(60)) - 10) / 59)
    f = ft.frequency_features(df, ["entity"], ["x"], 60).first()
    assert [f[c] for c in ft.SPECTRUM] == [None, None, None]


def test_slope_std_corr_match_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=60)
    df = make(spark, {("a", 0): [float(v) for v in x]}).withColumn("y", F.col("x") * 2 + F.col("t"))
    s = ft.window_stats(df, ["entity"], ["x"], 60).first()
    assert s["slope"] == pytest.approx(np.polyfit(np.arange(60), x, 1)[0])
    assert s["std"] == pytest.approx(np.std(x, ddof=1))
    c = ft.window_correlations(df, ["entity"], ["x", "y"], 60).first()
    assert c["corr"] == pytest.approx(np.corrcoef(x, 2 * x + np.arange(60))[0, 1])


def test_spectrum_of_sine_and_noise(spark):
    t = np.arange(60)
    sine, noise = np.sin(2 * math.pi * 7 * t / 60), np.random.default_rng(1).normal(size=60)
    df = make(spark, {("a", 0): [float(v) for v in sine], ("a", 1): [float(v) for v in noise]})
    got = {r["window"]: r for r in ft.frequency_features(df, ["entity"], ["x"], 60).collect()}
    assert got[0]["dominant_power_ratio"] == pytest.approx(1.0)
    assert got[0]["spectral_entropy"] == pytest.approx(0.0, abs=1e-6)
    power = np.array([abs(sum(v * np.exp(-2j * math.pi * k * i / 60) for i, v in enumerate(noise))) ** 2 / 60
                      for k in range(1, 31)])
    share = power / power.sum()
    assert got[1]["total_power"] == pytest.approx(power.sum())
    assert got[1]["dominant_power_ratio"] == pytest.approx(share.max())
    assert got[1]["spectral_entropy"] == pytest.approx(-(share * np.log2(share + 1e-12)).sum())


def test_previous_window_skips_a_gap(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 4.0), ("a", 3, 9.0), ("b", 2, 5.0)],
                               "entity string, window int, f double")
    for max_rows in (1, 100):
        rows = {(r["entity"], r["window"]): (r["f_prev"], r["f_delta"])
                for r in ft.temporal_features(df, ["entity"], ["f"], max_rows=max_rows).collect()}
        assert rows == {("a", 0): (None, None), ("a", 1): (1.0, 3.0), ("a", 3): (4.0, 5.0), ("b", 2): (None, None)}


def test_label_is_the_first_rows(spark):
    rows = [("a", 0, i, 0 if i < 30 else 2) for i in range(60)] + [("a", 1, i, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "entity string, window int, position long, label int")
    got = {r["window"]: r["target"] for r in ft.window_metadata(df, ["entity"], [], label="label").collect()}
    assert got == {0: 0, 1: 1}


def test_binary_target(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (3,), (None,)], "x int").select("x", binary_target(F.col("x")).alias("y"))
    assert {r["x"]: r["y"] for r in df.collect()} == {0: 0, 1: None, 2: 1, 3: 1, None: None}


def test_flatten_and_back(spark):
    rng = np.random.default_rng(2)
    df = make(spark, {("a", w): [float(v) for v in rng.normal(size=60)] for w in range(3)})
    wide = ft.raw_windows(df, ["entity"], ["x", "c"], 60)
    assert len(wide.columns) == 2 + 120 and "x_07" in wide.columns
    back = ft.unflatten_window(wide, ["entity"]).filter("signal = 'x'").select("entity", "window", "position", "value")
    assert back.exceptAll(df.selectExpr("entity", "window", "cast(position as int)", "x")).count() == 0
    assert back.count() == 180


def test_full_feature_counts():
    signals, actuators = [f"S{i}" for i in range(30)], [f"S{i}" for i in range(20, 30)]
    temps, pairs = signals[:10], [(signals[i], signals[i + 1]) for i in range(7)]
    assert len(ft.window_feature_names(signals, actuators, temps, pairs)) == 240


def test_wide_table_matches_blocks(spark):
    rng = np.random.default_rng(5)
    df = make(spark, {("a", w): [float(v) for v in rng.normal(size=60)] for w in range(2)}).withColumn(
        "y", F.col("x") + F.col("t"))
    wide = ft.window_features(df, ["entity"], ["x", "y", "c"], ["c"], ["x", "y"], [("y", "x")], 60)
    assert [c for c in wide.columns if c not in ("entity", "window")] == ft.window_feature_names(
        ["x", "y", "c"], ["c"], ["x", "y"], [("y", "x")])
    stats = ft.window_stats(df, ["entity"], ["x"], 60).orderBy("window").collect()
    for r, s in zip(wide.orderBy("window").collect(), stats):
        assert r["x_mean"] == s["mean"] and r["x_slope"] == s["slope"]
        assert r["c_constant"] == 1.0 and r["y_x_diff_slope"] == pytest.approx(1.0)


def test_modalities_fan_out_and_default_label(spark):
    act = spark.createDataFrame([("e", "1", 1.0), ("e", "2", 2.0), ("e", None, 3.0)], "identifier string, Time string, a double")
    lab = spark.createDataFrame([("e", "1", 2), ("e", "1", 3)], "identifier string, Time string, `Label (anomaly)` int")
    sen = spark.createDataFrame([("e", "2", 7.0)], "identifier string, Time string, s double")
    rows = sorted((r["Time"] or "", r["anomaly_label"], r["s"]) for r in series.join_modalities(act, lab, sen).collect())
    assert rows == [("", 0, None), ("1", 2, None), ("1", 3, None), ("2", 0, 7.0)]


def test_operation_data(spark):
    rows = [("Operation", 0.0, 800.0), ("operation", 61.0, 20.0), ("Shutdown", 5.0, 1.0)]
    df = spark.createDataFrame(rows, "phase string, elapsed_time double, T701 double").withColumns({
        c: F.lit("i") for c in ("Time", "anomaly_label", "identifier", "batch", "operating_point", "experiment_type", "experiment")})
    got = sorted((r["window"], r["window_start"], r["window_end"], r["T701"])
                 for r in series.operation_data(df, ["T701"], large=["T701"]).collect())
    assert got == [(0, 0, 60, 0.8), (1, 60, 120, 20.0)]
    with pytest.raises(ValueError, match="T999"):
        series.operation_data(df, ["T701", "T999"])


@pytest.mark.parametrize("max_rows", [2, 100])
def test_elapsed_since_first(spark, max_rows):
    df = spark.createDataFrame([("a", 5), ("a", 3), ("a", 9), ("b", 7), (None, 4), (None, 6)], "e string, t int")
    out = series.elapsed_since_first(df, ["e"], "t", max_rows=max_rows)
    got = sorted((r["e"] or "", r["t"], r["elapsed_time"]) for r in out.collect())
    assert got == [("", 4, 0), ("", 6, 2), ("a", 3, 0), ("a", 5, 2), ("a", 9, 6), ("b", 7, 0)]


def test_one_window_as_series(spark):
    df = make(spark, {("a", w): [w * 100 + i for i in range(60)] for w in range(3)})
    wide = ft.raw_windows(df, ["entity"], ["x", "c"], 60)
    out = ft.window_series(wide, ["entity"], ["a"], 2).filter("signal = 'x'").collect()
    assert [(r["position"], r["value"]) for r in out] == [(i, 200.0 + i) for i in range(60)]
    assert [r["window"] for r in ft.window_list(df, ["entity"]).collect()] == [0, 1, 2]


def test_kernel_equals_the_aggregates(spark):
    """Missing values, NaN, infinity, constant and empty signals, windows that are too short; no rows at all."""
    rng = np.random.default_rng(4)
    rows, size = [], 6
    for e in range(4):
        for w in range(8):
            for p in range(size - (w == 7)):
                x, y = float(rng.integers(0, 9)), float(rng.normal())
                if (e, w) == (0, 0):
                    x = None
                if (e, w) == (0, 1):
                    x = 2.0
                if e == 1 and (w + p) % 5 == 0:
                    y = None
                if (e, w, p) in ((2, 0, 1), (2, 1, 0), (2, 1, 3)):
                    y = float("nan")
                if (e, w) == (2, 2):
                    y = float("nan")
                if (e, w, p) == (3, 3, 2):
                    y = float("inf")
                if (e, w) == (3, 4) and p:
                    y = None
                rows.append((None if e == 3 else str(e), w, p, x, y, 1.5 if w % 2 else float(p)))
    df = spark.createDataFrame(rows, "entity string, window int, position long, x double, y double, c double")
    signals, keys, pairs = ["x", "y", "c"], ["entity"], [("y", "x")]
    for data in (df, df.filter("window = 7")):
        wide = ft.window_features(data, keys, signals, ["c", "x"], signals, pairs, size)
        spectrum = ft.pivot_frequency(ft.frequency_features(data, keys, signals, size), keys, signals)
        want = ft.ml_features(wide, spectrum, keys)
        got = ft.window_kernel(data, keys, signals, ["c", "x"], signals, pairs, size)
        assert got.columns == want.columns
        a, b = ({(r["entity"], r["window"]): r for r in d.collect()} for d in (want, got))
        assert set(a) == set(b) and len(a) == (28 if data is df else 0)
        for k, row in a.items():
            for c in want.columns[2:]:
                here, there = row[c], b[k][c]
                if here is None or there is None:
                    assert here is there, (k, c, here, there)
                else:
                    assert np.isclose(here, there, rtol=1e-9, atol=1e-9, equal_nan=True), (k, c, here, there)
