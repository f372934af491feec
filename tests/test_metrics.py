import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmith.operators import metrics, profile


def frame(spark, scores, truth, model="m"):
    return spark.createDataFrame([(model, float(s), None if t is None else int(t)) for s, t in zip(scores, truth)],
                                 "model string, s double, t int")


def brute_ap(s, t):
    out, seen = 0.0, 0.0
    for cut in sorted(set(s), reverse=True):
        hit = s >= cut
        recall = t[hit].sum() / t.sum()
        out, seen = out + (recall - seen) * t[hit].mean(), recall
    return out


def brute_auc(s, t):
    pairs = [(1.0 if a > b else 0.5 if a == b else 0.0) for a in s[t == 1] for b in s[t == 0]]
    return float(np.mean(pairs))


@pytest.mark.parametrize("max_rows", [5, 100_000])
def test_ranking_metrics_with_ties(spark, max_rows):
    rng = np.random.default_rng(0)
    s, t = rng.integers(0, 15, 200) / 10, rng.integers(0, 2, 200)
    df = frame(spark, s, t)
    assert metrics.average_precision(df, ["model"], "s", "t", max_rows).first()["average_precision"] == pytest.approx(brute_ap(s, t))
    assert metrics.roc_auc(df, ["model"], "s", "t", max_rows).first()["roc_auc"] == pytest.approx(brute_auc(s, t))


def test_unlabelled_rows_do_not_count(spark):
    df = frame(spark, [3, 2, 1, 0], [1, None, 0, 1])
    assert metrics.average_precision(df, ["model"], "s", "t").first()[1] == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert metrics.roc_auc(frame(spark, [1, 2], [1, 1]), ["model"], "s", "t").first()["roc_auc"] is None


def test_no_predicted_positive(spark):
    df = frame(spark, [1, 2], [1, 0]).withColumn("p", F.lit(0))
    r = metrics.confusion(df, ["model"], "t", "p").first()
    assert (r["precision"], r["recall"], r["f1"], r["accuracy"]) == (0, 0, 0, 0.5)
    assert (r["tn"], r["fp"], r["fn"], r["tp"]) == (1, 0, 1, 0)


def test_threshold_sweep_is_exact(spark):
    rng = np.random.default_rng(1)
    grid = np.linspace(0.1, 0.7, 1000)
    # Scores that sit exactly on thresholds as well as between them.
    s = np.concatenate([grid[rng.integers(0, 1000, 150)], rng.uniform(0.1, 0.7, 150), [0.1, 0.7]])
    t = rng.integers(0, 2, len(s))
    got = metrics.threshold_sweep(frame(spark, s, t), ["model"], "s", "t").toPandas().sort_values("threshold_index")
    assert len(got) == 1000
    for r in got.itertuples():
        hit = s >= r.threshold
        assert (r.tp, r.fp, r.fn, r.tn) == (t[hit].sum(), (1 - t[hit]).sum(), t[~hit].sum(), (1 - t[~hit]).sum())
    np.testing.assert_allclose(got["threshold"], np.linspace(s.min(), s.max(), 1000))


def test_lowest_threshold_wins_ties_and_equal_scores(spark):
    df = frame(spark, [0.0, 1.0], [0, 1])
    best = metrics.best_thresholds(metrics.threshold_sweep(df, ["model"], "s", "t"), ["model"]).first()
    assert best["f1"] == 1.0 and best["threshold_index"] == 1
    flat = metrics.threshold_sweep(frame(spark, [0.5, 0.5], [0, 1]), ["model"], "s", "t")
    assert flat.filter("tp = 1 and fp = 1").count() == 1000


def test_score_equal_to_threshold_is_positive(spark):
    cut = spark.createDataFrame([("m", 2.0)], "model string, threshold double")
    got = metrics.apply_thresholds(frame(spark, [1, 2, 3], [0, 0, 0]), cut, ["model"], "s").orderBy("s").collect()
    assert [r["prediction"] for r in got] == [0, 1, 1]


@pytest.mark.parametrize("max_rows", [10, 100_000])
def test_exact_quantiles(spark, max_rows):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=301), 1)
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 1.0), ("b", 4.0), ("b", None)], "k string, v double")
    got = {r["k"]: r for r in profile.exact_quantiles(df, ["k"], "v", [0.1, 0.5, 0.75], max_rows).collect()}
    for i, p in enumerate([0.1, 0.5, 0.75]):
        assert got["a"][f"q{i}"] == pytest.approx(np.quantile(x, p))
    assert got["b"]["q1"] == 2.5


def test_missing_features_and_infinities(spark):
    df = spark.createDataFrame([(1.0, None, None)] * 19 + [(2.0, 5.0, None)], "a double, b double, c double")
    assert profile.kept_features(df, ["a", "b", "c"]) == ["a", "b"]
    with pytest.raises(ValueError, match="infinite"):
        profile.check_infinite(spark.createDataFrame([(float("inf"),)], "a double"), ["a"])
    med = profile.medians(df, ["a", "b"])
    filled = profile.impute(df, med, ["a", "b"])
    assert filled.filter("b = 5.0").count() == 20


def test_counts_contract():
    profile.validate_count(["a"] * 240, 240)
    with pytest.raises(ValueError):
        profile.validate_count(["a"] * 239, 240)
