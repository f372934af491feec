import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmith.operators import forest as fo
from seriesmith.operators import study


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 6))
    x[:, 5] = 1.0
    x[17] = 9.0
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vec array<double>").persist()


def scores(df, forests, **kw):
    return fo.score_forests(df, forests, **kw).toPandas().sort_values(["spec", "n_trees", "id"])["score"].to_numpy()


def test_average_path():
    got = fo.average_path([0, 1, 2, 3, 256])
    assert list(got[:3]) == [0, 0, 1]
    assert got[3] == pytest.approx(2 * (np.log(2) + np.euler_gamma) - 4 / 3)
    assert got[4] == pytest.approx(10.244770920116851)


def test_planted_outlier_ranks_first(spark, cloud):
    fitted = fo.fit_forests(cloud, ["id"], [fo.ForestSpec(100)])
    out = fo.default_prediction(fo.score_forests(cloud, fitted)).orderBy(F.col("score").desc()).collect()
    assert out[0]["id"] == 17 and out[0]["prediction"] == 1
    assert all(0 < r["score"] <= 1 for r in out)


def test_same_forest_under_any_partitioning(spark, cloud):
    spec = [fo.ForestSpec(10, "0.5", "0.5")]
    a = fo.fit_forests(cloud, ["id"], spec).nodes.toPandas().sort_values(["tree", "node"]).reset_index(drop=True)
    b = fo.fit_forests(cloud.repartition(11), ["id"], spec).nodes.toPandas().sort_values(["tree", "node"]).reset_index(drop=True)
    assert a.equals(b)


def test_tree_structure(spark, cloud):
    spec = fo.ForestSpec(8, "0.5", "0.5")
    nodes = fo.fit_forests(cloud, ["id"], [spec]).nodes.toPandas()
    roots = nodes[nodes["node"] == 1]
    assert (roots["size"] == 200).all() and len(roots) == 8
    assert nodes["depth"].max() <= fo.depth_limit(200)
    size = {(r.tree, r.node): r.size for r in nodes.itertuples(index=False)}
    for r in nodes[nodes["feature"] >= 0].itertuples(index=False):
        assert size[(r.tree, 2 * r.node)] + size[(r.tree, 2 * r.node + 1)] == r.size
        assert r.feature in fo.tree_features(spec, r.tree, 6)
        assert r.feature != 5 or size[(r.tree, 2 * r.node + 1)] == 1  # one row differs in it
    leaves = nodes[nodes["feature"] < 0]
    assert np.allclose(leaves["path"], leaves["depth"] + fo.average_path(leaves["size"]))


@pytest.mark.parametrize("share,rows", [("0.5", 200), ("0.75", 300), ("1.0", 400)])
def test_levels_give_the_same_trees(spark, cloud, share, rows):
    spec = [fo.ForestSpec(6, share, "0.5")]
    plain = fo.fit_forests(cloud, ["id"], spec).nodes.toPandas().sort_values(["tree", "node"]).reset_index(drop=True)
    split = fo.fit_forests(cloud, ["id"], spec, max_group_cells=6 * 60).nodes.toPandas().sort_values(["tree", "node"]).reset_index(drop=True)
    assert (split.loc[split["node"] == 1, "size"] == rows).all()
    assert (plain[["tree", "node", "feature", "size"]].to_numpy() == split[["tree", "node", "feature", "size"]].to_numpy()).all()
    np.testing.assert_allclose(plain["threshold"], split["threshold"], equal_nan=True)


def test_blocks_and_joins_give_the_same_scores(spark, cloud):
    forests = fo.fit_forests(cloud, ["id"], [fo.ForestSpec(6, "auto", "1.0"), fo.ForestSpec(4, "0.75", "0.5")])
    whole = scores(cloud, forests, prefixes=[3, 6])
    np.testing.assert_allclose(whole, scores(cloud, forests, prefixes=[3, 6], max_shared_nodes=500))
    np.testing.assert_allclose(whole, scores(cloud, forests, prefixes=[3, 6], max_shared_nodes=150))


def test_levels_with_one_tree_at_a_time(spark, cloud, monkeypatch):
    spec = [fo.ForestSpec(3, "0.75", "1.0")]
    plain = fo.fit_forests(cloud, ["id"], spec, max_group_cells=6 * 40).nodes
    monkeypatch.setattr(fo, "MAX_TOP_NODES", 1)
    joined = fo.fit_forests(cloud, ["id"], spec, max_group_cells=6 * 40).nodes
    assert sorted(map(str, plain.collect())) == sorted(map(str, joined.collect()))


def test_cuts_leave_exactly_the_wanted_rows(spark, cloud):
    for size in (1, 37, 399):
        cuts = fo.sample_cuts(cloud, ["id"], 5, 4, size, 400)
        rows = cloud.select(F.explode(fo._sampled_trees(5, 4, ["id"], cuts)).alias("p")).groupBy("p.tree").count()
        assert {r["tree"]: r["count"] for r in rows.collect()} == dict.fromkeys(range(4), size)


def test_prefix_is_the_smaller_forest(spark, cloud):
    big = fo.fit_forests(cloud, ["id"], [fo.ForestSpec(20)])
    small = fo.fit_forests(cloud, ["id"], [fo.ForestSpec(8)])
    np.testing.assert_allclose(scores(cloud, big, prefixes=[8]), scores(cloud, small))


def test_sample_sizes():
    assert fo.ForestSpec().sample_size(10_000) == 256 and fo.ForestSpec().sample_size(100) == 100
    assert fo.ForestSpec(max_samples="0.75").sample_size(101) == 75
    assert fo.ForestSpec(max_features="0.5").n_features(5) == 2 and fo.ForestSpec(max_features="0.5").n_features(1) == 1


def test_study_end_to_end(spark):
    rng = np.random.default_rng(7)
    rows = []
    for e in range(30):
        part = ["train", "validation", "final_test"][e % 3]
        for w in range(8):
            bad = part != "train" and (e + w) % 4 == 0
            x = rng.normal(size=3) + (6 if bad else 0)
            rows.append((f"e{e}", w, part, 1 if bad else 0, None if w == 0 else float(x[0]), float(x[1]), float(x[2]), None))
    table = spark.createDataFrame(rows, "identifier string, window int, split string, observable_anomaly int, "
                                        "a double, b double, c double, gone double")
    grid = {"n_estimators": [5, 20], "max_samples": ["auto", "0.5"], "max_features": ["1.0"]}
    data = {"one": study.Dataset(table, ["a", "b", "c", "gone"]),
            "two": study.Dataset(table.withColumn("window_start", F.col("window") * 60), ["b"])}
    out = study.run_study(data, ["identifier", "window"], "observable_anomaly", ["window_start"], grid)
    assert out["hyperparameter_results"].count() == 8
    default = study.default_results(study.prepare_all(data, ["identifier", "window"], "observable_anomaly"),
                                    ["identifier", "window"], "observable_anomaly")
    one = default.filter("model = 'one'").first()
    assert (one["n_features_original"], one["n_features_used"], one["n_train"], one["n_validation"]) == (4, 3, 80, 80)
    final = {r["model"]: r for r in out["final_test_results"].collect()}
    assert final["one"]["AUPRC"] > 0.95 and final["one"]["tp"] + final["one"]["fn"] == 20
    predictions = out["window_predictions"]
    assert predictions.count() == 160
    assert predictions.filter("model = 'one' and window_start is not null").count() == 0
    assert predictions.filter("model = 'two' and window_start is null").count() == 0
    line = study.prediction_timeline(predictions, "two", ["e2"], ["identifier"]).collect()
    assert [r["window"] for r in line] == list(range(8))
    assert study.error_types(predictions, "observable_anomaly").agg(F.sum("n_windows")).first()[0] == 160


def test_equal_rows_end_in_the_same_leaves():
    rng = np.random.default_rng(3)
    x = np.repeat(rng.integers(0, 3, size=(40, 5)).astype(float), 6, axis=0)
    classes = np.unique(x, axis=0, return_inverse=True)[1].reshape(-1)
    args = np.arange(240), np.arange(5), fo.NodeDraws(1, 0), 1, 0, 8
    for a, b in zip(fo._grow(x, *args), fo._grow(np.asfortranarray(x), *args, classes)):
        np.testing.assert_array_equal(a, b)


@pytest.mark.parametrize("limits", [{}, {"max_held_cells": 6, "max_held_nodes": 50}])
def test_fit_and_score_equals_fitting_and_scoring(spark, cloud, limits):
    specs = [fo.ForestSpec(6, "auto", "1.0"), fo.ForestSpec(4, "0.75", "0.5"), fo.ForestSpec(6, "1.0", "0.5", seed=7)]
    train, rest = cloud.filter("id % 2 = 0"), cloud.filter("id % 3 <> 0").withColumn("name", F.concat(F.lit("n"), "id"))
    want = fo.score_forests(rest, fo.fit_forests(train, ["id"], specs), [3, 6])
    got = fo.fit_and_score(train, ["id"], specs, rest, [3, 6], **limits)
    assert got.columns == want.columns
    a, b = ([tuple(r) for r in df.select("id", "name", "spec", "n_trees", "score").orderBy("id", "spec", "n_trees").collect()]
            for df in (want, got))
    assert [r[:4] for r in a] == [r[:4] for r in b]
    np.testing.assert_allclose([r[4] for r in a], [r[4] for r in b], rtol=1e-12)


def test_study_keeps_no_node_tables(spark, monkeypatch):
    def never(*a, **kw):
        raise AssertionError("a node table of the searched forests")
    monkeypatch.setattr(fo, "fit_forests", never)
    test_study_end_to_end(spark)
