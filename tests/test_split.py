from itertools import product

import pytest

from seriesmith.operators import model_grid, split


def test_classes(spark):
    rows = [("a", 0, 0), ("a", 1, 2), ("b", 0, 0), ("b", 1, 1), ("c", 0, 0), ("d", 0, 1), ("d", 1, 3), ("e", 0, None)]
    df = spark.createDataFrame(rows, "id string, window int, label int")
    got = {r["id"]: r["experiment_class"] for r in split.entity_classes(df, "id", "label").collect()}
    assert got == {"a": "observable", "b": "unobservable", "c": "normal", "d": "observable", "e": "normal"}


def test_first_known_attribute(spark):
    df = spark.createDataFrame([("a", 0, 0, None), ("a", 1, 0, "x"), ("a", 2, 0, "y")], "id string, window int, label int, b string")
    assert split.entity_classes(df, "id", "label", ["b"]).first()["b"] == "x"


@pytest.fixture(scope="module")
def entities(spark):
    rows, i = [], 0
    for b, o in product(range(3), range(4)):
        for _ in range(1 + (b * 4 + o) % 5):
            rows.append((i, f"b{b}", f"o{o}", "observable"))
            i += 1
    rows += [(1000 + j, "b0", "o0", "normal" if j % 2 else "unobservable") for j in range(6)]
    return spark.createDataFrame(rows, "id int, batch string, op string, experiment_class string")


def test_balanced_split_is_sound_and_repeatable(spark, entities):
    observable = entities.filter("experiment_class = 'observable'")
    sides = split.balanced_group_split(observable, ["batch", "op"], 300)
    rows = sides.collect()
    assert len(rows) == 12 and sum(r["side"] == "validation" for r in rows) == 6
    gap = abs(sum(r["n_entities"] * (1 if r["side"] == "validation" else -1) for r in rows))
    assert gap == observable.count() % 2
    again = split.balanced_group_split(observable.repartition(7), ["batch", "op"], 300).collect()
    assert sorted(again) == sorted(rows)
    assigned = split.assign_by_group(entities, sides, ["batch", "op"])
    assert split.split_violations(assigned, entities, "id", ["batch", "op"]).isEmpty()
    split.require_sound(assigned, entities, "id", ["batch", "op"])


def test_group_in_both_sides_raises(spark):
    df = spark.createDataFrame([(1, "b", "observable", "validation"), (2, "b", "observable", "final_test")],
                               "id int, batch string, experiment_class string, split string")
    with pytest.raises(ValueError, match="group in both sides"):
        split.require_sound(df, df, "id", ["batch"])


def test_unassigned_and_unknown_entities_are_reported(spark):
    df = spark.createDataFrame([(1, "b", "observable", None), (1, "b", "normal", "train"), (3, "b", "normal", None)],
                               "id int, batch string, experiment_class string, split string")
    src = spark.createDataFrame([(1,), (2,)], "id int")
    rules = sorted(r["rule"] for r in split.split_violations(df, src, "id", ["batch"]).collect())
    assert rules == ["duplicate entity", "entity missing", "entity unknown", "normal not in train",
                     "observable outside evaluation"]


def test_grid_order_and_numbers(spark):
    grid = model_grid.param_grid(spark.createDataFrame([("a",), ("b",)], "model string"))
    assert grid.count() == 72
    rows = {r["run"]: r for r in grid.filter("model = 'a'").collect()}
    want = list(product([200, 300, 500], ["auto", "0.5", "0.75", "1.0"], ["0.5", "0.75", "1.0"]))
    assert [(rows[i + 1]["n_estimators"], rows[i + 1]["max_samples"], rows[i + 1]["max_features"]) for i in range(36)] == want


def test_best_run_tie_and_report_order(spark):
    df = spark.createDataFrame([("x", 2, 0.5), ("x", 1, 0.5), ("y", 1, 0.9), ("z", 1, 0.1)], "model string, run int, AUPRC double")
    best = model_grid.presentation_order(model_grid.best_configurations(df), "model", ["y", "x"])
    assert [(r["model"], r["run"]) for r in best.collect()] == [("y", 1), ("x", 1), ("z", 1)]
