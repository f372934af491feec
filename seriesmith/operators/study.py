"""Model study: feature preparation, default models, grid search, thresholds, frozen final evaluation.

Every stage returns tables. What a later stage reads more than once (scores, thresholds) is written down, so a lost
executor neither changes nor repeats it. Forests are not kept: their draws are md5, so the best ones grow again, the same,
for the final windows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmith.functions.expressions import ordered_select
from seriesmith.operators import forest as fo
from seriesmith.operators import metrics, profile
from seriesmith.operators.joins import model_datasets, union_all
from seriesmith.operators.model_grid import CONTAMINATION, DEFAULT_N_ESTIMATORS, PARAM_GRID, best_configurations
from seriesmith.session import pin, store
from seriesmith.sources.files import write_table

# The columns of the prediction table, in order.
PREDICTION_COLUMNS = ["identifier", "window", "window_start", "window_end", "batch", "operating_point", "experiment",
                      "experiment_type", "phase", "model", "anomaly_score", "prediction", "anomaly_label"]


@dataclass
class Dataset:
    """One feature representation: windows with key, split, target, metadata and feature columns.

    The table is read once for every use of its parts, so write it down when it is expensive.
    """

    table: DataFrame
    features: Sequence[str]


@dataclass
class Prepared:
    """Imputed vectors of the three subsets; medians and kept features come from the training rows only.

    There are medians of the features that are missing somewhere.
    """

    name: str
    original: list[str]
    kept: list[str]
    medians: DataFrame
    parts: dict[str, DataFrame]
    sizes: dict[str, int]


def prepare(name: str, data: Dataset, keys: Sequence[str], target: str, keep: Sequence[str] = ()) -> Prepared:
    """Check, drop features missing in more than 95 % of the training rows, impute, pack."""
    features = list(data.features)
    parts = model_datasets(data.table, target)
    train = parts["train"]
    found = {r["column"]: r for r in profile.missing_profile(train, features).collect()}
    infinite = [f for f in features if f in found and found[f]["n_infinite"]]
    if infinite:
        raise ValueError(f"{name}: infinite values in {infinite}")
    if not found:
        raise ValueError(f"{name}: no training rows")
    kept = [f for f in features if found[f]["missing_fraction"] <= profile.MAX_MISSING_FRACTION]
    others = profile.missing_profile(union_all([parts["validation"], parts["final_test"]]), kept).collect()
    infinite = [r["column"] for r in others if r["n_infinite"]]
    if infinite:
        raise ValueError(f"infinite values in {infinite}")
    lacking = {r["column"] for r in [*found.values(), *others] if r["n_missing"]}
    medians = pin(profile.medians(train, [f for f in kept if f in lacking])) if lacking.intersection(kept) else \
        data.table.sparkSession.createDataFrame([], "feature string, median double")
    meta = [c for c in (target, *keep) if c in data.table.columns]
    known = {r["feature"]: r["median"] for r in medians.collect()}
    packed, sizes = {}, {}
    for p, df in parts.items():
        vectors = fo.pack(df, keys, kept, meta)
        packed[p] = vectors.withColumn("vec", profile.impute_vector("vec", [known.get(f) for f in kept]))
        sizes[p] = df.count()
    return Prepared(name, features, kept, medians, packed, sizes)


def prepare_all(datasets: Mapping[str, Dataset], keys: Sequence[str], target: str,
                keep: Sequence[str] = ()) -> dict[str, Prepared]:
    return {n: prepare(n, d, keys, target, keep) for n, d in datasets.items()}


def default_results(prepared: Mapping[str, Prepared], keys: Sequence[str], target: str, seed: int = 42,
                    search: Search | None = None) -> DataFrame:
    """Default forest per representation, evaluated on the validation windows at the default cut.

    The default setting is a prefix of a searched one; with a ``search`` of the same seed its scores are reused.
    """
    setting = (DEFAULT_N_ESTIMATORS, "auto", "1.0")
    if search is not None:
        runs = search.results.filter((F.col("n_estimators") == setting[0]) & (F.col("max_samples") == setting[1])
                                     & (F.col("max_features") == setting[2])).select("model", "run")
        scored = search.scores.join(runs, ["model", "run"], "left_semi").select("model", target, "score")
    else:
        parts = []
        for p in prepared.values():
            out = fo.fit_and_score(p.parts["train"], keys, [fo.ForestSpec(*setting, seed)], p.parts["validation"])
            parts.append(out.select(F.lit(p.name).alias("model"), target, "score"))
        scored = pin(union_all(parts))
    table = scored.sparkSession.createDataFrame(
        [(p.name, p.sizes["train"], p.sizes["validation"], len(p.original), len(p.kept)) for p in prepared.values()],
        "model string, n_train long, n_validation long, n_features_original int, n_features_used int")
    result = metrics.evaluate(fo.default_prediction(scored), ["model"], "score", target)
    return table.join(result, "model", "left")


@dataclass
class Search:
    """Grid-search outcome: result table, best rows and validation scores per model and run."""

    results: DataFrame
    best: DataFrame
    scores: DataFrame
    seed: int


def grid_search(prepared: Mapping[str, Prepared], keys: Sequence[str], target: str,
                grid: Mapping[str, Sequence] = PARAM_GRID, seed: int = 42) -> Search:
    """Average precision of every parameter combination on the validation windows.

    Trees are independent draws, so the forests of fewer trees are prefixes of the largest one: one fit per
    (max_samples, max_features) serves every ``n_estimators``, and all settings of a model are fitted and scored in
    one job.
    """
    counts = list(grid["n_estimators"])
    pairs = list(product(grid["max_samples"], grid["max_features"]))
    specs = [fo.ForestSpec(max(counts), str(s), str(f), seed) for s, f in pairs]
    scored, rows = [], []
    for p in prepared.values():
        out = fo.fit_and_score(p.parts["train"], keys, specs, p.parts["validation"], counts)
        rank = reduce(lambda acc, ic: F.when(F.col("n_trees") == ic[1], ic[0]).otherwise(acc), enumerate(counts), F.lit(0))
        run = (rank * len(pairs) + F.col("spec") + 1).cast("int")
        scored.append(store(out.select(F.lit(p.name).alias("model"), run.alias("run"), *keys, target, "score"), "scores"))
        rows += [
            (p.name, i * len(pairs) + j + 1, n, str(s), str(f), CONTAMINATION, p.sizes["train"], p.sizes["validation"],
             len(p.kept))
            for i, n in enumerate(counts) for j, (s, f) in enumerate(pairs)
        ]
    scores = union_all(scored)
    spark = scores.sparkSession
    table = spark.createDataFrame(
        rows, "model string, run int, n_estimators int, max_samples string, max_features string, contamination string, "
              "n_train long, n_validation long, n_features int")
    ap = metrics.average_precision(scores, ["model", "run"], "score", target)
    results = pin(table.join(ap.withColumnRenamed("average_precision", "AUPRC"), ["model", "run"], "left"))
    return Search(results, pin(best_configurations(results)), scores, seed)


def best_specs(search: Search) -> dict[str, fo.ForestSpec]:
    """The best setting of each model; its forest is a prefix of the searched one."""
    return {r["model"]: fo.ForestSpec(r["n_estimators"], r["max_samples"], r["max_features"], search.seed)
            for r in search.best.collect()}


def validation_thresholds(search: Search, target: str, n_thresholds: int = metrics.N_THRESHOLDS) -> DataFrame:
    """Best threshold per model on the validation scores of its best run."""
    best = search.scores.join(search.best.select("model", "run"), ["model", "run"], "left_semi")
    return metrics.best_thresholds(metrics.threshold_sweep(best, ["model"], "score", target, n_thresholds), ["model"])


def final_predictions(prepared: Mapping[str, Prepared], search: Search, thresholds: DataFrame, keys: Sequence[str],
                      target: str) -> DataFrame:
    """Score and prediction per final-test window and model, with everything frozen beforehand."""
    scored = []
    for name, spec in best_specs(search).items():
        out = fo.fit_and_score(prepared[name].parts["train"], keys, [spec], prepared[name].parts["final_test"])
        scored.append(out.drop("spec", "n_trees").withColumn("model", F.lit(name)))
    predicted = metrics.apply_thresholds(union_all(scored), thresholds, ["model"], "score")
    shown = predicted.withColumnRenamed("score", "anomaly_score")
    return ordered_select(shown, [*PREDICTION_COLUMNS, target])


def final_results(predictions: DataFrame, target: str) -> DataFrame:
    """Final-test metrics per model."""
    cuts = predictions.groupBy("model").agg(F.max("threshold").alias("threshold"))
    return metrics.evaluate(predictions, ["model"], "anomaly_score", target).join(cuts, "model")


def run_study(datasets: Mapping[str, Dataset], keys: Sequence[str], target: str, keep: Sequence[str] = (),
              grid: Mapping[str, Sequence] = PARAM_GRID, seed: int = 42) -> dict[str, DataFrame]:
    """All result tables of the study."""
    prepared = prepare_all(datasets, keys, target, keep)
    search = grid_search(prepared, keys, target, grid, seed)
    thresholds = pin(validation_thresholds(search, target))
    predictions = store(final_predictions(prepared, search, thresholds, keys, target), "predictions")
    return {
        "default_results": default_results(prepared, keys, target, seed, search),
        "hyperparameter_results": search.results,
        "best_configurations": search.best,
        "threshold_results": thresholds,
        "final_test_results": final_results(predictions, target),
        "window_predictions": predictions,
    }


def write_results(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Result sink: one Parquet table per result."""
    for name, table in tables.items():
        write_table(table, f"{folder.rstrip('/')}/{name}")


def prediction_timeline(predictions: DataFrame, model: str, entity: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Score and prediction of one entity's windows under one model, in window order."""
    cond = reduce(lambda a, b: a & b, [F.col(k) == v for k, v in zip(keys, entity)])
    return predictions.filter((F.col("model") == model) & cond).orderBy("window")


def error_types(predictions: DataFrame, target: str) -> DataFrame:
    """Windows per model and outcome (TP, FP, FN, TN), windows without a truth value left out."""
    p, t = F.col("prediction") == 1, F.col(target) == 1
    kind = F.when(p & t, "TP").when(p, "FP").when(t, "FN").otherwise("TN")
    return predictions.filter(F.col(target).isNotNull()).groupBy("model", kind.alias("outcome")).agg(
        F.count("*").alias("n_windows"))
