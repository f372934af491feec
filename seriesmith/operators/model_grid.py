"""Parameter grids and their result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The searched parameters and their candidates.
PARAM_GRID = {
    "n_estimators": [200, 300, 500],
    "max_samples": ["auto", "0.5", "0.75", "1.0"],
    "max_features": ["0.5", "0.75", "1.0"],
}
DEFAULT_N_ESTIMATORS = 300
CONTAMINATION = "auto"


def param_grid(models: DataFrame, grid: Mapping[str, Sequence] = PARAM_GRID) -> DataFrame:
    """Every model with every parameter combination, numbered from 1 in grid order (last parameter fastest).

    The combinations are exploded from literal arrays, so no join is involved; ``max_samples`` and
    ``max_features`` are text throughout because one candidate is a word.
    """
    out = models
    number = F.lit(0)
    for name, values in grid.items():
        out = out.select("*", F.posexplode(F.array(*[F.lit(v) for v in values])).alias(f"__p_{name}", name))
        number = number * len(values) + F.col(f"__p_{name}")
    return out.withColumn("run", (number + 1).cast("int")).drop(*[f"__p_{n}" for n in grid])


def number_results(results: DataFrame, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach the configuration number by the text form of the parameters."""
    text = {k: F.col(k).cast("string") for k in keys}
    numbers = grid.select(*[e.alias(k) for k, e in text.items()], "run").distinct()
    return results.withColumns(text).join(numbers, list(keys), "left")


def best_configurations(results: DataFrame, model: str = "model", metric: str = "AUPRC", run: str = "run") -> DataFrame:
    """Best run per model: highest metric, lowest run number on ties."""
    ranked = Window.partitionBy(model).orderBy(F.col(metric).desc(), F.col(run))
    return results.withColumn("__rank", F.row_number().over(ranked)).filter("__rank = 1").drop("__rank")


def presentation_order(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Sort a report by a fixed order of names; unknown names go last."""
    rank = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        rank = F.when(F.col(column) == name, i).otherwise(rank)
    return df.orderBy(rank, column)


def validation_against_final(validation: DataFrame, final: DataFrame, model: str = "model",
                             metrics: Sequence[str] = ("AUPRC", "precision", "recall", "f1")) -> DataFrame:
    """One row per model and metric: validation value, final value, difference."""
    tall = [
        df.unpivot([model], list(metrics), "metric", value)
        for df, value in ((validation, "validation"), (final, "final_test"))
    ]
    return tall[0].join(tall[1], [model, "metric"]).withColumn("change", F.col("final_test") - F.col("validation"))


def display_table(df: DataFrame, digits: Mapping[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), n) for c, n in digits.items()})
