"""Evaluation of anomaly scores: confusion counts, average precision, ROC AUC, threshold sweep.

Scores are first reduced to one row per distinct score, and everything cumulative runs through
``ordered_columns``, so a model with very many windows is not ranked in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmith.functions.statistics import ratio_or_zero
from seriesmith.operators.joins import best_row
from seriesmith.operators.ordered import find_large_keys, join_null_safe, join_one_per_key, ordered_columns
from seriesmith.session import pin

N_THRESHOLDS = 1000


def _hits(truth: Column) -> tuple[Column, Column]:
    return F.count_if(truth == 1), F.count_if(truth == 0)


def rates(df: DataFrame) -> DataFrame:
    """precision, recall, f1 and accuracy from tp, fp, fn, tn; 0 where a denominator is 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return df.withColumns({
        "precision": ratio_or_zero(tp, tp + fp),
        "recall": ratio_or_zero(tp, tp + fn),
        "f1": ratio_or_zero(2 * tp, 2 * tp + fp + fn),
        "accuracy": ratio_or_zero(tp + tn, tp + fp + fn + tn),
    })


def confusion(df: DataFrame, keys: Sequence[str], truth: str, prediction: str) -> DataFrame:
    """Confusion counts and rates per key; rows without a truth value are left out."""
    t, p = F.col(truth), F.col(prediction)
    counts = df.filter(t.isNotNull()).groupBy(*keys).agg(
        F.count_if((t == 0) & (p == 0)).alias("tn"), F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 1) & (p == 0)).alias("fn"), F.count_if((t == 1) & (p == 1)).alias("tp"),
        F.count("*").alias("n_test"), F.count_if(t == 1).alias("n_anomalies"), F.count_if(t == 0).alias("n_normal"),
    )
    return rates(counts)


def score_steps(df: DataFrame, keys: Sequence[str], score: str, truth: str) -> DataFrame:
    """One row per key and distinct score with its positives and negatives: ties become a single step."""
    pos, neg = _hits(F.col(truth))
    return df.filter(F.col(truth).isNotNull()).groupBy(*keys, score).agg(pos.alias("pos"), neg.alias("neg"))


def _totals(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    return steps.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def precision_recall_steps(df: DataFrame, keys: Sequence[str], score: str, truth: str,
                           max_rows: int | None = None) -> DataFrame:
    """Precision and recall after each distinct score, from the highest score down."""
    steps = pin(score_steps(df, keys, score, truth))  # read for sizes, sums and totals
    large = find_large_keys(steps, keys, max_rows)
    cum = ordered_columns(steps, keys, [F.col(score).desc()], sums={"tp": F.col("pos"), "fp": F.col("neg")},
                          large=large)
    joined = join_one_per_key(cum, _totals(steps, keys), keys, "inner")
    return joined.withColumns({
        "precision": ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fp")),
        "recall": ratio_or_zero(F.col("tp"), F.col("n_pos")),
    })


def average_precision(df: DataFrame, keys: Sequence[str], score: str, truth: str,
                      max_rows: int | None = None) -> DataFrame:
    """Sum over the distinct scores of recall gain times precision."""
    steps = precision_recall_steps(df, keys, score, truth, max_rows)
    gain = ratio_or_zero(F.col("pos"), F.col("n_pos"))
    return steps.groupBy(*keys).agg(F.sum(gain * F.col("precision")).alias("average_precision"))


def roc_auc(df: DataFrame, keys: Sequence[str], score: str, truth: str, max_rows: int | None = None) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties counted half; NULL with one class only."""
    steps = score_steps(df, keys, score, truth)
    large = find_large_keys(df, keys, max_rows)
    cum = ordered_columns(steps, keys, [score], sums={"__below": F.col("neg")}, large=large)
    pairs = F.sum(F.col("pos").cast("double") * (F.col("__below") - F.col("neg") / 2))
    n_pos, n_neg = F.sum("pos"), F.sum("neg")
    return cum.groupBy(*keys).agg(F.try_divide(pairs, n_pos.cast("double") * n_neg).alias("roc_auc"))


def threshold_sweep(df: DataFrame, keys: Sequence[str], score: str, truth: str,
                    n_thresholds: int = N_THRESHOLDS) -> DataFrame:
    """Confusion counts and rates at evenly spaced thresholds between the lowest and highest score.

    A row is predicted positive when its score is at or above the threshold. Each score is put into the bucket of
    the highest threshold it reaches (the computed bucket is corrected against the actual threshold values), the
    buckets are counted, and the counts are accumulated from the top: one pass over the scores whatever the number
    of thresholds, and at most ``n_thresholds`` rows per key afterwards.
    """
    known = df.filter(F.col(truth).isNotNull() & F.col(score).isNotNull()).select(
        *keys, F.col(score).cast("double").alias("__s"), F.col(truth).alias("__t"))
    last = n_thresholds - 1
    span = pin(known.groupBy(*keys).agg(F.min("__s").alias("__lo"), F.max("__s").alias("__hi")).withColumn(
        "__step", (F.col("__hi") - F.col("__lo")) / last))

    def at(i: Column) -> Column:
        return F.when(i == last, F.col("__hi")).otherwise(F.col("__lo") + i * F.col("__step"))

    guess = F.coalesce(F.floor(F.try_divide(F.col("__s") - F.col("__lo"), F.col("__step"))), F.lit(last))
    i = F.least(F.greatest(guess, F.lit(0)), F.lit(last)).cast("long")
    placed = join_one_per_key(known, span, keys, "inner").withColumn("__i", i)
    reached = F.col("__s") >= at(F.col("__i") + 1)
    missed = F.col("__s") < at(F.col("__i"))
    fixed = F.when((F.col("__i") < last) & reached, F.col("__i") + 1).when(missed, F.col("__i") - 1)
    pos, neg = _hits(F.col("__t"))
    counts = (
        placed.withColumn("__i", F.coalesce(fixed, F.col("__i")))
        .groupBy(*keys, "__i").agg(pos.alias("__pos"), neg.alias("__neg"))
    )
    grid = span.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))))
    full = join_null_safe(grid, counts, [*keys, "__i"]).withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in ("__pos", "__neg")})
    # At most n_thresholds rows per key from here on.
    whole = Window.partitionBy(*keys)
    down = whole.orderBy(F.col("__i").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = full.select(
        *keys, F.col("__i").alias("threshold_index"), at(F.col("__i")).alias("threshold"),
        F.sum("__pos").over(down).alias("tp"), F.sum("__neg").over(down).alias("fp"),
        F.sum("__pos").over(whole).alias("__p"), F.sum("__neg").over(whole).alias("__n"),
    )
    return rates(cum.withColumns({"fn": F.col("__p") - F.col("tp"), "tn": F.col("__n") - F.col("fp")})).drop(
        "__p", "__n", "accuracy")


def best_thresholds(sweep: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Threshold with the highest F1 per key, the lowest one on ties."""
    return best_row(sweep, keys, [F.col("f1").desc(), F.col("threshold_index").asc()])


def apply_thresholds(scored: DataFrame, thresholds: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Prediction per row from the frozen threshold of its model (one threshold row per model)."""
    cut = thresholds.select(*keys, F.col("threshold").alias("__cut"))
    return join_one_per_key(scored, cut, keys, "inner").withColumn(
        "prediction", (F.col(score) >= F.col("__cut")).cast("int")).withColumnRenamed("__cut", "threshold")


def evaluate(predicted: DataFrame, keys: Sequence[str], score: str, truth: str,
             prediction: str = "prediction") -> DataFrame:
    """Average precision and confusion metrics per key in one table."""
    ap = average_precision(predicted, keys, score, truth).withColumnRenamed("average_precision", "AUPRC")
    return join_null_safe(confusion(predicted, keys, truth, prediction), ap, keys, "left")
