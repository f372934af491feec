"""Table profiles and validation: counts, missing values, infinities, exact quantiles, checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmith.operators.features import to_long
from seriesmith.operators.ordered import find_large_keys, join_null_safe, join_one_per_key, ordered_columns
from seriesmith.session import pin

MAX_MISSING_FRACTION = 0.95


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Rows per value, NULL included."""
    return df.groupBy(*columns).agg(F.count("*").alias("n_rows"))


def distinct_counts(df: DataFrame, **keys: Sequence[str]) -> DataFrame:
    """Distinct combinations per named key, as one row.

    Each key is counted from its own pre-aggregated groups, so no row is multiplied by the number of keys.
    """
    rows = [df.groupBy(*cols).agg(F.lit(1).alias("x")).agg(F.count("*").alias("n")).withColumn("name", F.lit(name))
            for name, cols in keys.items()]
    tall = reduce(DataFrame.unionByName, rows)
    return tall.agg(*[F.max(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in keys])


def missing_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: rows, missing values, missing fraction and infinite values.

    One (column number, missing, infinite) row per cell, reduced on the map side to one row per column and task.
    """
    types = dict(df.dtypes)

    def cell(c: str) -> str:
        infinite = f"coalesce(abs(`{c}`) = double('inf'), false)" if types[c] in ("double", "float") else "false"
        return f"struct(`{c}` IS NULL AS m, {infinite} AS i)"

    cells = df.select(F.expr(f"posexplode(array({', '.join(cell(c) for c in columns)}))").alias("i", "c"))
    names = F.array(*[F.lit(c) for c in columns])
    return (
        cells.groupBy("i")
        .agg(F.count("*").alias("n_rows"), F.count_if("c.m").alias("n_missing"), F.count_if("c.i").alias("n_infinite"))
        .select(F.get(names, F.col("i")).alias("column"), "n_rows", "n_missing", "n_infinite",
                F.try_divide(F.col("n_missing").cast("double"), F.col("n_rows")).alias("missing_fraction"))
    )


def kept_features(train: DataFrame, features: Sequence[str], limit: float = MAX_MISSING_FRACTION) -> list[str]:
    """Features whose missing fraction on the training rows is at most ``limit`` (one row per feature collected)."""
    high = {r["column"] for r in missing_profile(train, features).filter(F.col("missing_fraction") > limit).collect()}
    return [f for f in features if f not in high]


def check_infinite(df: DataFrame, features: Sequence[str]) -> DataFrame:
    bad = [r["column"] for r in missing_profile(df, features).filter("n_infinite > 0").collect()]
    if bad:
        raise ValueError(f"infinite values in {bad}")
    return df


def exact_quantiles(long: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float],
                    max_rows: int | None = None, at_most: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, NULLs skipped: columns ``q0``, ``q1`` ... per probability.

    Values are counted first and ranked by a running sum, so no task ever holds all values of a key. The counts are
    pinned: sizes, ranks and totals come from them, and the input is read once. ``at_most`` is an upper bound of the rows
    per key, if the caller knows one.
    """
    counts = pin(long.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c")))
    ranked = ordered_columns(counts, keys, [value], sums={"__upto": F.col("__c")},
                             large=find_large_keys(counts, keys, max_rows, at_most=at_most))
    totals = counts.groupBy(*keys).agg(F.sum("__c").alias("__n"))
    joined = join_one_per_key(ranked, totals, keys, "inner")
    cells, out = [], []
    for i, p in enumerate(probabilities):
        at = (F.col("__n") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            cells.append(F.min(F.when(F.col("__upto") > rank, F.col(value))).alias(f"__{side}{i}"))
        part = at - F.floor(at)
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        out.append((lo + (hi - lo) * part).alias(f"q{i}"))
    return joined.groupBy(*keys, "__n").agg(*cells).select(*keys, *out)


def medians(df: DataFrame, features: Sequence[str], max_rows: int | None = None,
            at_most: int | None = None) -> DataFrame:
    """Exact median per feature: (feature, median). ``at_most`` bounds the rows of ``df`` if known."""
    long = to_long(df, [], features, "feature", "value")
    return exact_quantiles(long, ["feature"], "value", [0.5], max_rows, at_most).withColumnRenamed("q0", "median")


def impute(df: DataFrame, medians_table: DataFrame, features: Sequence[str]) -> DataFrame:
    """Fill missing features with the training medians (one value per feature, held as literals in the plan)."""
    table = {r["feature"]: r["median"] for r in medians_table.collect()}
    return df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(table.get(f))) for f in features})


def impute_vector(vector: str, table: Sequence[float]) -> Column:
    """The same on a feature vector, given the medians in feature order."""
    medians_array = F.array(*[F.lit(m) for m in table])
    return F.transform(F.col(vector), lambda x, i: F.coalesce(x, F.get(medians_array, i)))


def column_summary(df: DataFrame, columns: Sequence[str], max_rows: int | None = None,
                   at_most: int | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max per column, all exact."""
    long = to_long(df, [], columns, "column", "value")
    v = F.col("value")
    base = long.groupBy("column").agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"))
    quarts = exact_quantiles(long, ["column"], "value", [0.25, 0.5, 0.75], max_rows, at_most)
    return join_null_safe(base, quarts, ["column"]).withColumnsRenamed({"q0": "q25", "q1": "q50", "q2": "q75"})


def dataset_summary(tables: dict[str, DataFrame], features: dict[str, Sequence[str]], split: str,
                    splits: Sequence[str], limit: float = MAX_MISSING_FRACTION) -> DataFrame:
    """One row per table: rows, features, rows per split, features with too many missing values."""
    def one(name: str) -> DataFrame:
        df, cols = tables[name], features[name]
        high = [F.when(F.avg(F.col(c).isNull().cast("double")) > limit, 1).otherwise(0) for c in cols]
        return df.agg(
            F.lit(name).alias("model"), F.count("*").alias("n_rows"), F.lit(len(cols)).alias("n_features"),
            *[F.count_if(F.col(split) == s).alias(f"n_{s}") for s in splits],
            reduce(lambda a, b: a + b, high).alias("n_high_missing"),
        )

    return reduce(DataFrame.unionByName, [one(n) for n in tables])


def validate_count(columns: Sequence[str], expected: int, name: str = "table") -> None:
    if len(columns) != expected:
        raise ValueError(f"{name}: expected {expected} feature columns, found {len(columns)}")


def temporal_violations(df: DataFrame, keys: Sequence[str], features: Sequence[str],
                        window: str = "window") -> DataFrame:
    """Entities that do not have exactly one window without any previous value, or whose first window has one."""
    empty = reduce(lambda a, b: a & b, [F.col(f"{f}_{s}").isNull() for f in features for s in ("prev", "delta")])
    return (
        df.withColumn("__empty", empty)
        .groupBy(*keys)
        .agg(F.count_if("__empty").alias("n_first"), F.min_by("__empty", window).alias("first_empty"))
        .filter((F.col("n_first") != 1) | ~F.col("first_empty"))
    )


def window_report(df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str,
                  window: str = "window") -> DataFrame:
    """Windows, entities, duplicate windows, missing targets, positives and missing feature cells, as one row."""
    cells = reduce(lambda a, b: a + b, [F.col(f).isNull().cast("long") for f in features])
    per_window = df.groupBy(*keys, window).agg(
        F.count("*").alias("__n"), F.count_if(F.col(target).isNull()).alias("__missing"),
        F.count_if(F.col(target) == 1).alias("__positive"), F.sum(cells).alias("__cells"))
    per_entity = per_window.groupBy(*keys).agg(
        F.sum("__n").alias("n"), F.sum(F.col("__n") - 1).alias("d"), F.sum("__missing").alias("m"),
        F.sum("__positive").alias("p"), F.sum("__cells").alias("c"))
    return per_entity.agg(
        F.count("*").alias("n_entities"), F.sum("n").alias("n_windows"), F.sum("d").alias("n_duplicates"),
        F.sum("m").alias("n_missing_target"), F.sum("p").alias("n_positive"), F.sum("c").alias("n_missing_cells"))
