"""Joins with contracts: cardinality, lookups, two-way difference, text match."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") > 1)


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key, as one number."""
    return df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_duplicates"))


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner",
                 validate: str = "one_to_one") -> DataFrame:
    """Equi-join that raises when a side that must be unique is not."""
    sides = {"one_to_one": [("left", left), ("right", right)], "many_to_one": [("right", right)],
             "one_to_many": [("left", left)]}
    if validate not in sides:
        raise ValueError(f"unknown contract {validate}")
    for name, side in sides[validate]:
        if not duplicate_keys(side, on).isEmpty():
            raise ValueError(f"{validate} violated: {name} side has duplicate keys on {list(on)}")
    return left.join(right, list(on), how)


def assign_split(entities: DataFrame, split: DataFrame, key: str = "identifier", kind: str = "experiment_type",
                 default_kind: str = "train_normal") -> DataFrame:
    """Split looked up by entity; normal training experiments default to train when not listed."""
    looked = entities.drop("split").join(split.select(key, F.col("split").alias("__split")), key, "left")
    default = F.when(F.col(kind) == default_kind, F.lit("train"))
    return looked.withColumn("split", F.coalesce(F.col("__split"), default)).drop("__split")


def model_datasets(df: DataFrame, target: str = "observable_anomaly") -> dict[str, DataFrame]:
    """Train on normal rows only; evaluate on rows with a known target."""
    known = F.col(target).isNotNull()
    return {
        "train": df.filter((F.col("split") == "train") & (F.col(target) == 0)),
        "validation": df.filter((F.col("split") == "validation") & known),
        "final_test": df.filter((F.col("split") == "final_test") & known),
    }


def key_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present on one side only, with the side that lacks them."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti").withColumn("missing_in", F.lit("right")).unionByName(
        b.join(a, list(keys), "left_anti").withColumn("missing_in", F.lit("left"))
    )


def pending_inputs(candidates: DataFrame, done: DataFrame, partner: DataFrame | None, key: str) -> DataFrame:
    """Inputs not processed yet that have their partner file."""
    todo = candidates.join(done.select(key).distinct(), key, "left_anti")
    return todo.join(partner.select(key).distinct(), key, "left_semi") if partner is not None else todo


def words(text: Column) -> Column:
    """Lower-case word tokens (letters, digits, underscore) in their order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), F.lit(1))


def match_word(keys: DataFrame, titles: DataFrame, key: str, title: str, title_order: str) -> DataFrame:
    """First title (by ``title_order``) that contains the key as whole words, ignoring case.

    A word-boundary match needs all words of the key next to each other in the title, so both sides meet on the key's
    whole word sequence by an equi-join, and only those candidates are tested for what stands between the words. Titles
    give their word sequences of the lengths that keys have (a handful of numbers, collected). The first match is a
    pre-aggregated minimum. A key without any word character matches nothing.
    """
    anchored = keys.withColumn("__words", words(F.col(key))).filter(F.size("__words") > 0)
    lengths = [r[0] for r in anchored.select(F.size("__words")).distinct().collect()]
    found = words(F.col(title))
    none = F.array().cast("array<string>")

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(found) - (n - 1))
        joined = F.transform(starts, lambda i: F.array_join(F.slice(found, i, n), " "))
        return F.when(F.size(found) >= n, joined).otherwise(none)

    spread = titles.select(title, title_order, F.explode(F.array_distinct(F.concat(none, *map(runs, lengths)))).alias("__word"))
    literal = F.replace(F.col(key), F.lit(r"\E"), F.lit(r"\E\\E\Q"))
    quoted = F.concat(F.lit(r"(?iuU)\b\Q"), literal, F.lit(r"\E\b"))
    return (
        anchored.select(key, F.array_join("__words", " ").alias("__word")).join(spread, "__word")
        .filter(F.rlike(F.col(title), quoted))
        .groupBy(key)
        .agg(F.min_by(title, title_order).alias(title), F.min(title_order).alias(title_order))
    )


def best_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank: str | None = None) -> DataFrame:
    """Best row per key of a small result table (one row per tried configuration)."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    best = ranked.filter("__rank = 1")
    return best.withColumnRenamed("__rank", rank) if rank else best.drop("__rank")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by column name, absent columns filled with NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def overlap(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present on both sides; empty means the sides are disjoint."""
    return left.select(*keys).intersect(right.select(*keys))


def exclude(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows whose column is none of a short list of values; rows without a value stay."""
    return df.filter(~F.coalesce(F.col(column).isin(list(values)), F.lit(False)))
