"""Leakage-safe splitting: experiment classes, balanced group split, integrity checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmith.operators.ordered import join_null_safe
from seriesmith.session import pin

N_SEEDS = 1000


def experiment_class(has_observable: Column, has_unobservable: Column) -> Column:
    """Labels 2 or 3 make an experiment observable; else label 1 makes it unobservable; else it is normal."""
    return F.when(has_observable, "observable").when(has_unobservable, "unobservable").otherwise("normal")


def entity_classes(windows: DataFrame, key: str, label: str, attributes: Sequence[str] = (),
                   order: str = "window") -> DataFrame:
    """Per entity: first known value of each attribute, sorted label set, and class."""
    lab = F.col(label).cast("int")
    firsts = [F.min_by(F.col(a), F.when(F.col(a).isNotNull(), F.col(order))).alias(a) for a in attributes]
    return (
        windows.groupBy(key)
        .agg(
            *firsts,
            F.array_sort(F.collect_set(lab)).alias("labels"),
            F.coalesce(F.bool_or(lab.isin(2, 3)), F.lit(False)).alias("__observable"),
            F.coalesce(F.bool_or(lab == 1), F.lit(False)).alias("__unobservable"),
        )
        .withColumn("experiment_class", experiment_class(F.col("__observable"), F.col("__unobservable")))
        .drop("__observable", "__unobservable")
    )


def balanced_group_split(entities: DataFrame, groups: Sequence[str], n_seeds: int = N_SEEDS) -> DataFrame:
    """Halve the groups so that both halves hold as equal a number of entities as any of ``n_seeds`` draws gives.

    Every draw orders the groups by a hash of seed and group and takes the first half (rounded down) as validation.
    The draws are scored in parallel, one small group list per seed; the lowest seed wins ties.
    Returns the groups with ``n_entities``, ``seed`` and ``side`` (validation or final_test).
    """
    sizes = entities.groupBy(*groups).agg(F.count("*").alias("n_entities"))
    name = F.concat_ws("|", *[F.col(g).cast("string") for g in groups])
    draws = sizes.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(n_seeds - 1)))).withColumn(
        "__hash", F.md5(F.concat_ws("|", F.col("seed").cast("string"), name)))
    by_seed = Window.partitionBy("seed")
    sided = draws.withColumns({
        "__rank": F.row_number().over(by_seed.orderBy("__hash", *groups)),
        "__groups": F.count("*").over(by_seed),
    }).withColumn("side", F.when(F.col("__rank") <= F.floor(F.col("__groups") / 2), "validation")
                  .otherwise("final_test"))
    signed = F.when(F.col("side") == "validation", F.col("n_entities")).otherwise(-F.col("n_entities"))
    best = (
        sided.groupBy("seed").agg(F.abs(F.sum(signed)).alias("gap"))
        .agg(F.min_by("seed", F.struct("gap", "seed")).alias("seed"))
    )
    return sided.join(F.broadcast(best), "seed", "left_semi").select(*groups, "n_entities", "seed", "side")


def assign_by_group(entities: DataFrame, sides: DataFrame, groups: Sequence[str],
                    cls: str = "experiment_class") -> DataFrame:
    """normal -> train, unobservable -> excluded, observable -> the side of its group."""
    joined = join_null_safe(entities, sides.select(*groups, "side"), groups)
    return joined.withColumn(
        "split",
        F.when(F.col(cls) == "normal", "train").when(F.col(cls) == "unobservable", "excluded").otherwise(F.col("side")),
    ).drop("side")


def split_violations(split: DataFrame, source: DataFrame, key: str, groups: Sequence[str],
                     cls: str = "experiment_class") -> DataFrame:
    """Every broken rule as a row (rule, detail); empty when the split is sound.

    Both tables are read by several rules, so they are pinned.
    """
    split, source = pin(split), pin(source.select(key).distinct())
    ident = F.col(key).cast("string").alias("detail")

    def rule(name: str, df: DataFrame, detail: Column = ident) -> DataFrame:
        return df.select(F.lit(name).alias("rule"), detail)

    c, s = F.col(cls), F.col("split")
    group_name = F.concat_ws("|", *[F.col(g).cast("string") for g in groups]).alias("detail")
    shared = (
        split.filter(s.isin("validation", "final_test")).groupBy(*groups)
        .agg(F.min("split").alias("a"), F.max("split").alias("b")).filter("a <> b")
    )
    checks = [
        rule("duplicate entity", split.groupBy(key).count().filter("count > 1")),
        rule("normal not in train", split.filter((c == "normal") & ~s.eqNullSafe("train"))),
        rule("unobservable not excluded", split.filter((c == "unobservable") & ~s.eqNullSafe("excluded"))),
        rule("observable outside evaluation",
             split.filter((c == "observable") & ~F.coalesce(s.isin("validation", "final_test"), F.lit(False)))),
        rule("group in both sides", shared, group_name),
        rule("entity missing", source.join(split, key, "left_anti")),
        rule("entity unknown", split.join(source, key, "left_anti")),
    ]
    out = checks[0]
    for check in checks[1:]:
        out = out.unionByName(check)
    return out


def require_sound(split: DataFrame, source: DataFrame, key: str, groups: Sequence[str]) -> DataFrame:
    found = pin(split_violations(split, source, key, groups))
    count = found.count()
    if count:
        first = [(r["rule"], r["detail"]) for r in found.limit(10).collect()]
        raise ValueError(f"unsound split, {count} violations, among them {first}")
    return split


def class_set_overlap(a: Column, b: Column) -> Column:
    """True when two label sets share a label."""
    return F.arrays_overlap(a, b)
