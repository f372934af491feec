"""Declared rules about a table, compiled into one aggregate that counts offenders and names the first and last."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Numbers of features of the published tables.
FEATURE_COUNTS = {"baseline_raw_windows": 1800, "window_features": 240, "temporal_features": 720, "ml_features": 780}


@dataclass(frozen=True)
class Rule:
    """One rule; build it with the functions below."""

    name: str
    kind: str
    columns: tuple[str, ...] = ()
    condition: Column | None = None
    table: DataFrame | None = None
    difference: int = 0


def holds(name: str, condition: Column) -> Rule:
    """Every row meets the condition; NULL does not."""
    return Rule(name, "row", condition=F.coalesce(condition, F.lit(False)))


def not_null(*columns: str) -> list[Rule]:
    return [holds(f"not_null {c}", F.col(c).isNotNull()) for c in columns]


def in_range(column: str, low: float, high: float) -> Rule:
    """Values lie between the bounds, both included; NULL passes, NaN does not."""
    c = F.col(column)
    return holds(f"in_range {column}", c.isNull() | (c.between(low, high) & ~F.isnan(c.cast("double"))))


def finite(columns: Sequence[str], name: str = "finite") -> Rule:
    """No cell of the columns is infinite or NaN; NULL passes."""
    cells = F.array(*[F.col(c).cast("double") for c in columns]).cast("array<double>")
    return holds(name, ~F.exists(cells, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(False))))


def references(columns: Sequence[str], table: DataFrame) -> Rule:
    """The row's key occurs in the table's columns of the same names; a key with a NULL passes."""
    return Rule(f"references {','.join(columns)}", "reference", tuple(columns), table=table)


def unique() -> Rule:
    """No two rows have the same key (NULL equals NULL); every row beyond the first of a key counts."""
    return Rule("unique", "unique")


def once_per(columns: Sequence[str], name: str, condition: Column) -> Rule:
    """In every group exactly one row meets the condition; other groups count."""
    return Rule(name, "once", tuple(columns), F.coalesce(condition, F.lit(False)))


def feature_count(features: Sequence[str], expected: int, name: str = "feature_count") -> Rule:
    """The table has the agreed number of features; the difference counts."""
    return Rule(name, "schema", difference=abs(len(features) - expected))


def _label(columns: Sequence[str]) -> Column:
    return F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])


def _with_references(df: DataFrame, rules: Sequence[tuple[int, Rule]], rows: Column) -> DataFrame:
    for i, rule in rules:
        mine = [f"__key_{c}" for c in rule.columns]
        known = rule.table.select(*[F.col(c).alias(m) for c, m in zip(rule.columns, mine)]).distinct().withColumn(
            "__known", F.lit(True))
        on = reduce(lambda a, b: a & b, [F.col(c) == F.col(m) for c, m in zip(rule.columns, mine)])
        whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in rule.columns])
        bad = F.when(whole & F.col("__known").isNull(), rows).otherwise(F.lit(0))
        df = df.join(known, on, "left").withColumn(f"__v{i}", bad.cast("long")).drop("__known", *mine)
    return df


def check(df: DataFrame, keys: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """One row per rule: rule, n_rows of the table, violations, first_offender and last_offender.

    Offenders are keys joined by ``/`` (groups for ``once_per``), first and last as text. The table is read once: rows are
    reduced per key, keys per group from the finest group to the coarsest, and groups to one row; numbers alone pass
    the first shuffle. Groups of ``once_per`` must be nested subsets of the keys. Without ``unique`` and ``once_per``
    nothing is grouped. References on key columns are looked up after rows are reduced to keys, others before.

    An empty table has no violations; NULL keys are shown as ``null``; other columns are not read.
    """
    names = [r.name for r in rules]
    if len(set(names)) < len(names):
        raise ValueError("two rules have the same name")
    indexed = list(enumerate(rules))
    of = {k: [(i, r) for i, r in indexed if r.kind == k] for k in ("row", "reference", "unique", "once", "schema")}
    levels = sorted({r.columns for _, r in of["once"]}, key=len, reverse=True)
    for wide, narrow in zip([tuple(keys), *levels], levels):
        if not set(narrow) <= set(wide):
            raise ValueError(f"groups are not nested: {narrow} is not part of {wide}")
    late = [(i, r) for i, r in of["reference"] if set(r.columns) <= set(keys)]
    early = [p for p in of["reference"] if p not in late]

    table = _with_references(df, early, F.lit(1))
    table = table.select(
        *keys, F.lit(1).cast("long").alias("__n"),
        *[F.when(r.condition, 0).otherwise(1).cast("long").alias(f"__v{i}") for i, r in of["row"]],
        *[f"__v{i}" for i, _ in early],
        *[r.condition.cast("long").alias(f"__c{i}") for i, r in of["once"]])
    counted = [i for i, _ in of["row"] + early]
    if of["unique"] or of["once"]:
        table = table.groupBy(*keys).agg(
            F.sum("__n").alias("__n"), *[F.sum(f"__v{i}").alias(f"__v{i}") for i in counted],
            *[F.sum(f"__c{i}").alias(f"__c{i}") for i, _ in of["once"]])
    table = _with_references(table, late, F.col("__n"))
    table = table.withColumns({f"__v{i}": F.col("__n") - 1 for i, _ in of["unique"]})
    counted += [i for i, _ in late + of["unique"]]
    offender = {i: F.when(F.col(f"__v{i}") > 0, _label(keys)) for i in counted}
    table = table.withColumns({f"__{end}{i}": o for i, o in offender.items() for end in ("first", "last")})

    def carried() -> list[Column]:
        return [F.sum("__n").alias("__n"), *[e for i in counted for e in (
            F.sum(f"__v{i}").alias(f"__v{i}"), F.min(f"__first{i}").alias(f"__first{i}"),
            F.max(f"__last{i}").alias(f"__last{i}"))]]

    waiting = [i for i, _ in of["once"]]
    for level in levels:
        table = table.groupBy(*level).agg(*carried(), *[F.sum(f"__c{i}").alias(f"__c{i}") for i in waiting])
        done = [i for i, r in of["once"] if r.columns == level]
        bad = {i: F.col(f"__c{i}") != 1 for i in done}
        table = table.withColumns({f"__v{i}": b.cast("long") for i, b in bad.items()}
                                  | {f"__{end}{i}": F.when(b, _label(level)) for i, b in bad.items()
                                     for end in ("first", "last")})
        counted += done
        waiting = [i for i in waiting if i not in done]

    total = table.agg(*carried())
    nothing = F.lit(None).cast("string")
    lines = [F.struct(
        F.lit(r.name).alias("rule"), F.coalesce("__n", F.lit(0)).cast("long").alias("n_rows"),
        (F.lit(r.difference) if r.kind == "schema" else F.coalesce(f"__v{i}", F.lit(0))).cast("long").alias("violations"),
        (nothing if r.kind == "schema" else F.col(f"__first{i}")).alias("first_offender"),
        (nothing if r.kind == "schema" else F.col(f"__last{i}")).alias("last_offender")) for i, r in indexed]
    return total.select(F.inline(F.array(*lines)))


def enforce(report: DataFrame) -> None:
    """End the job with the names of the broken rules; the report has one row per rule."""
    broken = report.filter("violations > 0").collect()
    if broken:
        raise ValueError("broken rules: " + "; ".join(
            f"{r['rule']}: {r['violations']} (first {r['first_offender']}, last {r['last_offender']})" for r in broken))
