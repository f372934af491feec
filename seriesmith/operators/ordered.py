"""Ordered per-key computations that stay balanced when one key holds most of the rows.

A plain ``Window.partitionBy(key).orderBy(...)`` sorts a whole key in one task. That is the plan used
for every key of ordinary size. Keys above ``seriesmith.maxRowsPerKey`` rows are cut into contiguous
blocks by a range shuffle on (key, order); the window functions run per block, and what each block must
know of the earlier ones (row count, running sum, last row, last known value) travels through a table
with one row per block.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmith.session import pin

MAX_ROWS_PER_KEY = 5_000_000
MAX_SHARED_KEYS = 500_000


def max_rows_per_key(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("seriesmith.maxRowsPerKey", str(MAX_ROWS_PER_KEY)))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left",
                   plain: Sequence[str] = ()) -> DataFrame:
    """Equi-join that also matches NULL keys and keeps the left side's key columns only.

    ``plain`` names further key columns that are never NULL.
    """
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in [*keys, *plain]})
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
                  + [F.col(k) == F.col(f"__r_{k}") for k in plain])
    joined = left.join(renamed, cond, how)
    return joined.drop(*[f"__r_{k}" for k in [*keys, *plain]])


@dataclass(frozen=True)
class LargeKeys:
    """Keys too long for one task: their number, their rows in total, and the list (None if there are none)."""

    limit: int
    keys: int
    rows: int
    marks: DataFrame | None

    def shared(self, table: DataFrame) -> DataFrame:
        """Broadcast a table with one row per large key; the counted number of keys is checked first."""
        return F.broadcast(table) if self.keys <= MAX_SHARED_KEYS else table


def find_large_keys(df: DataFrame, keys: Sequence[str], max_rows: int | None = None,
                    weight: Column | None = None, at_most: int | None = None) -> LargeKeys:
    """Count rows per key (pre-aggregated, key columns only) and keep the keys above the limit.

    The list has at most total rows / limit entries. One result serves every ordered pass over rows whose number
    per key does not grow. A caller that knows no key has more than ``at_most`` rows may spare the count.
    """
    limit = max_rows or max_rows_per_key(df)
    if at_most is not None and at_most <= limit:
        return LargeKeys(limit, 0, 0, None)
    size = F.count("*") if weight is None else F.sum(weight)
    large = df.groupBy(*keys).agg(size.alias("count")).filter(F.col("count") > limit)
    n_keys, n_rows = large.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    marks = large.select(*keys, F.lit(True).alias("__large")) if n_keys else None
    return LargeKeys(limit, int(n_keys), int(n_rows), marks)


def join_per_key(df: DataFrame, table: DataFrame, keys: Sequence[str], large: LargeKeys,
                 how: str = "left") -> DataFrame:
    """Join a table with one row per key to a long one. Rows of large keys are not shuffled by their key."""
    if large.marks is None:
        return join_null_safe(df, table, keys, how)
    marked = join_null_safe(df, large.shared(large.marks), keys)
    few = large.shared(join_null_safe(table, large.marks, keys, "left_semi"))
    small = join_null_safe(marked.filter(F.col("__large").isNull()).drop("__large"), table, keys, how)
    return small.unionByName(join_null_safe(marked.filter("__large").drop("__large"), few, keys, how))


def join_one_per_key(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join a table with one row per key to a long one without shuffling the long one by its key.

    The table is written down and counted, and sent around when it has at most ``MAX_SHARED_KEYS`` rows. With more keys
    than that both sides are shuffled, and the skew join splits a key that holds many rows.
    """
    pinned = pin(table)
    return join_null_safe(df, F.broadcast(pinned) if pinned.count() <= MAX_SHARED_KEYS else pinned, keys, how)


def without_large(df: DataFrame, keys: Sequence[str], large: LargeKeys) -> DataFrame:
    return df if large.marks is None else join_null_safe(df, large.shared(large.marks), keys, "left_anti")


def _sort_columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c).asc() if isinstance(c, str) else c for c in order]


def ordered_columns(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    *,
    position: str | None = None,
    sums: Mapping[str, Column] | None = None,
    lags: Mapping[str, Column] | None = None,
    last: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
    max_rows: int | None = None,
    large: LargeKeys | None = None,
) -> DataFrame:
    """Add ordered columns per key.

    position   0-based row number
    sums       running sum up to and including the row (NULL counts as 0)
    lags       value of the previous row
    last       latest non-NULL value up to and including the row
    following  nearest non-NULL value strictly after the row

    ``order`` must be a total order of a key's rows. ``large`` takes the result of an earlier ``find_large_keys``.
    """
    sums, lags, last, following = dict(sums or {}), dict(lags or {}), dict(last or {}), dict(following or {})
    keys, order = list(keys), _sort_columns(order)
    large = large or find_large_keys(df, keys, max_rows)
    if large.marks is None:
        return _within(df, keys, order, position, sums, lags, last, following)

    marked = join_null_safe(df, large.shared(large.marks), keys)
    small = marked.filter(F.col("__large").isNull()).drop("__large")
    blocks = max(2, -(-2 * large.rows // large.limit))
    # The range shuffle samples its bounds, so the block ids are written down before they are used twice.
    blocked = pin(
        marked.filter(F.col("__large"))
        .drop("__large")
        .repartitionByRange(blocks, *[F.col(k) for k in keys], *order)
        .withColumn("__block", F.spark_partition_id())
    )
    done = _across_blocks(blocked, keys, order, position, sums, lags, last, following)
    return _within(small, keys, order, position, sums, lags, last, following).unionByName(done)


def _reverse(order: list[Column]) -> list[Column]:
    # Rows are ranked once in ascending order, so "reverse" is the descending rank.
    return [F.col("__rank").desc()]


def _within(df, keys, order, position, sums, lags, last, following) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new: dict[str, Column] = {}
    if position:
        new[position] = F.row_number().over(w).cast("long") - 1
    for name, expr in sums.items():
        new[name] = F.sum(F.coalesce(expr, F.lit(0))).over(upto)
    for name, expr in lags.items():
        new[name] = F.lag(expr).over(w)
    for name, expr in last.items():
        new[name] = F.last(expr, ignorenulls=True).over(upto)
    if following:
        new["__rank"] = F.row_number().over(w)
        for name, expr in following.items():
            new[f"__next_{name}"] = expr
    out = df.withColumns(new) if new else df
    if following:
        # A frame that ends at UNBOUNDED FOLLOWING is quadratic; reading backwards is linear.
        back = Window.partitionBy(*keys).orderBy(*_reverse(order)).rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumns(
            {n: F.last(F.col(f"__next_{n}"), ignorenulls=True).over(back) for n in following}
        ).drop("__rank", *[f"__next_{n}" for n in following])
    return out


def _across_blocks(blocked, keys, order, position, sums, lags, last, following) -> DataFrame:
    bkeys = [*keys, "__block"]
    w = Window.partitionBy(*bkeys).orderBy(*order)
    inner = _within(
        blocked.withColumns({f"__v_{n}": e for n, e in {**lags, **following}.items()}),
        bkeys, order, "__pos", sums, lags, last, following,
    ).withColumn("__end", F.lead(F.lit(1)).over(w).isNull())

    # One row per (key, block), taken from the block's last (first) row.
    ends = inner.filter("__end").select(
        *bkeys, (F.col("__pos") + 1).alias("__n"),
        *[F.col(n).alias(f"__s_{n}") for n in sums],
        *[F.struct(f"__v_{n}").alias(f"__l_{n}") for n in lags],
        *[F.col(n).alias(f"__f_{n}") for n in last],
    )
    starts = inner.filter(F.col("__pos") == 0).select(
        *bkeys, *[F.coalesce(F.col(f"__v_{n}"), F.col(n)).alias(f"__b_{n}") for n in following]
    )
    summary = join_null_safe(ends, starts, bkeys, "inner") if following else ends
    along = Window.partitionBy(*keys).orderBy("__block")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(*keys).orderBy(F.col("__block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *bkeys,
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__cn"),
        *[F.sum(f"__s_{n}").over(before).alias(f"__cs_{n}") for n in sums],
        *[F.lag(f"__l_{n}").over(along).alias(f"__cl_{n}") for n in lags],
        *[F.last(f"__f_{n}", ignorenulls=True).over(before).alias(f"__cf_{n}") for n in last],
        *[F.last(f"__b_{n}", ignorenulls=True).over(behind).alias(f"__cb_{n}") for n in following],
    )
    joined = join_null_safe(inner, carry, bkeys, "inner")
    new: dict[str, Column] = {}
    if position:
        new[position] = F.col("__pos") + F.col("__cn")
    for n in sums:
        new[n] = F.when(F.col(f"__cs_{n}").isNull(), F.col(n)).otherwise(F.col(n) + F.col(f"__cs_{n}"))
    for n in lags:
        new[n] = F.when(F.col("__pos") == 0, F.col(f"__cl_{n}.__v_{n}")).otherwise(F.col(n))
    for n in last:
        new[n] = F.coalesce(F.col(n), F.col(f"__cf_{n}"))
    for n in following:
        new[n] = F.coalesce(F.col(n), F.col(f"__cb_{n}"))
    return joined.withColumns(new).drop(
        "__block", "__pos", "__end", "__cn",
        *[f"__v_{n}" for n in [*lags, *following]],
        *[f"__cs_{n}" for n in sums], *[f"__cl_{n}" for n in lags],
        *[f"__cf_{n}" for n in last], *[f"__cb_{n}" for n in following],
    )


def row_position(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "position",
                 max_rows: int | None = None, large: LargeKeys | None = None) -> DataFrame:
    return ordered_columns(df, keys, order, position=name, max_rows=max_rows, large=large)


def run_starts(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: Column,
               name: str = "run_start", max_rows: int | None = None, large: LargeKeys | None = None) -> DataFrame:
    """True where ``value`` differs from the previous row; the first row of a key counts as a change."""
    lagged = ordered_columns(df, keys, order, lags={"__prev": F.struct(value.alias("v"))}, max_rows=max_rows,
                             large=large)
    changed = F.col("__prev").isNull() | ~F.col("__prev.v").eqNullSafe(value)
    return lagged.withColumn(name, changed).drop("__prev")


def run_ids(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: Column,
            name: str = "run_id", max_rows: int | None = None, large: LargeKeys | None = None) -> DataFrame:
    """Number the runs of equal ``value`` per key, starting at 1."""
    large = large or find_large_keys(df, keys, max_rows)
    flagged = run_starts(df, keys, order, value, "__start", large=large)
    return ordered_columns(
        flagged, keys, order, sums={name: F.col("__start").cast("long")}, large=large
    ).drop("__start")
