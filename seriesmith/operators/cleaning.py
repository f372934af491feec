"""Row repair: scales, units, duplicates, gaps, phases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmith.functions.expressions import repair_scale
from seriesmith.operators.ordered import (
    LargeKeys, find_large_keys, join_null_safe, join_per_key, ordered_columns, row_position, run_ids,
)


def repair_scales(df: DataFrame, thresholds: Mapping[str, float], divisor: float = 1000.0,
                  use_abs: bool = False) -> DataFrame:
    return df.withColumns({c: repair_scale(F.col(c), t, divisor, use_abs) for c, t in thresholds.items()})


def convert_units(df: DataFrame, factors: Mapping[str, float]) -> DataFrame:
    """Percent of full scale to absolute units: ``x / 100 * factor``."""
    return df.withColumns({c: F.col(c) / 100 * F.lit(f) for c, f in factors.items()})


def floor_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.floor(F.col(c)).cast("double") for c in columns})


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key as a pre-aggregated minimum, so a key with many copies is reduced before the shuffle."""
    rest = [c for c in df.columns if c not in set(keys)]
    lead = [c for c in order if c in rest]
    row = F.struct(*lead, *[c for c in rest if c not in set(lead)])
    best = df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("__row"))
    return best.select(*[F.col(c) if c in set(keys) else F.col(f"__row.{c}").alias(c) for c in df.columns])


def resample_interpolate(df: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str], step: int = 1,
                         max_rows: int | None = None) -> DataFrame:
    """One row per ``step`` between the first and last time of a key, gaps filled linearly.

    ``time`` is an integer; its values must be unique per key and lie on the step grid. A trailing gap of a
    column repeats its last value, a leading gap stays NULL. ``quality`` is 1 for measured rows, 2 for filled ones.
    Each measured row emits only its own gap, in chunks, so no single row or task holds a whole series.
    """
    # A present value and its time travel together, so that gaps of different columns stay apart.
    point = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(time).alias("t"), F.col(c).cast("double").alias("x")))
             for c in columns}
    known = ordered_columns(
        df, keys, [time],
        last={f"__p_{c}": point[c] for c in columns},
        following={**{f"__n_{c}": point[c] for c in columns}, "__next": F.col(time)},
        max_rows=max_rows,
    )
    chunk = 4096
    points = F.coalesce(F.floor((F.col("__next") - F.col(time)) / step), F.lit(1)).cast("long")
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("__count") - 1) / chunk).cast("long"))
    upto = F.least(F.col("__count"), (F.col("__chunk") + 1) * chunk) - 1
    grid = (
        known.withColumn("__count", points)
        .withColumn("__chunk", F.explode(chunks))
        .withColumn("__i", F.explode(F.sequence(F.col("__chunk") * chunk, upto)))
        .withColumn("__t", F.col(time) + F.col("__i") * step)
    )

    def filled(c: str) -> Column:
        p, n = F.col(f"__p_{c}"), F.col(f"__n_{c}")
        line = p["x"] + (n["x"] - p["x"]) * (F.col("__t") - p["t"]) / (n["t"] - p["t"])
        return F.when(p.isNotNull() & n.isNotNull(), line).otherwise(p["x"]).alias(c)

    return grid.select(
        *keys,
        F.col("__t").alias(time),
        *[filled(c) for c in columns],
        F.when(F.col("__i") == 0, 1).otherwise(2).alias("quality"),
    )


def long_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], mask: Column, longer_than: int = 50,
              max_rows: int | None = None, large: LargeKeys | None = None) -> DataFrame:
    """Runs in which ``mask`` is true for more than ``longer_than`` rows: key, run_id, first_position, run_length.

    A NULL mask counts as false.
    """
    large = large or find_large_keys(df, keys, max_rows)
    flag = F.coalesce(mask, F.lit(False))
    indexed = row_position(df.withColumn("__mask", flag), keys, order, "position", large=large)
    numbered = run_ids(indexed, keys, ["position"], F.col("__mask"), "run_id", large=large)
    return (
        numbered.filter("__mask")
        .groupBy(*keys, "run_id")
        .agg(F.min("position").alias("first_position"), F.count("*").alias("run_length"))
        .filter(F.col("run_length") > longer_than)
    )


def phase_status(df: DataFrame, keys: Sequence[str], order: Sequence[str], active: Column, mask: Column,
                 longer_than: int = 50, position: str = "position", large: LargeKeys | None = None) -> DataFrame:
    """Per key: n_rows, first and last active position, start of the first long run of ``mask`` and a status.

    The status is ``split`` where all three positions are known, else ``never active`` or ``no long run``: those keys have
    no phases and are reported here. NULL conditions count as false.
    """
    ends = df.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        F.min(F.when(active, F.col(position))).alias("startup_position"),
        F.max(F.when(active, F.col(position))).alias("shutdown_position"),
    )
    runs = (
        long_runs(df, keys, order, mask, longer_than, large=large)
        .groupBy(*keys)
        .agg(F.min("first_position").alias("operation_position"))
    )
    status = F.when(F.col("startup_position").isNull(), "never active").when(
        F.col("operation_position").isNull(), "no long run").otherwise("split")
    return join_null_safe(ends, runs, keys, "left").withColumn("status", status)


def phase_boundaries(df: DataFrame, keys: Sequence[str], order: Sequence[str], active: Column, mask: Column,
                     longer_than: int = 50, position: str = "position", large: LargeKeys | None = None) -> DataFrame:
    """Per key: first and last active position and the start of the first long run of ``mask``.

    Keys that are never active or have no long run are left out; ``phase_status`` names them.
    """
    found = phase_status(df, keys, order, active, mask, longer_than, position, large)
    return found.filter("startup_position IS NOT NULL AND operation_position IS NOT NULL").drop("n_rows", "status")


def split_phases(df: DataFrame, keys: Sequence[str], order: Sequence[str], active: Column, mask: Column,
                 longer_than: int = 50, max_rows: int | None = None) -> DataFrame:
    """Cut a series into Startup, Operation and Shutdown rows.

    Startup runs up to and including the first row of the first long run of ``mask``; Operation from there to two
    rows before the last active row; Shutdown from that row to the end. The boundary rows belong to two phases and
    appear twice. Keys that are never active or have no long run are left out; ``phase_status`` names them.
    """
    large = find_large_keys(df, keys, max_rows)
    indexed = row_position(df, keys, order, "position", large=large)
    bounds = phase_boundaries(indexed, keys, order, active, mask, longer_than, large=large)
    joined = join_per_key(indexed, bounds, keys, large, "inner")
    p, s, d = F.col("position"), F.col("startup_position"), F.col("operation_position")
    cut = F.col("shutdown_position") - 2
    phases = F.array(
        F.when(p.between(s, d), F.lit("Startup")),
        F.when(p.between(d, cut), F.lit("Operation")),
        F.when(p >= cut, F.lit("Shutdown")),
    )
    return joined.withColumn("phase", F.explode(F.array_compact(phases))).drop(
        "startup_position", "operation_position", "shutdown_position"
    )
