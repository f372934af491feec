"""Series preparation: joining modalities, elapsed time, tumbling windows, complete windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmith.functions.expressions import ordered_select, require_columns
from seriesmith.operators.cleaning import repair_scales
from seriesmith.operators.ordered import (
    LargeKeys, find_large_keys, join_null_safe, join_per_key, max_rows_per_key, ordered_columns, row_position,
    without_large,
)


def join_modalities(actuators: DataFrame, labels: DataFrame, sensors: DataFrame,
                    on: Sequence[str] = ("identifier", "Time"), label: str = "anomaly_label",
                    raw_label: str = "Label (anomaly)") -> DataFrame:
    """actuators left-joined with labels and sensors; a row without a label gets label 0.

    Rows whose key holds a NULL match nothing.
    """
    on = list(on)
    if raw_label in labels.columns:
        labels = labels.withColumnRenamed(raw_label, label)
    return (
        actuators.join(labels, on, "left")
        .join(sensors, on, "left")
        .withColumn(label, F.coalesce(F.col(label), F.lit(0)))
    )


def elapsed_time(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], seconds: Column,
                 clamp_for: Column | None = None, name: str = "elapsed_time",
                 max_rows: int | None = None) -> DataFrame:
    """Running sum of the steps to the previous row, 0 for the first row.

    Negative steps are kept, except where ``clamp_for`` is true (a known clock error), where they count as 0.
    """
    step = "__step"
    large = find_large_keys(df, keys, max_rows)
    lagged = ordered_columns(df, keys, order, lags={"__prev": seconds}, large=large)
    raw = seconds - F.col("__prev")
    cond = raw < 0
    cond = cond & clamp_for if clamp_for is not None else F.lit(False)
    stepped = lagged.withColumn(step, F.when(cond, F.lit(0)).otherwise(raw))
    return ordered_columns(stepped, keys, order, sums={name: F.col(step)}, large=large).drop(step, "__prev")


def elapsed_since_first(df: DataFrame, keys: Sequence[str], seconds: str, name: str = "elapsed_time",
                        max_rows: int | None = None) -> DataFrame:
    """Time since the earliest row of the key: one small aggregate joined back, no sort."""
    first = df.groupBy(*keys).agg(F.min(seconds).alias("__first"))
    joined = join_per_key(df, first, keys, find_large_keys(df, keys, max_rows))
    return joined.withColumn(name, F.col(seconds) - F.col("__first")).drop("__first")


def tumbling_windows(df: DataFrame, elapsed: str = "elapsed_time", size: int = 60) -> DataFrame:
    """Window number per row with its start and (exclusive) end, relative to the series start."""
    number = F.floor(F.col(elapsed) / size).cast("int")
    return df.withColumn("window", number).withColumns(
        {"window_start": F.col("window") * size, "window_end": (F.col("window") + 1) * size}
    )


def phase_filter(df: DataFrame, phase: str = "operation", column: str = "phase") -> DataFrame:
    return df.filter(F.lower(F.col(column)) == phase.lower())


def complete_windows(df: DataFrame, keys: Sequence[str], size: int = 60, window: str = "window",
                     max_rows: int | None = None) -> DataFrame:
    """Rows of the windows that hold exactly ``size`` rows.

    The count is pre-aggregated before its shuffle. Windows too long for one task cannot be complete, so their rows
    leave before the others are shuffled.
    """
    group = [*keys, window]
    limit = max(size, max_rows or max_rows_per_key(df))
    full = df.groupBy(*group).count().filter(F.col("count") == size).select(*group)
    rest = without_large(df, group, find_large_keys(df, group, limit))
    return join_null_safe(rest, full, group, "left_semi")


def window_position(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], window: str = "window",
                    name: str = "position") -> DataFrame:
    """0-based position inside a complete window (at most ``size`` rows per group)."""
    w = Window.partitionBy(*keys, window).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w).cast("long") - 1)


def position_windows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], size: int = 60,
                     max_rows: int | None = None, large: LargeKeys | None = None) -> DataFrame:
    """Windows of ``size`` consecutive rows for series without a clock: adds window, position, window_rows.

    Window k is complete exactly when ``window_rows == size``. A group has at most ``size`` rows.
    """
    out = row_position(df, keys, order, "__row", max_rows=max_rows, large=large)
    out = out.withColumns({
        "window": F.floor(F.col("__row") / size).cast("int"),
        "position": F.pmod(F.col("__row"), F.lit(size)),
    }).drop("__row")
    return out.withColumn("window_rows", F.count("*").over(Window.partitionBy(*keys, "window")))


def operation_data(series: DataFrame, signals: Sequence[str], large: Sequence[str] = (), small: Sequence[str] = (),
                   size: int = 60) -> DataFrame:
    """Operation-phase rows with repaired signals and window numbers, metadata first; a missing column is an error."""
    # Metadata columns of the output in their order.
    meta = ["Time", "elapsed_time", "anomaly_label", "identifier", "phase", "batch", "operating_point",
            "experiment_type", "experiment"]
    require_columns(series, [*meta, *signals])
    fixed = repair_scales(series, {**{c: 500 for c in large}, **{c: 1 for c in small}})
    kept = ordered_select(phase_filter(fixed), [*meta, *signals], keep_rest=False)
    return tumbling_windows(kept, "elapsed_time", size)
