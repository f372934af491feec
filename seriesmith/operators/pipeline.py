"""The whole way from the modalities of a series to its feature table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmith.operators import features as ft
from seriesmith.operators.joins import checked_join
from seriesmith.operators.ordered import find_large_keys
from seriesmith.operators.series import complete_windows, elapsed_time, join_modalities, operation_data, window_position
from seriesmith.session import pin

FILE_ORDER = ["file_block", "file_row"]


def join_in_file_order(modalities: Mapping[str, DataFrame], seconds: Column, clamp_for: Column | None = None,
                       keys: Sequence[str] = ("identifier",)) -> DataFrame:
    """Actuators with labels and sensors of the same time and the time elapsed since the first row of their file.

    Rows follow each other as in the actuators' file, so a clock that is set back does not move them; ``clamp_for`` marks
    where such a step counts as 0. The order columns of the other files are not read.
    """
    others = [modalities[n].drop(*FILE_ORDER) for n in ("labels", "sensors")]
    joined = pin(join_modalities(modalities["actuators"], *others))  # files are read once, the clock passes over the rows
    return elapsed_time(joined, keys, FILE_ORDER, seconds, clamp_for)


def ml_table(series: DataFrame, signals: Sequence[str], actuators: Sequence[str] = (), corr_signals: Sequence[str] = (),
             pairs: Sequence[tuple[str, str]] = (), large: Sequence[str] = (), small: Sequence[str] = (),
             metadata: Sequence[str] = (), size: int = 60, keys: Sequence[str] = ("identifier",),
             order: Sequence[str] = FILE_ORDER) -> DataFrame:
    """One row per complete window of the operation phase: metadata, target, features with history, spectrum.

    ``series`` holds the columns that ``operation_data`` asks for and those of ``order``, which places the rows of a window:
    a clock set back gives two rows the same elapsed time.
    """
    rows = pin(operation_data(series, [*signals, *order], large, small, size))
    placed = pin(window_position(complete_windows(rows, keys, size), keys, order))
    names = ft.window_feature_names(signals, actuators, corr_signals, pairs)
    wide = ft.window_kernel(placed, keys, signals, actuators, corr_signals, pairs, size)
    spectrum = [c for c in wide.columns if c not in (*keys, "window", *names)]
    temporal = ft.temporal_features(wide, keys, names, large=find_large_keys(rows, keys, weight=F.lit(1.0 / size)))
    table = temporal.select(*[c for c in temporal.columns if c not in spectrum], *spectrum)
    first = ft.window_metadata(placed, keys, metadata, label="anomaly_label", size=size).drop("anomaly_label")
    return checked_join(first, table, [*keys, "window"], "inner", "one_to_one")
