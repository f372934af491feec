"""Window features: statistics, slopes, constant flags, correlations, differences, spectrum, previous window.

Everything is computed in long form, one row per (key, window, signal), and pivoted only where a wide table is
asked for. The unpivot happens before the aggregate, so the map side reduces each window to one row per signal.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmith.functions.expressions import binary_target, pair_differences
from seriesmith.functions.statistics import constant_flag, safe_corr, strict_slope
from seriesmith.operators.ordered import LargeKeys, join_null_safe, ordered_columns
from seriesmith.session import ship_package

STATISTICS = ("mean", "std", "min", "max")
SPECTRUM = ("total_power", "dominant_power_ratio", "spectral_entropy")


def as_doubles(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    types = dict(df.dtypes)
    return [F.col(c) if types.get(c) == "double" else F.col(c).cast("double").alias(c) for c in columns]


def to_long(df: DataFrame, keep: Sequence[str], signals: Sequence[str], name: str = "signal",
            value: str = "value") -> DataFrame:
    """Selected signals in tall form, NULL values kept.

    One array per row is exploded; the plan stays small for hundreds of columns.
    """
    tall = _numbered(df, keep, signals, value)
    return tall.select(*keep, _name(signals).alias(name), value)


def _numbered(df: DataFrame, keep: Sequence[str], signals: Sequence[str], value: str = "value") -> DataFrame:
    """Tall form with the signal as its number ``__i``: cheaper to group by than its name."""
    return df.select(*keep, F.posexplode(F.array(*as_doubles(df, signals))).alias("__i", value))


def _name(signals: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(s) for s in signals]), F.col("__i"))


def window_stats(df: DataFrame, keys: Sequence[str], signals: Sequence[str], size: int = 60,
                 window: str = "window", position: str = "position", constants: bool = False) -> DataFrame:
    """mean, std, min, max and slope of every signal in every complete window, in one aggregation.

    Completeness is tested on the aggregated row count, so incomplete windows need no join or second pass.
    """
    v = F.col("value")
    return (
        _numbered(df, [*keys, window, position], signals)
        .groupBy(*keys, window, "__i")
        .agg(
            F.count("*").alias("__n"),
            F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            strict_slope(v, F.col(position), size).alias("slope"),
            *([constant_flag(v).alias("constant")] if constants else []),
        )
        .filter(F.col("__n") == size)
        .withColumn("__i", _name(signals))
        .withColumnRenamed("__i", "signal")
        .drop("__n")
    )


def window_constants(df: DataFrame, keys: Sequence[str], signals: Sequence[str], size: int = 60,
                     window: str = "window") -> DataFrame:
    return (
        _numbered(df, [*keys, window], signals)
        .groupBy(*keys, window, "__i")
        .agg(F.count("*").alias("__n"), constant_flag(F.col("value")).alias("constant"))
        .filter(F.col("__n") == size)
        .withColumn("__i", _name(signals))
        .withColumnRenamed("__i", "signal")
        .drop("__n")
    )


def window_correlations(df: DataFrame, keys: Sequence[str], signals: Sequence[str], size: int = 60,
                        window: str = "window") -> DataFrame:
    """Pearson correlation of every unordered pair of signals (pairs of columns, not of rows)."""
    x = dict(zip(signals, as_doubles(df, signals)))
    couples = list(combinations(signals, 2))
    pairs = F.array(*[F.struct(x[a].alias("x"), x[b].alias("y")) for a, b in couples])
    return (
        df.select(*keys, window, F.posexplode(pairs).alias("__i", "p"))
        .groupBy(*keys, window, "__i")
        .agg(F.count("*").alias("__n"), safe_corr(F.col("p.x"), F.col("p.y")).alias("corr"))
        .filter(F.col("__n") == size)
        .select(*keys, window, _name([f"{a}_{b}" for a, b in couples]).alias("pair"), "corr")
    )


def difference_features(df: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]], size: int = 60,
                        window: str = "window", position: str = "position") -> DataFrame:
    """Statistics and slope of the differences of configured signal pairs."""
    diffs = pair_differences(pairs)
    return window_stats(df.select(*keys, window, position, *[e.alias(n) for n, e in diffs.items()]),
                        keys, list(diffs), size, window, position)


def pivot_wide(long: DataFrame, keys: Sequence[str], name: str, names: Sequence[str],
               values: Mapping[str, str]) -> DataFrame:
    """Tall to wide with the column names known beforehand (no extra pass to discover them).

    ``values`` maps a value column to its output pattern, e.g. ``{"mean": "{name}_mean"}``.
    """
    grouped = long.groupBy(*keys).pivot(name, list(names))
    wide = grouped.agg(*[F.max(F.col(v)).alias(f"__{i}") for i, v in enumerate(values)])
    only = len(values) == 1
    return wide.select(*keys, *[
        F.col(f"`{n}`" if only else f"`{n}___{i}`").alias(pattern.format(name=n))
        for n in names for i, pattern in enumerate(values.values())
    ])


def window_features(df: DataFrame, keys: Sequence[str], signals: Sequence[str], actuators: Sequence[str] = (),
                    corr_signals: Sequence[str] = (), diff_pairs: Sequence[tuple[str, str]] = (), size: int = 60,
                    window: str = "window", position: str = "position") -> DataFrame:
    """The wide window table: all blocks are reduced to named values in long form, then pivoted once.

    ``actuators`` must be a subset of ``signals``.

    One union and one pivot replace a chain of one-to-one joins of the blocks.
    """
    diffs = pair_differences(diff_pairs)
    base = df.select(*keys, window, position, *signals, *[e.alias(n) for n, e in diffs.items()])
    stats = window_stats(base, keys, [*signals, *diffs], size, window, position, constants=True)
    # Actuators are signals, so their constant flag falls out of the same aggregation.
    cells = [("mean", "mean"), ("std", "std"), ("min", "min"), ("max", "max"), ("slope", "slope")]
    flag = F.when(F.col("signal").isin(list(actuators)), F.col("constant").cast("double"))
    named = [(F.col(c), s) for c, s in cells] + ([(flag, "constant")] if actuators else [])
    blocks = [stats.select(*keys, window, F.inline(F.array(*[
        F.struct(F.concat(F.col("signal"), F.lit(f"_{s}")).alias("feature"), c.alias("value")) for c, s in named
    ])))]
    if corr_signals:
        blocks.append(window_correlations(df, keys, corr_signals, size, window).select(
            *keys, window, F.concat("pair", F.lit("_corr")).alias("feature"), F.col("corr").alias("value")))
    long = blocks[0]
    for b in blocks[1:]:
        long = long.unionByName(b)
    names = window_feature_names(signals, actuators, corr_signals, diff_pairs)
    return pivot_wide(long, [*keys, window], "feature", names, {"value": "{name}"})


def window_feature_names(signals: Sequence[str], actuators: Sequence[str] = (), corr_signals: Sequence[str] = (),
                         diff_pairs: Sequence[tuple[str, str]] = ()) -> list[str]:
    return [
        *[f"{s}_{x}" for s in signals for x in STATISTICS],
        *[f"{s}_slope" for s in signals],
        *[f"{a}_constant" for a in actuators],
        *[f"{a}_{b}_corr" for a, b in combinations(corr_signals, 2)],
        *[f"{a}_{b}_diff_{x}" for a, b in diff_pairs for x in (*STATISTICS, "slope")],
    ]


def window_metadata(df: DataFrame, keys: Sequence[str], columns: Sequence[str], window: str = "window",
                    position: str = "position", label: str | None = None, size: int = 60) -> DataFrame:
    """Metadata (and label) of the first row of every complete window, as one pre-aggregated minimum."""
    picked = [*columns, *([label] if label else [])]
    first = (
        df.groupBy(*keys, window)
        .agg(F.min_by(F.struct(*picked), F.col(position)).alias("__first"), F.count("*").alias("__n"))
        .filter(F.col("__n") == size)
    )
    out = first.select(*keys, window, *[F.col(f"__first.{c}").alias(c) for c in picked])
    return out.withColumn("target", binary_target(F.col(label))) if label else out


def window_arrays(df: DataFrame, keys: Sequence[str], signals: Sequence[str], size: int = 60,
                  window: str = "window", position: str = "position") -> DataFrame:
    """One row per complete window, one array of ``size`` values per signal, in position order.

    Only rows at positions below ``size`` are gathered, and a window counts as complete if it has no others; positions
    are those of ``window_position`` or ``position_windows``, so a longer window gathers ``size`` rows at most.
    """
    row = F.struct(F.col(position).alias("p"), *[F.col(s).cast("double").alias(s) for s in signals])
    rows = F.array_sort(F.collect_list(F.when(F.col(position) < size, row)))
    packed = df.groupBy(*keys, window).agg(rows.alias("__rows"), F.count("*").alias("__n"))
    return packed.filter((F.size("__rows") == size) & (F.col("__n") == size)).select(
        *keys, window, *[F.col(f"__rows.{s}").alias(s) for s in signals]
    )


def raw_windows(df: DataFrame, keys: Sequence[str], signals: Sequence[str], size: int = 60,
                window: str = "window", position: str = "position") -> DataFrame:
    """The flattened window vector: ``size`` columns ``{signal}_{ii}`` per signal."""
    arrays = window_arrays(df, keys, signals, size, window, position)
    return arrays.select(*keys, window, *[
        F.get(F.col(s), F.lit(i)).alias(f"{s}_{i:02d}") for s in signals for i in range(size)
    ])


def unflatten_window(wide: DataFrame, keys: Sequence[str], window: str = "window") -> DataFrame:
    """Inverse of ``raw_windows``: one row per (window, position, signal)."""
    columns = [c for c in wide.columns if c.rpartition("_")[2].isdigit()]
    pattern = r"^(.*)_(\d+)$"
    tall = wide.unpivot([*keys, window], columns, "__column", "value")
    return tall.select(
        *keys, window,
        F.regexp_extract("__column", pattern, 1).alias("signal"),
        F.regexp_extract("__column", pattern, 2).cast("int").alias("position"),
        "value",
    )


def window_series(wide: DataFrame, keys: Sequence[str], values: Sequence, number: int,
                  window: str = "window") -> DataFrame:
    """The time series of one window of one entity; the lookup is a plain filter and reaches the Parquet scan."""
    picked = wide.filter(F.col(window) == number)
    for k, v in zip(keys, values):
        picked = picked.filter(F.col(k) == v)
    return unflatten_window(picked, keys, window).orderBy("signal", "position")


def window_list(df: DataFrame, keys: Sequence[str], window: str = "window") -> DataFrame:
    """Distinct windows in key order."""
    return df.select(*keys, window).distinct().orderBy(*keys, window)


def _power_summary(x: np.ndarray) -> np.ndarray:
    """Total power, dominant power ratio and entropy of each row of ``x``; NaN where there is none."""
    out = np.full((len(x), 3), np.nan)
    size = x.shape[1]
    flat = (x == x[:, :1]).all(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        power = np.abs(np.fft.rfft(x - x.mean(axis=1, keepdims=True), axis=1)[:, 1:]) ** 2 / size
        total = power.sum(axis=1)
        share = power / total[:, None]
        entropy = -(share * np.log2(share + 1e-12)).sum(axis=1)
    out[:, 0] = np.where(flat, 0.0, total)
    out[:, 1] = np.where(flat, np.nan, share.max(axis=1, initial=0))
    out[:, 2] = np.where(flat, 0.0, entropy)
    return out


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in SPECTRUM]))
def _spectrum(values: pd.Series) -> pd.DataFrame:
    """Power spectrum summary of a batch of complete windows (arrays of equal length, no missing value)."""
    x = np.stack(values.to_numpy()) if len(values) else np.empty((0, 1))
    return pd.DataFrame(_power_summary(x), columns=list(SPECTRUM))


def frequency_features(df: DataFrame, keys: Sequence[str], signals: Sequence[str], size: int = 60,
                       window: str = "window", position: str = "position") -> DataFrame:
    """Total power, dominant power ratio and spectral entropy per (window, signal), mean removed.

    The transform is one vectorised call per Arrow batch over arrays of ``size`` values. A missing value in a
    window gives three NULLs; a constant signal gives power 0, no ratio and entropy 0.
    """
    arrays = window_arrays(df, keys, signals, size, window, position)
    tall = arrays.unpivot([*keys, window], list(signals), "signal", "values")
    whole = ~F.exists("values", lambda x: x.isNull() | F.isnan(x))
    usable = tall.filter(whole).withColumn("s", _spectrum("values"))
    done = usable.select(*keys, window, "signal", *[_null_if_nan(F.col(f"s.{c}")).alias(c) for c in SPECTRUM])
    rest = tall.filter(~whole).select(
        *keys, window, "signal", *[F.lit(None).cast("double").alias(c) for c in SPECTRUM])
    return done.unionByName(rest)


KERNEL_WINDOWS = 1024  # windows whose arrays are worked on at once


def _one_signal(x: np.ndarray, valid: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """(values, whether NULL) of every statistic of one signal in some windows, by the rules of the aggregates."""
    n, size = valid.sum(axis=1), x.shape[1]
    mean = np.where(valid, x, 0).sum(axis=1) / np.maximum(n, 1)
    off = np.where(valid, x - mean[:, None], 0)
    std = np.sqrt((off * off).sum(axis=1) / np.maximum(n - 1, 1))
    least, most = np.where(valid, x, np.inf), np.where(valid, x, -np.inf)
    # NaN is greater than every number.
    least = np.where((np.isnan(x) | ~valid).all(axis=1), np.nan, np.fmin.reduce(least, axis=1))
    most = most.max(axis=1)
    t = np.arange(size) - (size - 1) / 2
    slope = (off * t).sum(axis=1) / max((t * t).sum(), 1e-300)
    same = (n >= 2) & ((least == most) | (np.isnan(least) & np.isnan(most)))
    return {"mean": (mean, n == 0), "std": (std, n < 2), "min": (least, n == 0), "max": (most, n == 0),
            "slope": (slope, (n < size) | (size < 2)), "constant": (same.astype(float), np.zeros(len(n), bool))}


def _two_signals(x: np.ndarray, y: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Correlation over complete pairs and whether it is NULL (either side constant)."""
    n = np.maximum(both.sum(axis=1), 1)
    varies, offs = np.ones(len(x), bool), []
    for z in (x, y):
        stats = _one_signal(z, both)
        (least, none), (most, _) = stats["min"], stats["max"]
        varies &= ~none & ((least < most) | (~np.isnan(least) & np.isnan(most)))
        offs.append(np.where(both, z - stats["mean"][0][:, None], 0))
    spread = np.sqrt((offs[0] ** 2).sum(axis=1) / n) * np.sqrt((offs[1] ** 2).sum(axis=1) / n)
    corr = (offs[0] * offs[1]).sum(axis=1) / n / np.where(spread == 0, 1, spread)
    return corr, ~varies | (spread == 0)


def window_kernel(df: DataFrame, keys: Sequence[str], signals: Sequence[str], actuators: Sequence[str] = (),
                  corr_signals: Sequence[str] = (), diff_pairs: Sequence[tuple[str, str]] = (), size: int = 60,
                  window: str = "window", position: str = "position") -> DataFrame:
    """``window_features`` and the pivoted ``frequency_features`` of all complete windows, from one gathering of the rows.

    A window's signals are gathered into arrays once; statistics, slopes, flags, correlations, differences and spectrum of
    a batch of windows then come from the same arrays, so there is neither a tall table nor a pivot nor a join. Missing
    values and NaN count as in the two operators; positions run from 0 to ``size`` - 1.
    """
    gathered = list(dict.fromkeys([*signals, *actuators, *corr_signals, *[c for p in diff_pairs for c in p]]))
    features = window_feature_names(signals, actuators, corr_signals, diff_pairs)
    names = [*features, *[f"{m}_{s}" for s in signals for m in SPECTRUM]]
    arrays = window_arrays(df, keys, gathered, size, window, position)
    schema = T.StructType([*[arrays.schema[k] for k in [*keys, window]], *[T.StructField(n, T.DoubleType()) for n in names]])
    ship_package(df.sparkSession)

    def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        flat = column.flatten()
        return (flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, size),
                flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, size))

    def computed(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = {c: matrix(batch.column(c)) for c in gathered}
        out = {}
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            differences = {f"{a}_{b}_diff": (data[a][0] - data[b][0], data[a][1] & data[b][1]) for a, b in diff_pairs}
            for s, (x, valid) in {**data, **differences}.items():
                out.update({f"{s}_{k}": v for k, v in _one_signal(x, valid).items()})
            for a, b in combinations(corr_signals, 2):
                (x, vx), (y, vy) = data[a], data[b]
                out[f"{a}_{b}_corr"] = _two_signals(x, y, vx & vy)
            for s in signals:
                x, valid = data[s]
                whole = valid.all(axis=1) & ~np.isnan(x).any(axis=1)
                power = np.full((len(x), 3), np.nan)
                power[whole] = _power_summary(x[whole])
                out.update({f"{m}_{s}": (power[:, i], np.isnan(power[:, i])) for i, m in enumerate(SPECTRUM)})
        columns = [pa.array(v, pa.float64(), mask=null, from_pandas=False) for v, null in (out[n] for n in names)]
        return pa.RecordBatch.from_arrays([*[batch.column(k) for k in [*keys, window]], *columns], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, KERNEL_WINDOWS):
                yield computed(batch.slice(begin, KERNEL_WINDOWS))

    return arrays.mapInArrow(run, schema)


def _null_if_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def pivot_frequency(long: DataFrame, keys: Sequence[str], signals: Sequence[str], window: str = "window") -> DataFrame:
    return pivot_wide(long, [*keys, window], "signal", signals, {m: m + "_{name}" for m in SPECTRUM})


def temporal_features(wide: DataFrame, keys: Sequence[str], features: Sequence[str], window: str = "window",
                      max_rows: int | None = None, large: LargeKeys | None = None) -> DataFrame:
    """Previous existing window's value and the change to it for every feature.

    All features travel as one struct, so there is a single lag per row whatever the number of features. ``large``
    (from the series the windows were cut from) spares counting windows per key.
    """
    packed = F.struct(*features)
    lagged = ordered_columns(wide, keys, [window], lags={"__prev": packed}, max_rows=max_rows, large=large)
    previous = {f"{f}_prev": F.col(f"__prev.{f}") for f in features}
    deltas = {f"{f}_delta": F.col(f) - F.col(f"__prev.{f}") for f in features}
    return lagged.select(*wide.columns, *[e.alias(n) for n, e in {**previous, **deltas}.items()])


def temporal_long(long: DataFrame, keys: Sequence[str], name: str = "feature", value: str = "value",
                  window: str = "window", max_rows: int | None = None) -> DataFrame:
    """The same on a tall feature table: the key grows by the feature name."""
    lagged = ordered_columns(long, [*keys, name], [window], lags={"prev": F.col(value)}, max_rows=max_rows)
    return lagged.withColumn("delta", F.col(value) - F.col("prev"))


def ml_features(temporal: DataFrame, frequency_wide: DataFrame, keys: Sequence[str],
                window: str = "window") -> DataFrame:
    """Temporal and frequency features of the windows present in both."""
    return join_null_safe(temporal, frequency_wide, [*keys, window], "inner")
