"""Window statistics, raw vectors, temporal and frequency features over the line-item series."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmith.operators import features as ft
from seriesmith.plans.bindings import (
    CORR_SQL, DIFF_SQL, FREQ_SQL, KEYS, PAIRS, SIGNALS, SIZE, STATS_SQL, large_by_windows, windowed, windows_sql,
)
from seriesmith.plans.registry import query, rounded

STAT_COLUMNS = ["mean", "std", "slope"]


@query("window_stats", f"""
WITH {windows_sql()}, {STATS_SQL}
SELECT entity, "window", signal, mean, std, min, max, slope FROM st""")
def window_stats(spark, sf_dir):
    return rounded(ft.window_stats(windowed(spark, sf_dir), KEYS, SIGNALS, SIZE), 7, *STAT_COLUMNS)


@query("window_constants", f"""
WITH {windows_sql(3)}
SELECT entity, "window", signal, CAST(CASE WHEN min(v) = max(v) THEN 1 ELSE 0 END AS TINYINT) AS constant
FROM l GROUP BY entity, "window", signal""")
def window_constants(spark, sf_dir):
    return ft.window_constants(windowed(spark, sf_dir, 3), KEYS, SIGNALS, 3)


@query("window_correlations", f"""
WITH {windows_sql()}, {CORR_SQL} SELECT entity, "window", pair, corr FROM co""")
def window_correlations(spark, sf_dir):
    return rounded(ft.window_correlations(windowed(spark, sf_dir), KEYS, SIGNALS, SIZE), 7, "corr")


@query("difference_features", f"""
WITH {windows_sql()}, {DIFF_SQL} SELECT entity, "window", signal, mean, std, min, max, slope FROM ds""")
def difference_features(spark, sf_dir):
    out = ft.difference_features(windowed(spark, sf_dir), KEYS, PAIRS, SIZE)
    return rounded(out, 7, *STAT_COLUMNS, "min", "max")


def wide_features(spark, sf_dir):
    return ft.window_features(windowed(spark, sf_dir), KEYS, SIGNALS, SIGNALS, SIGNALS, PAIRS, SIZE)


WIDE_NAMES = ft.window_feature_names(SIGNALS, SIGNALS, SIGNALS, PAIRS)

# The wide table in SQL: one conditional maximum per feature over the tall blocks.
WIDE_CTE = f"""
WITH {windows_sql()}, {STATS_SQL}, {CORR_SQL}, {DIFF_SQL},
cn AS (SELECT entity, "window", signal, CASE WHEN min(v) = max(v) THEN 1.0 ELSE 0.0 END AS constant
       FROM l GROUP BY entity, "window", signal),
sb AS (SELECT * FROM st UNION ALL BY NAME SELECT * FROM ds),
tall AS (
  SELECT entity, "window", signal || '_mean' AS feature, round(mean, 7) + 0.0 AS v FROM sb
  UNION ALL SELECT entity, "window", signal || '_std', std FROM sb
  UNION ALL SELECT entity, "window", signal || '_min', round(min, 7) + 0.0 FROM sb
  UNION ALL SELECT entity, "window", signal || '_max', round(max, 7) + 0.0 FROM sb
  UNION ALL SELECT entity, "window", signal || '_slope', slope FROM sb
  UNION ALL SELECT entity, "window", signal || '_constant', CAST(constant AS DOUBLE) FROM cn
  UNION ALL SELECT entity, "window", pair || '_corr', corr FROM co),
wide AS (SELECT entity, "window", {", ".join(f"max(v) FILTER (feature = '{n}') AS {n}" for n in WIDE_NAMES)}
         FROM tall GROUP BY entity, "window")"""


@query("window_features_wide", f"{WIDE_CTE} SELECT * FROM wide")
def window_features_wide(spark, sf_dir):
    return rounded(wide_features(spark, sf_dir), 7, *WIDE_NAMES)


RAW_CELLS = [(s, i, f"{s}_{i:02d}") for s in SIGNALS for i in range(SIZE)]


@query("raw_window_vector", f"""
WITH {windows_sql()}
SELECT entity, "window", {", ".join(f"max({s}) FILTER (position = {i}) AS {n}" for s, i, n in RAW_CELLS)}
FROM w GROUP BY entity, "window" """)
def raw_window_vector(spark, sf_dir):
    return ft.raw_windows(complete(spark, sf_dir), KEYS, SIGNALS, SIZE)


def complete(spark, sf_dir, size=SIZE):
    return windowed(spark, sf_dir, size).filter(F.col("window_rows") == size)


@query("raw_window_unflatten", f"""
WITH {windows_sql()} SELECT entity, "window", signal, CAST(position AS INTEGER) AS position, v AS value FROM l""")
def raw_window_unflatten(spark, sf_dir):
    return ft.unflatten_window(raw_window_vector(spark, sf_dir), KEYS)


@query("window_metadata", f"""
WITH {windows_sql()}
SELECT entity, "window", status, shipdate, label, CASE WHEN label = 0 THEN 0 WHEN label IN (2, 3) THEN 1 END AS target
FROM w WHERE position = 0""")
def window_metadata(spark, sf_dir):
    return ft.window_metadata(windowed(spark, sf_dir), KEYS, ["status", "shipdate"], label="label", size=SIZE)


def _temporal_sql(names):
    lagged = ", ".join(f"lag({n}) OVER e AS {n}_prev" for n in names)
    deltas = ", ".join(f"round({n} - {n}_prev, 7) + 0.0 AS {n}_delta" for n in names)
    rounds = ", ".join(f"round({n}, 7) + 0.0 AS {n}, round({n}_prev, 7) + 0.0 AS {n}_prev" for n in names)
    return f"""lg AS (SELECT *, {lagged} FROM wide WINDOW e AS (PARTITION BY entity ORDER BY "window")),
tmp AS (SELECT entity, "window", {rounds}, {deltas} FROM lg)"""


TEMPORAL_NAMES = [*WIDE_NAMES, *[f"{n}_prev" for n in WIDE_NAMES], *[f"{n}_delta" for n in WIDE_NAMES]]


def _exact(sql):
    """Drop every round(x, 7) of the shared blocks."""
    import re

    while True:
        new = re.sub(r"round\(((?:[^()]|\([^()]*\))*), 7\)", r"(\1)", sql)
        if new == sql:
            return sql
        sql = new


@query("temporal_features", f"{_exact(WIDE_CTE)}, {_temporal_sql(WIDE_NAMES)} SELECT * FROM tmp")
def temporal_features(spark, sf_dir):
    return rounded(temporal_table(spark, sf_dir), 7, *TEMPORAL_NAMES)


def temporal_table(spark, sf_dir, names=WIDE_NAMES):
    wide = wide_features(spark, sf_dir).select(*KEYS, "window", *names)
    return ft.temporal_features(wide, KEYS, names, large=large_by_windows(spark, sf_dir))


@query("temporal_long", f"""
WITH {windows_sql()}, {_exact(STATS_SQL)},
g AS (SELECT entity, "window", signal, mean, lag(mean) OVER (PARTITION BY entity, signal ORDER BY "window") AS prev
      FROM st)
SELECT entity, "window", signal, round(mean, 7) + 0.0 AS mean, round(prev, 7) + 0.0 AS prev,
       round(mean - prev, 7) + 0.0 AS delta FROM g""")
def temporal_long(spark, sf_dir):
    stats = ft.window_stats(windowed(spark, sf_dir), KEYS, SIGNALS, SIZE).select("entity", "window", "signal", "mean")
    return rounded(ft.temporal_long(stats, KEYS, "signal", "mean"), 7, "mean", "prev", "delta")


@query("frequency_features", f"""
WITH {windows_sql()}, {FREQ_SQL}
SELECT entity, "window", signal, total_power, dominant_power_ratio, spectral_entropy FROM fr""")
def frequency_features(spark, sf_dir):
    out = ft.frequency_features(complete(spark, sf_dir), KEYS, SIGNALS, SIZE)
    # Digits by the size of the signal: the power of quantity and price is about a million times larger.
    power, fine = F.col("total_power"), F.col("signal").isin("discount", "tax")
    out = out.withColumn("total_power", F.when(fine, F.round(power, 8)).otherwise(F.round(power, 5)) + F.lit(0.0))
    return rounded(out, 8, "dominant_power_ratio", "spectral_entropy")


FREQ_NAMES = [f"{m}_{s}" for s in SIGNALS for m in ft.SPECTRUM]


@query("ml_features", f"""{_exact(WIDE_CTE)}, {_temporal_sql(WIDE_NAMES)}, {FREQ_SQL},
fw AS (SELECT entity, "window",
  {", ".join(f"max({m}) FILTER (signal = '{s}') AS {m}_{s}" for s in SIGNALS for m in ft.SPECTRUM)}
  FROM fr GROUP BY entity, "window")
SELECT tmp.*, {", ".join(f"fw.{n}" for n in FREQ_NAMES)}
FROM tmp JOIN fw ON tmp.entity = fw.entity AND tmp."window" = fw."window" """)
def ml_features(spark, sf_dir):
    coarse = ["total_power_quantity", "total_power_price"]
    out = rounded(rounded(ml_table(spark, sf_dir), 7, *TEMPORAL_NAMES), 5, *coarse)
    return rounded(out, 8, *[n for n in FREQ_NAMES if n not in coarse])


def ml_table(spark, sf_dir):
    wide = ft.window_kernel(complete(spark, sf_dir), KEYS, SIGNALS, SIGNALS, SIGNALS, PAIRS, SIZE)
    out = ft.temporal_features(wide, KEYS, WIDE_NAMES, large=large_by_windows(spark, sf_dir))
    return out.select(*[c for c in out.columns if c not in FREQ_NAMES], *FREQ_NAMES)


@query("window_list", f"""
WITH {windows_sql()} SELECT DISTINCT entity, "window" FROM w""")
def window_list(spark, sf_dir):
    return ft.window_list(complete(spark, sf_dir), KEYS)
