"""Contracts of the four feature tables with planted faults, and the way from series files to the checked ML table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seriesmith.functions.expressions import features_except, seconds_of_clock, seconds_to_time, split_identifier
from seriesmith.operators import contracts as ct
from seriesmith.operators import features as ft
from seriesmith.operators import joins, pipeline
from seriesmith.plans.bindings import FREQ_SQL, KEYS, PAIRS, SIGNALS, SIZE, windowed, windows_sql
from seriesmith.plans.registry import load, query, rounded
from seriesmith.plans.source_queries import LAYOUT, PLANT_SQL, layout_columns
from seriesmith.plans.window_queries import (
    FREQ_NAMES, TEMPORAL_NAMES, WIDE_CTE, WIDE_NAMES, _exact, _temporal_sql, ml_table, raw_window_vector,
    temporal_table, wide_features,
)
from seriesmith.session import scratch_path
from seriesmith.sources import files

META = ["entity", "window", "status", "target"]
WINDOW = ["entity", "window"]

# Numbers of features that 4 signals of 60 values give, as agreed beforehand: 4 x 60 raw values; 4 x (4 statistics, slope,
# constant), 6 correlations and 2 x 5 differences; three times as many with history; and 3 spectral values per signal.
EXPECTED = {"raw": 240, "window": 40, "temporal": 120, "ml": 132}


def with_faults(spark, sf_dir, features):
    """Features with metadata; every window 1 of entities 1, 8, 15, ... occurs twice, window 0 of 3, 14, ... has no status."""
    first = ft.window_metadata(windowed(spark, sf_dir), KEYS, ["status"], label="label", size=SIZE).drop("label")
    table = joins.checked_join(first, features, WINDOW, "inner", "one_to_one")
    e, w = F.col("entity"), F.col("window")
    lost = (e % 11 == 3) & (w == 0)
    twice = F.when((e % 7 == 1) & (w == 1), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return table.withColumn("status", F.when(~lost, F.col("status"))).withColumn("__copy", F.explode(twice)).drop("__copy")


def standing_rules(table, expected):
    """Rules of every feature table: one row per window, metadata and target present, the agreed features."""
    return [ct.unique(), *ct.not_null("status", "target"),
            ct.feature_count(features_except(table, META), expected)]


BASE_SQL = f"""WITH {windows_sql()},
f AS (SELECT entity, "window", position, CASE WHEN label = 0 THEN 0 WHEN label IN (2, 3) THEN 1 END AS target,
             CASE WHEN entity % 11 = 3 AND "window" = 0 THEN NULL ELSE status END AS status,
             min(quantity) OVER g AS quantity_min, max("window") OVER (PARTITION BY entity) AS last,
             last_value(tax) OVER (PARTITION BY entity, "window" ORDER BY position
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tax_59
      FROM w WINDOW g AS (PARTITION BY entity, "window")),
t AS (SELECT *, entity || '/' || "window" AS k FROM f, LATERAL (SELECT unnest(CASE WHEN entity % 7 = 1 AND "window" = 1
             THEN [0, 1] ELSE [0] END) AS copy) WHERE position = 0)"""


def rule_sql(name, bad):
    return f"""SELECT '{name}' AS rule, (SELECT count(*) FROM t) AS n_rows, count(*) AS violations,
       min(k) AS first_offender, max(k) AS last_offender FROM t WHERE {bad}"""


def contract_sql(difference, *more):
    lines = [
        rule_sql("unique", "copy = 1"), rule_sql("not_null status", "status IS NULL"),
        rule_sql("not_null target", "target IS NULL"),
        f"SELECT 'feature_count', (SELECT count(*) FROM t), CAST({difference} AS BIGINT), NULL, NULL", *more]
    return BASE_SQL + "\n" + "\nUNION ALL ".join(lines)


def once_sql(name, bad):
    """Entities in place of windows."""
    return f"""SELECT '{name}', (SELECT count(*) FROM t), count(*), min(k), max(k)
FROM (SELECT DISTINCT CAST(entity AS VARCHAR) AS k FROM t WHERE {bad})"""


@query("raw_contract", contract_sql(0, rule_sql("in_range tax_59", "tax_59 NOT BETWEEN 0.01 AND 0.07"),
                                    rule_sql("finite", "false")))
def raw_contract(spark, sf_dir):
    """Raw windows: 240 cells, all finite."""
    table = with_faults(spark, sf_dir, raw_window_vector(spark, sf_dir))
    cells = features_except(table, META)
    rules = [*standing_rules(table, EXPECTED["raw"]), ct.in_range("tax_59", 0.01, 0.07), ct.finite(cells)]
    return ct.check(table, WINDOW, rules)


@query("window_contract", contract_sql(
    0, rule_sql("in_range quantity_min", "quantity_min NOT BETWEEN 2 AND 50"),
    rule_sql("references entity", "entity NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 17 <> 4)")))
def window_contract(spark, sf_dir):
    """Window features; the suppliers 4, 21, 38, ... are unknown."""
    table = with_faults(spark, sf_dir, wide_features(spark, sf_dir))
    known = load(spark, sf_dir, "supplier").filter("s_suppkey % 17 <> 4").select(F.col("s_suppkey").alias("entity"))
    rules = [*standing_rules(table, EXPECTED["window"]), ct.in_range("quantity_min", 2, 50),
             ct.references(["entity"], known)]
    return ct.check(table, WINDOW, rules)


def history_rules(names):
    empty = [F.col(f"{n}_{s}").isNull() for n in names for s in ("prev", "delta")]
    none = F.forall(F.array(*empty), lambda x: x)
    return [ct.once_per(KEYS, "one first window", none), ct.holds("first window first", none == (F.col("window") == 0))]


@query("temporal_contract", contract_sql(
    1, once_sql("one first window", "(entity % 10 = 0 AND last >= 1) OR entity % 10 = 1"),
    rule_sql("first window first", "(entity % 10 = 0 AND \"window\" = 1) OR (entity % 10 = 1 AND \"window\" = 0)")))
def temporal_contract(spark, sf_dir):
    """Features with history: one feature is missing, some second windows have no history and some first ones do."""
    e, w = F.col("entity") % 10, F.col("window")
    history = [n for n in TEMPORAL_NAMES if n.endswith(("_prev", "_delta"))]
    temporal = temporal_table(spark, sf_dir)
    broken = temporal.withColumns({c: F.when((e == 0) & (w == 1), F.lit(None)).when((e == 1) & (w == 0), F.lit(1.0))
                                   .otherwise(F.col(c)) for c in history}).drop("tax_constant")
    table = with_faults(spark, sf_dir, broken)
    return ct.check(table, WINDOW, [*standing_rules(table, EXPECTED["temporal"]), *history_rules(WIDE_NAMES)])


@query("ml_contract", contract_sql(
    0, "SELECT 'frequency_count', (SELECT count(*) FROM t), CAST(0 AS BIGINT), NULL, NULL",
    rule_sql("finite frequency", "entity % 13 = 4 AND \"window\" = 0"), once_sql("one first window", "false"),
    rule_sql("first window first", "false")))
def ml_contract(spark, sf_dir):
    """The ML table: 132 features, 12 of them spectral; the power of some first windows is infinite."""
    e, w = F.col("entity"), F.col("window")
    ml = ml_table(spark, sf_dir)
    endless = F.when((e % 13 == 4) & (w == 0), float("inf")).otherwise(F.col("total_power_tax"))
    table = with_faults(spark, sf_dir, ml.withColumn("total_power_tax", endless))
    spectral = [c for c in features_except(table, META) if c.startswith(tuple(ft.SPECTRUM))]
    rules = [*standing_rules(table, EXPECTED["ml"]), ct.feature_count(spectral, 12, "frequency_count"),
             ct.finite(spectral, "finite frequency"), *history_rules(WIDE_NAMES)]
    return ct.check(table, WINDOW, rules)


# One row a second per series; until row 130 the clock runs 50,000 seconds or more ahead, then it is set back.
RUN_SQL = f"""{PLANT_SQL},
rn AS (SELECT *, concat_ws('/', phase, batch, operating_point, experiment_type, experiment) AS entity,
              row_number() OVER (PARTITION BY phase, batch, operating_point, experiment_type, experiment
                                 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS r FROM pl),
s AS (SELECT *, CASE WHEN r < 130 THEN r ELSE r - 1 END AS elapsed FROM rn WHERE phase = 'Operation'),
wa AS (SELECT *, CAST(elapsed // 60 AS INTEGER) AS "window", row_number() OVER (PARTITION BY entity, elapsed // 60 ORDER BY r) - 1 AS position,
              count(*) OVER (PARTITION BY entity, elapsed // 60) AS n FROM s),
w AS (SELECT *, l_quantity AS quantity, l_extendedprice / 1000 AS price, l_discount AS discount, l_tax AS tax,
             CASE WHEN l_linenumber = 7 THEN 0 ELSE l_linenumber % 4 END AS label FROM wa WHERE n = 60),
l AS (SELECT entity, "window", position, 'quantity' AS signal, quantity AS v FROM w
      UNION ALL SELECT entity, "window", position, 'price', price FROM w
      UNION ALL SELECT entity, "window", position, 'discount', discount FROM w
      UNION ALL SELECT entity, "window", position, 'tax', tax FROM w)"""


def write_plant(spark, sf_dir, root):
    """Labels, sensors and actuators of every series as files, rows in the order they were measured.

    Rows of line number 7 have no label. The files are joined by time, so no time may occur twice in a series: hours go on
    beyond 23, and in a series of more than 50,000 rows the clock first runs ahead by its length.
    """
    items = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                                                   "l_discount", "l_tax", "l_extendedprice", "l_quantity",
                                                   "l_returnflag", "l_linestatus")
    rows = items.withColumns(layout_columns())
    order = Window.partitionBy(*LAYOUT).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"r": F.row_number().over(order) - 1,
                             "ahead": F.greatest(F.lit(50000), F.count("*").over(whole))})
    clock = F.when(F.col("r") < 130, F.col("r") + F.col("ahead")).otherwise(F.col("r"))
    rows = rows.withColumn("Time", seconds_to_time(clock))
    kinds = {
        "labels": rows.filter("l_linenumber <> 7").withColumn("Label (anomaly)", F.col("l_linenumber") % 4),
        "sensors": rows.withColumnsRenamed({"l_quantity": "quantity", "l_extendedprice": "price"}),
        "actuators": rows.withColumnsRenamed({"l_discount": "discount", "l_tax": "tax"}),
    }
    columns = {"labels": ["Label (anomaly)"], "sensors": ["quantity", "price"], "actuators": ["discount", "tax"]}
    for name, table in kinds.items():
        files.write_series(table.select("Time", *columns[name], "r", *LAYOUT), f"{root}/{files.MODALITIES[name]}", LAYOUT,
                           order=["r"])


PLANT_META = ["batch", "operating_point", "experiment_type", "experiment"]


@query("plant_to_ml", f"""{_exact(WIDE_CTE.replace(windows_sql(), RUN_SQL))}, {_temporal_sql(WIDE_NAMES)}, {FREQ_SQL},
fw AS (SELECT entity, "window",
  {", ".join(f"max({m}) FILTER (signal = '{s}') AS {m}_{s}" for s in SIGNALS for m in ft.SPECTRUM)}
  FROM fr GROUP BY entity, "window"),
m AS (SELECT DISTINCT entity, "window", batch, operating_point, experiment_type, experiment,
             CASE first_value(label) OVER (PARTITION BY entity, "window" ORDER BY position) WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 1 END
               AS target FROM w)
SELECT tmp.* EXCLUDE (entity), tmp.entity AS identifier, {", ".join(f"fw.{n}" for n in FREQ_NAMES)}, m.batch, m.operating_point,
       m.experiment_type, m.experiment, m.target
FROM tmp JOIN fw ON tmp.entity = fw.entity AND tmp."window" = fw."window"
JOIN m ON m.entity = tmp.entity AND m."window" = tmp."window" """)
def plant_to_ml(spark, sf_dir):
    """Series files of three kinds to the ML table: read, joined, clocked in file order, repaired, windowed, featurised.

    The table is written down, held against its contract there and only then handed on.
    """
    root = scratch_path(spark, "plant")
    write_plant(spark, sf_dir, root)
    joined = pipeline.join_in_file_order(files.read_modalities(spark, root), seconds_of_clock(F.col("Time")), F.lit(True))
    ml = pipeline.ml_table(split_identifier(joined), SIGNALS, actuators=SIGNALS, corr_signals=SIGNALS, pairs=PAIRS,
                           large=["price"], metadata=PLANT_META, size=SIZE)
    path = scratch_path(spark, "ml")
    files.write_table(ml, path)
    table = files.read_table(spark, path)
    names = features_except(table, ["identifier", "window", "target", *PLANT_META])
    ct.enforce(ct.check(table, ["identifier", "window"], [
        ct.unique(), *ct.not_null(*PLANT_META), ct.feature_count(names, EXPECTED["ml"]), ct.finite(names),
        ct.once_per(["identifier"], "one first window",
                    F.forall(F.array(*[F.col(f"{n}_prev").isNull() for n in WIDE_NAMES]), lambda x: x))]))
    coarse = ["total_power_quantity", "total_power_price"]
    out = rounded(rounded(table, 7, *TEMPORAL_NAMES), 5, *coarse)
    return rounded(out, 8, *[n for n in FREQ_NAMES if n not in coarse])
