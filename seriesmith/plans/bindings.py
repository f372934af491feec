"""Stand-ins for plant series on the driver tables, in DataFrame and in SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmith.operators.ordered import LargeKeys, find_large_keys
from seriesmith.operators.series import position_windows
from seriesmith.plans.registry import load

KEYS = ["entity"]
ORDER = ["shipdate", "orderkey", "linenumber", "partkey"]
SIGNALS = ["quantity", "price", "discount", "tax"]
PAIRS = [("quantity", "price"), ("discount", "tax")]
SIZE = 60


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One measured row per line item: entity is the supplier, price in thousands, label from the return flag."""
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("entity"),
        F.col("l_shipdate").alias("shipdate"),
        F.col("l_orderkey").alias("orderkey"),
        F.col("l_linenumber").alias("linenumber"),
        F.col("l_partkey").alias("partkey"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / 1000).alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1)
        .when(F.col("l_returnflag") == "R", 2).alias("label"),
        F.col("l_linestatus").alias("status"),
    )


def windowed(spark: SparkSession, sf_dir: str, size: int = SIZE) -> DataFrame:
    return position_windows(series(spark, sf_dir), KEYS, ORDER, size)


def large_by_windows(spark: SparkSession, sf_dir: str, size: int = SIZE) -> LargeKeys:
    """Entities with too many windows for one task, from the row counts."""
    return find_large_keys(series(spark, sf_dir), KEYS, weight=F.lit(1.0 / size))


SERIES_SQL = """
s AS (
  SELECT l_suppkey AS entity, l_shipdate AS shipdate, l_orderkey AS orderkey, l_linenumber AS linenumber,
         l_partkey AS partkey, l_quantity AS quantity, l_extendedprice / 1000 AS price, l_discount AS discount,
         l_tax AS tax, CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 WHEN 'R' THEN 2 END AS label,
         l_linestatus AS status,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS rn
  FROM lineitem)"""


def windows_sql(size: int = SIZE) -> str:
    return f"""{SERIES_SQL},
wa AS (SELECT *, CAST(rn // {size} AS INTEGER) AS "window", rn % {size} AS position,
              count(*) OVER (PARTITION BY entity, rn // {size}) AS n FROM s),
w AS (SELECT * FROM wa WHERE n = {size}),
l AS (SELECT entity, "window", position, 'quantity' AS signal, quantity AS v FROM w
      UNION ALL SELECT entity, "window", position, 'price', price FROM w
      UNION ALL SELECT entity, "window", position, 'discount', discount FROM w
      UNION ALL SELECT entity, "window", position, 'tax', tax FROM w)"""


STATS_SQL = """
st AS (
  SELECT entity, "window", signal, round(avg(v), 7) + 0.0 AS mean, round(stddev_samp(v), 7) + 0.0 AS std,
         min(v) AS min, max(v) AS max, round(regr_slope(v, position), 7) + 0.0 AS slope
  FROM l GROUP BY entity, "window", signal)"""

CORR_SQL = """
p AS (SELECT entity, "window", 'quantity_price' AS pair, quantity AS x, price AS y FROM w
      UNION ALL SELECT entity, "window", 'quantity_discount', quantity, discount FROM w
      UNION ALL SELECT entity, "window", 'quantity_tax', quantity, tax FROM w
      UNION ALL SELECT entity, "window", 'price_discount', price, discount FROM w
      UNION ALL SELECT entity, "window", 'price_tax', price, tax FROM w
      UNION ALL SELECT entity, "window", 'discount_tax', discount, tax FROM w),
co AS (SELECT entity, "window", pair,
              CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN round(corr(x, y), 7) + 0.0 END AS corr
       FROM p GROUP BY entity, "window", pair)"""

DIFF_SQL = """
dl AS (SELECT entity, "window", position, 'quantity_price_diff' AS signal, quantity - price AS v FROM w
       UNION ALL SELECT entity, "window", position, 'discount_tax_diff', discount - tax FROM w),
ds AS (SELECT entity, "window", signal, round(avg(v), 7) + 0.0 AS mean, round(stddev_samp(v), 7) + 0.0 AS std,
              round(min(v), 7) + 0.0 AS min, round(max(v), 7) + 0.0 AS max,
              round(regr_slope(v, position), 7) + 0.0 AS slope
       FROM dl GROUP BY entity, "window", signal)"""

FREQ_SQL = """
cen AS (SELECT entity, "window", signal, position, v - avg(v) OVER (PARTITION BY entity, "window", signal) AS v,
               min(v) OVER (PARTITION BY entity, "window", signal) AS lo,
               max(v) OVER (PARTITION BY entity, "window", signal) AS hi FROM l),
pk AS (SELECT entity, "window", signal, k, any_value(lo) AS lo, any_value(hi) AS hi,
              (pow(sum(v * cos(2 * pi() * k * position / 60)), 2)
               + pow(sum(v * sin(2 * pi() * k * position / 60)), 2)) / 60 AS power
       FROM cen, range(1, 31) AS r(k) GROUP BY entity, "window", signal, k),
tp AS (SELECT *, sum(power) OVER (PARTITION BY entity, "window", signal) AS total FROM pk),
fr AS (SELECT entity, "window", signal,
              CASE WHEN any_value(lo) = any_value(hi) THEN 0.0 WHEN signal IN ('discount', 'tax') THEN round(sum(power), 8) + 0.0
                   ELSE round(sum(power), 5) + 0.0 END AS total_power,
              CASE WHEN any_value(lo) < any_value(hi) THEN round(max(power / total), 8) + 0.0 END
                AS dominant_power_ratio,
              CASE WHEN any_value(lo) = any_value(hi) THEN 0.0
                   ELSE round(-sum(power / total * log2(power / total + 1e-12)), 8) + 0.0 END AS spectral_entropy
       FROM tp GROUP BY entity, "window", signal)"""
