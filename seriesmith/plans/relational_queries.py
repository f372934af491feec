"""Row repair, lookups, set operations and reports over the relational driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmith.functions import expressions as ex
from seriesmith.operators import cleaning, joins, model_grid, series
from seriesmith.plans.registry import load, query, rounded
from seriesmith.sources.nested import extra_fields

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query("scale_repair", f"""
SELECT {LINE_SQL}, CASE WHEN l_extendedprice > 500 THEN l_extendedprice / 1000 ELSE l_extendedprice END AS l_extendedprice,
       CASE WHEN l_quantity - 25 > 1 THEN (l_quantity - 25) / 1000 ELSE l_quantity - 25 END AS shifted,
       CASE WHEN abs(l_quantity - 25) > 1 THEN (l_quantity - 25) / 1000 ELSE l_quantity - 25 END AS shifted_abs
FROM lineitem""")
def scale_repair(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem").select(
        *LINE, "l_extendedprice", (F.col("l_quantity") - 25).alias("shifted"),
        (F.col("l_quantity") - 25).alias("shifted_abs"))
    plain = cleaning.repair_scales(df, {"l_extendedprice": 500, "shifted": 1})
    return cleaning.repair_scales(plain, {"shifted_abs": 1}, use_abs=True)


@query("unit_convert", f"""
SELECT {LINE_SQL}, l_discount / 100 * 350 AS l_discount, l_tax / 100 * 150 AS l_tax FROM lineitem""")
def unit_convert(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem").select(*LINE, "l_discount", "l_tax")
    return cleaning.convert_units(df, {"l_discount": 350.0, "l_tax": 150.0})


@query("floor_columns", f"""
SELECT {LINE_SQL}, CAST(floor(l_extendedprice) AS DOUBLE) AS l_extendedprice, CAST(floor(l_tax * 10) AS DOUBLE) AS l_tax
FROM lineitem""")
def floor_columns(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem").select(*LINE, "l_extendedprice", (F.col("l_tax") * 10).alias("l_tax"))
    return cleaning.floor_columns(df, ["l_extendedprice", "l_tax"])


@query("pair_differences", f"""
SELECT {LINE_SQL}, l_discount - l_tax AS l_discount_l_tax_diff, l_quantity - l_linenumber AS l_quantity_l_linenumber_diff
FROM lineitem""")
def pair_differences(spark, sf_dir):
    pairs = [("l_discount", "l_tax"), ("l_quantity", "l_linenumber")]
    df = load(spark, sf_dir, "lineitem")
    return df.select(*LINE, *[e.alias(n) for n, e in ex.pair_differences(pairs).items()])


@query("regex_match_join", r"""
WITH k AS (SELECT DISTINCT lower(p_type) || '' AS key FROM part
           UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part
           UNION SELECT DISTINCT upper(p_name) FROM part),
t AS (SELECT p_partkey, p_name || ' (' || p_type || ')' AS title FROM part)
SELECT key, arg_min(title, p_partkey) AS title, min(p_partkey) AS p_partkey
FROM k JOIN t ON regexp_matches(title, '(?i)\b' || key || '\b') GROUP BY key""")
def regex_match_join(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    words = [F.lower("p_type"), F.split_part(F.col("p_name"), F.lit(" "), F.lit(2)), F.upper("p_name")]
    keys = part.select(F.explode(F.array(*words)).alias("key")).distinct()
    titles = part.select("p_partkey", F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")).alias("title"))
    return joins.match_word(keys, titles, "key", "title", "p_partkey")


@query("uncertainty", f"""
WITH sp AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'Pt100 class 1/3' WHEN 1 THEN 'Pt100 class A'
              WHEN 2 THEN 'Pt100 class B' ELSE 'flow' END AS kind,
              CASE p_partkey % 5 WHEN 0 THEN '-' WHEN 1 THEN 'abc' ELSE CAST(p_size AS VARCHAR) END AS pct
            FROM part WHERE p_partkey % 11 <> 3)
SELECT {LINE_SQL}, round(CASE WHEN kind IS NULL THEN NULL
         WHEN kind = 'Pt100 class 1/3' THEN 0.10 + 0.0017 * abs(l_quantity)
         WHEN kind = 'Pt100 class A' THEN 0.15 + 0.002 * abs(l_quantity)
         WHEN kind = 'Pt100 class B' THEN 0.30 + 0.005 * abs(l_quantity)
         ELSE coalesce(TRY_CAST(pct AS DOUBLE) * 0.01 * abs(l_quantity), 0.0) END, 6) AS uncertainty
FROM lineitem LEFT JOIN sp ON l_partkey = p_partkey""")
def uncertainty(spark, sf_dir):
    """Sensor class and percentage come from a specification table; the join side is left to the optimizer."""
    k = F.col("p_partkey")
    spec = load(spark, sf_dir, "part").filter(k % 11 != 3).select(
        k.alias("l_partkey"),
        F.when(k % 7 == 0, "Pt100 class 1/3").when(k % 7 == 1, "Pt100 class A").when(k % 7 == 2, "Pt100 class B")
        .otherwise("flow").alias("kind"),
        F.when(k % 5 == 0, "-").when(k % 5 == 1, "abc").otherwise(F.col("p_size").cast("string")).alias("percent"))
    df = load(spark, sf_dir, "lineitem").select(*LINE, "l_quantity").join(spec, "l_partkey", "left")
    out = df.withColumn("uncertainty", ex.uncertainty(F.col("kind"), F.col("percent"), F.col("l_quantity")))
    return rounded(out.select(*LINE, "uncertainty"), 6, "uncertainty")


@query("equipment_attributes", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_type AS kind, CAST(p_size AS DOUBLE) AS percent
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand NOT IN ('Brand#1', 'Brand#2')""")
def equipment_attributes(spark, sf_dir):
    """Attributes kept as nested JSON per equipment item, read out and attached; excluded makes left out."""
    def value(c):
        return F.struct(F.col(c).cast("string").alias("value"))

    part = joins.exclude(load(spark, sf_dir, "part"), "p_brand", ["Brand#1", "Brand#2"])
    text = F.to_json(F.struct(F.struct(value("p_type").alias("Sensor Type"), value("p_size").alias("Uncertainty Estimation"))
                              .alias("extra_fields")))
    spec = extra_fields(part.select(F.col("p_partkey").alias("l_partkey"), text.alias("metadata")), "metadata",
                        {"kind": "Sensor Type", "percent": "Uncertainty Estimation"})
    spec = spec.select("l_partkey", "kind", F.col("percent").try_cast("double").alias("percent"))
    return load(spark, sf_dir, "lineitem").select(*LINE).join(spec, "l_partkey")


@query("multi_source_left_join", """
WITH a AS (SELECT l_orderkey AS identifier, l_linenumber AS "Time", l_quantity AS act FROM lineitem),
l AS (SELECT l_orderkey AS identifier, l_linenumber AS "Time", CASE l_returnflag WHEN 'A' THEN 1 ELSE 2 END AS lab
      FROM lineitem WHERE l_returnflag <> 'N'),
s AS (SELECT o_orderkey AS identifier, CAST(1 AS INTEGER) AS "Time", o_totalprice AS sensor FROM orders)
SELECT identifier, "Time", act, coalesce(lab, 0) AS anomaly_label, sensor
FROM a LEFT JOIN l USING (identifier, "Time") LEFT JOIN s USING (identifier, "Time")""")
def multi_source_left_join(spark, sf_dir):
    """Three modalities on (identifier, Time); repeated times fan out, unlabelled rows get 0."""
    line = load(spark, sf_dir, "lineitem").withColumnsRenamed({"l_orderkey": "identifier", "l_linenumber": "Time"})
    actuators = line.select("identifier", "Time", F.col("l_quantity").alias("act"))
    labels = line.filter("l_returnflag <> 'N'").select(
        "identifier", "Time", F.when(F.col("l_returnflag") == "A", 1).otherwise(2).alias("Label (anomaly)"))
    sensors = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("identifier"), F.lit(1).alias("Time"), F.col("o_totalprice").alias("sensor"))
    return series.join_modalities(actuators, labels, sensors)


@query("inner_join_modalities", """
SELECT o_orderkey, l_linenumber, o_totalprice, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def inner_join_modalities(spark, sf_dir):
    line = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(line, "o_orderkey")


@query("checked_join", """
SELECT l_orderkey, l_linenumber, l_partkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey""")
def checked_join(spark, sf_dir):
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    line = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return joins.checked_join(line, part, ["l_partkey"], "inner", "many_to_one")


LOOKUP_SQL = """
e AS (SELECT s_suppkey AS identifier, CASE WHEN s_acctbal < 3000 THEN 'train_normal' ELSE 'test_anormal' END AS experiment_type,
             CASE WHEN s_acctbal < 5000 THEN 0 WHEN s_acctbal < 6000 THEN NULL ELSE 1 END AS observable_anomaly FROM supplier),
t AS (SELECT s_suppkey AS identifier, CASE s_suppkey % 4 WHEN 0 THEN 'validation' WHEN 1 THEN 'final_test' ELSE 'excluded' END AS split
      FROM supplier WHERE s_suppkey % 3 <> 0),
x AS (SELECT e.*, coalesce(t.split, CASE WHEN experiment_type = 'train_normal' THEN 'train' END) AS split
      FROM e LEFT JOIN t USING (identifier))"""


def _lookup(spark, sf_dir):
    key, bal = F.col("s_suppkey"), F.col("s_acctbal")
    supplier = load(spark, sf_dir, "supplier")
    known = supplier.select(
        key.alias("identifier"), F.when(bal < 3000, "train_normal").otherwise("test_anormal").alias("experiment_type"),
        F.when(bal < 5000, 0).when(bal < 6000, None).otherwise(1).alias("observable_anomaly"))
    table = supplier.filter(key % 3 != 0).select(
        key.alias("identifier"),
        F.when(key % 4 == 0, "validation").when(key % 4 == 1, "final_test").otherwise("excluded").alias("split"))
    return joins.assign_split(known, table)


@query("lookup_split", f"WITH {LOOKUP_SQL} SELECT * FROM x")
def lookup_split(spark, sf_dir):
    return _lookup(spark, sf_dir)


@query("model_datasets", f"""
WITH {LOOKUP_SQL}
SELECT 'train' AS dataset, identifier, observable_anomaly FROM x WHERE split = 'train' AND observable_anomaly = 0
UNION ALL SELECT split, identifier, observable_anomaly FROM x
WHERE split IN ('validation', 'final_test') AND observable_anomaly IS NOT NULL""")
def model_datasets(spark, sf_dir):
    parts = joins.model_datasets(_lookup(spark, sf_dir))
    return joins.union_all([df.select(F.lit(n).alias("dataset"), "identifier", "observable_anomaly")
                            for n, df in parts.items()])


@query("incremental_anti_join", """
SELECT c_custkey, c_name FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
  AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""")
def incremental_anti_join(spark, sf_dir):
    """Inputs without a finished result that have their partner."""
    orders = load(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return joins.pending_inputs(load(spark, sf_dir, "customer").select("c_custkey", "c_name"),
                                orders.filter("o_orderstatus = 'F'"), orders.filter("o_orderstatus = 'O'"), "c_custkey")


@query("key_difference", """
SELECT o_custkey AS k, 'right' AS missing_in FROM (SELECT o_custkey FROM orders EXCEPT SELECT user_id FROM events)
UNION ALL SELECT user_id, 'left' FROM (SELECT user_id FROM events EXCEPT SELECT o_custkey FROM orders)""")
def key_difference(spark, sf_dir):
    return joins.key_difference(load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")),
                                load(spark, sf_dir, "events").select(F.col("user_id").alias("k")), ["k"])


@query("key_overlap", "SELECT c_custkey AS k FROM customer INTERSECT SELECT user_id FROM events")
def key_overlap(spark, sf_dir):
    return joins.overlap(load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")),
                         load(spark, sf_dir, "events").select(F.col("user_id").alias("k")), ["k"])


@query("union_missing_columns", """
SELECT o_orderkey AS identifier, o_totalprice AS value, o_orderstatus AS phase, NULL::INTEGER AS "window" FROM orders
UNION ALL SELECT l_orderkey, l_extendedprice, NULL, l_linenumber FROM lineitem""")
def union_missing_columns(spark, sf_dir):
    a = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("identifier"), F.col("o_totalprice").alias("value"),
                                             F.col("o_orderstatus").alias("phase"))
    b = load(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("window"), F.col("l_orderkey").alias("identifier"),
                                               F.col("l_extendedprice").alias("value"))
    return joins.union_all([a, b])


GRID_SQL = """
m AS (SELECT DISTINCT event_type AS model FROM events),
g AS (SELECT model, n_estimators, max_samples, max_features,
             CAST(ie * 12 + js * 3 + kf + 1 AS INTEGER) AS run
      FROM m, (VALUES (0, 200), (1, 300), (2, 500)) a(ie, n_estimators),
           (VALUES (0, 'auto'), (1, '0.5'), (2, '0.75'), (3, '1.0')) b(js, max_samples),
           (VALUES (0, '0.5'), (1, '0.75'), (2, '1.0')) c(kf, max_features)),
rs AS (SELECT event_type AS model, n_estimators, max_samples, max_features, run, CAST(sum(user_id) AS BIGINT) AS total,
              round(avg(value), 7) + 0.0 AS "AUPRC"
       FROM events JOIN g ON model = event_type AND event_id % 36 + 1 = run GROUP BY ALL)"""


def _models(spark, sf_dir):
    return load(spark, sf_dir, "events").select(F.col("event_type").alias("model")).distinct()


@query("param_grid", f"WITH {GRID_SQL} SELECT * FROM g")
def param_grid(spark, sf_dir):
    return model_grid.param_grid(_models(spark, sf_dir))


def _results(spark, sf_dir):
    """A result table with one metric per model and run, taken from the events."""
    grid = model_grid.param_grid(_models(spark, sf_dir))
    metric = load(spark, sf_dir, "events").groupBy(
        F.col("event_type").alias("model"), (F.col("event_id") % 36 + 1).cast("int").alias("run")
    ).agg(F.sum("user_id").alias("total"), F.avg("value").alias("AUPRC"))
    return metric.join(grid, ["model", "run"])


@query("numbered_results", f"WITH {GRID_SQL} SELECT * FROM rs")
def numbered_results(spark, sf_dir):
    """Results without their run number get it back from the grid through the text form of the parameters."""
    grid = model_grid.param_grid(_models(spark, sf_dir))
    out = model_grid.number_results(_results(spark, sf_dir).drop("run"), grid,
                                    ["n_estimators", "max_samples", "max_features"])
    return rounded(out.withColumn("n_estimators", F.col("n_estimators").cast("int")), 7, "AUPRC")


@query("best_per_model", f"""
WITH {GRID_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY "AUPRC" DESC, run) AS rk FROM rs)
SELECT model, run, n_estimators, max_samples, max_features, round("AUPRC", 3) AS "AUPRC" FROM b WHERE rk = 1""")
def best_per_model(spark, sf_dir):
    best = model_grid.best_configurations(rounded(_results(spark, sf_dir), 7, "AUPRC"))
    shown = model_grid.display_table(best, {"AUPRC": 3}).drop("total")
    return model_grid.presentation_order(shown, "model", ["view", "click", "purchase", "signup", "error"])


@query("max_per_model", f"""WITH {GRID_SQL} SELECT model, max("AUPRC") AS best FROM rs GROUP BY model""")
def max_per_model(spark, sf_dir):
    return rounded(_results(spark, sf_dir), 7, "AUPRC").groupBy("model").agg(F.max("AUPRC").alias("best"))


@query("top_result", f"""WITH {GRID_SQL} SELECT model, run, "AUPRC" FROM rs ORDER BY "AUPRC" DESC, model, run LIMIT 1""")
def top_result(spark, sf_dir):
    """The single best configuration of all models (a top-1 report)."""
    out = rounded(_results(spark, sf_dir), 7, "AUPRC").select("model", "run", "AUPRC")
    return out.orderBy(F.col("AUPRC").desc(), "model", "run").limit(1)


@query("identifier_parts", """
SELECT o_orderkey, o_orderstatus AS phase, o_orderpriority AS batch, 'op_' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS operating_point,
       'train_normal' AS experiment_type, 'experiment_' || o_orderkey AS experiment FROM orders""")
def identifier_parts(spark, sf_dir):
    """Identifier joined with slashes and split back into its five columns."""
    whole = F.concat_ws(
        "/", "o_orderstatus", "o_orderpriority", F.concat(F.lit("op_"), F.lpad(F.col("o_custkey").cast("string"), 6, "0")),
        F.lit("train_normal"), F.concat(F.lit("experiment_"), F.col("o_orderkey").cast("string")))
    df = load(spark, sf_dir, "orders").select("o_orderkey", whole.alias("identifier"))
    return ex.split_identifier(df).drop("identifier")


@query("time_functions", """
WITH b AS (SELECT event_id, ts, strftime(ts, '%H:%M:%S') AS hms FROM events),
r AS (SELECT *, epoch_us(ts) AS us FROM b)
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE hms END AS clock,
       CASE WHEN event_id % 5 = 0 THEN NULL
            ELSE CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS INTEGER) END AS second_of_day,
       CAST((us // 1000000 + CASE WHEN us % 1000000 > 500000 OR (us % 1000000 = 500000 AND us // 1000000 % 2 = 1)
             THEN 1 ELSE 0 END) % 86400 AS INTEGER) AS rounded_second
FROM r""")
def time_functions(spark, sf_dir):
    """Two text formats and unreadable text normalised to HH:MM:SS; full-second rounding of fractions."""
    ts = F.col("ts")
    text = F.when(F.col("event_id") % 5 == 0, "bad").when(F.col("event_id") % 5 == 1, F.date_format(ts, "HH:mm:ss")) \
        .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
    near = ex.round_to_second(ts.cast("timestamp")).cast("timestamp")
    df = load(spark, sf_dir, "events").select("event_id", ex.normalize_time(text).alias("clock"), near.alias("near"))
    return df.select("event_id", "clock", ex.seconds_of_day(F.col("clock")).alias("second_of_day"),
                     ex.seconds_of_day(F.date_format("near", "HH:mm:ss")).alias("rounded_second"))


@query("recode_values", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status,
       CASE WHEN o_orderkey % 4 = 0 THEN 0 WHEN o_orderkey % 4 IN (2, 3) THEN 1 END AS target FROM orders""")
def recode_values(spark, sf_dir):
    df = load(spark, sf_dir, "orders")
    return df.select("o_orderkey", ex.recode(F.col("o_orderstatus"), {"F": "finished", "O": "open"}).alias("status"),
                     ex.binary_target(F.col("o_orderkey") % 4).alias("target"))
