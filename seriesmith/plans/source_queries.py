"""Round trips through files: path metadata, by-name union, fixed number formats, Parquet."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmith.functions.expressions import features_except, split_identifier
from seriesmith.operators.joins import pending_inputs
from seriesmith.operators.series import operation_data
from seriesmith.plans.bindings import windowed
from seriesmith.plans.registry import load, query
from seriesmith.session import scratch_path
from seriesmith.sources import files

PLANT_SQL = """
pl AS (SELECT CASE l_returnflag WHEN 'A' THEN 'Startup' WHEN 'N' THEN 'Operation' ELSE 'Shutdown' END AS phase,
  CASE l_suppkey % 3 WHEN 0 THEN 'batch_dist_binary_ethanol+propan-2-ol'
       WHEN 1 THEN 'batch_dist_ternary_acetone+butan-1-ol+methanol'
       ELSE 'batch_dist_ternary_butan-1-ol+propan-2-ol+water' END AS batch,
  'operating_point_' || lpad(CAST(l_suppkey % 5 AS VARCHAR), 3, '0') AS operating_point,
  CASE l_linestatus WHEN 'O' THEN 'train_normal' ELSE 'test_anormal' END AS experiment_type,
  'experiment_' || lpad(CAST(l_suppkey % 20 AS VARCHAR), 3, '0') AS experiment, * FROM lineitem)"""


def layout_columns():
    """Where a line item stands in the plant's folder layout."""
    s = F.col("l_suppkey")
    number = F.lpad((s % 20).cast("string"), 3, "0")
    kind = F.when(F.col("l_linestatus") == "O", "train_normal").otherwise("test_anormal")
    return {
        "phase": F.when(F.col("l_returnflag") == "A", "Startup").when(F.col("l_returnflag") == "N", "Operation")
        .otherwise("Shutdown"),
        "batch": F.element_at(F.array(*[F.lit(b) for b in files.BATCHES]), (s % 3 + 1).cast("int")),
        "operating_point": F.concat(F.lit("operating_point_"), F.lpad((s % 5).cast("string"), 3, "0")),
        "experiment_file": F.concat(kind, F.lit("_experiment_"), number),
    }


def plant_rows(spark, sf_dir):
    """Line items placed into the plant's folder layout."""
    return load(spark, sf_dir, "lineitem").select(
        *[c.alias(n) for n, c in layout_columns().items()],
        F.date_format(F.timestamp_seconds((F.col("l_orderkey") % 86400).cast("long")), "HH:mm:ss").alias("Time"),
        F.col("l_orderkey").cast("double").alias("order"), F.col("l_linenumber").cast("double").alias("line"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("flag"),
    )


LAYOUT = ["phase", "batch", "operating_point", "experiment_file"]


@query("csv_roundtrip_path_metadata", f"""
WITH {PLANT_SQL}
SELECT phase, batch, operating_point, experiment_type, experiment, count(*) AS n_rows,
       CAST(sum(l_orderkey) AS DOUBLE) AS orders, round(sum(l_quantity), 3) AS quantity,
       round(sum(CASE WHEN phase = 'Operation' THEN l_extendedprice END), 2) AS price
FROM pl GROUP BY ALL""")
def csv_roundtrip_path_metadata(spark, sf_dir):
    """Write one CSV folder per experiment in two layouts, read both back by column name."""
    root = scratch_path(spark, "series")
    rows = plant_rows(spark, sf_dir).drop("status", "flag")
    files.write_series(rows.filter("phase = 'Operation'"), f"{root}/full", LAYOUT)
    # Other phases lack the price and hold their columns in another order.
    files.write_series(rows.filter("phase <> 'Operation'").select("quantity", "Time", "order", "line", *LAYOUT),
                       f"{root}/short", LAYOUT)
    back = split_identifier(files.read_series(spark, root))
    return back.groupBy(*files.PATH_COLUMNS).agg(
        F.count("*").alias("n_rows"), F.sum("order").alias("orders"), F.round(F.sum("quantity"), 3).alias("quantity"),
        F.round(F.sum("price"), 2).alias("price"))


@query("series_rows", f"""
WITH {PLANT_SQL}
SELECT phase, experiment, strftime(make_timestamp(l_orderkey % 86400 * 1000000), '%H:%M:%S') AS "Time",
       CAST(l_orderkey AS DOUBLE) AS "order", CAST(l_linenumber AS DOUBLE) AS line, l_quantity AS quantity,
       l_linestatus || ', ' || l_returnflag AS note
FROM pl""")
def series_rows(spark, sf_dir):
    """Every row of written series with a text column that holds the separator, in two layouts."""
    root = scratch_path(spark, "notes")
    note = F.concat("status", F.lit(", "), "flag")
    rows = plant_rows(spark, sf_dir).withColumn("note", note)
    full = [c for c in rows.columns if c not in ("price", "status", "flag")]
    files.write_series(rows.filter("phase = 'Operation'").select(*full), f"{root}/a", LAYOUT)
    files.write_series(rows.filter("phase <> 'Operation'").select(*reversed(full)), f"{root}/b", LAYOUT)
    back = split_identifier(files.read_series(spark, root, text=("Time", "note")))
    return back.select("phase", "experiment", "Time", "order", "line", "quantity", "note")


@query("series_line_breaks", f"""
WITH {PLANT_SQL}
SELECT phase, experiment, strftime(make_timestamp(l_orderkey % 86400 * 1000000), '%H:%M:%S') AS "Time",
       CAST(l_orderkey AS DOUBLE) AS "order", l_quantity AS quantity,
       l_linestatus || chr(10) || '"' || l_returnflag || '", ' || l_linenumber AS "free text"
FROM pl""")
def series_line_breaks(spark, sf_dir):
    """Every row of written series whose text cells hold a line break, quotes and the separator, in two layouts."""
    root = scratch_path(spark, "breaks")
    words = F.concat("status", F.lit('\n"'), "flag", F.lit('", '), F.col("line").cast("int"))
    rows = plant_rows(spark, sf_dir).select("Time", "order", "quantity", words.alias("free text"), *LAYOUT)
    files.write_series(rows.filter("phase = 'Operation'"), f"{root}/a", LAYOUT)
    files.write_series(rows.filter("phase <> 'Operation'").select("free text", "quantity", "order", "Time", *LAYOUT),
                       f"{root}/b", LAYOUT)
    back = split_identifier(files.read_series(spark, root, text=("Time", "free text")))
    return back.select("phase", "experiment", "Time", "order", "quantity", "free text")


@query("read_modalities", f"""
WITH {PLANT_SQL}
SELECT 'labels' AS modality, experiment, count(*) AS n_rows, round(sum(CAST(l_linenumber AS DOUBLE)), 2) AS total
FROM pl GROUP BY experiment
UNION ALL SELECT 'sensors', experiment, count(*), round(sum(l_extendedprice), 2) FROM pl GROUP BY experiment
UNION ALL SELECT 'actuators', experiment, count(*), round(sum(l_quantity), 2) FROM pl GROUP BY experiment""")
def read_modalities(spark, sf_dir):
    """The three kinds of series written into their folders and read back."""
    root = scratch_path(spark, "plant")
    rows = plant_rows(spark, sf_dir)
    columns = {"labels": "line", "sensors": "price", "actuators": "quantity"}
    for name, column in columns.items():
        files.write_series(rows.select("Time", column, *LAYOUT), f"{root}/{files.MODALITIES[name]}", LAYOUT)
    found = files.read_modalities(spark, root)
    parts = [split_identifier(found[name]).groupBy("experiment").agg(
        F.count("*").alias("n_rows"), F.round(F.sum(column), 2).alias("total")).select(
        F.lit(name).alias("modality"), "experiment", "n_rows", "total") for name, column in columns.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("inferred_settings", """
SELECT p_brand, count(*) AS n_rows, CAST(sum(p_size) AS BIGINT) AS sizes, round(sum(p_retailprice), 2) AS prices,
       'string int double' AS types FROM part GROUP BY p_brand""")
def inferred_settings(spark, sf_dir):
    """A delimited settings table whose column types are inferred."""
    path = scratch_path(spark, "settings")
    part = load(spark, sf_dir, "part").select("p_brand", "p_size", F.col("p_retailprice").cast("double").alias("p_retailprice"))
    part.write.option("header", True).option("sep", ";").csv(path)
    back = files.read_delimited(spark, path, infer=True)
    return back.groupBy("p_brand").agg(
        F.count("*").alias("n_rows"), F.sum("p_size").alias("sizes"), F.round(F.sum("p_retailprice"), 2).alias("prices"),
    ).withColumn("types", F.lit(" ".join(t for _, t in back.dtypes)))


@query("csv_number_format", """
SELECT l_suppkey, count(*) AS n_rows, round(sum(CAST(printf('%.6f', l_extendedprice / 7) AS DOUBLE)), 3) AS price
FROM lineitem GROUP BY l_suppkey""")
def csv_number_format(spark, sf_dir):
    """Numbers written with six decimals and read back."""
    path = scratch_path(spark, "formatted")
    line = load(spark, sf_dir, "lineitem")
    out = line.select("l_suppkey", (F.col("l_extendedprice") / 7).alias("price"), "l_linestatus")
    files.write_series(out, path, ["l_linestatus"], formats={"price": "%.6f"})
    back = spark.read.schema("l_suppkey BIGINT, price DOUBLE, l_linestatus STRING").option("header", True).csv(path)
    return back.groupBy("l_suppkey").agg(F.count("*").alias("n_rows"), F.round(F.sum("price"), 3).alias("price"))


@query("delimited_incidents", """
SELECT event_type, count(*) AS n_rows, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY event_type""")
def delimited_incidents(spark, sf_dir):
    """Semicolon-separated list with padded names and values, as plant operators write it."""
    path = scratch_path(spark, "incidents")
    ev = load(spark, sf_dir, "events").select(
        F.col("event_id").alias(" event_id "), F.concat(F.lit(" "), "event_type").alias("event_type "))
    ev.write.option("header", True).option("sep", ";").option("ignoreLeadingWhiteSpace", False) \
        .option("ignoreTrailingWhiteSpace", False).csv(path)
    back = files.read_delimited(spark, path)
    return back.groupBy("event_type").agg(F.count("*").alias("n_rows"),
                                          F.sum(F.col("event_id").cast("long")).alias("ids"))


@query("parquet_roundtrip", """
WITH s AS (SELECT l_suppkey AS entity, l_linestatus AS status, l_quantity AS quantity,
       (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1) // 60 AS w
       FROM lineitem)
SELECT entity, CAST(w AS INTEGER) AS "window", count(*) AS n_rows, sum(quantity) AS quantity FROM s WHERE status = 'F'
GROUP BY entity, w""")
def parquet_roundtrip(spark, sf_dir):
    """Windowed series written as a partitioned table; the reader prunes partitions and columns."""
    path = scratch_path(spark, "operation")
    files.write_table(windowed(spark, sf_dir), path, ["status"])
    back = files.read_table(spark, path, ["entity", "window", "quantity", "status"])
    return back.filter("status = 'F'").groupBy("entity", "window").agg(
        F.count("*").alias("n_rows"), F.sum("quantity").alias("quantity"))


@query("parquet_whole", """
SELECT l_suppkey AS entity, l_linestatus AS status, count(*) AS n_rows, sum(l_quantity) AS quantity FROM lineitem
GROUP BY l_suppkey, l_linestatus""")
def parquet_whole(spark, sf_dir):
    """The whole partitioned table read back."""
    path = scratch_path(spark, "operation")
    files.write_table(windowed(spark, sf_dir), path, ["status"])
    return files.read_table(spark, path).groupBy("entity", "status").agg(
        F.count("*").alias("n_rows"), F.sum("quantity").alias("quantity"))


@query("pending_files", f"""
WITH {PLANT_SQL}, f AS (SELECT DISTINCT phase, experiment_type || '_' || experiment AS stem FROM pl)
SELECT stem FROM (SELECT DISTINCT stem FROM f WHERE phase = 'Startup') EXCEPT SELECT stem FROM f
WHERE phase = 'Shutdown' AND stem LIKE '%_experiment_00%'""")
def pending_files(spark, sf_dir):
    """Files of one folder not yet processed, found by file name; the partner folder must hold them too."""
    root = scratch_path(spark, "pending")
    rows = plant_rows(spark, sf_dir).select("phase", "batch", "operating_point", "experiment_file", "order")
    files.write_series(rows, root, LAYOUT)
    found = files.discover(spark, root).withColumn(
        "stem", F.concat_ws("_", "experiment_type", "experiment")).select("phase", "stem").distinct()
    done = found.filter("phase = 'Shutdown' and stem like '%\\_experiment\\_00%'")
    return pending_inputs(found.filter("phase = 'Startup'").select("stem"), done,
                          found.filter("phase = 'Operation'"), "stem")


@query("upload_parts", """
WITH p AS (SELECT user_id, event_id, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) % 86400 AS s, epoch_us(ts) % 1000000 AS us,
                  value, CASE WHEN day(ts) <= 15 THEN 0 ELSE 1 END AS part, strftime(ts, '%H:%M:%S.%f') AS raw FROM events),
r AS (SELECT *, (s + CASE WHEN us > 500000 OR (us = 500000 AND s % 2 = 1) THEN 1 ELSE 0 END) % 86400 AS t FROM p),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id, t ORDER BY part, raw) AS rn FROM r)
SELECT user_id, printf('%02d:%02d:%02d', t // 3600, t // 60 % 60, t % 60) AS "Time", value FROM f WHERE rn = 1""")
def upload_parts(spark, sf_dir):
    """Two uploads per entity joined to one, fractional times rounded to the second, first row per second kept."""
    ev = load(spark, sf_dir, "events").select(
        "user_id", F.date_format("ts", "HH:mm:ss.SSSSSS").alias("Timestamp"), "value", F.dayofmonth("ts").alias("d"))
    return files.combine_uploads([ev.filter("d <= 15").drop("d"), ev.filter("d > 15").drop("d")], ["user_id"])


@query("operation_rows", f"""
WITH {PLANT_SQL}, o AS (SELECT *, CAST(l_orderkey % 1000 AS DOUBLE) AS elapsed, CAST(floor(l_orderkey % 1000 / 60.0) AS INTEGER) AS k
                        FROM pl WHERE phase = 'Operation')
SELECT strftime(make_timestamp(l_orderkey % 86400 * 1000000), '%H:%M:%S') AS "Time", elapsed AS elapsed_time,
       CAST(l_linenumber % 4 AS DOUBLE) AS anomaly_label,
       concat_ws('/', phase, batch, operating_point, experiment_type, experiment) AS identifier,
       phase, batch, operating_point, experiment_type, experiment, l_quantity AS quantity,
       CASE WHEN l_extendedprice > 500 THEN l_extendedprice / 1000 ELSE l_extendedprice END AS price,
       k AS "window", k * 60 AS window_start, (k + 1) * 60 AS window_end, 2 AS n_features
FROM o""")
def operation_rows(spark, sf_dir):
    """Operation-phase rows of all experiments, repaired and windowed, metadata first; other columns are left out."""
    rows = plant_rows(spark, sf_dir).withColumns({
        "experiment_type": F.regexp_extract("experiment_file", "^(.*)_experiment_", 1),
        "experiment": F.regexp_extract("experiment_file", "(experiment_.*)$", 1),
        "elapsed_time": F.col("order") % 1000, "anomaly_label": F.col("line") % 4})
    named = rows.withColumn("identifier", F.concat_ws("/", *files.PATH_COLUMNS))
    out = operation_data(named, ["quantity", "price"], large=["price"])
    meta = ["Time", "elapsed_time", "anomaly_label", "identifier", *files.PATH_COLUMNS, "window", "window_start", "window_end"]
    return out.withColumn("n_features", F.lit(len(features_except(out, meta))))
