"""Clock-based operators over the events table: elapsed time, runs, phases, resampling, interval labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmith.operators import cleaning, intervals, ordered, series
from seriesmith.plans.registry import load, query
from seriesmith.sources.nested import flatten_anomalies, json_columns, parse_anomalies

USER = ["user_id"]
ORDER = ["ts", "event_id"]
ORIGIN = 1704067200  # 2024-01-01, start of the events

EV_SQL = f"""
ev AS (SELECT *, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) - {ORIGIN} AS t,
              CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)"""


def events(spark, sf_dir):
    """Events with ``t`` (whole seconds since the origin) and ``k`` from the JSON properties."""
    # Calendar parts instead of an epoch: the column has no time zone, so the session's zone must not matter.
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01")).cast("long")
    clock = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    df = load(spark, sf_dir, "events").withColumn("t", day * 86400 + clock)
    return json_columns(df, "props", "k INT")


@query("elapsed_time", f"""
WITH {EV_SQL},
st AS (SELECT event_id, user_id, t % 86400 AS second_of_day,
              t % 86400 - lag(t % 86400) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, ts FROM ev)
SELECT event_id, user_id, CAST(second_of_day AS BIGINT) AS second_of_day,
       CAST(sum(CASE WHEN step IS NULL THEN 0 WHEN step < 0 AND user_id = 7 THEN 0 ELSE step END)
            OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS elapsed_time
FROM st""")
def elapsed_time(spark, sf_dir):
    """Time of day wraps at midnight; only the named entity's backward steps count as 0."""
    df = events(spark, sf_dir).select("event_id", "user_id", "ts", F.pmod("t", F.lit(86400)).alias("second_of_day"))
    out = series.elapsed_time(df, USER, ORDER, F.col("second_of_day"), clamp_for=F.col("user_id") == 7)
    return out.drop("ts")


@query("tumbling_windows", f"""
WITH {EV_SQL}, el AS (SELECT event_id, user_id, t - min(t) OVER (PARTITION BY user_id) AS elapsed_time FROM ev
                      WHERE lower(event_type) = 'view')
SELECT event_id, user_id, elapsed_time, CAST(elapsed_time // 86400 AS INTEGER) AS "window",
       CAST(elapsed_time // 86400 * 86400 AS INTEGER) AS window_start,
       CAST((elapsed_time // 86400 + 1) * 86400 AS INTEGER) AS window_end FROM el""")
def tumbling_windows(spark, sf_dir):
    df = series.phase_filter(events(spark, sf_dir), "VIEW", "event_type").select("event_id", "user_id", "t")
    return series.tumbling_windows(series.elapsed_since_first(df, USER, "t"), "elapsed_time", 86400).drop("t")


@query("complete_windows", f"""
WITH {EV_SQL}, el AS (SELECT *, (t - min(t) OVER (PARTITION BY user_id)) // 86400 AS "window" FROM ev),
c AS (SELECT *, count(*) OVER (PARTITION BY user_id, "window") AS n FROM el)
SELECT event_id, user_id, CAST("window" AS INTEGER) AS "window",
       row_number() OVER (PARTITION BY user_id, "window" ORDER BY ts, event_id) - 1 AS position
FROM c WHERE n = 3""")
def complete_windows(spark, sf_dir):
    """Clock windows with exactly three rows, and the position inside them."""
    df = series.elapsed_since_first(events(spark, sf_dir).select("event_id", "user_id", "ts", "t"), USER, "t")
    full = series.complete_windows(series.tumbling_windows(df, "elapsed_time", 86400), USER, 3)
    return series.window_position(full, USER, ORDER).select("event_id", "user_id", "window", "position")


@query("phase_changes", """
SELECT event_id, user_id, event_type,
       lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type AS run_start
FROM events""")
def phase_changes(spark, sf_dir):
    df = load(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return ordered.run_starts(df, USER, ORDER, F.col("event_type")).drop("ts")


RUNS_SQL = """
ix AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position,
              coalesce(value > 10, false) AS mask FROM events),
ch AS (SELECT *, CASE WHEN lag(mask) OVER (PARTITION BY user_id ORDER BY position) IS DISTINCT FROM mask
                      THEN 1 ELSE 0 END AS change FROM ix),
ru AS (SELECT *, sum(change) OVER (PARTITION BY user_id ORDER BY position) AS run_id FROM ch),
runs AS (SELECT user_id, CAST(run_id AS BIGINT) AS run_id, min(position) AS first_position, count(*) AS run_length
         FROM ru WHERE mask GROUP BY user_id, run_id HAVING count(*) > 4)"""


@query("run_islands", f"WITH {RUNS_SQL} SELECT * FROM runs")
def run_islands(spark, sf_dir):
    df = load(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return cleaning.long_runs(df, USER, ORDER, F.col("value") > 10, 4)


@query("phase_segments", f"""
WITH {RUNS_SQL},
b AS (SELECT user_id, min(position) FILTER (value > 20) AS s, max(position) FILTER (value > 20) AS e
      FROM ix GROUP BY user_id HAVING count(*) FILTER (value > 20) > 0),
d AS (SELECT user_id, min(first_position) AS d FROM runs GROUP BY user_id),
j AS (SELECT ix.event_id, ix.user_id, position, s, d, e FROM ix JOIN b USING (user_id) JOIN d USING (user_id))
SELECT event_id, user_id, position, 'Startup' AS phase FROM j WHERE position BETWEEN s AND d
UNION ALL SELECT event_id, user_id, position, 'Operation' FROM j WHERE position BETWEEN d AND e - 2
UNION ALL SELECT event_id, user_id, position, 'Shutdown' FROM j WHERE position >= e - 2""")
def phase_segments(spark, sf_dir):
    df = load(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    out = cleaning.split_phases(df, USER, ORDER, F.col("value") > 20, F.col("value") > 10, 4)
    return out.select("event_id", "user_id", "position", "phase")


@query("phase_status", f"""
WITH {RUNS_SQL},
b AS (SELECT user_id, count(*) AS n_rows, min(position) FILTER (value > 20 AND user_id % 7 <> 3) AS s,
             max(position) FILTER (value > 20 AND user_id % 7 <> 3) AS e FROM ix GROUP BY user_id),
d AS (SELECT user_id, min(first_position) AS d FROM runs GROUP BY user_id)
SELECT user_id, n_rows, s AS startup_position, e AS shutdown_position, d AS operation_position,
       CASE WHEN s IS NULL THEN 'never active' WHEN d IS NULL THEN 'no long run' ELSE 'split' END AS status
FROM b LEFT JOIN d USING (user_id)""")
def phase_status(spark, sf_dir):
    """Which users can be cut into phases; every seventh is never active."""
    df = load(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    indexed = ordered.row_position(df, USER, ORDER, "position")
    return cleaning.phase_status(indexed, USER, ORDER, (F.col("value") > 20) & (F.col("user_id") % 7 != 3), F.col("value") > 10, 4)


@query("resample_interpolate", f"""
WITH {EV_SQL},
h AS (SELECT user_id, t // 3600 AS hour, value, CASE WHEN event_type = 'error' THEN value END AS error_value,
             row_number() OVER (PARTITION BY user_id, t // 3600 ORDER BY ts, event_id) AS rn FROM ev),
f AS (SELECT * FROM h WHERE rn = 1),
g AS (SELECT user_id, unnest(generate_series(lo, hi)) AS hour
      FROM (SELECT user_id, min(hour) AS lo, max(hour) AS hi FROM f GROUP BY user_id)),
j AS (SELECT g.user_id, g.hour, f.value, f.error_value, f.user_id IS NOT NULL AS measured
      FROM g LEFT JOIN f ON g.user_id = f.user_id AND g.hour = f.hour),
n AS (SELECT *,
        last_value(CASE WHEN value IS NOT NULL THEN hour END IGNORE NULLS) OVER p AS pt,
        last_value(value IGNORE NULLS) OVER p AS px,
        first_value(CASE WHEN value IS NOT NULL THEN hour END IGNORE NULLS) OVER q AS nt,
        first_value(value IGNORE NULLS) OVER q AS nx,
        last_value(CASE WHEN error_value IS NOT NULL THEN hour END IGNORE NULLS) OVER p AS ept,
        last_value(error_value IGNORE NULLS) OVER p AS epx,
        first_value(CASE WHEN error_value IS NOT NULL THEN hour END IGNORE NULLS) OVER q AS ent,
        first_value(error_value IGNORE NULLS) OVER q AS enx
      FROM j WINDOW p AS (PARTITION BY user_id ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    q AS (PARTITION BY user_id ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, hour,
       CASE WHEN pt IS NULL THEN NULL WHEN nt IS NULL OR nt = pt THEN px
             ELSE px + (nx - px) * (hour - pt) / (nt - pt) END AS value,
       CASE WHEN ept IS NULL THEN NULL WHEN ent IS NULL OR ent = ept THEN epx
             ELSE epx + (enx - epx) * (hour - ept) / (ent - ept) END AS error_value,
       CASE WHEN measured THEN 1 ELSE 2 END AS quality
FROM n""")
def resample_interpolate(spark, sf_dir):
    """Hourly grid per user; the error column has leading, inner and trailing gaps."""
    df = events(spark, sf_dir).select(
        "user_id", F.floor(F.col("t") / 3600).alias("hour"), "ts", "event_id", "value",
        F.when(F.col("event_type") == "error", F.col("value")).alias("error_value"),
    )
    first = cleaning.keep_first(df, ["user_id", "hour"], ORDER).drop("ts", "event_id")
    return cleaning.resample_interpolate(first, USER, "hour", ["value", "error_value"])


@query("dedupe_first", f"""
WITH {EV_SQL}, h AS (SELECT user_id, t // 3600 AS hour, event_id, event_type, value,
             row_number() OVER (PARTITION BY user_id, t // 3600 ORDER BY ts, event_id) AS rn FROM ev)
SELECT user_id, hour, event_id, event_type, value FROM h WHERE rn = 1""")
def dedupe_first(spark, sf_dir):
    df = events(spark, sf_dir).select("user_id", F.floor(F.col("t") / 3600).alias("hour"), "ts", "event_id",
                                      "event_type", "value")
    return cleaning.keep_first(df, ["user_id", "hour"], ORDER).drop("ts")


@query("range_patch", f"""
WITH {EV_SQL},
pa AS (SELECT user_id, CASE event_type WHEN 'signup' THEN 'value' ELSE 'score' END AS feature,
              t AS start, t + 3600 * (k % 24) AS "end", CAST(k AS DOUBLE) AS pv, event_id AS ord
       FROM ev WHERE event_type IN ('signup', 'click')),
x AS (SELECT event_id, user_id, t, value, value * 2 AS score FROM ev),
b AS (SELECT x.event_id, pa.feature, arg_max(pa.pv, pa.ord) AS pv
      FROM x JOIN pa ON x.user_id = pa.user_id AND x.t BETWEEN pa.start AND pa."end"
      GROUP BY x.event_id, pa.feature)
SELECT x.event_id, x.user_id, x.t, coalesce(v.pv, x.value) AS value, coalesce(s.pv, x.score) AS score
FROM x LEFT JOIN b v ON v.event_id = x.event_id AND v.feature = 'value'
       LEFT JOIN b s ON s.event_id = x.event_id AND s.feature = 'score' """)
def range_patch(spark, sf_dir):
    ev = events(spark, sf_dir)
    patches = ev.filter(F.col("event_type").isin("signup", "click")).select(
        "user_id", F.when(F.col("event_type") == "signup", "value").otherwise("score").alias("feature"),
        F.col("t").alias("start"), (F.col("t") + 3600 * (F.col("k") % 24)).alias("end"),
        F.col("k").cast("double").alias("value"), F.col("event_id").alias("patch_order"),
    )
    rows = ev.select("event_id", "user_id", "t", "value", (F.col("value") * 2).alias("score"))
    return intervals.patch_ranges(rows, patches, USER, "t", ["value", "score"])


@query("interval_last_writer", f"""
WITH {EV_SQL}, iv AS (SELECT user_id, t AS lo, t + 600 * k AS hi, event_id AS anomaly_id FROM ev
                      WHERE event_type = 'signup')
SELECT ev.event_id, ev.user_id, ev.t, arg_max(iv.anomaly_id, iv.anomaly_id) AS anomaly_id
FROM ev LEFT JOIN iv ON ev.user_id = iv.user_id AND ev.t BETWEEN iv.lo AND iv.hi
GROUP BY ev.event_id, ev.user_id, ev.t""")
def interval_last_writer(spark, sf_dir):
    ev = events(spark, sf_dir)
    spans = ev.filter("event_type = 'signup'").select(
        "user_id", F.col("t").alias("lo"), (F.col("t") + 600 * F.col("k")).alias("hi"),
        F.col("event_id").alias("anomaly_id"))
    rows = ev.select("event_id", "user_id", "t")
    return intervals.last_writer(rows, spans, USER, "t", "lo", "hi", ["anomaly_id"], "anomaly_id", "anomaly_id")


INCIDENTS_SQL = """
inc AS (SELECT user_id, event_id AS incident,
               CASE WHEN k % 5 IN (0, 1) THEN 0 ELSE t END AS sc,
               CASE WHEN k % 5 = 0 THEN 0 ELSE t + 1200 * (k % 7) + 1 END AS ec,
               CASE WHEN k % 11 = 0 THEN 0 ELSE t + 1800 * (k % 4) END AS se,
               CASE WHEN k % 13 = 0 THEN 0 ELSE t + 1800 * (k % 4) + 900 * (k % 17) END AS ee,
               CAST(1 + k % 3 AS INTEGER) AS class
        FROM ev WHERE event_type = 'error' AND k % 10 <> 9),
ru AS (
  SELECT user_id, incident, se AS lo, ee AS hi, 2 AS label, 0 AS ro FROM inc WHERE sc = 0 AND ec = 0
  UNION ALL SELECT user_id, incident, sc, ec, 1, 1 FROM inc WHERE sc = 0 AND ec = 0 AND class = 3
  UNION ALL SELECT user_id, incident, sc, ec, 1, 2 FROM inc WHERE sc = 0 AND ec <> 0
  UNION ALL SELECT user_id, incident, se, ee, 2, 3 FROM inc WHERE sc = 0 AND ec <> 0
  UNION ALL SELECT user_id, incident, sc, ec, 1, 4 FROM inc WHERE se = 0 OR ee = 0
  UNION ALL SELECT user_id, incident, sc, ec, 1, 5 FROM inc WHERE sc <> 0 AND ec <> 0 AND se <> 0 AND ee <> 0
  UNION ALL SELECT user_id, incident, se, ec, 2, 6 FROM inc WHERE sc <> 0 AND ec <> 0 AND se <> 0 AND ee <> 0
  UNION ALL SELECT user_id, incident, CASE WHEN se <= ec THEN ec ELSE se END, ee, 3, 7
            FROM inc WHERE sc <> 0 AND ec <> 0 AND se <> 0 AND ee <> 0)"""


def incidents(ev):
    k, t = F.col("k"), F.col("t")
    raw = ev.filter("event_type = 'error'").select(
        "user_id", F.col("event_id").alias("incident"),
        F.when((k % 5).isin(0, 1), 0).otherwise(t).alias("sc"),
        F.when(k % 5 == 0, 0).otherwise(t + 1200 * (k % 7) + 1).alias("ec"),
        F.when(k % 11 == 0, 0).otherwise(t + 1800 * (k % 4)).alias("se"),
        F.when(k % 13 == 0, 0).otherwise(t + 1800 * (k % 4) + 900 * (k % 17)).alias("ee"),
        (1 + k % 3).alias("class"),
        F.when(k % 10 == 9, " negligible").otherwise("fault").alias("description"),
    )
    return intervals.drop_incidents(raw, ev, USER, "description", "class", ["negligible"])


@query("incident_labels", f"""
WITH {EV_SQL}, {INCIDENTS_SQL}
SELECT ev.event_id, ev.user_id, ev.t,
       CAST(CASE WHEN max(ru.label = 2) THEN 2 ELSE coalesce(arg_max(ru.label, ru.incident * 10 + ru.ro), 0) END
            AS INTEGER) AS label
FROM ev LEFT JOIN ru ON ev.user_id = ru.user_id AND ev.t BETWEEN ru.lo AND ru.hi
GROUP BY ev.event_id, ev.user_id, ev.t""")
def incident_labels(spark, sf_dir):
    ev = events(spark, sf_dir)
    rules = intervals.incident_rules(incidents(ev), "sc", "ec", "se", "ee", "class", "incident")
    return intervals.label_incidents(ev.select("event_id", "user_id", "t"), rules, USER, "t", ["incident"])


@query("label_grid", f"""
WITH {EV_SQL}, {INCIDENTS_SQL},
sp AS (SELECT user_id, min(t) AS lo, max(t) AS hi FROM ev GROUP BY user_id),
g AS (SELECT user_id, unnest(generate_series(lo, hi, 14400)) AS t FROM sp)
SELECT g.user_id, g.t, CAST(CASE WHEN max(ru.label = 2) THEN 2
         ELSE coalesce(arg_max(ru.label, ru.incident * 10 + ru.ro), 0) END AS INTEGER) AS label
FROM g LEFT JOIN ru ON g.user_id = ru.user_id AND g.t BETWEEN ru.lo AND ru.hi GROUP BY g.user_id, g.t""")
def label_grid(spark, sf_dir):
    """A label series of its own: one row per four hours from the first to the last event of an entity."""
    ev = events(spark, sf_dir)
    rules = intervals.incident_rules(incidents(ev), "sc", "ec", "se", "ee", "class", "incident")
    grid = intervals.label_grid(ev, USER, "t", step=14400)
    return intervals.label_incidents(grid, rules, USER, "t", ["incident"])


@query("incident_rows", f"""
WITH {EV_SQL}, {INCIDENTS_SQL}
SELECT u.user_id, count(inc.incident) AS n_incidents, CAST(coalesce(max(inc.class), 0) AS INTEGER) AS worst_class
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN inc ON inc.user_id = u.user_id GROUP BY u.user_id""")
def incident_rows(spark, sf_dir):
    """Incidents kept per entity; one without any keeps a class-0 placeholder."""
    return incidents(events(spark, sf_dir)).groupBy("user_id").agg(
        F.count("incident").alias("n_incidents"), F.max("class").alias("worst_class"))


@query("json_attributes", """
SELECT event_id, user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events""")
def json_attributes(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", "user_id", "k")


@query("nested_flatten", f"""
WITH {EV_SQL}, two AS (SELECT *, unnest(generate_series(0, 1)) AS part FROM ev)
SELECT event_id, event_id || '-' || part AS id, CAST(t AS VARCHAR) AS begin, CAST(t + k AS VARCHAR) AS "end",
       'sensor-' || user_id AS sensor, event_type AS observation, 'value' AS property, 'unit-' || k AS feature
FROM two""")
def nested_flatten(spark, sf_dir):
    """Two anomaly descriptions per event, held as nested JSON text, read back as flat rows."""
    def one(part):
        seen = F.struct(
            F.col("event_type").alias("label"),
            F.struct(F.struct(F.concat(F.lit("sensor-"), "user_id").alias("id")).alias("Sensor")).alias("madeBySensor"),
            F.struct(F.lit("value").alias("ObservableProperty")).alias("observedProperty"),
            F.struct(F.concat(F.lit("unit-"), "k").alias("FeatureOfInterest")).alias("hasFeatureOfInterest"),
        )
        return F.struct(
            F.concat("event_id", F.lit(f"-{part}")).alias("id"), F.col("t").cast("string").alias("hasBeginning"),
            (F.col("t") + F.col("k")).cast("string").alias("hasEnd"),
            F.struct(seen.alias("Observation")).alias("wasOriginatedBy"),
        )

    text = F.to_json(F.struct(F.array(one(0), one(1)).alias("anomalies")))
    nested = events(spark, sf_dir).select("event_id", text.alias("text"))
    return flatten_anomalies(nested.select("event_id", parse_anomalies(F.col("text")).alias("anomalies")), ["event_id"])
