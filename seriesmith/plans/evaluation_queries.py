"""Scores, splits and profiles over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmith.operators import features as ft
from seriesmith.operators import joins, metrics, profile, split
from seriesmith.plans.bindings import KEYS, SIGNALS, SIZE, STATS_SQL, series, windowed, windows_sql
from seriesmith.plans.registry import load, query, rounded
from seriesmith.plans.window_queries import WIDE_CTE, WIDE_NAMES, _exact, temporal_table, wide_features
from seriesmith.session import pin

MODEL = ["model"]

SCORED_SQL = """
sc AS (SELECT doc_id, lang, CAST(n_chars AS DOUBLE) AS score, 'quality' AS model, quality AS truth
       FROM documents JOIN labels USING (doc_id)
       UNION ALL SELECT doc_id, lang, CAST(n_chars AS DOUBLE), 'toxic', toxic FROM documents JOIN labels USING (doc_id)),
kn AS (SELECT * FROM sc WHERE truth IS NOT NULL),
gr AS (SELECT model, score, count(*) FILTER (truth = 1) AS pos, count(*) FILTER (truth = 0) AS neg
       FROM kn GROUP BY model, score)"""


def scored(spark, sf_dir):
    """Labelled documents, the length as score, one row per label used as truth ("model")."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("score"))
    both = docs.join(load(spark, sf_dir, "labels"), "doc_id")
    return both.select("doc_id", "lang", "score", F.inline(F.array(
        F.struct(F.lit("quality").alias("model"), F.col("quality").alias("truth")),
        F.struct(F.lit("toxic").alias("model"), F.col("toxic").alias("truth")))))


@query("confusion_metrics", f"""
WITH {SCORED_SQL}, c AS (
SELECT model, count(*) FILTER (truth = 0 AND score < 500) AS tn, count(*) FILTER (truth = 0 AND score >= 500) AS fp,
       count(*) FILTER (truth = 1 AND score < 500) AS fn, count(*) FILTER (truth = 1 AND score >= 500) AS tp,
       count(*) AS n_test, count(*) FILTER (truth = 1) AS n_anomalies, count(*) FILTER (truth = 0) AS n_normal
FROM kn GROUP BY model)
SELECT *, coalesce(round(tp / nullif(tp + fp, 0), 9), 0.0) AS precision, coalesce(round(tp / nullif(tp + fn, 0), 9), 0.0) AS recall,
       coalesce(round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 9), 0.0) AS f1,
       coalesce(round((tp + tn) / nullif(n_test, 0), 9), 0.0) AS accuracy FROM c""")
def confusion_metrics(spark, sf_dir):
    flagged = scored(spark, sf_dir).withColumn("prediction", (F.col("score") >= 500).cast("int"))
    out = metrics.confusion(flagged, MODEL, "truth", "prediction")
    return rounded(out, 9, "precision", "recall", "f1", "accuracy")


PR_SQL = f"""{SCORED_SQL},
cu AS (SELECT *, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER (PARTITION BY model) AS n_pos
       FROM gr WINDOW d AS (PARTITION BY model ORDER BY score DESC))"""


@query("precision_recall_curve", f"""
WITH {PR_SQL} SELECT model, score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       round(tp / (tp + fp), 9) AS precision, coalesce(round(tp / nullif(n_pos, 0), 9), 0.0) AS recall FROM cu""")
def precision_recall_curve(spark, sf_dir):
    out = metrics.precision_recall_steps(scored(spark, sf_dir), MODEL, "score", "truth")
    return rounded(out.select("model", "score", "tp", "fp", "precision", "recall"), 9, "precision", "recall")


@query("average_precision", f"""
WITH {PR_SQL} SELECT model, coalesce(round(sum(pos * tp / (tp + fp)) / nullif(max(n_pos), 0), 9), 0.0) AS average_precision
FROM cu GROUP BY model""")
def average_precision(spark, sf_dir):
    return rounded(metrics.average_precision(scored(spark, sf_dir), MODEL, "score", "truth"), 9, "average_precision")


@query("roc_auc", f"""
WITH {SCORED_SQL},
rk AS (SELECT model, truth, rank() OVER (PARTITION BY model ORDER BY score)
              + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0 AS r FROM kn)
SELECT model, round((sum(r) FILTER (truth = 1) - count(*) FILTER (truth = 1) * (count(*) FILTER (truth = 1) + 1) / 2.0)
       / nullif(count(*) FILTER (truth = 1) * count(*) FILTER (truth = 0), 0), 9) AS roc_auc FROM rk GROUP BY model""")
def roc_auc(spark, sf_dir):
    return rounded(metrics.roc_auc(scored(spark, sf_dir), MODEL, "score", "truth"), 9, "roc_auc")


SWEEP_SQL = f"""{SCORED_SQL},
sp AS (SELECT model, min(score) AS lo, max(score) AS hi FROM kn GROUP BY model),
th AS (SELECT model, i AS threshold_index, CASE WHEN i = 999 THEN hi ELSE lo + i * ((hi - lo) / 999) END AS threshold
       FROM sp, range(0, 1000) AS r(i)),
sw AS (SELECT th.model, threshold_index, threshold,
              count(*) FILTER (truth = 1 AND score >= threshold) AS tp,
              count(*) FILTER (truth = 0 AND score >= threshold) AS fp,
              count(*) FILTER (truth = 1 AND score < threshold) AS fn,
              count(*) FILTER (truth = 0 AND score < threshold) AS tn
       FROM th JOIN kn ON th.model = kn.model GROUP BY th.model, threshold_index, threshold),
sr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall,
              coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1 FROM sw)"""
SWEEP_OUT = """model, threshold_index, round(threshold, 7) + 0.0 AS threshold, tp, fp, fn, tn,
       round(precision, 9) + 0.0 AS precision, round(recall, 9) + 0.0 AS recall, round(f1, 9) + 0.0 AS f1"""


def _sweep(spark, sf_dir):
    return metrics.threshold_sweep(scored(spark, sf_dir), MODEL, "score", "truth")


@query("threshold_sweep", f"WITH {SWEEP_SQL} SELECT {SWEEP_OUT} FROM sr")
def threshold_sweep(spark, sf_dir):
    return rounded(rounded(_sweep(spark, sf_dir), 9, "precision", "recall", "f1"), 7, "threshold")


@query("best_threshold", f"""
WITH {SWEEP_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold_index) AS rn FROM sr)
SELECT {SWEEP_OUT} FROM b WHERE rn = 1""")
def best_threshold(spark, sf_dir):
    out = metrics.best_thresholds(_sweep(spark, sf_dir), MODEL)
    return rounded(rounded(out, 9, "precision", "recall", "f1"), 7, "threshold")


@query("frozen_evaluation", f"""
WITH {SWEEP_SQL},
b AS (SELECT model, threshold FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold_index) AS rn
      FROM sr) WHERE rn = 1),
pr AS (SELECT kn.model, truth, lang, CASE WHEN score >= threshold THEN 1 ELSE 0 END AS prediction FROM kn JOIN b ON kn.model = b.model)
SELECT model, lang, count(*) AS n_test, count(*) FILTER (truth = 1) AS n_anomalies,
       count(*) FILTER (truth = 1 AND prediction = 1) AS tp, count(*) FILTER (truth = 0 AND prediction = 1) AS fp
FROM pr GROUP BY model, lang""")
def frozen_evaluation(spark, sf_dir):
    """Best threshold of each model frozen and applied to every row, counted per language."""
    frozen = metrics.best_thresholds(_sweep(spark, sf_dir), MODEL)
    predicted = metrics.apply_thresholds(scored(spark, sf_dir), frozen, MODEL, "score")
    return metrics.confusion(predicted, ["model", "lang"], "truth", "prediction").select(
        "model", "lang", "n_test", "n_anomalies", "tp", "fp")


# ---- experiment classes and splits -------------------------------------------------------------------------------

# Labels per entity: a third of the suppliers keeps all labels, in a third 2 becomes 1, in a third all become 0.
ENTITY_SQL = f"""{windows_sql()},
fw AS (SELECT entity, "window", CASE entity % 3 WHEN 0 THEN label WHEN 1 THEN least(label, 1) ELSE 0 END AS label,
              status FROM w WHERE position = 0),
ec AS (SELECT entity, arg_min(status, "window") AS status, list_sort(list(DISTINCT label)) AS labels,
              CASE WHEN bool_or(label IN (2, 3)) THEN 'observable' WHEN bool_or(label = 1) THEN 'unobservable'
                   ELSE 'normal' END AS experiment_class FROM fw GROUP BY entity),
en AS (SELECT ec.*, s_nationkey AS nation, n_regionkey AS region FROM ec JOIN supplier ON s_suppkey = entity
       JOIN nation ON n_nationkey = s_nationkey)"""


def classes(spark, sf_dir):
    first = ft.window_metadata(windowed(spark, sf_dir), KEYS, ["status"], label="label", size=SIZE)
    group, label = F.col("entity") % 3, F.col("label")
    marked = first.withColumn(
        "label", F.when(group == 0, label).when(group == 1, F.least(label, F.lit(1))).otherwise(0))
    return split.entity_classes(marked, "entity", "label", ["status"])


def entities(spark, sf_dir):
    """Entity classes with their process context (nation and region of the supplier)."""
    context = load(spark, sf_dir, "supplier").join(
        load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    return classes(spark, sf_dir).join(context, "entity")


@query("entity_classes", f"""
WITH {ENTITY_SQL} SELECT entity, status, array_to_string(labels, ',') AS labels, experiment_class FROM ec""")
def entity_classes(spark, sf_dir):
    out = classes(spark, sf_dir)
    return out.withColumn("labels", F.array_join(F.col("labels").cast("array<string>"), ","))


GROUPS = ["nation", "region"]

SPLIT_SQL = f"""{ENTITY_SQL},
sz AS (SELECT nation, region, count(*) AS n_entities FROM en WHERE experiment_class = 'observable' GROUP BY nation, region),
dr AS (SELECT sz.*, CAST(seed AS INTEGER) AS seed,
              row_number() OVER (PARTITION BY seed ORDER BY md5(seed || '|' || nation || '|' || region), nation, region) AS rk,
              count(*) OVER (PARTITION BY seed) AS g FROM sz, range(0, 1000) AS r(seed)),
sd AS (SELECT *, CASE WHEN rk <= g // 2 THEN 'validation' ELSE 'final_test' END AS side FROM dr),
gp AS (SELECT seed, abs(sum(CASE WHEN side = 'validation' THEN n_entities ELSE -n_entities END)) AS gap FROM sd GROUP BY seed),
be AS (SELECT seed FROM gp ORDER BY gap, seed LIMIT 1),
si AS (SELECT nation, region, n_entities, seed, side FROM sd WHERE seed = (SELECT seed FROM be)),
sp AS (SELECT en.entity, en.nation, en.region, en.experiment_class,
              CASE experiment_class WHEN 'normal' THEN 'train' WHEN 'unobservable' THEN 'excluded' ELSE side END AS split
       FROM en LEFT JOIN si ON en.nation = si.nation AND en.region = si.region)"""


def sides(spark, sf_dir):
    observable = entities(spark, sf_dir).filter("experiment_class = 'observable'")
    return split.balanced_group_split(observable, GROUPS)


@query("balanced_group_split", f"WITH {SPLIT_SQL} SELECT * FROM si")
def balanced_group_split(spark, sf_dir):
    return sides(spark, sf_dir)


def experiment_split(spark, sf_dir):
    return split.assign_by_group(entities(spark, sf_dir), sides(spark, sf_dir), GROUPS).select(
        "entity", "nation", "region", "experiment_class", "split")


@query("experiment_split", f"WITH {SPLIT_SQL} SELECT * FROM sp")
def experiment_split_query(spark, sf_dir):
    return experiment_split(spark, sf_dir)


@query("split_violations", f"""
WITH {SPLIT_SQL}, broken AS (SELECT entity, nation, region, experiment_class,
       CASE WHEN entity % 10 = 0 THEN 'train' WHEN entity % 10 = 1 THEN 'final_test' ELSE split END AS split
       FROM sp WHERE entity % 7 <> 0)
SELECT rule, count(*) AS n FROM (
  SELECT 'normal not in train' AS rule FROM broken WHERE experiment_class = 'normal' AND split <> 'train'
  UNION ALL SELECT 'unobservable not excluded' FROM broken WHERE experiment_class = 'unobservable' AND split <> 'excluded'
  UNION ALL SELECT 'observable outside evaluation' FROM broken
            WHERE experiment_class = 'observable' AND split NOT IN ('validation', 'final_test')
  UNION ALL SELECT 'group in both sides' FROM (SELECT nation, region FROM broken WHERE split IN ('validation', 'final_test')
            GROUP BY nation, region HAVING count(DISTINCT split) > 1)
  UNION ALL SELECT 'entity missing' FROM sp WHERE entity % 7 = 0) GROUP BY rule""")
def split_violations(spark, sf_dir):
    """A sound split damaged on purpose; counts every broken rule."""
    sound = pin(experiment_split(spark, sf_dir))
    e = F.col("entity") % 10
    broken = sound.filter(F.col("entity") % 7 != 0).withColumn(
        "split", F.when(e == 0, "train").when(e == 1, "final_test").otherwise(F.col("split")))
    found = split.split_violations(broken, sound, "entity", GROUPS)
    return found.groupBy("rule").agg(F.count("*").alias("n"))


@query("split_counts", f"""
WITH {SPLIT_SQL}
SELECT split, experiment_class, count(*) AS n_entities, count(DISTINCT (nation, region)) AS n_groups
FROM sp GROUP BY split, experiment_class""")
def split_counts(spark, sf_dir):
    per_group = experiment_split(spark, sf_dir).groupBy("split", "experiment_class", *GROUPS).agg(F.count("*").alias("n"))
    return per_group.groupBy("split", "experiment_class").agg(
        F.sum("n").alias("n_entities"), F.count("*").alias("n_groups"))


# ---- profiles ------------------------------------------------------------------------------------------------------


@query("value_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n_rows FROM lineitem GROUP BY ALL")
def value_counts(spark, sf_dir):
    return profile.value_counts(load(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query("distinct_counts", """
SELECT count(DISTINCT l_suppkey) AS n_entities, count(DISTINCT (l_suppkey, l_shipdate)) AS n_entity_days,
       count(DISTINCT l_returnflag) AS n_labels FROM lineitem""")
def distinct_counts(spark, sf_dir):
    return profile.distinct_counts(load(spark, sf_dir, "lineitem"), n_entities=["l_suppkey"],
                                   n_entity_days=["l_suppkey", "l_shipdate"], n_labels=["l_returnflag"])


@query("missing_profile", """
WITH x AS (SELECT d.doc_id, d.lang, l.quality, CAST(d.n_chars AS DOUBLE) / nullif(d.n_chars % 5, 0) AS ratio, d.n_chars
           FROM documents d LEFT JOIN labels l USING (doc_id)),
c AS (SELECT 'lang' AS "column", count(*) AS n_rows, count(*) - count(lang) AS n_missing, 0::BIGINT AS n_infinite FROM x
      UNION ALL SELECT 'quality', count(*), count(*) - count(quality), 0 FROM x
      UNION ALL SELECT 'ratio', count(*), count(*) - count(ratio), 0 FROM x
      UNION ALL SELECT 'odd', count(*), count(*) - count(ratio),
        count(*) FILTER (n_chars % 5 <> 0 AND (n_chars % 7 = 0 OR n_chars % 11 = 0)) FROM x)
SELECT *, round(n_missing / n_rows, 9) AS missing_fraction FROM c""")
def missing_profile(spark, sf_dir):
    df = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left").withColumn(
        "ratio", F.try_divide(F.col("n_chars").cast("double"), F.col("n_chars") % 5))
    # Infinities of both signs, planted where the ratio is known.
    odd = F.when(F.col("n_chars") % 7 == 0, float("inf")).when(F.col("n_chars") % 11 == 0, float("-inf")).otherwise(1.0)
    df = df.withColumn("odd", F.when(F.col("ratio").isNotNull(), odd))
    return rounded(profile.missing_profile(df, ["lang", "quality", "ratio", "odd"]), 9, "missing_fraction")


@query("duplicate_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(spark, sf_dir):
    return joins.duplicate_keys(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("duplicate_count", """
SELECT CAST(count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS BIGINT) AS n_duplicates FROM lineitem""")
def duplicate_count(spark, sf_dir):
    return joins.duplicate_count(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def _summary_sql(c):
    return f"""SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 7) + 0.0 AS mean,
       round(stddev_samp({c}), 7) + 0.0 AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
       round(quantile_cont({c}, 0.25), 7) + 0.0 AS q25, round(quantile_cont({c}, 0.5), 7) + 0.0 AS q50,
       round(quantile_cont({c}, 0.75), 7) + 0.0 AS q75 FROM s"""


@query("column_summary", "WITH s AS (SELECT l_quantity AS quantity, l_extendedprice / 1000 AS price, l_discount AS discount, "
       "l_tax AS tax FROM lineitem) " + " UNION ALL ".join(_summary_sql(c) for c in SIGNALS))
def column_summary(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").count()
    out = profile.column_summary(series(spark, sf_dir), SIGNALS, at_most=rows)
    return rounded(out, 7, "mean", "std", "q25", "q50", "q75")


@query("feature_medians", _exact(WIDE_CTE) + "\n" + " UNION ALL ".join(f"SELECT '{n}' AS feature, round(median({n}), 7) + 0.0 AS median FROM wide" for n in WIDE_NAMES))
def feature_medians(spark, sf_dir):
    windows = load(spark, sf_dir, "lineitem").count() // SIZE
    return rounded(profile.medians(wide_features(spark, sf_dir), WIDE_NAMES, at_most=windows), 7, "median")


IMPUTED = ["quantity_mean_prev", "price_mean_prev", "price_std_prev"]


@query("median_impute", f"""
WITH {windows_sql()}, {_exact(STATS_SQL)},
wd AS (SELECT entity, "window", max(mean) FILTER (signal = 'quantity') AS quantity_mean,
              max(mean) FILTER (signal = 'price') AS price_mean, max(std) FILTER (signal = 'price') AS price_std
       FROM st GROUP BY entity, "window"),
lg AS (SELECT entity, "window", lag(quantity_mean) OVER e AS quantity_mean_prev, lag(price_mean) OVER e AS price_mean_prev,
              lag(price_std) OVER e AS price_std_prev FROM wd WINDOW e AS (PARTITION BY entity ORDER BY "window")),
md AS (SELECT median(quantity_mean_prev) AS q, median(price_mean_prev) AS p, median(price_std_prev) AS s
       FROM lg WHERE entity % 3 <> 0)
SELECT entity, "window", round(coalesce(quantity_mean_prev, q), 7) + 0.0 AS quantity_mean_prev,
       round(coalesce(price_mean_prev, p), 7) + 0.0 AS price_mean_prev,
       round(coalesce(price_std_prev, s), 7) + 0.0 AS price_std_prev FROM lg, md""")
def median_impute(spark, sf_dir):
    """Previous-window features; the missing first windows are filled with the medians of the training entities.

    A feature that is missing in more than 95 % of the training rows is planted and must be dropped.
    """
    base = ["quantity_mean", "price_mean", "price_std"]
    rare = F.when((F.col("window") == 1) & (F.col("entity") % 5 == 1), F.col("price_mean_prev"))
    temporal = temporal_table(spark, sf_dir, base).withColumn("rare", rare)
    train = temporal.filter(F.col("entity") % 3 != 0)
    kept = profile.kept_features(train, [*IMPUTED, "rare"])
    out = profile.impute(temporal.select("entity", "window", *kept), profile.medians(train, kept), kept)
    return rounded(out, 7, *kept)


@query("window_report", f"""
WITH {windows_sql()}, f AS (SELECT entity, "window", CASE WHEN label = 0 THEN 0 WHEN label IN (2, 3) THEN 1 END AS target
                            FROM w WHERE position = 0)
SELECT count(DISTINCT entity) AS n_entities, count(*) AS n_windows, CAST(0 AS BIGINT) AS n_duplicates,
       count(*) - count(target) AS n_missing_target, count(*) FILTER (target = 1) AS n_positive,
       count(*) - count(target) AS n_missing_cells FROM f""")
def window_report(spark, sf_dir):
    first = ft.window_metadata(windowed(spark, sf_dir), KEYS, ["status"], label="label", size=SIZE)
    return profile.window_report(first, KEYS, ["status", "target"], "target")


@query("temporal_violations", f"""
WITH {windows_sql()}, f AS (SELECT entity, max("window") AS last FROM w GROUP BY entity)
SELECT 'entities' AS item, count(*) AS n FROM f
UNION ALL SELECT 'violations', count(*) FILTER ((entity % 10 = 0 AND last >= 1) OR entity % 10 = 1) FROM f""")
def temporal_violations(spark, sf_dir):
    """Sound temporal features damaged on purpose: a second window without history, a first window with some."""
    base = ["quantity_mean", "price_mean"]
    temporal = temporal_table(spark, sf_dir, base)
    e, w = F.col("entity") % 10, F.col("window")
    names = [f"{b}_{s}" for b in base for s in ("prev", "delta")]
    broken = temporal.withColumns({
        c: F.when((e == 0) & (w == 1), F.lit(None)).when((e == 1) & (w == 0), F.lit(1.0)).otherwise(F.col(c)) for c in names})
    bad = profile.temporal_violations(broken, KEYS, base).agg(F.lit("violations").alias("item"), F.count("*").alias("n"))
    known = temporal.groupBy("entity").count().agg(F.lit("entities").alias("item"), F.count("*").alias("n"))
    return known.unionByName(bad)


@query("temporal_report", f"""
WITH {windows_sql()}, f AS (SELECT entity, "window", CASE WHEN label = 0 THEN 0 WHEN label IN (2, 3) THEN 1 END AS target
                            FROM w WHERE position = 0)
SELECT count(DISTINCT entity) AS n_entities, count(*) AS n_windows, CAST(0 AS BIGINT) AS n_duplicates,
       count(*) - count(target) AS n_missing_target, count(*) FILTER (target = 1) AS n_positive,
       4 * count(DISTINCT entity) AS n_missing_cells FROM f""")
def temporal_report(spark, sf_dir):
    """The validation report on real features: only first windows lack their four temporal values."""
    base = ["quantity_mean", "price_mean"]
    names = [f"{b}_{s}" for b in base for s in ("prev", "delta")]
    first = ft.window_metadata(windowed(spark, sf_dir), KEYS, ["status"], label="label", size=SIZE)
    table = joins.checked_join(first.select("entity", "window", "target"), temporal_table(spark, sf_dir, base),
                               ["entity", "window"], "inner", "one_to_one")
    profile.validate_count(names, 2 * len(base), "temporal")
    return profile.window_report(table, KEYS, names, "target")


@query("dataset_summary", f"""
WITH {SPLIT_SQL},
ws AS (SELECT w.entity, w."window", sp.split, CASE WHEN w.label = 1 THEN 1 END AS rare FROM w JOIN sp ON sp.entity = w.entity WHERE position = 0)
SELECT 'windows' AS model, count(*) AS n_rows, 2 AS n_features, count(*) FILTER (split = 'train') AS n_train,
       count(*) FILTER (split = 'validation') AS n_validation, count(*) FILTER (split = 'final_test') AS n_final_test,
       CASE WHEN avg(CASE WHEN rare IS NULL THEN 1.0 ELSE 0.0 END) > 0.5 THEN 1 ELSE 0 END AS n_high_missing FROM ws
UNION ALL SELECT 'entities', count(*), 1, count(*) FILTER (split = 'train'), count(*) FILTER (split = 'validation'),
       count(*) FILTER (split = 'final_test'), 0 FROM sp""")
def dataset_summary(spark, sf_dir):
    parts = experiment_split(spark, sf_dir)
    first = ft.window_metadata(windowed(spark, sf_dir), KEYS, ["status"], label="label", size=SIZE)
    windows = first.join(parts.select("entity", "split"), "entity").withColumn("rare", F.when(F.col("label") == 1, 1))
    return profile.dataset_summary(
        {"windows": windows, "entities": parts}, {"windows": ["status", "rare"], "entities": ["experiment_class"]},
        "split", ["train", "validation", "final_test"], 0.5)


@query("label_set_overlap", f"""
WITH {ENTITY_SQL} SELECT entity, coalesce(list_has_any(labels, [2, 3]), false) AS observable FROM ec""")
def label_set_overlap(spark, sf_dir):
    """Entities whose label set meets the observable labels."""
    out = classes(spark, sf_dir)
    return out.select("entity", split.class_set_overlap(F.col("labels"), F.array(F.lit(2), F.lit(3))).alias("observable"))
