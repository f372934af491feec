"""Forest fits and the full model study over the driver tables.

The forests draw by md5, so recursive SQL grows and walks the same trees.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmith.operators import features as ft
from seriesmith.operators import forest as fo
from seriesmith.operators import joins, study
from seriesmith.operators.model_grid import presentation_order, validation_against_final
from seriesmith.plans.bindings import KEYS, SIGNALS, SIZE, windowed
from seriesmith.plans.evaluation_queries import SPLIT_SQL, experiment_split
from seriesmith.plans.registry import load, query
from seriesmith.plans.window_queries import FREQ_NAMES, RAW_CELLS, TEMPORAL_NAMES, WIDE_NAMES, complete, ml_table
from seriesmith.session import pin, scratch_path, store
from seriesmith.sources.files import read_table

WINDOW = ["entity", "window"]
TARGET = "observable_anomaly"


def _embeddings(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))


def forest_sql(trees: int, size: str, share: float, seed: int = 42, d: int = 64) -> str:
    """CTEs ``e`` (vectors) and ``nodes`` of the forest over the embeddings, grown level by level.

    ``size`` is SQL for the sub-sample size. The operator looks at all features of a node after eight constant draws;
    no node of these continuous vectors comes to that, so the eight draws are all that is written here.
    """
    attempts = range(fo.ATTEMPTS)

    def digits(text: str, start: str) -> str:
        return f"('0x' || substr(md5({text}), {start}, 13))::BIGINT / 4503599627370496.0"

    def decided(source: str) -> str:
        """Rows of ``source`` (tree, node, depth, vec_id) with their node's size n, feature f (null: leaf) and cut."""
        node = f"'{seed}:node:' || g.tree || ':' || g.node || ':' ||"
        drawn = ", ".join(f"subset[1 + CAST(floor({digits(f'{node} {k}', '14')} * len(subset)) AS BIGINT)] AS f{k}" for k in attempts)
        spans = ", ".join(f"min(vec[f{k} + 1]) OVER w AS l{k}, max(vec[f{k} + 1]) OVER w AS h{k}" for k in attempts)
        first = " ".join(f"WHEN l{k} < h{k} THEN {{{k}}}" for k in attempts)
        pick = lambda c: "CASE " + first.format(*[f"{c}{k}" for k in attempts]) + " END"
        return f"""(
  SELECT tree, node, depth, vec_id, vec, n, f, CASE WHEN low + u * (high - low) >= high THEN low ELSE low + u * (high - low) END AS cut
  FROM (SELECT *, CASE WHEN n > 1 AND depth < most THEN {pick('f')} END AS f, {pick('l')} AS low, {pick('h')} AS high FROM (
    SELECT *, count(*) OVER w AS n, {spans} FROM (
      SELECT g.*, e.vec, z.most, {digits(f"{node} 0", '1')} AS u, {drawn}
      FROM {source} g JOIN e ON e.vec_id = g.vec_id JOIN fs ON fs.tree = g.tree, z
    ) WINDOW w AS (PARTITION BY tree, node))))"""

    return f"""WITH RECURSIVE
e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings),
z AS (SELECT size, greatest(1, CAST(ceil(log2(greatest(size, 2))) AS INTEGER)) AS most FROM (SELECT {size} AS size FROM e)),
t AS (SELECT CAST(unnest(range({trees})) AS INTEGER) AS tree),
s AS (SELECT tree, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY u) AS place FROM (
  SELECT tree, vec_id, {digits(f"'{seed}:row:' || (tree // 2) || ':' || vec_id", '1 + 13 * (tree % 2)')} AS u FROM e, t)), z
  WHERE place <= size),
fs AS (SELECT tree, list(feature ORDER BY feature) AS subset FROM (
  SELECT tree, feature, row_number() OVER (PARTITION BY tree ORDER BY md5('{seed}:feature:' || tree || ':' || feature)) AS place
  FROM t, (SELECT unnest(range({d})) AS feature)) WHERE place <= {max(1, int(share * d))} GROUP BY tree),
g AS (
  SELECT tree, CAST(1 AS BIGINT) AS node, 0 AS depth, vec_id FROM s
  UNION ALL
  SELECT tree, 2 * node + CAST(vec[f + 1] > cut AS INTEGER), depth + 1, vec_id FROM {decided('g')} WHERE f IS NOT NULL
),
nodes AS (
  SELECT DISTINCT tree, node, depth, coalesce(f, -1) AS feature, CASE WHEN f IS NOT NULL THEN cut END AS threshold, n AS size,
    CASE WHEN f IS NULL THEN depth + CASE WHEN n > 2 THEN 2 * (ln(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
                                          WHEN n = 2 THEN 1.0 ELSE 0.0 END END AS path
  FROM {decided('g')}
)"""


@query("isolation_forest_scores", f"""{forest_sql(300, 'least(256, count(*))', 1.0)},
k AS (
  SELECT tree, vec_id, CAST(1 AS BIGINT) AS node FROM e, t
  UNION ALL
  SELECT k.tree, k.vec_id, 2 * k.node + CAST(vec[feature + 1] > threshold AS INTEGER)
  FROM k JOIN nodes ON nodes.tree = k.tree AND nodes.node = k.node AND feature >= 0 JOIN e ON e.vec_id = k.vec_id
), sc AS (
  SELECT vec_id, pow(2.0, -avg(path) / any_value(2 * (ln(size_ - 1) + 0.5772156649015329) - 2 * (size_ - 1) / size_)) AS score
  FROM k JOIN nodes ON nodes.tree = k.tree AND nodes.node = k.node AND feature < 0, (SELECT size AS size_ FROM z) GROUP BY vec_id
)
SELECT vec_id, round(score, 9) AS score, round(score - 0.5, 9) AS decision, CAST(score > 0.5 AS INTEGER) AS prediction FROM sc""")
def isolation_forest_scores(spark, sf_dir):
    """Default forest over all embedding vectors with the default decision."""
    packed = _embeddings(spark, sf_dir)
    fitted = fo.fit_forests(packed, ["vec_id"], [fo.ForestSpec()])
    return fo.default_prediction(fo.score_forests(packed, fitted)).select(
        "vec_id", F.round("score", 9).alias("score"), F.round("decision", 9).alias("decision"), "prediction")


@query("isolation_forest_nodes", f"""{forest_sql(50, 'count(*) // 2', 0.5)}
SELECT 0 AS spec, tree, node, depth, CAST(feature AS INTEGER) AS feature, round(threshold, 12) AS threshold, size,
  round(path, 9) AS path FROM nodes""")
def isolation_forest_nodes(spark, sf_dir):
    """The fitted forest as a table of nodes, with a fractional sub-sample and feature share."""
    nodes = fo.fit_forests(_embeddings(spark, sf_dir), ["vec_id"], [fo.ForestSpec(50, "0.5", "0.5")]).nodes
    return nodes.withColumns({"threshold": F.round("threshold", 12), "path": F.round("path", 9)})


def datasets(spark, sf_dir):
    """The four window representations of the line-item series, each with split, target and window bounds."""
    first = ft.window_metadata(windowed(spark, sf_dir), KEYS, ["status"], label="label", size=SIZE)
    meta = pin(first.join(experiment_split(spark, sf_dir).select("entity", "split"), "entity").select(
        "entity", "window", F.col("label").alias("anomaly_label"), F.col("target").alias(TARGET), "split",
        (F.col("window") * SIZE).alias("window_start"), ((F.col("window") + 1) * SIZE).alias("window_end")))
    # The ML table holds the other feature sets' columns, so it is computed, joined and written once and cut.
    wide = joins.checked_join(meta, store(ml_table(spark, sf_dir), "wide"), WINDOW, "inner", "one_to_one")
    raw = joins.checked_join(meta, store(ft.raw_windows(complete(spark, sf_dir), KEYS, SIGNALS, SIZE), "raw"), WINDOW,
                             "inner", "one_to_one")
    tables = {"raw": store(raw, "raw-windows"), "wide": store(wide, "wide-windows")}
    columns = {
        "raw_window": ("raw", [n for _, _, n in RAW_CELLS]),
        "window_features": ("wide", WIDE_NAMES),
        "temporal_features": ("wide", TEMPORAL_NAMES),
        "ml_features": ("wide", [*TEMPORAL_NAMES, *FREQ_NAMES]),
    }
    return {n: study.Dataset(tables[t].select(*meta.columns, *f), f) for n, (t, f) in columns.items()}


KEEP = ["anomaly_label", "window_start", "window_end"]
RESULTS = ["default_results", "hyperparameter_results", "best_configurations", "threshold_results",
           "final_test_results", "window_predictions"]
_WRITTEN: dict[tuple, str] = {}


def _input_state(spark, sf_dir) -> tuple:
    """Names, sizes and times of the input files; their contents are not read."""
    rows = []
    for table in ("lineitem", "supplier", "nation"):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{sf_dir}/{table}.parquet")
        rows += files.select("path", "modificationTime", "length").collect()
    return tuple(sorted(map(str, rows)))


def full_study(spark, sf_dir):
    """The study's result tables, written once for each state of the input files and read back."""
    key = (spark.sparkContext.applicationId, _input_state(spark, sf_dir))
    if key not in _WRITTEN:
        folder = scratch_path(spark, "study")
        study.write_results(study.run_study(datasets(spark, sf_dir), WINDOW, TARGET, KEEP), folder)
        _WRITTEN[key] = folder
    return {n: read_table(spark, f"{_WRITTEN[key]}/{n}") for n in RESULTS}


MODELS = ["raw_window", "window_features", "temporal_features", "ml_features"]


@query("default_models")
def default_models(spark, sf_dir):
    return full_study(spark, sf_dir)["default_results"]


@query("grid_search")
def grid_search(spark, sf_dir):
    """All parameter combinations of all four representations."""
    return full_study(spark, sf_dir)["hyperparameter_results"]


@query("best_configurations")
def best_configurations(spark, sf_dir):
    return presentation_order(full_study(spark, sf_dir)["best_configurations"], "model", MODELS)


@query("model_thresholds")
def model_thresholds(spark, sf_dir):
    return full_study(spark, sf_dir)["threshold_results"]


@query("final_evaluation")
def final_evaluation(spark, sf_dir):
    return full_study(spark, sf_dir)["final_test_results"]


@query("window_predictions")
def window_predictions(spark, sf_dir):
    return full_study(spark, sf_dir)["window_predictions"]


@query("validation_against_final")
def validation_and_final(spark, sf_dir):
    tables = full_study(spark, sf_dir)
    validation = tables["threshold_results"].join(tables["best_configurations"].select("model", "AUPRC"), "model")
    return validation_against_final(validation, tables["final_test_results"])


@query("error_types")
def error_types(spark, sf_dir):
    return study.error_types(full_study(spark, sf_dir)["window_predictions"], TARGET)


# ---- what is exact in the study, against SQL -----------------------------------------------------------------------

STUDY_SQL = f"""{SPLIT_SQL},
sw AS (SELECT w.entity, w."window", w.label AS anomaly_label, CASE w.label WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 1 END AS target,
              sp.split FROM w JOIN sp ON sp.entity = w.entity WHERE w.position = 0),
mo AS (SELECT unnest(['raw_window', 'window_features', 'temporal_features', 'ml_features']) AS model)"""


@query("study_grid", f"""
WITH {STUDY_SQL},
g AS (SELECT n.v AS n_estimators, s.v AS max_samples, f.v AS max_features,
        CAST((n.i - 1) * 12 + (s.i - 1) * 3 + f.i AS INTEGER) AS run
      FROM (SELECT unnest([200, 300, 500]) AS v, unnest([1, 2, 3]) AS i) n,
           (SELECT unnest(['auto', '0.5', '0.75', '1.0']) AS v, unnest([1, 2, 3, 4]) AS i) s,
           (SELECT unnest(['0.5', '0.75', '1.0']) AS v, unnest([1, 2, 3]) AS i) f)
SELECT model, run, n_estimators, max_samples, max_features, (SELECT count(*) FROM sw WHERE split = 'train' AND target = 0) AS n_train,
       (SELECT count(*) FROM sw WHERE split = 'validation' AND target IS NOT NULL) AS n_validation
FROM mo, g""")
def study_grid(spark, sf_dir):
    """Every searched setting of every representation with the sizes of its sets."""
    return full_study(spark, sf_dir)["hyperparameter_results"].select(
        "model", "run", "n_estimators", "max_samples", "max_features", "n_train", "n_validation")


@query("study_predictions", f"""
WITH {STUDY_SQL}
SELECT model, entity, "window", "window" * 60 AS window_start, ("window" + 1) * 60 AS window_end, anomaly_label, target
FROM sw, mo WHERE split = 'final_test' AND target IS NOT NULL""")
def study_predictions(spark, sf_dir):
    """Windows that are predicted, with their bounds and labels."""
    return full_study(spark, sf_dir)["window_predictions"].select(
        "model", *WINDOW, "window_start", "window_end", "anomaly_label", F.col(TARGET).alias("target"))


@query("study_totals", f"""
WITH {STUDY_SQL}
SELECT model, count(*) AS n_test, CAST(sum(target) AS BIGINT) AS n_anomalies, count(*) AS outcomes
FROM sw, mo WHERE split = 'final_test' AND target IS NOT NULL GROUP BY model""")
def study_totals(spark, sf_dir):
    """Sizes of the final evaluation; the four outcomes add up to the windows."""
    return full_study(spark, sf_dir)["final_test_results"].select(
        "model", "n_test", "n_anomalies", (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("outcomes"))
