from pyspark.sql import functions as F

from seriesmith.functions.expressions import seconds_of_day, split_identifier
from seriesmith.operators import pipeline
from seriesmith.sources import files

FOLDER = "Operation/batch_dist_binary_ethanol+propan-2-ol/operating_point_001"
NAMES = ["heat", "flow"]


def write(root, kind, header, lines, number="001"):
    folder = root / files.MODALITIES[kind] / FOLDER
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"train_normal_experiment_{number}.csv").write_text("\n".join([header, *lines]) + "\n")


def clock(seconds):
    return f"{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"


def plant(root, rows, jump):
    """A series of one row a second whose clock is set back to zero at row ``jump``."""
    times = [clock(i + 50000 if i < jump else i) for i in range(rows)]
    write(root, "labels", "Time,Label (anomaly)", [f"{t},{2 if i >= 120 else 0}" for i, t in enumerate(times) if i != 0])
    write(root, "sensors", "Time,heat", [f"{t},{i}" for i, t in enumerate(times)])
    write(root, "actuators", "flow,Time", [f"{i % 7},{t}" for i, t in enumerate(times)])


def test_rows_follow_the_file_and_windows_its_elapsed_time(spark, tmp_path):
    plant(tmp_path, 245, 59)
    joined = pipeline.join_in_file_order(
        files.read_modalities(spark, str(tmp_path)), seconds_of_day(F.col("Time")), F.lit(True))
    by_heat = {int(r["heat"]): int(r["elapsed_time"]) for r in joined.collect()}
    assert by_heat == {i: i if i < 59 else i - 1 for i in range(245)}

    ml = pipeline.ml_table(split_identifier(joined), NAMES, ["flow"], NAMES, [("heat", "flow")], metadata=["experiment"])
    rows = {r["window"]: r for r in ml.collect()}
    assert sorted(rows) == [1, 2, 3]  # 61 rows in the first minute, 4 in the last
    assert [rows[w]["target"] for w in (1, 2, 3)] == [0, 1, 1]
    assert rows[1]["heat_min"] == 61 and rows[1]["heat_mean_prev"] is None and rows[2]["heat_mean_delta"] == 60
    assert abs(rows[3]["heat_slope"] - 1) < 1e-9 and rows[1]["experiment"] == "experiment_001"


def test_rows_of_equal_elapsed_time_keep_the_order_of_the_file(spark, tmp_path):
    plant(tmp_path, 60, 30)
    joined = pipeline.join_in_file_order(
        files.read_modalities(spark, str(tmp_path)), seconds_of_day(F.col("Time")), F.lit(True))
    (row,) = pipeline.ml_table(split_identifier(joined), NAMES, metadata=["experiment"]).collect()
    assert abs(row["heat_slope"] - 1) < 1e-9 and row["window"] == 0


def test_series_without_a_complete_window(spark, tmp_path):
    plant(tmp_path, 30, 5)
    joined = pipeline.join_in_file_order(files.read_modalities(spark, str(tmp_path)), seconds_of_day(F.col("Time")))
    assert pipeline.ml_table(split_identifier(joined), NAMES, metadata=["experiment"]).count() == 0


def test_ordered_files_hold_one_series_each(spark, tmp_path):
    df = spark.range(500).select((F.col("id") % 3).alias("part"), (-F.col("id")).alias("x"))
    files.write_series(df.repartition(7), str(tmp_path / "s"), ["part"], order=["x"])
    for folder in (tmp_path / "s").glob("part=*"):
        (file,) = folder.glob("*.csv")
        values = [int(v) for v in file.read_text().split()[1:]]
        assert values == sorted(values) and len(values) in (166, 167)


def test_times_of_a_series_longer_than_a_day_occur_once(spark, tmp_path):
    from seriesmith.functions.expressions import seconds_of_clock
    from seriesmith.plans.contract_queries import write_plant

    n = F.col("id")
    spark.range(90_000).select(
        n.alias("l_orderkey"), (n % 6 + 1).cast("int").alias("l_linenumber"), n.alias("l_partkey"), F.lit(0).cast("long").alias("l_suppkey"),
        F.lit("1995-01-01").cast("timestamp").alias("l_shipdate"), F.lit(0.1).alias("l_discount"), F.lit(0.2).alias("l_tax"),
        F.lit(9.5).alias("l_extendedprice"), F.lit(1.0).alias("l_quantity"), F.lit("N").alias("l_returnflag"),
        F.lit("O").alias("l_linestatus")).write.parquet(str(tmp_path / "lineitem.parquet"))
    write_plant(spark, str(tmp_path), str(tmp_path / "plant"))
    for kind in files.MODALITIES.values():
        back = files.read_series(spark, str(tmp_path / "plant" / kind))
        assert back.select("Time").distinct().count() == 90_000
        steps = {r["s"] - r["r"]: r["n"] for r in back.withColumn("s", seconds_of_clock(F.col("Time"))).groupBy(
            (F.col("s") - F.col("r")).alias("ahead")).agg(F.count("*").alias("n"), F.min("s").alias("s"), F.min("r").alias("r")).collect()}
        assert steps == {90_000: 130, 0: 89_870}


def test_clock_beyond_a_day(spark):
    from seriesmith.functions.expressions import seconds_of_clock

    texts = ["00:00:05", "23:59:59", "25:00:01", "277:00:00", "1:2", "a:00:00", "-1:00:00", "00:60:00", "00:00:61", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(seconds_of_clock(F.col("t"))).collect()] == [5, 86399, 90001, 997200, *[None] * 6]
