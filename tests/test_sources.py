import pytest
from pyspark.sql import functions as F

from seriesmith.functions.expressions import split_identifier
from seriesmith.sources import files, nested

BATCH = "batch_dist_binary_ethanol+propan-2-ol"


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_layouts_are_united_by_name(spark, tmp_path):
    base = tmp_path / "01_Timeseries_Sensors"
    write(base / "operation" / BATCH / "operating_point_007" / "train_normal_experiment_012.csv",
          "Time,T701,P701\n08:00:00,1.5,2\n08:00:01,,3\n")
    write(base / "Shutdown" / BATCH / "operating_point_007" / "test_anormal_experiment_003.csv",
          "P701,Time\n5,09:00:00\n")
    write(base / "Operation" / "other" / "operating_point_007" / "train_normal_experiment_001.csv", "Time,T701\nx,1\n")
    df = split_identifier(files.read_series(spark, str(base)))
    rows = {(r["phase"], r["Time"]): (r["T701"], r["P701"], r["experiment_type"], r["experiment"]) for r in df.collect()}
    assert rows == {
        ("operation", "08:00:00"): (1.5, 2.0, "train_normal", "experiment_012"),
        ("operation", "08:00:01"): (None, 3.0, "train_normal", "experiment_012"),
        ("Shutdown", "09:00:00"): (None, 5.0, "test_anormal", "experiment_003"),
    }
    assert df.first()["identifier"].count("/") == 4
    assert files.discover(spark, str(base)).count() == 2


def test_file_order_is_kept(spark, tmp_path):
    lines = "".join(f"{i:02d}:00:00,{(i * 7) % 24}\n" for i in range(24))
    write(tmp_path / "Operation" / BATCH / "operating_point_001" / "train_normal_experiment_001.csv", "Time,x\n" + lines)
    got = [r["x"] for r in files.read_series(spark, str(tmp_path)).orderBy("file_block", "file_row").collect()]
    assert got == [float((i * 7) % 24) for i in range(24)]


def test_text_columns_quotes_and_bad_cells(spark, tmp_path):
    name = tmp_path / "Operation" / BATCH / "operating_point_001" / "train_normal_experiment_001.csv"
    write(name, 'Time,"a,b", Remark ,x,\n08:00:00,1,"hot, very",2,7\n08:00:01,1;6,,-1.5e3,\n')
    read = files.read_series(spark, str(tmp_path), text=("Time", "Remark"), bad_cells="report").orderBy("file_row")
    assert read.columns[:5] == ["Time", "a,b", "Remark", "x", "_c4"]
    assert [tuple(r)[:6] for r in read.collect()] == [
        ("08:00:00", 1.0, "hot, very", 2.0, 7.0, []), ("08:00:01", None, None, -1500.0, None, ["a,b"])]
    with pytest.raises(Exception, match="no number in column a,b: 1;6"):
        files.read_series(spark, str(tmp_path), text=("Time", "Remark")).collect()


def test_line_breaks_blank_lines_and_repeated_headers(spark, tmp_path):
    folder = tmp_path / "Operation" / BATCH / "operating_point_001"
    write(folder / "train_normal_experiment_001.csv",
          '\ufeff\n"Re\nmark",x\n"first\nsecond",1\n\n  \nRe,2\n"Re\nmark",x\nonly\nlong,4,beyond\n')
    write(folder / "train_normal_experiment_002.csv", "")
    write(folder / "train_normal_experiment_003.csv", "x\r\n5\r\n6")
    read = files.read_series(spark, str(tmp_path), text=("Re\nmark",), bad_cells="report")
    got = {k: [] for k in ("experiment_001", "experiment_003")}
    for r in read.orderBy("file_block", "file_row").collect():
        got[r["identifier"].rpartition("/")[2]].append((r["Re\nmark"], r["x"], r["bad_cells"]))
    assert got == {
        "experiment_001": [("first\nsecond", 1.0, []), ("Re", 2.0, []), ("Re\nmark", None, ["x"]), ("only", None, []),
                           ("long", 4.0, [])],
        "experiment_003": [(None, 5.0, []), (None, 6.0, [])]}


def test_headers_are_read_in_bounded_steps(spark, tmp_path):
    path = tmp_path / "a b%41+c" / "x.csv"
    write(path, '"a""b\n",' + "c" * 50 + "\n" + "1,2\n" * 1000)
    for step in (1, 7, 1 << 16):
        assert files.first_record(path.as_uri(), step) == '"a""b\n",' + "c" * 50


def test_long_files_can_be_split(spark, tmp_path):
    path = tmp_path / "Operation" / BATCH / "operating_point_001" / "train_normal_experiment_001.csv"
    write(path, "x\n" + "".join(f"{i}\n" for i in range(30000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        read = files.read_series(spark, str(tmp_path), line_breaks=False)
        rows = read.orderBy("file_block", "file_row").collect()
        assert [r["x"] for r in rows] == list(map(float, range(30000))) and len({r["file_block"] for r in rows}) > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_no_matching_file_is_an_error(spark, tmp_path):
    write(tmp_path / "Operation" / "x.csv", "a\n1\n")
    with pytest.raises(ValueError, match="no matching"):
        files.read_series(spark, str(tmp_path))


def test_series_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("Operation", BATCH, "operating_point_001", "train_normal_experiment_004", "10:00:00", 1 / 3)],
                               "phase string, batch string, operating_point string, experiment_file string, Time string, x double")
    files.write_series(df, str(tmp_path / "out"), ["phase", "batch", "operating_point", "experiment_file"], formats={"x": "%.6f"})
    back = files.read_series(spark, str(tmp_path / "out")).first()
    assert back["x"] == 0.333333
    assert back["identifier"] == f"Operation/{BATCH}/operating_point_001/train_normal/experiment_004"


def test_incident_list_headers_are_trimmed(spark, tmp_path):
    write(tmp_path / "i.csv", " Start_Cause ;Anomaly_Class; Description\n 08:00:00 ;2; leak\n")
    df = files.read_delimited(spark, str(tmp_path / "i.csv"))
    assert df.columns == ["Start_Cause", "Anomaly_Class", "Description"]
    assert tuple(df.first()) == ("08:00:00", "2", "leak")


def test_uploads_are_combined(spark):
    a = spark.createDataFrame([("08:00:00.400", 1.0), ("08:00:00.600", 2.0)], "Timestamp string, x double")
    b = spark.createDataFrame([("08:00:01.100", 3.0), ("08:00:02.000", 4.0)], "Timestamp string, x double")
    got = sorted((r["Time"], r["x"]) for r in files.combine_uploads([a, b]).collect())
    assert got == [("08:00:00", 1.0), ("08:00:01", 2.0), ("08:00:02", 4.0)]


def test_nested_metadata(spark, tmp_path):
    write(tmp_path / "a.json", """{"anomalies": [{"id": "1", "hasBeginning": "08:00:00", "hasEnd": "08:10:00",
      "wasOriginatedBy": {"Observation": {"label": "hot", "madeBySensor": {"Sensor": {"id": "T701"}},
      "observedProperty": {"ObservableProperty": "temperature"}, "hasFeatureOfInterest": {"FeatureOfInterest": "kettle"}}}}]}""")
    row = nested.flatten_anomalies(nested.read_json(spark, str(tmp_path / "a.json"))).first()
    assert tuple(row) == ("1", "08:00:00", "08:10:00", "T701", "hot", "temperature", "kettle")
    meta = spark.createDataFrame([('{"extra_fields": {"Sensor Type": {"value": "Pt100 class A"}}}',)], "m string")
    assert nested.extra_fields(meta, "m", {"kind": "Sensor Type"}).first()["kind"] == "Pt100 class A"


def test_tables_and_result_cache(spark, tmp_path):
    files.write_table(spark.range(5).withColumn("p", F.col("id") % 2), str(tmp_path / "t"), ["p"])
    assert files.read_table(spark, str(tmp_path / "t"), ["id", "p"]).filter("p = 1").count() == 2
    cached = files.load_results(spark, str(tmp_path), ["t"])["t"]
    assert cached.is_cached and cached.count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_table(spark, str(tmp_path / "missing"))


def test_paths_are_matched_once_a_file(spark, tmp_path, monkeypatch):
    for number in ("001", "002"):
        write(tmp_path / "Operation" / BATCH / "operating_point_001" / f"train_normal_experiment_{number}.csv",
              f"Time,x\n08:00:00,{int(number)}\n08:00:01,5\n")
    write(tmp_path / "Operation" / BATCH / "notes.csv", "Time,x\n08:00:00,77\n")
    got = {}
    for most in (files.MAX_SHARED_HEADS, 0):
        monkeypatch.setattr(files, "MAX_SHARED_HEADS", most)
        read = files.read_series(spark, str(tmp_path))
        assert "regexp" not in read._jdf.queryExecution().optimizedPlan().toString()
        got[most] = sorted((r["identifier"][-3:], r["Time"], r["x"]) for r in read.collect())
    assert len({str(rows) for rows in got.values()}) == 1
    assert got[0] == [("001", "08:00:00", 1.0), ("001", "08:00:01", 5.0), ("002", "08:00:00", 2.0), ("002", "08:00:01", 5.0)]
