from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seriesmith.operators import contracts as ct

SCHEMA = "e int, w int, x double, site string"
RULES = lambda sites: [
    *ct.not_null("x"), ct.in_range("x", 0, 10), ct.finite(["x"]), ct.unique(), ct.once_per(["e"], "one zero", F.col("x") == 0),
    ct.references(["site"], sites), ct.references(["e"], sites), ct.feature_count(["x", "site"], 3)]


def brute(rows, known_sites, known_e):
    def ends(keys):
        texts = sorted("/".join("null" if v is None else str(v) for v in k) for k in keys)
        return (texts[0], texts[-1]) if texts else (None, None)

    nan = lambda x: x is not None and x != x
    tests = {
        "not_null x": lambda r: r[2] is None,
        "in_range x": lambda r: r[2] is not None and (nan(r[2]) or not 0 <= r[2] <= 10),
        "finite": lambda r: r[2] is not None and (nan(r[2]) or abs(r[2]) == float("inf")),
        "references site": lambda r: r[3] is not None and r[3] not in known_sites,
        "references e": lambda r: r[0] is not None and r[0] not in known_e,
    }
    out = {}
    for name, bad in tests.items():
        found = [r[:2] for r in rows if bad(r)]
        out[name] = (len(found), *ends(found))
    copies = {k: n - 1 for k, n in Counter(r[:2] for r in rows).items() if n > 1}
    out["unique"] = (sum(copies.values()), *ends(copies))
    zeros = {r[0]: 0 for r in rows}
    for r in rows:
        zeros[r[0]] += r[2] == 0
    wrong = [(e,) for e, n in zeros.items() if n != 1]
    out["one zero"] = (len(wrong), *ends(wrong))
    out["feature_count"] = (1, None, None)
    return out


values = st.sampled_from([None, 0.0, 1.5, 10.0, 11.0, -1.0, float("inf"), float("nan")])
table = st.lists(st.tuples(st.sampled_from([None, 1, 2, 10]), st.integers(0, 2), values, st.sampled_from([None, "a", "b", "z"])),
                 max_size=25)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(table)
def test_report_matches_brute_force(spark, rows):
    sites = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2), (None, None)], "site string, e int")
    report = ct.check(spark.createDataFrame(rows, SCHEMA), ["e", "w"], RULES(sites)).collect()
    assert {r["n_rows"] for r in report} == {len(rows)}
    assert {r["rule"]: tuple(r)[2:] for r in report} == brute(rows, {"a", "b"}, {1, 2})


def test_row_rules_alone_need_no_grouping(spark):
    df = spark.createDataFrame([(1, 0, None, "a"), (1, 0, 3.0, "a")], SCHEMA)
    report = ct.check(df, ["e", "w"], ct.not_null("x", "site"))
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1
    assert [(r["rule"], r["violations"], r["first_offender"]) for r in report.collect()] == [
        ("not_null x", 1, "1/0"), ("not_null site", 0, None)]


def test_table_is_read_once(spark, tmp_path):
    spark.range(10).select(F.col("id").alias("e"), F.lit(0).alias("w"), F.lit(1.0).alias("x"), F.lit("u").alias("unused")) \
        .write.parquet(str(tmp_path / "t"))
    report = ct.check(spark.read.parquet(str(tmp_path / "t")), ["e", "w"],
                      [*ct.not_null("x"), ct.unique(), ct.once_per(["e"], "one", F.col("x") == 1)])
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "unused" not in plan
    ct.enforce(report)


def test_wrong_rules_are_refused(spark):
    df = spark.createDataFrame([(1, 0, -1.0, "a")], SCHEMA)
    with pytest.raises(ValueError, match="not nested"):
        ct.check(df, ["e", "w"], [ct.once_per(["e"], "a", F.lit(True)), ct.once_per(["w"], "b", F.lit(True))])
    with pytest.raises(ValueError, match="same name"):
        ct.check(df, ["e", "w"], [*ct.not_null("x", "x")])
    with pytest.raises(ValueError, match="in_range x: 1 .first 1/0"):
        ct.enforce(ct.check(df, ["e", "w"], [ct.in_range("x", 0, 1), ct.unique()]))


def test_published_feature_counts():
    assert ct.feature_count([str(i) for i in range(780)], ct.FEATURE_COUNTS["ml_features"]).difference == 0
    assert ct.feature_count(["a"], ct.FEATURE_COUNTS["window_features"]).difference == 239
