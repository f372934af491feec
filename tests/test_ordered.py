import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesmith.operators.ordered import find_large_keys, ordered_columns, run_ids, run_starts


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    n = 400
    key = np.where(rng.random(n) < 0.4, "hot", rng.choice(["a", "b", "c", "d"], n)).astype(object)
    key[rng.random(n) < 0.1] = None
    rows = [
        (k, int(o), None if rng.random() < 0.3 else float(rng.integers(0, 9)), int(rng.integers(0, 2)))
        for k, o in zip(key, rng.permutation(n))
    ]
    return spark.createDataFrame(rows, "k string, o int, v double, m int").repartition(5)


def expected(frame, descending=False):
    pdf = frame.toPandas().sort_values("o", ascending=not descending)
    out = []
    for _, g in pdf.groupby("k", dropna=False):
        g = g.copy()
        g["position"] = np.arange(len(g))
        g["total"] = g["v"].fillna(0).cumsum()
        g["prev"] = g["v"].shift()
        g["known"] = g["v"].ffill()
        g["coming"] = g["v"].bfill().shift(-1)
        out.append(g)
    return pd.concat(out).sort_values("o").reset_index(drop=True)


@pytest.mark.parametrize("max_rows", [7, 60, 10_000])
@pytest.mark.parametrize("descending", [False, True])
def test_blocks_equal_plain_order(frame, max_rows, descending):
    order = [F.col("o").desc()] if descending else ["o"]
    got = ordered_columns(
        frame, ["k"], order, position="position", sums={"total": F.col("v")}, lags={"prev": F.col("v")},
        last={"known": F.col("v")}, following={"coming": F.col("v")}, max_rows=max_rows,
    ).toPandas().sort_values("o").reset_index(drop=True)
    want = expected(frame, descending)
    assert len(got) == len(want)
    for c in ["position", "total", "prev", "known", "coming"]:
        np.testing.assert_array_equal(got[c].astype(float), want[c].astype(float), err_msg=c)


@pytest.mark.parametrize("max_rows", [7, 10_000])
def test_runs(frame, max_rows):
    rows = run_ids(frame, ["k"], ["o"], F.col("m"), max_rows=max_rows).toPandas()
    for _, g in rows.groupby("k", dropna=False):
        g = g.sort_values("o")
        want = (g["m"] != g["m"].shift()).cumsum()
        assert (g["run_id"].to_numpy() == want.to_numpy()).all()
    starts = run_starts(frame, ["k"], ["o"], F.col("m"), max_rows=max_rows)
    assert starts.filter("run_start").count() == len(rows.groupby(["k", "run_id"], dropna=False))


def test_large_keys_are_counted(frame):
    found = find_large_keys(frame, ["k"], 100)
    assert found.keys == 1 and found.marks.first()["k"] == "hot"
    assert find_large_keys(frame, ["k"], 10_000).marks is None
