import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as se
from seriesmith.llm import language_id as li
from seriesmith.llm.common import fold

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, __text string, score int, l string, hash int"


def brute_counts(text, settings):
    """n-grams one by one, numbered as the operator numbers them."""
    data = re.sub(rb"[\x00-\x60\x7b-\x7f]+", b" ", b" " + text + b" ")
    found = Counter()
    for n in settings.grams:
        for i in range(len(data) - n + 1):
            code = n
            for byte in data[i:i + n]:
                code = code * 257 + byte
            found[(code * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - 15)] += 1
    return found


@pytest.mark.parametrize("text", ["", "a", "Ein  Satz, mit 12 Wörtern — et là?", "x" * 50 + " y " * 40, "\x00 \n!"])
def test_counts_equal_a_loop(monkeypatch, text):
    for chunk in (1 << 20, 7):
        monkeypatch.setattr(li, "CHUNK", chunk)
        s = li.Settings()
        found = li.counts(text.lower().encode(), s.grams, s.buckets)
        assert {i: int(found[i]) for i in np.flatnonzero(found)} == dict(brute_counts(text.lower().encode(), s))


def test_frequencies_and_nearest_centroid_equal_loops(spark):
    s = li.Settings(sample_rows=20)
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id % 9 = 0").select("doc_id", "text", "lang")
    model = li.fit(docs, s)
    rows = docs.collect()
    seen, bags = Counter(), {}
    for r in rows:
        bags[r.doc_id] = brute_counts(r.text.lower().encode(), s)
        seen.update(bags[r.doc_id].keys())
    idf = [math.log((1 + len(rows)) / (1 + seen[b])) + 1 for b in range(s.buckets)]
    assert np.allclose(model.idf, idf)
    assert np.allclose(np.linalg.norm(model.centroids, axis=0), 1, atol=1e-5)
    assert sorted(set(model.languages)) == sorted({r.lang for r in rows}) and len(model.languages) > len(set(model.languages))
    got = {r.doc_id: r for r in li.predict(docs, model, s).collect()}
    for r in rows:
        values = {b: (1 + math.log(n)) * idf[b] for b, n in bags[r.doc_id].items()}
        norm = math.sqrt(sum(v * v for v in values.values()))
        cosines = [sum(v / norm * model.centroids[b, c] for b, v in values.items()) for c in range(len(model.languages))]
        best = max(range(len(cosines)), key=lambda c: cosines[c])
        assert abs(got[r.doc_id].score - cosines[best]) < 1e-4
        if sorted(cosines)[-1] - sorted(cosines)[-2] > 1e-4:
            assert got[r.doc_id].lang_pred == model.languages[best]
            assert abs(cosines[best] - model.least[best]) < 1e-5 or got[r.doc_id].rejected == (cosines[best] < model.least[best])


def test_clusters_find_groups():
    rng = np.random.default_rng(1)
    centres = np.eye(8)[:3]
    rows = np.abs(np.repeat(centres, 40, 0) + rng.normal(0, 0.05, (120, 8)))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    found, least = li.cluster(rows, li.Settings(clusters=3))
    assert sorted((found @ centres.T).argmax(1).tolist()) == [0, 1, 2]
    own = (rows @ found.T).max(1)
    assert 0 < (own < least[(rows @ found.T).argmax(1)]).mean() < 0.05


def test_held_out_accuracy_and_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = se.queries()["op12_language_id"](spark, SF)
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 200 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert found.count() == docs.count()
    wrong = found.filter(F.col("held_out") != (fold(F.col("doc_id"), 4) == 2)).count()
    assert wrong == 0 and found.filter("score < 0 OR score > 1 OR lang_pred IS NULL").isEmpty()


def test_foreign_text_is_rejected_but_named(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = li.fit(docs.filter("doc_id < 400"))
    odd = spark.createDataFrame([(1, "zzzzq qqqx wwwwk vvvvj " * 30), (2, "Привет, как дела?")], "doc_id long, text string")
    rows = li.predict(odd, model).collect()
    assert all(r.rejected and r.lang_pred in model.languages for r in rows)


def test_nulls_and_clashing_names(spark):
    rows = [(i, f"the word and number {i} of the text", "en") for i in range(30)]
    rows += [(100 + i, f"der Satz und die Zahl {i} im Text", "de") for i in range(30)]
    rows += [(None, "the null id", "en"), (300, None, "en"), (301, "", None), (302, " 12 ²! ", "de"), (303, "der Satz und die Zahl im Text", None),
             (1, rows[1][1], "en"), (304, "word " * 300_000, "en")]
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA).repartition(3)
    found = li.language_id(df).collect()
    assert len(found) == len(rows)
    of = {r.doc_id: r for r in found}
    assert all(of[i].lang_pred == "und" and of[i].score == 0 and of[i].rejected for i in (300, 301, 302))
    assert of[303].lang_pred == "de" and of[304].lang_pred == "en"


def test_empty_table_and_no_language(spark):
    assert li.language_id(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, "text", None, "", 0, "", 0)], SCHEMA)
    assert [r.lang_pred for r in li.language_id(df).collect()] == ["und"]
