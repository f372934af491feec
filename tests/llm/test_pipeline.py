import re

import corpus_pipeline
import __spark_entry__ as se
import pytest

from tests.llm.test_packing import check_places, ids_of

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), "test")
        out.append(docs)
    return out


def test_stages_and_registration():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near copies", "suffix dedup", "mixing", "packing"]
    numbered = [n for n in se.queries() if re.match(r"op\d+_", n)]
    assert "pipeline" in se.queries() and sorted(int(n[2:].split("_")[0]) for n in numbered) == list(range(1, 14))


def test_every_stage_but_the_last_returns_documents(spark, stages):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    assert all(s.schema == schema for s in stages[:-1])


def test_decisions_take_effect(spark, stages):
    clean, apart, cut, mixed, packed = stages
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 0.6 * docs.count() < clean.count() < docs.count()
    assert 0.6 * clean.count() < apart.count() < clean.count()
    texts = {r.doc_id: r.text for r in apart.collect()}
    rows = cut.collect()
    assert any(r.text != texts[r.doc_id] for r in rows) and all(len(r.text) <= len(texts[r.doc_id]) for r in rows)
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in rows}
    assert check_places(packed.collect(), 2048) > 0
    assert sum(r.length for r in packed.collect()) == sum(len(ids_of(r.text)) for r in mixed.collect())


def test_run_equals_the_stages(spark, stages):
    key = lambda df: sorted(map(str, df.drop("sequence_id", "offset").collect()))
    assert key(corpus_pipeline.run(spark, SF)) == key(stages[-1])


def test_stages_on_nulls_copies_and_clashing_names(spark):
    """Stages one by one: null ids and texts, exact copies, a very long text, and columns named as the stages' own."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    words = " ".join(f"w{i % 977}x" for i in range(60_000))
    rows = [(i, f"plain words of document {i} and some more {i * 7}", "s", "k", i, 0) for i in range(40)]
    rows += [(50, rows[3][1], "s", "k", 1, 1), (51, None, None, None, None, None), (None, rows[4][1], "s", "k", 2, 2),
             (52, "", "t", "", 0, 0), (53, words, "s", "k", 3, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, key string, fp long, size long").repartition(3)
    assert labels.count() and corpus_pipeline.STAGES[1][1] is corpus_pipeline.drop_near_copies
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and len(ids) == len(set(ids)) and {3, 4, 51, 53} <= set(ids)
    assert 50 not in ids and None not in ids and 52 not in ids  # copies of 3 and 4; null and empty are one text
    for name, stage in [*corpus_pipeline.STAGES[:1], *corpus_pipeline.STAGES[2:]]:
        out = stage(spark, docs, SF)
        assert out.count() > 0 and (name == "packing" or out.columns == docs.columns)


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert all(stage(spark, docs, SF).count() == 0 for _, stage in corpus_pipeline.STAGES)
