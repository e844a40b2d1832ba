import shutil

import pytest

import corpus_pipeline
from terraloom.llm import decontaminate, mixing, quality_rules, simhash
from terraloom.llm.queries import oracle_sql, queries
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    text = {1: prose(1, 60, 10**5), 2: prose(2, 60, 10**5), 3: prose(3, 90, 10**5), 4: "too short", 5: prose(5, 50, 10**5) + " " + prose(77, 30, 10**5), 6: None, 7: prose(1, 60, 10**5)}
    rows = [(k, t, "en", f"s{k % 2}", len(t or "")) for k, t in text.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, prose(77, 30, 10**5))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    yield str(at)
    shutil.rmtree(at)


def test_each_stage_keeps_what_it_should(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    good = corpus_pipeline.quality(spark, docs, folder)
    assert ids(good) == [1, 2, 3, 5, 7]
    one = corpus_pipeline.near_duplicates(spark, good, folder)
    assert ids(one) == [1, 2, 3, 5]
    clean = corpus_pipeline.decontamination(spark, one, folder)
    assert ids(clean) == [1, 2, 3]
    mixed = corpus_pipeline.mix(spark, clean, folder)
    assert set(ids(mixed)) == {1, 2, 3}
    for df in (good, one, clean, mixed):
        assert df.columns == docs.columns
    last = corpus_pipeline.shards(spark, mixed, folder)
    assert sorted(r["doc_id"] for r in last.collect()) == ids(mixed)


def test_run_is_all_stages(spark, folder):
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} == {1, 2, 3}
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_every_query_is_registered():
    assert [k.split("_")[0] for k in queries()] == [*(f"op{i}" for i in range(1, 11)), "pipeline"]
    assert set(oracle_sql()) <= set(queries())


def test_empty_tables_go_through(spark, folder):
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet").limit(0) for t in ("documents", "benchmark"))
    for df in (quality_rules.keep_good(docs), simhash.one_of_each(docs), decontaminate.without_leaks(docs, items), mixing.mixed_documents(docs)):
        assert df.count() == 0
