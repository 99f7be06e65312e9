"""The pipeline's stages, each against its operator on its own input, and the queries' oracles."""

from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from tallyforge.llm import queries, toxicity
from tallyforge.llm.mixing import mix

from .helpers import awkward, empty, words
from .test_documents import kept_rows, near_rows

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(100, 160)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = awkward() + near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in toxicity.score(docs, labels).where("predicted = 0").collect())
    left = [tuple(r) for r in kept.collect()]
    single = corpus_pipeline.drop_copies(spark, kept, str(tmp_path))
    assert single.columns == docs.columns
    assert Counter(r.doc_id for r in single.collect()) == kept_rows(left, 5, 80)
    mixed = corpus_pipeline.mix_sources(spark, single, str(tmp_path))
    assert mixed.columns == docs.columns
    budget = {(r.doc_id, r.source): r.whole * r.size + r.part for r in mix(single).collect()}
    got = Counter()
    for r in mixed.collect():
        got[r.doc_id, r.source] += len(words(r.text))
    assert {k: v for k, v in budget.items() if v} == {k: v for k, v in got.items() if v}
    packed = corpus_pipeline.pack_sequences(spark, mixed, str(tmp_path))
    assert packed.where("start = 0").count() == mixed.count()


def test_run(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "mixing", "packing"]
    assert corpus_pipeline.run(spark, SF).count() > 0
    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert Counter(map(repr, want)) == Counter(repr(tuple(r)) for r in df.select(*columns).collect())


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 11)}
