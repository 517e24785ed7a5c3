"""The registered queries against their SQL, and the pipeline, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from rowsmith.llm.queries import ORACLES, QUERIES
from rowsmith.plans.registry import TABLES
from tools.check import canonical_rows

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical_rows(df.columns, [tuple(r) for r in df.collect()]) == canonical_rows(columns, cursor.fetchall())


@pytest.mark.parametrize(("name", "columns"), [
    ("op3_language", {"doc_id", "held_out", "lang_pred", "score"}),
    ("op4_personal_data", {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"}),
    ("op6_simhash", {"doc_id", "fingerprint", "component_id"}),
    ("op7_token_files", {"doc_id", "start", "n_tokens", "ids_crc32"}),
    ("op8_pseudo_likelihood", {"doc_id", "n_tokens", "log_prob", "mean_log_prob"}),
    ("op9_toxicity", {"doc_id", "held_out", "score", "predicted"}),
])
def test_a_row_for_each_document(spark, name, columns):
    df = QUERIES[name](spark, SF_DIR)
    assert columns <= set(df.columns)
    ids = [r.doc_id for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id").collect()]
    assert sorted(r.doc_id for r in df.select("doc_id").collect()) == sorted(ids)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_files"]


def test_stages_take_hard_rows(spark, hard_docs, no_docs):
    for start in (hard_docs, no_docs):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF_DIR)
            assert docs.columns == start.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() == docs.count()


def test_pipeline_keeps_clean_documents_once(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    clean = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        clean = stage(spark, clean, SF_DIR)
    ids = [r.doc_id for r in clean.select("doc_id").collect()]
    toxic = {r.doc_id for r in QUERIES["op9_toxicity"](spark, SF_DIR).collect() if r.predicted}
    assert len(ids) == len(set(ids)) and not toxic & set(ids)
    result = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id for r in result} <= set(ids)
    # Starts and lengths lie end to end.
    spans = sorted((r.start, r.n_tokens) for r in result)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
