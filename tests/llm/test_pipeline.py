"""The corpus pipeline: every stage on the columns of documents, its decisions in effect, odd tables, and the contract queries."""

import hashlib

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from dqspark.llm import pii, queries

ODD = [(0, "a b c d e f g", "en", "s", 13), (0, "a b c d e f g", "en", "s", 13), (None, "call +49 30 1234567890 now", None, None, None), (2, None, "en", "t", 0), (3, "", "en", "t", 0), (4, "word " * 30_000, "en", "s", 150_000)]


def test_stages_keep_columns_and_take_effect(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == names, name
        out.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}")
        docs = spark.read.parquet(path)
        if name == "near_duplicates":
            texts = [r["text"] for r in docs.collect()]
            assert len({hashlib.md5(t.encode()).digest() for t in texts}) == len(texts) < before
        if name == "personal_data":
            assert not any(pii.base_spans(r["text"]) for r in docs.collect())
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert tokens.count() == docs.count() and {"doc_id", "n_tokens", "ids"} <= set(tokens.columns)


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_on_odd_tables(spark, small, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.createDataFrame(rows, schema), small).collect()
        assert rows or not out, name


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0
    assert set(corpus_pipeline.oracle_sql()) <= {"pipeline"} == set(corpus_pipeline.queries())


CONTRACT = {
    "op1_toxicity": ["doc_id", "held_out", "score", "predicted"], "op2_neardup": ["doc_id", "n_shingles", "component_id", "kept"], "op3_quality": ["doc_id", "held_out", "score", "predicted"],
    "op4_suffixes": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], "op5_pivots": ["query_id", "rank", "vec_id", "score"], "op6_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op7_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], "op8_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op9_ann": ["query_id", "rank", "vec_id", "score"],
    "op10_mixing": ["doc_id", "size", "source_size", "target", "taken"],
}


@pytest.mark.parametrize("name", list(CONTRACT))
def test_contract_columns(spark, small, name):
    out = queries.queries()[name](spark, small)
    assert set(CONTRACT[name]) <= set(out.columns)
    table = "embeddings" if name in ("op5_pivots", "op9_ann") else "pages" if name == "op7_warc" else "documents"
    if table != "embeddings":
        assert out.count() == spark.read.parquet(f"{small}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, small, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    cursor = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(map(str, cursor.fetchall())) == sorted(str(tuple(r)) for r in queries.queries()[name](spark, small).select(*names).collect())


def test_held_out_folds_are_learnt_about(spark):
    """Held-out accuracy on more labels than the smallest tables have."""
    from pathlib import Path

    folder = "/root/testdata/sf0.1"
    if not Path(folder).is_dir():
        pytest.skip("no test tables")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    tox = queries.op1_toxicity(spark, folder).where("held_out").join(labels, "doc_id").selectExpr("avg(int(predicted = toxic)) a", "sum(predicted * toxic) / sum(toxic) r").first()
    qua = queries.op3_quality(spark, folder).where("held_out").join(labels, "doc_id").selectExpr("avg(int(predicted = quality)) a").first()
    assert tox["a"] > 0.95 and tox["r"] > 0.8 and qua["a"] > 0.95
