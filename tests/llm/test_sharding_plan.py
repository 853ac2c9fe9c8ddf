from pathlib import Path

import pytest
from synblock.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
def test_shards_are_native(spark):
    text = queries.op5_kd_shards(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
def test_queries_return_what_they_must(spark):
    want = {
        "op1_simhash_dedup": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
        "op2_html_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
        "op3_mix_sources": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
        "op4_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
        "op5_kd_shards": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
        "op6_bpe_codec": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
        "op7_hmm_score": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
        "op9_kd_topk": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
        "op10_warc_archive": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    }
    for name, columns in want.items():
        have = dict(queries.QUERIES[name](spark, FOLDER).dtypes)
        assert columns.items() <= have.items(), name


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
def test_model_beats_unigrams_on_held_out_texts(spark):
    rows = queries.op7_hmm_score(spark, FOLDER).where("held_out").toPandas()
    assert rows["score"].sum() > rows["base_score"].sum()
