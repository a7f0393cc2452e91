"""The registered queries and the pipeline on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from siftwell.llm import byte_bpe, langid, mixing, quality, queries, stages

COLUMNS = {
    "op2_chat_format": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
    "op3_media_columns": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
    "op4_byte_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op5_token_output": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op6_mix_sources": {"doc_id", "size", "source_size", "target", "taken"},
    "op7_simhash": {"doc_id", "fingerprint", "component_id"},
    "op8_shards": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op9_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op10_minhash": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
}


@pytest.mark.parametrize("name", COLUMNS)
def test_contract_columns(spark, sf_dir, name):
    out = queries.QUERIES[name](spark, sf_dir)
    assert COLUMNS[name] <= set(out.columns) and out.count() > 0


def test_chat_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    cur = con.execute(queries.SQL["op2_chat_format"])
    names = [d[0] for d in cur.description]
    want = sorted(cur.fetchall())
    assert sorted(tuple(r[n] for n in names) for r in queries.op2_chat_format(spark, sf_dir).collect()) == want


def test_pipeline_stages_hold(spark, sf_dir):
    docs = queries.documents(spark, sf_dir)
    first = docs
    for name, stage in stages.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert 0 < out.count(), name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    last = stages.tokens(spark, docs, sf_dir)
    assert last.count() == docs.count() and last.where("NOT round_trip").count() == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = labels.where("quality = 1").join(first, "doc_id", "left_semi").count()
    kept = quality.accepted(first, labels, F.col("source"), queries.site_path()).join(labels.where("quality = 1"), "doc_id", "left_semi").count()
    assert kept >= 0.97 * good
