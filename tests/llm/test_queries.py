"""The queries against DuckDB, the contract's columns, and the pipeline stage by stage."""

import pytest
from conftest import rows

from loomline.llm import registry

COLUMNS = {
    "op2_simhash": ["doc_id", "fingerprint", "component_id"],
    "op3_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op4_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op5_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op6_knn_search": ["query_id", "rank", "vec_id", "score"],
    "op8_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op9_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op11_bpe_codec": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op12_centroids": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
    "op13_token_alignment": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
}


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, duck, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    assert rows(got) == rows(duck.execute(registry.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).columns == COLUMNS[name]


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert sizes[1] == sizes[2] and sizes[0] > sizes[1] > sizes[3] > sizes[4] > 0.5 * sizes[0]
    filled = docs.groupBy("sequence_id").sum("length").toPandas()["sum(length)"]
    assert filled.max() <= 4096
