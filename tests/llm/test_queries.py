"""Every registered query of the subpackage on the smallest tables."""

import pytest

from partloom.llm.queries import LLM_QUERIES
from tests.compare import compare, connect

TABLES = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op2_jaccard_join": "doc_id n_shingles component_id",
    "op6_mixing": "doc_id size source_size target taken",
    "op7_language_id": "doc_id held_out lang_pred score",
    "op8_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op9_vector_dedup": "vec_id n_links component_id kept",
    "op10_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op13_quality_classifier": "doc_id held_out score predicted",
    "op12_embedding_whitening": "vec_id component n deviation whitened explained identity_error",
    "op11_conversation_trie": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
}


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES if n != "pipeline") == list(range(1, 14))


@pytest.mark.parametrize("name", [n for n in LLM_QUERIES if n != "pipeline"])
def test_query_returns_every_row(spark, name):
    frame = LLM_QUERIES[name].plan(spark, TABLES)
    assert set(COLUMNS.get(name, "").split()) <= set(frame.columns)
    if name not in ("op5_token_shards", "op11_conversation_trie", "op12_embedding_whitening"):
        whole = spark.read.parquet(f"{TABLES}/{'embeddings' if 'vector' in name else 'documents'}.parquet").count()
        assert frame.count() == whole


@pytest.mark.parametrize("name", [n for n, q in LLM_QUERIES.items() if q.sql])
def test_query_agrees_with_sql(spark, name):
    assert compare(spark, connect(TABLES), LLM_QUERIES[name], TABLES) is None


def test_language_accuracy_on_held_out_documents(spark):
    found = LLM_QUERIES["op7_language_id"].plan(spark, "/root/testdata/sf0.01").filter("held_out")
    right = found.join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert right.filter("lang_pred = lang").count() >= 0.98 * right.count()


def test_model_beats_word_frequencies_on_held_out_documents(spark):
    row = LLM_QUERIES["op8_lm_scoring"].plan(spark, "/root/testdata/sf0.01").filter("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert row["s"] > row["b"]
