"""Registered queries of the training-data operators over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from partloom.llm import conversation_trie, jaccard_join, language_crf, licenses, mixing, nb_svm, pieces, quality, secrets, suffix_tree, token_shards, vector_dedup, whitening
from partloom.llm.text import held_out, table
from partloom.plans.registry import Plan, Query
from partloom.session import checkpointed

LLM_QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(plan: Plan) -> Plan:
        LLM_QUERIES[name] = Query(plan, sql)
        return plan

    return register


WORDS_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


@query(
    "op6_mixing",
    rf"""
    WITH sized AS (
        SELECT doc_id, source, {WORDS_SQL}::BIGINT AS size, md5(concat('mix:', coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))))) AS k FROM documents),
    totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
    weighted AS (
        SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w, 3 * source_size AS lim FROM totals),
    levels AS (
        SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / w, source NULLS LAST
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(w) OVER (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lev FROM weighted),
    opened AS (SELECT lev AS o FROM levels WHERE lev * w <= lim ORDER BY lim / w, lev LIMIT 1),
    targets AS (SELECT source, source_size, least(lim::DOUBLE, coalesce((SELECT o FROM opened) * w, lim::DOUBLE)) AS target FROM levels),
    queued AS (
        SELECT s.doc_id, s.size, t.source_size, t.target,
            coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
        FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target,
        (greatest(0, least(size, floor(target)::BIGINT - start))
         + greatest(0, least(size, floor(target)::BIGINT - start - source_size))
         + greatest(0, least(size, floor(target)::BIGINT - start - 2 * source_size)))::BIGINT AS taken
    FROM queued""",
)
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op1_secrets")
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = secrets.scan(docs, secrets.model_of(docs))

    def count(kind: str):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return scanned.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secrets.span_text("base_spans"), 256).alias("base_sha256"), secrets.span_text("spans").alias("spans"),
    )


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = checkpointed(quality.text_statistics(table(spark, sf_dir, "documents")), "quality")
    junk = quality.learn_from_labels(stats, table(spark, sf_dir, "labels"))
    return quality.judge(stats, junk).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 4, 2)
    model = language_crf.train(language_crf.training_documents(docs.filter(~out)))
    labelled = language_crf.predict(docs.select("doc_id", "text"), model)
    return labelled.select("doc_id", out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@query("op3_sentencepiece")
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = pieces.load_vocabulary(PIECE_MODEL)
    coded = pieces.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, check=True)
    return coded.select(
        "doc_id", F.size("piece_ids").cast("bigint").alias("n_pieces"), F.xxhash64("piece_ids").alias("ids_hash"), "round_trip"
    )


BYTE_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary of BYTE_RANKS cuts a text before merging.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BYTE_END = 50256


@query("op5_token_shards")
def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = token_shards.load_tokenizer(BYTE_RANKS, BYTE_PATTERN, BYTE_END)
    return token_shards.write_shards(table(spark, sf_dir, "documents"), tokenizer).manifest


@query("op9_vector_dedup")
def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op8_lm_scoring")
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 5, 1)
    scored = suffix_tree.score_documents(docs, ~out)
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op2_jaccard_join")
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents"))


@query("op4_licenses")
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = licenses.scan(docs, licenses.train(docs))
    families = F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["family"])))
    places = F.transform("licenses", lambda x: F.concat_ws(":", x["line"], x["family"]))
    return scanned.select(
        "doc_id", F.size("licenses").cast("bigint").alias("n_licenses"), F.array_join(families, ",").alias("families"), F.array_join(places, ",").alias("places")
    )


# CRC-32 of a decimal number: each character, then eight shifts.
CRC_SQL = """xor(4294967295, list_reduce(
        list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(conv_id::VARCHAR) + 1),
            lambda i: list_concat([ascii(substr(conv_id::VARCHAR, i::INT, 1))::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
        lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"""


@query(
    "op11_conversation_trie",
    rf"""
    WITH turned AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS pos
        FROM (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id, length(coalesce(text, '')) AS chars
              FROM conversations WHERE conv_id IS NOT NULL)),
    convs AS (SELECT conv_id, {CRC_SQL} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turned)),
    rebuilt AS (
        SELECT c.conv_id, 0 AS part, b.pos, b.id, b.chars FROM convs c JOIN turned b ON b.conv_id = c.conv_id - c.conv_id % 100 AND b.pos <= c.h
        UNION ALL SELECT c.conv_id, 1, t.pos, t.id, t.chars FROM convs c JOIN turned t ON t.conv_id = c.conv_id AND t.pos > c.h),
    placed AS (
        SELECT conv_id, chars, row_number() OVER w AS depth, md5(string_agg(id, '') OVER w) AS node
        FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
    steps AS (
        SELECT conv_id, depth, node, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth), 'root') AS parent, chars FROM placed
        UNION ALL SELECT conv_id, 0, 'root', NULL, 0 FROM convs),
    lengths AS (SELECT conv_id, max(depth) AS len FROM steps GROUP BY conv_id),
    nodes AS (
        SELECT node, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(parent) AS parent, min(chars) AS chars,
            string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = len) AS ends
        FROM steps JOIN lengths USING (conv_id) GROUP BY node),
    children AS (SELECT parent AS node, count(*) AS n_children FROM nodes GROUP BY parent),
    described AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children ON children.node = nodes.node),
    subtrees AS (
        SELECT s.node, sum((t.n_convs - 1) * t.chars)::BIGINT AS saved_tokens, sum((t.n_children = 0)::INT)::BIGINT AS n_leaves
        FROM described t JOIN steps s ON s.conv_id = t.conv_id AND s.depth <= t.depth GROUP BY s.node)
    SELECT d.conv_id, d.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, d.n_convs, d.n_children::BIGINT AS n_children,
        n_leaves, saved_tokens, sha256(coalesce(d.ends, '')) AS ends_sha256
    FROM described d JOIN subtrees USING (node) LEFT JOIN described p ON p.node = d.parent""",
)
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rebuilt = conversation_trie.branched(conversation_trie.turn_sequences(table(spark, sf_dir, "conversations")))
    return conversation_trie.prefix_trie(rebuilt).drop("turn_id")


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"))


@query("op13_quality_classifier")
def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 5, 0)
    model = nb_svm.train(nb_svm.training_rows(docs.filter(~out), table(spark, sf_dir, "labels"), "quality"))
    return nb_svm.score(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
