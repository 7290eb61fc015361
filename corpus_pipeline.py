"""A training corpus from raw documents: language, near-duplicates, secrets, mixture, token ids.

Every stage takes what its predecessor kept, stored as Parquet, and returns the columns of `documents`; the last
one returns the token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from partloom.llm import jaccard_join, language_crf, mixing, pieces, secrets
from partloom.llm.text import set_aside
from partloom.session import checkpointed

LEAST_LANGUAGE_SCORE = 0.4
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined, learned from those that carry one; a missing `lang` is filled in.

    Texts without a letter go, and those in which no language reaches the least mean posterior.
    """
    docs, named_back = set_aside(docs, ["language"])
    model = language_crf.train(language_crf.training_documents(docs))
    labelled = language_crf.predict(docs, model)
    found = (F.col("language.lang") != language_crf.UNDETERMINED) & (F.col("language.score") >= LEAST_LANGUAGE_SCORE)
    return named_back(labelled.filter(found).withColumn("lang", F.coalesce("lang", "language.lang")).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: the one with the smallest id."""
    return jaccard_join.one_per_group(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked and `n_chars` of the new text."""
    return secrets.redact(docs, secrets.model_of(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them, in the order in which it does."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`doc_id, lang, source, piece_ids`; decoding the ids gives the text."""
    return pieces.encode_documents(docs, pieces.load_vocabulary(PIECE_MODEL)).select("doc_id", "lang", "source", "piece_ids")


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", near_duplicates),
    ("secrets", secret_scan),
    ("mixing", mixture),
    ("sentencepiece", token_ids),
]

# Trained models and the automaton are beyond SQL; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = checkpointed(stage(spark, docs, sf_dir), name)
    return docs
