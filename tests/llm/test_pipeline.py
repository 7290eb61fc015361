"""The corpus pipeline: columns, effects of each stage on its own input, and the whole run."""

import collections
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from partloom.llm import pieces
from tests.llm.test_joins_and_models import groups, shingles
from tests.llm.test_text_operators import expected_targets

TABLES = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{TABLES}/documents.parquet")


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "secrets", "mixing", "sentencepiece"]


def test_language_stage_keeps_clean_documents(spark, docs):
    odd = spark.createDataFrame([(10**6, None, None, "s", 0), (10**6 + 1, "12 34", None, "s", 5)], docs.schema)
    unlabelled = docs.limit(1).withColumns({"doc_id": F.lit(10**6 + 2).cast("bigint"), "lang": F.lit(None).cast("string")})
    out = STAGES["language_id"](spark, docs.unionByName(odd).unionByName(unlabelled), TABLES)
    assert out.columns == docs.columns
    ids = {r["doc_id"]: r["lang"] for r in out.collect()}
    assert set(ids) == {r["doc_id"] for r in docs.collect()} | {10**6 + 2} and ids[10**6 + 2] is not None


def test_join_stage_keeps_one_of_each_group(spark, docs):
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows |= {10**6 + i: rows[d] + " end" * (i % 2) for i, d in enumerate(sorted(rows)[:20])}
    extra = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows.items() if d >= 10**6], docs.schema)
    out = STAGES["jaccard_join"](spark, docs.unionByName(extra), TABLES)
    sets = {d: shingles(t) for d, t in rows.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == set(groups(sets, links).values())


def test_secret_stage_masks(spark, docs):
    planted = spark.createDataFrame([(10**6, "my password=hunter2hunter2 here", "en", "s", 31)], docs.schema)
    out = STAGES["secrets"](spark, docs.unionByName(planted), TABLES)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert out.columns == docs.columns and got[10**6] == ("my [SECRET] here", 16) and len(got) == docs.count() + 1
    assert sum(got[r["doc_id"]][0] == r["text"] for r in docs.collect()) > 0.8 * docs.count()


def test_mixing_stage_meets_targets(spark, docs):
    out = STAGES["mixing"](spark, docs, TABLES)
    sizes, taken, longest = collections.Counter(), collections.Counter(), collections.Counter()
    for r in docs.collect():
        n = len(r["text"].split())
        sizes[r["source"]] += n
        longest[r["source"]] = max(longest[r["source"]], n)
    for r in out.collect():
        taken[r["source"]] += len(r["text"].split())
    want = expected_targets(sizes)
    assert out.columns == docs.columns and all(abs(taken[s] - want[s]) <= longest[s] for s in sizes)


def test_last_stage_and_whole_run(spark, docs):
    codec = pieces.Codec(pieces.load_vocabulary(corpus_pipeline.PIECE_MODEL))
    out = STAGES["sentencepiece"](spark, docs, TABLES)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(codec.decode(r["piece_ids"]) == texts[r["doc_id"]] for r in out.collect())
    whole = corpus_pipeline.run(spark, TABLES)
    assert whole.columns == ["doc_id", "lang", "source", "piece_ids"]
    rows = whole.collect()
    assert 100 < len(rows) and max(collections.Counter(r["doc_id"] for r in rows).values()) <= 3
    sample = random.Random(1).sample(rows, 20)
    assert all("password=" not in codec.decode(r["piece_ids"]) for r in sample)


def test_stages_of_an_empty_table(spark, docs):
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, TABLES).count() == 0
