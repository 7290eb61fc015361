"""The quality classifier: its n-grams, ratios and dual descent against plain code, held-out accuracy, odd rows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from partloom.llm import nb_svm
from partloom.llm.queries import LLM_QUERIES

ROWS = "doc_id bigint, text string, label int"
SMALL = nb_svm.Settings(buckets=1 << 12, sample=200)


def grams(words, settings):
    """Distinct n-grams of a text, each as a tuple that names its stream."""
    shapes = ["=" if i and w == words[i - 1] else nb_svm.shape(w) for i, w in enumerate(words)]
    out = set()
    for name, stream, longest in (("w", [w.lower() for w in words], settings.word_grams), ("s", shapes, settings.shape_grams)):
        for n in range(1, longest + 1):
            out |= {(name, n, tuple(stream[i : i + n])) for i in range(len(words) - n + 1)}
    return out


def test_buckets_stand_for_ngrams():
    settings = nb_svm.Settings(buckets=1 << 40)
    texts = [t.split() for t in ("the The cat | cat", "", "a", "the the the", "xx## 12 a.b !!! Word. WORD, wOrd a,,,", "cat | cat the")]
    found, ends = nb_svm.features([[w.encode() for w in t] for t in texts], settings, nb_svm._Memo())
    sets = [set(found[a:b].tolist()) for a, b in itertools.pairwise(ends)]
    want = [grams(t, settings) for t in texts]
    assert [len(s) for s in sets] == [len(w) for w in want]
    for i, j in itertools.combinations(range(len(texts)), 2):
        assert len(sets[i] & sets[j]) == len(want[i] & want[j])
    assert nb_svm.shape("Abc12!!!x") == "Aa0!!a"
    for word in ("Été,", "ÜBER!!!", "a", "A", "aB", "", "|", "1984.", "x###"):
        assert nb_svm.shape(word) == nb_svm._runs(word)


def test_dual_descent_reaches_the_optimum_of_the_hinge_loss():
    rng = np.random.default_rng(1)
    lists = [np.sort(rng.choice(30, 6, replace=False)) for _ in range(60)]
    labels = np.array([int((x < 15).sum() >= 3) for x in lists])
    ratios = rng.uniform(0.2, 1, 30)
    settings = nb_svm.Settings(cost=1.0, epochs=3000)
    weights, bias = nb_svm.dual_descent(lists, labels, ratios, settings)
    share = np.bincount(labels, minlength=2) / 60
    x = np.zeros((60, 31))
    for i, b in enumerate(lists):
        x[i, b] = ratios[b] / np.linalg.norm(ratios[b])
        x[i, 30] = 1
    y, cost = np.where(labels == 1, 1, -1), 0.5 / share[labels]

    def loss(w):
        return 0.5 * w @ w + (cost * np.maximum(0, 1 - y * (x @ w))).sum()

    found = np.append(weights, bias)
    best = loss(found)
    for _ in range(3000):
        assert loss(found + rng.standard_normal(31) * 10.0 ** -rng.uniform(1, 4)) >= best - 1e-2


def toy(n=200):
    rng = np.random.default_rng(2)
    good, bad = ["one", "two", "three", "four", "five"], ["buy", "now", "$$$", "click", "five"]
    return [(i, " ".join(rng.choice(bad if i % 4 == 0 else good, 8)), int(i % 4 != 0)) for i in range(n)]


def test_counts_cover_all_rows(spark):
    rows = toy(60)
    frame = spark.createDataFrame([(i, y, i, t) for i, t, y in rows], "doc_id bigint, label int, pick bigint, text string").repartition(5)
    counts = nb_svm.class_counts(nb_svm.indicators(frame, SMALL), SMALL)
    want = np.zeros((2, SMALL.buckets))
    for _, t, y in rows:
        found, _ = nb_svm.features([t.encode().split()], SMALL, nb_svm._Memo())
        want[y, found] += 1
    assert (counts == want).all()


def test_odd_rows_and_missing_classes(spark):
    rows = [*toy(), (900, None, 1), (901, "", 1), (None, "one two three", 1), (902, "one two", None), (903, "one two", 7)]
    frame = spark.createDataFrame([(*r, "clash", [1.0]) for r in rows], ROWS + ", words string, score array<double>")
    model = nb_svm.train(frame, SMALL)
    docs = [(1, "buy now click"), (2, "one two three"), (2, "one two three"), (None, "one"), (3, None), (4, " \n"), (5, "unseen words only"), (6, "one two " * 60_000)]
    got = nb_svm.score(spark.createDataFrame([(*r, "x") for r in docs], "doc_id bigint, text string, pick string"), model).collect()
    scores = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got)
    assert scores[1] < 0.3 < 0.9 < scores[2] and scores[6] > 0.9 and scores[3] == scores[4]
    again = nb_svm.score(spark.createDataFrame([(*r, "x") for r in docs], "doc_id bigint, text string, pick string").repartition(3), model).collect()
    assert {(r["doc_id"], r["score"]) for r in again} == {(r["doc_id"], r["score"]) for r in got}
    assert nb_svm.score(frame.limit(0), model).count() == 0
    one_class = nb_svm.train(frame.filter("label = 1"), SMALL)
    assert nb_svm.score(frame, one_class).filter("score < 0.9").count() == 0
    nobody = nb_svm.train(frame.limit(0), SMALL)
    assert nb_svm.score(frame, nobody).filter("score <> 0.5").count() == 0


def test_several_labels_of_a_document(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, None), (3, 0), (None, 1)], "doc_id bigint, quality int")
    got = nb_svm.training_rows(docs, labels, "quality").collect()
    assert {(r["doc_id"], r["label"]) for r in got} == {(1, 1), (3, 0)}


def test_labelled_rows_are_bounded_by_class(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "'t' AS text")
    labels = spark.range(300).selectExpr("id AS doc_id", "CAST(id % 3 > 0 AS INT) AS quality")
    frame = nb_svm.training_rows(docs, labels, "quality", nb_svm.Settings(labelled=40))
    got = frame.groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got} == {0: 40, 1: 40}
    assert frame.exceptAll(nb_svm.training_rows(docs.repartition(3), labels.repartition(5), "quality", nb_svm.Settings(labelled=40))).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    found = LLM_QUERIES["op13_quality_classifier"].plan(spark, d).filter("held_out")
    known = found.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("quality", "predicted", "score").collect()
    good, bad = [r for r in known if r["quality"] == 1], [r for r in known if r["quality"] == 0]
    assert len(good) > 50 and len(bad) > 8
    assert sum(r["predicted"] for r in good) >= 0.98 * len(good) and sum(r["predicted"] for r in bad) <= 0.1 * len(bad)
    assert sum(g["score"] > b["score"] for g in good for b in bad) >= 0.98 * len(good) * len(bad)
