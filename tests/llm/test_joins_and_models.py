"""Joins, vectors, shards and trained models against brute force, and on odd rows."""

import collections
import itertools
import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import small_tree
from partloom.llm import components, jaccard_join, language_crf, suffix_tree, token_shards, vector_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def groups(nodes, links):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


# ---- components


def test_components_of_paths_stars_and_noise(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(5, 5), (7, 3), (3, 7)]
    links += [(rng.randint(200, 320), rng.randint(200, 320)) for _ in range(70)]
    got = components.connected_components(spark.createDataFrame([*links, (None, 3)], "a bigint, b bigint")).collect()
    real = [(a, b) for a, b in links if a != b]
    want = groups({x for p in real for x in p}, real)
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_of_many_slices_and_of_one(spark, monkeypatch):
    """What fits a slice is done without a round; what doesn't goes on with them, to the same components."""
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(-50, 60)] + [(rng.randint(200, 900), rng.randint(200, 900)) for _ in range(500)]
    links = [(a, b) for a, b in links if a != b] * 2
    want = groups({x for p in links for x in p}, links)
    df = spark.createDataFrame(links, "a bigint, b bigint").repartition(7)
    stored = []
    monkeypatch.setattr(components, "checkpointed", lambda df, name, store=components.checkpointed: (stored.append(name), store(df, name))[1])
    for size, rounds in ((20, True), (components.SLICE_LINKS, False)):
        stored.clear()
        got = components.connected_components(df, slice_links=size).collect()
        assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)
        assert ("stars" in stored) == rounds


# ---- n-gram join


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def near_texts():
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(1, 6)))
    passage = [word() for _ in range(45)]
    texts = [None, "", " \t", "one", "ONE", "one two", "one two three four", "a b c d e", "A b\nc d  e"]
    for size in (6, 9, 14, 25, 60, 130, 400):
        for _ in range(3):
            base = [word() for _ in range(size)]
            texts.append(" ".join(base))
            for _ in range(9):
                copy = list(base)
                for _ in range(rng.randint(0, max(1, size // 14))):
                    at = rng.randrange(len(copy))
                    copy[at : at + rng.randint(0, 1)] = [word()] if rng.random() < 0.7 else []
                texts.append(" ".join(copy))
    # A shared passage that is most of many texts.
    texts += [" ".join(passage + [word() for _ in range(rng.randint(0, 40))]) for _ in range(90)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(
    "join", [jaccard_join.Join(), jaccard_join.Join(slack=1.0, small_slack=0.0, small=0, filter_bits=1 << 12)], ids=["default", "lacking units"]
)
def test_links_are_exact(spark, join, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CROWD", 8)
    monkeypatch.setattr(jaccard_join, "CROWD_BLOCK", 16)
    texts = near_texts()
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    links = [
        (a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    want = groups(sets, links)
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    got = jaccard_join.similar_documents(spark.createDataFrame(rows, DOCS + ", node string").repartition(5), join).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(sets[i]), want[i]) for i in sets}
    assert 20 < len(set(want.values())) < len(sets) - 50


def test_ids_that_are_null_or_repeated(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(5, long), (5, long), (9, long + " end"), (None, long), (3, None), (7, "other text of its own"), (7, "first words"), (8, "first words")]
    got = jaccard_join.similar_documents(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1), (3, 3), (5, 5), (5, 5), (7, 7), (7, 7), (8, 7), (9, 5)]
    kept = jaccard_join.one_per_group(spark.createDataFrame(rows, DOCS)).collect()
    # The repeated row (5, long) is there once.
    assert sorted(r["doc_id"] or -1 for r in kept) == [-1, 3, 5, 7, 7]
    assert jaccard_join.similar_documents(spark.createDataFrame([], DOCS)).count() == 0


# ---- vectors


def test_repeated_ids_and_tiny_doubles(spark):
    """Vectors of one id are linked by their cosine alone, and doubles are not rounded to floats."""
    doubles = "vec_id bigint, embedding array<double>, class_id string"
    rows = [(5, [1.0, 0.0], "x"), (5, [0.0, 1.0], "x"), (6, [1.0, 0.1], "x"), (7, [1e-60, 0.0], "x"), (8, [0.0, 1e-60], "x"), (9, [1e-300, 1e-302], "x"), (10, [1e300, 1e290], "x")]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.near_duplicates(spark.createDataFrame(rows, doubles)).collect())
    # 5a, 6, 7, 9 and 10 point one way, 5b and 8 another.
    assert got == [(5, 1, 5, True), (5, 4, 5, True), (6, 4, 5, False), (7, 4, 5, False), (8, 1, 5, False), (9, 4, 5, False), (10, 4, 5, False)]
    assert vector_dedup.near_duplicates(spark.createDataFrame([(1, [0.0, 0.0], "x"), (2, [0.0, 0.0], "x"), (None, [1.0, 0.0], "x")], doubles)).filter("n_links > 0").count() == 0


def test_smallest_reachable_numbers():
    rng = np.random.default_rng(9)
    for size, links in ((50, 30), (200, 150), (300, 600)):
        x, y = rng.integers(0, size, links), rng.integers(0, size, links)
        want = groups(range(size), zip(x.tolist(), y.tolist()))
        assert vector_dedup._smallest_reachable(size, x, y).tolist() == [want[i] for i in range(size)]
    path = np.arange(1000)
    assert (vector_dedup._smallest_reachable(1001, path + 1, path) == 0).all()


def test_recall_among_many_vectors(spark):
    """Of all links among 20,000 vectors, many just above the threshold, at least nine in ten are found, and none below it."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((14_000, 64))
    near = base[:6_000] / np.linalg.norm(base[:6_000], axis=1, keepdims=True)
    side = rng.standard_normal(near.shape)
    side -= (side * near).sum(axis=1, keepdims=True) * near
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.86, 0.96, (6_000, 1))
    x = np.concatenate([base, cosine * near + np.sqrt(1 - cosine**2) * side]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(8)
    got = {r["vec_id"]: r["n_links"] for r in vector_dedup.near_duplicates(frame).collect()}
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = np.concatenate([(unit[at : at + 2000] @ unit.T >= 0.9).sum(axis=1) - 1 for at in range(0, len(x), 2000)])
    found = np.array([got[i] for i in range(len(x))])
    assert want.sum() > 5_000 and (found <= want).all() and found.sum() >= 0.9 * want.sum()


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 20))
    vectors = [v + rng.standard_normal(20) * s for v in base for s in (0.0, 0.1, 0.25, 0.4)]
    vectors += [vectors[0]] * 5 + [vectors[1] * 2.0]
    rows = [(i + 10, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    bad = [(1000, None), (1001, [0.0] * 20), (1002, []), (1003, [1.0] * 19 + [None]), (1004, [float("nan")] * 20), (1005, [float("inf")] + [1.0] * 19)]
    other = [(1006, [1.0, 2.0, 3.0]), (1007, [1.0, 2.0, 3.1]), (1007, [1.0, 2.0, 3.1])]
    schema = "vec_id bigint, embedding array<float>, copies int"
    frame = spark.createDataFrame([(*r, 0) for r in rows + bad + other], schema)
    got = {r["vec_id"]: r for r in vector_dedup.near_duplicates(frame).collect()}
    matrix = np.array([r[1] for r in rows])
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    near = matrix @ matrix.T >= 0.9
    want = groups(range(10, 10 + len(rows)), [(i + 10, j + 10) for i, j in zip(*np.nonzero(near)) if i < j])
    for i in range(len(rows)):
        r = got[i + 10]
        assert (r["n_links"], r["component_id"], r["kept"]) == (near[i].sum() - 1, want[i + 10], want[i + 10] == i + 10)
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] and got[i]["component_id"] == i for i, _ in bad)
    assert (got[1006]["n_links"], got[1007]["n_links"], got[1007]["component_id"]) == (1, 1, 1006)
    assert vector_dedup.near_duplicates(frame.limit(0)).count() == 0 and vector_dedup.near_duplicates(frame.filter("vec_id < 1")).count() == 0


def test_large_buckets_are_cut_and_counted_once(spark):
    rng = np.random.default_rng(4)
    vectors = np.float32(rng.standard_normal(16)) + np.float32(rng.standard_normal((150, 16)) * 0.1)
    classes = spark.createDataFrame([(i, [float(x) for x in v], 1) for i, v in enumerate(vectors)], "class_id bigint, vector array<float>, copies bigint")
    hashing = vector_dedup.plan_hashing(150, 16, 0.9)
    out = vector_dedup.link_vectors(classes, 16, 0.9, hashing, block_rows=20).filter("kind = 0").groupBy("a").agg(F.sum("b").alias("n")).collect()
    unit = vectors.astype(np.float64) / np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True)
    assert {r["a"]: r["n"] for r in out} == {i: n - 1 for i, n in enumerate((unit @ unit.T >= 0.9).sum(axis=1).tolist()) if n > 1}


# ---- token shards


@pytest.mark.parametrize("size", [1, 2, 5, 17, 1000, 4097])
def test_slots_are_a_permutation(size):
    assert sorted(token_shards.permuted(np.arange(size), size, "k").tolist()) == list(range(size))
    assert size < 100 or token_shards.permuted(np.arange(size), size, "k").tolist() != token_shards.permuted(np.arange(size), size, "j").tolist()


def test_shards_hold_all_tokens_in_slots(spark):
    from partloom.llm.queries import BYTE_END, BYTE_PATTERN, BYTE_RANKS

    tokenizer = token_shards.load_tokenizer(BYTE_RANKS, BYTE_PATTERN, BYTE_END)
    encode = token_shards._encoding(tokenizer).encode_ordinary
    rows = [(i, "some words é of text %d " % i * (i % 9), 1) for i in range(60)] + [(None, "no id", 1), (70, None, 1), (71, "long " * 5000, 1), (72, "two  blanks \n\n\t and\u2003\u2003more ", 1)]
    docs = spark.createDataFrame(rows, DOCS + ", slot int").repartition(3, "doc_id")
    shards = token_shards.write_shards(docs, tokenizer, length=16, shard_records=50)
    manifest = shards.manifest.collect()
    assert sorted(r["slot"] for r in manifest) == list(range(shards.sequences))
    tokens = {r["slot"]: r["tokens"] for r in token_shards.read_sequences(spark, shards).collect()}
    # Sequences of a document follow its starts: put every document together again.
    found = collections.defaultdict(dict)
    for r in manifest:
        cuts = [*r["starts"], r["n_tokens"]]
        for k, (doc, start) in enumerate(zip(r["doc_ids"], r["starts"])):
            found[doc][-start if start < 0 else 0] = tokens[r["slot"]][max(start, 0) : cuts[k + 1]]
    whole = {d: [t for at in sorted(parts) for t in parts[at]] for d, parts in found.items()}
    for doc, text, _ in rows:
        assert whole[doc] == encode(text or "") + [BYTE_END], doc
    part = token_shards.read_sequences(spark, shards, 45, 10).collect()
    assert {r["slot"]: r["tokens"] for r in part} == {s: tokens[s] for s in range(45, 55)}
    again = token_shards.write_shards(docs, tokenizer, length=16, shard_records=50).manifest
    assert sorted((r["slot"], r["crc"]) for r in again.collect()) == sorted((r["slot"], r["crc"]) for r in manifest)
    empty = token_shards.write_shards(docs.limit(0), tokenizer)
    assert empty.sequences == 0 and empty.manifest.count() == 0 and token_shards.read_sequences(spark, empty).count() == 0


# ---- language


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(5)
    lengths, size = np.array([5, 3, 1]), 3
    scores, moves, start = rng.standard_normal((5, 3, size)), rng.standard_normal((size, size)), rng.standard_normal(size)
    got, expected = language_crf.forward_backward(scores, lengths, moves, start, pairs=True)
    pairs = np.zeros((size, size))
    for k, n in enumerate(lengths):
        total, marginal, moved = 0.0, np.zeros((n, size)), np.zeros((size, size))
        for path in itertools.product(range(size), repeat=int(n)):
            value = start[path[0]] + sum(scores[t, k, path[t]] for t in range(n)) + sum(moves[a, b] for a, b in zip(path, path[1:]))
            weight = math.exp(value)
            total += weight
            for t in range(n):
                marginal[t, path[t]] += weight
            for a, b in zip(path, path[1:]):
                moved[a, b] += weight
        assert np.allclose(got[:n, k], marginal / total)
        pairs += moved / total
    assert np.allclose(expected, pairs)


def language_texts():
    rng = random.Random(6)
    stock = {"xx": ["the", "and", "of", "thing", "being", "lowly"], "yy": ["der", "und", "sich", "schau", "keit", "über"]}
    return [(i, " ".join(rng.choices(stock[x], k=rng.randint(5, 60))), x) for i, x in enumerate(rng.choices(["xx", "yy"], k=160))]


def test_language_of_texts_and_words(spark):
    rows = language_texts()
    docs = spark.createDataFrame(rows, DOCS + ", lang string")
    model = language_crf.train(language_crf.training_documents(docs.filter("doc_id % 4 <> 2").unionByName(docs.limit(1).withColumn("lang", F.lit(None).cast("string")))))
    assert model.languages == ("xx", "yy")
    out = language_crf.predict(docs.withColumn("language", F.lit(1)), model).filter("doc_id % 4 = 2").collect()
    assert sum(r["language"]["lang"] == r["lang"] for r in out) >= 0.95 * len(out)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "The THE and " * 40000), (5, "...über, und!")], DOCS)
    got = {r["doc_id"]: (r["language"]["lang"], r["language"]["score"]) for r in language_crf.predict(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "xx" and got[5][0] == "yy" and all(0 <= s <= 1 for _, s in got.values())
    mixed = spark.createDataFrame([("the thing and being 7 lowly of und der sich schau keit über",), (None,)], "text string")
    labels = [r[0] for r in mixed.select(language_crf.word_labels(F.col("text"), model)).collect()]
    assert [w["lang"] for w in labels[0]] == ["xx"] * 6 + ["yy"] * 6 and labels[1] == []


def test_training_holds_features_as_numbers():
    """The features of all words of the sample lie in the driver's memory as an array, not as a list of objects."""
    words = [f"{a}{b}{c}qrstuvwxyz" for a in "abcdefghijklmnop" for b in "abcdefghijklmnop" for c in "abcdefghijklmnop"]

    class Sample:
        def collect(self):
            return [{"lang": "x", "text": " ".join(words)}]

    tracemalloc.start()
    language_crf.train(Sample(), epochs=0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    features = sum(len(language_crf.word_features(w, {}, 1 << 15)) for w in words)
    assert features > 70_000 and peak < 32 * features + 2_500_000


def test_language_without_examples(spark):
    docs = spark.createDataFrame([(1, "words", None)], DOCS + ", lang string")
    model = language_crf.train(language_crf.training_documents(docs))
    assert [(r["language"]["lang"], r["language"]["score"]) for r in language_crf.predict(docs, model).collect()] == [("und", 0.0)]
    assert language_crf.predict(docs.limit(0), model).count() == 0


# ---- language model


def test_scores_against_counts(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices(["The", "the", "cat", "sat", "mat", "on", f"rare{i}"], k=rng.randint(0, 40))), 0) for i in range(200)]
    rows += [(300, None, 0), (301, "", 0), (None, "the cat", 0), (5, "the cat sat", 0), (302, "the " * 20000, 0)]
    docs = spark.createDataFrame(rows, DOCS + ", row int").repartition(3)
    out = suffix_tree.score_documents(docs, F.col("doc_id") % 5 != 1, suffix_tree.Shares(head=0.001)).collect()
    assert len(out) == len(rows)
    tokens = lambda t: WORD.findall((t or "").translate(LOWER)) + [""]
    counts = collections.Counter(w for d, t, _ in rows if d is not None and d % 5 != 1 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter()
    for d, t, _ in rows:
        own = tokens(t)
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        want[d, len(own), sum(counts[w] > 0 for w in own), n, round(base, 6)] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    assert all(r["score"] <= 0 for r in out)


def test_states_hold_distributions():
    """After every state the probabilities of all tokens and of the unknown one add up to 1."""
    rng = random.Random(8)
    corpus, at = [], 0
    for _ in range(30000):
        at = rng.choices(range(5), weights=[1 + 9 * ((at + 1) % 5 == x) for x in range(5)])[0]
        corpus.append(at)
    pairs, triples = collections.Counter(zip(corpus, corpus[1:])), collections.Counter(zip(corpus, corpus[1:], corpus[2:]))
    root = np.array([corpus.count(x) for x in range(5)])
    tree = small_tree.build(
        root, len(corpus), 5, {a * 4 + b: c for (a, b), c in pairs.items() if b < 4}, {(a * 5 + b) * 4 + c: n for (a, b, c), n in triples.items() if c < 4}, 5, 5, 4
    )
    assert not np.isnan(tree.factor1[:5]).any()
    unknown = 5 / (len(corpus) + 5)
    for history in [[], *([a] for a in range(5)), *([a, b] for a in range(5) for b in range(5))]:
        total = sum(10 ** small_tree.token_scores(tree, np.array([*history, x]), np.array([0]))[-1] for x in range(5))
        # A token outside the head gets the factor of its state only; its root probability is the unknown mass.
        total += unknown * 10 ** small_tree.token_scores(tree, np.array([*history, -1]), np.array([0]))[-1]
        assert total == pytest.approx(1.0, abs=1e-9), history


def test_tables_hold_distributions_at_depth_three(spark):
    """After up to three tokens the probabilities of all tokens and the unknown one, as the tables give them, add up to 1."""
    rng = random.Random(9)
    words, texts = [f"w{i}" for i in range(5)], []
    for _ in range(300):
        own = [0, 1, 2]
        for _ in range(80):
            nearby = (own[-1] + own[-2] * own[-3] + 1) % 5
            own.append(rng.choices(range(5), weights=[1 + 15 * (nearby == x) for x in range(5)])[0])
        texts.append(" ".join(words[x] for x in own))
    table, tokens, _ = suffix_tree.values(spark.createDataFrame(list(enumerate(texts)), DOCS), F.lit(True))
    rows = {r["gram"]: r for r in table.collect()}
    hashes = suffix_tree._WordHashes()

    def gram(sequence):
        grams = np.array([hashes[w] for w in sequence], dtype=np.int64)
        for n in range(2, len(sequence) + 1):
            grams = suffix_tree._longer(grams, n)
        return rows.get(int(grams[-1]), {"value": 0.0, "factor": 0.0})

    unknown, deep = math.log10(6 / (tokens + 6)), 0
    for size in range(4):
        for history in itertools.product([w.encode() for w in words], repeat=size):
            left = sum(gram(history[-k:])["factor"] for k in range(1, size + 1))
            deep += size == 3 and gram(history)["factor"] != 0
            total = 10 ** (unknown + left)
            for x in [*(w.encode() for w in words), suffix_tree.END]:
                total += 10 ** (left + gram([x])["value"] + sum(gram([*history[-k:], x])["value"] for k in range(1, size + 1)))
            assert total == pytest.approx(1.0, abs=1e-9), history
    assert deep > 20


def test_scores_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], DOCS)
    r = suffix_tree.score_documents(docs, F.lit(False)).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) == (3, 0, 0, 0.0) and r["base_score"] == pytest.approx(0.0)
    assert suffix_tree.score_documents(docs.limit(0), F.lit(True)).count() == 0


def test_tree_grows_with_the_input(spark):
    """Every sequence seen twice counts, as in the tree in memory over all counts, whatever its share of the tokens."""
    rng = random.Random(12)
    phrases = [" ".join(f"w{rng.randint(0, 3000)}" for _ in range(6)) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(phrases) for _ in range(8))) for i in range(1500)]
    texts = [t.encode().split() + [b""] for _, t in rows]
    ids = {w: i for i, (w, _) in enumerate(collections.Counter(w for t in texts for w in t).most_common())}
    numbered, v = [[ids[w] for w in t] for t in texts], len(ids)
    root = collections.Counter(x for t in numbered for x in t)
    pairs = collections.Counter(p for t in numbered for p in zip(t, t[1:]))
    triples = collections.Counter(p for t in numbered for p in zip(t, t[1:], t[2:]))
    tree = small_tree.build(
        np.array([root[i] for i in range(v)]), sum(root.values()), v,
        {a * v + b: c for (a, b), c in pairs.items() if c > 1}, {(a * v + b) * v + x: c for (a, b, x), c in triples.items() if c > 1}, v, v, v,
    )
    want = {i: small_tree.token_scores(tree, np.array(t), np.array([0])).sum() for i, t in enumerate(numbered)}
    docs = spark.createDataFrame(rows, DOCS)
    for head in (1e-3, 1.0):
        got = {r["doc_id"]: r["score"] for r in suffix_tree.score_documents(docs, F.lit(True), suffix_tree.Shares(head=head, depth=2)).collect()}
        assert got == pytest.approx(want, abs=1e-6)
    deep = {r["doc_id"]: r["score"] for r in suffix_tree.score_documents(docs, F.lit(True)).collect()}
    assert sum(deep.values()) > sum(want.values())


def test_hashing_tokens_remembers_no_words():
    """A worker's memory doesn't fill with words; a text's hashes don't depend on what was hashed with it."""
    suffix_tree._hashed(pa.array(["some words to begin with"]))
    tracemalloc.start()
    sizes = [len(suffix_tree._hashed(pa.array([" ".join(f"w{i}" for i in range(at, at + 1000))]))[0]) for at in range(0, 50_000, 1000)]
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert sizes == [1001] * 50 and held < 500_000
    ids, starts = suffix_tree._hashed(pa.array(["a B", None, "", "b\tA c"]))
    a, b, end, c = (suffix_tree._WordHashes()[w] for w in (b"a", b"b", suffix_tree.END, b"c"))
    assert ids.tolist() == [a, b, end, end, end, b, a, c, end] and starts.tolist() == [0, 3, 4, 5] and len({a, b, c, end}) == 4


def test_sequences_are_counted_a_length_and_a_part_at_a_time(spark):
    """However many rounds take their parts, together they have every sequence seen twice, once; no round has all of them."""
    rng = random.Random(21)
    texts = [" ".join(f"w{rng.randint(0, 40)}" for _ in range(rng.randint(0, 60))) for _ in range(300)]
    docs, hashes = spark.createDataFrame(list(enumerate(texts)), DOCS), suffix_tree._WordHashes()
    none = spark.sparkContext.broadcast((np.zeros(0, dtype=np.int64), np.zeros((0, 2))))
    for n in (2, 3, 4):
        want = collections.Counter()
        for t in texts:
            tokens = suffix_tree.tokens_of(t)
            grams = np.array([hashes[w] for w in tokens], dtype=np.int64)
            for k in range(2, n):
                grams = suffix_tree._longer(grams, k)
            want.update((int(grams[i - 1]), int(grams[i])) for i in range(n - 1, len(tokens)))
        want = {k: c for k, c in want.items() if c > 1}
        for rounds in (1, 4):
            found = []
            for part in suffix_tree.gram_counts(docs, F.lit(True), n, 12, none, None, rounds):
                lists = [[np.frombuffer(x, dtype=np.int64).tolist() for x in (r["a"], r["b"], r["c"])] for r in part.collect()]
                found.append([row for columns in lists for row in zip(*columns)])
            assert len(found) == rounds and all(found)
            rows = [row for part in found for row in part]
            assert len(rows) == len(want) and {(a, b): c for a, b, c in rows} == want


def test_a_full_filter_changes_no_score(spark):
    """The filters only spare work: as full as they get on inputs far larger than their bits, scores are the same."""
    rng = random.Random(22)
    phrases = [" ".join(f"w{rng.randint(0, 300)}" for _ in range(5)) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(phrases) for _ in range(8))) for i in range(400)] + [(None, "w1 w2"), (400, None), (400, "w1 new")]
    docs = spark.createDataFrame(rows, DOCS)
    assert suffix_tree._rounds(np.full(8, 255, dtype=np.uint8)) == 4 and suffix_tree._rounds(np.zeros(8, dtype=np.uint8)) == 1
    got = []
    for shares in (suffix_tree.Shares(), suffix_tree.Shares(head=1.0, filter_bits=64), suffix_tree.Shares(head=2e-3, filter_bits=64)):
        out = suffix_tree.score_documents(docs, F.col("doc_id") % 4 != 1, shares).collect()
        got.append(sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in out))
    assert len(got[0]) == len(rows) and got[0] == got[1] == got[2]


def test_scoring_shuffled_texts_stores_them(spark, monkeypatch):
    """Rounds tell rows by their place, so what a shuffle deals is read from one stored copy; tables that are read no more are freed."""
    stored, freed, store, free = [], [], suffix_tree._Steps.store, suffix_tree._Steps.free
    monkeypatch.setattr(suffix_tree._Steps, "store", lambda self, df, name: (stored.append(name), store(self, df, name))[1])
    monkeypatch.setattr(suffix_tree._Steps, "free", lambda self, *names: (freed.extend(names), free(self, *names))[1])
    docs = spark.createDataFrame([(i, f"a b c {i % 7} a b c") for i in range(50)], DOCS)
    got = []
    for given in (docs, docs.repartition(3, "text")):
        got.append(sorted((r["doc_id"], round(r["score"], 9)) for r in suffix_tree.score_documents(given, F.lit(True)).collect()))
        assert ("texts" in stored) == (given is not docs) and sorted({*freed, "sums"}) == sorted({*stored, "grams", "sums"})
    assert got[0] == got[1]


def test_hashes_of_words_of_any_size():
    """Words of up to 64 bytes are hashed by eights and longer ones one by one; each byte counts."""
    words = [b"a" * n for n in range(1, 200)] + [b"a" * n + b"b" for n in range(199)] + [b"b" + b"a" * n for n in range(1, 199)] + [bytes([0]), bytes([0, 0])]
    together = suffix_tree._word_hashes(b"\t " + b" \n".join(words) + b" ")
    assert len(set(together.tolist())) == len(words) == len(together)
    assert together.tolist() == [int(suffix_tree._word_hashes(w)[0]) for w in words]


def test_vocabulary_counts_words_across_slices(spark):
    """Counts of training texts and of all, in however many slices a task takes them."""
    rng = random.Random(2)
    rows = [(i, None if i == 7 else " ".join(f"w{rng.randint(0, 200)}" for _ in range(rng.randint(0, 30)))) for i in range(1200)]
    found = suffix_tree.vocabulary(spark.createDataFrame(rows, DOCS).coalesce(1), F.col("doc_id") % 3 != 1).collect()
    each = [(i % 3 != 1, w) for i, t in rows for w in suffix_tree.tokens_of(t)]
    n, c = collections.Counter(w for _, w in each), collections.Counter(w for known, w in each if known)
    hashes = suffix_tree._WordHashes()
    assert {r["gram"]: (r["c"], r["n"]) for r in found} == {hashes[w]: (c[w], n[w]) for w in n} and len(found) == len(n)


def test_a_shingler_remembers_no_words():
    """Words that were never seen before cost no more than others, and nothing of them stays."""
    shingler = jaccard_join.Shingler(jaccard_join.Join())
    shingler.shingles("some words to begin with")
    tracemalloc.start()
    sets = [shingler.shingles(" ".join(f"w{i}" for i in range(at, at + 1000))) for at in range(0, 50_000, 1000)]
    sizes = [len(s) for s in sets]
    del sets
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert sizes == [996] * 50 and held < 500_000
    a, b = shingler.shingles("A b  c d e f"), shingler.shingles("a B c d\te f a b c d e f")
    assert len(a) == 2 and set(a) < set(b) and len(b) == 6 and (np.diff(b.astype(object)) > 0).all()
    assert len(shingler.shingles("one two")) == 1 and not len(shingler.shingles(" \n")) and not len(shingler.shingles(None))
