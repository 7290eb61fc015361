"""The conversation trie against brute force, with containers that burst, and on odd rows."""

import hashlib
import random
import zlib

import pytest

from partloom.llm import conversation_trie as trie

TURNS = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def brute(conversations):
    """Nodes of `{conv_id: [(role, text), ...]}` by definition."""
    members = {}
    for conv, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), set()).add(conv)
    rows = set()
    for path, own in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[: len(p)] == p and len(q) > len(p) for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in sorted(c for c in own if len(conversations[c]) == len(path)))
        above = min(members[path[:-1]]) if path else None
        rows.add((min(own), len(path), above, len(own), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return rows


def table(spark, conversations):
    rows = [(c, i, role, text) for c, turns in conversations.items() for i, (role, text) in enumerate(turns)]
    return spark.createDataFrame(rows, TURNS)


def some_conversations(seed=1, n=150):
    rng = random.Random(seed)
    out = {}
    for c in rng.sample(range(1, 2000), n):
        out[c] = [(rng.choice(["user", "assistant"]), rng.choice(["", "a", "bé", "ccc\n"])) for _ in range(rng.randint(1, 6))]
    ids = sorted(out)
    for c in ids[:60]:
        out[c] = out[ids[70]]  # copies
    for c in ids[100:120]:
        out[c] = [("user", "same"), *out[c]]
    return out


@pytest.mark.parametrize("burst", [1, 3, 20, 1000])
def test_nodes_are_those_of_the_definition(spark, burst):
    conversations = some_conversations()
    got = trie.prefix_trie(trie.turn_sequences(table(spark, conversations).repartition(7)), burst=burst).select(*COLUMNS).collect()
    assert {tuple(r) for r in got} == brute(conversations)
    assert len({tuple(r) for r in got}) == len(got)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [
        (1, None, "user", "first"), (1, 0, None, None), (1, 5, "user", "x"),
        (2, None, "user", "first"), (2, 0, "", ""), (2, 5, "user", "x"),
        (3, 1, "user", "b"), (3, 1, "user", "a"), (3, 1, "user", "a"),
        (4, 1, "user", "a"), (4, 1, "user", "b"), (4, 1, "user", "a"),
        (None, 1, "user", "nobody"),
    ]
    frame = spark.createDataFrame([(*r, "clash", [1]) for r in rows], TURNS + ", container string, ids array<int>")
    got = trie.prefix_trie(trie.turn_sequences(frame)).collect()
    by_place = {(r["depth"], r["conv_id"]): r for r in got}
    # Null and empty are the same turn; ties have one order, so 1 and 2, and 3 and 4, are equal conversations.
    assert sorted(by_place) == [(0, 1), (1, 1), (1, 3), (2, 1), (2, 3), (3, 1), (3, 3)]
    assert by_place[3, 1]["ends_sha256"] == hashlib.sha256(b"1,2").hexdigest()
    assert by_place[0, 1]["saved_tokens"] == len("first") + len("x") + len("aab")
    assert trie.prefix_trie(trie.turn_sequences(frame.limit(0))).count() == 0


def test_long_conversations_and_texts(spark):
    long = [("user", "y" * 200_000), *[("user", str(i)) for i in range(3000)]]
    conversations = {7: long, 9: long[:2000], 8: [*long[:10], ("user", "other")], 11: long}
    got = trie.prefix_trie(trie.turn_sequences(table(spark, conversations)), burst=2).select(*COLUMNS).collect()
    assert len(got) == 3003 and max(r["depth"] for r in got) == 3001
    root = next(r for r in got if r["depth"] == 0)
    once = sum(len(t) for _, t in long)
    assert root["saved_tokens"] == once + sum(len(t) for _, t in long[:2000]) + sum(len(t) for _, t in long[:10])
    assert root["n_leaves"] == 2 and root["n_convs"] == 4


def test_end_hash_of_a_key_over_many_pieces(spark, monkeypatch):
    members = spark.range(5000).selectExpr("IF(id % 7 = 0, 'b', 'a') AS key", "id - 100 AS conv_id").repartition(8)
    got = {r["key"]: r["ends_sha256"] for r in trie.end_hashes(members).collect()}
    ids = {k: [i - 100 for i in range(5000) if (i % 7 == 0) == (k == "b")] for k in "ab"}
    assert got == {k: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for k, v in ids.items()}


def test_branches_of_a_family(spark):
    own = {c: [("user", f"{c}-{i}") for i in range(n)] for c, n in {100: 3, 101: 8, 102: 1, 199: 6, 205: 4, 0: 2, -5: 4}.items()}
    got = trie.prefix_trie(trie.branched(trie.turn_sequences(table(spark, own)))).select(*COLUMNS).collect()
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(int(c / 100) * 100, [])[:h] + turns[h:]
    assert {tuple(r) for r in got} == brute(rebuilt)
