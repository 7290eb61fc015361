"""Prefix trie of conversations as burst tries.

Equal conversations are one suffix with a weight. All suffixes start in the container of the root. A container
with too many of them bursts: it becomes a trie head, and its suffixes are dealt by their next turn into
containers below it. Heads are few, since each holds more suffixes than a container may. What is left is sorted
by Spark, container by container, and swept once into nodes. Sums over subtrees of heads are put together at the
end from the tops of the containers below them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from partloom.session import Rounds, broadcast_if_small, checkpointed

BURST = 256
NO_ENDS = hashlib.sha256(b"").hexdigest()
PIECE_CHARS = 1 << 20
BATCH_NODES = 50_000

SUFFIX = "ids array<string>, chars array<bigint>, n bigint, least bigint, ends_sha256 string, container string, path array<string>, parent_least bigint"
HEAD = "container string, path array<string>, parent_least bigint, least bigint, n bigint, chars bigint, turn_id string, ends_sha256 string"
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, turn_id string, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def turn_sequences(turns: DataFrame) -> DataFrame:
    """`(conv_id, turns)`: the turns of each conversation in order, as an array of `(id, chars)`.

    `turns` has `conv_id, turn, role, text`; other columns are ignored. The id stands for role and text (128 bits),
    `chars` are the code points of the text. A null role or text is empty, a null turn comes first, and equal
    turns follow each other by id. Rows without a `conv_id` belong to no conversation. A conversation is one row of
    ids, as a text is one row of `documents`.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn_id = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.struct("turn", turn_id.alias("id"), F.length(text).cast("bigint").alias("chars")).alias("_t")
    )
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("_t")).alias("_t"))
    return ordered.select("conv_id", F.transform("_t", lambda t: F.struct(t["id"].alias("id"), t["chars"].alias("chars"))).alias("turns"))


def end_hashes(members: DataFrame) -> DataFrame:
    """`(key, ends_sha256)`: SHA-256 of the comma-joined `conv_id`s of each key in ascending order.

    `members(key, conv_id)` must be stored. Ids are joined to pieces where the range partitions hold them, so a key of
    any size is spread; the hash, which has to run from the first id to the last, then reads few rows a key and
    keeps only its state.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, parts, size = None, 0, [], 0
        out: list[tuple[str, int, str]] = []
        for batch in batches:
            for k, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
                if k != key or size > PIECE_CHARS:
                    if parts:
                        out.append((key, first, ",".join(parts)))
                    key, first, parts, size = k, conv, [], 0
                parts.append(str(conv))
                size += len(parts[-1]) + 1
            if len(out) > 10_000:
                yield _rows(out, "key string, first bigint, part string")
                out = []
        if parts:
            out.append((key, first, ",".join(parts)))
        yield _rows(out, "key string, first bigint, part string")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, hashlib.sha256()
        for batch in batches:
            out = []
            for k, part in zip(batch.column("key").to_pylist(), batch.column("part")):
                if k != key:
                    if key is not None:
                        out.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(part.as_py().encode())
            yield _rows(out, "key string, ends_sha256 string")
        if key is not None:
            yield _rows([(key, state.hexdigest())], "key string, ends_sha256 string")

    ranged = members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = ranged.mapInArrow(joined, "key string, first bigint, part string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed, "key string, ends_sha256 string")


ARROW = {"string": pa.string(), "bigint": pa.int64()}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [part.split() for part in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


def container_nodes(suffixes: list[tuple], depth: int, parent_least: int | None) -> list[tuple]:
    """Nodes of one container, its top first, from its sorted suffixes `(ids, chars, n, least, ends)`.

    All suffixes agree in the first `depth` turns. Rows are as in `NODE`.
    """
    parents, depths, turn_ids, chars = [], [], [], []
    convs, leasts, ends = [], [], []
    previous: list[str] = []
    stack: list[int] = []

    def push(d: int, ids: list[str], sizes: list[int]) -> None:
        parents.append(stack[-1] if stack else -1)
        depths.append(d)
        turn_ids.append(ids[d - 1] if d else None)
        chars.append(sizes[d - 1] if d else 0)
        convs.append(0)
        leasts.append(None)
        ends.append(NO_ENDS)
        stack.append(len(depths) - 1)

    for ids, sizes, n, least, end in suffixes:
        if not stack:
            push(depth, ids, sizes)
        common, most = depth, min(len(previous), len(ids))
        while common < most and previous[common] == ids[common]:
            common += 1
        del stack[common - depth + 1 :]
        for d in range(common + 1, len(ids) + 1):
            push(d, ids, sizes)
        convs[stack[-1]], leasts[stack[-1]], ends[stack[-1]] = n, least, end
        previous = ids
    children, leaves, saved = [0] * len(depths), [0] * len(depths), [0] * len(depths)
    for i in range(len(depths) - 1, -1, -1):  # children come after their parents
        leaves[i] = leaves[i] or 1
        saved[i] += (convs[i] - 1) * chars[i]
        p = parents[i]
        if p >= 0:
            convs[p] += convs[i]
            leasts[p] = leasts[i] if leasts[p] is None else min(leasts[p], leasts[i])
            children[p] += 1
            leaves[p] += leaves[i]
            saved[p] += saved[i]
    above = [leasts[p] if p >= 0 else parent_least for p in parents]
    return list(zip(leasts, depths, above, turn_ids, convs, children, leaves, saved, ends))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of sorted containers; `head` names the head above the top of each."""
    schema = f"{NODE}, head string"
    out: list[tuple] = []
    container, depth, above, head = None, 0, None, None
    held: list[tuple] = []

    def close() -> None:
        nodes = container_nodes(held, depth, above)
        out.append((*nodes[0], head))
        out.extend((*x, None) for x in nodes[1:])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("container", "depth", "parent_least", "head", "ids", "chars", "n", "least", "ends_sha256")]
        for c, d, p, h, *suffix in zip(*columns):
            if c != container:
                if held:
                    close()
                container, depth, above, head, held = c, d, p, h, []
                if len(out) > BATCH_NODES:
                    yield _rows(out, schema)
                    out = []
            held.append(tuple(suffix))
    if held:
        close()
    yield _rows(out, schema)


def prefix_trie(sequences: DataFrame, *, burst: int = BURST) -> DataFrame:
    """One row per node of the trie over `sequences(conv_id, turns)`; `turns` is an array of `(id, chars)`.

    `conv_id` must be unique and not null. A node is a distinct sequence of the first `depth` turns of some
    conversation. Returns `conv_id` (smallest member), `depth`, `parent_conv_id` (null at the root), `turn_id`
    (id of the last turn), `n_convs`, `n_children`, `n_leaves`, `saved_tokens` (sum over the subtree of
    `(members - 1) * chars`) and `ends_sha256` (of the members that end here). `(depth, conv_id)` is unique.
    Conversations without turns end at the root. Any number of equal conversations is one suffix. An empty table
    has no nodes. The number of rounds is the depth at which more than `burst` different conversations still
    agree; each round stores what is still in play.
    """
    spark = sequences.sparkSession
    split = sequences.select(
        "conv_id", F.transform("turns", lambda t: t["id"]).alias("ids"), F.transform("turns", lambda t: t["chars"].cast("bigint")).alias("chars")
    ).withColumn("key", F.md5(F.array_join("ids", "")))
    stored = checkpointed(split, "trie-sequences")
    members = stored.select("key", "conv_id")
    classes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")).join(end_hashes(members), "key")
    # One conversation stands for all that are equal to it.
    suffixes = stored.drop("key").join(classes.withColumn("conv_id", F.col("least")), "conv_id")
    none = F.lit(None)
    active = suffixes.select(
        "ids", "chars", "n", "least", "ends_sha256", F.lit("").alias("container"),
        F.expr("CAST(array() AS array<string>)").alias("path"), none.cast("bigint").alias("parent_least"),
    )
    settled, heads = Rounds(spark, "trie-containers", SUFFIX), Rounds(spark, "trie-heads", HEAD)
    depth = 0
    while True:
        active = checkpointed(active, "trie-active")
        ends_here = F.size("ids") == depth
        last = F.lit(depth)
        sizes = active.groupBy("container").agg(
            F.count(F.lit(1)).alias("_suffixes"), F.first("path").alias("path"), F.first("parent_least").alias("parent_least"),
            F.min("least").alias("least"), F.sum("n").alias("n"),
            (F.max(F.element_at("chars", last)) if depth else F.lit(0).cast("bigint")).alias("chars"),
            (F.max(F.element_at("ids", last)) if depth else none.cast("string")).alias("turn_id"),
            F.coalesce(F.max(F.when(ends_here, F.col("ends_sha256"))), F.lit(NO_ENDS)).alias("ends_sha256"),
        )
        large = checkpointed(sizes.filter(F.col("_suffixes") > burst).drop("_suffixes"), "trie-large")
        if large.isEmpty():
            settled.add(active, depth)
            break
        heads.add(large, depth)
        marked = active.join(broadcast_if_small(large.select("container", F.col("least").alias("_head_least"))), "container", "left")
        settled.add(marked.filter(F.col("_head_least").isNull()).select(*active.columns), depth)
        following = F.get("ids", F.lit(depth))
        active = marked.filter(F.col("_head_least").isNotNull() & ~ends_here).select(
            "ids", "chars", "n", "least", "ends_sha256", F.md5(F.concat("container", following)).alias("container"),
            F.array_append("path", F.col("container")).alias("path"), F.col("_head_least").alias("parent_least"),
        )
        depth += 1
    rows = settled.read().select(
        F.col("turn").cast("bigint").alias("depth"), "container", "parent_least", F.try_element_at("path", F.lit(-1)).alias("head"),
        "ids", "chars", "n", "least", "ends_sha256",
    )
    swept = rows.repartition("container").sortWithinPartitions("container", "ids").mapInArrow(_sweep, f"{NODE}, head string")
    if depth == 0:
        return swept.drop("head")
    swept = checkpointed(swept, "trie-nodes")
    return swept.drop("head").unionByName(_head_nodes(heads.read(), swept))


def _head_nodes(heads: DataFrame, swept: DataFrame) -> DataFrame:
    """Nodes of the heads, with the tops of the containers below them added up along the paths."""
    tops = swept.filter(F.col("head").isNotNull()).groupBy(F.col("head").alias("container")).agg(
        F.count(F.lit(1)).alias("_tops"), F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved")
    )
    zero = F.lit(0).cast("bigint")
    own = checkpointed(
        heads.join(tops, "container", "left").withColumns(
            {
                "_tops": F.coalesce("_tops", zero),
                "_leaves": F.coalesce("_leaves", zero),
                "_saved": F.coalesce("_saved", zero) + (F.col("n") - 1) * F.col("chars"),
            }
        ),
        "trie-head-sums",
    )
    spread = own.select(F.explode(F.array_append("path", F.col("container"))).alias("container"), "_leaves", "_saved")
    sums = spread.groupBy("container").agg(F.sum("_leaves").alias("n_leaves"), F.sum("_saved").alias("saved_tokens"))
    below = own.filter(F.size("path") > 0).groupBy(F.element_at("path", -1).alias("container")).agg(F.count(F.lit(1)).alias("_heads"))
    return (
        own.join(sums, "container")
        .join(below, "container", "left")
        .select(
            F.col("least").alias("conv_id"), F.col("turn").cast("bigint").alias("depth"), F.col("parent_least").alias("parent_conv_id"), "turn_id",
            F.col("n").alias("n_convs"), (F.col("_tops") + F.coalesce("_heads", zero)).alias("n_children"), "n_leaves", "saved_tokens", "ends_sha256",
        )
    )


def branched(sequences: DataFrame, family: int = 100, shared: int = 6) -> DataFrame:
    """Conversations that begin like the first one of their family.

    Conversation `c` takes its first `h` turns from `c - c % family`, all if that has fewer and none if there is
    no such conversation, then its own after its first `h`; `h` is the CRC-32 of its decimal id modulo `shared`.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(shared)).cast("int")
    none = F.slice("turns", 1, 0)
    firsts = sequences.filter(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("_base"), F.slice("turns", 1, shared - 1).alias("_first")
    )
    joined = sequences.withColumn("_base", F.col("conv_id") - F.col("conv_id") % family).join(firsts, "_base", "left")
    shared_turns = F.slice(F.coalesce("_first", none), F.lit(1), h)
    own = F.slice("turns", h + 1, F.size("turns"))
    return joined.select("conv_id", F.concat(shared_turns, own).alias("turns"))
