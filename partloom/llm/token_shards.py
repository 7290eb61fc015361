"""Token ids in binary shards, in the order of training.

Documents are tokenized, joined with an end mark and cut into sequences of equal length. A keyed Feistel
permutation with cycle-walking gives every sequence its global slot without a sort of the whole corpus. The
slots are cut into ranges; each range is one file of fixed-stride records, so that record `slot` lies at a
known place and reading can go on at any slot.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from partloom.session import checkpointed, scratch_path

ROUNDS = 8
TOKEN_TYPE = np.dtype("<u2")
SPACE_RULE = r"|\s+(?!\S)|\s+"
SPACES = re.compile(r"\s\s")
PIECE_ROWS = 64  # sequences handed on at once, about 128 KB


@dataclass(frozen=True)
class Tokenizer:
    """A byte-level vocabulary: the text of its rank file, the pattern that cuts texts, and the end mark."""

    ranks: bytes
    pattern: str
    end_id: int


@dataclass(frozen=True)
class Shards:
    """Shards in `folder`; `manifest` has one row per sequence."""

    folder: str
    manifest: DataFrame
    sequences: int
    length: int
    shard_records: int


def load_tokenizer(path: str, pattern: str, end_id: int) -> Tokenizer:
    with open(path, "rb") as file:
        return Tokenizer(file.read(), pattern, end_id)


@lru_cache(maxsize=2)
def _encoding(tokenizer: Tokenizer) -> tiktoken.Encoding:
    """Built once per worker and kept from task to task."""
    lines = (line.split() for line in tokenizer.ranks.splitlines() if line)
    ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
    return tiktoken.Encoding("shards", pat_str=tokenizer.pattern, mergeable_ranks=ranks, special_tokens={})


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def permuted(index: np.ndarray, size: int, key: str) -> np.ndarray:
    """The slots of `index` under a keyed permutation of `0 .. size - 1`.

    A Feistel network permutes the next power of four; results outside the range go through it again, which
    takes less than four turns on average.
    """
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little") for r in range(ROUNDS)]
    out = np.asarray(index, dtype=np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (_mixed(right, k) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= np.uint64(size)]
    return out.astype(np.int64)


def _token_lists(batches: Iterator[pa.RecordBatch], tokenizer: Tokenizer) -> Iterator[tuple[int | None, list[int]]]:
    encode = quick = _encoding(tokenizer).encode_ordinary
    if tokenizer.pattern.endswith(SPACE_RULE):
        # The look-ahead only matters where white space stands side by side, and costs a third of the time.
        simple = replace(tokenizer, pattern=tokenizer.pattern.removesuffix(SPACE_RULE) + r"|\s+")
        quick = _encoding(simple).encode_ordinary
    for batch in batches:
        for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            text = value.as_py() or ""
            tokens = (encode if SPACES.search(text) else quick)(text)
            tokens.append(tokenizer.end_id)
            yield doc_id, tokens


def write_shards(
    docs: DataFrame,
    tokenizer: Tokenizer,
    *,
    folder: str | None = None,
    length: int = 1024,
    shard_records: int = 8192,
    key: str = "training-order",
) -> Shards:
    """Writes `docs(doc_id, text)` as shards `shard-<number>.bin` of little-endian 16-bit ids.

    A null text counts as empty and is one end mark; other columns are ignored; repeated rows are documents
    of their own. The last sequence of an input partition is filled up with end marks. An empty table has no
    sequences and no shard. Texts are tokenized twice: first for the number of sequences per input partition,
    which the permutation needs, then to write; that costs less than storing all tokens in between. Both
    passes read the same partitions, and the second fails if they differ. A retried task writes the same
    file again and moves it into place when it is whole.
    """
    if tokenizer.end_id > np.iinfo(TOKEN_TYPE).max:
        raise ValueError("ids don't fit 16 bits")
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "shards")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = sum(len(ids) for _, ids in _token_lists(batches, tokenizer))
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "n": [-(-tokens // length)]})

    # One number per input partition.
    counts = {r["part"]: r["n"] for r in rows.mapInArrow(count, "part bigint, n bigint").collect()}
    offsets, total = {}, 0
    for part in sorted(counts):
        offsets[part] = total
        total += counts[part]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        made, waiting, size, marks, out = 0, [], 0, [], []

        def sequence(tokens: np.ndarray) -> None:
            nonlocal made
            inside = [(d, s) for d, s in marks if s < length]
            out.append((offsets.get(part, 0) + made, [d for d, _ in inside], [s for _, s in inside], len(tokens), tokens))
            # The document that the cut goes through goes on in the next sequence, before its start.
            marks[:] = [(d, s - length) for d, s in (marks[len(inside) - 1 :] if len(tokens) == length else [])]
            made += 1

        def flush() -> pa.RecordBatch:
            index = np.array([o[0] for o in out], dtype=np.int64)
            full = [np.concatenate([o[4], np.full(length - len(o[4]), tokenizer.end_id, dtype=TOKEN_TYPE)]) for o in out]
            done = pa.RecordBatch.from_arrays(
                [
                    pa.array(permuted(index, total, key)),
                    pa.array([o[1] for o in out], pa.list_(pa.int64())),
                    pa.array([o[2] for o in out], pa.list_(pa.int64())),
                    pa.array([o[3] for o in out], pa.int64()),
                    pa.array([t.astype(TOKEN_TYPE, copy=False).tobytes() for t in full], pa.binary()),
                ],
                names=["slot", "doc_ids", "starts", "n_tokens", "tokens"],
            )
            out.clear()
            return done

        for doc_id, ids in _token_lists(batches, tokenizer):
            marks.append((doc_id, size))
            waiting.append(np.frombuffer(array("H", ids), dtype=np.uint16))
            size += len(ids)
            if size >= length:
                joined = np.concatenate(waiting)
                whole = size // length
                for i in range(whole):
                    sequence(joined[i * length : (i + 1) * length])
                    if len(out) >= PIECE_ROWS:
                        yield flush()
                waiting, size = [joined[whole * length :]], size - whole * length
                if size == 0:
                    marks.clear()
        if size:
            sequence(np.concatenate(waiting))
        if out:
            yield flush()
        if made != counts.get(part, 0):
            raise RuntimeError(f"partition {part} had {counts.get(part, 0)} sequences when counted and {made} when written")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        files.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        number, stream = None, None

        def close() -> None:
            if stream is not None:
                stream.close()
                files.move(f"{root}/.shard-{number:08d}-{attempt}", f"{root}/shard-{number:08d}.bin")

        for batch in batches:
            crc = []
            for shard, tokens in zip(batch.column("shard").to_pylist(), batch.column("tokens").to_pylist()):
                if shard != number:
                    close()
                    number = shard
                    stream = files.open_output_stream(f"{root}/.shard-{number:08d}-{attempt}")
                stream.write(tokens)
                crc.append(zlib.crc32(tokens))
            kept = ["slot", "doc_ids", "starts", "n_tokens", "shard"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(crc, pa.int64())], names=[*kept, "crc"])
        close()

    columns = "slot bigint, doc_ids array<bigint>, starts array<bigint>, n_tokens bigint"
    shards = -(-total // shard_records)
    cut_rows = rows.mapInArrow(cut, f"{columns}, tokens binary").withColumn("shard", F.expr(f"slot div {shard_records}"))
    # Ranges of slots are known by arithmetic; a range partitioner would sample, that is tokenize, once more.
    dealt = cut_rows.repartition(max(1, shards), "shard").sortWithinPartitions("shard", "slot")
    manifest = dealt.mapInArrow(write, f"{columns}, shard bigint, crc bigint")
    return Shards(folder, checkpointed(manifest, "shard-manifest"), total, length, shard_records)


def read_sequences(spark: SparkSession, shards: Shards, first: int = 0, count: int | None = None) -> DataFrame:
    """`(slot, tokens)` for `count` slots from `first` on, read at their places in the files."""
    last = shards.sequences if count is None else min(shards.sequences, first + count)
    length, per_shard, folder = shards.length, shards.shard_records, shards.folder
    numbers = spark.range(first // per_shard, -(-last // per_shard) if last > first else first // per_shard)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        stride = length * TOKEN_TYPE.itemsize
        for batch in batches:
            for number in batch.column("id").to_pylist():
                low, high = max(first, number * per_shard), min(last, (number + 1) * per_shard)
                with files.open_input_file(f"{root}/shard-{number:08d}.bin") as file:
                    file.seek((low - number * per_shard) * stride)
                    for at in range(low, high, PIECE_ROWS):
                        n = min(PIECE_ROWS, high - at)
                        tokens = np.frombuffer(file.read(n * stride), dtype=TOKEN_TYPE).reshape(n, length)
                        lists = pa.array(list(tokens.astype(np.int32)), pa.list_(pa.int32()))
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), lists], names=["slot", "tokens"])

    return numbers.repartition(max(1, min(numbers.count(), 10_000)), "id").mapInArrow(read, "slot bigint, tokens array<int>")
