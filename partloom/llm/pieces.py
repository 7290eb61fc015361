"""Encoding into SentencePiece vocabularies and decoding.

An Aho-Corasick automaton over all pieces reads a text once. At each position the pieces that end there, found
along the output links, relax the best score of the prefix; the best path is read off backwards. Characters
without a piece become the byte pieces of their UTF-8 form, so that every text can be decoded exactly.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, functions as F, types as T

SPACE = "▁"  # stands for a blank inside pieces
MEMO_CHARS, MEMO_ENTRIES = 32, 150_000
BATCH_IDS = 500_000
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Vocabulary:
    """`pieces`: text, score and id of each ordinary piece; `byte_ids`: id of each byte; `size`: all ids."""

    pieces: tuple[tuple[str, float, int], ...]
    byte_ids: tuple[int, ...]
    size: int


def load_vocabulary(path: str) -> Vocabulary:
    """Reads a model file on the driver; tasks get the pieces, whose number the file bounds."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids = [], [-1] * 256
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            byte_ids[int(model.id_to_piece(i)[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces.append((model.id_to_piece(i), model.get_score(i), i))
    if min(byte_ids) < 0:
        raise ValueError("the vocabulary has no piece for some bytes, so not every text could be decoded")
    return Vocabulary(tuple(log_probabilities(pieces)), tuple(byte_ids), model.get_piece_size())


def log_probabilities(pieces: list[tuple[str, float, int]]) -> list[tuple[str, float, int]]:
    """Scores that can be added up along a path.

    Files of merged vocabularies hold negated merge ranks instead of log-probabilities. Those become the
    log-probabilities of Zipf's law: the r-th of N pieces has 1 / (r * H(N)).
    """
    ranks = [-score for _, score, _ in pieces]
    if any(r < 0 or r != int(r) for r in ranks):
        return pieces
    log_sum = math.log(sum(1.0 / r for r in range(1, len(ranks) + 1)) or 1.0)
    return [(piece, -math.log(-score + 1.0) - log_sum, number) for piece, score, number in pieces]


class Codec:
    """Encoder and decoder of one vocabulary, built once per Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.automaton = ahocorasick.Automaton()
        for piece, score, number in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), score, number))
        if vocabulary.pieces:
            self.automaton.make_automaton()
        self.single = {p for p, _, _ in vocabulary.pieces if len(p) == 1}
        self.unknown = min((s for _, s, _ in vocabulary.pieces), default=0.0) - UNKNOWN_PENALTY
        self.byte_ids = vocabulary.byte_ids
        self.memo: dict[str, tuple[int, ...]] = {}
        # If no piece has a blank behind another character, no piece crosses the start of a word.
        whole = any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _, _ in vocabulary.pieces)
        self.stretch = re.compile("(?s).+" if whole else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.raw_space = [self.byte_ids[b] for b in SPACE.encode()]
        self.bytes_of = [b""] * vocabulary.size
        for piece, _, number in vocabulary.pieces:
            self.bytes_of[number] = piece.replace(SPACE, " ").encode()
        for byte, number in enumerate(self.byte_ids):
            self.bytes_of[number] = bytes([byte])

    def _viterbi(self, text: str) -> list[int]:
        """Ids of the best path; of equal scores the one whose last piece is longest, at each step back."""
        n = len(text)
        best, back = [0.0] + [float("-inf")] * n, [(0, -1)] * (n + 1)
        settled = 0  # prefixes up to here have their best score

        def settle(upto: int) -> None:
            nonlocal settled
            while settled < upto:
                settled += 1
                if text[settled - 1] not in self.single and best[settled - 1] + self.unknown > best[settled]:
                    best[settled], back[settled] = best[settled - 1] + self.unknown, (1, -1)

        if self.single.issuperset(text):
            # Every character has a piece, so every prefix has a score when it is needed.
            for end, (length, score, number) in self.automaton.iter(text):
                total = best[end + 1 - length] + score
                if total > best[end + 1]:
                    best[end + 1], back[end + 1] = total, (length, number)
            settled = n
        elif self.single or len(self.automaton):
            for end, (length, score, number) in self.automaton.iter(text):
                if settled < end:
                    settle(end)
                total = best[end + 1 - length] + score
                if total > best[end + 1]:
                    best[end + 1], back[end + 1] = total, (length, number)
        settle(n)
        out: list[int] = []
        at = n
        while at:
            length, number = back[at]
            if number < 0:
                out.extend(self.byte_ids[b] for b in reversed(text[at - length : at].encode()))
            else:
                out.append(number)
            at -= length
        out.reverse()
        return out

    def encode(self, text: str) -> list[int]:
        """A blank is put in front, as the vocabularies expect. An empty text has no ids."""
        if not text:
            return []
        ids: list[int] = []
        memo = self.memo
        # The sign for a blank may stand in the text itself: that one goes by its bytes.
        for number, part in enumerate((" " + text).split(SPACE)):
            if number:
                ids += self.raw_space
            for stretch in self.stretch.findall(part.replace(" ", SPACE)):
                known = memo.get(stretch)
                if known is None:
                    known = tuple(self._viterbi(stretch))
                    # Frequent words come early; what comes after the memo is full is mostly rare.
                    if len(memo) < MEMO_ENTRIES and len(stretch) <= MEMO_CHARS:
                        memo[stretch] = known
                ids += known
        return ids

    def decode(self, ids) -> str:
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        return data.decode("utf-8", "replace")[1:]


_CODECS: dict[int, Codec] = {}


def _codec(vocabulary: Vocabulary) -> Codec:
    """The codec of a worker, kept from task to task with what it remembers."""
    key = hash(vocabulary)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(vocabulary)
    return _CODECS[key]


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, *, check: bool = False) -> DataFrame:
    """`docs` with `piece_ids`, an array of the ids of each whole `text`, and all other columns as they are.

    Null for a null text, empty for an empty one. With `check`, `round_trip` says whether decoding the ids
    gives the text again. Own columns of these names are replaced; repeated rows stay.
    """
    added = ["piece_ids", *(["round_trip"] if check else [])]
    kept = docs.select(*[c for c in docs.columns if c not in added])
    schema = T.StructType([*kept.schema.fields, T.StructField("piece_ids", T.ArrayType(T.IntegerType()))])
    if check:
        schema = schema.add("round_trip", T.BooleanType())
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            ids, same, start, size = [], [], 0, 0
            texts = batch.column("text")
            for i, text in enumerate(texts):
                value = text.as_py()
                own = None if value is None else np.array(codec.encode(value), dtype=np.int32)
                ids.append(own)
                if check:
                    same.append(value is None or codec.decode(own.tolist()) == value)
                size += 0 if own is None else len(own)
                # What waits is bounded by ids, not by rows, however long the texts are.
                if size >= BATCH_IDS or i == len(texts) - 1:
                    arrays = [pa.array(ids, pa.list_(pa.int32())), *([pa.array(same, pa.bool_())] if check else [])]
                    part = batch.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*part.schema.names, *added])
                    ids, same, start, size = [], [], i + 1, 0

    return kept.mapInArrow(encode, schema)


def decoded(ids: Column, vocabulary: Vocabulary) -> Column:
    """The text of each list of ids, exactly the one that was encoded; null for null."""

    @F.pandas_udf("string")
    def decode(lists: pd.Series) -> pd.Series:
        codec = _codec(vocabulary)
        return pd.Series([None if x is None else codec.decode(x.tolist()) for x in lists], dtype=object)

    return decode(ids)


def decode_documents(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """`docs` with `decoded_text` of its `piece_ids`."""
    return docs.withColumn("decoded_text", decoded(F.col("piece_ids"), vocabulary))
