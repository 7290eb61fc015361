"""Language identification by a linear-chain conditional random field over words.

Each word has affix, character n-gram and lexicon features; transitions between the languages of neighbouring
words are learned as well. Words of code-switched text get their posterior by the forward-backward algorithm,
and a document takes the language with the highest mean posterior.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from partloom.session import checkpointed

UNDETERMINED = "und"
CACHE_WORDS = 150_000
CELLS = 120_000


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    weights: np.ndarray  # features x languages
    transitions: np.ndarray  # languages x languages
    start: np.ndarray
    lexicon: dict[str, int]  # frequent word -> bit set of the languages that use it


def letters(token: str) -> str:
    return token if token.isalpha() else "".join(filter(str.isalpha, token))


def word_features(word: str, lexicon: dict[str, int], buckets: int) -> list[int]:
    """Hashed features of a word of letters: itself, affixes of 1-3, trigrams, languages that list it."""
    data = f"<{word}>".encode("utf-32-le")
    chars = len(data) // 4
    keys = [b"w" + data]
    for k in range(2, min(5, chars)):
        keys.append(b"p" + data[: 4 * k])
        keys.append(b"s" + data[-4 * k :])
    keys += [b"g" + data[4 * i : 4 * i + 12] for i in range(chars - 2)]
    listed = lexicon.get(word, 0)
    keys.append(b"l%d" % listed)
    return [zlib.crc32(k) % buckets for k in keys]


def emissions(words: list[str], model_weights: np.ndarray, lexicon: dict[str, int]) -> np.ndarray:
    """Scores of each word for each language."""
    flat: list[int] = []
    starts = []
    for word in words:
        starts.append(len(flat))
        flat += word_features(word, lexicon, len(model_weights))
    if not words:
        return np.zeros((0, model_weights.shape[1]))
    return np.add.reduceat(model_weights[np.array(flat)], np.array(starts), axis=0)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Posteriors of padded sequences (longest first) and, if asked for, expected transitions.

    `scores` is time x sequence x language. Messages are scaled in each step, so length doesn't matter.
    """
    steps, _, size = scores.shape
    local = np.exp(scores - scores.max(axis=2, keepdims=True))
    move = np.exp(transitions - transitions.max())
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # sequences longer than t
    forward = np.zeros_like(local)
    first = np.exp(start - start.max()) * local[0]
    forward[0] = first / first.sum(axis=1, keepdims=True)
    for t in range(1, steps):
        n = active[t]
        step = (forward[t - 1, :n] @ move) * local[t, :n]
        forward[t, :n] = step / step.sum(axis=1, keepdims=True)
    backward = np.ones_like(local)
    expected = np.zeros((size, size))
    for t in range(steps - 1, 0, -1):
        n = active[t]
        ahead = local[t, :n] * backward[t, :n]
        step = ahead @ move.T
        if pairs:
            joint = forward[t - 1, :n, :, None] * move * ahead[:, None, :]
            expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        backward[t - 1, :n] = step / step.sum(axis=1, keepdims=True)
    posterior = forward * backward
    posterior /= np.maximum(posterior.sum(axis=2, keepdims=True), 1e-300)
    return (posterior, expected) if pairs else posterior


def training_documents(docs: DataFrame, *, documents_per_language: int = 300, most_chars: int = 20_000) -> DataFrame:
    """A bounded sample of labelled documents: per language the distinct texts that come first in order of a hash.

    Rows without a text or a language are no examples, nor are texts above `most_chars`, so that the
    sample has a proven bound. The number of languages is that of the labels. The hashes alone are ordered;
    texts are only read for those below the cut.
    """
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= most_chars))
    usable = usable.select("lang", "text", F.xxhash64("text").alias("_hash"))
    hashes = checkpointed(usable.select("lang", "_hash").distinct(), "language-hashes")
    wanted = F.lit(False)
    for row in hashes.groupBy("lang").count().orderBy("lang").collect():
        first = hashes.filter(F.col("lang") == row["lang"]).select("_hash").orderBy("_hash").limit(documents_per_language)
        wanted = wanted | ((F.col("lang") == row["lang"]) & (F.col("_hash") <= first.agg(F.max("_hash")).first()[0]))
    return usable.filter(wanted).dropDuplicates(["lang", "_hash"]).select("lang", "text")


def train(
    sample: DataFrame,
    *,
    buckets: int = 1 << 15,
    lexicon_words: int = 300,
    epochs: int = 3,
    length: int = 64,
    batch: int = 64,
    rate: float = 0.3,
    ridge: float = 1e-5,
    seed: int = 7,
) -> LanguageModel:
    """Fits the field by stochastic gradients on a bounded `(lang, text)` sample.

    The words of a document carry its language. Stretches of documents of different languages are put side by
    side, as in code-switched text; from these the transitions are learned.
    """
    rows = sorted((r["lang"], r["text"]) for r in sample.collect())
    languages = tuple(sorted({lang for lang, _ in rows}))
    size = max(1, len(languages))
    if not languages:
        return LanguageModel((), np.zeros((1, 1)), np.zeros((1, 1)), np.zeros(1), {})
    rng = np.random.default_rng(seed)
    counts = [Counter() for _ in languages]
    ids: dict[str, int] = {}
    stretches: list[tuple[np.ndarray, int]] = []
    for lang, text in rows:
        label = languages.index(lang)
        tokens = [w for w in map(letters, text.lower().split()) if w]
        counts[label].update(tokens)
        numbers = np.array([ids.setdefault(w, len(ids)) for w in tokens], dtype=np.int64)
        at = 0
        while at < len(numbers):
            step = int(rng.integers(4, 40))
            stretches.append((numbers[at : at + step], label))
            at += step
    lexicon: dict[str, int] = {}
    for label, counter in enumerate(counts):
        for word, _ in sorted(counter.items(), key=lambda x: (-x[1], x[0]))[:lexicon_words]:
            lexicon[word] = lexicon.get(word, 0) | 1 << label
    flat = array("q")  # eight bytes a number on the driver; a list has forty
    starts = [0]
    for word in ids:
        flat.extend(word_features(word, lexicon, buckets))
        starts.append(len(flat))
    features, offsets = np.array(flat, dtype=np.int64), np.array(starts)
    weights, squares = np.zeros((buckets, size)), np.full((buckets, size), 1e-2)
    moves, moves_sq = np.zeros((size, size)), np.full((size, size), 1e-2)
    begin = np.zeros(size)
    for _ in range(epochs if stretches else 0):
        order = rng.permutation(len(stretches))
        words = np.concatenate([stretches[i][0] for i in order])
        gold = np.concatenate([np.full(len(stretches[i][0]), stretches[i][1]) for i in order])
        usable = len(words) // length * length
        if usable == 0:
            words, gold = np.resize(words, length), np.resize(gold, length)
            usable = length
        words, gold = words[:usable].reshape(-1, length), gold[:usable].reshape(-1, length)
        for b in range(0, len(words), batch):
            w, y = words[b : b + batch].T, gold[b : b + batch].T
            seen, where = np.unique(w, return_inverse=True)
            where = where.reshape(w.shape)
            spans = [np.arange(offsets[i], offsets[i + 1]) for i in seen]
            owner = np.repeat(np.arange(len(seen)), [len(s) for s in spans])
            used = features[np.concatenate(spans)]
            local = np.zeros((len(seen), size))
            np.add.at(local, owner, weights[used])
            posterior, expected = forward_backward(local[where], np.full(w.shape[1], length), moves, begin, pairs=True)
            error = -posterior
            error[np.arange(length)[:, None], np.arange(w.shape[1]), y] += 1
            per_word = np.zeros((len(seen), size))
            np.add.at(per_word, where.ravel(), error.reshape(-1, size))
            rows_, inverse = np.unique(used, return_inverse=True)
            gradient = np.zeros((len(rows_), size))
            np.add.at(gradient, inverse, per_word[owner])
            gradient = gradient / w.size - ridge * weights[rows_]
            squares[rows_] += gradient**2
            weights[rows_] += rate * gradient / np.sqrt(squares[rows_])
            real = np.zeros((size, size))
            np.add.at(real, (y[:-1].ravel(), y[1:].ravel()), 1)
            change = (real - expected) / w.size
            moves_sq += change**2
            moves += rate * change / np.sqrt(moves_sq)
    return LanguageModel(languages, weights.astype(np.float32), moves, begin, lexicon)


class _Labeller:
    """Scores words once per worker and labels the texts of a batch together."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.ids: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)))

    def sequences(self, texts: list[str | None]) -> list[np.ndarray]:
        """Word numbers of each text; tokens without a letter are left out."""
        if len(self.ids) > CACHE_WORDS:
            self.ids, self.scores = {}, self.scores[:0]
        ids, fresh, out = self.ids, [], []
        known = len(self.scores)
        for text in texts:
            row = []
            for token in (text or "").lower().split():
                number = ids.get(token)
                if number is None:
                    word = letters(token)
                    if not word:
                        number = -1
                    elif word != token and word in ids:
                        number = ids[word]
                    else:
                        number = known + len(fresh)
                        fresh.append(word)
                        ids[word] = number
                    ids[token] = number
                if number >= 0:
                    row.append(number)
            out.append(np.array(row, dtype=np.int64))
        if fresh:
            self.scores = np.concatenate([self.scores, emissions(fresh, self.model.weights, self.model.lexicon)])
        return out

    def posteriors(self, rows: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray]]:
        """Groups of rows of like length with their padded posteriors, time x row x language."""
        order = sorted((i for i in range(len(rows)) if len(rows[i])), key=lambda i: -len(rows[i]))
        at = 0
        while at < len(order):
            longest = len(rows[order[at]])
            group = order[at : at + max(1, CELLS // longest)]
            at += len(group)
            lengths = np.array([len(rows[i]) for i in group])
            padded = np.zeros((len(group), longest), dtype=np.int64)
            inside = np.arange(longest) < lengths[:, None]
            padded[inside] = np.concatenate([rows[i] for i in group])
            posterior = forward_backward(self.scores[padded.T], lengths, self.model.transitions, self.model.start)
            posterior[~inside.T] = 0.0
            yield group, posterior

    def documents(self, texts: pd.Series) -> pd.DataFrame:
        labels, scores = np.full(len(texts), UNDETERMINED, dtype=object), np.zeros(len(texts))
        if self.model.languages:
            values = list(texts)
            # Slices keep the word numbers of a batch of long texts small.
            for low in range(0, len(values), 512):
                rows = self.sequences(values[low : low + 512])
                for group, posterior in self.posteriors(rows):
                    mean = posterior.sum(axis=0) / np.array([len(rows[i]) for i in group])[:, None]
                    best = mean.argmax(axis=1)
                    for k, i in enumerate(group):
                        labels[low + i] = self.model.languages[best[k]]
                        scores[low + i] = min(1.0, max(0.0, float(mean[k, best[k]])))
        return pd.DataFrame({"lang": labels, "score": scores})


def _label_documents(model: LanguageModel):
    @F.pandas_udf("lang string, score double")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = _Labeller(model)
        for texts in batches:
            yield labeller.documents(texts)

    # Else a filter on the result would evaluate the model once for itself and once more for the column.
    return label.asNondeterministic()


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """`docs` with `language`, a struct of `lang` and `score`, for each whole text.

    `score` is the mean posterior of the language over all words. A text that is null or without any letter is
    `und` with score 0, as is every text under a model without languages. Rows and columns stay as they are;
    a column `language` is replaced. Ties go to the language that is first in the alphabet.
    """
    return docs.withColumn("language", _label_documents(model)(F.col(text)))


def word_labels(text: Column, model: LanguageModel) -> Column:
    """`array<struct<word, lang, score>>` of the tokens with a letter, for code-switched text."""

    @F.pandas_udf("array<struct<word string, lang string, score double>>")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        labeller = _Labeller(model)
        for texts in batches:
            out = [[] for _ in texts]
            if model.languages:
                rows = labeller.sequences(list(texts))
                tokens = [[w for w in (t or "").split() if letters(w.lower())] for t in texts]
                for group, posterior in labeller.posteriors(rows):
                    for k, i in enumerate(group):
                        best = posterior[: len(rows[i]), k].argmax(axis=1)
                        out[i] = [
                            {"word": w, "lang": model.languages[b], "score": float(posterior[t, k, b])}
                            for t, (w, b) in enumerate(zip(tokens[i], best))
                        ]
            yield pd.Series(out)

    return label(text)
