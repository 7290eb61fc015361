"""A suffix tree of depth two in memory, for small tests of the one that Spark builds."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from partloom.llm.suffix_tree import _found


@dataclass(frozen=True)
class SuffixTree:
    """A tree of depth two in memory. Tokens are numbered by frequency. `factor1[a]` and `factor2` are log10 factors for what a state does not list.

    States of two tokens are `codes2 = a * double + b` in order; entries are `(state code) * listed + next`.
    """

    root: np.ndarray
    singles: int
    doubles: int
    listed: int
    factor1: np.ndarray  # nan: no state
    entries1: np.ndarray
    values1: np.ndarray
    codes2: np.ndarray
    factor2: np.ndarray
    entries2: np.ndarray
    values2: np.ndarray


def _contexts(ids: np.ndarray, first: np.ndarray, singles: int, doubles: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the contexts of one and two tokens before each token; -1 where there is none. `first` marks starts."""
    before = np.concatenate([[-1], ids[:-1]])
    before[first] = -1
    earlier = np.concatenate([[-1], before[:-1]])
    earlier[first] = -1
    one = np.where(before < singles, before, -1)
    two = np.where((before >= 0) & (before < doubles) & (earlier >= 0) & (earlier < doubles), earlier * doubles + before, -1)
    return one, two


def build(
    root_counts: np.ndarray, tokens: int, kinds: int, pairs: dict[int, int], triples: dict[int, int], singles: int, doubles: int, listed: int
) -> SuffixTree:
    """The tree in memory, for few tokens, from counts of tokens, pairs and triples; `root_counts` are those of the numbered tokens.

    A context becomes a state if `N * KL(own || parent's)`, over the tokens it lists and the rest, is above
    what the listed probabilities cost by the Bayesian information criterion.
    """
    unknown = kinds / (tokens + kinds) if kinds else 1.0
    linear_root = np.where(root_counts > 0, root_counts / max(1.0, float(tokens + kinds)), unknown)
    penalty = 0.5 * math.log(max(tokens, 2))

    def grouped(counts: dict[int, int]) -> dict[int, list[tuple[int, int]]]:
        out: dict[int, list[tuple[int, int]]] = {}
        for code in sorted(counts):
            out.setdefault(code // listed, []).append((code % listed, counts[code]))
        return out

    linear: dict[tuple[int, ...], tuple[dict[int, float], float]] = {}

    def probability(state: tuple[int, ...], token: int) -> float:
        if state and state in linear:
            entries, factor = linear[state]
            return entries[token] if token in entries else factor * probability(state[1:], token)
        return probability(state[1:], token) if state else float(linear_root[token])

    def consider(state: tuple[int, ...], total: int, followers: list[tuple[int, int]]) -> None:
        parent = state[1:]
        total = max(total, sum(c for _, c in followers))
        expected = {x: probability(parent, x) for x, _ in followers}
        rest, rest_expected = total - sum(c for _, c in followers), max(1e-12, 1 - sum(expected.values()))
        gain = sum(c * math.log(c / total / expected[x]) for x, c in followers)
        gain += rest * math.log(rest / total / rest_expected) if rest > 0 else 0.0
        if gain <= penalty * len(followers):
            return
        weight = len(followers) + 1.0
        entries = {x: (c + weight * expected[x]) / (total + weight) for x, c in followers}
        linear[state] = (entries, max(1e-12, 1 - sum(entries.values())) / rest_expected)

    for a, followers in grouped(pairs).items():
        consider((a,), int(root_counts[a]), followers)
    for ab, followers in grouped(triples).items():
        a, b = divmod(ab, doubles)
        consider((a, b), pairs.get(a * listed + b, 0), followers)

    factor1 = np.full(singles + 1, np.nan)
    listed1, listed2, states2 = [], [], []
    for state, (entries, factor) in linear.items():
        if len(state) == 1:
            factor1[state[0]] = math.log10(factor)
            listed1 += [(state[0] * listed + x, math.log10(p)) for x, p in entries.items()]
        else:
            code = state[0] * doubles + state[1]
            states2.append((code, math.log10(factor)))
            listed2 += [(code * listed + x, math.log10(p)) for x, p in entries.items()]

    def arrays(rows: list[tuple[int, float]]) -> tuple[np.ndarray, np.ndarray]:
        rows.sort()
        return np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.float64)

    return SuffixTree(np.log10(linear_root), singles, doubles, listed, factor1, *arrays(listed1), *arrays(states2), *arrays(listed2))


def token_scores(tree: SuffixTree, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """log10 probability of each token after the longest state of its history.

    For a token outside the head (-1) it is the part that the states give; its own probability at the root is
    to be added.
    """
    one, two = _contexts(ids, starts, tree.singles, tree.doubles)
    value = np.where(ids >= 0, tree.root[np.maximum(ids, 0)] if len(tree.root) else 0.0, 0.0)
    may = (ids >= 0) & (ids < tree.listed)
    factor = tree.factor1[one]  # the last element stands for no context
    at = np.flatnonzero(~np.isnan(factor))
    value[at] += factor[at]
    at = at[may[at]]
    hit, place = _found(tree.entries1, one[at] * tree.listed + ids[at])
    value[at[hit]] = tree.values1[place[hit]]
    at = np.flatnonzero(two >= 0)
    state, place = _found(tree.codes2, two[at])
    at = at[state]
    value[at] += tree.factor2[place[state]]
    at = at[may[at]]
    hit, place = _found(tree.entries2, two[at] * tree.listed + ids[at])
    value[at[hit]] = tree.values2[place[hit]]
    return value
