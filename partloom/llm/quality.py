"""Quality rules: statistics of whole texts and learned decision lists, as column expressions.

A decision list is an ordered list of conjunctions of thresholds. Each is grown on one part of the labelled
rows by information gain and pruned on the other (incremental reduced-error pruning); rows it covers are then
taken out and the next is learned. The result is one `CASE WHEN` expression.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from partloom.llm.text import let, words
from partloom.session import checkpointed

WINDOW_WORDS = 5
FEATURES = (
    "n_words", "chars_per_word", "symbols_per_word", "exclaims_per_word", "upper_share", "digit_share", "repeat_share", "dup_line_share",
)


def repeated_words(tokens: Column, n: Column, width: int = WINDOW_WORDS) -> Column:
    """Words in windows of `width` words that are found twice or more in the text, first ones included.

    Each window is one number: its hash with the place of the window in the lowest bits, as many as the
    text needs. Sorted, equal windows stand side by side, so the work is that of a sort, however often a
    window repeats. Windows of equal numbers count only if their words are equal.
    """
    places = F.greatest(n, F.lit(2))
    bits = F.ceil(F.log2(places)).cast("int") + 1

    def packed(state: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), n - (width - 1)),
            lambda i: F.call_function("shiftleft", F.xxhash64(F.slice(tokens, i, width)), state).bitwiseOR(i.cast("bigint")),
        )

    def window(place: Column) -> Column:
        # The last key has none after it, and its place is null.
        return F.slice(tokens, F.greatest(F.coalesce(place, F.lit(1)), F.lit(1)).cast("int"), width)

    def twins(both: Column) -> Column:
        keys, shift = both["keys"], both["shift"]
        mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), shift) - 1
        hit = F.zip_with(
            keys,
            F.slice(keys, 2, F.size(keys)),
            lambda a, b: F.when(
                (F.call_function("shiftrightunsigned", a.bitwiseXOR(b), shift) == 0) & (window(a.bitwiseAND(mask)) == window(b.bitwiseAND(mask))),
                F.array(a.bitwiseAND(mask), b.bitwiseAND(mask)),
            ),
        )
        return F.sort_array(F.array_distinct(F.flatten(F.filter(hit, lambda p: p.isNotNull()))))

    def covered(starts: Column) -> Column:
        gaps = F.zip_with(
            starts, F.slice(starts, 2, F.size(starts)), lambda a, b: F.least(F.coalesce(b - a, F.lit(width)), F.lit(width)).cast("bigint")
        )
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda total, g: total + g)

    keyed = let(bits, lambda shift: F.struct(F.sort_array(packed(shift)).alias("keys"), shift.alias("shift")))
    counted = let(let(keyed, twins), lambda starts: F.when(F.size(starts) == 0, F.lit(0).cast("bigint")).otherwise(covered(starts)))
    return F.when(n < width + 1, F.lit(0).cast("bigint")).otherwise(counted)


def text_statistics(docs: DataFrame) -> DataFrame:
    """`doc_id` and the statistics of each whole text; a null text counts as an empty one.

    `word_chars` are code points in words, `n_symbols` characters of `#*$%&|<>`, `n_dup_lines` lines with a
    word that equal an earlier line, `n_repeat_words` words in windows of five found twice or more.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def dropped(pattern: str) -> Column:
        return F.length("text") - F.length(F.regexp_replace("text", pattern, ""))

    prepared = docs.select("doc_id", text.alias("text")).withColumn("_w", words(F.col("text"))).withColumn("n_words", F.size("_w"))
    counted = prepared.select(
        "doc_id",
        F.col("n_words").cast("bigint").alias("n_words"),
        F.length(F.concat_ws("", "_w")).cast("bigint").alias("word_chars"),
        dropped(r"[#*$%&|<>]").cast("bigint").alias("n_symbols"),
        F.when(F.instr("text", "\n") > 0, let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).otherwise(0).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("_w"), F.col("n_words")).alias("n_repeat_words"),
        dropped("!").cast("bigint").alias("n_exclaims"),
        dropped(r"\p{Lu}").cast("bigint").alias("n_upper"),
        dropped(r"[0-9]").cast("bigint").alias("n_digits"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("bigint").alias("n_lines"),
    )
    return counted


def with_features(stats: DataFrame) -> DataFrame:
    words_ = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return stats.withColumns(
        {
            "chars_per_word": F.col("word_chars") / words_,
            "symbols_per_word": F.col("n_symbols") / words_,
            "exclaims_per_word": F.col("n_exclaims") / words_,
            "upper_share": F.col("n_upper") / chars,
            "digit_share": F.col("n_digits") / chars,
            "repeat_share": F.col("n_repeat_words") / words_,
            "dup_line_share": F.col("n_dup_lines") / F.col("n_lines").cast("double"),
        }
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature).cast("double")
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold!r}"


@dataclass(frozen=True)
class DecisionList:
    """Rules for the class `true`, in order; a row that none covers is of the other class."""

    rules: tuple[tuple[Condition, ...], ...]

    def rule(self) -> Column:
        """Number of the first rule that covers a row, from 1; 0 if none does."""
        out = F.lit(0)
        for number, rule in reversed(list(enumerate(self.rules, 1))):
            out = F.when(conjunction(rule), F.lit(number)).otherwise(out)
        return out

    def __str__(self) -> str:
        cases = [f"WHEN {' AND '.join(map(str, r))} THEN {i}" for i, r in enumerate(self.rules, 1)]
        return f"CASE {' '.join(cases)} ELSE 0 END" if cases else "0"


def conjunction(rule: Sequence[Condition]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & F.coalesce(c.column(), F.lit(False))
    return out


def learn(
    rows: DataFrame,
    features: Sequence[str] = FEATURES,
    *,
    max_rows: int = 20_000,
    cuts: int = 32,
    max_rules: int = 12,
    max_conditions: int = 3,
    least_rows: int = 8,
    least_precision: float = 0.98,
) -> DecisionList:
    """A decision list for the boolean column `target`, learned from at most `max_rows` rows.

    `rows` has `doc_id`, `target` and the features. Rows are taken in the order of a hash of the id, so
    the bound is the same at every size and reruns agree; two thirds grow rules, the rest prune them. Rows
    with a null target are ignored, null features fail every condition. Without rows of both classes the
    list is empty. Each step is one small aggregation over the bounded sample; to the driver come the
    counts per feature and cut only.
    """
    columns = [F.col(f).cast("double").alias(f) for f in features]
    chosen = rows.filter(F.col("target").isNotNull()).select(F.xxhash64("doc_id").alias("_h"), "target", *columns)
    # The bounded sample is one file, so that the many small steps need no shuffle.
    sample = checkpointed(chosen.orderBy("_h", "target", *features).limit(max_rows).coalesce(1), "rule-sample").coalesce(1)
    points = [i / (cuts + 1) for i in range(1, cuts + 1)]
    asked = [F.percentile_approx(f, points).alias(f) for f in features]
    quantiles = {bool(r["target"]): r for r in sample.groupBy("target").agg(*asked).collect()}
    if len(quantiles) < 2:
        return DecisionList(())
    cut_of = {f: sorted({x for q in quantiles.values() for x in (q[f] or [])}) for f in features}
    features = [f for f in features if cut_of[f]]
    bins = [
        F.struct(
            F.lit(i).alias("f"), F.when(F.col(f).isNotNull(), F.size(F.filter(F.lit(cut_of[f]), lambda t: t < F.col(f)))).alias("b")
        )
        for i, f in enumerate(features)
    ]
    grow, prune = F.pmod("_h", F.lit(3)) != 0, F.pmod("_h", F.lit(3)) == 0
    rules: list[tuple[Condition, ...]] = []
    left = F.lit(True)
    positive = F.col("target").cast("int")
    while len(rules) < max_rules:
        rule: list[Condition] = []
        before = None
        while len(rule) < max_conditions:
            inside = sample.filter(grow & left & conjunction(rule))
            table = (
                inside.select(positive.alias("t"), F.explode(F.array(*bins)).alias("x"))
                .groupBy("x.f", "x.b")
                .agg(F.sum("t").alias("p"), F.sum(1 - F.col("t")).alias("n"))
                .collect()
            )
            best, totals = _best_condition(table, features, cut_of, least_rows)
            if before is None:
                before = totals
            if best is None or totals[1] == 0:
                break
            rule.append(best)
        if not rule:
            break
        sums = []
        for k in range(1, len(rule) + 1):
            covered = left & conjunction(rule[:k])
            for part, when in (("g", grow), ("p", prune)):
                sums += [
                    F.sum(F.when(when & covered, positive).otherwise(0)).alias(f"p{part}{k}"),
                    F.sum(F.when(when & covered, 1 - positive).otherwise(0)).alias(f"n{part}{k}"),
                ]
        seen = sample.agg(*sums).first()

        def worth(k: int) -> tuple[float, int]:
            p, n = seen[f"pp{k}"], seen[f"np{k}"]
            return ((p - n) / (p + n) if p + n else -1.0, -k)

        keep = max(range(1, len(rule) + 1), key=worth)
        p, n = (seen[f"pg{keep}"] + seen[f"pp{keep}"], seen[f"ng{keep}"] + seen[f"np{keep}"])
        if p < least_rows or p < least_precision * (p + n):
            break
        rules.append(tuple(rule[:keep]))
        left = left & ~conjunction(rule[:keep])
    return DecisionList(tuple(rules))


def _best_condition(table, features, cut_of, least_rows):
    """The condition with the highest information gain, and the counts of both classes before it."""
    by: dict[int, dict[int | None, tuple[int, int]]] = {}
    for r in table:
        by.setdefault(r["f"], {})[r["b"]] = (r["p"], r["n"])
    if not by:
        return None, (0, 0)
    first = next(iter(by.values()))
    p0, n0 = sum(p for p, _ in first.values()), sum(n for _, n in first.values())
    if p0 == 0:
        return None, (p0, n0)
    start = math.log2(p0 / (p0 + n0))
    best, gain = None, 1e-9
    for i, feature in enumerate(features):
        counts = by.get(i, {})
        known = [(b, *counts[b]) for b in sorted(b for b in counts if b is not None)]
        p_all, n_all = sum(p for _, p, _ in known), sum(n for _, _, n in known)
        low_p = low_n = 0
        cursor = 0
        for j, cut in enumerate(cut_of[feature]):
            # Bin b holds the values above exactly b cuts.
            while cursor < len(known) and known[cursor][0] <= j:
                low_p, low_n, cursor = low_p + known[cursor][1], low_n + known[cursor][2], cursor + 1
            for above, p, n in ((False, low_p, low_n), (True, p_all - low_p, n_all - low_n)):
                if p >= least_rows:
                    g = p * (math.log2(p / (p + n)) - start)
                    if g > gain:
                        best, gain = Condition(feature, above, cut), g
    return best, (p0, n0)


def judge(stats: DataFrame, junk: DecisionList) -> DataFrame:
    """Adds `base_failed`, `rule` (the rule for junk that covers the row, else 0) and `kept`."""
    out = with_features(stats).withColumn("base_failed", base_failed()).withColumn("rule", junk.rule())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def learn_from_labels(stats: DataFrame, labels: DataFrame, **settings) -> DecisionList:
    """Rules for junk, from stored statistics and `labels(doc_id, quality)` with quality 0 for junk.

    Null ids and labels are ignored; of several labels of an id the lowest counts.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id")
    rows = with_features(stats).join(known.agg((F.min("quality") == 0).alias("target")), "doc_id")
    return learn(rows, **settings)
