"""Secret scans with column expressions: fixed patterns, and character Markov models for what they miss.

Two first-order Markov models of characters are trained from labelled strings: random ones (values of
passwords, keys and hexadecimal digests) and ordinary identifiers. A run of identifier characters is a
secret if the log-likelihood ratio of the two models is high enough.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from partloom.llm.text import let, set_aside
from partloom.session import checkpointed

# The kinds in their order of precedence, with pattern, measured group and its least length.
BASE_KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
# Whether a text can hold a match of the kind that is long enough; the first filter of a scan.
HINTS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}""",
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"[0-9a-f]{32}",
}
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
RUN = r"[A-Za-z0-9+/_-]{%d,}={0,2}"
MARKOV = "markov"
MASK = "[SECRET]"
SPAN_TYPE = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


@dataclass(frozen=True)
class SecretModel:
    """`ratios[previous * (symbols + 1) + next]`: log P(random) - log P(ordinary); index 0 is the start."""

    ratios: tuple[float, ...]
    least_ratio: float
    least_mean: float
    least_length: int


def _totals_before(lengths: Column, block: int = 512) -> Column:
    """Sums of all earlier elements. Blocks keep the growing array of a fold short, so long lists stay cheap."""
    nothing = F.struct(F.lit(0).cast("bigint").alias("total"), F.expr("CAST(array() AS array<bigint>)").alias("sums"))

    def add(state: Column, x: Column) -> Column:
        return F.struct((state["total"] + x).alias("total"), F.array_append(state["sums"], state["total"]).alias("sums"))

    cut = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size(lengths) / block).cast("int") - 1, F.lit(0))),
        lambda b: F.aggregate(F.slice(lengths, b * block + 1, block), nothing, add),
    )

    def joined(blocks: Column) -> Column:
        offsets = F.aggregate(F.transform(blocks, lambda b: b["total"]), nothing, add)["sums"]
        return F.flatten(F.zip_with(blocks, offsets, lambda b, offset: F.transform(b["sums"], lambda s: s + offset)))

    return let(cut, joined)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """`array<struct<start, end, value>>` of all leftmost non-overlapping matches of a pattern that isn't empty.

    Positions are code points, the end exclusive; `value` is the text of `group`. They follow from the
    lengths of what lies between the matches, which `split` returns.
    """

    def placed(parts: Column) -> Column:
        found, gaps = parts["found"], parts["gaps"]
        # The last piece has no match behind it.
        lengths = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda gap, m: (F.length(gap) + F.length(m)).cast("bigint"))
        stops = F.zip_with(_totals_before(lengths), lengths, lambda before, own: before + own)
        with_match = F.zip_with(stops, found, lambda stop, m: F.struct((stop - F.length(m)).alias("start"), stop.alias("end")))
        return F.zip_with(
            with_match, parts["values"], lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), v.alias("value"))
        )

    found = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values"),
    )
    return let(found, placed)


def _spans(text: Column, kind: str, rank: int, pattern: str, group: int, keep, hint: Column) -> Column:
    found = F.transform(
        F.filter(matches(text, pattern, group), keep),
        lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")),
    )
    return F.when(hint, found).otherwise(F.expr(f"CAST(array() AS {SPAN_TYPE})"))


def _long(least: int, value: Column) -> Column:
    return F.length(value) >= least


def _long_match(least: int, m: Column) -> Column:
    return F.length(m["value"]) >= least


def base_spans(text: Column) -> Column:
    """Spans of the fixed kinds, by start, then kind. A null text has none."""
    text = F.coalesce(text, F.lit(""))
    by_kind = [
        _spans(text, kind, rank, pattern, group, partial(_long_match, least), text.rlike(HINTS[kind]))
        for rank, (kind, pattern, group, least) in enumerate(BASE_KINDS)
    ]
    return F.array_sort(F.concat(*by_kind))


def labelled_strings(docs: DataFrame, max_strings: int = 20_000, least_length: int = 12) -> DataFrame:
    """`(value, random)`: values of the fixed kinds against runs of texts without any, at most `max_strings` each.

    Distinct strings in the order of a hash, so every document is looked at and reruns agree.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    any_hint = "|".join(f"(?:{h})" for h in HINTS.values())
    values = F.concat(
        *[
            F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), partial(_long, least))
            for _, pattern, group, least in BASE_KINDS
        ]
    )
    random = docs.filter(text.rlike(any_hint)).select(F.explode(values).alias("value"))
    runs = F.regexp_extract_all(text, F.lit(RUN % least_length), F.lit(0))
    ordinary = docs.filter(~text.rlike(any_hint)).select(F.explode(runs).alias("value"))

    def sample(strings: DataFrame, label: bool) -> DataFrame:
        chosen = strings.distinct().orderBy(F.xxhash64("value"), "value").limit(max_strings)
        return chosen.withColumn("random", F.lit(label))

    return sample(random, True).unionByName(sample(ordinary, False))


def train(
    strings: DataFrame, *, smoothing: float = 0.5, least_ratio: float = 12.0, least_mean: float = 0.6, least_length: int = 16
) -> SecretModel:
    """Models of `(value, random)` strings; characters outside the alphabet are skipped, null values ignored.

    What comes to the driver are counts of pairs of symbols, bounded by the alphabet. A class without any
    sample is uniform.
    """
    known = F.regexp_replace("value", "[^A-Za-z0-9+/_=-]", "")
    symbols = F.transform(F.array_remove(F.split(known, ""), ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = F.zip_with(F.concat(F.array(F.lit(0)), "s"), F.col("s"), lambda before, now: F.struct(before.alias("p"), now.alias("n")))
    counted = (
        strings.filter(F.col("value").isNotNull() & F.col("random").isNotNull())
        .select("random", symbols.alias("s"))
        .select("random", F.explode(pairs).alias("x"))
        .filter(F.col("x.n").isNotNull())
        .groupBy("random", "x.p", "x.n")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    width = len(ALPHABET) + 1
    counts = {True: [0] * (width * width), False: [0] * (width * width)}
    for row in counted.collect():
        counts[row["random"]][row["p"] * width + row["n"]] += row["c"]

    def logs(label: bool) -> list[float]:
        out = []
        for p in range(width):
            line = counts[label][p * width : (p + 1) * width]
            total = sum(line) + smoothing * (width - 1)
            out += [math.log((c + smoothing) / total) for c in line]
        return out

    ratios = tuple(round(a - b, 6) for a, b in zip(logs(True), logs(False)))
    return SecretModel(ratios, least_ratio, least_mean, least_length)


def log_ratio(value: Column, model: SecretModel) -> Column:
    """Log-likelihood ratio of a string under the two models: positive for random strings."""
    table = F.from_json(F.lit(json.dumps(model.ratios)), "array<double>")
    width = len(ALPHABET) + 1

    def step(state: Column, c: Column) -> Column:
        def moved(now: Column) -> Column:
            return F.struct(now.alias("at"), (state["sum"] + F.element_at(table, state["at"] * width + now + 1)).alias("sum"))

        return F.when(F.instr(F.lit(ALPHABET), c) > 0, let(F.instr(F.lit(ALPHABET), c), moved)).otherwise(state)

    start = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum"))
    return F.aggregate(F.array_remove(F.split(value, ""), ""), start, step)["sum"]


def scan(docs: DataFrame, model: SecretModel) -> DataFrame:
    """All columns of `docs` and `base_spans`, `spans`: arrays of `(start, rank, end, kind)` over whole texts.

    `spans` adds to the base ones each run that the models call random and that no base span touches. Null
    and empty texts have empty lists. Rows stay as they are, repeated ones too. The names of the two new
    columns must not be taken.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    run = RUN % model.least_length

    def is_random(m: Column) -> Column:
        ratio = log_ratio(m["value"], model)
        return let(ratio, lambda r: (r >= model.least_ratio) & (r >= model.least_mean * F.length(m["value"])))

    added = _spans(text, MARKOV, len(BASE_KINDS), run, 0, is_random, text.rlike(run))
    free = F.filter(
        "_added", lambda a: ~F.exists("base_spans", lambda b: (b["start"] < a["end"]) & (a["start"] < b["end"]))
    )
    return (
        docs.withColumn("base_spans", base_spans(F.col("text")))
        .withColumn("_added", added)
        .withColumn("spans", F.array_sort(F.concat("base_spans", free)))
        .drop("_added")
    )


def span_text(spans: Column | str) -> Column:
    """`kind:start:end`, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span, or overlapping spans together, replaced by a mask. Null stays null."""
    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("CAST(array() AS array<string>)").alias("out"))

    def step(state: Column, s: Column) -> Column:
        before = F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        masked = F.concat(state["out"], F.array(before, F.lit(MASK)))
        return F.when(s["start"] >= state["at"], F.struct(s["end"].alias("at"), masked.alias("out"))).otherwise(
            F.struct(F.greatest(state["at"], s["end"]).alias("at"), state["out"].alias("out"))
        )

    def finish(state: Column) -> Column:
        rest = F.substring(text, (state["at"] + 1).cast("int"), F.length(text))
        return F.concat(F.array_join(state["out"], ""), rest)

    return F.when(F.size(spans) > 0, F.aggregate(spans, first, step, finish)).otherwise(text)


def redact(docs: DataFrame, model: SecretModel) -> DataFrame:
    """`docs` with secrets masked in `text`, and `n_chars`, where there is one, of the new text; all else stays."""
    docs, named_back = set_aside(docs, ["base_spans", "spans", "_added", "_masked"])
    masked = scan(docs, model).withColumn("_masked", redacted(F.col("text"), F.col("spans")))
    values = {"text": F.col("_masked")}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(F.size("spans") > 0, F.length("_masked").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return named_back(masked.withColumns(values).select(*docs.columns))


def model_of(docs: DataFrame) -> SecretModel:
    """A model trained from the documents themselves: what the fixed kinds find is random, the rest ordinary."""
    return train(checkpointed(labelled_strings(docs), "secret-strings"))
