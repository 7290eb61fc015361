"""Mixing sources to target weights by weighted fair queueing.

The documents of a source queue up in a keyed random order, once per epoch. A document leaves its queue at
the virtual time `words of its source up to and including it / target of the source`. All queues are served
in order of virtual time until the budget is spent. Since the targets add up to the budget, that is at
virtual time 1, so that no task has to see the whole queue to know where it ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from partloom.llm.text import set_aside, word_count
from partloom.operators.ordered import global_row_number
from partloom.session import checkpointed

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
CHUNK_WORDS = 250_000


def source_targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Word targets per source, from `(source, source_size)`.

    Sources in order of code point, null last, take the weights in turn and share the sum of all sizes. No
    target exceeds `max_epochs` times the size of its source; what is cut off goes to the others by weight,
    until none is above. In order of size per weight, exactly the first sources are full: the level is the
    rest of the budget over the rest of the weights at the first source that stays below its limit.
    """
    placed = global_row_number(totals, [F.asc_nulls_last("source")], "_place")
    turn = F.element_at(F.array(*[F.lit(int(w)).cast("bigint") for w in weights]), (F.pmod(F.col("_place") - 1, len(weights)) + 1).cast("int"))
    limits = placed.select("source", "source_size", turn.alias("_w"), (F.col("source_size") * max_epochs).alias("_limit"))
    # One row per source of the mix, the length of its configuration.
    order = Window.orderBy(F.col("_limit") / F.col("_w"), F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything)
    level = (budget - F.coalesce(F.sum("_limit").over(before), F.lit(0))).cast("double") / F.sum("_w").over(
        order.rowsBetween(0, Window.unboundedFollowing)
    ).cast("double")
    levels = limits.withColumn("_level", level)
    open_level = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_limit"), F.struct(F.col("_limit") / F.col("_w"), F.col("_level")))).over(everything)
    share = F.coalesce(open_level["_level"] * F.col("_w"), F.col("_limit").cast("double"))
    return levels.select("source", "source_size", F.least(F.col("_limit").cast("double"), share).alias("target"))


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[int] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = "mix",
    chunk_words: int = CHUNK_WORDS,
) -> DataFrame:
    """What the mix takes of each document.

    `docs` has `doc_id`, `text` and `source`; of other columns only `_row`, a unique number of each row, is
    kept if there is one. Rows without an id are shuffled by their texts. Returns one row per document with
    `doc_id, source, size, source_size, target, served` and `taken`. `served` lists the words taken in each
    epoch with the virtual times at which the document starts and ends; `taken` is their sum. The document
    at the end of the budget is taken in part. Sizes are words; null and blank texts have size 0 and
    nothing is taken of them. A null source is a source of its own. Repeated rows are documents of their
    own: those that agree in id and size are interchangeable, so reruns agree. An empty table gives none.

    A source of any size is cut into chunks of about `chunk_words` words by the leading digits of its
    shuffle key. Only the totals of chunks are added up in order; a window sorts the inside of one chunk.
    """
    row = [c for c in ("_row",) if c in docs.columns]
    unnamed = F.md5(F.coalesce(F.col("text"), F.lit("")))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), unnamed)))
    sized = checkpointed(docs.select(*row, "doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("_key")), "mix")
    totals = checkpointed(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    # Of a source with few words per chunk there are few chunks; 2^28 at most.
    parts = F.greatest(F.lit(1), F.least(F.ceil(F.col("source_size") / chunk_words), F.lit(1 << 28))).cast("bigint")
    targets = checkpointed(source_targets(totals, weights, max_epochs).withColumn("_parts", parts), "mix-targets")
    same_source = sized["source"].eqNullSafe(targets["source"])
    placed = sized.join(targets, same_source).drop(targets["source"])
    lead = F.conv(F.substring("_key", 1, 8), 16, 10).cast("bigint")
    placed = placed.withColumn("_chunk", F.floor(lead * F.col("_parts") / F.lit(float(1 << 32))).cast("bigint"))
    chunks = placed.groupBy("source", "_chunk").agg(F.sum("size").alias("_words"))
    earlier = Window.partitionBy("source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.select(
        F.col("source").alias("_s"), F.col("_chunk").alias("_c"), F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_offset")
    )
    joined = placed.join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_chunk") == F.col("_c")))
    inside = Window.partitionBy("source", "_chunk").orderBy("_key", "doc_id", "size", *row).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    served = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(max_epochs - 1)), lambda epoch: _service(epoch, F.col("_start"))),
        lambda s: s["words"] > 0,
    )
    return (
        joined.withColumn("_start", start)
        .withColumn("served", served)
        .withColumn("taken", F.aggregate("served", F.lit(0).cast("bigint"), lambda total, s: total + s["words"]))
        .select(*row, "doc_id", "source", "size", "source_size", "target", "served", "taken")
    )


def _service(epoch: Column, start: Column) -> Column:
    begin = start + epoch.cast("bigint") * F.col("source_size")
    left = F.floor(F.col("target")).cast("bigint") - begin
    return F.struct(
        epoch.alias("epoch"),
        F.try_divide(begin, F.col("target")).alias("start"),
        F.try_divide(begin + F.col("size"), F.col("target")).alias("finish"),
        F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), left)).alias("words"),
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mixed corpus: whole documents with all their columns, repeated per epoch, in order of virtual time.

    A document that the end of the budget cuts is there if at least half of it fits. Every row is a document of
    its own, also with a null or repeated `doc_id`. Columns of any name and type are kept.
    """
    docs, named_back = set_aside(docs, ["_row", "_size", "_s", "_finish"])
    # The number is stored with the row, so that it is the same on both sides of the join.
    stored = checkpointed(docs.withColumn("_row", F.monotonically_increasing_id()), "mix-rows")
    served = mix(stored, **settings).select("_row", F.col("size").alias("_size"), F.explode("served").alias("_s"))
    taken = served.filter(F.col("_s.words") * 2 >= F.col("_size")).select("_row", F.col("_s.finish").alias("_finish"))
    order = ["_finish", "doc_id", "_row"]
    return named_back(stored.join(taken, "_row").repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns))
