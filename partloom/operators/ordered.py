"""Ordered work inside groups of any size.

A plain window sorts a whole group in one task, so one hot key would stall a cluster. Here a group is
cut into order-preserving chunks: totals per chunk are pre-aggregated on the map side, their running
sums are small, and only the inside of a chunk is windowed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from partloom.session import broadcast_if_small, checkpointed

CHUNK_ROWS = 65_536


def id_chunk(column: Column | str, width: int = CHUNK_ROWS) -> Column:
    """Chunk of a whole-number order column: at most `width` distinct values each."""
    column = F.col(column) if isinstance(column, str) else column
    return F.call_function("div", column.cast("bigint"), F.lit(width))


def chunk_offsets(df: DataFrame, keys: Sequence[str], sums: Sequence[str], *, descending: bool = False) -> DataFrame:
    """Per key and `_chunk`: totals `_t_*` and the sums `_o_*` over all earlier chunks of the key."""
    totals = df.groupBy(*keys, "_chunk").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    order = F.desc("_chunk") if descending else F.asc("_chunk")
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumns({f"_o_{n}": F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)) for n in sums})


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    chunk: Column,
    sums: Mapping[str, Column],
    *,
    inclusive: bool = False,
    descending: bool = False,
    needed: Callable[[Callable[[str], Column]], Column] | None = None,
) -> DataFrame:
    """Adds one running sum per entry of `sums`, over the rows of a key before (or up to) each row.

    `chunk` must not fall along `order` (not rise, if `descending`). `needed` tells from the sums at the
    start of a chunk (and the keys) whether any of its rows is wanted: other chunks are dropped before
    anything is sorted, and before the shuffle if the list of needed chunks turns out short.
    """
    names = list(sums)
    work = df.withColumns({"_chunk": chunk, **{f"_v_{n}": e for n, e in sums.items()}})
    offsets = chunk_offsets(work, keys, names, descending=descending).drop(*[f"_t_{n}" for n in names])
    if needed is not None:
        offsets = broadcast_if_small(offsets.filter(needed(lambda n: F.col(f"_o_{n}"))))
    inside = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    joined = work.join(offsets, [*keys, "_chunk"])
    out = joined.withColumns(
        {n: F.col(f"_o_{n}") + F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in names}
    )
    return out.drop("_chunk", *[f"_v_{n}" for n in names], *[f"_o_{n}" for n in names])


def smallest_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], chunk: Column, k: Column) -> DataFrame:
    """Rows of each key whose position in `order` is at most `k`: a literal, a scalar, or one of the keys.

    Chunks wholly above the cut are dropped without any sort.
    """
    placed = running_sums(df, keys, order, chunk, {"_place": F.lit(1)}, needed=lambda start: start("_place") < k)
    return placed.filter(F.col("_place") < k).drop("_place")


def global_row_number(df: DataFrame, order: Sequence[Column | str], name: str = "row_number") -> DataFrame:
    """1-based position over the whole table, without a single-task window.

    The range-partitioned rows are written once, so that the per-partition counts and the rows agree
    on the borders even if an executor is lost in between.
    """
    ranged = checkpointed(df.repartitionByRange(*order).withColumn("_chunk", F.spark_partition_id()))
    counts = ranged.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition, whatever the size of the table.
    offsets = counts.select("_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("_chunk").orderBy(*order)
    joined = ranged.join(F.broadcast(offsets), "_chunk")
    return joined.withColumn(name, F.col("_o") + F.row_number().over(inside)).drop("_chunk", "_o")


def exact_median(df: DataFrame, keys: Sequence[str], value: str, chunk: Column, name: str = "median") -> DataFrame:
    """Median of `value` per key (mean of the two middle values for an even count).

    Equal values are counted first, so a value that fills most of a group is one row; only the one or two
    chunks that hold the middle are looked at.
    """
    work = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_v_n")).withColumn("_chunk", chunk)
    offsets = chunk_offsets(work, keys, ["n"])
    sizes = offsets.groupBy(*keys).agg(F.sum("_t_n").alias("_n"))
    spans = offsets.join(sizes, list(keys)).withColumns(
        {"_low": F.floor((F.col("_n") + 1) / 2), "_high": F.floor((F.col("_n") + 2) / 2)}
    )
    middle = spans.filter((F.col("_o_n") < F.col("_high")) & (F.col("_o_n") + F.col("_t_n") >= F.col("_low")))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = work.join(middle, [*keys, "_chunk"]).withColumn("_upto", F.col("_o_n") + F.sum("_v_n").over(inside))

    def at(place: str) -> Column:
        here = (F.col("_upto") >= F.col(place)) & (F.col("_upto") - F.col("_v_n") < F.col(place))
        return F.max(F.when(here, F.col(value)))

    return ranked.groupBy(*keys).agg(((at("_low") + at("_high")) / 2).alias(name))


RUN_ROWS, RUNS = 4096, 1024


def decayed_series(df: DataFrame, key: str, order: str, value: str, decay: float) -> DataFrame:
    """Exponential moving average along `order` per key, the first value as seed.

    `order` must number the rows of a key 1, 2, 3, …  A run of rows turns the state before it into the state
    after it by `state -> factor * state + tail`. Such maps compose, so runs are put together by the thousand
    until a key has one; going back down, every run gets the exact state it starts from, however far back
    that comes from.
    """
    if not 0 < decay < 1:
        raise ValueError("decay must lie between 0 and 1")
    # Longest run whose weights stay far inside the range of a double.
    width = max(1, min(RUN_ROWS, int(math.log(1e-100) / math.log(decay))))
    position = (F.col(order) - 1) % width + 1
    base = F.lit(decay)
    rows = df.withColumns(
        {
            "_run": F.floor((F.col(order) - 1) / width).cast("bigint"),
            "_age": position.cast("double"),
            "_w": F.col(value) * F.when(F.col(order) == 1, 1.0).otherwise(1.0 - decay),
        }
    )
    # A run that others follow is full.
    maps = rows.groupBy(key, "_run").agg(F.sum(F.col("_w") * F.pow(base, width - F.col("_age"))).alias("tail")).select(
        key, "_run", F.lit(decay**width).alias("factor"), "tail"
    )
    levels: list[DataFrame] = []
    while True:
        parent = id_chunk("_run", RUNS).alias("_parent")
        bundle = F.sort_array(F.collect_list(F.struct(F.col("_run").alias("run"), "factor", "tail")))
        level = checkpointed(maps.groupBy(key, parent).agg(bundle.alias("_maps")), "runs")
        levels.append(level)
        if (level.agg(F.max("_parent")).first()[0] or 0) == 0:
            break
        whole = F.aggregate(
            "_maps",
            F.struct(F.lit(1.0).alias("factor"), F.lit(0.0).alias("tail")),
            lambda s, m: F.struct((s["factor"] * m["factor"]).alias("factor"), (s["tail"] * m["factor"] + m["tail"]).alias("tail")),
        )
        maps = level.select(key, F.col("_parent").alias("_run"), whole.alias("_m")).select(key, "_run", "_m.factor", "_m.tail")
    starts = levels[-1].select(key, F.col("_parent"), F.lit(0.0).alias("_start"))
    for level in reversed(levels):
        none = F.expr("CAST(array() AS array<struct<run:bigint,start:double>>)")
        walk = F.aggregate(
            "_maps",
            F.struct(F.col("_start").alias("state"), none.alias("out")),
            lambda s, m: F.struct(
                (m["factor"] * s["state"] + m["tail"]).alias("state"),
                F.array_append(s["out"], F.struct(m["run"].alias("run"), s["state"].alias("start"))).alias("out"),
            ),
        )
        inner = level.join(starts, [key, "_parent"]).select(key, F.explode(walk["out"]).alias("_o"))
        starts = inner.select(key, F.col("_o.run").alias("_parent"), F.col("_o.start").alias("_start"))
    carried = starts.select(key, F.col("_parent").alias("_run"), F.col("_start").alias("_carry"))
    inside = Window.partitionBy(key, "_run").orderBy(order)
    grown = F.sum(F.col("_w") * F.pow(base, -F.col("_age"))).over(inside)
    state = F.pow(base, F.col("_age")) * (F.col("_carry") + grown)
    return rows.join(carried, [key, "_run"]).withColumn("ema", state).drop("_run", "_age", "_w", "_carry")
