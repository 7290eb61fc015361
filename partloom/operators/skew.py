"""Joins of many rows to one small record per group, when one group may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

HOT_ROWS = 1_000_000


def hot_keys(rows: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than `hot_rows` rows, and into how many pieces to cut them."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > hot_rows)
    return counted.select(*keys, F.ceil(F.col("_rows") / hot_rows).alias("_pieces"))


def split_join(
    rows: DataFrame,
    records: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    *,
    hot_rows: int | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """`rows` joined to `records` on `keys`, with known hot keys cut into pieces.

    Without `hot` and `hot_rows` this is a plain join: small records are broadcast, and adaptive execution
    splits skewed partitions, while `rows` is evaluated once. Counting hot keys first means evaluating `rows`
    again, so it is done on request only.

    A plain join of large sides sends a whole group to one task, and an aggregation by finer keys would stay
    there with it. With `hot` the rows of a hot key go to a piece by a hash of `spread`, and its records are repeated per
    piece. Hot keys are found by a pre-aggregated count; there can be only one per `hot_rows` rows (a
    million in 10^12 rows), so their list is safe to broadcast. Keys that are not hot join as usual. Pass
    stored `hot_keys` as `hot` when the same rows are joined again and again.
    """
    if hot is None and hot_rows is None:
        return rows.join(records, list(keys), how)
    hot = F.broadcast(hot_keys(rows, keys, hot_rows) if hot is None else hot)
    piece = F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_pieces")), F.lit(0).cast("bigint"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_pieces", F.lit(1).cast("bigint")) - 1))
    cut_rows = rows.join(hot, list(keys), "left").withColumn("_piece", piece).drop("_pieces")
    cut_records = records.join(hot, list(keys), "left").withColumn("_piece", every).drop("_pieces")
    return cut_rows.join(cut_records, [*keys, "_piece"], how).drop("_piece")
