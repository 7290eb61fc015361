"""Text helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# A word: a longest run of characters other than the six ASCII white-space ones.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text in order; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("bigint")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether a document is kept from training: its id is hashed as text. A null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus)) == remainder, F.lit(False))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, where the optimizer would copy it into each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def set_aside(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`df` with columns that bear one of `names` under other names, and a function that gives them theirs back."""
    taken = {c.lower() for c in (*df.columns, *names)}
    renamed = {}
    for column in df.columns:
        if column.lower() in {n.lower() for n in names}:
            spare = column
            while spare.lower() in taken:
                spare += "_"
            taken.add(spare.lower())
            renamed[column] = spare
    back = {v: k for k, v in renamed.items()}
    return df.withColumnsRenamed(renamed), lambda out: out.withColumnsRenamed(back)
