"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F


def build_session(app: str = "partloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Without the setting a local master, as in unit tests, uses a folder beside its warehouse; on a cluster it must be
    set, since a folder of one machine would be lost with it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/partloom-steps"
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder. All of one application lie in one folder."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark).rstrip('/')}/partloom-{app}/{name}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The setting holds for what runs inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def delete_stored(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table; call it once nothing reads it any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def checkpointed(df: DataFrame, name: str = "step") -> DataFrame:
    """Write `df` once to the shared folder and read it from there from now on.

    Cuts the lineage for loops, survives lost executors, and makes a plan see one and the same rows
    wherever it looks twice. As a Parquet table it also shows the planner its true size.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Stored `df`, marked for broadcast if it really has at most `max_rows` rows; otherwise joins shuffle."""
    stored = checkpointed(df, "small")
    return F.broadcast(stored) if stored.limit(max_rows + 1).count() <= max_rows else stored


class Rounds:
    """A table that grows by one folder per round of a loop and is always read as one scan."""

    def __init__(self, spark: SparkSession, name: str, schema: str):
        self.spark, self.schema = spark, schema
        self.path = scratch_path(spark, name)

    def add(self, df: DataFrame, turn: int) -> DataFrame:
        """Writes the rows of a round and returns them as stored."""
        df.write.parquet(f"{self.path}/turn={turn}")
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/turn={turn}")

    def read(self) -> DataFrame:
        """Rows of all rounds so far, with their `turn`; at least one round must have been added."""
        return self.spark.read.schema(f"{self.schema}, turn int").parquet(self.path)


class Flagged:
    """A stored table whose rows carry a boolean `flag` and lie in one folder per value.

    Whether any row is flagged is then a question to the file system, not a job.
    """

    def __init__(self, df: DataFrame, flag: str, name: str):
        self.spark, self.flag, self.schema = df.sparkSession, flag, df.schema
        self.path = scratch_path(self.spark, name)
        df.write.partitionBy(flag).parquet(self.path)

    def any(self) -> bool:
        return self._files().exists(self._file(f"{self.path}/{self.flag}=true"))

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def flagged(self) -> DataFrame:
        return self.read().filter(F.col(self.flag))

    def free(self) -> None:
        """Deletes the table; call it once nothing reads it any more."""
        self._files().delete(self._file(self.path), True)

    def _file(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self):
        return self._file(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())


class SharedStages:
    """Stored results that several steps of one query need, keyed by plan.

    Asked twice for the same plan, however it was put together, it computes and stores that once. It lives as long as
    one query, so that later ones see later inputs.
    """

    def __init__(self) -> None:
        self._stored: dict[int, list[tuple[DataFrame, DataFrame]]] = {}

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        known = self._stored.setdefault(df.semanticHash(), [])
        for plan, result in known:
            if plan.sameSemantics(df):
                return result
        known.append((df, checkpointed(df, name)))
        return known[-1][1]
