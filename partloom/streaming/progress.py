"""Incremental progress: new units arrive as files, finished ones are skipped, counters follow each batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Process = Callable[[DataFrame], DataFrame]


KEY_BUCKETS = 64


class FinishedUnits:
    """Keys of completed units, in folders by a hash of the key and then by batch.

    A batch opens only the folders of its own keys, so what it reads does not grow with the batches before it, as long
    as it has fewer keys than there are buckets.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = KEY_BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def among(self, units: DataFrame, batch_id: int) -> DataFrame:
        """Finished keys in the folders of `units`, those of this batch's own earlier attempts left out."""
        asked = units.select(self._bucket().alias("b")).distinct().collect()  # `buckets` rows at most
        file = self.spark._jvm.org.apache.hadoop.fs.Path
        files = file(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        there = [p for p in (f"{self.path}/bucket={r['b']}" for r in asked) if files.exists(file(p))]
        schema = units.select(*self.keys).schema
        if not there:
            return self.spark.createDataFrame([], schema)
        read = self.spark.read.schema(schema.add("batch", "long")).option("basePath", self.path).parquet(*there)
        return read.filter(F.col("batch") != batch_id).select(*self.keys)

    def add(self, finished: DataFrame, batch_id: int) -> None:
        """Writes the keys of a batch; a retry replaces its own folders."""
        rows = finished.select(*self.keys).withColumns({"bucket": self._bucket(), "batch": F.lit(batch_id).cast("bigint")})
        writer = rows.repartition("bucket").write.partitionBy("bucket", "batch").option("partitionOverwriteMode", "dynamic")
        writer.mode("overwrite").parquet(self.path)


def run_incremental(
    spark: SparkSession,
    source: str,
    schema: str,
    sink: str,
    checkpoint: str,
    *,
    keys: Sequence[str],
    process: Process,
    progress_schema: str,
    files_per_batch: int | None = None,
    buckets: int = KEY_BUCKETS,
) -> None:
    """Process everything that is new in `source`, then stop.

    A batch is written under its own number, so a batch that is retried after a lost executor or driver
    replaces its own rows and adds none twice. Units that a batch before has completed are skipped; failed ones are
    processed again when they arrive again. The keys of completed units lie beside the sink, in `<sink>-finished`.
    """
    finished = FinishedUnits(spark, f"{sink.rstrip('/')}-finished", keys, buckets)
    stream = spark.readStream.schema(schema)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)

    def handle(batch: DataFrame, batch_id: int) -> None:
        units = batch.dropDuplicates(list(keys))
        fresh = units.join(finished.among(batch, batch_id), list(keys), "left_anti")
        path = f"{sink}/batch={batch_id}"
        process(fresh).write.mode("overwrite").parquet(path)
        done = batch.sparkSession.read.schema(progress_schema).parquet(path)
        finished.add(done.filter(F.col("status") == "completed"), batch_id)

    query = (
        stream.parquet(source)
        .writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def progress_counters(progress: DataFrame) -> DataFrame:
    return progress.groupBy("status").agg(
        F.count(F.lit(1)).alias("num_units"), F.sum("num_records").alias("num_records")
    )
