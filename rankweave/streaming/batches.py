"""State tables fed by micro-batches: each batch writes what it changes under its own number, so that one that is run again changes nothing twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def run(spark: SparkSession, source: str, schema: StructType, change: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, files: int = 16, after: Callable[[int], None] | None = None) -> None:
    """Streams the Parquet files of a folder, so many at a time, and writes change(batch) as folder/batch=<number>; ends when all there are have been read.

    A batch that was cut short comes again with the same files under the same number and replaces what it had written.
    after(number), for tests and counters, is called once a batch's rows are there and before Spark notes it as done.
    """

    def write(batch: DataFrame, number: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        if after:
            after(number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(log: DataFrame, key: str, newest: Column, sums: tuple[str, ...] = ()) -> DataFrame:
    """A change log (key, fields, batch) as the table that it makes: added-up columns as sums, of the others the newest value that isn't null.

    newest orders a key's changes, for instance by batch; changes that it doesn't tell apart must be equal.
    """
    fields = [c for c in log.columns if c not in (key, "batch", *sums)]
    latest = (F.max_by(F.col(c), F.when(F.col(c).isNotNull(), newest)).alias(c) for c in fields)
    return log.groupBy(key).agg(*(F.sum(c).alias(c) for c in sums), *latest)


def compacted(spark: SparkSession, folder: str, upto: int, into: str, key: str, newest: Column, sums: tuple[str, ...] = ()) -> None:
    """The batches up to a number as one batch of another folder, which further batches can follow."""
    log = spark.read.option("basePath", folder).parquet(folder)
    old = current(log.where(F.col("batch") <= upto), key, newest, sums)
    old.write.mode("overwrite").parquet(f"{into}/batch={upto}")
    for number in [r.batch for r in log.where(F.col("batch") > upto).select("batch").distinct().collect()]:
        log.where(F.col("batch") == number).drop("batch").write.mode("overwrite").parquet(f"{into}/batch={number}")
