"""Progress of running jobs: snapshots, smoothed rates, and the same from a stream of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How much each phase counts, and how much of the old rate a new one keeps.
PHASE_WEIGHTS = {"phase1": 0.55, "phase2": 0.45, "full": 1.0}
KEEP = 0.65


def snapshot(phases: DataFrame) -> DataFrame:
    """phases (job, weight, done, total) to the weighted percentage of each job, at most 99 until all is done."""
    share = F.sum(F.col("weight") * F.col("done") / F.greatest("total", F.lit(1))) / F.sum("weight") * 100
    whole = F.min(F.col("done") >= F.col("total"))
    out = phases.groupBy("job").agg(share.alias("share"), whole.alias("all_done"), F.sum("done").alias("done"), F.sum("total").alias("total"))
    return out.select("job", "done", "total", F.when(F.col("all_done"), 100.0).otherwise(F.least(F.lit(99.0), F.floor(F.col("share") * 10 + 0.5) / 10)).alias("percent"))


def outlook(phases: DataFrame) -> DataFrame:
    """phases (job, place, phase, weight, done, total, rate) to where each job stands: percent over its phases that have work, the first unfinished phase, and the seconds left.

    A phase counts by its weight. The seconds left are of the unfinished phases whose rate is known, null if there is none.
    """
    share = F.least(F.lit(1.0), F.col("done") / F.col("total"))
    left = F.when((F.col("done") < F.col("total")) & (F.col("rate") > 0), (F.col("total") - F.col("done")) / F.col("rate"))
    one = lambda c: F.floor(c * 10 + 0.5) / 10
    found = phases.where("total > 0").groupBy("job").agg(
        F.sum(F.col("weight") * share).alias("reached"),
        F.sum("weight").alias("all"),
        F.min(F.when(share < 1, F.struct("place", "phase", "done", "total"))).alias("now"),
        F.sum(left).alias("left"),
    )
    now = F.col("now")
    return found.select(
        "job",
        F.when(now.isNull(), 100.0).otherwise(one(F.col("reached") / F.col("all") * 100)).alias("percent"),
        now["phase"].alias("phase"),
        now["done"].alias("phase_done"),
        now["total"].alias("phase_total"),
        F.coalesce(one(100 * now["done"] / now["total"]), F.lit(100.0)).alias("phase_percent"),
        one(F.col("left")).alias("seconds_left"),
    )


def without_tracker(done: Column, total: Column, finished: Column) -> Column:
    """The percentage of a job whose progress isn't tracked: processed of all rows, at most 95 until it is finished."""
    share = F.floor(1000.0 * done / F.greatest(total, F.lit(1)) + 0.5) / 10
    return F.when(finished, 100.0).otherwise(F.least(F.lit(95.0), share))


def smoothed_rates(steps: DataFrame) -> DataFrame:
    """steps (job, t in seconds, done) to the exponentially smoothed rate of each job, a fold over the steps in order. Steps that take no time or add nothing leave the rate."""
    ordered = steps.groupBy("job").agg(F.array_sort(F.collect_list(F.struct("t", "done"))).alias("s"))
    start = F.struct(F.lit(None).cast("double").alias("t"), F.lit(0.0).alias("done"), F.lit(None).cast("double").alias("rate"))

    def add(state, s):
        moved = (s["t"] > state["t"]) & (s["done"] > state["done"])
        now = (s["done"] - state["done"]) / F.nullif(s["t"] - state["t"], F.lit(0.0))
        rate = F.when(~F.coalesce(moved, F.lit(False)), state["rate"]).when(state["rate"].isNull(), now).otherwise(KEEP * state["rate"] + (1 - KEEP) * now)
        return F.struct(s["t"].alias("t"), s["done"].alias("done"), rate.alias("rate"))

    return ordered.select("job", F.size("s").cast("long").alias("steps"), F.aggregate("s", start, add)["rate"].alias("rate"))


RATES = "job long, t double, done double, rate double, steps long"


def streamed_rates(steps: DataFrame) -> DataFrame:
    """The same as a stream: keyed state holds a job's last step and rate; a job that got new steps gives one row per batch.

    Within a batch steps are put in order; a step that is older than the last batch's is counted but leaves the rate.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, done, rate, n = state.get if state.exists else (None, 0.0, None, 0)
        for t, now in sorted(pair for b in batches for pair in zip(b["t"], b["done"], strict=True)):
            n += 1
            if last is not None and t < last:
                continue
            if last is not None and t > last and now > done:
                speed = (now - done) / (t - last)
                rate = speed if rate is None else KEEP * rate + (1 - KEEP) * speed
            last, done = t, now
        state.update((last, done, rate, n))
        yield pd.DataFrame({"job": [key[0]], "t": [last], "done": [done], "rate": [rate], "steps": [n]})

    return steps.groupBy("job").applyInPandasWithState(fold, RATES, "t double, done double, rate double, steps long", "update", GroupStateTimeout.NoTimeout)


def stream_to(counted: DataFrame, folder: str, checkpoint: str, mode: str = "update") -> None:
    """Runs a stream over what is there; each batch of its rows goes to folder/batch=<number>."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    counted.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def daily_counts(spark: SparkSession, path: str, folder: str, checkpoint: str, lateness: str = "1 day", files: int = 16) -> DataFrame:
    """Counts per day and type of the event files in a folder, by a stream that takes what is there and stops.

    Only days that changed are written, and days beyond the lateness leave the state; the last word on a day is the newest batch's.
    """
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    counted = events.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    stream_to(counted.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n"), folder, checkpoint)
    log = spark.read.option("basePath", folder).parquet(folder)
    return log.groupBy("day", "event_type").agg(F.max_by("n", "batch").alias("n"))
