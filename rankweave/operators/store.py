"""State tables without a table format: upserts, sparse updates and reruns as joins that give the new table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, force: bool = False, always: tuple[str, ...] = ()) -> DataFrame:
    """new over old by key. Unless forced, a null in new keeps the old value, but for the columns in `always`."""
    fields = [c for c in old.columns if c != key]
    n = new.select(F.col(key), *(F.col(c).alias("new_" + c) for c in fields), F.lit(True).alias("is_new"))
    both = old.join(n, key, "full")
    take = lambda c: F.when(F.col("is_new"), F.col("new_" + c)).otherwise(F.col(c)) if force or c in always else F.coalesce("new_" + c, c)
    return both.select(key, *(take(c).alias(c) for c in fields))


def last_written(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The newest row of each key."""
    newest = Window.partitionBy(key).orderBy(F.desc(at))
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def rerun_set(rows: DataFrame, scores: DataFrame, key: str = "resume_id") -> tuple[DataFrame, DataFrame]:
    """Failed rows reset to pending, and the scores without theirs."""
    failed = rows.where("status = 'failed'")
    return failed.withColumn("status", F.lit("pending")), scores.join(failed.select(key), key, "left_anti")


def cache_key(model: Column, text: Column) -> Column:
    """One key for a text under a model; no text of one model can have that of another."""
    return F.sha2(F.concat(F.coalesce(model, F.lit("")), F.lit("\u0000"), F.coalesce(text, F.lit(""))).cast("binary"), 256)


def embedded(wanted: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """wanted (model, text and whatever else) with key and embedding, and what is new for the cache (key, model, embedding).

    Only keys that the cache doesn't hold are computed, each once, however many rows share it. compute takes
    (key, model, text) and gives (key, embedding).
    """
    asked = wanted.withColumn("key", cache_key(F.col("model"), F.col("text")))
    missing = asked.select("key", "model", "text").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    new = missing.select("key", "model").join(compute(missing), "key")
    known = cache.select("key", "embedding").unionByName(new.select("key", "embedding"))
    return asked.join(known, "key", "left"), new


def numbered(rows: DataFrame, by: str, name: str, after: DataFrame | None = None, parts: int = 64) -> DataFrame:
    """Adds name: ids without gaps that follow the largest one of `after`, or begin at 1.

    Rows fall into parts by the hash of their key, which must be unique; parts are numbered side by side and then moved by the
    sizes of those before them. A row's id depends on the rows alone, so a repeated run gives the same.
    """
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("n"))
    if after is not None:
        sizes = sizes.unionByName(after.agg(F.coalesce(F.max(name), F.lit(0)).cast("long").alias("n")).select(F.lit(-1).alias("_part"), "n"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))  # a row per part
    within = F.row_number().over(Window.partitionBy("_part").orderBy(by))
    out = dealt.withColumn("_place", within).join(F.broadcast(before), "_part")
    return out.withColumn(name, (F.col("_before") + F.col("_place")).cast("long")).drop("_part", "_place", "_before")


def without_collisions(new: DataFrame, old: DataFrame, group: str, name: str, order: str) -> DataFrame:
    """New files whose name stands in their group already, among old rows or earlier new ones, get eight letters of a hash before it."""
    taken = old.select(group, name).distinct().withColumn("_taken", F.lit(True))
    turn = F.row_number().over(Window.partitionBy(group, name).orderBy(order))
    placed = new.withColumn("_turn", turn).join(taken, [group, name], "left")
    clash = F.col("_taken").isNotNull() | (F.col("_turn") > 1)
    mark = F.left(F.sha2(F.concat_ws("|", group, order, name).cast("binary"), 256), F.lit(8))
    return placed.withColumn(name, F.when(clash, F.concat_ws("_", mark, name)).otherwise(F.col(name))).select(*new.columns)
