"""Operator 8: best-fit packing of tokenised documents into sequences, by hierarchical rounds.

Every document is cut into full pieces, which fill a sequence each, and at most one residual piece. Partitions
pack their residual pieces by best fit, longest first, and close nearly full bins. The underfull bins of a partition
are the items of the next round, in which an eighth of the partitions do the same, until one partition holds the few
bins that are left. Best fit leaves at most one bin up to half full in a partition, for two of them would have shared
one; a fuller bin takes part in a merge only with such a one. So of the fuller bins no more go on than a best matching
with those up to half full needs, found on the counts by load, at most one number for each; the others are closed.
A round thus gets at most two bins for each partition of the round before, whatever the lengths. Each round's input is a written table and is sorted before packing, so that a lost executor's work
comes out the same when it is done again.

Defined results: a null or empty text is the end token alone, a sequence item of length 1; repeated rows are packed one
by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.shared import tidy, written
from rankweave.llm.tokens import VOCABULARY, Words

#: A bin is nearly full, and closed, when at most this share of it is free.
SLACK = 1 / 64
#: Partitions of one round that meet in one of the next.
FAN_IN = 8

PIECES = "item long, doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of n tokens: all are full but, possibly, the first."""
    first = n % capacity or capacity
    return [0, *range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int, end_id: int, vocabulary: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(vocabulary, lambda ids: np.array(ids, "<u4").tobytes())
        end, item = int(end_id).to_bytes(4, "little"), TaskContext.get().partitionId() << 32
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = b"".join(words.values_of(text or "")) + end
                n = len(ids) // 4
                starts = cut(n, capacity)
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    rows.append((item, doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
                    item += 1
            out = pd.DataFrame(rows, columns=["item", "doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInPandas(tidy(run), PIECES)


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each length, given longest first, and each bin's load. The fullest bin that has room gets the next."""
    free: dict[int, list[int]] = {}
    mask, bins, offsets, loads = 0, [], [], []
    for n in lengths:
        rest = mask >> n
        if rest:
            room = n + (rest & -rest).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            b, room = len(loads), capacity
            loads.append(0)
        bins.append(b)
        offsets.append(loads[b])
        loads[b] += n
        if room > n:
            free.setdefault(room - n, []).append(b)
            mask |= 1 << (room - n)
    return bins, offsets, loads


def pack_round(items: DataFrame, parts: int, capacity: int, level: int) -> DataFrame:
    """items: (item, length, part); adds bin, place (offset in the bin) and load (the bin's)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"item": [], "length": []}, dtype="int64"), *(b[["item", "length"]] for b in batches)])
        rows = rows.astype("int64").sort_values(["length", "item"], ascending=[False, True])
        bins, offsets, loads = best_fit(rows["length"].tolist(), capacity)
        base = (level << 56) | (TaskContext.get().partitionId() << 32)
        rows["bin"] = np.array(bins, "int64") + base
        rows["place"] = np.array(offsets, "int64")
        rows["load"] = np.array(loads, "int64")[np.array(bins, "int64")] if bins else np.array([], "int64")
        yield rows

    return items.repartition(parts, F.col("part")).mapInPandas(tidy(run), "item long, length long, bin long, place long, load long")


def mergeable(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Of the numbers of bins by load, how many can still be merged: all up to half full, and their partners in a best matching.

    Whoever is longest has the fewest partners to choose from, so it chooses first, the fullest that has room.
    """
    half = capacity // 2
    kept = {load: n for load, n in counts.items() if load <= half}
    fuller = sorted(load for load in counts if load > half)
    fitting, at = [], 0
    for load, n in sorted(kept.items(), reverse=True):
        while at < len(fuller) and fuller[at] + load <= capacity:
            fitting.append([fuller[at], counts[fuller[at]]])
            at += 1
        while n and fitting:
            used = min(n, fitting[-1][1])
            kept[fitting[-1][0]] = kept.get(fitting[-1][0], 0) + used
            n, fitting[-1][1] = n - used, fitting[-1][1] - used
            if not fitting[-1][1]:
                fitting.pop()
    return kept


def go_on(open_bins: DataFrame, capacity: int) -> DataFrame | None:
    """The bins (bin, length) of the next round, None if no two of them can be merged."""
    kept = mergeable({r.length: r.n for r in open_bins.groupBy("length").agg(F.count("*").alias("n")).collect()}, capacity)
    if sum(kept.values()) < 2:
        return None
    numbers = open_bins.sparkSession.createDataFrame(sorted(kept.items()), "length long, most long")
    # The constant lets each task drop what is beyond it before bins of one load meet.
    order = F.row_number().over(Window.partitionBy("length").orderBy("bin"))
    first = open_bins.withColumn("place", order).where(F.col("place") <= max(kept.values()))
    return first.join(F.broadcast(numbers), "length").where(F.col("place") <= F.col("most")).select("bin", "length")


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 0, vocabulary: str = VOCABULARY, parts: int | None = None) -> DataFrame:
    """docs (doc_id, text) to one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = written(pieces(docs, capacity, end_id, vocabulary))
    left = rows.where(F.col("length") < capacity)
    items = left.select("item", "length", F.pmod(F.xxhash64("item"), F.lit(parts)).alias("part"))
    placed, level = None, 1
    while True:
        packed = written(pack_round(items, parts, capacity, level))
        if placed is None:
            placed = packed.select("item", "bin", "place")
        else:
            moved = packed.select(F.col("item").alias("bin"), F.col("bin").alias("to"), F.col("place").alias("by"))
            placed = placed.join(moved, "bin", "left").select("item", F.coalesce("to", "bin").alias("bin"), (F.col("place") + F.coalesce("by", F.lit(0))).alias("place"))
        if parts == 1:
            break
        open_bins = packed.where(F.col("load") < capacity * (1 - SLACK)).groupBy("bin").agg(F.max("load").alias("length"))
        left = go_on(open_bins, capacity)
        if left is None:
            break
        parts, level = -(-parts // FAN_IN), level + 1
        items = left.select(F.col("bin").alias("item"), "length", F.pmod(F.xxhash64("bin"), F.lit(parts)).alias("part"))
    alone = rows.where(F.col("length") == capacity).withColumn("sequence_id", F.col("item")).withColumn("offset", F.lit(0).cast("long"))
    shared = rows.where(F.col("length") < capacity).join(placed, "item").withColumnRenamed("bin", "sequence_id").withColumnRenamed("place", "offset")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return alone.select(columns).unionByName(shared.select(columns))


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
