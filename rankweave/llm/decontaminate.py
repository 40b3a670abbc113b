"""Operator 10: benchmark decontamination by a broadcast set of normalised test n-grams, in built-in functions only.

Every run of ten words of a benchmark item (all its words, if it has fewer) is a gram, a space-joined string. The
distinct grams are broadcast when their number is within a bound, and shuffled otherwise; the windows of training texts
look them up by the whole string, so that a match needs no second look. A document's hits are merged into spans.

Defined results: null or wordless texts have no words and no hits; null or wordless items have no grams; an item that
occurs twice counts once; repeated document rows are judged one by one; an empty table on either side gives no hits;
other columns are ignored by decontaminate() and kept by clean_documents().
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.shared import ascii_lower

#: Fixed value: what separates words, after A-Z have become a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Most grams to broadcast; of ten words each they take about 200 MB.
MAX_BROADCAST = 1_000_000


def words_of(text):
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def windows(words, length: int):
    """(pos, gram) of each run of so many words."""
    last = F.size(words) - length
    made = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("pos"), F.array_join(F.slice(words, i + 1, length), " ").alias("gram")))
    return F.when(last >= 0, made).otherwise(F.array().cast("array<struct<pos:int,gram:string>>"))


def benchmark_grams(benchmark: DataFrame, length: int) -> DataFrame:
    """gram, n (its words), items: the sorted ids of the items that hold it."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words"))
    short = F.size("words").between(1, length - 1)
    grams = F.when(short, F.array(F.array_join("words", " "))).otherwise(F.transform(windows(F.col("words"), length), lambda w: w["gram"]))
    each = words.select("item_id", F.least(F.size("words"), F.lit(length)).alias("n"), F.explode(grams).alias("gram"))
    return each.groupBy("gram", "n").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, length: int = 10, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, spans (array of from, to in words), items (sorted ids)."""
    grams = benchmark_grams(benchmark, length).cache()
    sizes = {r.n: r["count"] for r in grams.groupBy("n").count().collect()}
    known = grams.select("gram", "n", "items")
    known = F.broadcast(known) if sum(sizes.values()) <= max_broadcast else known
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("words"))
    # A first entry without a gram stands for the document itself and outlives the lookup.
    itself = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("gram")))
    looked_up = F.concat(itself, *(windows(F.col("words"), n) for n in sorted(sizes)))
    each = texts.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.explode(looked_up).alias("w")).select("row", "doc_id", "n_words", "w.pos", "w.gram")
    hits = each.join(known, "gram", "left").where((F.col("pos") < 0) | F.col("n").isNotNull())
    span = F.when(F.col("pos") >= 0, F.struct(F.col("pos").alias("from"), (F.col("pos") + F.col("n")).alias("to")))
    per_doc = hits.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.sort_array(F.collect_list(span)).alias("found"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    empty = F.array().cast("array<struct<from:int,to:int>>")
    merged = F.aggregate(
        "found",
        empty,
        lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1)["to"] >= s["from"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["from"].alias("from"), F.greatest(F.element_at(done, -1)["to"], s["to"]).alias("to"))))).otherwise(F.concat(done, F.array(s))),
    )
    out = per_doc.select("doc_id", "n_words", F.when(F.size("found") > 0, merged).otherwise(empty).alias("spans"), "items")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return out.withColumn("n_hit", n_hit)


def clean_documents(docs: DataFrame, benchmark: DataFrame, length: int = 10) -> DataFrame:
    """The documents without any hit, with all their columns. Each row is judged by its own text, whether or not it shares its id, or has none."""
    # Rows of the same text have the same verdict, so a text's hash may stand for its row.
    named = docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("doc_id"), "text")
    hit = decontaminate(named, benchmark, length).where(F.col("n_hit") > 0).select(F.col("doc_id.doc_id").alias("hit_id"), F.col("doc_id.text_hash").alias("hit_hash")).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["hit_id"]) & (F.xxhash64(docs["text"]) == hit["hit_hash"]), "left_anti")


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP10_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
    SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bg AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (
    SELECT DISTINCT n FROM bg
), dg AS (
    SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hit AS (
    SELECT dg.doc_id, dg.i, dg.n, bg.item_id FROM dg JOIN bg USING (gram, n)
), words AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
