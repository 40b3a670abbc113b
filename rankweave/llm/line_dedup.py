"""Operator 13: lines that several documents share stay in the first of them only, in built-in functions only.

Each line that can be shared becomes a 128-bit hash of its key with the document and the position. The hashes are dealt
out by range, sorted by document and position within a hash, and read in that order: the first document of a hash keeps
its lines, all others lose theirs. What comes back is a run-length keep bitmap for each document that loses a line, so
texts are never sorted. A key that holds more than one in HOT_PARTS of all lines would make one task too large: such
keys, at most HOT_PARTS of them, are counted by partial aggregation, and their first documents are broadcast.

Defined results: a null or empty text is one empty line; a line's \\r belongs to the white space that its key leaves out; a
key found in one document alone is kept however often it stands there; rows that share a doc_id are one document; rows
without one are together a document that comes after all others; repeated rows are judged alike; very long texts and lines
are taken whole; an empty table gives an empty result; other columns are ignored by keep_bitmaps() and kept by
without_shared_lines().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.shared import ascii_lower, dropped, written

#: Fixed value: what a key leaves out at both ends.
BLANKS = " \t\n\x0b\x0c\r"
#: A key with more than a share of 1 in so many of all lines is hot; there are fewer of them than that.
HOT_PARTS = 1_000
KEEP = "array<struct<first:int,n:int>>"


def lines_of(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed_lines(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, doc_hash, n_lines, pos, and the two hashes of the key, of all lines whose key has at least so many code points."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("doc_hash"), lines_of(F.col("text")).alias("lines"))
    each = texts.select("doc_id", "doc_hash", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    keyed = each.withColumn("key", F.trim(F.col("line"), F.lit(BLANKS))).where(F.length("key") >= least).withColumn("key", ascii_lower(F.col("key")))
    return keyed.select("doc_id", "doc_hash", "n_lines", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"))


def hot_keys(lines: DataFrame, parts: int) -> DataFrame:
    """h, g and first_doc of the keys that hold more than one in parts of the lines; counted within tasks before the shuffle."""
    most = lines.count() // parts
    return lines.groupBy("h", "g").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where(F.col("n") > most).drop("n")


def keep_bitmaps(docs: DataFrame, least: int = 10, hot_parts: int = HOT_PARTS) -> DataFrame:
    """doc_id, doc_hash (xxhash64 of the text), n_lines, keep: runs of lines that stay. Documents that lose no line aren't listed."""
    lines = written(hashed_lines(docs, least))
    hot = written(hot_keys(lines, hot_parts))
    known = F.broadcast(hot.withColumn("is_hot", F.lit(True)))
    found = lines.join(known, ["h", "g"], "left")
    later = lambda df: df.where(F.col("first_doc").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first_doc"))).select("doc_id", "doc_hash", "n_lines", "pos")
    in_order = Window.partitionBy("h", "g").orderBy(F.col("doc_id").asc_nulls_last(), "pos")
    rest = found.where(F.col("is_hot").isNull()).drop("first_doc", "is_hot").repartitionByRange("h")
    streamed = rest.withColumn("first_doc", F.first("doc_id").over(in_order))
    gone = later(found.where(F.col("is_hot"))).unionByName(later(streamed))
    of_doc = gone.groupBy("doc_id", "doc_hash").agg(F.max("n_lines").alias("n_lines"), F.sort_array(F.collect_set("pos")).alias("gone"))
    between = F.zip_with(F.concat(F.array(F.lit(-1)), "gone"), F.concat("gone", F.array("n_lines")), lambda a, b: F.struct((a + 1).alias("first"), (b - a - 1).alias("n")))
    out = written(of_doc.select("doc_id", "doc_hash", "n_lines", F.filter(between, lambda run: run["n"] > 0).cast(KEEP).alias("keep")))
    dropped(lines, hot)
    return out


def kept_text(text, keep):
    """The lines of these runs, joined."""
    lines = lines_of(text)
    return F.array_join(F.flatten(F.transform(keep, lambda run: F.slice(lines, run["first"] + 1, run["n"]))), "\n")


def judged(docs: DataFrame, least: int) -> DataFrame:
    """All columns of docs as the struct doc, with keep, null where nothing goes."""
    bitmaps = keep_bitmaps(docs, least).select(F.col("doc_id").alias("of_id"), F.col("doc_hash").alias("of_hash"), "keep")
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"))
    return whole.join(bitmaps, F.col("doc.doc_id").eqNullSafe(F.col("of_id")) & (F.xxhash64("doc.text") == F.col("of_hash")), "left").select("doc", "keep")


def without_shared_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """The documents, with all their columns, without the lines that an earlier document holds."""
    text = F.when(F.col("keep").isNull(), F.col("doc.text")).otherwise(kept_text(F.col("doc.text"), F.col("keep")))
    return judged(docs, least).select(*(text.alias(c) if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns))


def op13_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.coalesce("doc.text", F.lit(""))
    n_lines = F.size(lines_of(text)).cast("long")
    n_kept = F.aggregate("keep", F.lit(0).cast("long"), lambda n, run: n + run["n"])
    kept = F.when(F.col("keep").isNull(), text).otherwise(kept_text(text, F.col("keep")))
    return judged(docs, 10).select("doc.doc_id", n_lines.alias("n_lines"), F.coalesce(n_lines - n_kept, F.lit(0).cast("long")).alias("n_dropped"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
    SELECT r, doc_id, i, lines[i] AS line, translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM (SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)
), shared AS (
    SELECT k, min(doc_id) AS first_doc FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1
), judged AS (
    SELECT r, l.doc_id, i, line, coalesce(first_doc <> l.doc_id, false) AS gone FROM l LEFT JOIN shared USING (k)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""
