"""Operator 4: token counts by a map-side two-tier lookup.

Tier one is a broadcast table of frequent words and their token lengths, tier two each worker's cache; only a word
that neither knows is encoded. Documents stay where they were read: there is no shuffle.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted row by row; an empty table
gives an empty result; a null key stays null; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.tokens import MAX_KEY, VOCABULARY, Words, word_encoder

#: Rows whose words fill the broadcast table, and its entries: at most 16,384 words of 48 characters, under 2 MB.
#: The table only saves work; no result depends on it.
SAMPLE_DOCS, TABLE_SIZE = 300, 16_384


def frequent_words(texts: DataFrame, sample_docs: int = SAMPLE_DOCS, table_size: int = TABLE_SIZE) -> list[str]:
    """The commonest space-delimited words of the first sample_docs rows; only as many partitions are read as hold them."""
    words: Counter = Counter()
    for row in texts.where(F.col("text").isNotNull()).take(sample_docs):
        words.update(x for x in row.text.split(" ")[1:] if 0 < len(x) <= MAX_KEY)
    return [w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:table_size]]


def lengths_of(words: list[str], vocabulary: str) -> dict[str, int]:
    """word -> number of its tokens after a space."""
    encode = word_encoder(vocabulary)
    return {w: len(encode(" " + w)) for w in words}


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, limit: int = 512, sample_docs: int = SAMPLE_DOCS, table_size: int = TABLE_SIZE) -> DataFrame:
    """One row per document: key, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    texts = docs.select(F.col(key), F.col(text).alias("text"))
    known = docs.sparkSession.sparkContext.broadcast(lengths_of(frequent_words(texts.select("text"), sample_docs, table_size), vocabulary))

    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = Words(vocabulary, len, known.value)
        for batch in batches:
            yield pd.Series([sum(words.values_of(x or "")) for x in batch], dtype="int64")

    n_tokens = F.pandas_udf(lengths, "long")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    counted = texts.select(F.col(key), n_bytes.alias("n_bytes"), n_tokens(F.col("text")).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
