"""Scores of documents against a brief: keyword coverage, embedding similarity and their blend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.functions.text import tokens

#: Weights of keyword, embedding and model scores.
WEIGHTS = (0.2, 0.3, 0.5)


def rounded(x: Column, digits: int = 2) -> Column:
    return F.floor(x * 10**digits + 0.5) / float(10**digits)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision, clamped; 0 for empty, unequal or zero vectors; negatives become (c + 1) / 2."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    x, y = a.cast("array<double>"), b.cast("array<double>")
    norms = F.sqrt(total(F.transform(x, lambda v: v * v))) * F.sqrt(total(F.transform(y, lambda v: v * v)))
    c = total(F.zip_with(x, y, lambda p, q: p * q)) / F.nullif(norms, F.lit(0.0))
    c = F.coalesce(F.when(F.size(x) == F.size(y), c), F.lit(0.0))
    c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))
    return F.when(c < 0, rounded((c + 1) / 2, 4)).otherwise(rounded(c, 4))


def similarity_to(vectors: DataFrame, vec_id: int) -> DataFrame:
    """(vec_id, label, sim) of every vector against one of them, a literal of the plan."""
    found = vectors.where(F.col("vec_id") == vec_id).select("embedding").first()
    query = F.array(*(F.lit(float(v)) for v in (found.embedding if found else [])))
    return vectors.select("vec_id", "label", cosine(F.col("embedding"), query).alias("sim"))


def blend(ats: Column, similarity: Column, llm: Column, weights: tuple[float, float, float] = WEIGHTS) -> Column:
    """Weighted mean of the components that are present, 0 to 100."""
    parts = list(zip((ats, similarity * 100, llm * 10), weights, strict=True))
    top = sum((F.coalesce(F.lit(w) * x, F.lit(0.0)) for x, w in parts), F.lit(0.0))
    share = sum((F.when(x.isNotNull(), F.lit(w)).otherwise(0.0) for x, w in parts), F.lit(0.0))
    return rounded(F.greatest(F.lit(0.0), F.least(F.lit(100.0), top / F.nullif(share, F.lit(0.0)))))


def normal_weights(a: Column, e: Column, m: Column) -> list[Column]:
    """Weights divided by their sum; the usual ones where any is no number or the sum isn't positive."""
    parts = [x.try_cast("double") for x in (a, e, m)]
    total = parts[0] + parts[1] + parts[2]
    return [F.when(total > 0, rounded(x / F.nullif(total, F.lit(0.0)), 6)).otherwise(F.lit(w)) for x, w in zip(parts, WEIGHTS, strict=True)]


def keyword_scores(docs: DataFrame, briefs: DataFrame, on: str | None = None) -> DataFrame:
    """docs (doc, text) and briefs (brief, prompt) to (brief, doc, hits, ats) of pairs with a shared token.

    60 % is the share of the brief's distinct tokens that the document has, 40 % the same weighted by 1 + ln(1 + frequency).
    Both sides become token rows that meet in one equi-join, so no pair without a common token is ever made.
    """
    keep = [on] if on else []
    words = briefs.select("brief", *keep, F.explode(tokens(F.col("prompt"))).alias("token"))
    words = words.groupBy("brief", *keep, "token").agg(F.count("*").alias("tf")).withColumn("weight", 1 + F.log(1.0 + F.col("tf")))
    whole = words.groupBy("brief").agg(F.count("*").alias("n_tokens"), F.sum("weight").alias("all_weight"))
    held = docs.select("doc", *keep, F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    hit = held.join(words, [*keep, "token"]).groupBy("brief", "doc").agg(F.count("*").alias("hits"), F.sum("weight").alias("weight"))
    ats = rounded(60.0 * F.col("hits") / F.col("n_tokens") + 40.0 * F.col("weight") / F.col("all_weight"))
    return hit.join(whole, "brief").select("brief", "doc", "hits", ats.alias("ats"))
