"""Ranks, shortlists, top-k cascades, duplicates and matches of people across jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions.text import first_email, first_phone, norm_email, norm_phone


def with_ranks(scores: DataFrame) -> DataFrame:
    """Adds rank: 1, 2, ... per job over passed rows with a score, best first, then by id; null elsewhere."""
    fits = (F.col("hard_filter_pass") == 1) & F.col("final_score").isNotNull()
    best = Window.partitionBy("job_id", fits).orderBy(F.col("final_score").desc_nulls_last(), "resume_id")
    return scores.withColumn("rank", F.when(fits, F.row_number().over(best).cast("long")))


def shortlisted(size: int, least: float = 0.0, exclude_duplicates: bool = True, duplicate: Column | None = None) -> Column:
    repeated = F.lit(False) if duplicate is None else F.coalesce(duplicate, F.lit(False))
    allowed = ~repeated if exclude_duplicates else F.lit(True)
    return F.coalesce((F.col("hard_filter_pass") == 1) & allowed & (F.col("rank") <= size) & (F.coalesce("final_score", F.lit(0.0)) >= least), F.lit(False))


def below_least(least: float) -> Column:
    return (F.coalesce("final_score", F.lit(0.0)) < least) & F.lit(least > 0)


def cascade(scores: DataFrame, k: int, least: float, score: str = "ats_score") -> DataFrame:
    """Per job the first k rows with the least score or more; where there is none, the first k of all."""
    job = Window.partitionBy("job_id")
    marked = scores.withColumn("fits", F.coalesce(F.col(score) >= least, F.lit(False)))
    order = Window.partitionBy("job_id", "fits").orderBy(F.col(score).desc_nulls_last(), "resume_id")
    ranked = marked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return ranked.withColumn("any_fits", F.max("fits").over(job)).where(F.col("fits") == F.col("any_fits")).select("job_id", "resume_id", score, F.col("place").cast("long").alias("place"))


def contacts(resumes: DataFrame) -> DataFrame:
    """resume_id, job_id, email, phone; the texts are read once."""
    text = F.col("raw_text")
    return resumes.select("resume_id", "job_id", norm_email(first_email(text)).alias("email"), norm_phone(first_phone(text)).alias("phone"))


def duplicates_by(people: DataFrame, key: str) -> DataFrame:
    """Rows that share a key in a job, each with the group's primary (best score, then lowest id) and size."""
    group = Window.partitionBy("job_id", key)
    best = F.max_by("resume_id", F.struct(F.coalesce("final_score", F.lit(0.0)), -F.col("resume_id"))).over(group)
    found = people.where(F.col(key).isNotNull()).withColumn("primary_id", best).withColumn("group_size", F.count("*").over(group))
    return found.where("group_size > 1").select("job_id", "resume_id", "primary_id", "group_size", F.lit(key).alias("reason"))


def duplicates(people: DataFrame) -> DataFrame:
    """Evidence of both keys together; the phone's word on who is primary is the last."""
    both = duplicates_by(people, "email").unionByName(duplicates_by(people, "phone"))
    last = F.max_by(F.col("primary_id") == F.col("resume_id"), "reason")
    other = F.when(F.col("primary_id") != F.col("resume_id"), F.col("primary_id"))
    return both.groupBy("job_id", "resume_id").agg(F.array_join(F.sort_array(F.collect_set("reason")), "+").alias("reasons"), F.max(F.col("primary_id") != F.col("resume_id")).alias("is_duplicate"), last.alias("is_primary"), F.min(other).alias("duplicate_of"))


def prior_appearances(people: DataFrame, most: int = 8, scan_limit: int | None = None) -> DataFrame:
    """Pairs of rows of different jobs with the same e-mail or phone, at most `most` per row, newest job first.

    Of a key's rows only the newest `most` of each job, and of these the newest 2 * `most`, can come first for anyone: at most
    `most` of them are of one's own job. Rows meet these lists, not each other, so a key that many rows share makes no more pairs.
    """
    keys = F.array_compact(F.array(F.concat(F.lit("e"), "email"), F.concat(F.lit("p"), "phone")))

    def keyed(rows: DataFrame) -> DataFrame:
        """resume_id, job_id, keys: what a row, or rows of one id and job, can be found by."""
        once = rows.where("job_id IS NOT NULL").select("resume_id", "job_id", "email", "phone").distinct()
        found = once.groupBy("resume_id", "job_id").agg(F.array_distinct(F.flatten(F.collect_list(keys))).alias("keys"))
        return found.select("*", F.explode("keys").alias("key"))

    pool = people.orderBy(F.desc("resume_id")).limit(scan_limit) if scan_limit else people
    others = keyed(pool).select("key", F.col("job_id").alias("other_job"), F.col("resume_id").alias("other_id"), F.col("keys").alias("other_keys"))
    of_job = Window.partitionBy("key", "other_job").orderBy(F.desc("other_id"))
    newest = Window.partitionBy("key").orderBy(F.desc("other_job"), F.desc("other_id"))
    first = others.withColumn("n", F.row_number().over(of_job)).where(F.col("n") <= most).withColumn("n", F.row_number().over(newest)).where(F.col("n") <= 2 * most)
    lists = first.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("other_job", "other_id", "other_keys")), asc=False).alias("others"))

    def hit(x: Column) -> Column:
        by = lambda kind: F.exists("keys", lambda k: k.startswith(kind) & F.array_contains(x["other_keys"], k))
        return F.struct(x["other_job"].alias("other_job"), x["other_id"].alias("other_id"), F.col("job_id").alias("job_id"), by("e").alias("email"), by("p").alias("phone"))

    elsewhere = F.slice(F.filter("others", lambda x: x["other_job"] != F.col("job_id")), 1, most)
    hits = keyed(people).join(lists, "key").select("resume_id", F.transform(elsewhere, hit).alias("hits")).where(F.size("hits") > 0)
    best = hits.groupBy("resume_id").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("hits"))), asc=False), 1, most).alias("hits"))
    pairs = best.select("resume_id", F.posexplode("hits").alias("place", "x"))
    reasons = F.concat_ws("+", F.when(F.col("x.email"), "email"), F.when(F.col("x.phone"), "phone"))
    return pairs.select("resume_id", "x.job_id", "x.other_id", "x.other_job", reasons.alias("reasons"), (F.col("place") + 1).cast("long").alias("place"))
