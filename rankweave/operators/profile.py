"""Structured profiles of résumés: extraction, clean-up, checks, merges with a model's answer, and overrides by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.functions import text as T
from rankweave.functions.person import bound


def list_of(c: Column) -> Column:
    """A comma string as its trimmed, non-empty parts."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def distinct_words(items: Column) -> Column:
    """Without empty entries and case-insensitive repeats; the first spelling stays."""
    full = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False)))
    once = lambda full, low: F.filter(full, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)
    return bound(full, lambda full: bound(F.transform(full, F.lower), lambda low: once(full, low)))


def issues(p: dict[str, Column]) -> Column:
    """Names of what is wrong or missing in a profile."""
    checks = {
        "missing_name": F.coalesce(F.length(F.trim(p["name"])) == 0, F.lit(True)),
        "missing_contact": p["email"].isNull() & p["phone"].isNull(),
        "years_out_of_range": F.coalesce(~p["years"].between(0, 50), F.lit(False)),
        "no_skills": F.coalesce(F.size(p["skills"]) == 0, F.lit(True)),
        "long_notice": F.coalesce(p["notice"] > 365, F.lit(False)),
    }
    return F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in checks.items())), lambda x: x.isNotNull())


def sanitised(p: DataFrame) -> DataFrame:
    """Types, bounds and lengths of every field made good."""
    digits = F.length(F.regexp_replace(F.coalesce("phone", F.lit("")), "[^0-9]", ""))
    return p.withColumns(
        {
            "name": F.left(F.trim("name"), F.lit(120)),
            "email": F.lower(F.trim("email")),
            "phone": F.when(digits >= 10, F.trim("phone")),
            "years": F.when(F.col("years").isNotNull(), F.floor(F.greatest(F.lit(0.0), F.least(F.lit(50.0), "years")) * 10 + 0.5) / 10),
            "notice": F.when(F.col("notice").isNotNull(), F.greatest(F.lit(0), F.least(F.lit(365), "notice"))),
            "skills": distinct_words(F.col("skills")),
        }
    )


# How years were found, where that is beyond doubt.
SURE_METHODS = ["work_history_sum", "work_history_span", "explicit_phrase", "recruiter_override", "student_no_jobs", "no_real_jobs"]


def two_pass_years(computed: Column, method: Column, jobs: Column, job_years: Column, stated: Column, student: Column, override: Column) -> Column:
    """struct(years, method, confidence) from what work_years() gives, the number of real jobs and their years, stated years and signs of a student.

    A correction by hand wins. A student without jobs has none. Stated years near the computed ones are averaged with them,
    lower ones replace them. A student's years beyond 2 are cut to those of the jobs unless these, or what is stated, are more.
    """
    n, own = F.coalesce(jobs, F.lit(0)), F.coalesce(job_years, F.lit(0.0))
    pair = lambda v, m: F.struct(v.cast("double").alias("years"), m.alias("method"))
    worked = computed.isNotNull() & F.coalesce(method != "none", F.lit(False))
    found = (
        F.when(student & (n == 0), pair(F.lit(0.0), F.lit("student_no_jobs")))
        .when(worked & (stated > 0) & (F.abs(stated - computed) <= 2), pair(F.bround(computed * 0.5 + stated * 0.5, 1), F.concat(method, F.lit("+explicit"))))
        .when(worked & (stated > 0) & (stated < computed), pair(stated, F.lit("explicit_phrase")))
        .when(worked, pair(computed, method))
        .when(stated.isNotNull(), pair(stated, F.lit("explicit_phrase")))
        .otherwise(pair(F.lit(0.0), F.lit("no_real_jobs")))
    )
    capped = student & ~F.coalesce(stated > 2, F.lit(False)) & (own <= 1.5)
    bounds = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(50.0), v))

    def settled(x: Column) -> Column:
        cut = F.when(capped & (x["years"] > 2), pair(F.least(x["years"], own), F.lit("student_capped"))).otherwise(x)
        return F.when(override.isNotNull(), pair(bounds(override), F.lit("recruiter_override"))).otherwise(cut)

    def told(x: Column) -> Column:
        sure = F.when(x["method"].isin(SURE_METHODS) | x["method"].endswith("+explicit"), "high").otherwise("medium")
        years = F.when(x["method"] == "recruiter_override", x["years"]).otherwise(bounds(F.bround(x["years"], 1)))
        return F.struct(years.alias("years"), x["method"].alias("method"), sure.alias("confidence"))

    return bound(bound(found, settled), told)


# Signs of a student, of stated experience, and of entries that are no jobs.
STUDENT = ["student", "undergrad", "undergraduate", "graduating", "pursuing", "cgpa", "gpa", "batch of", "expected graduation", "fresher", "final year", "pre-final"]
EXPERIENCED = ["years of experience", "years experience", "yrs of experience", "professional experience of"]
NO_TITLE = ["", "-", "n/a", "na", "none", "null", ".", "—", "–"]
SCHOOLING = ["bachelor", "master", "b.tech", "btech", "m.tech", "university", "institute of", "high school", "class xii", "class 12"]


def _any_of(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def student(text: Column) -> Column:
    """Whether a text reads like a student's or a beginner's, without a claim of experience."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return _any_of(low, STUDENT) & ~_any_of(low, EXPERIENCED)


def real_job(title: Column, company: Column) -> Column:
    """Whether an entry looks like employment: a title or a company that says something, and no schooling."""
    t, c = (F.lower(F.trim(F.coalesce(x, F.lit("")))) for x in (title, company))
    return ~(t.isin(NO_TITLE) & c.isin(NO_TITLE)) & ~_any_of(F.concat_ws(" ", t, c), SCHOOLING)


def work_years(jobs: DataFrame, key: str, year: int, month: int) -> DataFrame:
    """jobs (key, title, company, duration, years) to key, years, method, jobs, job_years: the sum over real jobs, or their span where they overlap a lot.

    A job's years are those of its duration, else the given ones. Without a real job the years are null. jobs and job_years are
    the number of real jobs and the plain sum of their years.
    """
    real = F.coalesce(real_job(F.col("title"), F.col("company")), F.lit(False))
    own = F.greatest(F.lit(0.0), F.coalesce(T.duration_years(F.col("duration"), year, month), F.col("years"), F.lit(0.0)))
    start, stop = (F.regexp_extract("duration", T.DATE_RANGE, k) for k in (1, 2))
    first = start.try_cast("int")
    last = F.when(stop != "", F.least(F.coalesce(stop.try_cast("int"), F.lit(year)), F.lit(year)))
    bounded = (first >= 1970) & (first <= year) & (last >= first)
    each = jobs.select(key, real.alias("real"), own.alias("own"), F.when(bounded, first).alias("first"), F.when(bounded, last).alias("last")).withColumn("counted", F.col("real"))
    sums = each.groupBy(key).agg(F.count_if("counted").alias("n"), F.sum(F.when(F.col("counted"), F.col("own")).otherwise(0.0)).alias("total"), F.min(F.when(F.col("counted"), F.col("first"))).alias("first"), F.max(F.when(F.col("counted"), F.col("last"))).alias("last"))
    span = (F.col("last") - F.col("first")).cast("double")
    one = lambda x: F.bround(F.least(x, F.lit(50.0)), 1)
    pair = lambda v, m: F.struct(v.cast("double").alias("years"), F.lit(m).alias("method"))
    found = (
        F.when(F.col("n") == 0, pair(F.lit(None), "none"))
        .when((F.col("total") > 0) & (span > 0) & (F.col("total") > span * 1.25), pair(one(span), "work_history_span"))
        .when((F.col("total") > 0) & (span > 0), pair(one(F.least("total", span)), "work_history_sum"))
        .when(F.col("total") > 0, pair(one(F.col("total")), "work_history_sum"))
        .when(span > 0, pair(one(span), "work_history_span"))
        .otherwise(pair(F.lit(0.0), "no_countable_jobs"))
    )
    return sums.select(key, found.alias("f"), F.col("n").alias("jobs"), F.col("total").alias("job_years")).select(key, "f.years", "f.method", "jobs", "job_years")


def job_entries(jobs: DataFrame, year: int, month: int) -> DataFrame:
    """jobs (title, company, duration, years) with each entry's own years, 0 for what is no job, and counted: whether it is one."""
    real = F.coalesce(real_job(F.col("title"), F.col("company")), F.lit(False))
    own = F.greatest(F.lit(0.0), F.coalesce(T.duration_years(F.col("duration"), year, month), F.col("years"), F.lit(0.0)))
    return jobs.withColumns({"counted": real, "years": F.when(real, own).otherwise(0.0)})


def merged(rule: DataFrame, model: DataFrame) -> DataFrame:
    """Rule-based and model profiles of the same rows: contacts and notice by rule first, skills and education by model first."""
    m = model.select("resume_id", *(F.col(c).alias("m_" + c) for c in model.columns if c not in ("resume_id", "job_id")))
    both = rule.join(m, "resume_id", "left")
    first = {c: F.coalesce(c, "m_" + c) for c in ("email", "phone", "notice", "years")}
    last = {c: F.coalesce("m_" + c, c) for c in ("name", "location")}
    lists = {c: F.when(F.size("m_" + c) > 0, F.col("m_" + c)).otherwise(F.col(c)) for c in ("skills", "education")}
    return both.withColumns(first | last | lists).drop(*("m_" + c for c in model.columns))


def overridden(p: DataFrame, overrides: DataFrame) -> DataFrame:
    """Corrections by hand (resume_id, years, notice, skills as a comma string) over a profile, with the list of changed fields."""
    o = overrides.select("resume_id", *(F.col(c).alias("o_" + c) for c in ("years", "notice", "skills")))
    both = p.join(o, "resume_id", "left")
    changed = F.filter(F.array(*(F.when(F.col("o_" + c).isNotNull(), F.lit(c)) for c in ("notice", "skills", "years"))), lambda x: x.isNotNull())
    new = {"years": F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(50.0), "o_years")), "years"), "notice": F.coalesce("o_notice", "notice"), "skills": F.when(F.col("o_skills").isNotNull(), distinct_words(list_of(F.col("o_skills")))).otherwise(F.col("skills"))}
    # least and greatest skip nulls: a missing correction must stay missing.
    new["years"] = F.when(F.col("o_years").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(50.0), "o_years"))).otherwise(F.col("years"))
    return both.withColumns({"overrides": changed} | new).drop("o_years", "o_notice", "o_skills")
