"""Profiles of résumés by rules: contacts, name, place, years, education and notice, with how sure each is and where it comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.functions import person
from rankweave.functions import text as T
from rankweave.operators import names, profile
from rankweave.operators.layout import with_sections
from rankweave.operators.matching import education_lines, merged_by_rank, said, strip

#: Fixed value: a warning that users read.
NO_NAME_YET = "Name not found yet — will try LLM + email + filename after parse."


def _map(**values: Column) -> Column:
    """A map of the values that aren't null."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), v)]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def facts(resumes: DataFrame, as_of: int) -> DataFrame:
    """All columns but raw_text, with what the text alone says, each part of it cut once and read by those who need it. No shuffle."""
    cut = with_sections(resumes.withColumn("raw_text", F.coalesce("raw_text", F.lit(""))))
    body = F.map_from_entries("parts")
    top = F.array_join(F.slice(F.split("raw_text", "\n"), 1, 20), "\n")
    cut = cut.withColumn("_body", body)
    there = lambda s: F.coalesce(F.col("_body")[s], F.lit(""))
    cut = cut.withColumns({"_header": F.coalesce(said(there("header")), top), "_work": there("experience"), "_schools": F.coalesce(said(there("education")), F.col("raw_text")), "_skills": there("skills")})
    hits = F.transform(F.filter("parts", lambda p: ~p["section"].isin("full", "body") & (p["body"] != "")), lambda p: p["section"])
    header, full, work = F.col("_header"), F.col("raw_text"), F.col("_work")
    read = cut.withColumns(
        {
            "email": F.coalesce(T.first_email(header), T.first_email(full)),
            "phone": F.coalesce(T.first_phone(header), T.first_phone(full)),
            "linkedin": T.link(full, T.LINKEDIN),
            "github": T.link(full, T.GITHUB),
            "location": person.place_of(header, full),
            "notice": T.notice_days(full),
            "education": education_lines(F.col("_schools")),
            "stated_years": T.stated_years(full),
            "dated_years": F.when(work != "", T.range_years(work, as_of)),
            "date_ranges": T.date_ranges(work, as_of),
            "listed_skills": profile.distinct_words(profile.list_of(F.regexp_replace("_skills", r"\n", ","))),
            "student": profile.student(full),
            "section_hits": hits,
        }
    )
    read = read.withColumn("lines", names.lines_to_try(full, header, F.col("email")))
    return read.withColumn("years", F.coalesce("stated_years", "dated_years")).drop("raw_text", "parts", "_body", "_header", "_work", "_schools", "_skills")


def extracted(resumes: DataFrame, as_of: int, by: str = "resume_id") -> DataFrame:
    """facts() with name, confidence and sources (maps by field) and warnings. resumes: by, filename, raw_text and whatever else. No shuffle."""
    people = names.with_guess(facts(resumes, as_of)).withColumn("said", F.lit(None).cast("string"))
    both = names.with_name(people).withColumnRenamed("confidence", "sure").drop("lines", "mailed", "guess", "said", "score")
    given = lambda c, v: F.when(F.col(c).isNotNull(), v)
    schools = F.size("education") > 0
    sure = _map(
        name=F.when(F.col("name").isNotNull(), F.col("sure")).otherwise("low"),
        email=given("email", "high"),
        phone=given("phone", "high"),
        location=given("location", "medium"),
        total_years_experience=F.when(F.col("stated_years").isNotNull(), "high").when(F.col("dated_years").isNotNull(), "medium"),
        education=F.when(schools, "medium"),
        notice_period_days=given("notice", "high"),
    )
    sources = _map(
        name=F.when(F.col("name").isNotNull(), F.col("source")).otherwise("missing"),
        email=given("email", "regex"),
        phone=given("phone", "regex"),
        location=given("location", "heuristic"),
        total_years_experience=F.when(F.col("stated_years").isNotNull(), "regex").when(F.col("dated_years").isNotNull(), "date_range"),
        education=F.when(schools, "heuristic"),
        notice_period_days=given("notice", "regex"),
    )
    warnings = F.array_compact(F.array(F.col("warning"), F.when(F.col("name").isNull(), NO_NAME_YET)))
    return both.withColumns({"confidence": sure, "sources": sources, "warnings": warnings}).drop("source", "sure", "warning")


def scorable(found: DataFrame, quality: Column) -> DataFrame:
    """extracted() made fit for scoring without a model: bounds kept, years by the two passes without jobs, and an overall grade by the quality of the text."""
    clean = profile.sanitised(found.withColumn("skills", F.array().cast("array<string>")))
    none = lambda t: F.lit(None).cast(t)
    y = profile.two_pass_years(none("double"), none("string"), none("int"), none("double"), F.col("stated_years"), F.col("student"), none("double"))
    settled = clean.withColumn("_y", y)
    there = said(F.col("name")).isNotNull() | said(F.col("email")).isNotNull()
    overall = F.when(quality == "low", "low").when(there, "medium").otherwise("low")
    return settled.withColumns({"years": F.col("_y.years"), "years_method": F.col("_y.method"), "overall": overall}).drop("_y")


def merged(rule: DataFrame, model: DataFrame, jobs: DataFrame, year: int, month: int, by: str = "resume_id") -> DataFrame:
    """A profile by rules and a model's of the same rows, one row per rule profile.

    rule: what extracted() gives. model: by, name, email, phone, location, notice, linkedin, github, education, skills,
    licenses, certifications, summary. jobs: by, title, company, duration, years of the model's work history.
    Contacts are the rule's where it is sure, lists and summary the model's; of the places the model's, if plausible, comes
    first; the name is decided among all sources anew, and the years by the two passes over the jobs.
    """
    from_rule = {"filename": "filename", "name": "guess", "location": "r_place", "stated_years": "stated_years", "student": "student", "section_hits": "section_hits", "confidence": "r_sure", "warnings": "r_warnings"}
    from_model = {"name": "said", "location": "m_place", "summary": "m_summary"}
    # Each row is read once: what the name and the years need comes along with the merge.
    both = merged_by_rank(rule, model, by, *(F.col(f"r.{c}").alias(n) for c, n in from_rule.items()), *(F.col(f"m.{c}").alias(n) for c, n in from_model.items()))
    worked = profile.work_years(jobs, by, year, month).withColumnsRenamed({"years": "w_years", "method": "w_method"})
    out = names.with_name(both).withColumnRenamed("confidence", "sure").join(worked, by, "left")
    stated = F.when(F.col("r_sure")["total_years_experience"] == "high", F.col("stated_years"))
    student = F.coalesce(F.col("student"), F.lit(False)) | profile.student(F.col("m_summary"))
    y = profile.two_pass_years(F.col("w_years"), F.col("w_method"), F.col("jobs"), F.col("job_years"), stated, student, F.lit(None).cast("double"))
    by_model, by_rule = person.plausible_place(F.col("m_place")), person.plausible_place(F.col("r_place"))
    place = F.when(by_model, strip(F.col("m_place"))).when(by_rule, strip(F.col("r_place")))
    from_place = F.when(by_model, "llm").when(by_rule, "heuristic").otherwise("rejected_invalid")
    out = out.withColumn("_y", y)
    new_sources = F.create_map(F.lit("location"), from_place, F.lit("name"), F.col("source"), F.lit("total_years_experience"), F.col("_y.method"))
    new_sure = _map(location=F.when(by_model | by_rule, "medium"), name=F.col("sure"), total_years_experience=F.col("_y.confidence"))
    others = lambda c: F.map_filter(c, lambda k, _: ~k.isin("location", "name", "total_years_experience"))
    return out.select(
        by, "name", "email", "phone", place.alias("location"), "linkedin", "github", "notice", "education", "skills", "licenses", "certifications",
        F.col("m_summary").alias("summary"), F.col("_y.years").alias("years"), F.col("_y.method").alias("years_method"), "section_hits",
        F.map_concat(others(F.col("r_sure")), new_sure).alias("confidence"),
        F.map_concat(others(F.col("sources")), new_sources).alias("sources"),
        F.array_compact(F.concat("r_warnings", F.array("warning"))).alias("warnings"),
    )


#: Fields that can be corrected by hand, and their names in the maps of confidence and sources.
SCALARS = {"name": "name", "email": "email", "phone": "phone", "location": "location", "years": "total_years_experience", "notice": "notice_period_days", "summary": "summary"}
LISTS = ("skills", "certifications", "licenses")


def corrected(profiles: DataFrame, fixes: DataFrame, jobs: DataFrame, year: int, month: int, by: str = "resume_id") -> DataFrame:
    """Profiles with corrections by hand, the years decided again and all fields made good; overrides holds what was changed.

    profiles: by, the fields of SCALARS and LISTS, confidence and sources. fixes: by and fixes, a map from field to text (lists
    by commas); blank texts and numbers that can't be read change nothing. jobs: by, title, company, duration, years.
    A correction of the years wins; without one they come from the jobs, and a summary that reads like a student's counts.
    """
    asked = fixes.select(F.col(by).alias("_by"), F.col("fixes").alias("_fix"))
    worked = profile.work_years(jobs, by, year, month).select(F.col(by).alias("_job"), F.col("years").alias("_w"), F.col("method").alias("_m"), F.col("jobs").alias("_n"), F.col("job_years").alias("_own"))
    both = profiles.join(asked, profiles[by] == F.col("_by"), "left").join(worked, profiles[by] == F.col("_job"), "left")
    text = {f: said(strip(F.col("_fix")[f])) for f in SCALARS}
    number = {"years": text["years"].try_cast("double"), "notice": text["notice"].try_cast("double").cast("int")}
    bounded = {f: F.when(c.isNotNull(), F.greatest(F.lit(0).cast(t), F.least(F.lit(top).cast(t), c))) for (f, c), t, top in zip(number.items(), ("double", "int"), (50, 365), strict=True)}
    new = {f: bounded.get(f, text[f]) for f in SCALARS}
    lists = {f: F.when(F.col("_fix")[f].isNotNull(), profile.distinct_words(profile.list_of(F.col("_fix")[f]))) for f in LISTS}
    both = both.withColumns({f"_new_{f}": c for f, c in (new | lists).items()})
    changed = _map(**{SCALARS.get(f, f): F.when(F.col(f"_new_{f}").isNotNull(), F.array_join(F.col(f"_new_{f}"), ", ") if f in LISTS else F.col(f"_new_{f}").cast("string")) for f in (*SCALARS, *LISTS)})
    both = both.withColumns({f: F.coalesce(f"_new_{f}", f) for f in (*SCALARS, *LISTS)} | {"overrides": changed})
    y = profile.two_pass_years(F.col("_w"), F.col("_m"), F.col("_n"), F.col("_own"), F.lit(None).cast("double"), profile.student(F.col("summary")), F.col("_new_years"))
    both = both.withColumn("_y", y)
    over = lambda old, to, years: F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key("overrides", k) & (k != "total_years_experience")), F.map_filter(F.transform_values("overrides", lambda k, _: F.lit(to)), lambda k, _: k != "total_years_experience"), F.create_map(F.lit("total_years_experience"), years))
    done = both.withColumns({"years": F.col("_y.years"), "years_method": F.col("_y.method"), "confidence": over(F.col("confidence"), "high", F.col("_y.confidence")), "sources": over(F.col("sources"), "recruiter_override", F.col("_y.method"))})
    return profile.sanitised(done).drop("_by", "_job", "_fix", "_w", "_m", "_n", "_own", "_y", *(f"_new_{f}" for f in (*SCALARS, *LISTS)))
