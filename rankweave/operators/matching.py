"""What scores and readers see of a profile, bounds of a job's settings, and which texts and profiles need more work.

A profile is a dict of columns: name, summary, location, years, skills, licenses, certifications (lists of strings),
jobs (list of title, company, duration) and education (list of degree, field, institution, year).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.functions.person import bound
from rankweave.operators.profile import distinct_words

# Degrees in the order in which a line is tried, and words of an institution.
DEGREES = {
    "B.Tech": r"(?i)\b(?:B\.?Tech|BTech|Bachelor of Technology)\b",
    "B.E.": r"(?i)\b(?:B\.?E\.?|Bachelor of Engineering)\b",
    "B.S.": r"(?i)\b(?:B\.?S\.?|B\.?Sc\.?|Bachelor of Science)\b",
    "B.A.": r"(?i)\b(?:B\.?A\.?|Bachelor of Arts)\b",
    "M.Tech": r"(?i)\b(?:M\.?Tech|MTech|Master of Technology)\b",
    "M.S.": r"(?i)\b(?:M\.?S\.?|M\.?Sc\.?|Master of Science)\b",
    "MBA": r"(?i)\b(?:M\.?B\.?A\.?|Master of Business Administration)\b",
    "MCA": r"(?i)\b(?:M\.?C\.?A\.?)\b",
    "Ph.D.": r"(?i)\b(?:Ph\.?D\.?|Doctor of Philosophy)\b",
    "B.Com": r"(?i)\b(?:B\.?Com|Bachelor of Commerce)\b",
}
INSTITUTION = r"(?i)\b(?:University|College|Institute|IIT|NIT|IIIT|MIT|Stanford|Berkeley|Harvard|Oxford|Cambridge|BITS|VIT|SRM|Amity)\b"
STUDY_FIELD = r"(?i)(?:in|of)\s+([A-Za-z &/]{3,40})(?:\s+from|\s+at|,|$)"

#: Characters of a résumé that scores read, of a compact profile, and the least a text must have.
MATCH_CHARS, PROFILE_CHARS, LEAST_CHARS = 6000, 2500, 40


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def said(c: Column) -> Column:
    """A text, or null if it is empty."""
    return F.nullif(c, F.lit(""))


def each(items: Column, f) -> Column:
    """f of every item as a list of texts; no list, no texts."""
    return F.coalesce(F.transform(items, f), F.array().cast("array<string>"))


def brief_text(prompt: Column, description: Column) -> Column:
    """What a job is ranked by: its prompt, else its description."""
    return F.coalesce(said(strip(prompt)), said(strip(description)), F.lit(""))


def match_text(p: dict[str, Column], raw_text: Column) -> Column:
    """The lines that keyword and vector scores read, ending in the first 6,000 characters of the raw text."""

    def listed(label: str, items: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(label + ": "), F.array_join(items, ", ")))

    def line(*names: str):
        return lambda x: F.concat_ws(" ", *(F.coalesce(x[n], F.lit("")) for n in names))

    lists = [listed(k.capitalize(), p[k]) for k in ("skills", "licenses", "certifications")]
    where = F.concat(F.lit("Location: "), said(p["location"]))
    lines = F.concat(
        F.array(said(p["summary"]), *lists),
        each(p["jobs"], line("title", "company", "duration")),
        each(p["education"], line("degree", "field", "institution")),
        F.array(where, F.left(said(raw_text), F.lit(MATCH_CHARS))),
    )
    return F.array_join(lines, "\n")


def compact_profile(p: dict[str, Column]) -> Column:
    """The public fields as JSON of at most 2,500 characters, with the six latest jobs."""
    fields = {
        "name": p["name"],
        "location": p["location"],
        "total_years_experience": p["years"],
        "skills": p["skills"],
        "education": p["education"],
        "work_history": F.slice(p["jobs"], 1, 6),
        "licenses": p["licenses"],
        "certifications": p["certifications"],
        "summary": p["summary"],
    }
    json = F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())), {"ignoreNullFields": "false"})
    return F.left(json, F.lit(PROFILE_CHARS))


def least_score(value: Column) -> Column:
    """The score that a shortlist asks for, 0 to 100; 0 where it is missing or no number."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(value.try_cast("double"), F.lit(0.0))))


def shortlist_size(value: Column) -> Column:
    """Rows of a shortlist, 1 to 500; 5 where it is missing, zero or no number."""
    n = F.coalesce(F.nullif(value.try_cast("double"), F.lit(0.0)), F.lit(5.0))
    return F.floor(F.greatest(F.lit(1.0), F.least(F.lit(500.0), n))).cast("int")


def model_score(value: Column) -> Column:
    """A model's score, 1 to 10; 5 where it gives none."""
    return F.greatest(F.lit(1.0), F.least(F.lit(10.0), F.coalesce(value.try_cast("double"), F.lit(5.0))))


def bulk_mode(total: Column, enabled: Column, full_below: Column, top_k: Column, least: Column) -> Column:
    """struct: whether only the best of a job go to the model, how many and from which score on. Missing settings take defaults."""
    below = F.greatest(F.lit(0), F.coalesce(full_below, F.lit(0)))
    limited = F.coalesce(enabled, F.lit(True)) & ((below <= 0) | (total >= below))
    return F.struct(
        limited.alias("enabled"),
        F.greatest(F.lit(1), F.coalesce(top_k, F.lit(20))).alias("llm_top_k"),
        F.coalesce(least, F.lit(30.0)).alias("min_pre_score"),
        below.alias("always_full_below"),
    )


def text_gate(text: Column) -> Column:
    """struct(failed, stage, reason): texts of fewer than 40 characters, blanks at the ends aside, go no further."""
    failed = F.length(strip(F.coalesce(text, F.lit("")))) < LEAST_CHARS
    return F.struct(failed.alias("failed"), F.when(failed, "failed_text").alias("stage"), F.when(failed, "Insufficient text extracted").alias("reason"))


def needs_enrichment(skills: Column, jobs: Column, enriched: Column, rules_only: Column, model_used: Column) -> Column:
    """Whether a profile should be read by the model again: rules alone made it, or no job and at most one skill is in it."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    thin = (n(jobs) <= 0) & (n(skills) < 2)
    return ~F.coalesce(enriched, F.lit(False)) & ((F.coalesce(rules_only, F.lit(False)) & ~F.coalesce(model_used, F.lit(False))) | thin)


def education_strings(education: Column, summary: Column) -> Column:
    """Every text in which a rule on education may find its needle: whole lines, their parts, and the summary."""
    part = lambda e, n: F.coalesce(e[n], F.lit(""))
    whole = lambda e: said(strip(F.concat_ws(" ", *(part(e, n) for n in ("degree", "field", "institution", "year")))))
    lines = F.transform(education, lambda e: F.array(whole(e), *(said(e[n]) for n in ("degree", "field", "institution"))))
    return F.array_compact(F.concat(F.coalesce(F.flatten(lines), F.array().cast("array<string>")), F.array(said(summary))))


def education_lines(text: Column) -> Column:
    """List of struct(degree, field, institution, year) of the first 40 lines that name a degree or an institution; eight distinct ones at most."""
    lines = F.slice(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip), lambda x: x != ""), 1, 40)

    def degree(line: Column) -> Column:
        out = F.lit("")
        for label, pattern in reversed(DEGREES.items()):
            out = F.when(line.rlike(pattern), label).otherwise(out)
        return out

    def entry(line: Column) -> Column:
        at = F.regexp_instr(line, F.lit(INSTITUTION))
        first = F.greatest(F.lit(1), at - 20)
        last = at + F.length(F.regexp_substr(line, F.lit(INSTITUTION))) + 40
        around = F.regexp_replace(F.substr(line, first, last - first), r"^[ ,\-|]+|[ ,\-|]+$", "")
        return F.struct(
            degree(line).alias("degree"),
            strip(F.regexp_extract(line, STUDY_FIELD, 1)).alias("field"),
            F.coalesce(F.when(at > 0, said(around)), F.left(line, F.lit(80))).alias("institution"),
            said(F.regexp_extract(line, r"\b((?:19|20)\d{2})\b", 1)).alias("year"),
        )

    found = F.transform(F.filter(lines, lambda x: (degree(x) != "") | x.rlike(INSTITUTION)), entry)
    key = lambda e: F.struct(e["degree"], e["year"], e["institution"])
    first = lambda found: F.filter(found, lambda e, i: F.array_position(F.transform(found, key), key(e)) == i + 1)
    return F.slice(bound(found, first), 1, 8)


def json_object(answer: Column) -> Column:
    """The JSON object in a model's answer as a variant: what a fence holds, else the text from its first to its last brace; null without one."""
    text = strip(answer)
    fence = r"```(?:json)?\s*([\s\S]*?)```"
    body = F.when(text.rlike(fence), strip(F.regexp_extract(text, fence, 1))).otherwise(text)
    objects = lambda c: F.when(c.startswith("{"), F.try_parse_json(c))
    return F.coalesce(objects(body), objects(F.regexp_substr(body, F.lit(r"\{[\s\S]*\}"))))


def merged_by_rank(rule: DataFrame, model: DataFrame, key: str, *more: Column) -> DataFrame:
    """One row per rule profile: contacts by rule where that is at least medium sure, notice and links by rule, lists by the model.

    rule: key, email, phone, notice, linkedin, github, education, confidence and sources (maps by field).
    model: key, email, phone, notice, linkedin, github, education, skills, licenses, certifications.
    more: what else is to be given, of r (rule) and m (model).
    """
    both = rule.alias("r").join(model.alias("m"), key, "left")
    r, m = (lambda c: F.col(f"r.{c}")), (lambda c: F.col(f"m.{c}"))
    sure = {c: said(r(c)).isNotNull() & F.coalesce(r("confidence")[c].isin("medium", "high"), F.lit(False)) for c in ("email", "phone")}
    items = lambda c, n: F.coalesce(F.slice(F.filter(F.transform(m(c), strip), lambda x: x != ""), 1, n), F.array().cast("array<string>"))
    lists = {"skills": items("skills", 60), "licenses": items("licenses", 40), "certifications": items("certifications", 40)}
    new = F.create_map(*(x for c in sure for x in (F.lit(c), F.when(sure[c], F.coalesce(r("sources")[c], F.lit("hybrid"))).otherwise(r("sources")[c]))), *(x for c in lists for x in (F.lit(c), F.lit("llm"))))
    old = F.map_filter(r("sources"), lambda k, _: ~k.isin(*sure, *lists))
    return both.select(
        key,
        *(F.when(sure[c], r(c)).otherwise(m(c)).alias(c) for c in sure),
        F.coalesce(r("notice"), m("notice")).alias("notice"),
        *(F.coalesce(said(r(c)), m(c)).alias(c) for c in ("linkedin", "github")),
        F.when(F.coalesce(F.size(m("education")), F.lit(0)) > 0, m("education")).otherwise(r("education")).alias("education"),
        *(c.alias(k) for k, c in lists.items()),
        F.map_concat(F.coalesce(old, F.create_map().cast("map<string,string>")), F.map_filter(new, lambda _, v: v.isNotNull())).alias("sources"),
        *more,
    )


def extraction_grade(sure: Column, quality: Column, model_used: Column, issues: Column, name: Column, name_fits: Column, location: Column, location_fits: Column) -> Column:
    """struct(overall, warnings, confidence): how far a profile can be trusted, and why not.

    sure is a map from field to high, medium or low; name_fits and location_fits say whether those values are plausible.
    """
    given = F.coalesce(sure, F.create_map().cast("map<string,string>"))
    issues = F.coalesce(issues, F.array().cast("array<string>"))
    quality = F.coalesce(quality, F.lit("medium"))
    no_name, bad_name = said(name).isNull(), ~name_fits
    bad_place = said(location).isNotNull() & ~location_fits
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    warnings = F.array_compact(
        F.concat(
            F.array(
                F.when(no_name, "Name missing or rejected — verify candidate identity from the file name or resume.").when(bad_name, F.concat(F.lit("Name looks unreliable ("), quoted(name), F.lit(") — may be a section header or skills line."))),
                F.when(bad_place, F.concat(F.lit("Location looks unreliable ("), quoted(location), F.lit(") — may be skills/tools misread."))),
                F.when(given["total_years_experience"] == "low", "Years of experience is low-confidence — verify manually."),
            ),
            F.transform(F.slice(issues, 1, 5), lambda x: F.concat(F.lit("Validation: "), x)),
        )
    )
    high = F.size(F.filter(F.map_values(given), lambda v: v == "high"))
    grade = F.when(~model_used | (quality == "low") | (F.size(issues) > 2), "low").when((high >= 3) & (quality == "high"), "high").otherwise("medium")
    overall = F.when(F.exists(warnings, lambda w: w.contains("unreliable") | w.contains("missing")), "low").otherwise(grade)
    lowered = F.map_filter(F.create_map(F.lit("name"), no_name | bad_name, F.lit("location"), bad_place), lambda _, v: v)
    kept = F.map_filter(given, lambda k, _: ~F.array_contains(F.map_keys(lowered), k))
    return F.struct(overall.alias("overall"), warnings.alias("warnings"), F.map_concat(kept, F.transform_values(lowered, lambda k, v: F.lit("low"))).alias("confidence"))


def section_hits(sections: DataFrame, key: str) -> DataFrame:
    """sections (key, section, body) to key, hits: names of the sections that hold text, in a fixed order."""
    order = ["summary", "experience", "education", "skills", "certifications"]
    has = [F.bool_or((F.col("section") == s) & (F.length(strip(F.col("body"))) > 0)).alias(s) for s in order]
    return sections.groupBy(key).agg(*has).select(key, F.array_compact(F.array(*(F.when(F.col(s), s) for s in order))).alias("hits"))


def shown_duration(seconds: Column) -> Column:
    """Seconds as 45s, 3m 20s or 2h 5m; a dash where there are none."""
    s = F.floor(seconds + 0.5)
    m, h = F.floor(s / 60), F.floor(s / 3600)
    two = lambda a, x, b, y: F.when(b > 0, F.concat(a.cast("string"), F.lit(x + " "), b.cast("string"), F.lit(y))).otherwise(F.concat(a.cast("string"), F.lit(x)))
    return F.when(seconds.isNull() | (seconds < 0) | F.isnan(seconds), "—").when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(m < 60, two(m, "m", s % 60, "s")).otherwise(two(h, "h", m % 60, "m"))


def shown_list(items: Column, limit: int = 20) -> Column:
    """The first items by commas and how many more there are; a dash for none."""
    full = F.filter(F.transform(items, strip), lambda x: x != "")
    n = F.size(full)
    head = F.array_join(F.slice(full, 1, limit), ", ")
    return F.when(items.isNull() | (n == 0), "—").when(n > limit, F.concat(head, F.lit(" (+"), (n - limit).cast("string"), F.lit(" more)"))).otherwise(head)


def shown_education(education: Column) -> Column:
    """Distinct lines "degree · field · institution (year)" by semicolons; a dash for none."""

    def line(e: Column) -> Column:
        words = F.concat_ws(" · ", *(said(strip(e[n])) for n in ("degree", "field", "institution")))
        year = F.when(~F.lower(e["year"]).isin("", "null"), F.concat(F.lit(" ("), e["year"], F.lit(")")))
        return F.when(words != "", F.concat(words, F.coalesce(year, F.lit(""))))

    return F.coalesce(said(F.array_join(F.array_distinct(F.array_compact(F.transform(education, line))), "; ")), F.lit("—"))


def shown_warnings(warnings: Column, sure: Column, name: Column) -> Column:
    """A profile's warnings, and those that follow from unsure fields and are not among them yet."""
    given = F.coalesce(warnings, F.array().cast("array<string>"))
    none = lambda word: ~F.exists(given, lambda w: w.contains(word))
    # A warning about the name that is added here has no bearing on the one about the location.
    more = F.array(
        F.when((sure["name"] == "low") & none("Name"), "Name is low-confidence — verify identity."),
        F.when((sure["location"] == "low") & none("Location"), "Location is low-confidence or was cleared."),
        F.when(said(name).isNull(), "No reliable name extracted — check resume file name."),
    )
    return F.array_compact(F.concat(given, more))


def job_lines(jobs: Column) -> Column:
    """The first eight jobs as "title @ company (duration)"."""

    def line(x: Column) -> Column:
        title, company, duration = (said(strip(x[n])) for n in ("title", "company", "duration"))
        what = said(F.concat_ws(" @ ", title, company))
        return F.when(duration.isNull(), what).when(what.isNull(), duration).otherwise(F.concat(what, F.lit(" ("), duration, F.lit(")")))

    return F.array_compact(each(F.slice(jobs, 1, 8), line))


def rich_row(p: dict[str, Column]) -> dict[str, Column]:
    """The list fields of an export row, cut to what readers need."""
    return {"skills": F.slice(distinct_words(p["skills"]), 1, 30), "work_lines": job_lines(p["jobs"]), "summary": said(F.left(p["summary"], F.lit(500)))}


def rule_fields(p: dict[str, Column]) -> dict[str, Column]:
    """What a hard filter on a field searches: certifications with licences, licences with both and all of education, skills with the summary."""
    none = F.array().cast("array<string>")
    listed = lambda c: F.coalesce(p[c], none)
    school, summary = education_strings(p["education"], p["summary"]), F.array_compact(F.array(said(p["summary"])))
    one = lambda c: F.array_compact(F.array(said(p[c])))
    return {
        "years": p["years"],
        "notice": p["notice"],
        "location": one("location"),
        "certifications": F.concat(listed("certifications"), listed("licenses")),
        "licenses": F.concat(listed("licenses"), listed("certifications"), school),
        "skills": F.concat(listed("skills"), summary),
        "education": school,
        **{c: one(c) for c in ("name", "email", "phone", "summary") if c in p},
    }


def decoded_json(text: Column, schema: str, default: Column | None = None) -> Column:
    """A stored JSON text as a value; the default, null if none is given, where it is missing or can't be read."""
    kept = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    good = F.try_parse_json(text).isNotNull()
    return F.coalesce(F.when(good, kept), F.lit(None) if default is None else default)


def public_part(profile: Column) -> Column:
    """A profile, a map from field to value, without the fields that begin with an underscore."""
    return F.map_filter(profile, lambda k, _: ~k.startswith("_"))


def quality_signals(text: Column, parts: Column, phone: Column, email: Column) -> Column:
    """struct of what tells whether a text was read well: characters, sections found, contacts, short lines among the first 40, mean length of the first 50, lines.

    parts: the sections of with_sections(); phone and email: those of the first 2,500 characters, a limit of the feature.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip), lambda x: x != "")
    n = F.size(lines)
    short = F.size(F.filter(F.slice(lines, 1, 40), lambda x: F.length(x) < 12))
    total = F.aggregate(F.slice(lines, 1, 50), F.lit(0), lambda s, x: s + F.length(x))
    hits = F.filter(F.transform(parts, lambda p: F.when(p["body"] != "", p["section"])), lambda s: ~s.isin("header", "body", "full"))
    return F.struct(
        F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "")).cast("long").alias("chars"),
        F.size(hits).cast("long").alias("section_count"),
        email.isNotNull().alias("has_email"),
        phone.isNotNull().alias("has_phone"),
        (short / F.greatest(F.least(n, F.lit(40)), F.lit(1))).alias("short_line_ratio"),
        (total / F.greatest(F.least(n, F.lit(50)), F.lit(1))).alias("avg_line_len"),
        n.cast("long").alias("line_count"),
    )
