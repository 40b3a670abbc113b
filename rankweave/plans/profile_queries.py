"""Queries over whole profiles: what scores read, merges by confidence, grades, gates, settings and display."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.functions import person
from rankweave.operators import matching, ranking, report
from rankweave.plans.catalog import query
from rankweave.plans.ranking_queries import SQL_RANKED
from rankweave.sources.views import SQL_R, SQL_S, resumes, scores, table

#: Profiles as a model might give them, derived from the résumés; lists are texts with separators. Runs in Spark and in the oracle.
PROFILES = """
SELECT resume_id, job_id, filename, raw_text,
    CASE WHEN resume_id % 11 = 0 THEN '' WHEN resume_id % 13 = 0 THEN 'Python SQL 2020' ELSE split_part(raw_text, chr(10), 1) END AS name,
    CASE WHEN resume_id % 6 = 0 THEN '' WHEN resume_id % 17 = 0 THEN 'HTML, CSS' ELSE 'Pune' END AS location,
    CASE WHEN resume_id % 3 = 0 THEN '' ELSE concat('Works in unit ', resume_id % 25) END AS summary,
    (resume_id % 40) / 2e0 AS years,
    CASE resume_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'Python' WHEN 2 THEN 'Python, SQL ,' ELSE 'Sales,CRM,Excel,Python,SQL' END AS skills_text,
    CASE WHEN resume_id % 5 = 0 THEN 'RN' ELSE '' END AS licenses_text,
    CASE WHEN resume_id % 7 = 0 THEN 'PMP,AWS' ELSE '' END AS certifications_text,
    CASE resume_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Analyst|Unit 7|2 years' ELSE 'Nurse||Jan 2015 - Mar 2019;|Clinic|;||1 year' END AS jobs_text,
    CASE resume_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'MBA|Marketing|State University|2012' ELSE 'B.Com||City College|;||| ;B.Com||City College|' END AS schools_text,
    CASE resume_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE '' END AS sure_1,
    CASE resume_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS sure_2,
    CASE resume_id % 5 WHEN 0 THEN 'low' ELSE 'high' END AS quality
FROM {resumes} r
"""


def _profiles(spark, sf_dir):
    given = spark.sql(PROFILES, resumes=resumes(spark, sf_dir))
    items = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    records = lambda c, *f: F.transform(F.filter(F.split(c, ";"), lambda x: x != ""), lambda x: F.struct(*(F.split_part(x, F.lit("|"), F.lit(i + 1)).alias(n) for i, n in enumerate(f))))
    return given.withColumns(
        {"skills": items("skills_text"), "licenses": items("licenses_text"), "certifications": items("certifications_text"), "jobs": records("jobs_text", "title", "company", "duration"), "education": records("schools_text", "degree", "field", "institution", "year")}
    )


def _fields():
    return {c: F.col(c) for c in ("name", "location", "summary", "years", "skills", "licenses", "certifications", "jobs", "education")}


def _sql_items(c: str) -> str:
    return f"list_filter(string_split({c}, ','), lambda x: x <> '')"


def _sql_records(c: str, *fields: str) -> str:
    struct = ", ".join(f"'{f}': split_part(x, '|', {i + 1})" for i, f in enumerate(fields))
    return f"list_transform(list_filter(string_split({c}, ';'), lambda x: x <> ''), lambda x: {{{struct}}})"


SQL_P = f"""{SQL_R}, p AS (SELECT *, {_sql_items("skills_text")} AS skills, {_sql_items("licenses_text")} AS licenses, {_sql_items("certifications_text")} AS certifications,
    {_sql_records("jobs_text", "title", "company", "duration")} AS jobs, {_sql_records("schools_text", "degree", "field", "institution", "year")} AS education FROM ({PROFILES.format(resumes="r")}))"""


@query(f"""WITH {SQL_P} SELECT resume_id, md5(array_to_string(list_filter([nullif(summary, ''), CASE WHEN len(skills) > 0 THEN 'Skills: ' || array_to_string(skills, ', ') END,
    CASE WHEN len(licenses) > 0 THEN 'Licenses: ' || array_to_string(licenses, ', ') END, CASE WHEN len(certifications) > 0 THEN 'Certifications: ' || array_to_string(certifications, ', ') END]
    || list_transform(jobs, lambda x: x.title || ' ' || x.company || ' ' || x.duration) || list_transform(education, lambda x: x.degree || ' ' || x.field || ' ' || x.institution)
    || ['Location: ' || nullif(location, ''), raw_text[1:6000]], lambda x: x IS NOT NULL), chr(10))) AS text_md5 FROM p""")
def match_text(spark, sf_dir):
    return _profiles(spark, sf_dir).select("resume_id", F.md5(matching.match_text(_fields(), F.col("raw_text")).cast("binary")).alias("text_md5"))


@query(f"""WITH {SQL_P} SELECT resume_id, CAST(to_json({{'name': name, 'location': location, 'total_years_experience': years, 'skills': skills, 'education': education, 'work_history': jobs[1:6],
    'licenses': licenses, 'certifications': certifications, 'summary': summary}}) AS VARCHAR)[1:2500] AS profile FROM p""")
def compact_profile(spark, sf_dir):
    return _profiles(spark, sf_dir).select("resume_id", matching.compact_profile(_fields()).alias("profile"))


SETTING = "CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'many' WHEN 2 THEN '0' WHEN 3 THEN '-4' WHEN 4 THEN '1250.5' ELSE concat('', o_orderkey % 97) END"


@query(f"""SELECT o_orderkey, greatest(0, least(100, coalesce(n, 0))) AS min_score, CAST(greatest(1, least(500, coalesce(CASE WHEN n <> 0 THEN n END, 5))) AS INTEGER) AS size, greatest(1, least(10, coalesce(n, 5))) AS fit
FROM (SELECT o_orderkey, TRY_CAST({SETTING} AS DOUBLE) AS n FROM orders)""")
def criteria_clamps(spark, sf_dir):
    """Settings of jobs as texts, put into their bounds."""
    v = F.expr(SETTING)
    return table(spark, sf_dir, "orders").select("o_orderkey", matching.least_score(v).alias("min_score"), matching.shortlist_size(v).alias("size"), matching.model_score(v).alias("fit"))


@query("""SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE lang END), ''), trim(source), '') AS brief FROM documents""")
def brief_source(spark, sf_dir):
    """The prompt, or the description where that is blank."""
    return table(spark, sf_dir, "documents").select("doc_id", matching.brief_text(F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.col("lang")), F.col("source")).alias("brief"))


@query(f"""WITH {SQL_R} SELECT job_id, total, CASE WHEN job_id = 1 THEN false WHEN job_id = 2 THEN true WHEN job_id = 3 THEN total >= 1000000 ELSE true END AS enabled,
    CASE WHEN job_id = 0 THEN 1 WHEN job_id = 4 THEN 20 ELSE 7 END AS llm_top_k, CASE WHEN job_id = 4 THEN 30e0 ELSE 12.5e0 END AS min_pre_score, CASE WHEN job_id = 3 THEN 1000000 WHEN job_id = 0 THEN 1 ELSE 0 END AS always_full_below
FROM (SELECT job_id, count(*) AS total FROM r GROUP BY job_id)""")
def bulk_mode(spark, sf_dir):
    """Which jobs send only their best rows to the model, by their settings and their number of rows."""
    job = F.col("job_id")
    mode = matching.bulk_mode(F.col("total"), F.when(job == 1, False).when(job != 0, True), F.when(job == 3, 1000000).when(job == 0, 1).when(job == 2, -5), F.when(job == 0, -3).when(job != 4, 7), F.when(job != 4, 12.5))
    return resumes(spark, sf_dir).groupBy("job_id").agg(F.count("*").alias("total")).select("job_id", "total", mode.alias("m")).select("job_id", "total", "m.*")


@query(r"""SELECT doc_id, n < 40 AS failed, CASE WHEN n < 40 THEN 'failed_text' END AS stage, CASE WHEN n < 40 THEN 'Insufficient text extracted' END AS reason
FROM (SELECT doc_id, length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) AS n FROM documents)""")
def text_gate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", matching.text_gate(F.col("text")).alias("g")).select("doc_id", "g.*")


@query(f"""WITH {SQL_P} SELECT resume_id, NOT (resume_id % 8 = 1) AND ((resume_id % 10 = 2 AND NOT resume_id % 4 = 2) OR (len(jobs) = 0 AND len(skills) < 2)) AS enrich FROM p""")
def enrich_targets(spark, sf_dir):
    rid = F.col("resume_id")
    need = matching.needs_enrichment(F.col("skills"), F.col("jobs"), rid % 8 == 1, rid % 10 == 2, rid % 4 == 2)
    return _profiles(spark, sf_dir).select("resume_id", need.alias("enrich"))


@query(f"""WITH {SQL_P} SELECT resume_id, array_to_string(list_filter(flatten(list_transform(education, lambda e: [nullif(trim(e.degree || ' ' || e.field || ' ' || e.institution || ' ' || e.year), ''), nullif(e.degree, ''), nullif(e.field, ''), nullif(e.institution, '')]))
    || [nullif(summary, '')], lambda x: x IS NOT NULL), '#') AS texts FROM p""")
def education_blob(spark, sf_dir):
    return _profiles(spark, sf_dir).select("resume_id", F.array_join(matching.education_strings(F.col("education"), F.col("summary")), "#").alias("texts"))


_SQL_DEGREE = "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{d}'" for d, p in matching.DEGREES.items()) + " ELSE '' END"


@query(rf"""WITH {SQL_R}, l AS (SELECT resume_id, unnest(string_split(raw_text, chr(10))) AS line, generate_subscripts(string_split(raw_text, chr(10)), 1) AS i FROM r
), d AS (SELECT *, {_SQL_DEGREE} AS degree, regexp_matches(line, '{matching.INSTITUTION}') AS school, length(regexp_extract(line, '(?i)^(.*?){matching.INSTITUTION[4:]}', 1)) AS a, length(regexp_extract(line, '{matching.INSTITUTION}')) AS n FROM l)
SELECT resume_id, degree, trim(regexp_extract(line, '{matching.STUDY_FIELD}', 1)) AS field, CASE WHEN school THEN trim(line[greatest(1, a - 19):a + n + 40], ' ,-|') ELSE line[1:80] END AS institution, nullif(regexp_extract(line, '\b((?:19|20)\d{{2}})\b', 1), '') AS year
FROM d WHERE degree <> '' OR school""")
def education_lines(spark, sf_dir):
    """Degrees, fields, institutions and years of the lines that name them."""
    found = resumes(spark, sf_dir).select("resume_id", F.explode(matching.education_lines(F.col("raw_text"))).alias("e"))
    return found.select("resume_id", "e.*")


_ANSWER = """CASE doc_id % 5 WHEN 0 THEN concat('Sure: ```json', chr(10), '{"score": ', doc_id % 23, ', "justification": "fits"}', chr(10), '``` done')
    WHEN 1 THEN concat('{"score": ', doc_id % 23, '}') WHEN 2 THEN concat('I think {"score": ', doc_id % 23, ', "more": {"a": 1}} is right') WHEN 3 THEN 'no answer' ELSE '  {"justification": "none"} ' END"""


@query(f"""SELECT doc_id, doc_id % 5 <> 3 AS parsed, CASE WHEN doc_id % 5 IN (0, 1, 2) THEN greatest(1e0, least(10e0, CAST(doc_id % 23 AS DOUBLE))) WHEN doc_id % 5 = 4 THEN 5e0 END AS score FROM documents""")
def model_answers(spark, sf_dir):
    """Scores out of answers in fences, alone or amid prose; null where there is no object."""
    got = table(spark, sf_dir, "documents").select("doc_id", matching.json_object(F.expr(_ANSWER)).alias("v"))
    score = matching.model_score(F.try_variant_get("v", "$.score", "double"))
    return got.select("doc_id", F.col("v").isNotNull().alias("parsed"), F.when(F.col("v").isNotNull(), score).alias("score"))


@query(f"""WITH {SQL_P} SELECT resume_id, CASE WHEN sure_1 IN ('high', 'medium') THEN 'rule@x.org' WHEN resume_id % 9 <> 0 THEN 'model@x.org' END AS email, CASE WHEN resume_id % 9 <> 0 THEN '111' END AS phone,
    CASE WHEN resume_id % 2 = 0 THEN 30 WHEN resume_id % 9 <> 0 THEN 60 END AS notice, CASE WHEN resume_id % 4 = 0 THEN 'r/in' WHEN resume_id % 9 <> 0 THEN 'm/in' END AS linkedin,
    CASE WHEN resume_id % 9 <> 0 AND len(education) > 0 THEN len(education) ELSE 1 END AS n_education,
    CASE WHEN resume_id % 9 = 0 THEN '' ELSE array_to_string(list_filter(list_transform(skills, lambda x: trim(x)), lambda x: x <> ''), ',') END AS skills,
    CASE WHEN sure_1 IN ('high', 'medium') THEN CASE WHEN resume_id % 3 = 0 THEN 'header' ELSE 'hybrid' END WHEN resume_id % 3 = 0 THEN 'header' END AS email_source FROM p""")
def merge_ranks(spark, sf_dir):
    """A rule profile and a model's: sure contacts of the rule stay, lists are the model's; a ninth has no model profile."""
    p, rid = _profiles(spark, sf_dir), F.col("resume_id")
    source = F.when(rid % 3 == 0, F.create_map(F.lit("email"), F.lit("header"))).otherwise(F.create_map().cast("map<string,string>"))
    rule_school = F.array(F.struct(F.lit("MCA").alias("degree"), F.lit("").alias("field"), F.lit("").alias("institution"), F.lit("").alias("year")))
    rule = p.select("resume_id", F.lit("rule@x.org").alias("email"), F.lit("").alias("phone"), F.when(rid % 2 == 0, 30).alias("notice"), F.when(rid % 4 == 0, "r/in").alias("linkedin"), F.lit(None).cast("string").alias("github"), rule_school.alias("education"), F.create_map(F.lit("email"), F.col("sure_1")).alias("confidence"), source.alias("sources"))
    model = p.where("resume_id % 9 <> 0").select("resume_id", F.lit("model@x.org").alias("email"), F.lit("111").alias("phone"), F.lit(60).alias("notice"), F.lit("m/in").alias("linkedin"), F.lit(None).cast("string").alias("github"), "education", "skills", "licenses", "certifications")
    out = matching.merged_by_rank(rule, model, "resume_id")
    return out.select("resume_id", "email", "phone", "notice", "linkedin", F.size("education").cast("long").alias("n_education"), F.array_join("skills", ",").alias("skills"), F.col("sources")["email"].alias("email_source"))


_GRADED = ["resume_id % 10 <> 1 AS used", "CASE resume_id % 8 WHEN 0 THEN 'a,b,c' WHEN 1 THEN 'a' ELSE '' END AS issues_text"]


@query(f"""WITH {SQL_P}, g AS (SELECT *, {', '.join(_GRADED)}, name = '' AS no_name, name <> '' AND name LIKE '%0%' AS bad_name, location = 'HTML, CSS' AS bad_place, sure_2 = 'low' AS unsure FROM p
), h AS (SELECT *, CASE WHEN NOT used OR quality = 'low' OR issues_text = 'a,b,c' THEN 'low' WHEN (sure_1 = 'high')::INT + (sure_2 = 'high')::INT + 1 >= 3 AND quality = 'high' THEN 'high' ELSE 'medium' END AS base FROM g)
SELECT resume_id, CASE WHEN no_name OR bad_name OR bad_place THEN 'low' ELSE base END AS overall, (no_name OR bad_name)::INT + bad_place::INT + unsure::INT + len({_sql_items("issues_text")}) AS n_warnings,
    CASE WHEN no_name OR bad_name THEN 'low' ELSE 'high' END AS name_sure, CASE WHEN bad_place THEN 'low' END AS place_sure FROM h""")
def extraction_grade(spark, sf_dir):
    """Overall grade of a profile, and its warnings, by fields, quality of the text and open issues."""
    p = _profiles(spark, sf_dir).selectExpr("*", *_GRADED)
    sure = F.create_map(F.lit("name"), F.lit("high"), F.lit("email"), F.col("sure_1"), F.lit("total_years_experience"), F.col("sure_2"))
    issues = F.filter(F.split("issues_text", ","), lambda x: x != "")
    g = matching.extraction_grade(sure, F.col("quality"), F.col("used"), issues, F.col("name"), person.plausible_person(F.col("name")), F.col("location"), person.plausible_place(F.col("location")))
    return p.select("resume_id", g.alias("g")).select("resume_id", "g.overall", F.size("g.warnings").alias("n_warnings"), F.col("g.confidence")["name"].alias("name_sure"), F.col("g.confidence")["location"].alias("place_sure"))


@query(f"""WITH {SQL_P} SELECT resume_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' || CASE WHEN s % 60 > 0 THEN ' ' || (s % 60) || 's' ELSE '' END
    ELSE (s // 3600) || 'h' || CASE WHEN (s // 60) % 60 > 0 THEN ' ' || ((s // 60) % 60) || 'm' ELSE '' END END AS took,
    CASE resume_id % 4 WHEN 0 THEN '—' WHEN 1 THEN 'Python' WHEN 2 THEN 'Python, SQL' ELSE 'Sales, CRM, Excel (+2 more)' END AS skills,
    CASE resume_id % 4 WHEN 0 THEN '—' WHEN 1 THEN 'MBA · Marketing · State University (2012)' ELSE 'B.Com · City College' END AS education FROM (SELECT *, resume_id * 7 % 9000 AS s FROM p)""")
def display_values(spark, sf_dir):
    p = _profiles(spark, sf_dir)
    return p.select("resume_id", matching.shown_duration((F.col("resume_id") * 7 % 9000).cast("double")).alias("took"), matching.shown_list(F.col("skills"), 3).alias("skills"), matching.shown_education(F.col("education")).alias("education"))


@query(f"""WITH {SQL_P} SELECT resume_id, array_to_string(list_filter([CASE WHEN resume_id % 2 = 0 THEN 'Name looks odd' END, CASE WHEN sure_1 = 'low' AND resume_id % 2 <> 0 THEN 'Name is low-confidence — verify identity.' END,
    CASE WHEN sure_2 = 'low' THEN 'Location is low-confidence or was cleared.' END, CASE WHEN name = '' THEN 'No reliable name extracted — check resume file name.' END], lambda x: x IS NOT NULL), '; ') AS warnings FROM p""")
def trust_warnings(spark, sf_dir):
    sure = F.create_map(F.lit("name"), F.col("sure_1"), F.lit("location"), F.col("sure_2"))
    given = F.when(F.col("resume_id") % 2 == 0, F.array(F.lit("Name looks odd")))
    return _profiles(spark, sf_dir).select("resume_id", F.array_join(matching.shown_warnings(given, sure, F.col("name")), "; ").alias("warnings"))


@query(f"""WITH {SQL_P} SELECT resume_id, CASE resume_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'Python' WHEN 2 THEN 'Python,SQL' ELSE 'Sales,CRM,Excel,Python,SQL' END AS skills,
    CASE resume_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Analyst @ Unit 7 (2 years)' ELSE 'Nurse (Jan 2015 - Mar 2019);Clinic;1 year' END AS work_lines, nullif(summary[1:500], '') AS summary FROM p""")
def export_rich(spark, sf_dir):
    r = matching.rich_row(_fields())
    return _profiles(spark, sf_dir).select("resume_id", F.array_join(r["skills"], ",").alias("skills"), F.array_join(r["work_lines"], ";").alias("work_lines"), r["summary"].alias("summary"))


@query(f"""WITH {SQL_RANKED}, v AS (SELECT r.*, k.rank, coalesce(k.rank <= 5, false) AS listed, chr(34) AS q FROM r LEFT JOIN k USING (resume_id))
SELECT resume_id, coalesce(rank || '', '') || ',' || CASE WHEN listed THEN 'Yes' ELSE 'No' END || ',' || q || replace(split_part(raw_text, chr(10), 1), ' ', ', ' || q || q) || q || q || q || ',' || filename AS line FROM v""")
def csv_minimal(spark, sf_dir):
    """CSV lines that quote a field only where it holds a comma, a quote or a line break."""
    view = report.results(resumes(spark, sf_dir), scores(spark, sf_dir))
    first = F.split_part("raw_text", F.lit("\n"), F.lit(1))
    named = resumes(spark, sf_dir).select("resume_id", F.concat(F.replace(first, F.lit(" "), F.lit(', "')), F.lit('"')).alias("candidate"))
    rows = view.join(named, "resume_id").withColumn("shortlist", F.when(F.col("rank") <= 5, "Yes").otherwise("No"))
    return report.csv_lines(rows, ["rank", "shortlist", "candidate", "filename"], always=False)


@query(f"""WITH {SQL_RANKED}, n AS (SELECT *, CASE WHEN resume_id % 3 = 0 THEN 'low' ELSE 'high' END AS sure, resume_id % 5 = 0 AS warned, resume_id % 10 = 0 AS unnamed FROM k)
SELECT job_id, count(*) FILTER (rank <= 5 AND final_score >= 20 AND (sure = 'low' OR (warned AND unnamed))) AS to_confirm, bool_or(coalesce(rank <= 5 AND final_score >= 20, false) AND sure = 'low') AS queue_has_shortlisted FROM n GROUP BY job_id""")
def confirm_before_contact(spark, sf_dir):
    """Shortlisted rows per job whose name has to be confirmed first."""
    rid = F.col("resume_id")
    n = ranking.with_ranks(scores(spark, sf_dir)).withColumns({"sure": F.when(rid % 3 == 0, "low").otherwise("high"), "warned": rid % 5 == 0, "unnamed": rid % 10 == 0})
    listed, low = F.coalesce(ranking.shortlisted(5, 20.0), F.lit(False)), F.col("sure") == "low"
    return n.groupBy("job_id").agg(F.count_if(listed & (low | (F.col("warned") & F.col("unnamed")))).alias("to_confirm"), F.bool_or(listed & low).alias("queue_has_shortlisted"))


@query(f"""WITH {SQL_S} SELECT job_id, count(*) FILTER (final_score IS NULL) AS failed, count(*) FILTER (hard_filter_pass = 1 AND final_score IS NOT NULL) AS passed, count(*) FILTER (hard_filter_pass = 0 AND final_score IS NOT NULL) AS rejected,
    count(*) FILTER (final_score IS NOT NULL) AS processed FROM s GROUP BY job_id""")
def phase_counts(spark, sf_dir):
    """Outcomes of a phase and the number of processed rows, derived from the rows instead of being counted up."""
    done, ok = F.col("final_score").isNotNull(), F.col("hard_filter_pass") == 1
    return scores(spark, sf_dir).groupBy("job_id").agg(F.count_if(~done).alias("failed"), F.count_if(ok & done).alias("passed"), F.count_if(~ok & done).alias("rejected"), F.count_if(done).alias("processed"))


_NAMES = """CASE doc_id % 9 WHEN 0 THEN 'Asha Verma Resume' WHEN 1 THEN concat('ASHA o', chr(39), 'neil-verma') WHEN 2 THEN 'Python SQL' WHEN 3 THEN 'Delhi Noida' WHEN 4 THEN 'asha verma' WHEN 5 THEN 'Meera' WHEN 6 THEN 'CV_Final Ravi Kumar 2020'
    ELSE concat(split_part(coalesce(text, ''), ' ', 1), ' ', split_part(coalesce(text, ''), ' ', 2), ' ', split_part(coalesce(text, ''), ' ', 3)) END"""
_SOURCE = "CASE doc_id % 4 WHEN 0 THEN 'email+filename' WHEN 1 THEN 'llm' WHEN 2 THEN 'other' ELSE 'heuristic' END"


def _sql_list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_SQL_WORD, _SQL_LONG, _SQL_TOKEN = r"[A-Za-z][A-Za-z\-'']*", r"[A-Za-z][A-Za-z\-'']+", r"[A-Za-z][A-Za-z0-9+.#\-'']*"
_SQL_LOW = "list_transform(regexp_extract_all({}, '" + _SQL_WORD + "'), lambda x: trim(lower(x), '-'''))"
_SQL_TECH = f"regexp_replace(lower(x), '[^a-z0-9]', '', 'g') IN {_sql_list(person.TECH_KEYS)}"
SQL_NAMES = f"""n AS (SELECT doc_id, {_NAMES} AS name, {_SOURCE} AS source FROM documents
), k AS (SELECT *, trim(name) AS raw, array_to_string(list_filter(regexp_extract_all(name, '{_SQL_WORD}'), lambda x: trim(lower(x), '-''') NOT IN {_sql_list(person.NOISE)}), ' ') AS kept FROM n
), w AS (SELECT *, CASE WHEN kept = '' THEN raw ELSE kept END AS bare FROM k
), t AS (SELECT *, regexp_extract_all(bare, '{_SQL_LONG}') AS words, len(list_filter(regexp_extract_all(bare, '{_SQL_TOKEN}'), lambda x: {_SQL_TECH})) AS tech, len(regexp_extract_all(bare, '{_SQL_TOKEN}')) AS n_tokens,
    {_SQL_LOW.format("bare")} AS low, {_SQL_LOW.format("name")} AS full_low, regexp_extract_all(name, '{_SQL_LONG}') AS full_words FROM w)"""


def _sql_prose(low: str) -> str:
    hits = f"len(list_filter({low}, lambda x: x IN {_sql_list(person.PROSE)}))"
    verbal = f"len(list_filter({low}, lambda x: (x LIKE '%ing' OR x LIKE '%ed' OR x LIKE '%ly') AND x NOT IN ('king', 'young'))) > 0"
    return f"(len({low}) = 0 OR ({hits} >= 1 AND len({low}) >= 3) OR {hits} >= 2 OR coalesce({low}[1] IN {_sql_list(person.OPENERS)}, false) OR ({verbal} AND (len({low}) >= 3 OR {hits} > 0)))"


_SQL_PLACES = f"len(list_filter(words, lambda x: lower(x) IN {_sql_list(person.PLACES)}))"


@query(f"""WITH {SQL_NAMES} SELECT doc_id, length(raw) BETWEEN 3 AND 80 AND NOT regexp_matches(bare, '{person.NO_NAME}') AND NOT ((tech >= 1 AND n_tokens <= 4 AND tech >= greatest(1, n_tokens - 1)) OR tech >= 2 OR (tech >= 1 AND tech * 2 >= n_tokens))
    AND NOT {_sql_prose("low")} AND len(words) BETWEEN 2 AND 4 AND len(list_filter(words, lambda x: {_SQL_TECH} OR lower(x) IN {_sql_list(person.NOISE)} OR lower(x) IN {_sql_list(person.PROSE)})) = 0
    AND NOT ({_SQL_PLACES} >= 1 AND {_SQL_PLACES} >= len(words) - 1) AND {_SQL_PLACES} < 2 AND len(list_filter(words, lambda x: regexp_matches(x, '^[A-Z]'))) > 0 AS fits FROM t""")
def name_plausible(spark, sf_dir):
    """Which of many texts can be a person's name."""
    return table(spark, sf_dir, "documents").select("doc_id", person.plausible_person(F.expr(_NAMES)).alias("fits"))


@query(f"""WITH {SQL_NAMES} SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 96 WHEN 1 THEN 68 WHEN 2 THEN 40 ELSE 48 END + CASE WHEN len(full_words) = 2 THEN 8 WHEN len(full_words) = 3 THEN 4 WHEN len(full_words) = 1 THEN -12 WHEN len(full_words) >= 4 THEN -10 ELSE 0 END
    + CASE WHEN len(full_words) > 0 AND len(list_filter(full_words, lambda x: NOT regexp_matches(x, '^[A-Z]'))) = 0 THEN 4 ELSE 0 END - CASE WHEN {_sql_prose("full_low")} THEN 40 ELSE 0 END
    - CASE WHEN len(list_filter(full_words, lambda x: lower(x) IN {_sql_list(person.NOISE)})) > 0 THEN 30 ELSE 0 END AS quality FROM t""")
def name_quality(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", person.name_quality(F.expr(_NAMES), F.expr(_SOURCE)).alias("quality"))
