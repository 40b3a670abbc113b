"""Queries over texts: tokens, cleaning, extraction, rules, briefs, layout and progress."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankweave.functions import person
from rankweave.functions import text as T
from rankweave.operators import briefs as B
from rankweave.operators import extraction, layout, profile, rules
from rankweave.plans.catalog import query
from rankweave.plans.ranking_queries import SQL_SCHOOL, sql_tokens
from rankweave.sources import files
from rankweave.sources.views import SQL_B, SQL_R, briefs, resumes, table
from rankweave.streaming import batches, progress

AS_OF = 2026


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest({sql_tokens('text')}) AS token FROM documents) GROUP BY token")
def tokenize_counts(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(T.tokens(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n"))


SQL_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"


@query("SELECT doc_id, md5(" + SQL_CLEAN.format("concat('  ', replace(text, '. ', '.' || chr(13) || chr(10) || chr(10) || chr(10) || '  '), '   ')") + ") AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    messy = F.concat(F.lit("  "), F.replace("text", F.lit(". "), F.lit(".\r\n\n\n  ")), F.lit("   "))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean(messy).cast("binary")).alias("cleaned"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE length(text) > 800
), m AS (SELECT *, count(*) OVER (PARTITION BY doc_id, lower(trim(line))) AS copies, count(*) OVER (PARTITION BY doc_id) AS n FROM l
), k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS body FROM m WHERE NOT (n >= 20 AND (length(trim(line)) BETWEEN 3 AND 80 AND copies >= 3 AND regexp_matches(lower(trim(line)), 'page\s*[0-9]+|^[0-9]+$|confidential|curriculum vitae|\bresume\b') OR regexp_matches(lower(trim(line)), '^page\s*[0-9]+(\s*of\s*[0-9]+)?$'))) GROUP BY doc_id)
SELECT doc_id, md5(CASE WHEN length(text) > 800 THEN coalesce(body, '') ELSE text END) AS body FROM documents LEFT JOIN k USING (doc_id)""")
def strip_headers(spark, sf_dir):
    return layout.without_headers(table(spark, sf_dir, "documents")).select("doc_id", F.md5(F.col("body").cast("binary")).alias("body"))


SQL_LINES = "SELECT resume_id, raw_text, unnest(string_split(raw_text, chr(10))) AS line, generate_subscripts(string_split(raw_text, chr(10)), 1) AS i FROM r"


@query(rf"""WITH {SQL_R}, l AS ({SQL_LINES}
), h AS (SELECT *, CASE WHEN regexp_matches(trim(line), '(?i)^experience') THEN 'experience' WHEN regexp_matches(trim(line), '(?i)^education') THEN 'education' WHEN regexp_matches(trim(line), '(?i)^skills') THEN 'skills' END AS opens FROM l
), o AS (SELECT *, coalesce(last_value(opens IGNORE NULLS) OVER (PARTITION BY resume_id ORDER BY i ROWS UNBOUNDED PRECEDING), 'header') AS section,
    CASE WHEN opens IS NULL THEN line ELSE nullif(regexp_replace(regexp_replace(trim(line), '(?i)^(experience|education|skills)', ''), '^[ \t:\-–—|]+', ''), '') END AS said FROM h)
SELECT resume_id, section, regexp_replace(coalesce(string_agg(said, chr(10) ORDER BY i), ''), '^\s+|\s+$', '', 'g') AS body FROM o GROUP BY ALL
UNION ALL SELECT resume_id, 'full', raw_text FROM r""")
def section_split(spark, sf_dir):
    return layout.sections(resumes(spark, sf_dir))


@query("""WITH t AS (SELECT doc_id, 'x ' || replace(coalesce(text, ''), chr(10), chr(10) || 'x ') AS t FROM documents)
SELECT doc_id, 'full' AS section, md5(t) AS body FROM t UNION ALL SELECT doc_id, 'body', md5(t) FROM t UNION ALL SELECT doc_id, 'header', md5(array_to_string(string_split(t, chr(10))[1:25], chr(10))) FROM t""")
def sections_without_headings(spark, sf_dir):
    """Texts without any heading have their first lines as header and all of them as body."""
    plain = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.concat(F.lit("x "), F.coalesce("text", F.lit(""))), "\n", "\nx ").alias("raw_text"))
    return layout.sections(plain, "doc_id").select("doc_id", "section", F.md5(F.col("body").cast("binary")).alias("body"))


_GRADED = "CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN concat('Summary', chr(10), text, chr(10), 'Skills: many') ELSE concat('Education', chr(10), text) END"


@query(rf"""WITH t AS (SELECT doc_id, {_GRADED} AS t, doc_id % 3 AS k FROM (SELECT doc_id, 'x ' || replace(coalesce(text, ''), chr(10), chr(10) || 'x ') AS text FROM documents)), n AS (SELECT doc_id, length(regexp_replace(t, '[ 	
]', '', 'g')) AS n, CASE k WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS s FROM t)
SELECT doc_id, CASE WHEN n < 80 THEN 'low' WHEN n >= 400 AND s >= 2 THEN 'high' WHEN n >= 200 OR s >= 1 THEN 'medium' ELSE 'low' END AS grade FROM n""")
def text_quality(spark, sf_dir):
    """Grades by length and by the sections found, of texts with none, one and two headings."""
    plain = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.concat(F.lit("x "), F.coalesce("text", F.lit(""))), "\n", "\nx ").alias("text"))
    cut = layout.with_sections(plain.select("doc_id", F.expr(_GRADED).alias("text")), "text")
    hits = F.filter("parts", lambda p: p["section"].isin(*files.HITS) & (p["body"] != ""))
    return cut.select("doc_id", T.quality_grade(F.col("text"), F.size(hits)).alias("grade"))


@query(r"""SELECT doc_id, length(regexp_replace(text, '[ \t\n\r]', '', 'g')) AS n_chars_solid, len(l) AS n_lines, len(list_filter(l[1:40], lambda x: length(x) < 30)) AS short_lines,
    length(regexp_replace(text, '[ \t\n\r]', '', 'g')) < 220 AS escalate FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)""")
def quality_signals(spark, sf_dir):
    solid = F.length(F.regexp_replace("text", r"[ \t\n\r]", ""))
    lines = F.split("text", "\n")
    short = F.size(F.filter(F.slice(lines, 1, 40), lambda x: F.length(x) < 30)).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", solid.cast("long").alias("n_chars_solid"), F.size(lines).cast("long").alias("n_lines"), short.alias("short_lines"), (solid < 220).alias("escalate"))


@query(r"SELECT doc_id, nullif(regexp_extract(text, '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b'), '') AS email FROM documents")
def extract_email(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.first_email(F.col("text")).alias("email"))


@query(rf"""SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '{T.PHONE}'), lambda x: trim(x)), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 10 AND 15 AND NOT regexp_matches(x, '{T.YEAR_RANGE}'))[1] AS phone FROM documents""")
def extract_phone(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.first_phone(F.col("text")).alias("phone"))


@query(rf"""SELECT page_id, regexp_replace(nullif(regexp_extract(t, '{T.LINKEDIN}'), ''), '/+$', '') AS linkedin, regexp_replace(nullif(regexp_extract(t, '{T.GITHUB}'), ''), '/+$', '') AS github
FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'see https://www.linkedin.com/in/a-' || page_id || '/ ' WHEN page_id % 3 = 1 THEN 'GitHub.com/u' || page_id || '/' ELSE url END AS t FROM pages)""")
def extract_links(spark, sf_dir):
    t = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("see https://www.linkedin.com/in/a-"), "page_id", F.lit("/ "))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("GitHub.com/u"), "page_id", F.lit("/"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", T.link(t, T.LINKEDIN).alias("linkedin"), T.link(t, T.GITHUB).alias("github"))


@query(rf"""WITH {SQL_R} SELECT resume_id, lower(regexp_extract(raw_text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{{2,}}')) AS email, right(regexp_replace(regexp_extract(raw_text, '[+]91 [0-9]+'), '[^0-9]', '', 'g'), 10) AS phone FROM r""")
def normalize_contact(spark, sf_dir):
    from rankweave.operators.ranking import contacts

    return contacts(resumes(spark, sf_dir)).select("resume_id", "email", "phone")


@query(rf"WITH {SQL_R} SELECT resume_id, regexp_extract(raw_text, 'Location: ([A-Za-z]+)', 1) AS location FROM r")
def extract_location(spark, sf_dir):
    return extraction.facts(resumes(spark, sf_dir), AS_OF).select("resume_id", "location")


@query(rf"WITH {SQL_R} SELECT resume_id, CAST(regexp_extract(raw_text, 'Notice period: ([0-9]+)', 1) AS INTEGER) AS notice FROM r")
def extract_notice(spark, sf_dir):
    return resumes(spark, sf_dir).select("resume_id", T.notice_days(F.col("raw_text")).alias("notice"))


@query(rf"WITH {SQL_R} SELECT resume_id, degree || ' / ' || institution || ' / ' || year AS education FROM (SELECT resume_id, CASE resume_id % 5 WHEN 0 THEN 'B.Tech' WHEN 1 THEN 'MBA' WHEN 2 THEN 'B.Com' WHEN 3 THEN 'M.S.' ELSE '' END AS degree, {SQL_SCHOOL} AS institution, right(line, 4) AS year FROM (SELECT resume_id, split_part(raw_text, chr(10), 8) AS line FROM r))")
def extract_education(spark, sf_dir):
    line = F.transform("education", lambda e: F.concat_ws(" / ", e["degree"], e["institution"], e["year"]))
    return extraction.facts(resumes(spark, sf_dir), AS_OF).select("resume_id", F.array_join(line, "; ").alias("education"))


@query(rf"""WITH t AS (SELECT conv_id, turn, 'Over ' || (conv_id % 30) || '+ years of experience; experience: ' || (turn % 60) || ' yrs' AS x FROM conversations)
SELECT conv_id, turn, list_max(list_filter(list_transform(list_concat(regexp_extract_all(x, '{T.YEARS_PHRASE}', 1), regexp_extract_all(x, '{T.YEARS_STATED}', 1)), lambda v: TRY_CAST(v AS DOUBLE)), lambda v: v > 0 AND v <= 50)) AS years FROM t""")
def years_explicit(spark, sf_dir):
    x = F.concat(F.lit("Over "), F.col("conv_id") % 30, F.lit("+ years of experience; experience: "), F.col("turn") % 60, F.lit(" yrs"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.stated_years(x).alias("years"))


SQL_YEARS = rf"""{SQL_R}, y AS (SELECT resume_id, CAST(regexp_extract(raw_text, 'Jan ([0-9]+) - Mar ([0-9]+)', 1) AS INTEGER) AS a, CAST(regexp_extract(raw_text, 'Jan ([0-9]+) - Mar ([0-9]+)', 2) AS INTEGER) AS b FROM r
), z AS (SELECT resume_id, floor(least(CAST(b - a AS DOUBLE), {AS_OF} - a, 50) * 10 + 0.5) / 10 AS years FROM y)"""


SQL_MONTHS = rf"""{SQL_R}, m AS (SELECT resume_id, CAST(regexp_extract(raw_text, 'Jan ([0-9]+) - Mar ([0-9]+)', 1) AS INTEGER) AS a, CAST(regexp_extract(raw_text, 'Jan ([0-9]+) - Mar ([0-9]+)', 2) AS INTEGER) AS b FROM r)"""


@query(f"WITH {SQL_MONTHS} SELECT resume_id, round_even(((b - a) * 12 + 2) / 12e0, 2) AS named, round_even(((b - a) * 12 + 8) / 12e0, 2) AS numbered, round_even((({AS_OF} - a) * 12 + 2) / 12e0, 2) AS still FROM m")
def years_month(spark, sf_dir):
    """Ranges of named months, of numbered ones, and one that isn't over."""
    r, text = resumes(spark, sf_dir), F.col("raw_text")
    year = lambda k: F.regexp_extract(text, "Jan ([0-9]+) - Mar ([0-9]+)", k)  # noqa: E731
    numbered = F.concat(F.lit("03/"), year(1), F.lit(" - 11/"), year(2))
    still = F.concat(F.lit("March "), year(1), F.lit(" – Present"))
    return r.select("resume_id", *(T.month_range_years(x, AS_OF, 5).alias(n) for n, x in (("named", text), ("numbered", numbered), ("still", still))))


@query(f"WITH {SQL_MONTHS} SELECT resume_id, CASE resume_id % 4 WHEN 0 THEN round_even(((b - a) * 12 + 2) / 12e0, 2) WHEN 1 THEN CASE WHEN a = b THEN 0.5 ELSE CAST(b - a AS DOUBLE) END WHEN 2 THEN round_even((1 + resume_id % 30) / 12e0, 1) ELSE CAST(resume_id % 9 AS DOUBLE) END AS years FROM m")
def years_duration(spark, sf_dir):
    """Durations of the four forms: months, years, stated months, stated years."""
    text, k = F.col("raw_text"), F.col("resume_id")
    year = lambda i: F.regexp_extract(text, "Jan ([0-9]+) - Mar ([0-9]+)", i)  # noqa: E731
    forms = F.when(k % 4 == 0, F.regexp_substr(text, F.lit("Jan [0-9]+ - Mar [0-9]+"))).when(k % 4 == 1, F.concat(year(1), F.lit(" - "), year(2))).when(k % 4 == 2, F.concat((1 + k % 30).cast("string"), F.lit(" months"))).otherwise(F.concat((k % 9).cast("string"), F.lit(" yrs")))
    return resumes(spark, sf_dir).select("resume_id", T.duration_years(forms, AS_OF, 5).alias("years"))


@query(f"WITH {SQL_YEARS} SELECT resume_id, years FROM z")
def years_ranges(spark, sf_dir):
    return resumes(spark, sf_dir).select("resume_id", T.range_years(F.col("raw_text"), AS_OF).alias("years"))


def _sql_skill(skill: str) -> str:
    return re.escape(skill).replace("\\ ", " ").replace("'", "''")


@query("WITH " + SQL_R + ", k(skill, form) AS (VALUES " + ", ".join(f"('{s}', '{_sql_skill(s)}')" for s in person.SKILLS) + ") SELECT skill, count(*) AS n FROM r JOIN k ON regexp_matches(' ' || raw_text || ' ', '(?i)[^a-z0-9]' || form || '[^a-z0-9]') GROUP BY skill")
def skills_lexicon(spark, sf_dir):
    """How many résumés name each skill of the list."""
    return resumes(spark, sf_dir).select(F.explode(T.skills_in(F.col("raw_text"), person.SKILLS)).alias("skill")).groupBy("skill").agg(F.count("*").alias("n"))


_CERTIFIED = "concat(coalesce(text, ''), ' ', " + "CASE doc_id % 27 " + " ".join(f"WHEN {i} THEN '{c.upper() if i % 2 else c}'" for i, c in enumerate(T.CERTIFICATES)) + " ELSE '' END)"


@query(f"WITH t AS (SELECT doc_id, lower({_CERTIFIED}) AS t FROM documents) SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(t, '{c.lower()}') THEN '{c}' END" for c in sorted(T.CERTIFICATES, key=len, reverse=True)) + "], lambda x: x IS NOT NULL), '; ') AS found FROM t")
def cert_lexicon(spark, sf_dir):
    """The certificates that each text names."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.certificates_in(F.expr(_CERTIFIED)), "; ").alias("found"))


@query("SELECT doc_id, md5(regexp_replace(replace(lower(strip_accents(text)), '&', 'and'), '[^a-z0-9]+', '', 'g')) AS strict, md5(trim(regexp_replace(regexp_replace(lower(strip_accents(trim(text))), '[.\\-_/]+', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))) AS loose FROM (SELECT doc_id, replace(text, 'ß', '') AS text FROM documents)")
def normalize_both(spark, sf_dir):
    """The sharp s has no decomposition: the strict form drops it, and so does the oracle, whose own accent stripping would spell it out; here both forms do."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit("ß"), F.lit("")))
    return docs.select("doc_id", F.md5(rules.strict_column(F.col("text")).cast("binary")).alias("strict"), F.md5(rules.loose_column(F.col("text")).cast("binary")).alias("loose"))


def _fields():
    return {c: F.col(c) for c in ("years", "notice", "skills", "education")} | {"location": F.array("location"), "name": F.array("name")}


def _profiles(spark, sf_dir):
    """What rules read of the résumés, with the skills that their texts list, where a model's would stand."""
    schools = F.transform("education", lambda e: F.concat_ws(" ", e["degree"], e["institution"], e["year"]))
    found = extraction.facts(resumes(spark, sf_dir), AS_OF).withColumns({"skills": F.col("listed_skills"), "education": schools, "name": person.name_of_file(F.col("filename"))})
    return found.select("resume_id", "job_id", "name", "email", "phone", "location", "years", "notice", "skills", "education")


def _rule(spark, sf_dir, rule):
    return _profiles(spark, sf_dir).select("resume_id", rules.passed(rule, _fields()).alias("passed"))


SQL_P = rf"""{SQL_YEARS}, p AS (SELECT r.resume_id, years, CAST(regexp_extract(raw_text, 'Notice period: ([0-9]+)', 1) AS INTEGER) AS notice, regexp_extract(raw_text, 'Skills: (.*)$', 1) AS skills,
    regexp_extract(raw_text, 'Location: ([A-Za-z]+)', 1) AS location, split_part(raw_text, chr(10), 8) AS education FROM r JOIN z USING (resume_id))"""


@query(f"WITH {SQL_P} SELECT resume_id, coalesce(years >= 4, false) AS passed FROM p")
def filter_gte(spark, sf_dir):
    return _rule(spark, sf_dir, {"field": "years", "operator": "gte", "value": 4})


@query(f"WITH {SQL_P} SELECT resume_id, coalesce(CASE WHEN resume_id % 6 = 0 THEN NULL ELSE notice END <= 30, true) AS passed FROM p")
def filter_lte_null(spark, sf_dir):
    p = _profiles(spark, sf_dir).withColumn("notice", F.when(F.col("resume_id") % 6 != 0, F.col("notice")))
    return p.select("resume_id", rules.passed({"field": "notice", "operator": "lte", "value": 30}, _fields()).alias("passed"))


@query(f"WITH {SQL_P} SELECT resume_id, location = 'Pune' AS passed FROM p")
def filter_eq(spark, sf_dir):
    return _rule(spark, sf_dir, {"field": "location", "operator": "eq", "value": "Pune"})


@query(f"WITH {SQL_P} SELECT resume_id, contains(skills, 'Excel') AS passed FROM p")
def filter_contains(spark, sf_dir):
    return _rule(spark, sf_dir, {"field": "skills", "operator": "contains", "value": "Excel"})


@query(f"WITH {SQL_P} SELECT resume_id, NOT contains(skills, 'Triage') AS passed FROM p")
def filter_not_contains(spark, sf_dir):
    return _rule(spark, sf_dir, {"field": "skills", "operator": "not_contains", "value": "Triage"})


# Chennai and Mumbai both contain "ai" and so share the synonyms of that field of study.
@query(f"WITH {SQL_P} SELECT resume_id, location IN ('Mumbai', 'Delhi', 'Chennai') AS passed FROM p")
def filter_in(spark, sf_dir):
    return _rule(spark, sf_dir, {"field": "location", "operator": "in", "value": "Mumbai, Delhi"})


RULES = [{"field": "years", "operator": "gte", "value": 2}, {"field": "location", "operator": "in", "value": ["Pune", "Noida"]}, {"field": "notice", "operator": "lte", "value": 45}]


@query(f"""WITH {SQL_P} SELECT resume_id, coalesce(years >= 2, false) AND location IN ('Pune', 'Noida') AND notice <= 45 AS passed,
    array_to_string(list_filter([CASE WHEN NOT coalesce(years >= 2, false) THEN 'years gte 2' END, CASE WHEN location NOT IN ('Pune', 'Noida') THEN 'location in [''Pune'', ''Noida'']' END, CASE WHEN notice > 45 THEN 'notice lte 45' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM p""")
def filter_all(spark, sf_dir):
    found = _profiles(spark, sf_dir).select("resume_id", rules.explained(RULES, _fields()).alias("results"))
    return found.select("resume_id", F.forall("results", lambda r: r["passed"]).alias("passed"), rules.reasons(F.col("results")).alias("reasons"))


@query(f"WITH {SQL_YEARS} SELECT resume_id, years >= 3 AS by_alias, years >= 3 AS by_text, FALSE AS unknown, FALSE AS unreadable FROM z")
def rule_aliases(spark, sf_dir):
    """Rules by another field name, with a number inside words, on a field that isn't there, and with a number that can't be read."""
    cases = {"by_alias": ("Total Years Experience", 3), "by_text": ("experience", "3 years"), "unknown": ("shoe size", 3), "unreadable": ("years", "some")}
    found = [rules.passed({"field": f, "operator": "gte", "value": v}, _fields()).alias(n) for n, (f, v) in cases.items()]
    return _profiles(spark, sf_dir).select("resume_id", *found)


SQL_STUDENT = " OR ".join(f"contains(t, '{w}')" for w in profile.STUDENT)
SQL_CLAIM = " OR ".join(f"contains(t, '{w}')" for w in profile.EXPERIENCED)


@query(f"SELECT doc_id, ({SQL_STUDENT}) AND NOT ({SQL_CLAIM}) AS student, NOT (t IN ('', '-', 'n/a')) AND NOT contains(t, 'master') AS job FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'final year pupil' WHEN 1 THEN 'fresher, 2 years of experience' WHEN 2 THEN '-' WHEN 3 THEN 'scrum master' ELSE lower(text) || ' batch of ' || doc_id END AS t FROM (SELECT doc_id, regexp_replace(text, '(?i)master|bachelor|b.tech|btech|m.tech|university|institute of|high school|class xii|class 12', '', 'g') AS text FROM documents))")
def student_and_jobs(spark, sf_dir):
    """Signs of students in texts, and entries that are jobs, over forms of each kind."""
    bare = F.regexp_replace("text", "(?i)master|bachelor|b.tech|btech|m.tech|university|institute of|high school|class xii|class 12", "")
    k = F.col("doc_id") % 5
    t = F.when(k == 0, "Final year pupil").when(k == 1, "Fresher, 2 years of experience").when(k == 2, "-").when(k == 3, "Scrum Master").otherwise(F.concat(bare, F.lit(" batch of "), F.col("doc_id")))
    return table(spark, sf_dir, "documents").select("doc_id", profile.student(t).alias("student"), profile.real_job(t, F.lit("n/a")).alias("job"))


SQL_WORKED = """j AS (SELECT o_custkey AS resume_id, year(o_orderdate) AS a, year(o_orderdate) + o_orderkey % 4 AS b, o_orderkey % 5 = 0 AS schooling FROM orders
), s AS (SELECT resume_id, count(*) FILTER (NOT schooling) AS n, coalesce(sum(CASE WHEN a = b THEN 0.5e0 ELSE b - a END) FILTER (NOT schooling), 0e0) AS total, CAST(max(b) FILTER (NOT schooling) - min(a) FILTER (NOT schooling) AS DOUBLE) AS span FROM j GROUP BY resume_id
), worked AS (SELECT resume_id, CASE WHEN n = 0 THEN NULL WHEN span > 0 AND total > span * 1.25e0 THEN span WHEN span > 0 THEN least(total, span) ELSE total END AS years,
    CASE WHEN n = 0 THEN 'none' WHEN span > 0 AND total > span * 1.25e0 THEN 'work_history_span' ELSE 'work_history_sum' END AS method, n AS jobs, total AS job_years FROM s)"""


def _jobs(spark, sf_dir):
    """A job per order of each customer, a fifth of them schooling."""
    year = F.year("o_orderdate")
    title = F.when(F.col("o_orderkey") % 5 == 0, "University course").otherwise(F.col("o_orderpriority"))
    duration = F.concat(year, F.lit(" - "), year + F.col("o_orderkey") % 4)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("resume_id"), title.alias("title"), F.lit("Unit").alias("company"), duration.alias("duration"), F.lit(None).cast("double").alias("years"))


@query(f"WITH {SQL_WORKED} SELECT resume_id, years, method, jobs, job_years FROM worked")
def years_work_history(spark, sf_dir):
    """Jobs of all orders' customers, summed or spanned per customer."""
    return profile.work_years(_jobs(spark, sf_dir), "resume_id", AS_OF, 5)


@query("SELECT o_orderkey, o_orderkey % 5 <> 0 AS counted, CASE WHEN o_orderkey % 5 = 0 THEN 0e0 WHEN o_orderkey % 4 = 0 THEN 0.5e0 ELSE CAST(o_orderkey % 4 AS DOUBLE) END AS years FROM orders")
def years_per_job(spark, sf_dir):
    """Each job's own years, and whether it is one."""
    return profile.job_entries(_jobs(spark, sf_dir), AS_OF, 5).select("o_orderkey", "counted", "years")


#: What a résumé says of its years, by id; half the résumés bring the jobs of their orders.
SAYS = """CASE resume_id % 9 WHEN 0 THEN 'Fresher, final year' WHEN 1 THEN 'Over 6 years of experience' WHEN 2 THEN 'Student, 1.5 years' WHEN 3 THEN '30 years of experience' WHEN 4 THEN 'Pursuing a degree' WHEN 5 THEN '2 yrs' ELSE '' END"""
_STATED = "CASE r.resume_id % 9 WHEN 1 THEN 6e0 WHEN 2 THEN 1.5e0 WHEN 3 THEN 30e0 WHEN 5 THEN 2e0 END"


@query(f"""WITH {SQL_R}, {SQL_WORKED}, q AS (SELECT r.resume_id, w.years AS c, w.method AS m, coalesce(w.jobs, 0) AS n, coalesce(w.job_years, 0) AS own, {_STATED} AS e, r.resume_id % 9 IN (0, 2, 4) AS student, CASE WHEN r.resume_id % 17 = 0 THEN 60e0 END AS o
    FROM r LEFT JOIN worked w ON w.resume_id = r.resume_id AND r.resume_id % 2 = 0
), f AS (SELECT *, CASE WHEN student AND n = 0 THEN 0 WHEN c IS NOT NULL AND e > 0 AND abs(e - c) <= 2 THEN round_even(c * 0.5 + e * 0.5, 1) WHEN c IS NOT NULL AND e > 0 AND e < c THEN e WHEN c IS NOT NULL THEN c WHEN e IS NOT NULL THEN e ELSE 0 END AS v,
    CASE WHEN student AND n = 0 THEN 'student_no_jobs' WHEN c IS NOT NULL AND e > 0 AND abs(e - c) <= 2 THEN m || '+explicit' WHEN c IS NOT NULL AND e > 0 AND e < c THEN 'explicit_phrase' WHEN c IS NOT NULL THEN m WHEN e IS NOT NULL THEN 'explicit_phrase' ELSE 'no_real_jobs' END AS k FROM q
), g AS (SELECT *, student AND v > 2 AND NOT coalesce(e > 2, false) AND own <= 1.5 AS capped FROM f)
SELECT resume_id, CASE WHEN o IS NOT NULL THEN 50 WHEN capped THEN least(v, own) ELSE least(v, 50) END AS years, CASE WHEN o IS NOT NULL THEN 'recruiter_override' WHEN capped THEN 'student_capped' ELSE k END AS method,
    CASE WHEN o IS NULL AND (capped OR k = 'no_countable_jobs') THEN 'medium' ELSE 'high' END AS confidence FROM g""")
def years_two_pass(spark, sf_dir):
    """Years by jobs, by what the text says, by signs of students and by hand, decided together."""
    says = F.expr(SAYS)
    r = resumes(spark, sf_dir).select("resume_id", F.concat_ws("\n", "raw_text", says).alias("text"))
    r = r.select("resume_id", T.stated_years(F.col("text")).alias("stated"), profile.student(F.col("text")).alias("student"))
    worked = profile.work_years(_jobs(spark, sf_dir).where("resume_id % 2 = 0"), "resume_id", AS_OF, 5)
    by_hand = F.when(F.col("resume_id") % 17 == 0, F.lit(60.0))
    found = profile.two_pass_years(F.col("years"), F.col("method"), F.col("jobs"), F.col("job_years"), F.col("stated"), F.col("student"), by_hand)
    return r.join(worked, "resume_id", "left").select("resume_id", found.alias("y")).select("resume_id", "y.*")


#: Texts as briefs, with a line of what is asked for in two of three.
ASKED = "concat(coalesce(text, ''), chr(10), CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '- Senior nurse in Pune, 3+ years of experience' ELSE 'Required: python, sql and excel; degree preferred, remote' END)"
SQL_CHECKS = ", ".join(rf"regexp_matches(t, '{p}') AS {k}" for k, p in B.CHECKS.items())


@query(rf"""WITH c AS (SELECT doc_id, t, {SQL_CHECKS} FROM (SELECT doc_id, {ASKED} AS t FROM documents)), n AS (SELECT *, {" + ".join(f"CAST({k} AS BIGINT)" for k in B.CHECKS)} AS n FROM c)
SELECT doc_id, {", ".join(B.CHECKS)}, CASE WHEN length(trim(t)) >= 80 THEN n * 20 ELSE least(n * 20, 40) END AS score, length(trim(t)) >= 80 AND n >= 3 AS ready FROM n""")
def brief_checklist(spark, sf_dir):
    """What briefs lack: the texts of all documents, some with what a brief should hold."""
    return table(spark, sf_dir, "documents").select("doc_id", *(c.alias(k) for k, c in B.checklist(F.expr(ASKED)).items()))


@query()
def brief_points(spark, sf_dir):
    """The points that the same texts ask for."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(B.points(F.expr(ASKED))).alias("place", "point"))


@query()
def brief_match(spark, sf_dir):
    asked = briefs(spark).select("job_id", B.points(F.col("hiring_prompt")).alias("points"))
    both = resumes(spark, sf_dir).join(asked, "job_id").withColumn("met", B.met(F.col("points"), F.col("raw_text")))
    ratio = F.floor(F.size("met") / F.greatest(F.size("points"), F.lit(1)) * 1000 + 0.5) / 1000
    return both.select("resume_id", "job_id", F.array_join("met", "; ").alias("met"), F.array_join(F.array_except("points", "met"), "; ").alias("missing"), ratio.alias("ratio"))


@query(f"WITH {SQL_P} SELECT resume_id, CASE WHEN resume_id % 4 = 0 THEN 'no_skills' ELSE '' END AS issues FROM p")
def profile_validate(spark, sf_dir):
    p = _profiles(spark, sf_dir).withColumn("skills", F.when(F.col("resume_id") % 4 != 0, F.col("skills")))
    fields = {c: F.col(c) for c in p.columns}
    return p.select("resume_id", F.array_join(profile.issues(fields), "; ").alias("issues"))


@query(f"WITH {SQL_P} SELECT resume_id, least(50, years * 20) AS years, CAST(least(365, notice * 10) AS INTEGER) AS notice, skills FROM p")
def profile_sanitize(spark, sf_dir):
    messy = _profiles(spark, sf_dir).withColumns({"years": F.col("years") * 20, "notice": F.col("notice") * 10, "skills": F.concat("skills", F.transform("skills", F.upper), F.array(F.lit(" ")))})
    return profile.sanitised(messy).select("resume_id", "years", "notice", F.array_join("skills", ", ").alias("skills"))


@query(f"WITH {SQL_P} SELECT resume_id, CASE WHEN resume_id % 3 = 0 THEN 'Welding' ELSE skills END AS skills, CASE WHEN resume_id % 3 = 0 THEN 'Goa' ELSE location END AS location, notice FROM p")
def profile_merge(spark, sf_dir):
    p = _profiles(spark, sf_dir)
    model = p.where("resume_id % 3 = 0").withColumns({"skills": F.array(F.lit("Welding")), "location": F.lit("Goa"), "notice": F.lit(1)})
    return profile.merged(p, model).select("resume_id", F.array_join("skills", ", ").alias("skills"), "location", "notice")


@query(f"WITH {SQL_P} SELECT resume_id, CASE WHEN resume_id % 10 = 0 THEN 50 ELSE years END AS years, CASE WHEN resume_id % 10 = 0 THEN 'Go, Rust' ELSE skills END AS skills, CASE WHEN resume_id % 10 = 0 THEN 'skills+years' ELSE '' END AS overrides FROM p")
def override_apply(spark, sf_dir):
    p = _profiles(spark, sf_dir)
    fixes = p.where("resume_id % 10 = 0").select("resume_id", F.lit(99.0).alias("years"), F.lit(None).cast("int").alias("notice"), F.lit("Go, Rust, go").alias("skills"))
    return profile.overridden(p, fixes).select("resume_id", "years", F.array_join("skills", ", ").alias("skills"), F.coalesce(F.array_join("overrides", "+"), F.lit("")).alias("overrides"))


@query("""WITH p AS (SELECT user_id % 5 AS job, event_type, count(*) FILTER (value > 50) AS done, count(*) AS total FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL
), j AS (SELECT job, sum((CASE event_type WHEN 'view' THEN 0.55e0 ELSE 0.45e0 END) * done / greatest(total, 1)) / sum(CASE event_type WHEN 'view' THEN 0.55e0 ELSE 0.45e0 END) * 100 AS share, min(done >= total) AS all_done, CAST(sum(done) AS BIGINT) AS done, CAST(sum(total) AS BIGINT) AS total FROM p GROUP BY job)
SELECT job, done, total, CASE WHEN all_done THEN 100 ELSE least(99, floor(share * 10 + 0.5) / 10) END AS percent FROM j""")
def progress_snapshot(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click"))
    p = e.groupBy((F.col("user_id") % 5).alias("job"), "event_type").agg(F.count_if(F.col("value") > 50).alias("done"), F.count("*").alias("total"))
    weight = F.when(F.col("event_type") == "view", progress.PHASE_WEIGHTS["phase1"]).otherwise(progress.PHASE_WEIGHTS["phase2"])
    return progress.snapshot(p.withColumn("weight", weight))


SQL_STEPS = """g AS (SELECT user_id % 5 AS job, CAST(round_even(epoch_us(ts) / 3.6e9 - 0.5, 0) AS BIGINT) AS hour, count(*) AS n FROM events GROUP BY ALL
), st AS (SELECT job, hour, CAST(sum(n) OVER (PARTITION BY job ORDER BY hour) AS DOUBLE) AS done, row_number() OVER (PARTITION BY job ORDER BY hour) AS i FROM g
), fold AS (SELECT job, i, hour, done, CAST(NULL AS DOUBLE) AS rate FROM st WHERE i = 1
    UNION ALL SELECT st.job, st.i, st.hour, st.done, CASE WHEN fold.rate IS NULL THEN (st.done - fold.done) / ((st.hour - fold.hour) * 3600e0) ELSE 0.65e0 * fold.rate + (1 - 0.65e0) * ((st.done - fold.done) / ((st.hour - fold.hour) * 3600e0)) END
    FROM fold JOIN st ON st.job = fold.job AND st.i = fold.i + 1
), ends AS (SELECT job, i AS steps, floor(rate * 1e6 + 0.5) / 1e6 AS rate, done FROM fold QUALIFY row_number() OVER (PARTITION BY job ORDER BY i DESC) = 1)"""


def _steps(spark, sf_dir):
    """Work done by the end of each hour, per job."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("job"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    steps = e.groupBy("job", F.floor(F.col("us") / 3.6e9).alias("hour")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("job").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select("job", (F.col("hour") * 3600.0).alias("t"), F.sum("n").over(upto).cast("double").alias("done"))


@query(f"WITH RECURSIVE {SQL_STEPS} SELECT job, steps, rate FROM ends")
def ema_rate(spark, sf_dir):
    return progress.smoothed_rates(_steps(spark, sf_dir)).select("job", "steps", (F.floor(F.col("rate") * 1e6 + 0.5) / 1e6).alias("rate"))


@query(f"WITH RECURSIVE {SQL_STEPS} SELECT job, steps, rate, done FROM ends")
def stream_rates(spark, sf_dir):
    """The same by keyed state: the steps come as files, a quarter of the time each, in four batches."""
    steps, folder = _steps(spark, sf_dir), files.shared_folder(spark, "rates")
    first, last = steps.agg(F.min("t"), F.max("t")).first()
    quarter = F.least(F.lit(3), F.floor((F.col("t") - (first or 0)) / (((last or 0) - (first or 0)) / 4 + 1)))
    for k in range(4):
        steps.where(quarter == k).coalesce(1).write.mode("append").parquet(f"{folder}/steps")
    stream = spark.readStream.schema(steps.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/steps")
    progress.stream_to(progress.streamed_rates(stream), f"{folder}/rates", f"{folder}/checkpoint")
    log = spark.read.option("basePath", f"{folder}/rates").parquet(f"{folder}/rates")
    last = log.groupBy("job").agg(F.max_by(F.struct("steps", "rate", "done"), "batch").alias("x"))
    return last.select("job", "x.steps", (F.floor(F.col("x.rate") * 1e6 + 0.5) / 1e6).alias("rate"), "x.done")


@query("""WITH p AS (SELECT user_id % 5 AS job, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS place, count(*) FILTER (value > 50) AS done, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL
), q AS (SELECT * EXCLUDE (n), CASE WHEN place = 1 AND job = 0 THEN done ELSE n END AS total FROM p), q1 AS (SELECT *, CASE place WHEN 1 THEN 0.55e0 ELSE 0.45e0 END AS weight, CASE WHEN job = 1 THEN NULL ELSE done / 3600e0 END AS rate, least(1e0, done / total) AS share FROM q WHERE total > 0
), f AS (SELECT job, sum(weight * share) AS reached, sum(weight) AS whole, min(CASE WHEN share < 1 THEN place END) AS place, sum(CASE WHEN done < total AND rate > 0 THEN (total - done) / rate END) AS remaining FROM q1 GROUP BY job)
SELECT f.job, CASE WHEN f.place IS NULL THEN 100e0 ELSE floor(reached / whole * 100 * 10 + 0.5) / 10 END AS percent, CASE f.place WHEN 1 THEN 'view' WHEN 2 THEN 'click' END AS phase, q.done AS phase_done, q.total AS phase_total, coalesce(floor(100 * q.done / q.total * 10 + 0.5) / 10, 100) AS phase_percent, floor(remaining * 10 + 0.5) / 10 AS seconds_left
FROM f LEFT JOIN q ON q.job = f.job AND q.place = f.place""")
def progress_outlook(spark, sf_dir):
    """Where each job stands, and how long it will take at the rates of its phases."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click"))
    p = e.groupBy((F.col("user_id") % 5).alias("job"), "event_type").agg(F.count_if(F.col("value") > 50).alias("done"), F.count("*").alias("total"))
    first = F.col("event_type") == "view"
    total = F.when(first & (F.col("job") == 0), F.col("done")).otherwise(F.col("total"))
    p = p.withColumns({"total": total, "place": F.when(first, 1).otherwise(2), "phase": F.col("event_type"), "weight": F.when(first, 0.55).otherwise(0.45), "rate": F.when(F.col("job") != 1, F.col("done") / 3600.0)})
    return progress.outlook(p)


@query("SELECT user_id, count(*) AS n, max(event_id) AS last_event, arg_max(event_type, event_id) AS last_type, arg_max(value, event_id) FILTER (value > 50) AS last_large FROM events GROUP BY user_id")
def stream_upsert(spark, sf_dir):
    """A table per user kept by micro-batches of event files: a count that grows, and of the other columns the newest value that isn't null."""
    events, folder = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), files.shared_folder(spark, "upsert")
    events.repartition(6, "event_id").write.parquet(f"{folder}/events")
    newest = F.col("last_event")

    def change(batch):
        large = F.when(F.col("value") > 50, F.struct("event_id", "value"))
        return batch.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"), F.max_by("event_type", "event_id").alias("last_type"), F.max(large).alias("large"))

    batches.run(spark, f"{folder}/events", events.schema, change, f"{folder}/log", f"{folder}/checkpoint", files=2)
    log = spark.read.option("basePath", f"{folder}/log").parquet(f"{folder}/log")
    # The value of a large event is the newest by the event's own number, not by that of the user's last one.
    found = batches.current(log.drop("large"), "user_id", newest, sums=("n",))
    large = log.groupBy("user_id").agg(F.max("large")["value"].alias("last_large"))
    return found.join(large, "user_id")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(spark, sf_dir):
    folder = files.shared_folder(spark, "daily")
    return progress.daily_counts(spark, f"{sf_dir}/event[s].parquet", f"{folder}/counts", f"{folder}/checkpoint")


def _spans(spark, sf_dir):
    """Each order is a page, so that pages don't grow with the table."""
    li = table(spark, sf_dir, "lineitem")
    side = F.when((F.col("l_orderkey") % 2 == 0) & (F.col("l_linenumber") % 2 == 0), 320.0).otherwise(40.0)
    x0 = side + F.col("l_quantity")
    return li.select(F.col("l_orderkey").alias("page"), (F.col("l_linenumber") * 12.0).alias("y"), x0.alias("x0"), (x0 + 100).alias("x1"), F.lit(600.0).alias("width"), F.concat_ws(" ", "l_partkey", "l_suppkey").alias("text"))


@query("""WITH s AS (SELECT l_orderkey AS page, CASE WHEN l_orderkey % 2 = 0 AND l_linenumber % 2 = 0 THEN 320 ELSE 40 END + l_quantity + 50 AS mid FROM lineitem
), h AS (SELECT page, floor(mid / 30) AS bin, count(*) AS n FROM s GROUP BY ALL
), p AS (SELECT page, CAST(sum(n) AS BIGINT) AS spans, coalesce(max(n) FILTER (bin < 10), 0) AS l, coalesce(max(n) FILTER (bin >= 10), 0) AS r FROM h GROUP BY page
), m AS (SELECT p.page, b, coalesce(n, 0) AS n FROM p CROSS JOIN range(6, 14) t(b) LEFT JOIN h ON h.page = p.page AND h.bin = b
), v AS (SELECT page, arg_min(b, n * 100 + b) AS b, min(n) AS n FROM m GROUP BY page
), g AS (SELECT page, count(*) FILTER (mid < (b + 0.5) * 30 - 12) AS l, count(*) FILTER (mid > (b + 0.5) * 30 + 12) AS r FROM s JOIN v USING (page) GROUP BY page
), f AS (SELECT page, spans, b, spans >= 8 AND p.l >= 3 AND p.r >= 3 AND v.n <= 0.45 * least(p.l, p.r) AND g.l >= 3 AND g.r >= 3 AS two_columns FROM p JOIN v USING (page) JOIN g USING (page)
) SELECT page, spans, two_columns, CASE WHEN two_columns THEN b END AS valley_bin FROM f""")
def column_split(spark, sf_dir):
    return layout.column_split(_spans(spark, sf_dir))


@query()
def line_cluster(spark, sf_dir):
    return layout.clustered_lines(_spans(spark, sf_dir))


@query()
def page_text(spark, sf_dir):
    """Pages as text, left columns before right ones; eight orders make a page, the spans of every second page stand in two columns."""
    return layout.reading_order(_pages(spark, sf_dir))


def _pages(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    page = F.floor(F.col("l_orderkey") / 32)
    x0 = F.when((page % 2 == 0) & (F.col("l_linenumber") % 2 == 0), 320.0).otherwise(40.0) + F.col("l_quantity")
    y = (F.col("l_orderkey") % 32 * 7 + F.col("l_linenumber")) * 6.0
    return li.select(page.alias("page"), y.alias("y"), x0.alias("x0"), (x0 + 100).alias("x1"), F.lit(600.0).alias("width"), F.concat_ws(" ", "l_partkey", "l_suppkey").alias("text"))


@query(r"""SELECT doc_id, regexp_replace(regexp_extract('a/b\c:d' || left(coalesce(text, ''), 30) || '.TXT', '([^/\\]*)$', 1), '[^\p{L}\p{N}._\- ()\[\]]', '_', 'g') AS name, doc_id % 4 <> 0 AS ok FROM documents""")
def upload_names(spark, sf_dir):
    """File names made safe, and whether their kind is one that is read."""
    name = F.concat(F.lit("a/b\\c:d"), F.left(F.coalesce("text", F.lit("")), F.lit(30)), F.lit(".TXT"))
    kind = F.when(F.col("doc_id") % 4 == 0, F.concat(name, F.lit(".exe"))).otherwise(name)
    return table(spark, sf_dir, "documents").select("doc_id", files.safe_name(name).alias("name"), files.supported(kind).alias("ok"))


@query("""SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN text ELSE 'caf' || chr(233) || ' ' || doc_id END) AS text FROM documents""")
def plain_decode(spark, sf_dir):
    """Bytes in two encodings: UTF-8 stays, what isn't valid UTF-8 is read as Latin-1."""
    latin = F.concat(F.lit(bytearray("café ".encode("latin-1"))), F.col("doc_id").cast("string").cast("binary"))
    content = F.when(F.col("doc_id") % 2 == 0, F.col("text").cast("binary")).otherwise(latin)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(files.decoded(content).cast("binary")).alias("text"))
