"""Queries over names and whole profiles by rules: guesses, votes, review, merges and how many come out right."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.functions import person
from rankweave.functions import text as T
from rankweave.operators import extraction, names, report
from rankweave.plans.catalog import query
from rankweave.plans.profile_queries import _SQL_LONG, _SQL_LOW, _SQL_TECH, _SQL_TOKEN, _SQL_WORD, _sql_list, _sql_prose
from rankweave.plans.ranking_queries import SQL_RANKED
from rankweave.plans.text_queries import AS_OF, SQL_WORKED, SQL_YEARS, _jobs
from rankweave.sources.views import SQL_R, resumes, scores, table

#: The résumés in eight forms: as they are; capitals under a title; bars; an address of one word under a portal's file; the name
#: deep in the text beside the address; another person's file; no name at all; a label, small letters and "City, State".
PEOPLE = """
SELECT resume_id, job_id, kind, person, CASE kind WHEN 1 THEN 'scan001.pdf' WHEN 3 THEN concat('Naukri_', f, l, '[3y_1m].pdf') WHEN 5 THEN 'Resume_Pat_Doe.pdf' WHEN 6 THEN 'document.pdf' ELSE filename END AS filename,
    CASE kind WHEN 1 THEN concat('CURRICULUM VITAE', chr(10), upper(person), chr(10), after)
        WHEN 2 THEN concat(person, ' | ', mail, ' | Pune', chr(10), body)
        WHEN 3 THEN concat(lower(f), lower(l), '7@example.com', chr(10), place, chr(10), body)
        WHEN 4 THEN concat(repeat(concat('Worked with the team on projects and reports.', chr(10)), 14), 'Contact', chr(10), person, chr(10), mail, chr(10), place, chr(10), body)
        WHEN 6 THEN concat('My novelties include hands-on experience with Python.', chr(10), place, chr(10), body)
        WHEN 7 THEN concat('Full Name: ', lower(person), chr(10), mail, chr(10), 'Springfield, IL', chr(10), body)
        ELSE raw_text END AS raw_text
FROM (
    SELECT *, split_part(person, ' ', 1) AS f, split_part(person, ' ', 2) AS l, split_part(split_part(raw_text, chr(10), 2), ' | ', 1) AS mail, split_part(raw_text, chr(10), 3) AS place,
        substr(raw_text, instr(raw_text, chr(10)) + 1) AS after, substr(raw_text, instr(raw_text, concat(chr(10), 'Experience')) + 1) AS body
    FROM (SELECT *, resume_id % 8 AS kind, split_part(raw_text, chr(10), 1) AS person FROM {resumes} r0) r1
) r2
"""
SQL_PEOPLE = f"{SQL_R}, q AS ({PEOPLE.format(resumes='r')})"
#: What is found where nothing but a line that looks like a name is there.
NO_PERSON = "Notice Period Days"
_DOUBT = f"'{names.DOUBTFUL[0]}{NO_PERSON}{names.DOUBTFUL[1]}heuristic{names.DOUBTFUL[2]}'"


def _people(spark, sf_dir):
    # Few bytes and much work: dealt out to more tasks than Spark would make of their size. The number of the join before would be no shuffle.
    n = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.sql(PEOPLE, resumes=resumes(spark, sf_dir)).repartition(n, "resume_id")


def _found(spark, sf_dir):
    return extraction.extracted(_people(spark, sf_dir), AS_OF)


@query(f"WITH {SQL_PEOPLE} SELECT resume_id, CASE WHEN kind IN (3, 6) THEN '{NO_PERSON}' ELSE person END AS guess FROM q")
def name_guess(spark, sf_dir):
    """The most name-like line near the address, in the header or among the first lines."""
    known = extraction.facts(_people(spark, sf_dir), AS_OF)
    return names.guessed(known, "resume_id")


@query(f"""WITH {SQL_PEOPLE} SELECT resume_id, CASE WHEN kind = 3 THEN f || lower(l) WHEN kind <> 6 THEN person END AS from_email, CASE kind WHEN 1 THEN NULL WHEN 5 THEN 'Pat Doe' WHEN 6 THEN NULL ELSE person END AS from_file
FROM (SELECT *, split_part(person, ' ', 1) AS f, split_part(person, ' ', 2) AS l FROM q)""")
def name_from_sources(spark, sf_dir):
    """Names that addresses and files' names hold."""
    email = T.first_email(F.col("raw_text"))
    return _people(spark, sf_dir).select("resume_id", person.name_of_mail(email).alias("from_email"), person.name_of_file(F.col("filename")).alias("from_file"))


@query(f"""WITH {SQL_PEOPLE} SELECT resume_id, CASE WHEN kind = 6 THEN '{NO_PERSON}' ELSE person END AS name, CASE WHEN kind = 6 THEN 'heuristic' WHEN kind = 3 THEN 'email+filename' WHEN kind IN (1, 5) THEN 'email+heuristic' ELSE 'email+filename+heuristic' END AS source,
    CASE WHEN kind = 6 THEN 56 WHEN kind IN (1, 5) THEN 120 ELSE 121 END AS score, CASE WHEN kind = 6 THEN 'medium' ELSE 'high' END AS confidence, CASE WHEN kind = 6 THEN {_DOUBT} END AS warning FROM q""")
def name_resolve(spark, sf_dir):
    """The name on which sources agree, or the fittest, with its score, how sure it is, and a warning."""
    return _resolved(spark, sf_dir).select("resume_id", "name", "source", "score", "confidence", "warning")


def _resolved(spark, sf_dir):
    known = extraction.facts(_people(spark, sf_dir), AS_OF).select("resume_id", "filename", "email", "lines")
    return names.resolved(names.with_guess(known).withColumn("said", F.lit(None).cast("string")), "resume_id")


@query(f"WITH {SQL_RANKED} SELECT k.job_id, resume_id, rank, filename, 'medium' AS confidence, {_DOUBT} AS warning FROM k JOIN r USING (resume_id) WHERE resume_id % 8 = 6")
def name_review_queue(spark, sf_dir):
    """Rows whose name needs a look, by doubt, missing support or form, shortlisted first."""
    n = _resolved(spark, sf_dir)
    ask = names.needs_review(F.col("name"), F.col("source"), F.col("confidence"), F.col("warning"))
    # Dealt out before the join: a sort reads its input twice, which would work out the names twice.
    asked = person.only(n, ask, "resume_id", "confidence", "warning").repartition("resume_id")
    found = report.results(resumes(spark, sf_dir), scores(spark, sf_dir)).join(asked, "resume_id")
    return found.orderBy(F.coalesce("rank", F.lit(9999)), "resume_id").select("job_id", "resume_id", "rank", "filename", "confidence", "warning")


@query(f"""WITH {SQL_PEOPLE} SELECT kind, count(*) AS cases, CAST(count(*) FILTER (kind = 6) AS BIGINT) AS wrong_name, CAST(count(*) FILTER (kind = 6) AS BIGINT) AS unsure, CAST(0 AS BIGINT) AS no_email, count(*) FILTER (kind <> 6) AS passed FROM q GROUP BY kind""")
def eval_golden(spark, sf_dir):
    """Per form of résumé how many names, grades and addresses come out as expected: the name of the first line, a high grade, an address that holds the name."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    want = _people(spark, sf_dir).select("resume_id", "kind", F.col("person").alias("expected"))
    both = _found(spark, sf_dir).select("resume_id", "name", "email", F.col("confidence")["name"].alias("sure")).join(want, "resume_id")
    wrong = plain(F.col("name")) != plain(F.col("expected"))
    unsure = F.coalesce(F.col("sure"), F.lit("low")) != "high"
    part = F.lower(F.split_part("expected", F.lit(" "), F.lit(1)))
    missing = (F.col("kind") != 6) & ~F.coalesce(F.contains(F.lower("email"), part), F.lit(False))
    return both.groupBy("kind").agg(F.count("*").alias("cases"), F.count_if(wrong).alias("wrong_name"), F.count_if(unsure).alias("unsure"), F.count_if(missing).alias("no_email"), F.count_if(~wrong & ~unsure & ~missing).alias("passed"))


def _sql_pairs(pairs: dict[str, str]) -> str:
    return "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN ({v}) IS NOT NULL THEN '{k}=' || ({v}) END" for k, v in pairs.items()) + "], lambda x: x IS NOT NULL)), ',')"


_SQL_PLACE = "CASE kind WHEN 2 THEN NULL WHEN 7 THEN 'Springfield, IL' ELSE regexp_extract(r.raw_text, 'Location: ([A-Za-z]+)', 1) END"


@query(rf"""WITH {SQL_PEOPLE}, {SQL_YEARS.removeprefix(SQL_R + ", ")}, h AS (
    SELECT q.resume_id, kind, CASE WHEN kind = 6 THEN '{NO_PERSON}' ELSE person END AS name, nullif(regexp_extract(q.raw_text, '{T.EMAIL}'), '') AS email, nullif(regexp_extract(q.raw_text, '[+]91 [0-9]+'), '') AS phone, {_SQL_PLACE} AS location,
        years, CAST(regexp_extract(r.raw_text, 'Notice period: ([0-9]+)', 1) AS INTEGER) AS notice, split_part(r.raw_text, chr(10), 5) AS work
    FROM q JOIN r USING (resume_id) JOIN z USING (resume_id)
) SELECT resume_id, name, email, phone, location, years, notice, 1 AS n_education, regexp_extract(work, 'Jan ([0-9]+)', 1) || '-' || regexp_extract(work, 'Mar ([0-9]+)', 1) AS first_range, 'header+experience+education+skills' AS hits,
    {_sql_pairs({"name": "CASE WHEN kind = 6 THEN 'medium' ELSE 'high' END", "email": "CASE WHEN email IS NOT NULL THEN 'high' END", "phone": "CASE WHEN phone IS NOT NULL THEN 'high' END", "location": "CASE WHEN location IS NOT NULL THEN 'medium' END", "total_years_experience": "'medium'", "education": "'medium'", "notice_period_days": "'high'"})} AS confidence,
    {_sql_pairs({"name": "CASE WHEN kind = 6 THEN 'heuristic' WHEN kind = 3 THEN 'email+filename' WHEN kind IN (1, 5) THEN 'email+heuristic' ELSE 'email+filename+heuristic' END", "email": "CASE WHEN email IS NOT NULL THEN 'regex' END", "phone": "CASE WHEN phone IS NOT NULL THEN 'regex' END", "location": "CASE WHEN location IS NOT NULL THEN 'heuristic' END", "total_years_experience": "'date_range'", "education": "'heuristic'", "notice_period_days": "'regex'"})} AS sources,
    CASE WHEN kind = 6 THEN {_DOUBT} ELSE '' END AS warnings FROM h""")
def hybrid_profile(spark, sf_dir):
    """Whole profiles by rules, with how sure each field is, where it comes from, and warnings."""
    shown = lambda c: F.array_join(F.transform(F.sort_array(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return _found(spark, sf_dir).select(
        "resume_id", "name", "email", "phone", "location", "years", "notice", F.size("education").alias("n_education"), F.try_element_at("date_ranges", F.lit(1))["duration"].alias("first_range"),
        F.array_join("section_hits", "+").alias("hits"), shown(F.col("confidence")).alias("confidence"), shown(F.col("sources")).alias("sources"), F.array_join("warnings", "; ").alias("warnings"),
    )


@query(rf"""WITH {SQL_PEOPLE} SELECT resume_id, CASE WHEN kind = 6 THEN '{NO_PERSON}' ELSE person END AS name, 'no_real_jobs' AS years_method, 0e0 AS years, CASE WHEN resume_id % 5 = 0 THEN 'low' ELSE 'medium' END AS overall FROM q""")
def hybrid_scorable(spark, sf_dir):
    """The same made fit for scoring without a model: date ranges of unread jobs don't count, the grade follows the text's quality."""
    quality = F.when(F.col("resume_id") % 5 == 0, "low").otherwise("high")
    return extraction.scorable(_found(spark, sf_dir), quality).select("resume_id", "name", "years_method", "years", "overall")


_MODEL = """SELECT resume_id, CASE resume_id % 4 WHEN 0 THEN person WHEN 1 THEN 'Python SQL' WHEN 2 THEN 'Robin Hale' END AS name, 'model@example.com' AS email, CAST(NULL AS STRING) AS phone,
    CASE resume_id % 3 WHEN 0 THEN ' Goa ' WHEN 1 THEN 'JavaScript, HTML' END AS location, 60 AS notice, CAST(NULL AS STRING) AS linkedin, CAST(NULL AS STRING) AS github, 'Reads and writes' AS summary FROM {people} q0 WHERE resume_id % 7 <> 0"""


@query(rf"""WITH {SQL_PEOPLE}, {SQL_WORKED}, m AS ({_MODEL.format(people="q")}), h AS (
    SELECT q.resume_id, kind, person, m.name AS said, nullif(regexp_extract(q.raw_text, '{T.EMAIL}'), '') AS r_email, m.email AS m_email, trim(m.location) AS m_place, {_SQL_PLACE} AS r_place, CAST(regexp_extract(r.raw_text, 'Notice period: ([0-9]+)', 1) AS INTEGER) AS notice, w.years, w.method
    FROM q JOIN r USING (resume_id) LEFT JOIN m USING (resume_id) LEFT JOIN worked w ON w.resume_id = q.resume_id AND q.resume_id % 2 = 1
), n AS (
    -- Of the forms, 3 and 6 have no line with the name; a model's other name is a source of its own, and so is the address that it gives to form 6.
    SELECT *, coalesce(said = person, false) AS agrees, coalesce(said = 'Robin Hale', false) AS other FROM h
) SELECT resume_id, CASE WHEN kind = 6 AND agrees THEN person WHEN kind = 6 AND other THEN 'Robin Hale' WHEN kind = 6 AND m_email IS NOT NULL THEN 'Model' WHEN kind = 6 THEN '{NO_PERSON}' ELSE person END AS name,
    coalesce(r_email, m_email) AS email, CASE WHEN m_place = 'Goa' THEN 'Goa' ELSE r_place END AS location, CASE WHEN m_place = 'Goa' THEN 'llm' WHEN r_place IS NOT NULL THEN 'heuristic' ELSE 'rejected_invalid' END AS place_source, notice,
    CASE WHEN years IS NULL THEN 0 ELSE least(round_even(years, 1), 50) END AS years, CASE WHEN years IS NULL THEN 'no_real_jobs' ELSE method END AS years_method FROM n""")
def profile_merged(spark, sf_dir):
    """Profiles by rules and a model's, merged: names voted on anew, places by plausibility, years by the jobs of the model's history."""
    people = _people(spark, sf_dir)
    none = F.array().cast("array<string>")
    schools = F.array().cast("array<struct<degree:string,field:string,institution:string,year:string>>")
    model = spark.sql(_MODEL, people=people).withColumns({"education": schools, "skills": F.array(F.lit("Reading")), "licenses": none, "certifications": none})
    jobs = _jobs(spark, sf_dir).where("resume_id % 2 = 1").drop("o_orderkey")
    out = extraction.merged(_found(spark, sf_dir), model, jobs, AS_OF, 5)
    return out.select("resume_id", "name", "email", "location", F.col("sources")["location"].alias("place_source"), "notice", "years", "years_method")


# The oracle of guesses over any text: the same steps as common table expressions.
def _sql_tests(source: str, name: str, prefix: str) -> str:
    """CTEs from source (with a column name) to {prefix}t, with fits (two to four words), alone (one word) and low (words for _sql_prose)."""
    bad = f"len(list_filter(ws, lambda x: {_SQL_TECH} OR lower(x) IN {_sql_list(person.NOISE)} OR lower(x) IN {_sql_list(person.PROSE)})) = 0"
    places = f"len(list_filter(ws, lambda x: lower(x) IN {_sql_list(person.PLACES)}))"
    return f"""{prefix}k AS (SELECT *, trim(coalesce({name}, '')) AS nm, array_to_string(list_filter(regexp_extract_all(coalesce({name}, ''), '{_SQL_WORD}'), lambda x: trim(lower(x), '-''') NOT IN {_sql_list(person.NOISE)}), ' ') AS kept FROM {source}
), {prefix}w AS (SELECT *, CASE WHEN kept = '' THEN nm ELSE kept END AS bare FROM {prefix}k
), {prefix}v AS (SELECT *, regexp_extract_all(bare, '{_SQL_LONG}') AS ws, regexp_extract_all(bare, '{_SQL_TOKEN}') AS toks, {_SQL_LOW.format("bare")} AS low, {_SQL_LOW.format("nm")} AS full_low FROM {prefix}w
), {prefix}x AS (SELECT *, len(list_filter(toks, lambda x: {_SQL_TECH})) AS tech FROM {prefix}v
), {prefix}y AS (SELECT *, length(nm) BETWEEN 3 AND 80 AND NOT regexp_matches(bare, '{person.NO_NAME}') AND NOT (tech >= 2 OR (tech = 1 AND len(toks) <= 2)) AND NOT {_sql_prose("low")} AND {bad} AS usable FROM {prefix}x
), {prefix}t AS (SELECT *, usable AND len(ws) BETWEEN 2 AND 4 AND {places} <= 1 AND len(ws) - {places} >= 2 AND len(list_filter(ws, lambda x: regexp_matches(x, '^[A-Z]'))) > 0 AS fits,
    usable AND len(ws) = 1 AND length(ws[1]) >= 5 AND {places} = 0 AND NOT (ws[1] = upper(ws[1]) AND length(ws[1]) <= 5) AS alone FROM {prefix}y)"""


_SQL_BLOCK = "list_filter(list_transform({}, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[1:12]"
_SQL_CASED = "array_to_string(list_transform({}, lambda w: CASE WHEN w = upper(w) OR w = lower(w) THEN array_to_string(list_transform(regexp_extract_all(w, '[A-Za-z]+|[^A-Za-z]+'), lambda y: upper(y[1]) || lower(y[2:])), '') ELSE w END), ' ')"


@query(rf"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, text, nullif(regexp_extract(text, '{T.EMAIL}'), '') AS email FROM documents
), b AS (SELECT doc_id, email, coalesce(list_position(list_transform(ls, lambda x: contains(lower(x), lower(email))), true), 0) AS spot, ls, coalesce(text, '') <> array_to_string(ls[1:25], chr(10)) AS more FROM d
), l AS (SELECT doc_id, email, list_concat(CASE WHEN spot > 0 THEN {_SQL_BLOCK.format("ls[greatest(1, spot - 5):spot + 1]")} ELSE [] END, {_SQL_BLOCK.format("ls[1:25]")}, CASE WHEN more THEN {_SQL_BLOCK.format("ls[1:8]")} ELSE [] END) AS rows FROM b
), e AS (SELECT doc_id, unnest(rows) AS raw, generate_subscripts(rows, 1) AS pos FROM l
), c AS (SELECT doc_id, pos, regexp_replace(regexp_replace(raw, '{names.LABEL}', ''), '^\s+|\s+$', '', 'g') AS line FROM e
), c2 AS (SELECT *, {_SQL_LOW.format("line")} AS line_low, regexp_extract_all(line, '{_SQL_TOKEN}') AS line_toks FROM c
), c3 AS (SELECT *, len(list_filter(line_toks, lambda x: {_SQL_TECH})) AS line_tech, regexp_extract_all(line, '{_SQL_LONG}') AS line_words, trim(regexp_extract(line, '^[^|•·,]*')) AS lft FROM c2
    WHERE length(line) <= 55 AND NOT regexp_matches(line, '{person.NO_NAME}') AND NOT {_sql_prose("line_low")}
), c4 AS (SELECT *, coalesce(nullif(array_to_string(list_filter(regexp_extract_all(lft, '{_SQL_WORD}'), lambda x: trim(lower(x), '-''') NOT IN {_sql_list(person.NOISE)}), ' '), ''), lft) AS part FROM c3 WHERE NOT (line_tech >= 2 OR (line_tech = 1 AND len(line_toks) <= 2))
), c5 AS (SELECT *, CASE WHEN regexp_matches(line, '{T.EMAIL}') THEN CASE WHEN NOT regexp_matches(part, '{T.EMAIL}') THEN part END WHEN regexp_matches(line, '{T.PHONE}') AND length(regexp_replace(line, '[^0-9]', '', 'g')) >= 10 THEN part
    WHEN len(line_words) BETWEEN 2 AND 3 AND length(line) < 48 AND NOT regexp_matches(line, '{names.JUNK}') THEN {_SQL_CASED.format("line_words")} END AS name FROM c4
), {_sql_tests("(SELECT * FROM c5 WHERE name <> '')", "name", "c")}, s AS (
    SELECT doc_id, pos, name, len(regexp_extract_all(name, '\S+')) AS n_words, 10 + CASE len(nw) WHEN 2 THEN 25 WHEN 3 THEN 15 WHEN 1 THEN 0 ELSE -5 END + CASE WHEN length(line) < 35 THEN 12 WHEN length(line) < 50 THEN 5 ELSE 0 END + CASE WHEN len(nw) > 0 AND len(list_filter(nw, lambda x: NOT regexp_matches(x, '^[A-Z]'))) = 0 THEN 10 ELSE 0 END
        + CASE WHEN line = upper(line) AND line <> lower(line) AND len(nw) BETWEEN 2 AND 3 THEN 8 ELSE 0 END + CASE WHEN regexp_matches(line, '[|•·]') THEN 6 ELSE 0 END - CASE WHEN {_sql_prose("full_low")} THEN 50 ELSE 0 END AS score
    FROM (SELECT *, regexp_extract_all(name, '{_SQL_LONG}') AS nw FROM ct WHERE fits)
), u AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, lower(name) ORDER BY pos) = 1
), g AS (SELECT doc_id, name AS found FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, n_words DESC, pos) = 1) WHERE score >= 20
), m AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(split_part(email, '@', 1), '[0-9._+\-]+', ' ', 'g')), ' '), lambda x: regexp_matches(x, '^[A-Za-z][A-Za-z]+$')) AS ms FROM d
), m2 AS (SELECT *, array_to_string(list_transform(ms[1:4], lambda x: upper(x[1]) || lower(x[2:])), ' ') AS joined, upper(ms[1][1]) || lower(ms[1][2:]) AS lone FROM m
), {_sql_tests("m2", "joined", "m")}, m3 AS (SELECT doc_id, fits, ms, CASE WHEN len(ms) >= 2 THEN CASE WHEN fits OR NOT (tech >= 2 OR (tech = 1 AND len(toks) <= 2)) THEN joined END WHEN len(ms) = 1 AND length(ms[1]) >= 5 AND NOT regexp_replace(lower(ms[1]), '[^a-z0-9]', '', 'g') IN {_sql_list(person.TECH_KEYS)} THEN lone END AS mailed FROM mt
), {_sql_tests("(SELECT doc_id, mailed FROM m3)", "mailed", "f")}
SELECT doc_id, coalesce(g.found, CASE WHEN ft.fits OR ft.alone THEN ft.mailed END) AS guess FROM ft LEFT JOIN g USING (doc_id)""")
def name_guess_documents(spark, sf_dir):
    """The same over any text: what looks most like a name in the first lines and around an address."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), T.first_email(text).alias("email"))
    header = F.array_join(F.slice(F.split("text", "\n"), 1, 25), "\n")
    return names.guessed(docs.select("doc_id", "email", names.lines_to_try(F.col("text"), header, F.col("email")).alias("lines")), "doc_id")
