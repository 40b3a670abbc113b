"""Queries over prompts, caches, ids, stored documents, export packs and what hard filters search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankweave.functions import text as T
from rankweave.operators import extraction, layout, prompts, ranking, report, rules, store
from rankweave.operators import matching as M
from rankweave.plans import profile_queries as P
from rankweave.plans.catalog import query
from rankweave.plans.ranking_queries import SQL_PEOPLE, SQL_RANKED, _people
from rankweave.plans.text_queries import AS_OF, SQL_CLEAN, SQL_WORKED, _jobs
from rankweave.sources import files
from rankweave.sources.views import SQL_R, resumes, scores, table

#: The résumés with sections from empty to far over the budget.
LONG = """
SELECT resume_id, person, concat(person, chr(10), mail, chr(10), 'Experience', chr(10), repeat(concat(work, chr(10)), CAST(resume_id % 60 AS INTEGER)), 'Education', chr(10),
    repeat(concat(degree, chr(10)), CAST(resume_id % 31 AS INTEGER)), skills) AS raw_text
FROM (SELECT resume_id, split_part(raw_text, chr(10), 1) AS person, split_part(raw_text, chr(10), 2) AS mail, split_part(raw_text, chr(10), 5) AS work, split_part(raw_text, chr(10), 8) AS degree, split_part(raw_text, chr(10), 9) AS skills FROM {resumes} r0) r1
"""
_BUDGET = 2600
_NL = "chr(10) || chr(10)"


def _block(i: int, label: str, body: str) -> str:
    return f"SELECT resume_id, {i} AS i, '### {label}' || chr(10) || ({body})[1:{_BUDGET // 3}] AS block FROM v WHERE ({body}) <> ''"


@query(rf"""WITH {SQL_R}, v AS (SELECT l.resume_id, person, l.raw_text, split_part(r.raw_text, chr(10), 2) AS mail, rtrim(repeat(split_part(r.raw_text, chr(10), 5) || chr(10), CAST(resume_id % 60 AS INTEGER)), chr(10)) AS work,
    rtrim(repeat(split_part(r.raw_text, chr(10), 8) || chr(10), CAST(resume_id % 31 AS INTEGER)), chr(10)) AS school, replace(split_part(r.raw_text, chr(10), 9), 'Skills: ', '') AS skills FROM ({LONG.format(resumes="r")}) l JOIN r USING (resume_id)
), b AS ({" UNION ALL ".join((_block(1, "HEADER / CONTACT", "person || chr(10) || mail"), _block(2, "EXPERIENCE", "work"), _block(3, "EDUCATION", "school"), _block(4, "SKILLS", "skills")))}
), k AS (SELECT *, coalesce(sum(length(block)) OVER (PARTITION BY resume_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b
), s AS (SELECT resume_id, sum(length(block)) AS used, string_agg(block, {_NL} ORDER BY i) AS kept FROM k WHERE before < {_BUDGET} GROUP BY resume_id
), p AS (SELECT resume_id, '{prompts.FACTS}' || {_NL} || '{{' || chr(10) || '  "name": "' || person || '",' || chr(10) || '  "notice_period_days": ' || (resume_id % 90) || chr(10) || '}}' || {_NL} || {_NL} || kept
    || CASE WHEN used < 500 THEN {_NL} || '{prompts.WHOLE}' || {_NL} || raw_text[1:{_BUDGET}] WHEN used < {_BUDGET * 0.6} AND {_BUDGET} - used > 800 THEN {_NL} || '{prompts.MORE}' || {_NL} || raw_text[1:CAST({_BUDGET} - used AS INTEGER)] ELSE '' END AS prompt FROM s JOIN v USING (resume_id))
SELECT resume_id, length(prompt) AS n_chars, md5(prompt) AS prompt_md5 FROM p""")
def sectioned_prompt(spark, sf_dir):
    """What a model reads of each résumé: facts, then sections within a budget, the text where they are thin."""
    cut = layout.with_sections(spark.sql(LONG, resumes=resumes(spark, sf_dir))).withColumn("body", F.map_from_entries("parts"))
    facts = {"name": F.col("person"), "location": F.lit(None).cast("string"), "education": F.array().cast("array<string>"), "notice_period_days": F.col("resume_id") % 90}
    made = cut.select("resume_id", prompts.sectioned(F.col("body"), F.col("raw_text"), facts, _BUDGET).alias("prompt"))
    return made.select("resume_id", F.length("prompt").cast("long").alias("n_chars"), F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


@query("""WITH w AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS model, coalesce(text, '') AS text FROM documents), c AS (SELECT DISTINCT text FROM w WHERE doc_id % 6 = 0)
SELECT doc_id, CASE WHEN model = 'even' AND text IN (SELECT text FROM c) THEN -1e0 ELSE CAST(length(text) AS DOUBLE) END AS first FROM w""")
def embedding_cache(spark, sf_dir):
    """Vectors of all texts under two models; those in the cache, of one model, come from there, the others are computed once per key."""
    wanted = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("model"), F.coalesce("text", F.lit("")).alias("text"))
    cache = wanted.where("doc_id % 6 = 0").select(store.cache_key(F.col("model"), F.col("text")).alias("key"), "model", F.array(F.lit(-1.0)).alias("embedding")).dropDuplicates(["key"])
    found, _ = store.embedded(wanted, cache, lambda rows: rows.select("key", F.array(F.length("text").cast("double")).alias("embedding")))
    return found.select("doc_id", F.col("embedding")[0].alias("first"))


@query("SELECT count(*) AS n, (SELECT max(c_custkey) FROM customer) + 1 AS first_id, (SELECT max(c_custkey) FROM customer) + count(*) AS last_id, count(*) AS ids, true AS same_again FROM orders")
def insert_ids(spark, sf_dir):
    """Ids of new rows, without gaps after those that are there, and the same when it is done again from other partitions."""
    new, old = table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    once, again = store.numbered(new, "o_orderkey", "id", old), store.numbered(new.repartition(5), "o_orderkey", "id", old)
    both = once.join(again.select("o_orderkey", F.col("id").alias("other")), "o_orderkey")
    return both.agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.countDistinct("id").alias("ids"), F.bool_and(F.col("id") == F.col("other")).alias("same_again"))


@query("""WITH n AS (SELECT doc_id, doc_id % 5 AS job, 'cv_' || (doc_id % 300) || '.pdf' AS name FROM documents)
SELECT doc_id, job, CASE WHEN doc_id % 300 < 20 OR row_number() OVER (PARTITION BY job, name ORDER BY doc_id) > 1 THEN sha256(job || '|' || doc_id || '|' || name)[1:8] || '_' || name ELSE name END AS name FROM n""")
def upload_collisions(spark, sf_dir):
    """Names of new files beside those of earlier ones."""
    name = F.concat(F.lit("cv_"), F.col("doc_id") % 300, F.lit(".pdf"))
    new = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 5).alias("job"), name.alias("name"))
    return store.without_collisions(new, new.where("doc_id % 300 < 20").select("job", "name"), "job", "name", "doc_id")




def _cleaned(text: str) -> str:
    return "md5(" + SQL_CLEAN.format(f"coalesce({text}, '')") + ")"



@query(f"""SELECT CAST(doc_id AS VARCHAR) AS path, CASE doc_id % 5 WHEN 0 THEN 'cached' WHEN 1 THEN 'read' WHEN 2 THEN 'read' WHEN 3 THEN 'cached_text' ELSE 'read' END AS method,
    CASE doc_id % 5 WHEN 0 THEN {_cleaned("'stored ' || text")} WHEN 3 THEN {_cleaned("'stored ' || text")} ELSE {_cleaned("text")} END AS text, CASE doc_id % 5 WHEN 1 THEN 2 WHEN 4 THEN 1 ELSE 1 END AS modified FROM documents WHERE text IS NOT NULL AND text <> ''""")
def document_reads(spark, sf_dir):
    """Files that haven't changed, are newer, are new, are gone, or have another length, against what an earlier read stored."""
    d, k = table(spark, sf_dir, "documents").where("text <> ''"), F.col("doc_id") % 5
    path = F.col("doc_id").cast("string").alias("path")
    listing = d.where(k != 3).select(path, path.alias("name"), F.when(k == 1, 2).otherwise(1).alias("modified"), F.length("text").alias("length"), "text")
    stored = d.where(k != 2).select(path, F.lit(1).alias("modified"), (F.length("text") + F.when(k == 4, 1).otherwise(0)).alias("length"), F.concat(F.lit("stored "), "text").alias("text"))
    return files.documents(listing, stored).select("path", "method", F.md5(F.col("text").cast("binary")).alias("text"), "modified")


def _pack_rows(spark, sf_dir):
    """The results with what an export pack asks of them."""
    people, rid = _people(spark, sf_dir), F.col("resume_id")
    twice = ranking.duplicates(people).select("resume_id", "is_duplicate")
    seen = ranking.prior_appearances(people).groupBy("resume_id").agg(F.sort_array(F.collect_list("other_id")).alias("appearances"))
    view = report.results(resumes(spark, sf_dir), scores(spark, sf_dir)).join(people.select("resume_id", "email"), "resume_id")
    rows = view.join(twice, "resume_id", "left").join(seen, "resume_id", "left")
    return rows.withColumns(
        {
            "display_name": F.col("filename"),
            "shortlisted": F.coalesce(F.col("rank") <= 5, F.lit(False)),
            "hr_status": F.when(rid % 10 == 1, "starred").when(rid % 10 == 2, "rejected"),
            "status": F.when(F.col("final_score").isNull(), "failed").when(F.col("hard_filter_pass") == 0, "rejected").otherwise("scored"),
            "needs_review": rid % 8 == 6,
            "name_confidence": F.lit("medium"),
            "name_source": F.lit("heuristic"),
            "appearances": F.coalesce("appearances", F.array().cast("array<bigint>")),
        }
    )


SQL_PACK = f"""{SQL_PEOPLE}, k AS ({SQL_RANKED.split("k AS (", 1)[1].rsplit(")", 1)[0]}), x AS (
    SELECT r.job_id, r.resume_id, k.rank, k.hard_filter_pass, k.final_score, coalesce(k.rank <= 5, false) AS shortlisted, r.resume_id % 10 AS hr, r.resume_id % 8 = 6 AS review,
        EXISTS (SELECT 1 FROM p a JOIN p b ON a.job_id <> b.job_id AND (a.email = b.email OR a.phone = b.phone) WHERE a.resume_id = r.resume_id) AS elsewhere,
        coalesce(e.first_id <> r.resume_id AND e.n > 1, false) OR coalesce(f.first_id <> r.resume_id AND f.n > 1, false) AS duplicate
    FROM r LEFT JOIN k USING (resume_id)
    LEFT JOIN (SELECT resume_id, count(*) OVER w AS n, first_value(resume_id) OVER (w ORDER BY coalesce(final_score, 0) DESC, resume_id) AS first_id FROM p WHERE email IS NOT NULL WINDOW w AS (PARTITION BY job_id, email)) e ON e.resume_id = r.resume_id
    LEFT JOIN (SELECT resume_id, count(*) OVER w AS n, first_value(resume_id) OVER (w ORDER BY coalesce(final_score, 0) DESC, resume_id) AS first_id FROM p WHERE phone IS NOT NULL WINDOW w AS (PARTITION BY job_id, phone)) f ON f.resume_id = r.resume_id
)"""


@query(f"""WITH {SQL_PACK}, t AS (SELECT job_id, resume_id, rank, 'all_ranked' AS section FROM x UNION ALL SELECT job_id, resume_id, rank, 'shortlist' FROM x WHERE shortlisted UNION ALL SELECT job_id, resume_id, rank, 'starred' FROM x WHERE hr = 1
    UNION ALL SELECT job_id, resume_id, rank, 'rejected_by_hr' FROM x WHERE hr = 2 UNION ALL SELECT job_id, resume_id, rank, 'name_review_queue' FROM x WHERE review AND hard_filter_pass = 1 UNION ALL SELECT job_id, resume_id, rank, 'cross_job_hits' FROM x WHERE elsewhere)
SELECT job_id, section, resume_id, coalesce(rank, 2147483648) AS place FROM t""")
def export_pack(spark, sf_dir):
    """The rows of an export pack by section, as their JSON lines tell them."""
    found = report.pack(_pack_rows(spark, sf_dir))
    return found.select("job_id", "section", F.get_json_object("line", "$.resume_id").cast("long").alias("resume_id"), F.col("place.rank").cast("long").alias("place"))


@query(f"""WITH {SQL_PACK} SELECT job_id, count(*) AS total, count(*) FILTER (hard_filter_pass = 1) AS scored, count(*) FILTER (shortlisted) AS shortlisted, count(*) FILTER (final_score IS NOT NULL AND hard_filter_pass = 0) AS rejected, count(*) FILTER (final_score IS NULL) AS failed,
    count(*) FILTER (duplicate) AS duplicates, count(*) FILTER (elsewhere) AS seen_elsewhere, count(*) FILTER (review) AS name_review, count(*) FILTER (hr = 1) AS starred FROM x GROUP BY job_id""")
def export_head(spark, sf_dir):
    """The figures at the head of an export pack."""
    return report.pack_stats(_pack_rows(spark, sf_dir))


@query(f"WITH {P.SQL_P} SELECT resume_id, resume_id % 7 = 0 AS by_certificate, resume_id % 5 = 0 AS by_licence, resume_id % 4 = 1 AS by_school, resume_id % 3 <> 0 AS by_summary FROM p")
def rule_composed(spark, sf_dir):
    """Rules that search beside their own field: licences also certificates and schools, certificates licences, skills the summary."""
    p = P._profiles(spark, sf_dir).withColumn("notice", F.lit(None).cast("int"))
    fields = M.rule_fields(P._fields() | {"notice": F.col("notice")})
    cases = {"by_certificate": ("licences", "PMP"), "by_licence": ("certs", "RN"), "by_school": ("license", "Marketing"), "by_summary": ("skill", "Works")}
    return p.select("resume_id", *(rules.passed({"field": f, "operator": "contains", "value": v}, fields).alias(n) for n, (f, v) in cases.items()))


_RULES = [{"field": "years", "operator": "gte", "value": 4}, {"field": "notice", "operator": "lte", "value": 30}, {"field": "location", "operator": "eq", "value": "Goa"}, {"field": "years", "operator": "lte", "value": "few"}]


@query(f"""WITH {P.SQL_P} SELECT resume_id, CASE WHEN years >= 4 THEN 'years=' || years || ' ≥ 4.0' ELSE 'years=' || years || ' is below required 4.0' END AS years,
    'notice unknown — skipped (not auto-rejected)' AS notice, 'location=' || location || ' does not match ''Goa''' AS location, 'Rule error: ''few'' is no number' AS unreadable, CASE WHEN location = '' THEN 0 ELSE 1 END AS n_seen FROM p""")
def rule_messages(spark, sf_dir):
    """Why rules pass or fail, in words, and how much they looked at."""
    p = P._profiles(spark, sf_dir).withColumn("notice", F.lit(None).cast("int"))
    fields = M.rule_fields(P._fields() | {"notice": F.col("notice")})
    told = p.select("resume_id", rules.explained(_RULES, fields).alias("r"))
    return told.select("resume_id", *(F.col("r")[i]["reason"].alias(n) for i, n in enumerate(("years", "notice", "location", "unreadable"))), F.size(F.col("r")[2]["actual"]).alias("n_seen"))


@query(rf"""WITH {SQL_R} SELECT resume_id, concat_ws('+', CASE WHEN resume_id % 60 <> 0 THEN 'experience' END, CASE WHEN resume_id % 31 <> 0 THEN 'education' END, 'skills') AS hits FROM r""")
def section_hits(spark, sf_dir):
    """Sections that hold text, of résumés some of whose sections are empty."""
    found = M.section_hits(layout.sections(spark.sql(LONG, resumes=resumes(spark, sf_dir))), "resume_id")
    return found.select("resume_id", F.array_join("hits", "+").alias("hits"))


@query(f"""WITH {SQL_PACK} SELECT count(*) AS total, count(*) FILTER (hard_filter_pass = 1) AS scored, count(*) FILTER (shortlisted) AS shortlisted, count(*) FILTER (final_score IS NOT NULL AND hard_filter_pass = 0) AS rejected, count(*) FILTER (final_score IS NULL) AS failed,
    count(*) FILTER (duplicate) AS duplicates, coalesce(max(final_score), 0) AS top_score FROM x""")
def ui_figures(spark, sf_dir):
    """The figures over all jobs that a start page shows."""
    rows, yes = _pack_rows(spark, sf_dir), lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return rows.agg(
        F.count("*").alias("total"), yes(F.col("hard_filter_pass") == 1).alias("scored"), yes(F.col("shortlisted")).alias("shortlisted"), yes(F.col("status") == "rejected").alias("rejected"), yes(F.col("status") == "failed").alias("failed"),
        yes(F.col("is_duplicate")).alias("duplicates"), F.coalesce(F.max("final_score"), F.lit(0.0)).alias("top_score"),
    )


def _table_rows(spark, sf_dir):
    scored = scores(spark, sf_dir).select("resume_id", "ats_score", "embedding_similarity", "llm_score")
    rows = _pack_rows(spark, sf_dir).drop("ats_score", "embedding_similarity", "llm_score").join(scored, "resume_id", "left")
    why = F.when(F.col("resume_id") % 3 == 0, 'fits, "well"').when(F.col("resume_id") % 3 == 1, "two\nlines")
    return rows.withColumns({"why": why, "matched": F.array(F.lit("a"), F.lit("b")), "missing": F.array().cast("array<string>")})


_Q = "chr(34)"


@query(f"""WITH {SQL_PACK} SELECT job_id, x.resume_id, coalesce(CASE WHEN x.hard_filter_pass = 1 THEN rank || '' END, '') || ',' || CASE WHEN shortlisted THEN 'Yes' ELSE 'No' END || ',' || filename || ',' || filename || ',medium,' || CASE WHEN duplicate THEN 'Yes' ELSE 'No' END || ','
    || CASE WHEN x.final_score IS NULL THEN 'failed' WHEN x.hard_filter_pass = 0 THEN 'rejected' ELSE 'scored' END || ',' || coalesce(x.final_score || '', '') || ',' || coalesce(s.ats_score || '', '') || ',' || coalesce(s.embedding_similarity || '', '') || ',' || coalesce(s.llm_score || '', '') || ','
    || CASE x.resume_id % 3 WHEN 0 THEN {_Q} || 'fits, ' || {_Q} || {_Q} || 'well' || {_Q} || {_Q} || {_Q} WHEN 1 THEN {_Q} || 'two' || chr(10) || 'lines' || {_Q} ELSE '' END || ',a; b,' AS line
FROM x JOIN (SELECT resume_id, filename FROM r) USING (resume_id) LEFT JOIN (SELECT resume_id, ats_score, embedding_similarity, llm_score FROM s) s ON s.resume_id = x.resume_id WHERE shortlisted""")
def csv_shortlist(spark, sf_dir):
    """The shortlist as CSV lines of fourteen columns."""
    return report.csv_table(_table_rows(spark, sf_dir), shortlist_only=True)


@query(f"WITH {SQL_RANKED} SELECT r.resume_id, r.job_id, final_score, row_number() OVER (PARTITION BY r.job_id ORDER BY final_score DESC NULLS LAST, r.resume_id) AS place FROM r LEFT JOIN k USING (resume_id) WHERE r.job_id = 2")
def results_of_job(spark, sf_dir):
    """One job's results as they are shown: best first, those without a score last, then by id."""
    shown = report.in_order(report.results(resumes(spark, sf_dir), scores(spark, sf_dir)).where("job_id = 2"))
    order = Window.partitionBy("job_id").orderBy(F.col("final_score").desc_nulls_last(), "resume_id")
    return shown.select("resume_id", "job_id", "final_score", F.row_number().over(order).cast("long").alias("place"))


@query(f"""WITH {SQL_RANKED}, t AS (SELECT r.resume_id, r.job_id, filename, rank, final_score, len(regexp_extract_all(r.raw_text, 'Excel')) > 0 AS wanted FROM r LEFT JOIN k USING (resume_id)) SELECT resume_id, job_id, filename, rank, final_score FROM t WHERE wanted""")
def results_by_ids(spark, sf_dir):
    """The results of a list of ids, here those of all who name a skill."""
    wanted = resumes(spark, sf_dir).where(F.contains("raw_text", F.lit("Excel"))).select("resume_id")
    view = report.results(resumes(spark, sf_dir), scores(spark, sf_dir))
    return view.join(wanted, "resume_id", "left_semi").select("resume_id", "job_id", "filename", "rank", "final_score")


_STORED = """CASE doc_id % 4 WHEN 0 THEN concat('{"name": "Ann ', doc_id, '", "years": ', doc_id % 30, '}') WHEN 1 THEN '{"name": ' WHEN 2 THEN NULL ELSE concat('{"years": ', doc_id % 30, '}') END"""


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Ann ' || doc_id WHEN 3 THEN NULL ELSE 'nobody' END AS name, CASE WHEN doc_id % 4 IN (0, 3) THEN CAST(doc_id % 30 AS DOUBLE) ELSE -1 END AS years FROM documents""")
def stored_json(spark, sf_dir):
    """Stored JSON columns as values; what is missing or broken takes the default."""
    default = F.struct(F.lit("nobody").alias("name"), F.lit(-1.0).alias("years"))
    value = M.decoded_json(F.expr(_STORED), "name string, years double", default)
    return table(spark, sf_dir, "documents").select("doc_id", value.alias("v")).select("doc_id", "v.*")


@query("SELECT doc_id, concat('source=', source, ',text=', length(coalesce(text, ''))) AS shown FROM documents")
def public_profile(spark, sf_dir):
    """What users may see of a profile with inner fields."""
    fields = {"source": F.col("source"), "text": F.length(F.coalesce("text", F.lit(""))).cast("string"), "_confidence": F.lit("high"), "_sources": F.col("lang")}
    whole = F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), v)))
    shown = F.transform(F.sort_array(F.map_entries(M.public_part(whole))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(shown, ",").alias("shown"))


@query(rf"""WITH t AS (SELECT doc_id, 'x ' || replace(coalesce(text, ''), chr(10), chr(10) || 'x ') || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Skills: a' || chr(10) || '  ' ELSE '' END AS t, doc_id % 2 = 0 AS listed FROM documents
), l AS (SELECT *, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM t)
SELECT doc_id, length(regexp_replace(t, '\s', '', 'g')) AS chars, CAST(listed AS BIGINT) AS section_count, regexp_matches(t[1:2500], '{T.EMAIL}') AS has_email,
    len(list_filter(ls[1:40], lambda x: length(x) < 12)) / greatest(least(len(ls), 40), 1) AS short_line_ratio, coalesce(list_sum(list_transform(ls[1:50], lambda x: length(x))), 0) / greatest(least(len(ls), 50), 1) AS avg_line_len, len(ls) AS line_count FROM l""")
def parse_signals(spark, sf_dir):
    """What tells whether a text was read well."""
    marked = F.regexp_replace(F.concat(F.lit("x "), F.coalesce("text", F.lit(""))), "\n", "\nx ")
    t = table(spark, sf_dir, "documents").select("doc_id", F.concat(marked, F.when(F.col("doc_id") % 2 == 0, "\nSkills: a\n  ").otherwise("")).alias("text"))
    cut, start = layout.with_sections(t, "text"), F.left("text", F.lit(2500))
    found = cut.select("doc_id", M.quality_signals(F.col("text"), F.col("parts"), T.first_phone(start), T.first_email(start)).alias("s"))
    return found.select("doc_id", "s.*").drop("has_phone")


@query(f"""WITH {P.SQL_P}, {SQL_WORKED} SELECT p.resume_id, CASE WHEN p.resume_id % 10 = 0 THEN 50 WHEN w.years IS NULL THEN 0 ELSE least(round_even(w.years, 1), 50) END AS years, CASE WHEN p.resume_id % 10 = 0 THEN 'recruiter_override' WHEN w.years IS NULL THEN 'no_real_jobs' ELSE w.method END AS years_method,
    CASE WHEN p.resume_id % 10 = 0 THEN 'Go, Rust' ELSE CASE p.resume_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'Python' WHEN 2 THEN 'Python, SQL' ELSE 'Sales, CRM, Excel, Python, SQL' END END AS skills, CASE WHEN p.resume_id % 10 = 0 THEN 2 ELSE 0 END AS n_changed
FROM p LEFT JOIN worked w USING (resume_id)""")
def corrections(spark, sf_dir):
    """Profiles with corrections by hand, and their years decided again from the jobs."""
    none = F.lit(None).cast("string")
    maps = F.create_map().cast("map<string,string>")
    given = P._profiles(spark, sf_dir).withColumns({"email": none, "phone": none, "notice": F.lit(None).cast("int"), "confidence": maps, "sources": maps})
    fixes = given.where("resume_id % 10 = 0").select("resume_id", F.create_map(F.lit("years"), F.lit("99"), F.lit("skills"), F.lit("Go, Rust, go")).alias("fixes"))
    out = extraction.corrected(given, fixes, _jobs(spark, sf_dir).drop("o_orderkey"), AS_OF, 5)
    return out.select("resume_id", "years", "years_method", F.array_join("skills", ", ").alias("skills"), F.size("overrides").alias("n_changed"))
