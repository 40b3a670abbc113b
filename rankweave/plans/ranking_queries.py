"""Queries over scores, ranks, duplicates, state tables and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.functions.text import STOP_WORDS, TOKEN
from rankweave.operators import extraction, ranking, report, scoring, store
from rankweave.plans.catalog import query
from rankweave.sources.views import SQL_B, SQL_E, SQL_R, SQL_S, briefs, resumes, scores, table

STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def sql_tokens(text: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({text}, '{TOKEN}'), lambda x: lower(x)), lambda x: x NOT IN ({STOP}))"


SQL_ATS = f"""bt AS (
    SELECT job_id, token, count(*) AS tf, 1 + ln(1 + count(*)) AS weight FROM (SELECT job_id, unnest({sql_tokens("hiring_prompt")}) AS token FROM b) GROUP BY ALL
), bw AS (SELECT job_id, count(*) AS n_tokens, sum(weight) AS all_weight FROM bt GROUP BY job_id
), rt AS (SELECT DISTINCT resume_id, job_id, unnest({sql_tokens("raw_text")}) AS token FROM r
), ats AS (
    SELECT h.*, floor((60.0 * hits / n_tokens + 40.0 * weight / all_weight) * 100 + 0.5) / 100 AS ats
    FROM (SELECT job_id, resume_id, count(*) AS hits, sum(weight) AS weight FROM rt JOIN bt USING (job_id, token) GROUP BY ALL) h JOIN bw USING (job_id)
)"""


@query(f"""WITH {SQL_R}, {SQL_B}, {SQL_E}, {SQL_ATS}, f AS (
    SELECT ats.job_id, ats.resume_id, ats, sim, CASE WHEN resume_id % 9 = 0 THEN 0 ELSE 1 END AS hard_filter_pass,
        floor(greatest(0, least(100, (0.2e0 * ats + 0.3e0 * (sim * 100)) / 0.5e0)) * 100 + 0.5) / 100 AS final_score
    FROM ats JOIN e ON e.vec_id = resume_id % 500
), k AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY final_score DESC, resume_id) AS rank FROM f WHERE hard_filter_pass = 1)
SELECT job_id, resume_id, ats, sim, final_score, rank FROM k WHERE rank <= 5""")
def flagship_rank_shortlist(spark, sf_dir):
    """For one brief per job: score all résumés, rank them, give the shortlist."""
    b = briefs(spark).select(F.col("job_id").alias("brief"), "job_id", F.col("hiring_prompt").alias("prompt"))
    r = resumes(spark, sf_dir).select(F.col("resume_id").alias("doc"), "job_id", F.col("raw_text").alias("text"))
    ats = scoring.keyword_scores(r, b, on="job_id").select(F.col("brief").alias("job_id"), F.col("doc").alias("resume_id"), "ats", (F.col("doc") % 500).alias("vec_id"))
    similar = scoring.similarity_to(table(spark, sf_dir, "embeddings"), 0).select("vec_id", "sim")
    scored = ats.join(similar, "vec_id").withColumn("final_score", scoring.blend(F.col("ats"), F.col("sim"), F.lit(None).cast("double")))
    passed = scored.withColumn("hard_filter_pass", F.when(F.col("resume_id") % 9 == 0, 0).otherwise(1))
    ranked = ranking.with_ranks(passed)
    return ranked.where(ranking.shortlisted(5)).select("job_id", "resume_id", "ats", "sim", "final_score", "rank")


@query(f"""WITH bt AS (
    SELECT item_id, token, count(*) AS tf, 1 + ln(1 + count(*)) AS weight FROM (SELECT item_id, unnest({sql_tokens("text")}) AS token FROM benchmark) GROUP BY ALL
), bw AS (SELECT item_id, count(*) AS n_tokens, sum(weight) AS all_weight FROM bt GROUP BY ALL
), dt AS (SELECT DISTINCT doc_id, unnest({sql_tokens("text")}) AS token FROM documents
), h AS (SELECT item_id, doc_id, count(*) AS hits, sum(weight) AS weight FROM dt JOIN bt USING (token) GROUP BY ALL
), s AS (SELECT item_id, doc_id, hits, floor((60.0 * hits / n_tokens + 40.0 * weight / all_weight) * 100 + 0.5) / 100 AS ats FROM h JOIN bw USING (item_id))
SELECT item_id, doc_id, hits, ats, place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ats DESC, doc_id) AS place FROM s) WHERE place <= 3""")
def ats_topk_per_brief(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("brief"), F.col("text").alias("prompt"))
    from pyspark.sql import Window

    best = Window.partitionBy("brief").orderBy(F.desc("ats"), "doc")
    top = scoring.keyword_scores(docs, items).withColumn("place", F.row_number().over(best)).where("place <= 3")
    return top.select(F.col("brief").alias("item_id"), F.col("doc").alias("doc_id"), "hits", "ats", F.col("place").cast("long").alias("place"))


@query(f"WITH {SQL_E} SELECT vec_id, sim FROM e")
def cosine_to_query(spark, sf_dir):
    return scoring.similarity_to(table(spark, sf_dir, "embeddings"), 0).select("vec_id", "sim")


@query(f"WITH {SQL_E} SELECT vec_id, sim FROM e ORDER BY sim DESC, vec_id LIMIT 10")
def cosine_topk(spark, sf_dir):
    return cosine_to_query(spark, sf_dir).orderBy(F.desc("sim"), "vec_id").limit(10)


@query(f"WITH {SQL_E} SELECT label, count(*) AS n, max(sim) AS best, min(sim) AS worst FROM e JOIN embeddings USING (vec_id) GROUP BY label")
def cosine_by_label(spark, sf_dir):
    found = scoring.similarity_to(table(spark, sf_dir, "embeddings"), 0)
    return found.groupBy("label").agg(F.count("*").alias("n"), F.max("sim").alias("best"), F.min("sim").alias("worst"))


@query(f"""WITH {SQL_S} SELECT resume_id, CASE WHEN hard_filter_pass = 0 THEN 0e0
    WHEN llm_score IS NULL THEN floor(least(100e0, greatest(0e0, (0.2e0 * ats_score + 0.3e0 * (embedding_similarity * 100e0)) / (0.2e0 + 0.3e0))) * 100e0 + 0.5e0) / 100e0
    ELSE floor(least(100e0, greatest(0e0, (0.2e0 * ats_score + 0.3e0 * (embedding_similarity * 100e0) + 0.5e0 * (llm_score * 10e0)) / (0.2e0 + 0.3e0 + 0.5e0))) * 100e0 + 0.5e0) / 100e0 END AS final_score FROM s""")
def blend_scores(spark, sf_dir):
    """All rows: those that a hard filter rejects score 0, those without a model's score are blended of the rest."""
    blended = scoring.blend(F.col("ats_score"), F.col("embedding_similarity"), F.col("llm_score"))
    return scores(spark, sf_dir).select("resume_id", F.when(F.col("hard_filter_pass") == 0, 0.0).otherwise(blended).alias("final_score"))


#: Weights as texts, by order: numbers, zeros, words and negative ones.
_WEIGHTS = {c: f"CASE o_orderkey % {k} WHEN 0 THEN '0' WHEN 1 THEN '{w}' WHEN 2 THEN '-0.5' ELSE concat('', o_orderkey % 11) END" for c, k, w in (("a", 5, "x"), ("e", 7, "1e1"), ("m", 6, ""))}


@query(f"""SELECT o_orderkey, CASE WHEN t > 0 THEN floor(a / t * 1000000 + 0.5) / 1000000 ELSE 0.2 END AS ats, CASE WHEN t > 0 THEN floor(e / t * 1000000 + 0.5) / 1000000 ELSE 0.3 END AS embed,
    CASE WHEN t > 0 THEN floor(m / t * 1000000 + 0.5) / 1000000 ELSE 0.5 END AS llm
FROM (SELECT *, a + e + m AS t FROM (SELECT o_orderkey, {", ".join(f"TRY_CAST({w} AS DOUBLE) AS {c}" for c, w in _WEIGHTS.items())} FROM orders))""")
def weights_normalize(spark, sf_dir):
    """Weights of the three scores made to add up to 1; the usual ones where they can't be read or don't add up to anything."""
    w = table(spark, sf_dir, "orders").select("o_orderkey", *(F.expr(x).alias(c) for c, x in _WEIGHTS.items()))
    ats, embed, llm = scoring.normal_weights(F.col("a"), F.col("e"), F.col("m"))
    return w.select("o_orderkey", ats.alias("ats"), embed.alias("embed"), llm.alias("llm"))


def _sql_cascade(least: int) -> str:
    return f"""WITH {SQL_S}, m AS (SELECT *, coalesce(ats_score >= {least}, false) AS fits FROM s
), k AS (SELECT *, row_number() OVER (PARTITION BY job_id, fits ORDER BY ats_score DESC NULLS LAST, resume_id) AS place, bool_or(fits) OVER (PARTITION BY job_id) AS any_fits FROM m)
SELECT job_id, resume_id, ats_score, place FROM k WHERE place <= 20 AND fits = any_fits"""


@query(_sql_cascade(30))
def bulk_topk_threshold(spark, sf_dir):
    return ranking.cascade(scores(spark, sf_dir), 20, 30.0)


@query(_sql_cascade(1000))
def bulk_topk_fallback(spark, sf_dir):
    return ranking.cascade(scores(spark, sf_dir), 20, 1000.0)


SQL_RANKED = f"""{SQL_S}, k AS (
    SELECT *, CASE WHEN hard_filter_pass = 1 AND final_score IS NOT NULL THEN row_number() OVER (PARTITION BY job_id, hard_filter_pass = 1 AND final_score IS NOT NULL ORDER BY final_score DESC NULLS LAST, resume_id) END AS rank FROM s
)"""


@query(f"WITH {SQL_RANKED} SELECT resume_id, job_id, final_score, rank FROM k")
def assign_ranks(spark, sf_dir):
    return ranking.with_ranks(scores(spark, sf_dir)).select("resume_id", "job_id", "final_score", "rank")


@query(f"WITH {SQL_RANKED} SELECT r.resume_id, r.job_id, filename, hard_filter_pass, ats_score, llm_score, final_score, rank FROM r LEFT JOIN k USING (resume_id)")
def results_view(spark, sf_dir):
    found = report.results(resumes(spark, sf_dir), scores(spark, sf_dir))
    return found.select("resume_id", "job_id", "filename", "hard_filter_pass", "ats_score", "llm_score", "final_score", "rank")


@query(f"WITH {SQL_RANKED} SELECT job_id, resume_id, rank, final_score FROM k WHERE hard_filter_pass = 1 AND rank <= 5 AND coalesce(final_score, 0) >= 20")
def shortlist(spark, sf_dir):
    return ranking.with_ranks(scores(spark, sf_dir)).where(ranking.shortlisted(5, 20.0)).select("job_id", "resume_id", "rank", "final_score")


@query(f"WITH {SQL_S} SELECT resume_id, coalesce(final_score, 0) < 40 AS below FROM s")
def below_min(spark, sf_dir):
    return scores(spark, sf_dir).select("resume_id", ranking.below_least(40.0).alias("below"))


SQL_PEOPLE = f"""{SQL_S}, p AS (
    SELECT r.resume_id, r.job_id, nullif(lower(trim(regexp_extract(raw_text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{{2,}}'))), '') AS email,
        right(regexp_replace(regexp_extract(raw_text, '[+]91 [0-9]+'), '[^0-9]', '', 'g'), 10) AS phone, final_score
    FROM r LEFT JOIN s USING (resume_id)
)"""


def _sql_duplicates(key: str) -> str:
    return f"""SELECT job_id, resume_id, primary_id, group_size, '{key}' AS reason FROM (
    SELECT *, first_value(resume_id) OVER (PARTITION BY job_id, {key} ORDER BY coalesce(final_score, 0) DESC, resume_id) AS primary_id, count(*) OVER (PARTITION BY job_id, {key}) AS group_size FROM p WHERE {key} IS NOT NULL
) WHERE group_size > 1"""


def _people(spark, sf_dir):
    return ranking.contacts(resumes(spark, sf_dir)).join(scores(spark, sf_dir).select("resume_id", "final_score"), "resume_id", "left")


@query(f"WITH {SQL_PEOPLE} {_sql_duplicates('email')}")
def duplicates_email(spark, sf_dir):
    return ranking.duplicates_by(_people(spark, sf_dir), "email")


@query(f"WITH {SQL_PEOPLE} {_sql_duplicates('phone')}")
def duplicates_phone(spark, sf_dir):
    return ranking.duplicates_by(_people(spark, sf_dir), "phone")


@query(f"""WITH {SQL_PEOPLE}, u AS ({_sql_duplicates('email')} UNION ALL {_sql_duplicates('phone')})
SELECT job_id, resume_id, string_agg(DISTINCT reason, '+' ORDER BY reason) AS reasons, bool_or(primary_id <> resume_id) AS is_duplicate, max_by(primary_id = resume_id, reason) AS is_primary,
    min(CASE WHEN primary_id <> resume_id THEN primary_id END) AS duplicate_of FROM u GROUP BY job_id, resume_id""")
def duplicates_union(spark, sf_dir):
    return ranking.duplicates(_people(spark, sf_dir))


def _sql_prior(pool: str) -> str:
    return f"""WITH {SQL_PEOPLE}, o AS ({pool}), m AS (
    SELECT p.resume_id, p.job_id, o.resume_id AS other_id, o.job_id AS other_job, 'email' AS reason FROM p JOIN o ON p.email = o.email AND p.job_id <> o.job_id
    UNION ALL SELECT p.resume_id, p.job_id, o.resume_id, o.job_id, 'phone' FROM p JOIN o ON p.phone = o.phone AND p.job_id <> o.job_id
), g AS (SELECT resume_id, job_id, other_id, other_job, string_agg(DISTINCT reason, '+' ORDER BY reason) AS reasons FROM m GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY other_job DESC, other_id DESC) AS place FROM g) WHERE place <= 8"""


@query(_sql_prior("SELECT * FROM p"))
def cross_job_hits(spark, sf_dir):
    return ranking.prior_appearances(_people(spark, sf_dir))


@query(_sql_prior("SELECT * FROM p ORDER BY resume_id DESC LIMIT 800"))
def cross_job_hits_newest(spark, sf_dir):
    """The same among the 800 newest rows only, a limit that the feature has."""
    return ranking.prior_appearances(_people(spark, sf_dir), scan_limit=800)


@query(f"""WITH {SQL_RANKED} SELECT job_id, count(*) AS total, count(final_score) AS scored, count(*) FILTER (hard_filter_pass = 0) AS rejected, count(*) FILTER (final_score IS NULL) AS failed,
    count(*) FILTER (rank <= 5) AS shortlisted, coalesce(max(final_score), 0) AS top_score FROM k GROUP BY job_id""")
def export_stats(spark, sf_dir):
    return report.stats(report.results(resumes(spark, sf_dir), scores(spark, sf_dir)))


@query(f"WITH {SQL_S} SELECT count(*) AS total, count(final_score) AS scored, count(*) FILTER (hard_filter_pass = 0) AS rejected, coalesce(max(final_score), 0) AS top_score FROM s")
def ui_kpis(spark, sf_dir):
    return scores(spark, sf_dir).agg(F.count("*").alias("total"), F.count("final_score").alias("scored"), F.count_if(F.col("hard_filter_pass") == 0).alias("rejected"), F.coalesce(F.max("final_score"), F.lit(0.0)).alias("top_score"))


#: The part of a line that names the school.
SQL_SCHOOL = "trim(line[greatest(1, instr(line, 'University') - 20):], ' ,-|')"
SQL_EXPORT = f"""{SQL_RANKED}, x AS (
    SELECT r.job_id, rank, r.resume_id, split_part(raw_text, chr(10), 1) AS display_name, lower(regexp_extract(raw_text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{{2,}}')) AS email,
        regexp_extract(raw_text, 'Skills: (.*)$', 1) AS skills, {SQL_SCHOOL} AS education, final_score
    FROM (SELECT *, split_part(raw_text, chr(10), 8) AS line FROM r) r LEFT JOIN k USING (resume_id)
)"""


def _exported(spark, sf_dir):
    r = resumes(spark, sf_dir)
    found = extraction.extracted(r, 2026).withColumns({"skills": F.col("listed_skills"), "education": F.transform("education", lambda e: e["institution"])})
    return report.export_rows(report.results(r, scores(spark, sf_dir)), found)


@query(f"WITH {SQL_EXPORT} SELECT * FROM x")
def export_rows(spark, sf_dir):
    return _exported(spark, sf_dir)


CSV = ["resume_id", "display_name", "email", "skills"]


@query(f"""WITH {SQL_EXPORT} SELECT resume_id, '"' || resume_id || '","' || replace(display_name, '"', '""') || '","' || email || '","' || skills || '"' AS line FROM x""")
def csv_rows(spark, sf_dir):
    return report.csv_lines(_exported(spark, sf_dir), CSV)


@query(f"WITH {SQL_EXPORT} SELECT job_id, string_agg(rank || '. ' || display_name, chr(10) ORDER BY rank) AS report FROM x WHERE rank <= 5 GROUP BY job_id")
def markdown_rows(spark, sf_dir):
    return report.markdown(_exported(spark, sf_dir).where("rank <= 5"))


SQL_DELTA = f"""{SQL_S}, d AS (
    SELECT resume_id, job_id, hard_filter_pass, CASE WHEN resume_id % 40 = 0 THEN NULL ELSE ats_score + 1 END AS ats_score, CAST(NULL AS DOUBLE) AS llm_score, final_score FROM s WHERE resume_id % 20 = 0
    UNION ALL SELECT resume_id + 10000000, job_id, 1, 50e0, 5e0, 50e0 FROM s WHERE resume_id % 100 = 1
), o AS (SELECT resume_id, job_id, hard_filter_pass, ats_score, llm_score, final_score FROM s)"""


def _deltas(spark, sf_dir):
    old = scores(spark, sf_dir).select("resume_id", "job_id", "hard_filter_pass", "ats_score", "llm_score", "final_score")
    changed = old.where("resume_id % 20 = 0").withColumns({"ats_score": F.when(F.col("resume_id") % 40 != 0, F.col("ats_score") + 1), "llm_score": F.lit(None).cast("double")})
    added = old.where("resume_id % 100 = 1").select((F.col("resume_id") + 10000000).alias("resume_id"), "job_id", F.lit(1).alias("hard_filter_pass"), F.lit(50.0).alias("ats_score"), F.lit(5.0).alias("llm_score"), F.lit(50.0).alias("final_score"))
    return old, changed.unionByName(added)


@query(f"""WITH {SQL_DELTA} SELECT resume_id, coalesce(d.job_id, o.job_id) AS job_id, CASE WHEN d.resume_id IS NOT NULL THEN d.hard_filter_pass ELSE o.hard_filter_pass END AS hard_filter_pass,
    coalesce(d.ats_score, o.ats_score) AS ats_score, coalesce(d.llm_score, o.llm_score) AS llm_score, coalesce(d.final_score, o.final_score) AS final_score FROM o FULL JOIN d USING (resume_id)""")
def upsert_coalesce(spark, sf_dir):
    old, new = _deltas(spark, sf_dir)
    return store.upsert(old, new, "resume_id", always=("hard_filter_pass",))


@query(f"WITH {SQL_DELTA} SELECT * FROM d UNION ALL SELECT * FROM o WHERE resume_id NOT IN (SELECT resume_id FROM d)")
def upsert_force(spark, sf_dir):
    old, new = _deltas(spark, sf_dir)
    return store.upsert(old, new, "resume_id", force=True)


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def template_upsert(spark, sf_dir):
    """The last row written under each key."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id")
    return store.last_written(events, "user_id", "event_id")


@query(f"WITH {SQL_S} SELECT resume_id, 'pending' AS status, CAST(NULL AS DOUBLE) AS final_score FROM s WHERE final_score IS NULL UNION ALL SELECT resume_id, 'scored', final_score FROM s WHERE final_score IS NOT NULL")
def rerun_failed_set(spark, sf_dir):
    s = scores(spark, sf_dir).withColumn("status", F.when(F.col("final_score").isNull(), "failed").otherwise("scored"))
    again, kept = store.rerun_set(s, s)
    return again.unionByName(kept).select("resume_id", "status", "final_score")
