"""Input tables and the résumé, brief and score views that are derived from them.

The views are plain SELECTs over the test tables, so that the same text runs in Spark and in the oracle database.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FIRST = "Asha Ravi Meera Arjun Priya Kabir Neha Rohan Alice James Maria".split()
LAST = "Sharma Verma Okafor Chen Martinez Nair Gupta Iyer Lopez Kumar Singh Novak Silva".split()
CITIES = "Pune Mumbai Delhi Chennai Noida".split()
TITLES = ["Analyst", "Sales Manager", "Staff Nurse"]
DEGREES = ["B.Tech Computer Science", "MBA Marketing", "B.Com Finance", "M.Sc Nursing", "Diploma Mechanical"]
SKILLS = ["Python, SQL, Excel", "Sales, CRM, Negotiation", "Nursing, Triage, ICU", "Java, Spring Boot, AWS", "Accounting, SAP, Excel", "React, TypeScript, CSS", "Logistics, Warehouse, Forklift"]


def _pick(key: str, values: list[str]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


RESUMES = f"""
SELECT c_custkey AS resume_id, CAST(c_nationkey % 5 AS BIGINT) AS job_id,
    concat('Resume_', f, '_', l, '.pdf') AS filename,
    concat(f, ' ', l, chr(10),
        lower(f), '.', lower(l), c_custkey % 715, '@example.com | +91 98', lpad(concat('', c_custkey % 983), 8, '0'), chr(10),
        'Location: ', {_pick("c_nationkey", CITIES)}, chr(10),
        'Experience', chr(10),
        {_pick("c_custkey", TITLES)}, ' at Unit ', c_nationkey, ' Jan ', y0, ' - Mar ', y1, chr(10),
        'Notice period: ', 15 * (c_custkey % 5), ' days', chr(10),
        'Education', chr(10),
        {_pick("c_custkey", DEGREES)}, ', State University ', y0 - 1, chr(10),
        'Skills: ', {_pick("c_custkey", SKILLS)}) AS raw_text
FROM (
    SELECT c_custkey, c_nationkey, {_pick("c_custkey", FIRST)} AS f, {_pick("c_custkey", LAST)} AS l, y0, y1
    FROM {{customer}} JOIN (SELECT o_custkey, min(year(o_orderdate)) AS y0, max(year(o_orderdate)) AS y1 FROM {{orders}} GROUP BY o_custkey) o ON c_custkey = o_custkey
) named
"""

BRIEFS = """
SELECT CAST(job_id AS BIGINT) AS job_id, replace(hiring_prompt, '|', chr(10)) AS hiring_prompt FROM (VALUES
    (0, 'Senior data analyst in Pune with 3+ years of experience.|- Python and SQL reporting|- Excel dashboards|Required: python, sql and excel.|B.Tech degree or certification preferred.'),
    (1, 'Sales manager, Mumbai, on-site.|* CRM pipeline ownership|* Negotiation with key accounts|Must-haves: sales, crm; negotiation|MBA or diploma.'),
    (2, 'Staff nurse for the Delhi unit, 2 years of ICU work.|1. Triage in emergency|2. ICU monitoring|Need: nursing, triage and icu|RN license is essential.'),
    (3, 'Short brief: java developer'),
    (4, 'Warehouse lead in Noida looking for: logistics, forklift and warehouse skills. Entry-level or junior welcome, hybrid shifts, any graduate degree.')
) AS b(job_id, hiring_prompt)
"""

#: s is a résumé row; the similarity to vector 0 comes from the embeddings of the same remainder.
SCORES = """
SELECT resume_id, job_id, hard_filter_pass, ats_score, embedding_similarity, llm_score,
    CASE WHEN resume_id % 50 = 0 THEN CAST(NULL AS DOUBLE) WHEN hard_filter_pass = 0 THEN 0e0
        WHEN llm_score IS NULL THEN floor(least(100e0, greatest(0e0, (0.2e0 * ats_score + 0.3e0 * (embedding_similarity * 100e0)) / (0.2e0 + 0.3e0))) * 100e0 + 0.5e0) / 100e0
        ELSE floor(least(100e0, greatest(0e0, (0.2e0 * ats_score + 0.3e0 * (embedding_similarity * 100e0) + 0.5e0 * (llm_score * 10e0)) / (0.2e0 + 0.3e0 + 0.5e0))) * 100e0 + 0.5e0) / 100e0 END AS final_score
FROM (
    SELECT resume_id, job_id, CASE WHEN resume_id % 9 = 0 THEN 0 ELSE 1 END AS hard_filter_pass,
        ((resume_id * 37) % 10001) / 100e0 AS ats_score, sim AS embedding_similarity,
        CASE WHEN resume_id % 4 = 0 THEN CAST(NULL AS DOUBLE) ELSE 1e0 + (resume_id % 10) * 0.9e0 END AS llm_score
    FROM {resumes} r JOIN {similarities} e ON e.vec_id = r.resume_id % 500
) s
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RESUMES, customer=table(spark, sf_dir, "customer"), orders=table(spark, sf_dir, "orders"))


def briefs(spark: SparkSession) -> DataFrame:
    return spark.sql(BRIEFS)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankweave.operators.scoring import similarity_to

    similar = similarity_to(table(spark, sf_dir, "embeddings"), 0)
    return spark.sql(SCORES, resumes=resumes(spark, sf_dir), similarities=similar)


#: The same views for the oracle database, as common table expressions.
SQL_R = f"r AS ({RESUMES.format(customer='customer', orders='orders')})"
SQL_B = f"b AS ({BRIEFS})"
SQL_E = """e AS (
    SELECT v.vec_id, CASE WHEN c < 0 THEN floor((c + 1) / 2 * 10000 + 0.5) / 10000 ELSE floor(c * 10000 + 0.5) / 10000 END AS sim
    FROM (SELECT v.vec_id, least(1, greatest(-1, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]))) AS c FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) v
)"""
SQL_S = f"{SQL_R}, {SQL_E}, s AS ({SCORES.format(resumes='r', similarities='e')})"
