"""Views for readers: results, figures, export rows and a report in Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.operators.ranking import with_ranks


def results(resumes: DataFrame, scores: DataFrame) -> DataFrame:
    """Every résumé with its score, if any, and rank."""
    return resumes.select("resume_id", "job_id", "filename").join(with_ranks(scores).drop("job_id"), "resume_id", "left")


def stats(view: DataFrame) -> DataFrame:
    """One row of figures per job, in one pass."""
    count = lambda c: F.count_if(c).alias
    return view.groupBy("job_id").agg(
        F.count("*").alias("total"),
        count(F.col("final_score").isNotNull())("scored"),
        count(F.col("hard_filter_pass") == 0)("rejected"),
        count(F.col("final_score").isNull())("failed"),
        count(F.col("rank") <= 5)("shortlisted"),
        F.coalesce(F.max("final_score"), F.lit(0.0)).alias("top_score"),
    )


#: Sections of an export pack, each with the rows that belong to it.
PACK = {
    "all_ranked": lambda: F.lit(True),
    "shortlist": lambda: F.col("shortlisted"),
    "starred": lambda: F.col("hr_status") == "starred",
    "rejected_by_hr": lambda: F.col("hr_status") == "rejected",
    "name_review_queue": lambda: F.col("needs_review") & (F.col("hard_filter_pass") == 1),
    "cross_job_hits": lambda: F.size("appearances") > 0,
}
#: What the short sections give of a row; the others give all of it.
SHORT = {"name_review_queue": ["resume_id", "display_name", "filename", "name_confidence", "name_source", "shortlisted", "rank"], "cross_job_hits": ["resume_id", "display_name", "email", "appearances"]}


def pack_stats(rows: DataFrame) -> DataFrame:
    """One row of figures per job for the head of an export pack. rows: those of pack()."""
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return rows.groupBy("job_id").agg(
        F.count("*").alias("total"),
        yes(F.col("hard_filter_pass") == 1).alias("scored"),
        yes(F.col("shortlisted")).alias("shortlisted"),
        yes(F.col("status") == "rejected").alias("rejected"),
        yes(F.col("status") == "failed").alias("failed"),
        yes(F.col("is_duplicate")).alias("duplicates"),
        yes(F.size("appearances") > 0).alias("seen_elsewhere"),
        yes(F.col("needs_review")).alias("name_review"),
        yes(F.col("hr_status") == "starred").alias("starred"),
    )


def pack(rows: DataFrame) -> DataFrame:
    """(job_id, section, place, line): every row once for each section that it belongs to, as a line of JSON, in one pass.

    rows: job_id, resume_id, rank, display_name, email, filename, shortlisted, hr_status, status, hard_filter_pass,
    needs_review, name_confidence, name_source, is_duplicate, appearances (a list) and whatever else is to be given.
    A job's rows are never brought together; readers order a section by place.
    """
    columns = [c for c in rows.columns if c != "job_id"]
    line = lambda names: F.to_json(F.struct(*names))
    entries = [F.when(F.coalesce(test(), F.lit(False)), F.struct(F.lit(name).alias("section"), line(SHORT.get(name, columns)).alias("line"))) for name, test in PACK.items()]
    tagged = rows.select("job_id", F.coalesce("rank", F.lit(2**31)).alias("rank"), "resume_id", F.explode_outer(F.array_compact(F.array(*entries))).alias("e"))
    return tagged.select("job_id", "e.section", F.struct("rank", "resume_id").alias("place"), "e.line")


def write_pack(rows: DataFrame, head: DataFrame, folder: str) -> None:
    """The pack as JSON lines in folder/job_id=<id>/section=<name>, and one line per job about it in folder/section=head. head: job_id and what is to be said of a job."""
    lines = pack(rows).sortWithinPartitions("job_id", "section", "place").select("job_id", "section", F.col("line").alias("value"))
    lines.write.mode("overwrite").partitionBy("job_id", "section").text(f"{folder}/rows")
    top = head.join(pack_stats(rows), "job_id", "left")
    top.select("job_id", F.to_json(F.struct(*top.columns)).alias("value")).write.mode("overwrite").partitionBy("job_id").text(f"{folder}/head")


def candidate_markdown(c: dict[str, Column]) -> Column:
    """A shortlisted candidate as paragraphs of a hiring summary. c: rank, name, final, ats, similarity, model, email, phone, location, years, skills, jobs (lists of texts), why, review (source and confidence, if it is to be verified), seen (names of jobs), notes."""
    dash = lambda x: F.coalesce(F.nullif(x.cast("string"), F.lit("")), F.lit("—"))
    none = lambda x: F.coalesce(x.cast("string"), F.lit("None"))
    there = lambda x: F.coalesce(x.cast("string"), F.lit("")) != ""
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    listed = lambda x, n: F.slice(F.coalesce(x, F.array().cast("array<string>")), 1, n)
    lines = F.concat(
        F.array(
            text("### #", dash(c["rank"]), " · ", F.coalesce(F.nullif(c["name"], F.lit("")), F.lit("Unknown"))),
            text("- Score: **", none(c["final"]), "** · ATS ", none(c["ats"]), " · Embed ", none(c["similarity"]), " · LLM ", none(c["model"])),
            F.when(there(c["email"]) | there(c["phone"]), text("- Contact: ", dash(c["email"]), " · ", dash(c["phone"]))),
            F.when(there(c["location"]) | c["years"].isNotNull(), text("- Location: ", dash(c["location"]), " · Years: ", none(c["years"]))),
            F.when(F.size(c["skills"]) > 0, text("- Skills: ", F.array_join(listed(c["skills"], 20), ", "))),
            F.when(F.size(c["jobs"]) > 0, F.lit("- Work history:")),
        ),
        F.transform(listed(c["jobs"], 6), lambda w: F.concat(F.lit("  - "), w)),
        F.array(
            F.when(there(c["why"]), text("- Why: ", c["why"])),
            F.when(c["review"].isNotNull(), text("- ⚠️ Verify name (source=", none(c["review"]["source"]), ", conf=", none(c["review"]["confidence"]), ")")),
            F.when(F.size(c["seen"]) > 0, text("- Seen in other jobs: ", F.array_join(listed(c["seen"], 4), ", "))),
            F.when(there(c["notes"]), text("- HR notes: ", c["notes"])),
            F.lit(""),
        ),
    )
    return F.array_join(F.array_compact(lines), "\n")


def export_rows(view: DataFrame, profiles: DataFrame) -> DataFrame:
    """Slim rows: skills as one string of at most 30, education of at most 8 lines."""
    p = profiles.select("resume_id", "name", "email", F.array_join(F.slice("skills", 1, 30), ", ").alias("skills"), F.array_join(F.slice("education", 1, 8), " / ").alias("education"))
    return view.join(p, "resume_id", "left").select("job_id", "rank", "resume_id", F.coalesce(F.nullif(F.trim("name"), F.lit("")), "filename", F.lit("Unknown")).alias("display_name"), "email", "skills", "education", "final_score")


def csv_lines(rows: DataFrame, columns: list[str], always: bool = True, keep: tuple[str, ...] = ("resume_id",)) -> DataFrame:
    """One CSV line per row beside the columns to keep: every field quoted, or only those that need it; quotes doubled, null empty."""

    def quoted(c: str):
        plain = F.coalesce(F.col(c).cast("string"), F.lit(""))
        full = F.concat(F.lit('"'), F.replace(plain, F.lit('"'), F.lit('""')), F.lit('"'))
        return full if always else F.when(plain.rlike('[",\\n\\r]'), full).otherwise(plain)

    return rows.select(*keep, F.concat_ws(",", *(quoted(f"`{c}`") for c in columns)).alias("line"))


#: Columns of the table of results, by the heading that readers see.
TABLE = {
    "Rank": lambda: F.when(F.col("hard_filter_pass") == 1, F.col("rank").cast("string")),
    "Shortlist": lambda: F.when(F.col("shortlisted"), "Yes").otherwise("No"),
    "Candidate": lambda: F.coalesce(F.nullif("display_name", F.lit("")), "filename"),
    "Source file": lambda: F.col("filename"),
    "Name confidence": lambda: F.col("name_confidence"),
    "Duplicate": lambda: F.when(F.col("is_duplicate"), "Yes").otherwise("No"),
    "Status": lambda: F.col("status"),
    "Final": lambda: F.col("final_score"),
    "ATS %": lambda: F.col("ats_score"),
    "Embed": lambda: F.col("embedding_similarity"),
    "LLM": lambda: F.col("llm_score"),
    "Why": lambda: F.col("why"),
    "Matched brief points": lambda: F.array_join("matched", "; "),
    "Missing brief points": lambda: F.array_join("missing", "; "),
}


def csv_table(rows: DataFrame, shortlist_only: bool = False) -> DataFrame:
    """(job_id, resume_id, line) of the table of results; its first line is HEADING. rows: those of pack() with scores, why, matched and missing."""
    shown = rows.where(F.coalesce("shortlisted", F.lit(False))) if shortlist_only else rows
    cells = shown.select("job_id", "resume_id", *(c().alias(k) for k, c in TABLE.items()))
    return csv_lines(cells, list(TABLE), always=False, keep=("job_id", "resume_id"))


HEADING = ",".join(TABLE)


def in_order(rows: DataFrame) -> DataFrame:
    """Results as they are shown: best score first, those without one last, then by id."""
    return rows.orderBy(F.col("final_score").desc_nulls_last(), "resume_id")


def markdown(rows: DataFrame) -> DataFrame:
    """Per job a list of the shortlist (rank, display_name) in rank order."""
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("display_name"))
    return rows.groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("t")))), lambda x: x["t"]), "\n").alias("report"))
