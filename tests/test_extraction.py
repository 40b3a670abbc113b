"""Hand-made cases of names, places, sections, years and whole profiles by rules, and the golden cases."""

from pyspark.sql import functions as F

from rankweave.functions import person
from rankweave.operators import extraction, layout, names, profile

FACTS = "resume_id long, filename string, raw_text string"


def guesses(spark, *texts):
    """Guesses of (text, e-mail) pairs, the first 25 lines as header."""
    rows = spark.createDataFrame([(i, t, e) for i, (t, e) in enumerate(texts)], "id int, text string, email string")
    header = F.array_join(F.slice(F.split("text", "\n"), 1, 25), "\n")
    found = names.guessed(rows.select("id", "email", names.lines_to_try(F.col("text"), header, F.col("email")).alias("lines")), "id")
    return [r.guess for r in found.orderBy("id").collect()]


def test_guesses_near_an_address_with_bars_and_capitals(spark):
    deep = "\n".join(["Worked with the team on projects."] * 30 + ["Ann Lee", "Senior things", "ann@x.org"])
    cases = [
        (deep, "ann@x.org"),
        ("Ann Lee | ann@x.org | Pune", "ann@x.org"),
        ("CURRICULUM VITAE\nANN O'NEIL-LEE\nann@x.org", "ann@x.org"),
        ("Candidate: ann lee", None),
        ("Ann Lee · +91 98765 43210", None),
        ("My novelties include hands-on work\nPython Django", None),
        ("no lines here that fit, at all", "zoe.quinn7@x.org"),
        ("x", "hr@x.org"),
        ("", None),
        (None, None),
        ("Ann Lee\nBob Stone\nANN LEE", None),
    ]
    assert guesses(spark, *cases) == ["Ann Lee", "Ann Lee", "Ann O'Neil-Lee", "Ann Lee", "Ann Lee", None, "Zoe Quinn", None, None, None, "Ann Lee"]


def resolve(spark, **given):
    row = {"id": 1, "filename": None, "email": None, "guess": None, "said": None} | given
    frame = spark.createDataFrame([tuple(row.values())], "id int, filename string, email string, guess string, said string")
    return names.resolved(frame, "id").first()


def test_votes(spark):
    agreed = resolve(spark, filename="Resume_Ann_Lee.pdf", email="ann.lee@x.org", guess="Bob Stone")
    assert (agreed.name, agreed.source, agreed.confidence, agreed.warning) == ("Ann Lee", "email+filename", "high", None)
    alone = resolve(spark, guess="Bob Stone")
    assert (alone.name, alone.source, alone.confidence) == ("Bob Stone", "heuristic", "medium") and "Bob Stone" in alone.warning
    assert resolve(spark, said="Ann Lee", guess="Bob Stone").name == "Ann Lee"
    single = resolve(spark, email="zoequinn@x.org")
    assert (single.name, single.confidence) == ("Zoequinn", "low") and single.warning
    assert resolve(spark, filename="scan001.pdf").source == "none"
    assert resolve(spark).warning == names.NO_CANDIDATE
    # A file's two words pass as a candidate, but not what a name of technologies would be.
    assert resolve(spark, said="Python SQL").source == "none"


def test_golden_cases(spark):
    """The self-contained cases of the golden set."""
    cases = [
        (1, "GARV RANDHAR_Doc-6.pdf", "Software developer with Node.js experience.\nSkills: React, Express.", "Garv Randhar"),
        (2, "Amit_Singh Resume.pdf", "Amitsingh Info\nDeveloper\namit.singh@gmail.com", "Amit Singh"),
        (3, "AYAN NASHINE RESUME (1) (1).pdf", "My novelties include hands-on experience with Python and IoT.", "Ayan Nashine"),
        (4, "scan001.pdf", "My novelties include hands-on experience with Python and Machine Learning.", None),
    ]
    frame = spark.createDataFrame([c[:3] for c in cases], FACTS)
    got = {r.resume_id: r for r in extraction.extracted(frame, 2026).collect()}
    assert [got[c[0]].name for c in cases] == [c[3] for c in cases]
    assert [got[i].confidence["name"] for i in (1, 2, 3, 4)] == ["high", "high", "high", "low"]
    assert got[2].email == "amit.singh@gmail.com" and got[4].sources["name"] == "missing" and len(got[4].warnings) == 2


def test_profiles_of_odd_texts(spark):
    rows = [
        (1, None, None),
        (2, "", ""),
        (3, "x.pdf", "Ann Lee\nann@x.org\nSpringfield, IL\nSummary\nOver 7 years of experience.\nEducation\nMBA, State University 2010\nExperience\nLead Jan 2015 - Mar 2019\nExperience\nIntern 2013 - 2014\nNotice period: 2 weeks"),
        (4, "y.pdf", "based in Pune, skills: x"),
        (5, "z.pdf", "word " * 200_000),
    ]
    got = {r.resume_id: r for r in extraction.extracted(spark.createDataFrame(rows, FACTS).withColumn("notes", F.lit("kept")), 2026).collect()}
    assert len(got) == 5 and all(r.notes == "kept" for r in got.values())
    assert got[1].name is None and got[1].years is None and got[1].education == [] and got[1].confidence == {"name": "low"}
    full = got[3]
    assert (full.name, full.location, full.years, full.notice, full.dated_years) == ("Ann Lee", "Springfield, IL", 7.0, 14, 5.0)
    assert full.section_hits == ["header", "summary", "education", "experience"] and [x.duration for x in full.date_ranges] == ["2015-2019", "2013-2014"]
    assert full.sources["total_years_experience"] == "regex" and full.education[0].degree == "MBA"
    assert got[4].location == "Pune, skills: x"


def test_places(spark):
    place = lambda header, full="": spark.range(1).select(person.place_of(F.lit(header), F.lit(full)).alias("x")).first().x
    assert place("Ann Lee\nSpringfield, IL 62701") == "Springfield, IL"
    assert place("Location: JavaScript, HTML\nNew Delhi, India") == "New Delhi, India"
    assert place("Python, SQL\nDeveloper, Berlin") is None
    assert place("", "now residing in Goa.") == "Goa"
    assert place("Based in Lyon | open") == "Lyon"


def test_sections_in_one_pass(spark):
    text = "Ann\n\nSkills: a, b\nc\nEducation\nSkills\n \nSkills - d\nExperience\n"
    frame = spark.createDataFrame([(1, text), (2, "no heading\nat all"), (3, None), (4, "Education\nMBA")], "resume_id int, raw_text string")
    got = {(r.resume_id, r.section): r.body for r in layout.sections(frame).collect()}
    assert got[1, "header"] == "Ann" and got[1, "skills"] == "a, b\nc\n\nd" and got[1, "education"] == got[1, "experience"] == ""
    assert got[2, "body"] == got[2, "full"] == got[2, "header"] == "no heading\nat all" and got[3, "full"] == ""
    assert got[4, "header"] == "" and got[4, "education"] == "MBA"
    plan = layout.sections(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_years_decided(spark):
    def years(computed=None, method=None, jobs=0, own=0.0, stated=None, student=False, override=None):
        lit = lambda v, t: F.lit(v).cast(t)
        y = profile.two_pass_years(lit(computed, "double"), lit(method, "string"), lit(jobs, "int"), lit(own, "double"), lit(stated, "double"), F.lit(student), lit(override, "double"))
        return tuple(spark.range(1).select(y.alias("y")).first().y)

    assert years(override=60.0) == (50.0, "recruiter_override", "high")
    assert years(9.0, "work_history_sum", 0, student=True)[:2] == (0.0, "student_no_jobs")
    assert years(9.0, "work_history_sum", 1, 1.0, student=True) == (1.0, "student_capped", "medium")
    assert years(9.0, "work_history_sum", 1, 9.0, student=True)[1] == "work_history_sum"
    assert years(5.0, "work_history_span", 2, 5.0, stated=6.0) == (5.5, "work_history_span+explicit", "high")
    assert years(9.0, "work_history_span", 2, 9.0, stated=3.0)[:2] == (3.0, "explicit_phrase")
    assert years(stated=4.0)[:2] == (4.0, "explicit_phrase") and years() == (0.0, "no_real_jobs", "high")
    assert years(0.0, "no_countable_jobs", 1) == (0.0, "no_countable_jobs", "medium")


def test_corrections_by_hand(spark):
    schema = "resume_id long, name string, email string, phone string, location string, years double, notice int, summary string, skills array<string>, certifications array<string>, licenses array<string>, confidence map<string,string>, sources map<string,string>"
    row = lambda i: (i, "Ann", "a@x", "9876543210", "Pune", 9.0, 30, "Fine", ["SQL"], [], None, {"name": "low", "notice_period_days": "high"}, {"name": "llm"})
    profiles = spark.createDataFrame([row(i) for i in (1, 2, 3)], schema)
    fixes = spark.createDataFrame([(1, {"name": " Ann Lee ", "years": "99", "notice": "x", "skills": "Go, Rust, go", "email": " "}), (2, {"notice": "400.7", "licenses": ""})], "resume_id long, fixes map<string,string>")
    jobs = spark.createDataFrame([(2, "Nurse", "X", "2010 - 2014", None), (3, "University course", "X", "2010 - 2014", None)], "resume_id long, title string, company string, duration string, years double")
    got = {r.resume_id: r for r in extraction.corrected(profiles, fixes, jobs, 2026, 5).collect()}
    one, two, three = got[1], got[2], got[3]
    assert (one.name, one.years, one.years_method, one.notice, one.skills, one.email) == ("Ann Lee", 50.0, "recruiter_override", 30, ["Go", "Rust"], "a@x")
    assert one.overrides == {"name": "Ann Lee", "total_years_experience": "50.0", "skills": "Go, Rust"}
    assert one.confidence["name"] == one.confidence["skills"] == "high" and one.sources["name"] == "recruiter_override" == one.sources["total_years_experience"]
    assert (two.years, two.years_method, two.notice, two.licenses) == (4.0, "work_history_sum", 365, []) and two.confidence["name"] == "low"
    assert (three.years, three.years_method, three.overrides, three.licenses) == (0.0, "no_real_jobs", {}, None)


def test_profiles_are_read_once_each(spark):
    """No row is read, joined or shuffled again for its name; a merge joins the model's answer and the jobs alone."""
    frame = spark.createDataFrame([(1, "Resume_Asha_Sharma.pdf", "Asha Sharma\nasha.sharma@example.com\nAsha Sharma\nExperience\nNurse 2010 - 2012")], "resume_id long, filename string, raw_text string")
    found = extraction.extracted(frame, 2026)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "Generate" not in plan
    lists = "array<string>"
    model = frame.select("resume_id", F.lit("Robin Hale").alias("name"), *(F.lit(None).cast("string").alias(c) for c in ("email", "phone", "location", "linkedin", "github", "summary")), F.lit(60).alias("notice"), F.array().cast("array<struct<degree:string,field:string,institution:string,year:string>>").alias("education"), *(F.array().cast(lists).alias(c) for c in ("skills", "licenses", "certifications")))
    jobs = spark.createDataFrame([(1, "Nurse", "Unit", "2010 - 2012", None)], "resume_id long, title string, company string, duration string, years double")
    out = extraction.merged(found, model, jobs, 2026, 5)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    row = out.first()
    assert (row.name, row.email, row.years, row.years_method, row.sources["name"]) == ("Asha Sharma", "asha.sharma@example.com", 2.0, "work_history_sum", "email+filename+heuristic")


def test_words_are_found_among_those_of_their_length(spark):
    words = ["my", "our", "the", "a", "university"]
    frame = spark.createDataFrame([(w,) for w in [*words, "", "y", "my|our", "universities", "theo", None]], "w string")
    assert [r.x for r in frame.select(person.among(F.col("w"), words).alias("x")).collect()] == [True] * 5 + [False] * 5 + [None]
    lines = ["Based in Pune", "a CV", "cvs", "B.Tech", "BTech Ann", "handson", "hands-on", "Full  Stack", "reactor", "www.x", "result driven", "Ann Hale", "MASTER plan", "livesin", "lives in"]
    got = spark.createDataFrame([(x,) for x in lines], "x string").select("x", person.no_name(F.col("x")).alias("fast"), F.col("x").rlike(person.NO_NAME).alias("plain")).collect()
    assert all(r.fast == r.plain for r in got) and {r.fast for r in got} == {True, False}


def test_names_to_review_need_no_shuffle(spark):
    """What is tried for a name stays in its row, from the lines to the winner."""
    frame = spark.createDataFrame([(1, "a.pdf", "a@example.com", None, ["Asha Sharma", "Asha Sharma", "Skills"])], "id long, filename string, email string, said string, lines array<string>")
    out = names.resolved(names.with_guess(frame), "id")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("Join", "Aggregate", "Generate", "Repartition", "Window"))
    assert tuple(out.first())[:3] == (1, "Asha Sharma", "heuristic")
