"""Hand-made cases of what scores read, merges, grades and display."""

from pyspark.sql import functions as F

from rankweave.functions import person
from rankweave.operators import matching as M

TEXT = """Education
  MBA in Marketing from State University, 2012
Bachelor of Science, 2009
B.Tech in Computer Science, IIT Delhi
MBA in Marketing from State University, 2012
no school here"""


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_education_lines(spark):
    found = one(spark, e=M.education_lines(F.lit(TEXT))).e
    assert [(x.degree, x.field, x.year) for x in found] == [("MBA", "Marketing from State University", "2012"), ("B.S.", "Science", "2009"), ("B.Tech", "Computer Science", None)]
    assert found[0].institution == "arketing from State University, 2012"
    assert found[1].institution == "Bachelor of Science, 2009"
    assert one(spark, e=M.education_lines(F.lit(None).cast("string"))).e == []


def test_settings(spark):
    row = one(spark, a=M.least_score(F.lit("x")), b=M.least_score(F.lit("101")), c=M.shortlist_size(F.lit("0")), d=M.shortlist_size(F.lit("0.5")), e=M.shortlist_size(F.lit("1e30")), f=M.model_score(F.lit(None).cast("string")))
    assert tuple(row) == (0.0, 100.0, 5, 1, 500, 5.0)
    none = F.lit(None)
    mode = one(spark, m=M.bulk_mode(F.lit(10), none.cast("boolean"), none.cast("int"), none.cast("int"), none.cast("double"))).m
    assert tuple(mode) == (True, 20, 30.0, 0)
    assert one(spark, m=M.bulk_mode(F.lit(10), F.lit(True), F.lit(11), F.lit(0), F.lit(1.0))).m.enabled is False


def test_gate_and_answers(spark):
    assert one(spark, g=M.text_gate(F.lit(" \n" + "x" * 39 + "\t"))).g.failed
    assert not one(spark, g=M.text_gate(F.lit("x" * 40))).g.failed
    assert one(spark, g=M.text_gate(F.lit(None).cast("string"))).g.stage == "failed_text"
    rows = {"fence": '```json\n{"score": 7}\n```', "prose": 'it is {"score": 3}, I think', "list": "[1, 2]", "broken": '{"score": ', "none": None}
    got = one(spark, **{k: F.try_variant_get(M.json_object(F.lit(v).cast("string")), "$.score", "int") for k, v in rows.items()})
    assert got.asDict() == {"fence": 7, "prose": 3, "list": None, "broken": None, "none": None}


def test_enrichment(spark):
    need = lambda skills, jobs, *flags: one(spark, n=M.needs_enrichment(F.array(*map(F.lit, skills)), F.array(*map(F.lit, jobs)), *map(F.lit, flags))).n
    assert need([], [], False, False, True)
    assert need(["a"], [], False, False, True)
    assert not need(["a", "b"], [], False, False, True)
    assert not need([], ["j"], False, False, True)
    assert need(["a", "b"], ["j"], False, True, False)
    assert not need([], [], True, True, False)


def test_grade(spark):
    sure = F.create_map(*(F.lit(x) for x in ("name", "high", "email", "high", "phone", "high")))
    none = F.array().cast("array<string>")
    good = one(spark, g=M.extraction_grade(sure, F.lit("high"), F.lit(True), none, F.lit("Ann Lee"), F.lit(True), F.lit("Pune"), F.lit(True))).g
    assert (good.overall, good.warnings) == ("high", [])
    odd = one(spark, g=M.extraction_grade(sure, F.lit("high"), F.lit(True), none, F.lit("SQL"), F.lit(False), F.lit("HTML"), F.lit(False))).g
    assert odd.overall == "low" and odd.confidence["name"] == odd.confidence["location"] == "low" and len(odd.warnings) == 2
    assert one(spark, g=M.extraction_grade(sure, F.lit(None).cast("string"), F.lit(False), none, F.lit("Ann Lee"), F.lit(True), F.lit(None).cast("string"), F.lit(False))).g.overall == "low"


def test_display(spark):
    got = one(spark, a=M.shown_duration(F.lit(59.6)), b=M.shown_duration(F.lit(3600.0)), c=M.shown_duration(F.lit(None).cast("double")), d=M.shown_list(F.array(*map(F.lit, ["a", " ", "b", "c"])), 2), e=M.shown_list(F.lit(None).cast("array<string>")))
    assert tuple(got) == ("1m", "1h", "—", "a, b (+1 more)", "—")


def test_names_and_places(spark):
    fits = lambda name, single=False: one(spark, x=person.plausible_person(F.lit(name).cast("string"), single)).x
    assert [fits(x) for x in ("Ann Lee", "Amit Singh Resume", "ANN LEE", "Anne-Marie O'Neil", "Ravi Kumar Delhi")] == [True] * 5
    assert [fits(x) for x in (None, "", "Al", "ann lee", "Meera", "My Resume", "Python SQL", "Delhi Noida", "Working With Teams", "Based in Pune", "Ab Cd Ef Gh Ij Kl")] == [False] * 11
    assert fits("Meera", True) and not fits("HTMLX", True) and not fits("Pune", True)
    place = lambda x: one(spark, x=person.plausible_place(F.lit(x).cast("string"))).x
    assert place("Pune, India") and place("St. John's")
    assert not any(place(x) for x in (None, "", "x", "JavaScript, HTML", "React-Redux-SQL", "a@b.org", "+91 98765 43210", "y" * 121))
    assert one(spark, x=person.cased(F.lit("ANN o'neil-lee McKay"))).x == "Ann O'Neil-Lee McKay"
    assert one(spark, x=person.without_noise(F.lit("Resume_Ann Lee final-2"))).x == "Ann Lee"
    assert one(spark, x=person.name_quality(F.lit("Ann Lee"), F.lit("email+filename"))).x == 78 + 18 + 8 + 4
