"""Hand-made cases of the operators."""

import io
import random
import zipfile

from pyspark.sql import functions as F

from rankweave.functions import text as T
from rankweave.operators import briefs, layout, profile, ranking, rules, scoring, store
from rankweave.plans import text_queries
from rankweave.sources import files
from rankweave.streaming import progress


def value(spark, column, **fields):
    frame = spark.createDataFrame([tuple(fields.values())], list(fields)) if fields else spark.range(1)
    return frame.select(column.alias("v")).first().v


def test_cosine_maps_negatives_up(spark):
    a = F.array(F.lit(1.0), F.lit(0.0))
    assert value(spark, scoring.cosine(a, F.array(F.lit(-0.1), F.lit(0.995)))) == 0.45
    assert value(spark, scoring.cosine(a, F.array(F.lit(1.0)))) == 0.0
    assert value(spark, scoring.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0


def test_blend_renormalises(spark):
    none = F.lit(None).cast("double")
    assert value(spark, scoring.blend(F.lit(50.0), F.lit(1.0), none)) == 80.0
    assert value(spark, scoring.blend(none, none, F.lit(7.0))) == 70.0


def test_tokens_drop_stop_words_and_keep_marks(spark):
    assert value(spark, T.tokens(F.col("t")), t="The C++ and Node.js candidate, a X5") == ["c++", "node.js", "x5"]


def test_phone_skips_year_ranges(spark):
    assert value(spark, T.first_phone(F.col("t")), t="2019-2021 then +91 9800000123 end") == "+91 9800000123"


def test_notice(spark):
    for text, days in (("Notice period: 2 weeks", 14), ("immediately available", 0), ("notice of about 3 months", 90), ("none", None)):
        assert value(spark, T.notice_days(F.col("t")), t=text) == days


def test_clean_text(spark):
    assert value(spark, T.clean(F.col("t")), t="  a \t b\r\n\r\n\r\n c  ") == "a b\n\nc"


def test_short_synonyms_fire_inside_words(spark):
    # "kubernetes" holds "be", and so meets the engineering degrees.
    assert value(spark, rules.matches(F.array(F.lit("B.Tech")), ["kubernetes"]))
    assert not value(spark, rules.matches(F.array(F.lit("Nursing")), ["plumbing"]))
    assert value(spark, rules.matches(F.array(F.lit("x")), [""]))
    assert not value(spark, rules.matches(F.array(F.lit("x")), ["", " "]))


def test_missing_notice_passes_at_most(spark):
    fields = {"notice": F.lit(None).cast("int"), "years": F.lit(None).cast("double")}
    assert value(spark, rules.passed({"field": "notice", "operator": "lte", "value": 30}, fields))
    assert not value(spark, rules.passed({"field": "years", "operator": "lte", "value": 30}, fields))


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, 5.0, 1), (2, 6.0, 1)], "k int, a double, b int")
    new = spark.createDataFrame([(2, None, 0), (3, 7.0, 1)], "k int, a double, b int")
    once = store.upsert(old, new, "k", always=("b",))
    assert sorted(map(tuple, once.collect())) == [(1, 5.0, 1), (2, 6.0, 0), (3, 7.0, 1)]
    assert sorted(map(tuple, store.upsert(once, new, "k", always=("b",)).collect())) == sorted(map(tuple, once.collect()))
    assert (2, None, 0) in [tuple(r) for r in store.upsert(old, new, "k", force=True).collect()]


def test_ranks_are_a_permutation(spark):
    s = spark.createDataFrame([(i, 0, int(i % 3 > 0), None if i == 4 else float(i % 5)) for i in range(20)], "resume_id long, job_id long, hard_filter_pass int, final_score double")
    ranks = sorted(r.rank for r in ranking.with_ranks(s).collect() if r.rank)
    assert ranks == list(range(1, len(ranks) + 1))


def test_distinct_words_keep_the_first_spelling(spark):
    assert value(spark, profile.distinct_words(F.array(*map(F.lit, ("SQL", "sql ", "", "Go"))))) == ["SQL", "Go"]


def test_brief_points(spark):
    got = value(spark, briefs.points(F.col("t")), t="- Python work\n2) SQL reports\nRequired: excel, sap and crm.")
    assert got == ["Python work", "SQL reports", "excel", "sap", "crm"]


def test_archives(spark):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name in ("a/x.txt", "b/x.txt", "__MACOSX/x.txt", "../y.txt", ".z.txt", "n.exe"):
            z.writestr(name, "café".encode("latin-1"))
    frame = spark.createDataFrame([("p.zip", bytearray(raw.getvalue())), ("bad.zip", bytearray(b"no")), ("q.txt", bytearray("é".encode()))], "path string, content binary")
    got = sorted((r.name, r.text) for r in files.texts(files.expand_archives(frame)).collect())
    assert got == [("q.txt", "é"), ("x.txt", "café"), ("x_1.txt", "café")]


def test_lines_join_and_gaps_double(spark):
    spans = spark.createDataFrame([(1, 10.0, 0.0, 50.0, "a"), (1, 11.0, 60.0, 70.0, "b"), (1, 12.0, 200.0, 210.0, "c"), (1, 30.0, 0.0, 9.0, "d")], "page int, y double, x0 double, x1 double, text string")
    assert [(r.line_no, r.text) for r in layout.clustered_lines(spans).orderBy("line_no").collect()] == [(0, "a b  c"), (1, "d")]


def test_column_split_needs_spans_on_both_sides_of_the_gap(spark):
    # Mid-x of spans on pages 200 wide; bins are 10 wide, so the valley of each page is bin 6 and the gap 61 to 69.
    pages = {1: [20.0] * 5 + [170.0] * 5, 2: [20.0] * 10, 4: [20.0] * 4 + [170.0] * 3}
    spans = spark.createDataFrame([(p, m - 1, m + 1, 200.0) for p, ms in pages.items() for m in ms], "page int, x0 double, x1 double, width double")
    got = {r.page: (r.spans, r.two_columns, r.valley_bin) for r in layout.column_split(spans).collect()}
    assert got[1] == (10, True, 6) and got[2] == (10, False, None) and got[4] == (7, False, None)
    # Peaks in both halves and a valley in bin 6, but nothing left of the gap.
    pages = {5: [64.0, 65.0] + [72.0] * 6 + [m for k in range(8, 14) for m in [10.0 * k + 2] * 6]}
    spans = spark.createDataFrame([(p, m - 1, m + 1, 200.0) for p, ms in pages.items() for m in ms], "page int, x0 double, x1 double, width double")
    assert [(r.two_columns, r.valley_bin) for r in layout.column_split(spans).collect()] == [(False, None)]


def lines_by_hand(spans):
    """Texts of the lines of a page's spans (y, x0, x1, text)."""
    lines, mean = [], None
    for y, x0, x1, t in sorted(spans, key=lambda s: (round(s[0] / 3.5), s[1], s[0], s[2], s[3])):
        if mean is not None and abs(y - mean) <= 3.5:
            mean = (mean + y) / 2
        else:
            mean = y
            lines.append([])
        lines[-1].append((x0, x1, t))
    out = []
    for line in lines:
        text, end = "", None
        for x0, x1, t in sorted(line, key=lambda s: s[0]):
            text, end = text + ("" if end is None else "  " if x0 - end > 56 else " ") + t, x1
        out.append(text)
    return out


def test_line_cluster_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    pages = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").collect():
        x0 = (320.0 if r.l_orderkey % 2 == 0 and r.l_linenumber % 2 == 0 else 40.0) + r.l_quantity
        pages.setdefault(r.l_orderkey, []).append((r.l_linenumber * 12.0, x0, x0 + 100, f"{r.l_partkey} {r.l_suppkey}"))
    want = sorted((p, n, t) for p, spans in pages.items() for n, t in enumerate(lines_by_hand(spans)))
    assert sorted((r.page, r.line_no, r.text) for r in text_queries.line_cluster(spark, sf).collect()) == want


def test_lines_of_uneven_spans_against_brute_force(spark):
    rng = random.Random(3)
    pages = {p: [(rng.randrange(0, 120) / 4, float(10 * x), 10.0 * x + rng.randrange(1, 40), f"t{x}") for x in range(40)] for p in range(30)}
    spans = spark.createDataFrame([(p, *s) for p, ss in pages.items() for s in ss], "page int, y double, x0 double, x1 double, text string")
    want = sorted((p, n, t) for p, ss in pages.items() for n, t in enumerate(lines_by_hand(ss)))
    assert sorted((r.page, r.line_no, r.text) for r in layout.clustered_lines(spans).collect()) == want


def test_smoothed_rate(spark):
    steps = spark.createDataFrame([(1, 10.0, 10.0), (1, 20.0, 40.0), (1, 30.0, 50.0)], "job int, t double, done double")
    assert abs(progress.smoothed_rates(steps).first().rate - (0.65 * 3 + 0.35 * 1)) < 1e-9
