"""Hand-made cases of streams, caches, ids, stored documents, prompts, pages, duplicates and export packs."""

import json

import pytest
from pyspark.sql import functions as F

from rankweave.operators import layout, prompts, ranking, report, store
from rankweave.plans import text_queries
from rankweave.sources import files
from rankweave.streaming import batches, progress
from tests.test_operators import lines_by_hand

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_stream_that_stops_in_mid_batch_counts_nothing_twice(spark, tmp_path):
    events = spark.createDataFrame([(i, i % 7, float(i)) for i in range(400)], "event_id long, user_id long, value double")
    events.repartition(8, "event_id").write.parquet(f"{tmp_path}/in")
    change = lambda batch: batch.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last"), F.max_by("value", "event_id").alias("value"))
    seen = []

    def stop_once(number):
        seen.append(number)
        if seen == [0, 1]:
            raise RuntimeError("stopped after the rows were there, before the batch was done")

    run = lambda: batches.run(spark, f"{tmp_path}/in", events.schema, change, f"{tmp_path}/log", f"{tmp_path}/checkpoint", files=3, after=stop_once)
    with pytest.raises(Exception, match="stopped after"):
        run()
    run()
    assert seen[:3] == [0, 1, 1]
    log = spark.read.option("basePath", f"{tmp_path}/log").parquet(f"{tmp_path}/log")
    want = rows_of(change(events))
    now = lambda log: rows_of(batches.current(log, "user_id", F.col("last"), ("n",)).select("user_id", "n", "last", "value"))
    assert now(log) == want
    batches.compacted(spark, f"{tmp_path}/log", 1, f"{tmp_path}/small", "user_id", F.col("last"), ("n",))
    small = spark.read.option("basePath", f"{tmp_path}/small").parquet(f"{tmp_path}/small")
    assert now(small) == want and small.count() < log.count()


def test_null_changes_keep_older_values(spark):
    log = spark.createDataFrame([(1, "a", 1, 0), (1, None, 2, 1), (2, None, 1, 1)], "k int, v string, n int, batch int")
    assert rows_of(batches.current(log, "k", F.col("batch"), ("n",)).select("k", "v", "n")) == [(1, "a", 3), (2, None, 1)]


def test_streamed_rates_equal_the_fold(spark, tmp_path):
    steps = [(job, float(t * t), float(t * 10 + job)) for job in range(3) for t in range(1, 13)]
    frame = spark.createDataFrame(steps, "job long, t double, done double")
    for lo, hi in ((0, 20), (20, 80), (80, 1000)):
        frame.where((F.col("t") >= lo) & (F.col("t") < hi)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/steps")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/steps")
    progress.stream_to(progress.streamed_rates(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    last = spark.read.option("basePath", f"{tmp_path}/out").parquet(f"{tmp_path}/out").groupBy("job").agg(F.max_by("rate", "batch").alias("rate"), F.max_by("steps", "batch").alias("steps"))
    want = {r.job: (r.steps, r.rate) for r in progress.smoothed_rates(frame).collect()}
    assert {r.job: (r.steps, pytest.approx(r.rate)) for r in last.collect()} == want


def test_outlook(spark):
    rows = [(1, 1, "p1", 0.55, 10, 10, 1.0), (1, 2, "p2", 0.45, 5, 20, 0.5), (2, 1, "p1", 0.55, 4, 4, None), (3, 1, "p1", 0.55, 0, 0, None), (3, 2, "p2", 0.45, 1, 3, None)]
    got = {r.job: tuple(r)[1:] for r in progress.outlook(spark.createDataFrame(rows, "job int, place int, phase string, weight double, done int, total int, rate double")).collect()}
    assert got == {1: (66.3, "p2", 5, 20, 25.0, 30.0), 2: (100.0, None, None, None, 100.0, None), 3: (33.3, "p2", 1, 3, 33.3, None)}
    part = spark.range(1).select(progress.without_tracker(F.lit(99), F.lit(100), F.lit(False)).alias("a"), progress.without_tracker(F.lit(99), F.lit(100), F.lit(True)).alias("b"), progress.without_tracker(F.lit(1), F.lit(3), F.lit(False)).alias("c")).first()
    assert tuple(part) == (95.0, 100.0, 33.3)


def test_pages_against_brute_force(spark):
    pages = {}
    for r in text_queries._pages(spark, SF).collect():
        pages.setdefault(r.page, []).append(r)
    split = {r.page: r for r in layout.column_split(text_queries._pages(spark, SF)).collect()}
    assert {s.two_columns for s in split.values()} == {True, False}
    for row in text_queries.page_text(spark, SF).collect():
        s, spans = split[row.page], pages[row.page]
        at = (s.valley_bin + 0.5) / 20 * 600 if s.two_columns else float("inf")
        sides = [[(x.y, x.x0, x.x1, x.text) for x in spans if ((x.x0 + x.x1) / 2 >= at) == right] for right in (False, True)]
        assert row.two_columns == s.two_columns and row.text == "\n\n".join("\n".join(lines_by_hand(x)) for x in sides if x)


def test_prompts(spark):
    def prompt(parts, text, budget=3000, facts=None):
        body = F.create_map(*(F.lit(x) for kv in parts.items() for x in kv)) if parts else F.create_map().cast("map<string,string>")
        return spark.range(1).select(prompts.sectioned(body, F.lit(text), facts, budget).alias("p")).first().p

    assert prompt({}, "abc") == "### FULL RESUME TEXT\n\nabc"
    assert prompt({"header": " Ann ", "full": "t"}, "t") == "### HEADER / CONTACT\nAnn\n\n### FULL RESUME TEXT\n\nt"
    long = {"header": "h" * 2000, "experience": "e" * 2000, "education": "d" * 2000, "skills": "s" * 2000, "full": "f" * 9000}
    parts = prompt(long, "f" * 9000).split("\n\n")
    assert [len(x) for x in parts] == [1021, 1015, 1014]
    thin = prompt({"experience": "e" * 700, "full": "f"}, "f" * 9000).split("\n\n")
    assert thin[1] == "### ADDITIONAL TEXT" and len(thin[2]) == 3000 - len(thin[0])
    facts = {"name": F.lit('A "B"'), "phone": F.lit(None).cast("string"), "email": F.lit(""), "education": F.array(F.struct(F.lit("MBA").alias("degree")))}
    assert prompt({}, "x", facts=facts).split("\n\n")[1] == '{\n  "name": "A \\"B\\"",\n  "education": [{"degree":"MBA"}]\n}'


def test_a_filled_cache_computes_nothing(spark):
    wanted = spark.createDataFrame([(1, "m", "a"), (2, "m", "a"), (3, "n", "a"), (4, "m", ""), (5, "ma", ""), (6, "m", None)], "id int, model string, text string")
    asked = []

    def compute(rows):
        asked.append(rows.count())
        return rows.select("key", F.array(F.length("text").cast("double")).alias("embedding"))

    none = spark.createDataFrame([], "key string, model string, embedding array<double>")
    first, new = store.embedded(wanted, none, compute)
    assert asked == [4] and first.select("key").distinct().count() == 4 and new.count() == 4
    again, more = store.embedded(wanted, new, compute)
    assert asked == [4, 0] and more.count() == 0 and rows_of(again.select("id", "embedding")) == rows_of(first.select("id", "embedding"))


def test_ids_and_names(spark):
    old = spark.createDataFrame([(1, 7)], "k int, id long")
    new = spark.range(100).withColumnRenamed("id", "k")
    got = store.numbered(new, "k", "id", old)
    assert sorted(r.id for r in got.collect()) == list(range(8, 108))
    assert rows_of(got) == rows_of(store.numbered(new.repartition(7), "k", "id", old)) and store.numbered(new.limit(0), "k", "id", old).count() == 0
    assert sorted(r.id for r in store.numbered(new, "k", "id").collect()) == list(range(1, 101))
    files_ = spark.createDataFrame([(1, 1, "a.pdf"), (2, 1, "a.pdf"), (3, 2, "a.pdf"), (4, 1, "b.pdf")], "n int, job int, name string")
    there = spark.createDataFrame([(1, "b.pdf")], "job int, name string")
    named = {r.n: r.name for r in store.without_collisions(files_, there, "job", "name", "n").collect()}
    assert named[1] == "a.pdf" and named[3] == "a.pdf" and named[2][8:] == "_a.pdf" and named[4][8:] == "_b.pdf"


def test_documents_with_a_stored_fallback(spark):
    good = "Summary\n" + "word " * 100 + "\nSkills: many"
    listing = spark.createDataFrame([("d/a", "a", 1, 5, "same"), ("d/b", "b", 2, 5, "changed"), ("d/c", "c", 1, 5, good), ("d/e", "e", 1, 5, None)], "path string, name string, modified int, length int, text string")
    stored = spark.createDataFrame([("d/a", 1, 5, "stored a"), ("d/b", 1, 5, "stored b"), ("d/gone", 1, 5, good), ("d/lost", 1, 5, None)], "path string, modified int, length int, text string")
    got = {r.path: r for r in files.documents(listing, stored).collect()}
    assert {p: r.method for p, r in got.items()} == {"d/a": "cached", "d/b": "read", "d/c": "read", "d/e": "read", "d/gone": "cached_text", "d/lost": None}
    assert got["d/a"].text == "stored a" and got["d/b"].text == "changed" and got["d/lost"].text == "" and got["d/lost"].name == "lost"
    assert (got["d/c"].quality, got["d/gone"].quality, got["d/lost"].quality) == ("high", "medium", "low") and got["d/c"].section_hits == ["summary", "skills"]


PEOPLE = [(1, 1, "a@x", "1", 9.0), (2, 1, "a@x", None, 9.5), (3, 1, None, "1", 3.0), (4, 2, "a@x", "1", 1.0), (5, 2, "z@x", None, None), (6, 3, None, "1", 2.0)]


def test_duplicates_and_appearances_by_hand(spark):
    people = spark.createDataFrame(PEOPLE, "resume_id long, job_id long, email string, phone string, final_score double")
    got = {r.resume_id: (r.reasons, r.is_duplicate, r.is_primary, r.duplicate_of) for r in ranking.duplicates(people).collect()}
    assert got == {1: ("email+phone", True, True, 2), 2: ("email", False, True, None), 3: ("phone", True, False, 1)}
    pairs = sorted((r.resume_id, r.other_id, r.reasons, r.place) for r in ranking.prior_appearances(people).collect())
    assert [p for p in pairs if p[0] == 1] == [(1, 4, "email+phone", 2), (1, 6, "phone", 1)]
    assert [p for p in pairs if p[0] == 6] == [(6, 1, "phone", 3), (6, 3, "phone", 2), (6, 4, "phone", 1)] and not [p for p in pairs if p[0] == 5]


def rows_of_joins(spark, df):
    """Rows of the result, and how many rows its joins made."""
    rows = df.collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    seen = spark._jsparkSession.sharedState().statusStore()
    of = seen.executionsList(seen.executionsCount() - 1, 1).apply(0).executionId()
    values, nodes, made = seen.executionMetrics(of), seen.planGraph(of).allNodes(), 0
    for node in (nodes.apply(i) for i in range(nodes.size()) if "Join" in nodes.apply(i).name()):
        metrics = (node.metrics().apply(i) for i in range(node.metrics().size()))
        made += sum(int(values.apply(m.accumulatorId()).replace(",", "")) for m in metrics if m.name() == "number of output rows" and values.contains(m.accumulatorId()))
    return rows, made


def test_appearances_of_a_key_that_many_share(spark):
    people = [(i, i % 4, f"m{i % 3}@x", "1" if i % 2 else None) for i in range(1200)] + [(1200, 9, None, "2"), (1200, 9, None, "2"), (1201, 9, "m1@x", "1"), (1201, 8, "m2@x", None), (1202, None, "m1@x", "1")]
    frame = spark.createDataFrame(people, "resume_id long, job_id long, email string, phone string").withColumn("final_score", F.lit(1.0))
    rows, made = rows_of_joins(spark, ranking.prior_appearances(frame))
    got, want = {}, {}
    for r in rows:
        got.setdefault(r.resume_id, []).append((r.place, r.job_id, r.other_job, r.other_id, r.reasons))
    for k in {p[0] for p in people}:
        pairs = {}
        for mine in (p for p in people if p[0] == k and p[1] is not None):
            for o in (o for o in people if o[1] is not None and o[1] != mine[1]):
                why = {n for n, at in (("email", 2), ("phone", 3)) if mine[at] and mine[at] == o[at]}
                if why:
                    pairs.setdefault((o[1], o[0], mine[1]), set()).update(why)
        found = [(i + 1, mine, job, other, "+".join(sorted(why))) for i, ((job, other, mine), why) in enumerate(sorted(pairs.items(), reverse=True)[:8])]
        if found:
            want[k] = found
    assert {k: sorted(v) for k, v in got.items()} == want
    assert made <= 3 * len(people)  # a row for each key of each person; all pairs would be 250,000 per e-mail


def test_cascade_by_hand(spark):
    scores = spark.createDataFrame([(1, i, float(i)) for i in range(5)] + [(2, 10 + i, 1.0) for i in range(3)], "job_id long, resume_id long, ats_score double")
    got = sorted((r.job_id, r.resume_id) for r in ranking.cascade(scores, 2, 3.5).collect())
    assert got == [(1, 4), (2, 10), (2, 11)]


PACK = "job_id long, resume_id long, rank long, display_name string, email string, filename string, shortlisted boolean, hr_status string, status string, hard_filter_pass int, needs_review boolean, name_confidence string, name_source string, is_duplicate boolean, appearances array<long>"


def test_export_pack(spark, tmp_path):
    rows = spark.createDataFrame(
        [
            (1, 1, 1, "Ann", "a@x", "a.pdf", True, "starred", "scored", 1, True, "low", "heuristic", False, [7, 8]),
            (1, 2, None, "Bob", None, "b.pdf", False, "rejected", "rejected", 0, True, "low", "none", True, []),
            (2, 3, None, None, None, "c.pdf", None, None, "failed", None, None, None, None, None, None),
        ],
        PACK,
    )
    lines = {(r.job_id, r.section, json.loads(r.line)["resume_id"]) for r in report.pack(rows).collect()}
    assert lines == {(1, "all_ranked", 1), (1, "all_ranked", 2), (2, "all_ranked", 3), (1, "shortlist", 1), (1, "starred", 1), (1, "rejected_by_hr", 2), (1, "name_review_queue", 1), (1, "cross_job_hits", 1)}
    head = spark.createDataFrame([(1, "Nurse"), (2, "Cook")], "job_id long, title string")
    report.write_pack(rows, head, str(tmp_path / "pack"))
    hits = spark.read.text(str(tmp_path / "pack/rows")).where("section = 'cross_job_hits'").collect()
    assert [json.loads(r.value) for r in hits] == [{"resume_id": 1, "display_name": "Ann", "email": "a@x", "appearances": [7, 8]}]
    tops = {r.job_id: json.loads(r.value) for r in spark.read.text(str(tmp_path / "pack/head")).collect()}
    assert tops[1] == {"job_id": 1, "title": "Nurse", "total": 2, "scored": 1, "shortlisted": 1, "rejected": 1, "failed": 0, "duplicates": 1, "seen_elsewhere": 1, "name_review": 2, "starred": 1}
    assert tops[2]["failed"] == 1


def test_candidate_markdown(spark):
    lit = lambda v, t="string": F.lit(v).cast(t)
    listed = lambda *v: F.array(*map(F.lit, v)).cast("array<string>")
    full = {
        "rank": lit(1), "name": lit("Ann"), "final": lit(90.5, "double"), "ats": lit(80.0, "double"), "similarity": lit(0.5, "double"), "model": lit(None, "double"), "email": lit("a@x"), "phone": lit(None), "location": lit("Pune"), "years": lit(4.0, "double"),
        "skills": listed("SQL", "Go"), "jobs": listed("Lead @ X"), "why": lit("fits"), "review": F.struct(F.lit("llm").alias("source"), F.lit("low").alias("confidence")), "seen": listed("Cook (job 2)"), "notes": lit(""),
    }
    got = spark.range(1).select(report.candidate_markdown(full).alias("x")).first().x
    assert got == "### #1 · Ann\n- Score: **90.5** · ATS 80.0 · Embed 0.5 · LLM None\n- Contact: a@x · —\n- Location: Pune · Years: 4.0\n- Skills: SQL, Go\n- Work history:\n  - Lead @ X\n- Why: fits\n- ⚠️ Verify name (source=llm, conf=low)\n- Seen in other jobs: Cook (job 2)\n"
