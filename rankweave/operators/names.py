"""A person's name: guessed from the lines around an address, and decided among several sources by votes.

Candidates are entries of lists in a person's row, so that no row is read twice, joined or shuffled. Their tests are computed
once for each distinct one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.functions import person
from rankweave.functions.text import EMAIL, PHONE

#: Score of a name of two words or more, and of one word, by source; what agreement adds; of a portal's file.
SOURCES = {"filename": (82, 82), "email": (80, 52), "llm": (70, 48), "heuristic": (45, 45)}
AGREEMENT, PORTAL = 22, 92
# Warnings that users read.
NO_CANDIDATE = "Could not extract a reliable name — verify from the resume file."
ALL_UNFIT = "Extracted name candidates looked invalid (skills/headers/prose)."
DOUBTFUL = ("Name “", "” is low-confidence (source: ", "). Please confirm before using for outreach.")

# Lines around an address, first lines, lines of a block, longest line, least score of a guess; labels, what parts a line, and junk.
BEFORE, AFTER, FIRST_LINES, BLOCK_LINES, LONGEST, LEAST_SCORE = 5, 1, 8, 12, 55, 20
LABEL, BARS, JUNK = r"(?i)^(name|candidate|full\s*name)\s*[:\-]\s*", r"[|•·,]", r"[:;/\\@]{2,}|\d{3,}"


def key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z]", "")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def lines_to_try(text: Column, header: Column, email: Column) -> Column:
    """The lines that may hold the name, in the order of trying: around the first one with the address, the header, the first ones."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    at = F.array_position(F.transform(lines, lambda x: F.contains(F.lower(x), F.lower(email))), F.lit(True)).cast("int")
    first = F.greatest(F.lit(1), at - BEFORE)
    around = F.when(at > 0, F.slice(lines, first, at + AFTER - first + 1))
    none = F.array().cast("array<string>")
    block = lambda c: F.slice(F.filter(F.transform(F.coalesce(c, none), _strip), lambda x: x != ""), 1, BLOCK_LINES)
    top = F.when(F.coalesce(text, F.lit("")) != F.coalesce(header, F.lit("")), F.slice(lines, 1, FIRST_LINES))
    return F.concat(block(around), block(F.split(header, "\n")), block(top))


def with_guess(people: DataFrame) -> DataFrame:
    """people (email, lines as lines_to_try() gives them) with mailed, the name that the address holds, and guess: the most name-like line, else that name if it fits, else null.

    A line scores once, where it is tried first; equal scores go to more words, then to the earlier line.
    """
    none = F.array().cast("array<string>")
    bare = F.transform(F.coalesce("lines", none), lambda x: _strip(F.regexp_replace(x, LABEL, "")))
    short = F.filter(F.array_distinct(bare), lambda x: (F.length(x) <= LONGEST) & ~person.no_name(x) & ~person.tech_blob(x) & ~person.prose(x))

    def part(line: Column) -> Column:
        phone = line.rlike(PHONE) & (F.length(F.regexp_replace(line, "[^0-9]", "")) >= 10)
        return F.struct(line.alias("line"), _strip(F.split(line, BARS)[0]).alias("left"), line.rlike(EMAIL).alias("mail"), phone.alias("phone"), person.name_words(line).alias("words"))

    def named(x: Column) -> Column:
        left = person.bound(person.without_noise(x["left"]), lambda b: F.coalesce(F.nullif(b, F.lit("")), x["left"]))
        alone = F.size(x["words"]).between(2, 3) & (F.length(x["line"]) < 48) & ~x["line"].rlike(JUNK)
        name = F.when(x["mail"], person.bound(left, lambda b: F.when(~b.rlike(EMAIL), b))).when(x["phone"], left).when(alone, person.cased(F.array_join(x["words"], " ")))
        return F.struct(name.alias("name"), x["line"].alias("line"))

    mailed = F.struct(F.col("mailed").alias("name"), F.lit(None).cast("string").alias("line"))
    rows = people.withColumn("_names", F.transform(short, part)).withColumns({"_names": F.filter(F.transform("_names", named), lambda x: x["name"].isNotNull()), "mailed": person.name_of_mail(F.col("email"))})
    rows = person.tested(rows.withColumn("_names", F.concat("_names", F.array(mailed))), "_names", "line")

    def scored(name: Column, line: Column, wordy: Column, words: Column, pos: Column) -> Column:
        n, capitals = F.size(words), F.forall(words, lambda w: w.rlike("^[A-Z]"))
        shouted = (line == F.upper(line)) & (line != F.lower(line)) & n.between(2, 3)
        points = [
            F.when(n == 2, 25).when(n == 3, 15).when(n == 1, 0).otherwise(-5),
            F.when(F.length(line) < 35, 12).when(F.length(line) < 50, 5).otherwise(0),
            F.when((n > 0) & capitals, 10).otherwise(0),
            F.when(shouted, 8).otherwise(0),
            F.when(line.rlike("[|•·]"), 6).otherwise(0),
            F.when(wordy, -50).otherwise(0),
        ]
        return F.struct(sum(points, F.lit(10)).alias("score"), F.size(F.split(name, r"\s+")).alias("n"), (-pos).alias("order"), name.alias("name"), F.lower(name).alias("low"))

    fit = F.filter("_names", lambda x: x["line"].isNotNull() & x["fits"])
    points = F.transform(fit, lambda x, i: person.bound(person.name_words(x["name"]), lambda words: scored(x["name"], x["line"], x["wordy"], words, i)))
    own = F.element_at("_names", -1)
    rows = rows.withColumns({"_points": points, "_own": F.when(own["fits_alone"], own["name"])}).withColumn("_lows", F.transform("_points", lambda x: x["low"]))
    best = F.array_max(F.filter("_points", lambda x, i: F.array_position("_lows", x["low"]) == i + 1))
    rows = rows.withColumn("_best", best)
    return rows.withColumn("guess", F.coalesce(F.when(F.col("_best.score") >= LEAST_SCORE, F.col("_best.name")), F.col("_own"))).drop("_names", "_points", "_lows", "_own", "_best")


def guessed(people: DataFrame, by: str) -> DataFrame:
    """by, guess: of with_guess()."""
    return with_guess(people).select(by, "guess")


def with_name(people: DataFrame) -> DataFrame:
    """people (filename, email, guess, said: a model's answer, and mailed, if the name in the address is known) with name, source, score, confidence and warning.

    Sources that agree are one candidate with a bonus. What reads like prose, technologies or a heading goes; of the rest the
    one fittest to be shown wins, but one that a line backs gives way to a file's name or an address of about the same fitness.
    """
    bare = lambda c: person.without_noise(F.trim(F.coalesce(F.col(c), F.lit(""))))
    mailed = F.col("mailed") if "mailed" in people.columns else person.name_of_mail(F.col("email"))
    given = F.array(person.name_of_file(F.col("filename")), mailed, bare("said"), bare("guess"))
    # What is shown of a name is the name without noise, if anything is left of it.
    shown = lambda name: person.bound(person.without_noise(name), lambda b: F.coalesce(F.nullif(b, F.lit("")), name))
    entry = lambda x, i: F.struct(x.alias("name"), i.alias("pos"), shown(x).alias("shown"))
    rows = people.withColumn("_given", given).withColumn("_given", F.filter(F.transform("_given", entry), lambda x: x["name"].isNotNull()))
    distinct = F.array_distinct(F.concat(F.transform("_given", lambda x: x["name"]), F.transform("_given", lambda x: x["shown"])))
    rows = person.tested(rows.withColumn("_tests", F.transform(distinct, lambda x: F.struct(x.alias("name")))), "_tests")
    test_of = lambda name: F.filter("_tests", lambda t: t["name"] == name)[0]
    pick = lambda many, one: F.when(many, one[0]).otherwise(one[1])
    portal = F.coalesce(F.col("filename"), F.lit("")).rlike("(?i)naukri|linkedin|indeed")

    def graded(x: Column, t: Column) -> Column:
        pos = x["pos"]
        usable = F.when(pos == 0, True).when(pos == 3, t["fits"]).otherwise(t["fits_alone"])
        # An address of one word, and an answer that only passes as a single word, count less.
        whole = F.when(pos == 2, t["fits"]).otherwise(F.trim(x["name"]).rlike(r"\s"))
        score = F.when((pos == 0) & F.col("_portal"), PORTAL)
        sure = F.lit(None).cast("string")
        for i, (source, points) in enumerate(SOURCES.items()):
            score = score.when(pos == i, pick(whole, points))
            sure = F.when(pos == i, {"filename": pick(whole, ("high", "medium")), "heuristic": F.lit("medium")}.get(source, pick(whole, ("medium", "low")))).otherwise(sure)
        source = F.get(F.array(*map(F.lit, SOURCES)), pos)
        return F.struct(usable.alias("usable"), key(x["name"]).alias("key"), score.alias("score"), F.length(x["name"]).alias("length"), (-pos).alias("order"), source.alias("source"), x["shown"].alias("shown"), sure.alias("sure"))

    rows = rows.withColumn("_portal", portal).withColumn("_given", F.filter(F.transform("_given", lambda x: person.bound(test_of(x["name"]), lambda t: graded(x, t))), lambda x: x["usable"]))
    rows = rows.withColumn("_keys", F.array_distinct(F.transform("_given", lambda x: x["key"])))

    def vote(own: Column) -> Column:
        best = F.array_max(F.transform(own, lambda x: F.struct(x["score"], x["length"], x["order"], x["shown"], x["sure"])))
        source = F.array_join(F.array_sort(F.transform(own, lambda x: x["source"])), "+")
        return F.struct((F.size(own) > 1).alias("more"), F.array_max(F.transform(own, lambda x: x["order"])).alias("order"), source.alias("source"), best.alias("best"))

    rows = rows.withColumn("_votes", F.transform("_keys", lambda k: person.bound(F.filter("_given", lambda x: x["key"] == k), vote)))

    def judged(x: Column, t: Column) -> Column:
        name, source = t["name"], x["source"]
        strong = source.rlike("filename|email")
        fit = ~t["tech"] & ~t["wordy"] & (source.contains("filename") | ~person.no_name(name)) & F.when(strong, t["fits_alone"]).otherwise(t["fits"])
        points = F.when(x["more"], F.least(F.lit(100), x["best"]["score"] + AGREEMENT)).otherwise(x["best"]["score"])
        sure = F.when(x["more"], "high").otherwise(x["best"]["sure"])
        quality = F.when(F.coalesce(fit, F.lit(False)), person.name_quality(name, source))
        fitness = lambda q: F.struct(q.alias("quality"), (points + F.floor(q / 5)).cast("int").alias("score"), F.size(F.split(name, r"\s+")).alias("words"), F.length(name).alias("length"), x["order"].alias("order"), name.alias("name"), source.alias("source"), sure.alias("sure"))
        return person.bound(quality, fitness)

    rows = rows.withColumn("_fit", F.transform("_votes", lambda x: person.bound(test_of(x["best"]["shown"]), lambda t: judged(x, t))))
    rows = rows.withColumns({"_n": F.size("_votes"), "_fit": F.sort_array(F.filter("_fit", lambda x: x["quality"].isNotNull()), asc=False)})
    top = F.try_element_at("_fit", F.lit(1))
    rival = F.try_element_at(F.filter(F.slice("_fit", 2, 4), lambda x: x["source"].rlike("filename|email") & (x["quality"] + 5 >= F.col("_top.quality"))), F.lit(1))
    rows = rows.withColumn("_top", top).withColumn("_won", F.when(F.col("_top.source").contains("heuristic"), F.coalesce(rival, F.col("_top"))).otherwise(F.col("_top")))
    x = lambda c: F.col(f"_won.{c}")
    doubt = (x("sure") == "low") | (x("score") < 55) | (x("source").contains("heuristic") & ~x("source").contains("+"))
    told = F.concat(F.lit(DOUBTFUL[0]), x("name"), F.lit(DOUBTFUL[1]), x("source"), F.lit(DOUBTFUL[2]))
    nothing, unfit = F.col("_n") == 0, F.col("_won").isNull()
    rows = rows.withColumns(
        {
            "name": x("name"),
            "source": F.when(nothing, "none").when(unfit, "rejected").otherwise(x("source")),
            "score": x("score"),
            "confidence": F.when(~unfit & (x("quality") >= 50), x("sure")).otherwise("low"),
            "warning": F.when(nothing, NO_CANDIDATE).when(unfit, ALL_UNFIT).when(doubt, told),
        }
    )
    return rows.drop("_given", "_tests", "_portal", "_keys", "_votes", "_fit", "_n", "_top", "_won")


def resolved(people: DataFrame, by: str) -> DataFrame:
    """by, name, source, score, confidence, warning: of with_name()."""
    return with_name(people).select(by, "name", "source", "score", "confidence", "warning")


def needs_review(name: Column, source: Column, sure: Column, warning: Column) -> Column:
    """Whether someone should look at a name before it is used: doubt, a warning, no name, no second source, or a single word that no address backs."""
    source, name = F.lower(F.coalesce(source, F.lit(""))), F.trim(F.coalesce(name, F.lit("")))
    weak = source.isin("heuristic", "none", "rejected", "") | ((source == "llm") & ~F.coalesce(F.lower(sure) == "high", F.lit(False)))
    single = ~name.rlike(r"\s") & ~source.contains("email")
    return F.coalesce(F.lower(sure) == "low", F.lit(False)) | (F.coalesce(warning, F.lit("")) != "") | (name == "") | weak | single
