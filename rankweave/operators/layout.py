"""Text cleaning over lines, and page layout: repeated headers, sections, columns and lines of spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions.text import header_of


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line"))


#: What makes a repeated line a page's header or footer, and a page mark.
RUNNING = r"page\s*\d+|^\d+$|confidential|curriculum vitae|\bresume\b"
PAGE_MARK = r"^page\s*\d+(\s*of\s*\d+)?$"


def without_headers(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 800, repeats: int = 3) -> DataFrame:
    """Texts over least_chars characters and 20 lines lose running headers that occur `repeats` times or more, and page marks."""
    lines = lines_of(docs.where(F.length(text) > least_chars), key, text)
    bare = F.lower(F.trim("line"))
    marked = lines.withColumn("copies", F.count("*").over(Window.partitionBy(key, bare))).withColumn("n_lines", F.count("*").over(Window.partitionBy(key)))
    running = F.length(bare).between(3, 80) & (F.col("copies") >= repeats) & bare.rlike(RUNNING)
    gone = (F.col("n_lines") >= 20) & (running | bare.rlike(PAGE_MARK))
    kept = marked.where(~gone).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("body"))
    long = docs.select(key, text).join(kept, key, "left")
    return long.select(key, F.when(F.length(text) > least_chars, F.coalesce("body", F.lit(""))).otherwise(F.coalesce(text, F.lit(""))).alias("body"))


def with_sections(docs: DataFrame, text: str = "raw_text", head: int = 25) -> DataFrame:
    """Adds parts: (section, body) of the text after each heading, on its line or below it, up to the next one; repeated sections are joined.

    "header" is what stands before the first heading; without any heading it is the first lines, and "body" the whole text.
    "full" is always the whole text. Each document is cut where it is read, without a shuffle.
    """
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    entry = lambda name, body: F.struct(name.alias("section"), body.alias("body"))
    cut = docs.withColumn("_lines", F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
    opened = F.transform("_lines", lambda x, i: F.struct(i.alias("at"), header_of(x).alias("h")))
    cut = cut.withColumn("_marks", F.filter(opened, lambda m: m["h"].isNotNull()))

    def body(mark, j):
        below = F.coalesce(F.try_element_at("_marks", j + 2)["at"], F.size("_lines")) - mark["at"] - 1
        rest = F.filter(F.array(mark["h"]["rest"]), lambda x: x != "")
        return entry(mark["h"]["section"], strip(F.array_join(F.concat(rest, F.slice("_lines", mark["at"] + 2, below)), "\n")))

    cut = cut.withColumn("_bodies", F.transform("_marks", body))

    def joined(name):
        # What is empty before the first text of a section leaves no line.
        own = F.transform(F.filter("_bodies", lambda b: b["section"] == name), lambda b: b["body"])
        first = F.array_position(F.transform(own, lambda b: b != ""), F.lit(True)).cast("int")
        return entry(name, F.when(first > 0, F.array_join(F.slice(own, first, F.size(own)), "\n")).otherwise(""))

    found = F.transform(F.array_distinct(F.transform("_bodies", lambda b: b["section"])), joined)
    before = strip(F.array_join(F.slice("_lines", 1, F.try_element_at("_marks", F.lit(1))["at"]), "\n"))
    whole = F.coalesce(F.col(text), F.lit(""))
    plain = F.array(entry(F.lit("header"), F.array_join(F.slice("_lines", 1, head), "\n")), entry(F.lit("body"), whole))
    parts = F.when(F.size("_marks") == 0, plain).otherwise(F.concat(F.array(entry(F.lit("header"), before)), found))
    return cut.withColumn("parts", F.concat(parts, F.array(entry(F.lit("full"), whole)))).drop("_lines", "_marks", "_bodies")


def sections(docs: DataFrame, key: str = "resume_id", text: str = "raw_text", head: int = 25) -> DataFrame:
    """(key, section, body), a row per part that with_sections() finds."""
    return with_sections(docs.select(key, text), text, head).select(key, F.explode_outer("parts").alias("p")).select(key, "p.section", "p.body")


def column_split(spans: DataFrame, bins: int = 20) -> DataFrame:
    """Per page (page, x0, x1, width) the valley between two columns, if spans gather on both sides of one and of a gap around it."""
    mid, width = (F.col("x0") + F.col("x1")) / 2, F.col("width")
    real = (F.col("x1") > F.col("x0")) & (width > 0)
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(mid / width * bins)))
    middle = range(bins // 3, 2 * bins // 3 + 1)
    split = {k: F.lit((k + 0.5) / bins) * width for k in middle}
    counts = [F.count_if(real & (at == k)).alias(f"n{k}") for k in range(bins)]
    left = [F.count_if(real & (mid < x - width * 0.02)).alias(f"left{k}") for k, x in split.items()]
    right = [F.count_if(real & (mid > x + width * 0.02)).alias(f"right{k}") for k, x in split.items()]
    pages = spans.groupBy("page").agg(F.count("*").alias("spans"), F.count_if(real).alias("mids"), *counts, *left, *right)
    valley = F.array_min(F.array(*(F.struct(F.col(f"n{k}").alias("n"), F.lit(k).cast("long").alias("bin"), F.col(f"left{k}").alias("l"), F.col(f"right{k}").alias("r")) for k in middle)))
    lower = F.least(F.greatest(*(f"n{k}" for k in range(bins // 2))), F.greatest(*(f"n{k}" for k in range(bins // 2, bins))))
    pages = pages.select("page", "spans", "mids", valley.alias("v"), lower.alias("lower"))
    found = (F.col("mids") >= 8) & (F.col("lower") >= 3) & (F.col("v.n") <= 0.45 * F.col("lower")) & (F.col("v.l") >= 3) & (F.col("v.r") >= 3)
    return pages.select("page", "spans", found.alias("two_columns"), F.when(found, F.col("v.bin")).alias("valley_bin"))


def clustered_lines(spans: DataFrame, near: float = 3.5, gap: float = 56.0, by: tuple[str, ...] = ("page",)) -> DataFrame:
    """(page, line_no, text): spans (page, y, x0, x1, text) in reading order; a running mean of y decides what shares a line. by: what lines are kept apart by."""
    ordered = spans.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.bround(F.col("y") / near).alias("row"), F.col("x0").alias("x0"), F.col("y").alias("y"), F.col("x1").alias("x1"), F.col("text").alias("t")))).alias("s"))
    start = F.array().cast("array<struct<y:double,items:array<struct<x0:double,k:int,x1:double,t:string>>>>")

    def add(lines, s):
        last = F.element_at(lines, -1)
        same = (F.size(lines) > 0) & (F.abs(last["y"] - s["y"]) <= near)
        item = lambda k: F.array(F.struct(s["x0"].alias("x0"), k.alias("k"), s["x1"].alias("x1"), s["t"].alias("t")))
        longer = F.struct(((last["y"] + s["y"]) / 2).alias("y"), F.concat(last["items"], item(F.size(last["items"]))).alias("items"))
        fresh = F.struct(s["y"].alias("y"), item(F.lit(0)).alias("items"))
        return F.when(same, F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(longer))).otherwise(F.concat(lines, F.array(fresh)))

    def join(done, s):
        joint = F.when(done["x1"].isNull(), F.lit("")).when(s["x0"] - done["x1"] > gap, F.lit("  ")).otherwise(F.lit(" "))
        return F.struct(s["x1"].alias("x1"), F.concat(done["text"], joint, s["t"]).alias("text"))

    lines = ordered.select(*by, F.posexplode(F.aggregate("s", start, add)).alias("line_no", "l"))
    empty = F.struct(F.lit(None).cast("double").alias("x1"), F.lit("").alias("text"))
    text = F.aggregate(F.array_sort("l.items"), empty, join)["text"]
    return lines.select(*by, F.col("line_no").cast("long").alias("line_no"), text.alias("text"))


def reading_order(spans: DataFrame, bins: int = 20) -> DataFrame:
    """(page, two_columns, text): spans (page, width, y, x0, x1, text) as text, a left column in full before the right one.

    Where column_split() finds a valley, a span belongs to the side of its middle; each side has lines of its own.
    """
    split = column_split(spans, bins).select(F.col("page").alias("of_page"), "two_columns", "valley_bin")
    dealt = spans.join(split, spans["page"] == F.col("of_page"))
    at = (F.col("valley_bin") + 0.5) / bins * F.col("width")
    side = F.when(F.col("two_columns") & ((F.col("x0") + F.col("x1")) / 2 >= at), 1).otherwise(0)
    lines = clustered_lines(dealt.withColumn("side", side), by=("page", "two_columns", "side"))
    in_order = lambda rows: F.transform(F.array_sort(rows), lambda x: x["text"])
    sides = lines.groupBy("page", "two_columns", "side").agg(F.array_join(in_order(F.collect_list(F.struct("line_no", "text"))), "\n").alias("text"))
    return sides.groupBy("page", "two_columns").agg(F.array_join(in_order(F.collect_list(F.struct("side", "text"))), "\n\n").alias("text"))
